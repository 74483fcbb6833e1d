"""Helpers of the text operators: column choice, Arrow blocks of bounded size, stored intermediate tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from arenalytics.session import shared_folder, ship_package

BLOCK_BYTES = 1 << 20
"""UTF-8 bytes of text that a Python worker holds in one piece; a longer text is a block of its own."""

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 300
"""Whole texts are long rows: unless the session sets its own number, so many go to a Python worker at once."""


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(frame: DataFrame, purpose: str) -> DataFrame:
    """The frame written to the shared folder and read again: lineage ends here, and Spark knows its size."""
    path = shared_folder(frame.sparkSession, purpose)
    frame.write.parquet(path)
    out = frame.sparkSession.read.schema(frame.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables of :func:`stored` that nothing reads any more: what was made of them is stored itself."""
    for frame in frames:
        spark = frame.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(frame.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def map_blocks(
    frame: DataFrame, schema, start: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Apply ``start()(block)`` to blocks of about ``block_bytes`` of the text column, in Python workers.

    ``start`` runs once per task, so it may open a model; what it keeps at module level outlives the task.
    """
    spark = frame.sparkSession
    ship_package(spark)
    if spark.conf.get(ARROW_ROWS) == "10000":
        spark.conf.set(ARROW_ROWS, str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            for block in split(batch, text, block_bytes):
                result = work(block)
                if result is not None and result.num_rows:
                    yield result

    return frame.mapInArrow(run, schema)


def split(batch: pa.RecordBatch, text: str, block_bytes: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``block_bytes`` of text each."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths, dtype=np.int64) // block_bytes
    edges = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [batch.num_rows]))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield batch.slice(a, b - a)


def strings(block: pa.RecordBatch, column: str) -> list[str]:
    """Values of a text column, null as the empty text."""
    return [x or "" for x in block.column(column).to_pylist()]


def result(schema: list[tuple[str, pa.DataType]], *columns) -> pa.RecordBatch:
    """A record batch of the named columns; lists and numpy arrays are converted."""
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=t) for c, (_, t) in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in schema])


def binaries(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Consecutive runs of ``flat`` as little-endian binary values, ``counts`` elements each."""
    ends = np.concatenate(([0], np.cumsum(counts, dtype=np.int64))) * flat.itemsize
    data = np.ascontiguousarray(flat).view(np.uint8)
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)]
    ).cast(pa.binary())


LONG_KEY = 256
"""Longer keys are not kept: they hardly come again, and a few of them could fill a worker's memory."""


class Cache(dict):
    """A dictionary that makes missing values by a function of many keys.

    When it is full, its entries become the older generation, from which those still in use come back; so it holds
    ``2 * limit`` entries at most, none with a key of over ``LONG_KEY``.
    """

    def __init__(self, make: Callable[[list], list], limit: int = 250_000):
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def all(self, keys: list) -> list:
        """Values of all keys; the missing ones are made together."""
        values = list(map(self.get, keys))
        lost = {k for k, v in zip(keys, values, strict=True) if v is None} if None in values else ()
        if lost:
            found = {k: v for k in lost if (v := self.older.get(k)) is not None}
            new = [k for k in lost if k not in found]
            found.update(zip(new, self.make(new), strict=True))
            if len(self) + len(found) > self.limit:
                self.older = dict(self)
                self.clear()
            self.update((k, v) for k, v in found.items() if not isinstance(k, (str, bytes)) or len(k) <= LONG_KEY)
            values = [found[k] if v is None else v for k, v in zip(keys, values, strict=True)]
        return values
