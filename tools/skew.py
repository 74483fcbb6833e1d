"""Write a copy of a test data folder in which one user and one server hold a third of the events or more.

python tools/skew.py SOURCE TARGET
"""

from __future__ import annotations

import shutil
import sys
from pathlib import Path

import duckdb

SKEWED = """
copy (
  select event_id*10 + case when event_id%3=0 then 0 else event_id%5 end event_id,
    case when event_id%300=0 then (select min(ts) from read_parquet('{src}')) + interval 9 day else ts end ts,
    case when event_id%3=0 then 1 else user_id end user_id, event_type, value, props
  from read_parquet('{src}')
) to '{dst}' (format parquet)
"""


def main(source: str, target: str) -> None:
    out = Path(target)
    out.mkdir(parents=True, exist_ok=True)
    for file in Path(source).glob("*.parquet"):
        if file.name == "events.parquet":
            duckdb.execute(SKEWED.format(src=file, dst=out / file.name))
        else:
            shutil.copy(file, out / file.name)


if __name__ == "__main__":
    main(*sys.argv[1:3])
