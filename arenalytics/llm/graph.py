"""Connected components of an edge table by hooking and pointer jumping, in a few rounds of joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arenalytics.llm.common import discard, stored

CELL = 256
"""Members of a key that one task compares with each other at a time."""


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b): the smallest node that can be reached.

    Every round gives a node, and the node it points at, the smallest label among its neighbours, then follows each
    label once. Labels only fall, so the rounds end when the table stays as it was. All rows stay in tables of the shared
    folder, of which only the result is left; the driver sees one digest per round. Nodes may be of any type that has an order. No edges give an empty result.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).where("a != b").distinct()
    both = stored(both, "edges")
    first = both.groupBy("a").agg(F.min("b").alias("b"))
    labels = stored(first.select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels")
    digest = _digest(labels)
    while digest.n:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("least"))
        held = labels.join(near, F.col("node") == F.col("a"), "left")
        lower = F.least("label", "least").alias("label")
        hooked = held.select("node", lower).union(held.select(F.col("label").alias("node"), lower))
        hooked = stored(hooked.groupBy("node").agg(F.min("label").alias("label")), "hooked")
        discard(labels)
        target = hooked.select(F.col("node").alias("to"), F.col("label").alias("next"))
        target = target.where(F.col("to") != F.col("next"))
        jumped = hooked.join(target, F.col("label") == F.col("to"), "left")
        labels = stored(jumped.select("node", F.coalesce("next", "label").alias("label")), "labels")
        discard(hooked)
        before, digest = digest, _digest(labels)
        if digest == before:
            break
    discard(both)
    return labels.withColumnRenamed("label", "component")


def _digest(labels: DataFrame):
    """Number of rows, and two sums over hashes of them that tell tables apart."""
    hashes = [F.xxhash64("node", "label"), F.xxhash64("label", "node")]
    return labels.agg(F.count("*").alias("n"), *[F.bit_xor(h) for h in hashes], F.sum(hashes[0].cast("decimal(20,0)"))).first()


def links(members: DataFrame, confirm: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs that share a key of ``members`` (key, id) and are confirmed.

    ``confirm`` keeps the rows of pairs (a, b) that are links. First each member is compared with the smallest of its
    key. Then, where a key still has members of several components, all its pairs from different components are compared,
    in cells of some ``CELL`` members. Pairs of one component need no link; no other pair is left out.
    """
    # Nearly all keys are single, so they are dealt out once, uncombined, for both the smallest member and the join.
    members = members.repartition("key")
    shared = members.groupBy("key").agg(F.min("id").alias("centre"), F.max("id").alias("last")).where("centre != last")
    held = stored(members.join(shared.select("key", "centre").hint("shuffle_hash"), "key"), "members")
    star = held.where("id != centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
    edges = stored(confirm(star).select("a", "b"), "star-links")
    named = held.join(components(edges), F.col("id") == F.col("node"), "left")
    named = named.select("key", "id", "centre", F.coalesce("component", "id").alias("label"))
    named = stored(named, "labelled")
    split = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n"))
    split = split.where("low != high and n > 2").select("key", F.ceil(F.col("n") / CELL).cast("int").alias("cells"))
    rest = stored(named.where("id != centre").join(split, "key").drop("centre"), "split-members")
    cell = F.pmod(F.xxhash64("id"), F.col("cells")).cast("int")
    left = rest.select("key", F.col("id").alias("a"), F.col("label").alias("la"), cell.alias("cell"), F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("to"))
    right = rest.select("key", F.col("id").alias("b"), F.col("label").alias("lb"), cell.alias("to"), F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"))
    pairs = left.join(right, ["key", "cell", "to"]).where("a < b and la != lb").select("a", "b").distinct()
    return edges.union(stored(confirm(pairs).select("a", "b"), "further-links"))
