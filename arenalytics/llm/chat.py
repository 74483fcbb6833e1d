"""Chat formatting of reply trees.

Messages answer one another; a path leads from a root to a leaf. Pointers to parents are doubled by self-joins: after k
rounds a message knows its ancestor 2^k steps up and the sums on the way, so the number of rounds is the logarithm of the
longest path, and a long or wide tree stays spread over all tasks. The best leaves of each tree are chosen by score, their
paths are climbed with the kept pointers, and each path becomes one formatted conversation with a loss mask.

The template: ``[INST] `` opens a user's turn, ``[SYS] `` a system's, ``[ANS] `` an assistant's and ``[ROLE] name`` with a new
line any other; ``</s>`` ends each. Where a text holds one of these strings, a backslash goes in after its first sign, one
more where there are some already, so the texts come back unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arenalytics.llm.common import stored

# The marks of the template.
OPENING = {"user": "[INST] ", "system": "[SYS] ", "assistant": "[ANS] "}
OTHER, END = "[ROLE] ", "</s>"
CONTROL = r"(/?(?:INST|SYS|ANS|ROLE)\]|/?s>)"
LEARNT = "assistant"


def escaped(text: Column) -> Column:
    """The text without any control string."""
    return F.regexp_replace(text, r"([\[<])(\\*)" + CONTROL, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\[<])\\(\\*)" + CONTROL, "$1$2$3")


def role_name(role: Column) -> Column:
    """A role on one line, without marks."""
    named = F.coalesce(role, F.lit(""))
    return F.replace(F.replace(F.replace(named, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("]"), F.lit("%5D"))


def named_role(name: Column) -> Column:
    return F.replace(F.replace(F.replace(name, F.lit("%5D"), F.lit("]")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def opening(role: Column) -> Column:
    known = F.lit(None).cast("string")
    for name, mark in OPENING.items():
        known = F.when(role == name, F.lit(mark)).otherwise(known)
    return F.coalesce(known, F.concat(F.lit(OTHER), escaped(role_name(role)), F.lit("\n")))


def turn(role: Column, text: Column) -> Column:
    """One formatted turn; a null text is empty."""
    return F.concat(opening(role), escaped(F.coalesce(text, F.lit(""))), F.lit(END))


def from_turns(rows: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Messages of flat conversations, each turn the answer to the one before: (tree, id, parent, role, text, score).

    Turns of one number are ordered by role and hash of the text; rows that repeat are turns of their own. A conversation
    becomes one row in the end, so its turns may meet in one task.
    """
    tie = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    place = F.row_number().over(Window.partitionBy("tree").orderBy("order", "role", "tie")).cast("bigint")
    rows = rows.select(F.col(conv).alias("tree"), F.col(order).alias("order"), F.col(role).alias("role"), F.col(text).alias("text"), tie.alias("tie"))
    rows = rows.withColumn("id", place)
    parent = F.when(F.col("id") > 1, F.col("id") - 1).alias("parent")
    return rows.select("tree", "id", parent, "role", "text", F.lit(0.0).alias("score"))


def ranked_paths(messages: DataFrame, best: int = 1) -> DataFrame:
    """(leaf, branch, score, node, tie, place, offset) of the messages on the ``best`` paths of each tree.

    ``leaf`` and ``node`` are (tree, id) structs, ``branch`` is the path's place by mean score, from 1, ties to the longer
    path, then to the smaller leaf; ``place`` counts messages from the root, ``offset`` the formatted characters before the
    message. A null score counts 0. A message whose parent is null or unknown is a root. Messages that answer each other
    in a ring, and what hangs on them, have no root and are on no path. Of messages with one tree and id the least by
    parent, score, size and hash counts.
    """
    turns = _sized(messages)
    least = F.min(F.struct("up", "score", "own", "tie"))
    nodes = stored(turns.groupBy("node").agg(least.alias("least")).select("node", "least.*"), "messages")
    known = nodes.select(F.col("node").alias("at"))
    answers = nodes.where("up is not null").join(known, F.col("up") == F.col("at"), "left").withColumn("up", F.col("at")).drop("at")
    roots = nodes.where("up is null")
    sums = ["node", "up", F.lit(1).cast("bigint").alias("n"), F.col("own").alias("size"), "score", "own", "tie"]
    table = stored(answers.select(*sums).union(roots.select(*sums)), "steps")
    # Sums run over a message and its ancestors below ``up``; without ``up`` they run to the root.
    jumps, before, left = [], None, table.where("up is not null").count()
    while left and left != before:
        waiting = table.where("up is not null")
        jumps.append(waiting.select(F.col("node").alias("at"), F.col("up").alias("above")))
        target = table.select(F.col("node").alias("at"), F.col("up").alias("next"), *[F.col(c).alias(f"more_{c}") for c in ("n", "size", "score")])
        moved = waiting.join(target, F.col("up") == F.col("at"))
        moved = moved.select("node", F.col("next").alias("up"), *[(F.col(c) + F.col(f"more_{c}")).alias(c) for c in ("n", "size", "score")], "own", "tie")
        table = stored(moved.union(table.where("up is null")), "steps")
        before, left = left, table.where("up is not null").count()
    whole = table.where("up is null").select("node", "n", "size", "score", "own", "tie")
    parents = jumps[0].select(F.col("above").alias("answered")).distinct() if jumps else known.where("false").withColumnRenamed("at", "answered")
    leaves = whole.join(parents, F.col("node") == F.col("answered"), "left_anti")
    mean = F.col("score") / F.col("n")
    order = Window.partitionBy("node.tree").orderBy(F.desc("mean"), F.desc("n"), "node")
    leaves = leaves.withColumn("mean", mean).withColumn("branch", F.row_number().over(order)).where(F.col("branch") <= best)
    chosen = stored(leaves.select(F.col("node").alias("leaf"), "branch", F.col("mean").alias("score"), "node"), "leaves")
    for step in reversed(jumps):
        climbed = chosen.join(step, F.col("node") == F.col("at")).select("leaf", "branch", "score", F.col("above").alias("node"))
        chosen = stored(chosen.union(climbed), "climbed")
    places = whole.select(F.col("node").alias("at"), F.col("n").alias("place"), (F.col("size") - F.col("own")).alias("offset"), "tie")
    return chosen.join(places, F.col("node") == F.col("at")).drop("at")


def _sized(messages: DataFrame) -> DataFrame:
    """(node, up, score, own, tie, role, text): keys, formatted characters, and a hash that tells messages of one id apart."""
    up = F.when(F.col("parent").isNotNull(), F.struct("tree", F.col("parent").alias("id")))
    text = F.coalesce(F.col("text"), F.lit(""))
    return messages.select(
        F.struct("tree", "id").alias("node"), up.alias("up"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
        F.char_length(turn(F.col("role"), text)).cast("bigint").alias("own"), F.xxhash64("role", text).alias("tie"), "role", text.alias("text"),
    )


def conversations(messages: DataFrame, best: int = 1) -> DataFrame:
    """(tree, branch, leaf, score, formatted, mask) of the best paths of each tree, one formatted conversation each.

    ``mask`` lists where the assistant's texts stand: (start, length) in characters, escaped texts without marks. Columns of
    ``messages``: tree, id, parent, role, text, score; others aren't read. A null tree is a tree, a null text is
    empty, a null role is an empty one. One path becomes one row, so it has to fit in one; trees may be of any size.
    An empty table gives an empty result.
    """
    texts = _sized(messages).select(F.col("node").alias("at"), F.col("tie").alias("own_tie"), "role", "text")
    same = (F.col("node") == F.col("at")) & (F.col("tie") == F.col("own_tie"))
    rows = ranked_paths(messages, best).join(texts, same)
    listed = F.array_sort(F.array_distinct(F.collect_list(F.struct("place", "offset", "role", "text"))))
    paths = rows.groupBy("leaf", "branch", "score").agg(listed.alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda t: turn(t["role"], t["text"])), "")

    def span(t: Column) -> Column:
        start = t["offset"] + F.char_length(F.lit(OPENING[LEARNT]))
        return F.struct(start.alias("start"), F.char_length(escaped(t["text"])).cast("bigint").alias("length"))

    mask = F.transform(F.filter("turns", lambda t: t["role"] == LEARNT), span)
    return paths.select(F.col("leaf.tree").alias("tree"), "branch", F.col("leaf.id").alias("leaf"), "score", formatted.alias("formatted"), mask.alias("mask"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, unescaped."""
    parts = F.split(formatted, END, -1)
    parts = F.slice(parts, 1, F.size(parts) - 1)

    def read(part: Column) -> Column:
        rest = F.substr(part, F.lit(len(OTHER) + 1))
        name = F.substring_index(rest, "\n", 1)
        role, text = named_role(unescaped(name)), F.substr(rest, F.char_length(name) + 2)
        for known, mark in OPENING.items():
            role = F.when(F.startswith(part, F.lit(mark)), F.lit(known)).otherwise(role)
            text = F.when(F.startswith(part, F.lit(mark)), F.substr(part, F.lit(len(mark) + 1))).otherwise(text)
        return F.struct(role.alias("role"), unescaped(text).alias("text"))

    return F.transform(parts, read)


def read_learnt(formatted: Column, mask: Column) -> Column:
    """The texts under the mask, unescaped, one after the other."""
    cut = lambda m: unescaped(F.substring(formatted, (m["start"] + 1).cast("int"), m["length"].cast("int")))
    return F.array_join(F.transform(mask, cut), "")
