"""Reply trees: paths from root to leaf, ranked by score and formatted as conversations.

DataFrame functions only.  A node knows its parent.  In round k every node is
joined with the node 2^k steps above it, which doubles the reach of its pointer
and adds up what lies between (steps, score, characters), so a thread of any depth
takes a logarithmic number of self-joins and no node is handled with all its tree.
Leaves are ranked by the score of their path; the chosen ones are joined with the
pointers of each round again, which lists the nodes of every path.  Nodes that share
a pointer in large numbers, such as the replies to one root, are joined without
gathering them (see ``skew``).

Template of a turn: ``### role``, a new line, the text, a new line, ``</turn>``, a
new line.  Inside roles and texts, ``\\`` becomes ``\\0``, ``#`` becomes ``\\1``, ``<``
becomes ``\\2`` and, in roles, a new line becomes ``\\3``, so neither marker can occur
in them, and the way back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodesieve.llm.skew import join_one
from lodesieve.sources.scratch import Scratch

END = "</turn>\n"


def escaped(c: Column) -> Column:
    for plain, code in (("\\", "\\0"), ("#", "\\1"), ("<", "\\2")):
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescaped(c: Column) -> Column:
    for plain, code in (("<", "\\2"), ("#", "\\1"), ("\\", "\\0")):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def _role_in(c: Column) -> Column:
    return F.replace(escaped(c), F.lit("\n"), F.lit("\\3"))


def _role_out(c: Column) -> Column:
    return unescaped(F.replace(c, F.lit("\\3"), F.lit("\n")))


def thread_nodes(spark: SparkSession, turns: DataFrame, scratch: Scratch) -> DataFrame:
    """Nodes of linear threads: each turn of a conversation answers the one before it.

    Takes conv_id, turn, role, text; orders turns by turn, role and text (null
    first), so repeated rows and equal turn numbers have a defined place.  Rows
    without conv_id are one thread, whose tree is null.  The order comes from a range
    partitioning over all four columns, so that one long conversation is spread over many tasks.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("tree"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = ["tree", "turn", "role", "text"]
    placed = scratch.save(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("spot", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("spot", 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # one row a partition
    numbered = placed.withColumn("part", part).join(before, "part").withColumn("node", F.col("spot").bitwiseAND((1 << 33) - 1) + F.col("before")).drop("part", "before", "spot", "turn")
    numbered = scratch.save(numbered, "numbered")
    above = numbered.select(F.col("tree").alias("_tree"), (F.col("node") + 1).alias("_node"), F.col("node").alias("parent"))
    both = (F.col("node") == F.col("_node")) & F.col("tree").eqNullSafe(F.col("_tree"))
    return numbered.join(above, both, "left").select("tree", "node", "parent", F.lit(0.0).alias("score"), "role", "text")


def _reached(done: list[DataFrame]) -> DataFrame:
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def format_trees(nodes: DataFrame, scratch: Scratch, per_tree: int = 1, trained_role: str = "assistant") -> DataFrame:
    """``tree, leaf, rank, path_score, n_turns, formatted, loss_spans`` for the per_tree best paths of every tree.

    ``nodes`` has tree, node (unique), parent, score, role and text.  A path's score
    is the sum over its nodes (null: 0); equal scores go by leaf, smaller first.  A
    null parent, or one that isn't in the same table, makes a root.  Null texts and
    roles are empty.  Nodes on or below a cycle have no root and are in no path.
    Of rows that repeat a node the least counts (by tree, parent, score, role and text, null
    first), so that a node is in a path once.  A null tree is a tree like any other; rows
    without node are left out; an empty table gives no rows; further columns are
    ignored.  A conversation is one string: one of more than 2 GB makes the job fail.  ``loss_spans`` lists start and length, in code points of
    ``formatted``, of the texts to train on.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = nodes.where("node is not null").select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"), role.alias("role"), text.alias("text"))
    rows = scratch.save(rows, "rows")
    if rows.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").head(1):
        fields = ["tree", "parent", "score", "role", "text"]
        rows = scratch.save(rows.groupBy("node").agg(F.min(F.struct(*fields)).alias("r")).select("node", "r.*"), "rows-once")
    turns = rows.select("tree", "node", "parent", "score", (F.col("role") == trained_role).alias("trained"), F.concat(F.lit("### "), _role_in(F.col("role")), F.lit("\n")).alias("head"), F.concat(escaped(F.col("text")), F.lit("\n" + END)).alias("body"))
    turns = scratch.save(turns, "turns")
    up = turns.select("tree", "node", "parent", "score", (F.length("head") + F.length("body")).cast("long").alias("chars"))
    # figures of a node cover it and what stands between it and its pointer, the pointer's node left out
    answered = up.where("parent is not null").groupBy("parent").agg(F.lit(1).alias("one")).join(up.select(F.col("node").alias("parent")), "parent", "left_anti").select("parent", F.lit(None).cast(up.schema["parent"].dataType).alias("above"))
    missing = scratch.save(answered, "missing")
    known = up.where("parent is not null").select("tree", "node", "parent", "score", "chars")
    if missing.head(1):
        lost = join_one(known, missing, ["parent"])
        known = known.withColumn("above", F.col("parent")).join(lost.select("node"), "node", "left_anti").unionByName(lost)
    else:
        known = known.withColumn("above", F.col("parent"))
    start = known.drop("parent").unionByName(up.where("parent is null").select("tree", "node", F.lit(None).cast(up.schema["parent"].dataType).alias("above"), "score", "chars"))
    reach = scratch.save(start.select("tree", "node", "above", F.col("score").alias("total"), F.col("chars").alias("sum"), F.lit(1).cast("long").alias("count")), "reach-0")
    done = [reach.where("above is null")]
    rounds, pending = 0, -1
    while True:
        waiting = reach.where("above is not null")
        left = waiting.count()
        if left in (0, pending):  # none, or only nodes that hang on a cycle
            break
        pending = left
        # a pointer's node has its root already or waits too
        higher = waiting.unionByName(_reached(done))
        higher = higher.select(F.col("node").alias("above"), F.col("above").alias("next"), F.col("total").alias("t"), F.col("sum").alias("s"), F.col("count").alias("c"))
        rounds += 1
        reach = scratch.save(join_one(waiting, higher, ["above"], left).select("tree", "node", F.col("next").alias("above"), (F.col("total") + F.col("t")).alias("total"), (F.col("sum") + F.col("s")).alias("sum"), (F.col("count") + F.col("c")).alias("count")), f"reach-{rounds}")
        done.append(reach.where("above is null"))
    rooted = _reached(done).join(up.select("node", "chars"), "node").select("tree", "node", "total", (F.col("count") - 1).alias("depth"), (F.col("sum") - F.col("chars")).alias("offset"))
    rooted = scratch.save(rooted, "rooted")
    leaves = rooted.join(up.select(F.col("parent").alias("node")).where("node is not null"), "node", "left_anti")
    if per_tree == 1:
        best = leaves.groupBy("tree").agg(F.max(F.struct("total", (-F.col("node")).alias("neg"), "depth")).alias("b")).select("tree", (-F.col("b.neg")).alias("leaf"), F.lit(1).alias("rank"), F.col("b.total").alias("path_score"))
    else:  # the limit on the rank is applied before the shuffle too
        best = leaves.select("tree", F.col("node").alias("leaf"), F.col("total").alias("path_score")).withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("path_score"), "leaf"))).where(F.col("rank") <= per_tree)
    best = scratch.save(best.select("tree", "leaf", "rank", "path_score"), "best")
    path = best.select("leaf", F.col("leaf").alias("node"))
    for k in range(rounds):
        jump = scratch.spark.read.parquet(scratch.path(f"reach-{k}")).where("above is not null").select("node", "above")
        path = scratch.save(path.unionByName(path.join(jump, "node").select("leaf", F.col("above").alias("node"))), f"path-{k + 1}")
    on_path = path.join(turns.select("node", "head", "body", "trained"), "node").join(rooted.select("node", "depth", "offset"), "node")
    made = on_path.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("depth", "head", "body", "trained", "offset"))).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["trained"]), lambda t: F.struct((t["offset"] + F.length(t["head"])).alias("start"), (F.length(t["body"]) - F.lit(len(END) + 1)).cast("long").alias("length")))
    made = made.select("leaf", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"])), "").alias("formatted"), spans.alias("loss_spans"))
    return best.join(made, "leaf").select("tree", "leaf", "rank", "path_score", "n_turns", "formatted", "loss_spans")


def parsed(formatted: Column) -> Column:
    """The turns of a formatted conversation, as structs of role and text."""
    segments = F.slice(F.split(formatted, END, -1), F.lit(1), F.size(F.split(formatted, END, -1)) - 1)
    cut = lambda s: F.locate("\n", s)
    return F.transform(segments, lambda s: F.struct(_role_out(F.substring(s, F.lit(5), cut(s) - 5)).alias("role"), unescaped(F.substring(s, cut(s) + 1, F.length(s) - cut(s) - 1)).alias("text")))


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations: turns, and the text under the loss mask."""
    turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return formatted.withColumn("turns", parsed(F.col("formatted"))).select(F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(turns, "").cast("binary"), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
