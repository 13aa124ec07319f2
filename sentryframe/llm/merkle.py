"""A Merkle manifest of a table: one tree of a fixed fanout per group, and one over the groups' roots, by slot pivots.

Rows are numbered within their group by a range partitioning: partitions are numbered apart and the counts of (group,
partition) are summed, so a group of any size is spread over tasks. A level is one aggregation: conditional aggregates
spread the children of a parent into `fanout` slot columns; all columns concatenated give the parent's hash, and all but a
child's own slot its siblings. Each level is written to the shared folder and holds a fanout-th of the rows of the one below.
Proofs go down from the root: a run of children takes its parent's proof once and adds the siblings of each slot, so whole
proofs travel with runs and never with rows.

A leaf is the hash of its columns, each as `-` if null and else as its number of UTF-8 bytes, `:` and its value; a hash is a
SHA-256 of the inputs joined, in lower-case hex. Groups and keys go from small to large, nulls first.

Cases: rows with equal keys in a group go by their leaf hashes, so that repeated rows keep one order; a lone row's leaf is
the root of its group, and a lone group's root the root; an empty table has no rows and no root; null and empty texts
differ; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

PROOF = "array<struct<before:string,after:string>>"
PART_BITS = 33  # monotonically_increasing_id holds the partition above so many bits


def field(c: Column) -> Column:
    """A value as it enters a leaf."""
    text = c.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(*columns: Column) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(proof, leaf, lambda h, p: F.sha2(F.concat(p["before"], h, p["after"]), 256))


def siblings(proof: Column) -> Column:
    """All siblings' hashes as one text, level by level from the leaf, left to right."""
    return F.array_join(F.transform(proof, lambda p: F.concat(p["before"], p["after"])), "")


def group_key(c: Column) -> Column:
    """A group as a text that is never null and sorts as the group does, null first."""
    return F.when(c.isNull(), "").otherwise(F.concat(F.lit("="), c.cast("string")))


def number(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds idx (0, 1, ... within grp by order) and n (rows of grp). A group is numbered in as many tasks as hold its rows."""
    ranged = rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order)
    held = table(ranged.withColumn("at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("at", PART_BITS)
    counts = held.groupBy("grp", part.alias("part")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("here"))
    group = Window.partitionBy("grp")
    sums = F.sum("here").over(group.orderBy("part"))
    counts = table(counts.select("grp", "part", (F.col("first") - sums + F.col("here")).alias("shift"), F.sum("here").over(group).alias("n")), "counts")
    out = held.withColumn("part", part).join(counts, ["grp", "part"])  # of known size, as it was written: Spark broadcasts it below its threshold alone
    return out.withColumn("idx", F.col("at") - F.col("shift")).drop("at", "part", "shift")


def _runs(nodes: DataFrame, fanout: int, carried: Sequence[str]) -> DataFrame:
    """One row for each run of children: grp, up (the parent's idx), n (nodes of this level in grp), and slot columns s0, s1, ..."""
    slot, child = F.pmod("idx", F.lit(fanout)), F.struct("hash", *carried)
    slots = [F.max(F.when(slot == k, child)).alias(f"s{k}") for k in range(fanout)]
    return nodes.groupBy("grp", F.floor(F.col("idx") / fanout).alias("up")).agg(F.max("n").alias("n"), *slots)


def _children(fanout: int) -> Column:
    """The slot columns of a run from left to right; the last run of a group has fewer."""
    return F.array_compact(F.array(*[F.col(f"s{k}") for k in range(fanout)]))


def _joined(children: Column) -> Column:
    return F.array_join(F.transform(children, lambda c: c["hash"]), "")


def build(nodes: DataFrame, fanout: int, carried: Sequence[str] = ()) -> tuple[list[DataFrame], DataFrame]:
    """The runs of each level from the leaves on, and the roots (grp, root). nodes: grp, idx, n, hash and the carried columns of leaves.

    A group that has a single node left stays as it is while others go on."""
    levels, done = [], []
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        runs = table(_runs(nodes.filter("n > 1"), fanout, carried if not levels else ()), "runs")
        done.append(nodes.filter("n = 1").select("grp", F.col("hash").alias("root")))
        parent = F.sha2(_joined(_children(fanout)), 256)
        nodes = runs.select("grp", F.col("up").alias("idx"), F.ceil(F.col("n") / fanout).alias("n"), parent.alias("hash"))
        levels.append(runs)
        most = -(-most // fanout)
    roots = nodes.filter("n = 1").select("grp", F.col("hash").alias("root"))
    for d in done:
        roots = roots.unionByName(d)
    return levels, roots


def prove(levels: list[DataFrame], roots: DataFrame, fanout: int, carried: Sequence[str] = ()) -> DataFrame | None:
    """grp, hash, proof and the carried columns of every leaf in a run; None without runs. roots: grp, proof and more columns, which leaves get too.

    A level's last run of its group hangs under the root; any other under a node of the level above."""
    more = [c for c in roots.columns if c not in ("grp", "proof")]
    nodes = None
    for k in range(len(levels) - 1, -1, -1):
        last = F.col("n") <= fanout
        met = levels[k].filter(last).join(roots, "grp")
        if nodes is not None:
            met = met.unionByName(levels[k].filter(~last).join(nodes, ["grp", "up"]))
        each = met.withColumn("children", _children(fanout)).select("grp", "up", "proof", *more, "children", F.posexplode("children").alias("slot", "child"))
        below = [F.col(f"child.{c}").alias(c) for c in ("hash", *carried)] if k == 0 else [(F.col("up") * fanout + F.col("slot")).alias("up")]
        left, right = F.slice("children", F.lit(1), F.col("slot")), F.slice("children", F.col("slot") + 2, F.lit(fanout))
        pair = F.struct(_joined(left).alias("before"), _joined(right).alias("after"))
        nodes = each.select("grp", *below, F.concat(F.array(pair), "proof").alias("proof"), *more)
    return nodes


def manifest(rows: DataFrame, fanout: int = 8) -> DataFrame:
    """Adds subroot, root and proof to leaves. rows: grp (as by group_key), key, leaf, and any other columns but idx, n, hash.

    proof: the hashes to the left and to the right in the leaf's run at each level, up to the root."""
    carried = [c for c in rows.columns if c not in ("grp", "leaf")]
    rows = table(rows.withColumnRenamed("leaf", "hash"), "leaves")  # narrow: a range partitioning reads its rows twice
    leaves = number(rows, ["key", "hash"])
    levels, roots = build(leaves, fanout, carried)
    roots = table(roots, "subroots")
    tops = number(roots.select(F.lit("").alias("grp"), F.col("grp").alias("key"), F.col("root").alias("hash")), ["key"])
    top_levels, top = build(tops, fanout, ["key"])
    top = table(top, "root").withColumn("proof", F.array().cast(PROOF))
    if top_levels:
        subroots = prove(top_levels, top, fanout, ["key"]).select(F.col("key").alias("grp"), F.col("hash").alias("subroot"), "root", "proof")
    else:
        subroots = roots.select("grp", F.col("root").alias("subroot"), "root", F.array().cast(PROOF).alias("proof"))
    subroots = table(subroots, "subproofs")
    lone = leaves.filter("n = 1").join(subroots, "grp").select("hash", *carried, "subroot", "root", "proof")
    proven = prove(levels, subroots, fanout, carried)
    out = lone if proven is None else proven.select(lone.columns).unionByName(lone)
    return out.withColumnRenamed("hash", "leaf")


def document_rows(docs: DataFrame) -> DataFrame:
    """grp, key, leaf and changed of documents: changed is the leaf after A-Z of the text became lower case, where 3 divides the CRC-32 of the decimal id, else null."""
    names = ("doc_id", "source", "lang", "n_chars")
    text = F.col("text").cast("string")
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    leaf = lambda t: leaf_hash(*map(F.col, names), t)
    return docs.select(group_key(F.col("lang")).alias("grp"), F.col("doc_id").alias("key"), leaf(text).alias("leaf"), F.when(hit, leaf(lower)).alias("changed"))
