"""A Merkle manifest of a table: digests of rows, a tree over each partition's rows in order, a tree over the partitions.

Trees are built natively, block by block. A block is an ordered array of at most 2^LEVELS nodes; its levels are
collapsed by one expression (sequence, slice, transform, aggregate), and the roots of blocks are the nodes of the next
round. Then the way goes down again: each block hands every one of its nodes the siblings within the block, in front
of the siblings of the block itself. A round is a thousandth of the one before; no task holds more than a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, work_table

LEVELS = 10
PROOF = "array<struct<left:boolean,hash:string>>"


def digest(*columns: Column) -> Column:
    """sha256, lowercase hexadecimal, of the values one after the other: each as its UTF-8 byte count, a colon and the
    value, or a hyphen if it is null."""
    told = lambda s: F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))
    return F.sha2(F.concat(*[told(c.cast("string")) for c in columns]), 256)


def positions(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """df with pos, the place of each row among those of its group, from 0, and n, how many they are.

    Rows are sorted by range, so a group may lie in many partitions; what is before each of them comes from counts,
    a row for each partition and group. Nulls come first, and form a group.
    """
    sort = [F.col(c).asc_nulls_first() for c in [group, *order]]
    placed = work_table(df.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part"), F.col(group).alias("_group")).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    own = Window.partitionBy("_group")
    before = F.sum("_rows").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_rows")
    starts = counts.select("_part", "_group", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(own).alias("n"))
    met = placed.join(starts, (part == F.col("_part")) & F.col(group).eqNullSafe(F.col("_group")))
    return met.withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_group", "_shift")


def depth(n: Column) -> Column:
    """Levels above n nodes until one is left: the bits of n - 1."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def _up(hashes: Column, levels: Column) -> Column:
    """Levels of a block, the lowest first: every two consecutive nodes become one, a last one alone does so by itself."""

    def above(acc, _):
        below = F.element_at(acc, -1)
        pairs = F.sequence(F.lit(0), F.floor((F.size(below) - 1) / 2).cast("int"))
        node = lambda i: F.sha2(F.array_join(F.slice(below, 2 * i + 1, F.lit(2)), ""), 256)
        return F.concat(acc, F.array(F.transform(pairs, node)))

    rounds = F.when(levels > 0, F.sequence(F.lit(1), levels)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(rounds, F.array(hashes), above)


def _block_levels(n: Column, done: int) -> Column:
    """Levels that the blocks of round `done` collapse in a group of n leaves."""
    return F.greatest(F.least(depth(n) - LEVELS * done, F.lit(LEVELS)), F.lit(0)).cast("int")


def blocks_up(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(tables of blocks by round, (grp, n, top)) of nodes (grp, n, pos, hash, more): more is a struct to be kept."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    tables, done = [], 0
    while True:
        gathered = F.array_sort(F.collect_list(F.struct("pos", "hash", "more")))
        blocks = work_table(nodes.groupBy("grp", "n", F.shiftright("pos", LEVELS).alias("block")).agg(gathered.alias("nodes")))
        tables.append(blocks)
        top = F.get(F.element_at(_up(F.col("nodes.hash"), _block_levels(F.col("n"), done)), -1), F.lit(0))
        roots = blocks.select("grp", "n", F.col("block").alias("pos"), top.alias("hash"), F.lit(None).cast("struct<x:int>").alias("more"))
        done += 1
        if most <= 1 << (LEVELS * done):
            return tables, work_table(roots.select("grp", "n", F.col("hash").alias("top")))
        nodes = work_table(roots)


def proofs_down(tables: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(grp, pos, hash, more, proof, over) of all nodes: proof has the siblings from each node up to its group's top and
    those that tops (grp, proof, over) brings; over is handed down as it is."""
    above = tops.withColumn("pos", F.lit(0).cast("long"))
    for done in range(len(tables) - 1, -1, -1):
        up = above.select(F.col("grp").alias("_grp"), F.col("pos").alias("block"), "proof", "over")
        met = tables[done].join(up.withColumnRenamed("block", "_block"), F.col("grp").eqNullSafe(F.col("_grp")) & (F.col("block") == F.col("_block")))
        met = met.withColumn("up", _up(F.col("nodes.hash"), _block_levels(F.col("n"), done)))
        heights = F.when(F.size("up") > 1, F.sequence(F.lit(0), F.size("up") - 2)).otherwise(F.array().cast("array<int>"))

        def sibling(j: Column, k: Column) -> Column:
            at = F.call_function("shiftright", j, k)
            return F.struct((at % 2 == 1).alias("left"), F.get(F.get(F.col("up"), k), at.bitwiseXOR(F.lit(1))).alias("hash"))

        def node(x: Column, j: Column) -> Column:
            own = F.transform(heights, lambda k: sibling(j, k))
            return F.struct(x["pos"].alias("pos"), x["hash"].alias("hash"), x["more"].alias("more"), F.concat(own, F.col("proof")).alias("proof"))

        above = met.select("grp", F.inline(F.transform("nodes", node)), "over")
    return above


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    step = lambda h, p: F.when(p["hash"].isNull(), h).when(p["left"], F.concat(p["hash"], h)).otherwise(F.concat(h, p["hash"]))
    return F.aggregate(proof, leaf, lambda h, p: F.sha2(step(h, p), 256))


def build(leaves: DataFrame, by: str, order: str) -> DataFrame:
    """(by, order, more, leaf, proof, subroot, root) of leaves (by, order, leaf, more): more is a struct to be kept.

    Leaves of one value of `by` ascend by `order`, ties by leaf; while there are several nodes, every two consecutive
    ones become the digest of both, a last one alone that of itself. What remains is the subroot; subroots, ordered by
    `by` (null first, bytewise), lead to the root in the same way. proof: the siblings from the leaf to the root,
    {left, hash}, hash null where there is none. An empty table has no root, and gives an empty one.
    """
    with Scratch() as inner:
        placed = positions(leaves, by, [order, "leaf"])
        keyed = placed.select(F.col(by).alias("grp"), "n", "pos", F.col("leaf").alias("hash"), F.struct(F.col(order).alias("key"), "more").alias("more"))
        tables, tops = blocks_up(keyed)
        parts = positions(tops.select(F.lit(0).alias("all"), F.col("grp").alias("part"), "top"), "all", ["part"])
        parts = parts.select(F.col("all").alias("grp"), "n", "pos", F.col("top").alias("hash"), F.struct("part").alias("more"))
        upper, root = blocks_up(parts)
        none = F.array().cast(PROOF)
        over = proofs_down(upper, root.select("grp", none.alias("proof"), F.struct("top").alias("over")))
        over = work_table(over.select(F.col("more.part").alias("grp"), "proof", F.struct(F.col("hash").alias("subroot"), F.col("over.top").alias("root")).alias("over")))
        out = proofs_down(tables, over)
        out = out.select(F.col("grp").alias(by), F.col("more.key").alias(order), F.col("more.more").alias("more"), F.col("hash").alias("leaf"), "proof", "over.subroot", "over.root")
    inner.drop(out)
    return out


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def audit(docs: DataFrame, tampered: Column, change: dict[str, Column], by: str = "lang", order: str = "doc_id", columns: list[str] = COLUMNS) -> DataFrame:
    """(order, leaf, proof, subroot, root, folded_root, verified): the manifest of docs, and whether each row still leads
    to its root once `change` is made to the rows of which `tampered` holds. Nulls, empty and very long values, and
    repeated rows are leaves like others; columns beside `columns` don't count, whatever their names."""
    after = [change.get(c, F.col(c)) for c in columns]
    again = F.when(F.coalesce(tampered, F.lit(False)), digest(*after))
    leaves = docs.select(F.col(by).alias("_by"), F.col(order).alias("_order"), digest(*map(F.col, columns)).alias("leaf"), F.struct(again.alias("again")).alias("more"))
    with Scratch() as inner:
        out = build(work_table(leaves), "_by", "_order")
        out = out.withColumn("folded_root", folded(F.coalesce("more.again", "leaf"), F.col("proof")))
        out = out.select(F.col("_order").alias(order), "leaf", "proof", "subroot", "root", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
    inner.drop(out)
    return out
