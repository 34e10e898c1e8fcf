"""Mixing sources to target weights, with DataFrame functions only.

Each source has a budget in words. Every document has a fixed point on a circle of 2**64 hash values; a
source takes its documents as many whole times as the budget allows, and once more those whose point lies
below a threshold. Thresholds come from histograms: words by source and hash bucket, a running sum to find
the bucket in which the budget ends, and a finer histogram of that bucket alone. Thresholds are nested: a
smaller budget takes a subset of what a larger one takes. Nothing is sorted but histograms of 2**16 buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, free_name, work_table

BITS = 16
#: A document is taken at most so many times.
MOST = 3
WEIGHTS = (1, 2, 3)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def point(doc_id: Column) -> Column:
    """The hash bits that place a document: 15 hexadecimal digits of the md5 of its id as text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(by_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Adds the target of each source to (source, source_size).

    The sources, by code point with null last, weigh `weights`, repeating, and share all words. A target
    above `most` times its source's size stops there, and the excess is shared by weight among the others
    until none is above. This is a water level: with x = most * size / weight, sources of x up to the level
    stop, the others get weight * level. From the level without stops it rises to its place in steps, each one
    sum over the sources. They are ordered by range, so no task holds them all; only sums reach the driver.
    """
    spark = by_source.sparkSession
    ordered = by_source.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    ordered = work_table(ordered.select("source", "source_size", F.monotonically_increasing_id().alias("at")))
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND(2**33 - 1)
    counts = sorted(tuple(r) for r in ordered.groupBy(part.alias("part")).count().collect())  # a row a partition
    before = [(p, sum(n for _, n in counts[:i])) for i, (p, _) in enumerate(counts)]
    offsets = F.broadcast(spark.createDataFrame(before, "part long, before long"))
    turn = F.col("before") + within
    kinds = F.array(*[F.lit(w) for w in weights])
    sources = ordered.withColumn("part", part).join(offsets, "part").withColumn("turn", turn)
    sources = sources.withColumn("weight", F.element_at(kinds, (F.col("turn") % len(weights) + 1).cast("int")))
    sources = work_table(sources.select("source", "source_size", "weight", (F.col("source_size") * float(most) / F.col("weight")).alias("x")))
    level, stopped = -1.0, None
    while True:
        stops = F.col("x") <= level
        s = sources.agg(
            F.sum("source_size"), F.coalesce(F.sum(F.when(stops, F.col("source_size") * most)), F.lit(0)), F.sum(F.when(~stops, F.col("weight"))), F.count(F.when(stops, 1))
        ).first()
        if s[2] is None or s[3] == stopped:  # all stop, or none more
            break
        level, stopped = float(s[0] - s[1]) / float(s[2]), s[3]
    free = F.lit(s[2] is not None) & (F.col("x") > level)
    return sources.select("source", "source_size", F.when(free, F.col("weight") * level).otherwise(F.col("source_size") * float(most)).alias("target"))


def _boundary(parts: DataFrame, budget: Column, bucket: str) -> DataFrame:
    """Per source of (source, budget..., bucket, words): the bucket in which the budget ends and the words before it."""
    w = Window.partitionBy("key").orderBy(bucket)
    return (
        parts.withColumn("before", F.coalesce(F.sum("words").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .filter((F.col("before") <= budget) & (budget < F.col("before") + F.col("words")))
        .select("key", bucket, "before")
    )


def _keyed(rows: DataFrame) -> DataFrame:
    # a null source needs a key that no source can have: its text stands after a mark
    return rows.withColumn("key", F.concat(F.when(F.col("source").isNull(), "n").otherwise("s"), F.coalesce("source", F.lit(""))))


def plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(key, source_size, target, full, limit) for each source of sized (key, source, size, point): all of a source is
    taken `full` times, and once more what has its point below `limit`."""
    first = F.shiftright("point", 60 - BITS)
    second = F.shiftright("point", 60 - 2 * BITS).bitwiseAND(2**BITS - 1)
    third = F.shiftright("point", 60 - 3 * BITS).bitwiseAND(2**BITS - 1)
    # 2**16 sums a source at most, from partial sums: the only table that holds every source
    hist = work_table(sized.groupBy("key", "source", first.alias("b1")).agg(F.sum("size").alias("words")))
    goals = _keyed(targets(hist.groupBy("key", "source").agg(F.sum("words").alias("source_size")).drop("key"), weights, most))
    goals = (
        goals.withColumn("full", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
        .select("key", "source_size", "target", "full", "rest")
    )
    one = _boundary(hist.join(goals, "key"), F.col("rest"), "b1")
    goals = work_table(goals.join(one.withColumnRenamed("before", "before1"), "key", "left"))
    # only the boundary bucket is looked at again
    near = sized.join(goals, "key").filter(first == F.col("b1"))
    two = _boundary(near.groupBy("key", second.alias("b2")).agg(F.sum("size").alias("words"), F.first(F.col("rest") - F.col("before1")).alias("left1")), F.col("left1"), "b2")
    goals = goals.join(two.withColumnRenamed("before", "before2"), "key", "left")
    near = sized.join(goals, "key").filter((first == F.col("b1")) & (second == F.col("b2")))
    last = near.groupBy("key", third.alias("b3")).agg(F.sum("size").alias("words"), F.first(F.col("rest") - F.col("before1") - F.col("before2")).alias("left2"))
    # of the last, finest bucket all is taken if that comes nearer to the budget
    before = F.coalesce(F.sum("words").over(Window.partitionBy("key").orderBy("b3").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = last.withColumn("before", before).groupBy("key").agg(F.max(F.when(F.col("before") + F.col("words") / 2 <= F.col("left2"), F.col("b3"))).alias("b3"))
    bucket = F.shiftleft(F.shiftleft(F.col("b1"), BITS) + F.coalesce("b2", F.lit(0)), 60 - 2 * BITS) + F.shiftleft(F.coalesce("b3", F.lit(-1)) + 1, 60 - 3 * BITS)
    limit = F.when(F.col("b1").isNull(), F.when(F.col("rest") > 0, F.lit(2**60)).otherwise(F.lit(0))).otherwise(bucket)
    return work_table(goals.join(last, "key", "left").select("key", "source_size", "target", "full", limit.alias("limit")))


def _times(most: int) -> Column:
    return F.least(F.col("full") + F.when(F.col("point") < F.col("limit"), 1).otherwise(0), F.lit(most))


def _sized(docs: DataFrame) -> DataFrame:
    return _keyed(work_table(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), point(F.col("doc_id")).alias("point"))))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """All of docs (doc_id, text, source) with size, source_size, target, times and taken = times * size.

    size: words, 0 for a null text. times: 0 (left out) to `most`. Reruns agree, as do equal rows: the decision
    depends on doc_id, source and the sums; rows of one doc_id and source are taken together. A null source is a
    source of its own, a null doc_id hashes as an empty text; an empty table gives an empty table. Further columns
    of docs are not looked at.
    """
    with Scratch() as inner:
        sized = _sized(docs)
        out = sized.join(plan(sized, weights, most), "key").withColumn("times", _times(most))
    inner.drop(out)
    return out.select("doc_id", "source", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))


def resample(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The rows of docs that the mix takes, each as many times as it takes it, with all columns of docs.

    Texts don't move: each row meets its source's line of the plan.
    """
    with Scratch() as inner:
        goals = plan(_sized(docs), weights, most).select("key", "full", "limit")
    inner.drop(goals)
    few = goals.limit(100_001).count() <= 100_000
    mark = free_name(docs.columns)
    goals = goals.toDF(mark + "key", mark + "full", mark + "limit")
    key = F.concat(F.when(F.col("source").isNull(), "n").otherwise("s"), F.coalesce("source", F.lit("")))
    times = F.least(F.col(mark + "full") + F.when(point(F.col("doc_id")) < F.col(mark + "limit"), 1).otherwise(0), F.lit(most))
    met = docs.join(F.broadcast(goals) if few else goals, key == F.col(mark + "key"))
    return met.withColumn(mark, F.explode(F.array_repeat(F.lit(0), times.cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])
