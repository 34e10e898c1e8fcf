"""Long time series (ts, key, value): gaps, steps, visible peaks, buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import recent
from .rates import milliseconds


#: Parts of the time from the first tick to the last, in which keys and ticks meet.
PARTS = 256


def with_gaps(samples: DataFrame, ticks: DataFrame, key: str, ts: str, value: str, parts: int = PARTS) -> DataFrame:
    """A row for each tick and each key from the key's first sample on; null where it has none. Ticks are distinct; a sample at a time
    that is no tick isn't there.

    Keys meet ticks by parts of the time: a key goes to every part from that of its first sample on, and ticks to their
    own, so it's a join on equal parts. Only where a key was born within a part, some of that part's ticks go again."""
    numeric = dict(ticks.dtypes)[ts] not in ("timestamp", "timestamp_ntz")
    at = (lambda c: F.col(c).cast("long")) if numeric else (lambda c: F.unix_micros(F.col(c).cast("timestamp")))
    first, last = ticks.agg(F.min(at(ts)), F.max(at(ts))).first()  # of one row
    first, last = first or 0, last or 0
    width = (last - first) // parts + 1
    part = lambda c: F.floor((c - first) / width)
    born = samples.groupBy(key).agg(F.min(ts).alias("_born")).withColumn("_at", at("_born"))
    # a key that is born after the last tick meets none
    spans = born.filter(F.col("_at") <= last).select(key, "_at", F.explode(F.sequence(F.greatest(part(F.col("_at")), F.lit(0).cast("long")), part(F.lit(last)))).alias("_part"))
    own = ticks.select(ts).distinct().withColumn("_part", part(at(ts)))
    grid = own.join(spans, "_part").filter(at(ts) >= F.col("_at"))
    return grid.join(samples.select(key, ts, value), [key, ts], "left").select(key, ts, value)


def steps(df: DataFrame, key: str, ts: str, value: str, end: Column) -> DataFrame:
    """Each sample holds until the next, the last to `end`: (key, start, stop, value)."""
    nxt = F.lead(ts).over(Window.partitionBy(key).orderBy(ts))
    return df.select(key, F.col(ts).alias("start"), F.coalesce(nxt, end).alias("stop"), value)


def visible_peak(df: DataFrame, ts: str, value: str, milliseconds_shown: int) -> DataFrame:
    """The largest value within the window before the newest sample, 0 at least."""
    return recent(df, ts, milliseconds_shown).agg(F.greatest(F.coalesce(F.max(value), F.lit(0.0)), F.lit(0.0)).alias("peak"))


def has_data(df: DataFrame, key: str, ts: str, value: str, oldest: Column) -> DataFrame:
    """For each key, whether its newest value that isn't a gap is no older than `oldest`."""
    last = F.max(F.when(F.col(value).isNotNull(), F.col(ts)))
    return df.groupBy(key).agg(F.coalesce(last >= oldest, F.lit(False)).alias("has_data"))


def latest(df: DataFrame, key: str, ts: str, value: str, keep_old: bool = True) -> DataFrame:
    """Each key's value at its newest time; with keep_old its newest that isn't null."""
    rows = df.filter(F.col(value).isNotNull()) if keep_old else df
    return rows.groupBy(key).agg(F.max_by(value, ts).alias(value))


def distinct_steps(df: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Rows whose value differs from the one before."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(ts))
    return df.withColumn("_before", before).filter(~F.col(value).eqNullSafe(F.col("_before")) | F.col("_before").isNull()).drop("_before")


def reverse_offset(df: DataFrame, ts: str, out: str = "offset_ms") -> DataFrame:
    """Milliseconds to the newest row, 0 or less."""
    newest = df.agg(F.max(ts).alias("_newest"))
    return df.crossJoin(F.broadcast(newest)).withColumn(out, milliseconds(F.col(ts)) - milliseconds(F.col("_newest"))).drop("_newest")  # of one row


def clamp_bucket(width_ms: int, window_ms: int) -> tuple[int, int]:
    """Bucket of 1 s to 24 h, window of a bucket to 90 days."""
    width = min(max(width_ms, 1000), 86_400_000)
    return width, min(max(window_ms, width), 90 * 86_400_000)


def bucket_totals(df: DataFrame, ms: Column, width_ms: int, keys: list[str], total: Column, out: str = "total") -> DataFrame:
    return df.groupBy((ms - F.pmod(ms, F.lit(width_ms))).alias("start_ms"), *keys).agg(F.sum(total).alias(out))


def fill_buckets(buckets: DataFrame, first_ms: int, last_ms: int, width_ms: int, out: str = "total") -> DataFrame:
    """Every bucket from first to last, oldest first, those that are missing with 0."""
    spark = buckets.sparkSession
    grid = spark.range(first_ms, last_ms + 1, width_ms).withColumnRenamed("id", "start_ms")
    return grid.join(buckets, "start_ms", "left").withColumn(out, F.coalesce(out, F.lit(0)))


def stacked(df: DataFrame, bucket: str, ordinal: str, total: str, out: str = "stacked") -> DataFrame:
    """Running total over the keys of a bucket, in a fixed order."""
    return df.withColumn(out, F.sum(total).over(Window.partitionBy(bucket).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, 0)))


def stacked_peak(df: DataFrame, bucket: str, total: str) -> DataFrame:
    """The highest sum over the keys of a bucket: the top of a stack, 0 at least."""
    return df.groupBy(bucket).agg(F.sum(total).alias("_sum")).agg(F.coalesce(F.max("_sum"), F.lit(0)).alias("peak"))


def clamped(df: DataFrame, value: str, top: Column) -> DataFrame:
    """Values above the top of an axis are drawn there."""
    return df.withColumn(value, F.least(F.col(value), top))


def fill_between(buckets: DataFrame, width_ms: int, out: str = "total") -> DataFrame:
    """Every bucket from the first to the last that there is, those that are missing with 0."""
    ends = buckets.agg(F.min("start_ms").alias("a"), F.max("start_ms").alias("z"))  # of one row
    grid = ends.filter("a is not null").select(F.explode(F.sequence("a", "z", F.lit(width_ms).cast("long"))).alias("start_ms"))
    return grid.join(buckets, "start_ms", "left").withColumn(out, F.coalesce(out, F.lit(0)))
