"""Token accounting over event logs: what is billable, one count a request, high water of the running output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.durations import iso_to_ms
from ..functions.texts import fold

FIELDS = ("input", "output", "cache_read", "cache_creation")
SYNTHETIC = "<synthetic>"


def billable() -> Column:
    """An assistant's record with a real model, usage and a message id that is no API error."""
    return (
        ~F.coalesce("isApiErrorMessage", F.lit(False))
        & (F.col("type") == "assistant")
        & F.col("message.model").isNotNull()
        & (F.col("message.model") != SYNTHETIC)
        & F.col("message.usage").isNotNull()
        & F.col("message.id").isNotNull()
    )


def requests(records: DataFrame, keys: list[str], keep: Column | None = None) -> DataFrame:
    """Flat billable records, and those of which `keep` holds: keys, request, family, ms, sidechain, the four counts, ord."""
    n = lambda f: F.coalesce(F.col(f"message.usage.{f}"), F.lit(0)).cast("long")
    return records.filter(billable() if keep is None else F.coalesce(billable(), F.lit(False)) | keep).select(
        *keys,
        F.coalesce("requestId", F.lit("")).alias("request_id"),
        F.col("message.id").alias("message_id"),
        fold(F.col("message.model")).alias("family"),
        iso_to_ms(F.col("timestamp")).alias("ms"),
        F.coalesce("isSidechain", F.lit(False)).alias("sidechain"),
        n("input_tokens").alias("input"),
        n("output_tokens").alias("output"),
        n("cache_read_input_tokens").alias("cache_read"),
        n("cache_creation_input_tokens").alias("cache_creation"),
        "ord",
    )


def once(flat: DataFrame, keys: list[str]) -> DataFrame:
    """One row a request of each key: fields of its first record by ord, output the highest of all. Aggregates are
    partial, so a request repeated very often is no hot spot."""
    first = F.min_by(F.struct("family", "ms", "sidechain", "input", "cache_read", "cache_creation"), "ord").alias("first")
    grouped = flat.groupBy(*keys, "request_id", "message_id").agg(first, F.max("output").alias("output"))
    return grouped.select(*keys, "request_id", "message_id", "first.*", "output")


def totals(single: DataFrame, by: list[str]) -> DataFrame:
    return single.groupBy(*by).agg(
        *[F.sum(f).alias(f) for f in FIELDS],
        F.count_if(~F.col("sidechain")).alias("main_messages"),
        F.count_if("sidechain").alias("sidechain_messages"),
    )


def by_family(single: DataFrame) -> DataFrame:
    """Totals of the families, with their place in the fixed order, which they are sorted by."""
    from ..functions.texts import ordinal

    return totals(single, ["family"]).withColumn("ordinal", ordinal(F.col("family"))).orderBy("ordinal", "family")


def by_session(single: DataFrame, session: str = "session") -> DataFrame:
    """Totals of each session, and the sum of its four counts."""
    return totals(single, [session]).withColumn("total", sum((F.col(f) for f in FIELDS[1:]), F.col(FIELDS[0])))


def grand_total(single: DataFrame) -> DataFrame:
    """One row: the totals of everything, zeros if there is nothing."""
    made = totals(single, [])
    return made.select(*[F.coalesce(c, F.lit(0)).alias(c) for c in made.columns])


def by_bucket(buckets: DataFrame, families: list[str], value: str = "output") -> DataFrame:
    """(start_ms, a column for each family, total): what a bucket lacks is 0."""
    each = [F.coalesce(F.sum(F.when(F.col("family") == f, F.col(value))), F.lit(0)).alias(f) for f in families]
    return buckets.groupBy("start_ms").agg(*each, F.sum(value).alias("total"))


def last_duration(records: DataFrame, keys: list[str]) -> DataFrame:
    """The duration of the last finished turn by ord."""
    done = records.filter((F.col("type") == "system") & (F.col("subtype") == "turn_duration") & F.col("durationMs").isNotNull())
    return done.groupBy(*keys).agg(F.max_by("durationMs", "ord").alias("duration_ms"))


def history(records: DataFrame, now_ms: int, width_ms: int = 60_000, window_ms: int = 3_600_000) -> DataFrame:
    """(start_ms, family, the four counts) of the buckets of a rolling window.

    A request belongs to the bucket and family of its first record that has a time within the window; that record
    and later ones raise its output to the highest seen. Earlier records of it don't count. Records are parsed once: what
    a request needs of them is stored, for it is read twice."""
    from .series import clamp_bucket
    from .stored import stored

    width_ms, window_ms = clamp_bucket(width_ms, window_ms)
    cutoff = (now_ms - window_ms) // width_ms * width_ms + width_ms
    flat = stored(requests(records, []))
    dated = flat.filter(F.col("ms") >= cutoff)
    born = dated.groupBy("request_id", "message_id").agg(F.min("ord").alias("_born"))
    later = flat.join(born, ["request_id", "message_id"]).filter(F.col("ord") >= F.col("_born")).drop("_born")
    single = once(later, [])
    start = (F.col("ms") - F.pmod("ms", F.lit(width_ms))).alias("start_ms")
    return single.groupBy(start, "family").agg(*[F.sum(f).alias(f) for f in FIELDS])
