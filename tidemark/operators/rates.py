"""Counters to rates, with a policy for the first sample of a key; one parameterised operator for every source."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class First(Enum):
    """What a key's first sample gives."""

    ZERO = "zero"  # a rate of 0
    NULL = "null"  # a gap
    OMIT = "omit"  # no row
    TOTAL = "total"  # the counter over the interval given


class Rounding(Enum):
    NONE = "none"
    TRUNCATE = "truncate"
    HALF_UP = "half_up"


def milliseconds(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def counter_to_rate(
    df: DataFrame,
    keys: list[str],
    ts: str,
    counter: str,
    first: First = First.NULL,
    rounding: Rounding = Rounding.NONE,
    whole_seconds: bool = False,
    first_seconds: float = 1.0,
    out: str = "rate",
) -> DataFrame:
    """Adds counter's rise a second since the key's previous sample. A counter that falls gives 0; an elapsed time of
    0 gives 0. whole_seconds: elapsed time is truncated to seconds first. A hot key is one window partition, which
    Spark sorts with spilling; nothing is gathered."""
    w = Window.partitionBy(*keys).orderBy(ts)
    before, seconds = F.lag(counter).over(w), (milliseconds(F.col(ts)) - milliseconds(F.lag(ts).over(w))) / 1000.0
    if whole_seconds:
        seconds = F.floor(seconds)
    is_first = F.row_number().over(w) == 1
    rise = F.greatest(F.col(counter) - before, F.lit(0))
    rate = F.coalesce(F.try_divide(rise.cast("double"), seconds.cast("double")), F.when(before.isNotNull(), F.lit(0.0)))
    start = {First.ZERO: F.lit(0.0), First.TOTAL: F.col(counter).cast("double") / first_seconds}.get(first, F.lit(None).cast("double"))
    value = F.when(is_first, start).otherwise(rate)
    if rounding is Rounding.TRUNCATE:
        value = F.floor(value)
    elif rounding is Rounding.HALF_UP:
        value = F.round(value)
    made = df.withColumn(out, value)
    if first is First.OMIT:
        made = made.withColumn("_first", is_first).filter(~F.col("_first")).drop("_first")
    return made


def since_start(df: DataFrame, keys: list[str], ts: str, counter: str, out: str = "total") -> DataFrame:
    """counter less its first value of the key, 0 at least: the first value is one row a key, joined back."""
    base = df.groupBy(*keys).agg(F.min_by(counter, ts).alias("_base"))
    return df.join(base, keys).withColumn(out, F.greatest(F.col(counter) - F.col("_base"), F.lit(0))).drop("_base")


def usage_percent(df: DataFrame, keys: list[str], ts: str, own: str, system: str, cores: int = 1, out: str = "usage") -> DataFrame:
    """Rise of a key's own time as a percentage of the system's; a system that stood still counts as 1."""
    w = Window.partitionBy(*keys).orderBy(ts)
    d_own = F.greatest(F.col(own) - F.lag(own).over(w), F.lit(0))
    d_sys = F.col(system) - F.lag(system).over(w)
    return df.withColumn(out, d_own / F.when(d_sys == 0, 1.0).otherwise(d_sys) * 100 / cores)


def high_water_delta(df: DataFrame, keys: list[str], order: str, value: str, out: str = "delta") -> DataFrame:
    """How far value rises above all earlier values of the key; the first counts whole."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.greatest(F.col(value) - F.coalesce(F.max(value).over(w), F.lit(0)), F.lit(0)))
