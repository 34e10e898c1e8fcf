"""Scaling and rendering of sizes, rates and counts; conversions of temperatures, memory and quotas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DECIMAL, BINARY = ("", "K", "M", "G", "T"), ("", "Ki", "Mi", "Gi", "Ti")


def scale(value: Column, binary: bool = False, unit: str = "B") -> Column:
    """struct(value, unit): the largest prefix up to T that value reaches."""
    base, names = (1024, BINARY) if binary else (1000, DECIMAL)
    out = F.struct(value.cast("double").alias("value"), F.lit(unit).alias("unit"))
    expr = None
    for k in range(len(names) - 1, 0, -1):
        step = F.struct((value / float(base**k)).alias("value"), F.lit(names[k] + unit).alias("unit"))
        expr = F.when(value >= base**k, step) if expr is None else expr.when(value >= base**k, step)
    return expr.otherwise(out)


def fixed(value: Column, digits: int) -> Column:
    """value rounded half to even with so many digits; whole numbers below 10**15."""
    n = F.bround(value, digits).cast(f"decimal(20,{digits})")
    return n.cast("string")


def format_bytes(value: Column, binary: bool = False, suffix: str = "") -> Column:
    """No digits below G, one from G on: '1023B', '1KiB', '2.5GiB'; suffix '/s' for rates."""
    base = 1024 if binary else 1000
    s = scale(value, binary)
    text = F.when(value >= base**3, fixed(s["value"], 1)).otherwise(fixed(s["value"], 0))
    return F.concat(text, s["unit"], F.lit(suffix))


def fixed_rate(value: Column) -> Column:
    """A binary rate with one digit, padded on the left to 11 characters: '  512.0B/s', '  1.5KiB/s'."""
    s = scale(value, binary=True)
    text = F.concat(fixed(s["value"], 1), s["unit"], F.lit("/s"))
    return F.when(F.length(text) < 11, F.lpad(text, 11, " ")).otherwise(text)


def abbreviate(count: Column, billions: bool = False) -> Column:
    """'999', '12.3k', '51.7M' and, if asked for, 'B'."""
    tenth = lambda d: fixed(count / float(d), 1)
    out = F.when(count >= 10**9, F.concat(tenth(10**9), F.lit("B"))).when(count >= 10**6, F.concat(tenth(10**6), F.lit("M"))) if billions else F.when(count >= 10**6, F.concat(tenth(10**6), F.lit("M")))
    return out.when(count >= 1000, F.concat(tenth(1000), F.lit("k"))).otherwise(count.cast("long").cast("string"))


def token_rate(rate: Column) -> Column:
    """Tokens a second, padded on the left to 9 characters."""
    text = F.when(rate >= 1e6, F.concat(fixed(rate / 1e6, 1), F.lit("M/s"))).when(rate >= 1e3, F.concat(fixed(rate / 1e3, 1), F.lit("k/s"))).otherwise(F.concat(fixed(rate, 0), F.lit("/s")))
    return F.lpad(text, 9, " ")


def bits_to_bytes(bits: Column) -> Column:
    return F.floor(bits / 8)


def temperature(celsius: Column, unit: str = "celsius") -> Column:
    c = celsius.cast("float")
    out = {"celsius": c, "kelvin": c + F.lit(273.15).cast("float"), "fahrenheit": c * F.lit(1.8).cast("float") + F.lit(32).cast("float")}[unit]
    return F.ceil(out).cast("int")


def saturating_log2(x: Column) -> Column:
    return F.when(x > 0, F.log2(x)).otherwise(F.lit(0.0))


def saturating_log10(x: Column) -> Column:
    return F.when(x > 0, F.log10(x)).otherwise(F.lit(0.0))


def saturating_sub(a: Column, b: Column) -> Column:
    return F.greatest(a - b, F.lit(0).cast("long"))


def percent(used: Column, total: Column) -> Column:
    """used / total * 100; null if total is 0."""
    return F.try_divide(used.cast("double"), total.cast("double")) * 100


def bar_count(pct: Column, slots: int) -> Column:
    return F.least(F.round(pct * slots / 100).cast("int"), F.lit(slots))


def average_packet(n_bytes: Column, packets: Column) -> Column:
    return F.coalesce(F.round(F.try_divide(n_bytes, packets)), F.lit(0)).cast("long")


def cpu_quota(text: Column) -> Column:
    """'quota period' to cores; null for 'max' or a zero."""
    q, p = (F.split(text, " ").getItem(i).try_cast("double") for i in (0, 1))
    return F.when((q > 0) & (p > 0), F.try_divide(q, p))


def memory_limit(limit: Column, physical: Column) -> Column:
    return F.least(limit, physical)


def arc_adjusted(used: Column, arc: Column, arc_min: Column) -> Column:
    """Used memory without what the cache would give back."""
    return F.greatest(used - F.greatest(arc - arc_min, F.lit(0)), F.lit(0))


def axis_ceiling(peak: Column, slack: float, floor: float = 0.0) -> Column:
    """Top of an axis: the visible peak with some slack, a floor at least."""
    return F.greatest(peak * slack, F.lit(floor))


def log_ceiling(peak: Column, base: int = 10) -> Column:
    """The next power of base at or above peak, for a logarithmic axis."""
    return F.when(peak > 1, F.pow(F.lit(float(base)), F.ceil(F.log(peak) / F.log(F.lit(float(base))) - 1e-12))).otherwise(F.lit(1.0))


def temperature_ceiling(peak: Column, base: float = 100.0, limit: float | None = None) -> Column:
    return F.lit(float(limit)) if limit is not None else F.greatest(peak, F.lit(base))
