"""Axes of graphs: from a visible peak to the top of the axis and the labels beside it, from the bottom up.

Each function gives struct(top, labels). On a logarithmic axis top is a logarithm, of the base that the axis has. Numbers in
labels are rounded half to even, of the number as it prints: 0.35 is a tie here, though its binary value lies below.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .units import BINARY, DECIMAL, fixed, saturating_log2, saturating_log10

# Headroom above a peak, least tops of logarithmic axes, widths of labels.
BYTES_SLACK, POWER_SLACK, RATE_SLACK, COUNT_SLACK, LOG_SLACK = 1.5, 1.25, 1.25, 1.1, 1.1
RATE_FLOOR, COUNT_FLOOR = 4.0, 10.0
NETWORK_WIDTH, DISK_WIDTH, POWER_WIDTH, TOKEN_WIDTH = 5, 8, 7, 9
DEGREES = {"celsius": "°C", "kelvin": "K", "fahrenheit": "°F"}


def right(text: Column, width: int) -> Column:
    """Padded on the left; longer texts stay whole."""
    return F.when(F.length(text) < width, F.lpad(text, width, " ")).otherwise(text)


def _axis(top: Column, labels: Column) -> Column:
    return F.struct(top.cast("double").alias("top"), labels.alias("labels"))


def _above(peak: Column, slack: float) -> Column:
    """A flat window still has an axis."""
    return F.when(peak <= 0, F.lit(1.0)).otherwise(peak * slack)


def bytes_linear(peak: Column, unit: str = "B", binary: bool = True, width: int = DISK_WIDTH) -> Column:
    """Half as much again as the peak, in the largest prefix up to T that this reaches; labels at 0, half, once and one and a
    half times the peak, of which the lowest names the unit."""
    base, names = (1024.0, BINARY) if binary else (1000.0, DECIMAL)
    peak = peak.cast("double")
    top = F.when(peak == 0, F.lit(1.0)).otherwise(peak * BYTES_SLACK)
    step = sum(((top >= base**k).cast("int") for k in range(2, len(names))), (top >= base).cast("int"))
    scaled = peak / F.pow(F.lit(base), step)
    zero = F.concat(F.lit("0"), F.element_at(F.array(*map(F.lit, names)), step + 1), F.lit(unit))
    return _axis(top, F.array(right(zero, width), *[right(fixed(scaled * part, 1), width) for part in (0.5, 1.0, 1.5)]))


def bytes_log(peak: Column, unit: str = "B", binary: bool = True, zero_width: int = 1) -> Column:
    """The first of mega, giga, tera that the peak lies below, else peta, with a label for each power of a thousand."""
    per, names = (10.0, BINARY) if binary else (3.0, DECIMAL)
    names = (*names, "Pi" if binary else "P")
    log = (saturating_log2 if binary else saturating_log10)(peak.cast("double"))
    rung = F.when(log < 2 * per, 2).when(log < 3 * per, 3).when(log < 4 * per, 4).otherwise(5)
    every = F.array(F.lit("0".rjust(zero_width) + unit), *[F.lit(f"1{n}{unit}") for n in names[1:]])
    return _axis(rung * per, F.slice(every, F.lit(1), rung + 1))


def network(peak: Column, log: bool = False, binary: bool = False, use_bytes: bool = False) -> Column:
    """Of rates in bits, or bytes where the series are."""
    unit = "B" if use_bytes else "b"
    return bytes_log(peak, unit, binary, 3 if binary else 2) if log else bytes_linear(peak, unit, binary, NETWORK_WIDTH)


def disk(peak: Column, log: bool = False) -> Column:
    return bytes_log(peak, "B/s", True, 3) if log else bytes_linear(peak, "B/s", True, DISK_WIDTH)


def temperature(peak: Column, unit: str = "celsius", limit: float | None = None) -> Column:
    """100 °C at least, in the unit of the peak; a limit goes before both."""
    least = {"celsius": F.lit(100.0), "kelvin": F.lit(100.0).cast("float") + F.lit(273.15).cast("float"), "fahrenheit": F.lit(212.0)}[unit].cast("double")
    top = F.lit(float(limit)) if limit is not None else F.greatest(peak.cast("double"), least)
    whole = lambda x: F.concat(F.ceil(x).cast("string"), F.lit(DEGREES[unit]))
    return _axis(top, F.array(F.lit("0" + DEGREES[unit]), whole(top / 2), whole(top)))


def power(peak: Column) -> Column:
    top = _above(peak.cast("double"), POWER_SLACK)
    return _axis(top, F.array(*[right(F.concat(fixed(top * part, 1), F.lit("W")), POWER_WIDTH) for part in (0.0, 0.5, 1.0)]))


def abbreviated(value: Column, suffix: str = "", billions: bool = True) -> Column:
    """'999', '12.3k', '51.7M' and, if asked for, 'B', with a suffix."""
    steps = [(1e9, "B")] * billions + [(1e6, "M"), (1e3, "k")]
    out = F
    for size, letter in steps:
        out = out.when(value >= size, F.concat(fixed(value / size, 1), F.lit(letter + suffix)))
    return out.otherwise(F.concat(fixed(value, 0), F.lit(suffix)))


def _tokens(peak: Column, log: bool, slack: float, floor: float, text) -> Column:
    peak = peak.cast("double")
    top = F.greatest(saturating_log2(peak) * LOG_SLACK, F.lit(floor)) if log else _above(peak, slack)
    at = (lambda part: F.pow(F.lit(2.0), top * part)) if log else (lambda part: top * part)
    labels = [text(F.lit(0.0)), text(at(0.5)), text(at(1.0))]  # nothing lies at the bottom of a logarithmic axis, too
    return _axis(top, F.array(*[right(x, TOKEN_WIDTH) for x in labels]))


def token_rate(peak: Column, log: bool = True) -> Column:
    """Tokens a second."""
    return _tokens(peak, log, RATE_SLACK, RATE_FLOOR, lambda x: abbreviated(x, "/s", billions=False))


def token_count(peak: Column, log: bool = False) -> Column:
    """Tokens of a bucket, stacked."""
    return _tokens(peak, log, COUNT_SLACK, COUNT_FLOOR, abbreviated)

