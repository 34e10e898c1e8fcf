"""Allow and deny lists, windows and visibility."""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def patterns(items: list[str], regex: bool = False, case_sensitive: bool = False, whole_word: bool = False) -> list[str]:
    made = [i if regex else re.sub(r"([\\.+*?()|\[\]{}^$])", r"\\\1", i) for i in items]
    made = [f"^{m}$" if whole_word else m for m in made]
    return [m if case_sensitive else f"(?i){m}" for m in made]


def matches_any(text: Column, items: list[str], **how) -> Column:
    return functools.reduce(operator.or_, [text.rlike(p) for p in patterns(items, **how)], F.lit(False))


def keep(text: Column, items: list[str] | None, deny: bool = True, **how) -> Column:
    """Whether a list keeps text: a deny list keeps what doesn't match, an allow list what does; no list keeps all.
    Nothing matches a null text."""
    return F.lit(True) if items is None else F.coalesce(matches_any(text, items, **how), F.lit(False)) != F.lit(deny)


def keep_either(text: Column, first: dict | None, second: dict | None) -> Column:
    """Whether one of two lists (arguments of keep) keeps text: each view narrows it down later."""
    one = lambda how: F.lit(True) if how is None else keep(text, **how)
    return one(first) | one(second)


def keep_entry(name: Column, mount: Column, names: tuple[list[str], bool] | None, mounts: tuple[list[str], bool] | None) -> Column:
    """Two lists of (items, deny) on one entry: a match of an allow list keeps it, whatever a deny list says; else a
    match of a deny list drops it; else it stays if no list is an allow list."""
    lists = [(matches_any(c, x[0]), x[1]) for c, x in ((name, names), (mount, mounts)) if x is not None]
    if not lists:
        return F.lit(True)
    allowed = functools.reduce(operator.or_, [m for m, deny in lists if not deny], F.lit(False))
    denied = functools.reduce(operator.or_, [m for m, deny in lists if deny], F.lit(False))
    undecided = F.lit(any(deny for _, deny in lists))
    return F.when(allowed, True).when(denied, False).otherwise(undecided)


def recent(df: DataFrame, ts: str, milliseconds: int, keys: list[str] = ()) -> DataFrame:
    """Rows no older than so many milliseconds before the newest, of all rows or of each key's. One small row of
    newest times meets the rows; no window gathers them."""
    newest = df.groupBy(*keys).agg(F.max(ts).alias("_newest"))
    met = df.join(newest, list(keys)) if keys else df.crossJoin(F.broadcast(newest))  # of one row
    return met.filter(F.col(ts) >= F.col("_newest") - F.expr(f"INTERVAL {milliseconds / 1000} SECONDS")).drop("_newest")


def retained(df: DataFrame, ts: str, now: Column, seconds: int = 600) -> DataFrame:
    """Rows whose age is at most `seconds`."""
    return df.filter(F.col(ts) >= now - F.expr(f"INTERVAL {seconds} SECONDS"))


def ever_reported(df: DataFrame, key: str, value: str) -> DataFrame:
    """Rows of keys that ever had a value above 0."""
    return df.join(df.groupBy(key).agg(F.max(value).alias("_max")).filter("_max > 0").select(key), key, "left_semi")


def ordinal_filter(df: DataFrame, key: str, total: str, order: list[str]) -> DataFrame:
    """Keys with a total above 0, in a fixed order; unknown keys last, by name."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col(key)), F.lit(0)), F.lit(len(order) + 1))
    return df.groupBy(key).agg(F.sum(total).alias(total)).filter(F.col(total) > 0).withColumn("ordinal", place.cast("int"))


def numbered(df: DataFrame, name: str, order: str, out: str = "label") -> DataFrame:
    """Repeated names get ' (1)', ' (2)' from their second row on."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1
    return df.withColumn(out, F.when(n == 0, F.col(name)).otherwise(F.concat(F.col(name), F.lit(" ("), n.cast("string"), F.lit(")"))))


def sections_with(lines: DataFrame, query: str, section: str = "section", line: str = "line", text: str = "text") -> DataFrame:
    """Lines of a help text (section, line from 0, the first its heading) that hold query, ignoring case, and the headings of
    their sections; `matches` tells them apart. Section 0, the contents, isn't searched; a blank query keeps all."""
    wanted = query.strip().lower()
    if not wanted:
        return lines.withColumn("matches", F.lit(False))
    found = lines.filter(F.col(section) > 0).withColumn("matches", F.lower(text).contains(wanted))
    some = found.groupBy(section).agg(F.max("matches").alias("_some")).filter("_some").select(section)
    return found.join(some, section, "left_semi").filter(F.col("matches") | (F.col(line) == 0))


def chosen_series(df: DataFrame, core: str, position: int, show_average: bool) -> DataFrame:
    """Rows of the series at a place of a legend: 0 is all, then the average (core -1) if shown, then the cores from 0."""
    if position == 0:
        return df if show_average else df.filter(F.col(core) >= 0)
    return df.filter(F.col(core) == position - 1 - show_average)


def legend_series(data: DataFrame, mounts: DataFrame, key: str, by_mount: bool) -> DataFrame:
    """Keys of a legend in their order, from data (key, has_data) and mounts (key, mount_point). By device: what is
    mounted, or has data in the window; by mount: what is mounted somewhere and has data."""
    m = mounts.select(key, "mount_point", F.lit(True).alias("_known"))
    met = data.join(m, key, "left")
    shown = (F.col("mount_point") != "") & F.col("has_data") if by_mount else F.col("_known").isNotNull() | F.col("has_data")
    return met.filter(shown).drop("_known").orderBy(key)
