"""The combinations of two collections: left joins on small dimensions, fallbacks, live and orphan rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_dimension(facts: DataFrame, dim: DataFrame, on: list[str]) -> DataFrame:
    """facts with dim's columns, null where dim has no row. Spark broadcasts dim if it is small enough."""
    return facts.join(dim, on, "left")


def live(rows: DataFrame, alive: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(alive, on, "left_semi")


def orphans(rows: DataFrame, key: str, parent: str) -> DataFrame:
    """Rows whose parent is null or isn't among the keys."""
    keys = rows.select(F.col(key).alias("_p")).distinct()
    return rows.join(keys, F.col(parent) == F.col("_p"), "left_anti")


def children(rows: DataFrame, key: str, parent: str) -> DataFrame:
    """parent to the sorted array of its children."""
    return rows.filter(F.col(parent).isNotNull()).groupBy(parent).agg(F.sort_array(F.collect_list(key)).alias("children"))


def first_of(rows: DataFrame, others: list[tuple[DataFrame, str]], value: str, out: str) -> DataFrame:
    """The value of the first of others (each joined to its own column of rows) that has one; of a key that is repeated
    there, the least."""
    names = []
    for i, (other, on) in enumerate(others):
        right = other.groupBy(F.col(other.columns[0]).alias(f"_k{i}")).agg(F.min(value).alias(f"_v{i}"))
        rows = rows.join(right, F.col(on) == F.col(f"_k{i}"), "left").drop(f"_k{i}")
        names.append(f"_v{i}")
    return rows.withColumn(out, F.coalesce(*names)).drop(*names)


def without(rows: DataFrame, seen: DataFrame, on: list[str]) -> DataFrame:
    """Rows that `seen` lacks."""
    return rows.join(seen, on, "left_anti")


def distinct_union(parts: list[DataFrame]) -> DataFrame:
    """Each row of several collections once."""
    return reduce(DataFrame.union, parts).distinct()


def members_or_self(ids: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """(key, ids): the members of each row's group, itself alone where it has none. groups: (key, ids)."""
    met = ids.select(key).join(groups.select(key, "ids"), key, "left")
    return met.withColumn("ids", F.coalesce("ids", F.array(key)))


def patch_ignoring_case(rows: DataFrame, patches: DataFrame, on: str, value: str) -> DataFrame:
    """As patch, for keys that differ in case alone; of several patches for a key the least counts."""
    right = patches.groupBy(F.lower(on).alias("_low")).agg(F.min(value).alias("_patch"))
    met = rows.join(right, F.lower(on) == F.col("_low"), "left")
    return met.withColumn(value, F.coalesce("_patch", value)).drop("_patch", "_low")


def patch(rows: DataFrame, patches: DataFrame, on: str, value: str) -> DataFrame:
    """value from patches where they have a row, else the row's own."""
    right = patches.select(on, F.col(value).alias("_patch"))
    return rows.join(right, on, "left").withColumn(value, F.coalesce("_patch", value)).drop("_patch")


def summed_dimension(facts: DataFrame, dims: list[DataFrame], on: str, value: str) -> DataFrame:
    """facts with value summed over several collections, 0 where none has a row."""
    total = reduce(DataFrame.unionByName, [d.select(on, value) for d in dims]).groupBy(on).agg(F.sum(value).alias(value))
    return facts.join(total, on, "left").withColumn(value, F.coalesce(value, F.lit(0)))


def tagged_union(parts: dict[str, DataFrame], tag: str = "origin") -> DataFrame:
    return reduce(DataFrame.unionByName, [df.withColumn(tag, F.lit(name)) for name, df in parts.items()])
