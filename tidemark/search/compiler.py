"""A search's tree to one Spark predicate: constants are folded while parsing, the rest is Catalyst's."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .binding import Binding
from .parser import SearchOptions, parse
from .tree import EPSILON, All, Any_, Compare, Everything, Match, Not


def _leaf(node: Compare) -> Column:
    left, right = F.col(node.attribute.column).cast("double"), F.lit(node.value)
    gap = F.abs(left - right)
    tests = {
        "=": gap < EPSILON,
        "!=": gap >= EPSILON,
        "<": left < right,
        ">": left > right,
        "<=": left <= right,
        ">=": left >= right,
    }
    if node.value != node.value:
        return F.lit(False)
    # NaN compares false to everything, while Spark holds it the largest number
    return ~F.isnan(left) & ~F.isnan(gap if node.op in ("=", "!=") else left) & tests[node.op]


def to_column(node) -> Column:
    match node:
        case All(parts):
            return functools.reduce(operator.and_, map(to_column, parts))
        case Any_(parts):
            return functools.reduce(operator.or_, map(to_column, parts))
        case Not(part):
            return ~to_column(part)
        case Everything():
            return F.lit(True)
        case Match(attribute, pattern):
            return F.coalesce(attribute.text().rlike(pattern), F.lit(False))
        case Compare():
            return F.coalesce(_leaf(node), F.lit(False))
    raise TypeError(node)


def compile_query(text: str, binding: Binding, options: SearchOptions = SearchOptions()) -> Column:
    return to_column(parse(text, binding, options))


def filter_rows(df: DataFrame, text: str, binding: Binding, options: SearchOptions = SearchOptions()) -> DataFrame:
    """df.filter with a search; an empty text is no filter."""
    return df.filter(compile_query(text, binding, options)) if text.strip() else df
