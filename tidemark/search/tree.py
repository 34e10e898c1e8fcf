"""What a parsed query is, and a plain evaluation of it for one row (the compiled Column is checked against it)."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from .binding import Attribute

EPSILON = 2.220446049250313e-16


@dataclass(frozen=True)
class All:
    parts: tuple


@dataclass(frozen=True)
class Any_:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: object


@dataclass(frozen=True)
class Everything:
    pass


@dataclass(frozen=True)
class Match:
    attribute: Attribute
    pattern: str


@dataclass(frozen=True)
class Compare:
    attribute: Attribute
    op: str
    value: float


def compare(op: str, left: float, right: float) -> bool:
    """IEEE comparison, but numbers are equal if they differ by less than EPSILON."""
    if math.isnan(left) or math.isnan(right):
        return False
    gap = abs(left - right) if not (math.isinf(left) and left == right) else math.nan
    return {"=": gap < EPSILON, "!=": gap >= EPSILON, "<": left < right, ">": left > right, "<=": left <= right, ">=": left >= right}[op]


def evaluate(node, row: dict) -> bool:
    match node:
        case All(parts):
            return all(evaluate(p, row) for p in parts)
        case Any_(parts):
            return any(evaluate(p, row) for p in parts)
        case Not(part):
            return not evaluate(part, row)
        case Everything():
            return True
        case Match(attribute, pattern):
            value = row.get(attribute.column)
            value = attribute.absent if value is None else str(value)
            return value is not None and re.search(pattern, value) is not None
        case Compare(attribute, op, value):
            own = row.get(attribute.column)
            return own is not None and compare(op, float(own), value)
    raise TypeError(node)
