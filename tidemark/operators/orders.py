"""Sort rules of tables, column by column: the key, and the direction that a column is first sorted in.

Nulls are smallest. Rows that are equal by a column follow the table's own order, ascending in either direction.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.texts import ordinal
from .views import ordinals


@dataclass(frozen=True)
class Rule:
    """descends: at first. key: 'value' is the column itself, 'caseless' its lower case, 'family' its place among the families. by: another
    column that tells the order."""

    descends: bool = False
    key: str = "value"
    by: str | None = None

    def column(self, name: str) -> Column:
        c = F.col(self.by or name)
        return {"value": c, "caseless": F.lower(c), "family": F.when(c.isNotNull(), ordinal(c))}[self.key]


@dataclass(frozen=True)
class Order:
    """Rules of a table's columns, and the columns that tell equal rows apart."""

    rules: dict[str, Rule] = field(default_factory=dict)
    ties: tuple[str, ...] = ()

    def defaults(self) -> dict[str, bool]:
        """For views.Sorting: whether a column descends at first."""
        return {c: r.descends for c, r in self.rules.items()}

    def keys(self, column: str, descending: bool | None = None) -> list[Column]:
        if column not in self.rules:
            raise ValueError(f"the table isn't sorted by {column!r}")
        rule = self.rules[column]
        key = rule.column(column)
        first = key.desc_nulls_last() if (rule.descends if descending is None else descending) else key.asc_nulls_first()
        return [first, *[F.col(c).asc_nulls_first() for c in self.ties if rule.key != "value" or c != (rule.by or column)]]

    def sorted(self, df: DataFrame, column: str, descending: bool | None = None) -> DataFrame:
        return df.orderBy(*self.keys(column, descending))

    def numbered(self, df: DataFrame, column: str, descending: bool | None = None) -> DataFrame:
        """df with the place of each row, `position` from 1, without one task that sees all rows."""
        return ordinals(df, self.keys(column, descending))


_DOWN = Rule(descends=True)
# The columns of each table and how they are sorted.
PROCESSES = Order(
    {
        "cpu_percent": _DOWN, "mem_bytes": _DOWN, "mem_percent": Rule(True, by="mem_bytes"), "virtual_mem": _DOWN, "pid": Rule(), "num_similar": Rule(),
        "name": Rule(key="caseless"), "command": Rule(key="caseless"), "read_per_sec": _DOWN, "write_per_sec": _DOWN, "total_read": _DOWN, "total_write": _DOWN,
        "user": Rule(), "state": Rule(), "time": Rule(), "priority": _DOWN, "nice": Rule(), "gpu_bytes": _DOWN, "gpu_mem_percent": Rule(True, by="gpu_bytes"), "gpu_percent": _DOWN,
    },
    ("pid",),
)
DISKS = Order(
    {"name": Rule(), "mount_point": Rule(), "used": _DOWN, "used_percent": _DOWN, "free": _DOWN, "free_percent": _DOWN, "total": _DOWN, "read_rate": _DOWN, "write_rate": _DOWN},
    ("name", "mount_point"),
)
TEMPERATURES = Order({"name": Rule(), "value": _DOWN}, ("name",))
SESSIONS = Order(
    {"name": Rule(), "cwd": Rule(), "model": Rule(key="family"), "status": Rule(), "tokens": _DOWN, "cost_usd": _DOWN, "context_percent": _DOWN, "agents": _DOWN},
    ("name", "session"),
)
