"""Which keywords a table has, and the columns they stand for."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F


class Kind(Enum):
    TEXT = "text"  # regex search; takes = and !=
    NUMBER = "number"
    SIZE = "size"  # a number that may be followed by a unit
    DURATION = "duration"  # milliseconds


@dataclass(frozen=True)
class Attribute:
    column: str
    kind: Kind
    #: What a null text is matched as.
    absent: str | None = None

    def text(self) -> Column:
        c = F.col(self.column).cast("string")
        return F.coalesce(c, F.lit(self.absent)) if self.absent is not None else c


@dataclass(frozen=True)
class Binding:
    """name: what words match. keywords: in lower case, to attributes."""

    name: Attribute
    keywords: dict[str, Attribute] = field(default_factory=dict)

    def find(self, word: str) -> Attribute | None:
        return self.keywords.get(word.lower())

    def named_by(self, column: str) -> Binding:
        return Binding(Attribute(column, Kind.TEXT), self.keywords)


# The relation of processes. Keywords and the columns they stand for.
PROCESS = Binding(
    Attribute("name", Kind.TEXT),
    {
        "cpu": Attribute("cpu_usage_percent", Kind.NUMBER),
        "cpu%": Attribute("cpu_usage_percent", Kind.NUMBER),
        "mem": Attribute("mem_usage_percent", Kind.NUMBER),
        "mem%": Attribute("mem_usage_percent", Kind.NUMBER),
        "memb": Attribute("mem_usage", Kind.SIZE),
        "read": Attribute("read_per_sec", Kind.SIZE),
        "r/s": Attribute("read_per_sec", Kind.SIZE),
        "rps": Attribute("read_per_sec", Kind.SIZE),
        "write": Attribute("write_per_sec", Kind.SIZE),
        "w/s": Attribute("write_per_sec", Kind.SIZE),
        "wps": Attribute("write_per_sec", Kind.SIZE),
        "tread": Attribute("total_read", Kind.SIZE),
        "t.read": Attribute("total_read", Kind.SIZE),
        "twrite": Attribute("total_write", Kind.SIZE),
        "t.write": Attribute("total_write", Kind.SIZE),
        "pid": Attribute("pid", Kind.TEXT),
        "state": Attribute("process_state", Kind.TEXT),
        "user": Attribute("user", Kind.TEXT, absent="N/A"),
        "time": Attribute("time_ms", Kind.DURATION),
        "nice": Attribute("nice", Kind.NUMBER),
        "priority": Attribute("priority", Kind.NUMBER),
        "gmem": Attribute("gpu_mem", Kind.SIZE),
        "gmem%": Attribute("gpu_mem_percent", Kind.NUMBER),
        "gpu%": Attribute("gpu_util", Kind.NUMBER),
    },
)
