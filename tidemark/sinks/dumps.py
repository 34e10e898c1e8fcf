"""Text tables, and a sink that writes lines once, batch by batch, however often a batch is done.

Tasks write their lines into files of their own in a staging folder of the attempt; the commit puts those of the tasks that count
under the batch's name, in one rename. A batch that is there already stays as it is. The path is of a file system that the driver
and all executors see.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

from ..functions.widths import width

GAP = "  "


def _padded(text: Column, columns: Column, right: bool) -> Column:
    room = F.repeat(F.lit(" "), F.greatest(columns - width(text), F.lit(0)))
    return F.concat(room, text) if right else F.concat(text, room)


def table_lines(df: DataFrame, order: list[str | Column], columns: list[str] | None = None, missing: str = "-") -> DataFrame:
    """(place, value): the lines of a text table of df, heading first, rows in order. Numbers stand to the right; a null is
    `missing`; a line end in a text is a blank. Every column is as wide as its widest text or name. Rows are sorted by range,
    so lines lie in as many partitions as rows."""
    columns = columns or df.columns
    kinds = dict(df.dtypes)
    is_number = lambda c: kinds[c].split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    text = lambda c: F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"[\r\n]+", " "), F.lit(missing))
    rows = df.orderBy(*order).select(F.monotonically_increasing_id().alias("place"), *[text(c).alias(f"c{i}") for i, c in enumerate(columns)])
    widest = rows.agg(*[F.greatest(F.coalesce(F.max(width(F.col(f"c{i}"))), F.lit(0)), F.lit(len(c))).alias(f"w{i}") for i, c in enumerate(columns)]).first()  # of one row
    cells = [_padded(F.col(f"c{i}"), F.lit(widest[i]), is_number(c)) for i, c in enumerate(columns)]
    body = rows.select("place", F.rtrim(F.concat_ws(GAP, *cells)).alias("value"))
    names = [c.rjust(widest[i]) if is_number(c) else c.ljust(widest[i]) for i, c in enumerate(columns)]
    head = df.sparkSession.createDataFrame([(-2, GAP.join(names).rstrip()), (-1, GAP.join("-" * w for w in widest))], "place long, value string")
    return head.coalesce(1).unionByName(body)


@dataclass
class Written(WriterCommitMessage):
    part: int
    file: str
    lines: int


class _Writer:
    """What batch and stream writers share. A row's last column is its line."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"].removeprefix("file://")
        self.staged = f"{self.path}/_staged-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        os.makedirs(self.staged, exist_ok=True)
        file, n = f"{self.staged}/{uuid.uuid4().hex}", 0
        with open(file, "w", encoding="utf-8") as f:
            for row in iterator:
                f.write(f"{row[-1] if row[-1] is not None else ''}\n")
                n += 1
        return Written(part, file, n)

    def _publish(self, messages: list, name: str) -> None:
        """The files of the tasks that count, in order, as the folder `name`; nothing if it is there."""
        target = f"{self.path}/{name}"
        if not os.path.exists(target):
            ready = f"{self.staged}/ready"
            os.makedirs(ready, exist_ok=True)
            for m in sorted((m for m in messages if m is not None and m.lines), key=lambda m: m.part):
                os.replace(m.file, f"{ready}/part-{m.part:05d}.txt")
            try:
                os.rename(ready, target)
            except OSError:  # another attempt was faster
                if not os.path.exists(target):
                    raise
        self._discard(messages)

    def _discard(self, messages: list) -> None:
        """What tasks that were lost or done twice have left of this attempt. The writer that tasks had may be another copy."""
        for folder in {self.staged, *(os.path.dirname(m.file) for m in messages if m is not None)}:
            shutil.rmtree(folder, ignore_errors=True)


class DumpWriter(_Writer, DataSourceWriter):
    def commit(self, messages: list) -> None:
        self._publish(messages, f"dump-{uuid.uuid4().hex}")

    def abort(self, messages: list) -> None:
        self._discard(messages)


class DumpStreamWriter(_Writer, DataSourceStreamWriter):
    def commit(self, messages: list, batchId: int) -> None:
        self._publish(messages, f"batch-{batchId:08d}")

    def abort(self, messages: list, batchId: int) -> None:
        self._discard(messages)


class DumpSink(DataSource):
    """df.write or writeStream.format("dump"): the last column of each row as a line, in the folder dump-* of a write or batch-* of a
    batch."""

    @classmethod
    def name(cls) -> str:
        return "dump"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> DumpWriter:
        if overwrite:
            raise ValueError("a dump is only added to")
        return DumpWriter(self.options)

    def streamWriter(self, schema, overwrite: bool) -> DumpStreamWriter:
        return DumpStreamWriter(self.options)
