"""A sampler's output of which only the newest counts.

A program appends a line a sample to a file, faster or slower than anybody reads. A reader that comes late gets the newest
complete line, never the queue behind it, and looks at no more than the last `most_bytes` of the file.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

MOST_BYTES = 1 << 16


def newest_line(path: str, after: int, until: int | None, most_bytes: int) -> tuple[str | None, int]:
    """(the last complete line that begins at or behind `after`, where it ends); (None, after) if there is none. The file counts up
    to `until`; a line longer than most_bytes isn't there."""
    try:
        with open(path, "rb") as f:
            size = f.seek(0, os.SEEK_END)
            end = size if until is None else min(until, size)
            begin = max(after, end - most_bytes, 0)
            f.seek(begin)
            held = f.read(end - begin)
    except OSError:
        return None, after
    stop = held.rfind(b"\n")
    if stop < 0:
        return None, after
    start = held.rfind(b"\n", 0, stop) + 1
    if start == 0 and begin > after:  # its beginning lies before what was looked at
        return None, begin + stop + 1
    return held[start:stop].decode("utf-8", "replace"), begin + stop + 1


class SamplerReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"].removeprefix("file://")
        self.most = int(options.get("mostBytes", MOST_BYTES))

    def initialOffset(self) -> dict:
        return {"inode": 0, "at": 0}

    def _from(self, start: dict) -> tuple[int, int]:
        """(inode, where to go on); a file that was replaced or cut is read from its beginning."""
        try:
            now = os.stat(self.path)
        except OSError:
            return start["inode"], start["at"]
        same = now.st_ino == start["inode"] and now.st_size >= start["at"]
        return now.st_ino, start["at"] if same else 0

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        inode, after = self._from(start)
        line, at = newest_line(self.path, after, None, self.most)
        return iter([(at, line)] if line is not None else []), {"inode": inode, "at": at}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        if self._from(end) != (end["inode"], end["at"]):  # gone since
            return iter([])
        after = start["at"] if start["inode"] == end["inode"] and start["at"] <= end["at"] else 0
        line, at = newest_line(self.path, after, end["at"], self.most)
        return iter([(at, line)] if line is not None else [])


class SamplerSource(DataSource):
    """spark.readStream.format("sampler").load(file): (position, value), at most one row a batch. Option mostBytes."""

    @classmethod
    def name(cls) -> str:
        return "sampler"

    def schema(self) -> str:
        return "position long, value string"

    def simpleStreamReader(self, schema) -> SamplerReader:
        return SamplerReader(self.options)


#: The channels of a power sample, in order, and their fields.
POWER = {"cpu": "cpu_power_w", "gpu": "gpu_power_w", "ane": "ane_power_w", "system": "sys_power_w"}


def power_rows(samples: DataFrame) -> DataFrame:
    """(position, channel, watts) of sampler rows whose value is a JSON object; a channel that it lacks is a gap, a line that isn't JSON
    gives gaps only."""
    sample = F.try_parse_json("value")
    watts = [F.struct(F.lit(c).alias("channel"), F.try_variant_get(sample, f"$.{f}", "double").alias("watts")) for c, f in POWER.items()]
    return samples.select("position", F.inline(F.array(*watts)))
