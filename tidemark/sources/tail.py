"""A streaming source of lines appended to files in place: offsets are (inode, bytes) of each file.

Only complete lines are handed out; a file that was replaced or cut starts anew, and its rows then carry
restarted = true. ``spark.dataSource.register(TailSource)``, then ``readStream.format("tail").load(directory)``.
"""

from __future__ import annotations

import glob
import json
import os

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


class TailPartition(InputPartition):
    def __init__(self, path: str, start: int, stop: int, restarted: bool, inode: int) -> None:
        self.path, self.start, self.stop, self.restarted, self.inode = path, start, stop, restarted, inode


def complete_until(path: str, start: int, step: int = 1 << 16) -> int:
    """End of the last complete line of a file, start if there is none behind it."""
    with open(path, "rb") as f:
        end = f.seek(0, os.SEEK_END)
        while end > start:
            begin = max(start, end - step)
            f.seek(begin)
            cut = f.read(end - begin).rfind(b"\n")
            if cut >= 0:
                return begin + cut + 1
            end = begin
    return start


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.pattern = os.path.join(options["path"], options.get("glob", "*.jsonl"))
        self.last: dict = {}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        now = {}
        for path in sorted(glob.glob(self.pattern)):
            inode = os.stat(path).st_ino
            known, at = self.last.get(path, (inode, 0))
            same = known == inode and os.path.getsize(path) >= at
            now[path] = [inode, complete_until(path, at if same else 0)]
        self.last = now
        return {"files": json.dumps(now)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        out = []
        for path, (inode, stop) in after.items():
            known, at = before.get(path, (inode, 0))
            restarted = known != inode or stop < at
            begin = 0 if restarted else at
            if stop > begin:
                out.append(TailPartition(path, begin, stop, restarted, inode))
        return out or [TailPartition("", 0, 0, False, 0)]

    def read(self, partition: TailPartition):
        if partition.stop <= partition.start:
            return
        with open(partition.path, "rb") as f:
            if os.fstat(f.fileno()).st_ino != partition.inode:  # replaced since: the next offsets start it anew
                return
            f.seek(partition.start)
            at = partition.start
            while at < partition.stop:
                line = f.readline()
                if not line.endswith(b"\n"):  # cut since
                    return
                yield partition.path, at, partition.restarted, line.decode("utf-8", "replace").rstrip("\n")
                at += len(line)


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "path string, position long, restarted boolean, value string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)
