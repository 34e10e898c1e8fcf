"""Host trees as tables: small files of /proc and /sys, of one host or of a fleet, read by tasks.

Two data sources. `processes` reads a directory tree with a folder for each process and makes a row of each, from several
small files; `collector` reads the files of sources (memory, mounts ...) that are asked for, as a table or as a stream of
samples. Neither opens a file that nobody needs: a file of a process is read if its column is in the schema, and of hosts,
pids and the collector's sources those that options name. What vanishes while it is read is left out, and nothing else is.

These are options, not filters that Spark pushes into the source: Spark 4.1.2 keeps the filters of one query for all later
ones on the same loaded table, whose rows would then be missing there.

A root holds one host's tree, or with the option fleet a folder for each host. On a cluster it lies in a file system that
executors see.
"""

from __future__ import annotations

import glob
import os
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Folders of processes that one task reads.
PIDS_A_TASK = 512


def read_text(path: str) -> str | None:
    """A whole file; None if it went, or may not be read."""
    try:
        with open(path, "rb") as f:
            return f.read().decode("utf-8", "replace")
    except OSError:
        return None


def hosts_of(options: dict) -> list[tuple[str, str]]:
    """(host, its tree) of the root, of a fleet those that the option hosts names."""
    root, wanted = options["path"].removeprefix("file://"), named(options, "hosts")
    if options.get("fleet", "false").lower() != "true":
        return [(options.get("host", "localhost"), root)]
    found = sorted(os.scandir(root), key=lambda d: d.name)
    return [(d.name, d.path) for d in found if d.is_dir() and (wanted is None or d.name in wanted)]


def named(options: dict, option: str) -> set[str] | None:
    """The names of an option, with commas between them; None if it isn't there."""
    given = options.get(option)
    return {x.strip() for x in given.split(",") if x.strip()} if given is not None else None


class PidsPartition(InputPartition):
    def __init__(self, host: str, tree: str, pids: list[int]) -> None:
        self.host, self.tree, self.pids = host, tree, pids


class ProcessReader(DataSourceReader):
    FILES = ("stat", "io", "cmdline", "status")

    def __init__(self, options: dict, columns: list[str]) -> None:
        self.options, self.columns = options, columns
        self.files = [c for c in columns if c in self.FILES]
        self.threads = options.get("threads", "false").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        out, wanted = [], named(self.options, "pids")
        for host, tree in hosts_of(self.options):
            pids = sorted(int(d.name) for d in os.scandir(tree) if d.name.isascii() and d.name.isdigit() and (wanted is None or d.name in wanted))
            size = int(self.options.get("pidsATask", PIDS_A_TASK))
            out += [PidsPartition(host, tree, pids[i : i + size]) for i in range(0, len(pids), size)]
        return out or [PidsPartition("", "", [])]

    def _row(self, host: str, folder: str, pid: int, owner: int | None) -> tuple | None:
        """None if the process went meanwhile; a single file that can't be read is null."""
        try:
            uid = os.stat(folder).st_uid
        except OSError:
            return None
        known = {f: read_text(f"{folder}/{f}") for f in self.files}
        if "stat" in known and not known["stat"]:
            return None
        known |= {"host": host, "pid": pid, "thread_of": owner, "uid": uid}
        return tuple(known[c] for c in self.columns)

    def read(self, partition: PidsPartition) -> Iterator[tuple]:
        for pid in partition.pids:
            folder = f"{partition.tree}/{pid}"
            row = self._row(partition.host, folder, pid, None)
            if row is None:
                continue
            yield row
            if self.threads:
                try:
                    tids = sorted(int(t) for t in os.listdir(f"{folder}/task") if t.isascii() and t.isdigit())
                except OSError:
                    continue
                for tid in tids:
                    row = self._row(partition.host, f"{folder}/task/{tid}", tid, pid) if tid != pid else None
                    if row is not None:
                        yield row


class ProcessSource(DataSource):
    """spark.read.format("processes").load(root): (host, pid, thread_of, uid, stat, io, cmdline, status), a row for each numeric folder.
    A schema of fewer columns reads fewer files. Options: fleet, hosts, pids, host (its name), threads (rows of <pid>/task/<tid>, too), pidsATask."""

    @classmethod
    def name(cls) -> str:
        return "processes"

    def schema(self) -> str:
        return "host string, pid int, thread_of int, uid long, stat string, io string, cmdline string, status string"

    def reader(self, schema) -> ProcessReader:
        known = {"host", "pid", "thread_of", "uid", *ProcessReader.FILES}
        if unknown := set(schema.names) - known:
            raise ValueError(f"a process has no {sorted(unknown)}")
        return ProcessReader(self.options, schema.names)


@dataclass(frozen=True)
class HostSource:
    """Files of a source, as patterns below a host's tree. A slow one is read by a stream once in SLOW_MS."""

    files: tuple[str, ...]
    slow: bool = False


SLOW_MS = 60_000
# Where the kernel has what.
SOURCES = {
    "cpu": HostSource(("proc/stat",)),
    "load": HostSource(("proc/loadavg",)),
    "memory": HostSource(("proc/meminfo",)),
    "arc": HostSource(("proc/spl/kstat/zfs/arcstats",)),
    "cgroup": HostSource(("sys/fs/cgroup/memory.*", "sys/fs/cgroup/cpu.*", "sys/fs/cgroup/memory/memory.*", "sys/fs/cgroup/cpu/cpu.*")),
    "disk_io": HostSource(("proc/diskstats", "proc/spl/kstat/zfs/*/objset-*")),
    "mounts": HostSource(("proc/mounts",)),
    "partitions": HostSource(("proc/partitions",)),
    "network": HostSource(("proc/net/dev",)),
    "temperature": HostSource(("sys/class/hwmon/hwmon*/*", "sys/class/thermal/thermal_zone*/*")),
    "battery": HostSource(("sys/class/power_supply/*/uevent",), slow=True),
    "users": HostSource(("etc/passwd",), slow=True),
}
# What each view is made of.
VIEWS = {
    "cpu": ("cpu", "load"), "memory": ("memory", "arc", "cgroup"), "disks": ("disk_io", "mounts", "partitions"), "network": ("network",),
    "temperature": ("temperature",), "battery": ("battery",), "processes": ("cpu", "memory", "cgroup", "users"),
}


def needs(views: Sequence[str]) -> list[str]:
    """The sources that some views need, each once."""
    return sorted({s for v in views for s in VIEWS[v]})


class FilesPartition(InputPartition):
    def __init__(self, host: str, tree: str, source: str, ms: int) -> None:
        self.host, self.tree, self.source, self.ms = host, tree, source, ms


def _wanted(options: dict) -> list[str]:
    names = named(options, "sources")
    if unknown := (names or set()) - set(SOURCES):
        raise ValueError(f"no source is named {sorted(unknown)}")
    return [s for s in SOURCES if names is None or s in names]


def _files(partition: FilesPartition) -> Iterator[tuple]:
    for pattern in SOURCES[partition.source].files if partition.source else ():
        for path in sorted(glob.glob(f"{glob.escape(partition.tree)}/{pattern}")):
            text = read_text(path) if os.path.isfile(path) else None
            if text is not None:
                yield partition.host, partition.source, os.path.relpath(path, partition.tree), partition.ms, text


class CollectorReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        ms = int(time.time() * 1000)
        return [FilesPartition(h, tree, s, ms) for h, tree in hosts_of(self.options) for s in _wanted(self.options)] or [FilesPartition("", "", "", ms)]

    def read(self, partition: FilesPartition) -> Iterator[tuple]:
        return _files(partition)


class CollectorStream(DataSourceStreamReader):
    """A sample for each batch: its time is the offset. Slow sources are read when a new turn of SLOW_MS begins, and at first."""

    def __init__(self, options: dict) -> None:
        self.options = options

    def initialOffset(self) -> dict:
        return {"ms": 0}

    def latestOffset(self) -> dict:
        return {"ms": int(time.time() * 1000)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        turn = end["ms"] // SLOW_MS != start["ms"] // SLOW_MS
        names = [s for s in _wanted(self.options) if turn or not SOURCES[s].slow]
        return [FilesPartition(h, tree, s, end["ms"]) for h, tree in hosts_of(self.options) for s in names] or [FilesPartition("", "", "", end["ms"])]

    def read(self, partition: FilesPartition) -> Iterator[tuple]:
        return _files(partition)


class CollectorSource(DataSource):
    """spark.read or readStream.format("collector").load(root): (host, source, file, ms, text). Options: fleet, hosts, host (its name),
    sources (of SOURCES; all if it isn't there)."""

    @classmethod
    def name(cls) -> str:
        return "collector"

    def schema(self) -> str:
        return "host string, source string, file string, ms long, text string"

    def reader(self, schema) -> CollectorReader:
        return CollectorReader(self.options)

    def streamReader(self, schema) -> CollectorStream:
        return CollectorStream(self.options)


def register(spark: SparkSession) -> None:
    for source in (ProcessSource, CollectorSource):
        spark.dataSource.register(source)


def samples(spark: SparkSession, root: str, views: Sequence[str], stream: bool = False, **options: str) -> DataFrame:
    """What the collector has of the sources that these views need, as a table, or as a stream that streaming.keyed.start gives its
    trigger."""
    register(spark)
    reader = (spark.readStream if stream else spark.read).format("collector").options(**options)
    return reader.option("sources", ",".join(needs(views))).load(root)


def processes(spark: SparkSession, root: str, columns: Sequence[str] | None = None, **options: str) -> DataFrame:
    """Processes of a tree, those columns of ProcessSource.schema that are asked for."""
    register(spark)
    reader = spark.read.format("processes").options(**options)
    if columns is not None:
        kinds = dict(c.split() for c in ProcessSource({}).schema().split(", "))
        reader = reader.schema(", ".join(f"{c} {kinds[c]}" for c in columns))
    return reader.load(root)
