"""Sources of host trees, and the sampler."""

import builtins
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from tidemark.functions import parsers
from tidemark.sources import host, sampler, trees
from tidemark.streaming import keyed


def stat_line(pid, comm="init", ppid=1, flags=0):
    return f"{pid} ({comm}) S {ppid} 1 1 0 -1 {flags} 0 0 0 0 11 7 0 0 20 0 1 0 100 4096 25 " + "0 " * 28


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    """1,000 processes, some half gone."""
    root = tmp_path_factory.mktemp("proc")
    for pid in range(1, 1001):
        d = root / str(pid)
        d.mkdir()
        if pid % 100 != 7:  # the folder is there, its files went
            (d / "stat").write_text(stat_line(pid, "a) b (c" if pid == 3 else "cmd", 0 if pid == 1 else 1, 0x200000 if pid == 5 else 0))
            (d / "cmdline").write_bytes(b"/bin/cmd\0-x\0")
            if pid % 2:
                (d / "io").write_text("rchar: 1\nread_bytes: 4096\nwrite_bytes: 10\n")
    task = root / "9" / "task"
    for tid in (9, 2001, 2002):
        (task / str(tid)).mkdir(parents=True)
        (task / str(tid) / "stat").write_text(stat_line(tid, "worker"))
    (root / "self").mkdir()
    (root / "12x").mkdir()
    (root / "meminfo").write_text("MemTotal: 1 kB\n")
    return root


def test_process_tree(spark, tree):
    rows = trees.processes(spark, str(tree), pidsATask="100")
    assert rows.rdd.getNumPartitions() == 10
    got = rows.withColumn("s", parsers.stat_fields(F.col("stat"))).collect()
    assert sorted(r.pid for r in got) == [p for p in range(1, 1001) if p % 100 != 7]
    by = {r.pid: r for r in got}
    assert by[3].s.comm == "a) b (c" and by[5].s.is_kernel and by[4].io is None and "read_bytes" in by[3].io
    assert by[3].host == "localhost" and by[3].thread_of is None and by[3].uid == os.getuid()
    view = host.processes(rows.select(F.lit(0).alias("ts"), "stat", "cmdline", "uid"))
    assert view.count() == 990 and view.filter("process_type = 'Kernel'").count() == 1
    threads = trees.processes(spark, str(tree), threads="true")
    assert [(r.pid, r.thread_of) for r in threads.filter("thread_of is not null").orderBy("pid").collect()] == [(2001, 9), (2002, 9)]


def opened(monkeypatch, run):
    """Files that run() opens."""
    seen, real = [], builtins.open
    monkeypatch.setattr(builtins, "open", lambda path, *a, **k: seen.append(str(path)) or real(path, *a, **k))
    out = run()
    monkeypatch.undo()
    return out, seen


def rows_of(reader):
    return [r for p in reader.partitions() for r in reader.read(p)]


def test_files_of_columns_and_pids_that_are_asked_for(spark, tree, monkeypatch):
    options = {"path": str(tree), "pids": "4, 9999"}
    rows, seen = opened(monkeypatch, lambda: rows_of(trees.ProcessReader(options, ["pid", "cmdline"])))
    assert rows == [(4, "/bin/cmd\0-x\0")] and seen == [f"{tree}/4/cmdline"]
    few = trees.processes(spark, str(tree), ["pid", "cmdline"], pids="4,7,8")
    assert sorted(r.pid for r in few.collect()) == [4, 7, 8]  # without stat nothing tells that 7 went
    with pytest.raises(Exception, match="no \\['colour'\\]"):
        spark.read.format("processes").schema("colour string").load(str(tree)).collect()


@pytest.fixture(scope="module")
def fleet(tmp_path_factory):
    root = tmp_path_factory.mktemp("fleet")
    for name in ("h1", "h2"):
        for path, text in {
            "proc/stat": "cpu 1 2 3 4 5 6 7 8\n", "proc/loadavg": "0.1 0.2 0.3 1/2 3\n", "proc/meminfo": "MemTotal: 100 kB\n",
            "proc/mounts": "/dev/sda1 / ext4 rw 0 0\n", "proc/net/dev": f"{name}\n", "sys/class/power_supply/BAT0/uevent": "POWER_SUPPLY_CAPACITY=50\n",
            "etc/passwd": "root:x:0:0::/:\n", "sys/class/hwmon/hwmon0/temp1_input": "42000\n",
        }.items():
            file = root / name / path
            file.parent.mkdir(parents=True, exist_ok=True)
            file.write_text(text)
    return root


def test_collector_reads_what_views_need(spark, fleet, monkeypatch):
    options = {"path": str(fleet), "fleet": "true"}
    rows, seen = opened(monkeypatch, lambda: rows_of(trees.CollectorReader(options | {"sources": "memory", "hosts": "h2"})))
    assert [r[:3] for r in rows] == [("h2", "memory", "proc/meminfo")] and len(seen) == 1
    counts = {}
    for view in trees.VIEWS:
        rows, seen = opened(monkeypatch, lambda v=view: rows_of(trees.CollectorReader(options | {"sources": ",".join(trees.needs([v]))})))
        counts[view] = len(seen)
        assert len(rows) == len(seen)
    assert counts == {"cpu": 4, "memory": 2, "disks": 2, "network": 2, "temperature": 2, "battery": 2, "processes": 6}
    table = trees.samples(spark, str(fleet), ["cpu", "battery"], fleet="true")
    assert table.rdd.getNumPartitions() == 6
    # filters of one query don't show in others on the same table
    assert [table.filter("source = 'cpu'").count(), table.count(), table.filter("host = 'h1'").count()] == [2, 6, 3]
    with pytest.raises(ValueError, match="no source is named"):
        trees.CollectorReader(options | {"sources": "colour"}).partitions()


def test_slow_sources_of_the_stream(fleet):
    reader = trees.CollectorStream({"path": str(fleet), "fleet": "true", "sources": "cpu,battery"})
    named = lambda a, b: sorted({p.source for p in reader.partitions({"ms": a}, {"ms": b})})
    assert named(0, 1_000_000) == ["battery", "cpu"]
    assert named(1_000_000, 1_001_000) == ["cpu"]
    assert named(1_019_000, 1_020_000) == ["battery", "cpu"]
    rows = [r for p in reader.partitions({"ms": 0}, {"ms": 90_000}) for r in reader.read(p)]
    assert len(rows) == 4 and {r[3] for r in rows} == {90_000}


def test_collector_stream(spark, fleet, tmp_path):
    out = []
    stream = trees.samples(spark, str(fleet), ["cpu", "battery"], stream=True, fleet="true")
    query = keyed.start(stream, str(tmp_path / "ck"), lambda df, batch: out.append(sorted((r.host, r.source) for r in df.collect())), 300)
    try:
        until = time.time() + 60
        while len(out) < 3 and time.time() < until:
            time.sleep(0.2)
    finally:
        query.stop()
    every = [("h1", "cpu"), ("h1", "load"), ("h2", "cpu"), ("h2", "load")]
    assert out[0] == sorted([*every, ("h1", "battery"), ("h2", "battery")])
    assert all(set(every) <= set(o) for o in out[:3]) and len(out) >= 3


def test_sampler_never_queues(spark, tmp_path):
    path = tmp_path / "samples"
    path.write_text("")
    reader = sampler.SamplerReader({"path": str(path), "mostBytes": "64"})
    rows, at = reader.read(reader.initialOffset())
    assert list(rows) == [] and at["at"] == 0
    path.write_text("".join(f"s{k}\n" for k in range(1000)) + "s1")
    rows, end = reader.read(at)
    assert [r[1] for r in rows] == ["s999"]
    assert [r[1] for r in reader.readBetweenOffsets(at, end)] == ["s999"]
    assert list(reader.read(end)[0]) == []  # an unfinished line
    with open(path, "a") as f:
        f.write("000\n")
    assert [r[1] for r in reader.read(end)[0]] == ["s1000"]
    with open(path, "a") as f:
        f.write("x" * 200 + "\n")
    rows, far = reader.read(end)
    assert list(rows) == [] and far["at"] > end["at"]  # longer than the buffer
    path.write_text("anew\n")
    assert [r[1] for r in reader.read(far)[0]] == ["anew"]
    assert list(reader.readBetweenOffsets(end, far)) == []
    os.remove(path)
    assert list(reader.read(far)[0]) == []


def test_power_of_the_newest_sample(spark, tmp_path):
    spark.dataSource.register(sampler.SamplerSource)
    path = tmp_path / "power"
    line = lambda w: json.dumps({"cpu_power_w": w, "gpu_power_w": 0.5, "ane_power_w": 0})
    path.write_text("".join(line(w) + "\n" for w in range(50)))
    out = []
    stream = sampler.power_rows(spark.readStream.format("sampler").load(str(path)))
    query = keyed.start(stream, str(tmp_path / "ck"), lambda df, batch: out.append({r.channel: r.watts for r in df.collect()}), 300, idle_batches=False)
    try:
        query.processAllAvailable()
        with open(path, "a") as f:
            f.write(line(1) + "\n" + line(2) + "\n" + "{broken\n")
        query.processAllAvailable()
    finally:
        query.stop()
    assert out == [{"cpu": 49.0, "gpu": 0.5, "ane": 0.0, "system": None}, dict.fromkeys(["cpu", "gpu", "ane", "system"])]
