"""Sources as tables, the rolling history, the tail source, and scalar functions by fixed vectors."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tidemark.functions import durations, parsers, texts
from tidemark.operators import filters, joins, tokens, views
from tidemark.sources import host, tail
from tidemark.sources.logs import parse_records


def one(spark, column):
    return spark.range(1).select(column).first()[0]


# fixed values: (chip, label, fallback) to the name of a sensor
SENSORS = [
    ("hwmon", "sensor", "test", "hwmon: Sensor"), ("hwmon", None, "test", "hwmon"), (None, "sensor", "test", "test: Sensor"), ("hwmon", "sensor", "test", "hwmon: Sensor (1)"),
    (None, None, "test", "test"), (None, None, None, "Unknown"), (None, None, "test", "test (1)"), (None, None, None, "Unknown (1)"), ("", "", "test", "Unknown (2)"), ("", "a", "", "A"),
]


def test_sensor_names(spark):
    rows = spark.createDataFrame([(i, *s) for i, s in enumerate(SENSORS)], "i int, chip string, label string, fb string, want string")
    named = filters.numbered(rows.select("i", "want", texts.sensor_name(F.col("chip"), F.col("label"), F.col("fb")).alias("name")), "name", "i", "got")
    assert all(r.got == r.want for r in named.collect())


def test_texts_of_durations_and_names(spark):
    short = {1: "0m 1s", 10: "0m 10s", 60: "1m 0s", 61: "1m 1s", 3600: "1h 0m 0s", 3601: "1h 0m 1s", 3661: "1h 1m 1s"}
    long = {1: "0 minutes, 1 second", 60: "1 minute, 0 seconds", 3601: "1 hour, 0 minutes, 1 second", 7322: "2 hours, 2 minutes, 2 seconds"}
    assert all(one(spark, durations.battery_time(F.lit(k))) == v for k, v in short.items())
    assert all(one(spark, durations.battery_time_long(F.lit(k))) == v for k, v in long.items())
    assert one(spark, texts.binary_name(F.lit("/opt/a -b/firefox -x"))) == "firefox"
    assert one(spark, texts.disk_number(F.lit("/dev/disk12s3"))) == "disk12"
    assert not one(spark, texts.equal_ignoring_case(F.lit("É"), F.lit("é"))) and one(spark, texts.equal_ignoring_case(F.lit("aB"), F.lit("Ab")))
    assert one(spark, filters.keep(F.lit(None).cast("string"), ["x"])) and not one(spark, filters.keep(F.lit(None).cast("string"), ["x"], deny=False))


def test_zfs_counters_and_memory(spark):
    text = "13 1 0x01 7 1904 1 2\nname type data\ndataset_name 7 tank/a b\nwrites 4 1\nnwritten 4 22\nreads 4 3\nnread 4 11\n"
    sets = spark.createDataFrame([("tank", text), ("tank", "nothing")], "pool string, text string")
    disks = spark.createDataFrame([("sda", 1, 2)], "name string, read_bytes long, write_bytes long")
    assert sorted(map(tuple, host.device_counters(disks, sets).collect())) == [("sda", 1, 2), ("tank/a b", 11, 22)]
    assert one(spark, parsers.memory_fields(F.lit("MemTotal: 10 kB\nMemFree: 2 kB\nCached: 3 kB\n"))) [:2] == (10240, 5120)


def test_zones_only_without_hwmon(spark):
    kind = "dir string, ord long, chip string, label string, fallback string, celsius double"
    chips = spark.createDataFrame([("h0", 1, "cpu", "core", None, 40.0)], kind)
    zones = spark.createDataFrame([(1, "acpi", 30.0), (2, "acpi", 31.0)], "ord long, type string, celsius double")
    none = chips.limit(0)
    assert {tuple(r) for r in host.temperatures(chips, chips, zones).collect()} == {("cpu: Core", 40)}
    assert {tuple(r) for r in host.temperatures(none, none, zones).collect()} == {("acpi", 30), ("acpi (1)", 31)}
    assert {tuple(r) for r in host.temperatures(none, chips, zones).collect()} == {("cpu: Core", 40), ("acpi", 30), ("acpi (1)", 31)}


def test_cgroup_share(spark):
    rows = [("2024-01-01 00:00:00", "200000 100000", 0), ("2024-01-01 00:00:01", "200000 100000", 1_000_000), ("2024-01-01 00:00:02", "200000 100000", 9_000_000), ("2024-01-01 00:00:03", "max 100000", 9_500_000)]
    files = spark.createDataFrame(rows, "ts string, v2_max string, v2_usage_us long").withColumn("ts", F.col("ts").cast("timestamp"))
    files = files.withColumns({c: F.lit(None).cast("long") for c in ("v1_quota", "v1_period", "v1_usage_ns")})
    got = [r.percent for r in host.cgroup_cpu(files).orderBy("ts").collect()]
    assert got == [None, pytest.approx(50.0), 100.0, None]


def test_gpu_usage_and_shares(spark):
    rows = [(0, "d", 1, 0, 0), (1, "d", 1, 250_000_000, 1024), (1, "e", 1, 5, 0), (1, "d", 2, 0, 512), (2, "d", 2, 0, 512)]
    clients = spark.createDataFrame(rows, "s long, device string, pid long, busy_ns long, vram_bytes long").withColumn("ts", F.timestamp_seconds("s"))
    used = host.gpu_usage(clients)
    assert sorted((r.pid, r.gpu_percent, r.gpu_bytes) for r in used.collect()) == [(1, 25, 1024), (2, 0, 512)]
    made = host.with_gpus(spark.createDataFrame([(1,), (3,)], "pid long"), [used.filter("pid = 1"), used.filter("pid = 1")], F.lit(4096)).orderBy("pid").collect()
    assert [tuple(r) for r in made] == [(1, 50, 2048, 50.0), (3, 0, 0, 0.0)]


def test_processes_with_threads(spark):
    stat = lambda pid, flags=0: f"{pid} (kworker) S 1 0 0 0 0 {flags} 0 0 0 0 7 8 0 0 20 5 1 0 99 1000 3 " + "0 " * 20
    rows = spark.createDataFrame([(1, stat(9, 0x200000), "", 0), (1, stat(3), "/bin/x\0-y", 1), (1, "broken", None, 1)], "ts long, stat string, cmdline string, uid int")
    threads = spark.createDataFrame([(1, stat(5), None, 1)], "ts long, stat string, cmdline string, uid int")
    got = host.processes(rows, threads).collect()
    assert [(r.pid, r.process_type, r.command) for r in got] == [(3, "Regular", "/bin/x -y"), (5, "Thread", "kworker"), (9, "Kernel", "[kworker]")]


def test_missing_keys_and_repeated_ones(spark):
    facts = spark.createDataFrame([(1,), (2,)], "k long")
    parts = [spark.createDataFrame([(1, 5), (1, 6)], "k long, v long"), spark.createDataFrame([(3, 7)], "k long, v long")]
    assert sorted(map(tuple, joins.summed_dimension(facts, parts, "k", "v").collect())) == [(1, 11), (2, 0)]
    assert sorted(map(tuple, joins.first_of(facts, [(parts[0], "k")], "v", "got").collect())) == [(1, 5), (2, None)]


def test_ordinals_are_those_of_one_sort(spark):
    rows = spark.range(5000).withColumn("x", F.pmod(F.xxhash64("id"), F.lit(100)))
    got = [(r.position, r.id) for r in views.ordinals(rows, [F.col("x").desc(), F.col("id")]).collect()]
    want = [r.id for r in rows.orderBy(F.desc("x"), "id").collect()]
    assert sorted(got) == list(enumerate(want, 1))


def test_tail_ends_on_files_that_were_cut_or_replaced(tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text("one\ntwo\nthree\n")
    reader = tail.TailReader({"path": str(tmp_path)})
    start, end = reader.initialOffset(), reader.latestOffset()
    (part,) = reader.partitions(start, end)
    assert [r[3] for r in reader.read(part)] == ["one", "two", "three"]
    os.truncate(path, 5)
    assert [r[3] for r in reader.read(part)] == ["one"]
    new = tmp_path / "b.tmp"
    new.write_text("other\nlines\nhere\n")
    os.replace(new, path)
    assert list(reader.read(part)) == []
    (again,) = reader.partitions(end, reader.latestOffset())
    assert again.restarted and [r[3] for r in reader.read(again)] == ["other", "lines", "here"]
