"""Axes by golden rows, widths of texts, nested JSON, gaps without a nested loop, samples of several hosts."""

import json
import unicodedata

import pytest
from pyspark.sql import functions as F

from tidemark.functions import axes, texts, units, widths
from tidemark.operators import series, views
from tidemark.sources import host, nested


def shown(spark, axis, peaks):
    rows = spark.createDataFrame([(i, float(p)) for i, p in enumerate(peaks)], "i int, peak double").withColumn("a", axis(F.col("peak"))).orderBy("i").collect()
    return [(round(r.a.top, 6), [x.strip() for x in r.a.labels]) for r in rows], [{len(x) for x in r.a.labels} for r in rows]


# fixed values: (axis, peaks, tops and labels, widths of labels)
GOLDEN = [
    (axes.network, [0, 390e6, 800, 666, 5e12], [(1.0, ["0b", "0.0", "0.0", "0.0"]), (585e6, ["0Mb", "195.0", "390.0", "585.0"]), (1200.0, ["0Kb", "0.4", "0.8", "1.2"]), (999.0, ["0b", "333.0", "666.0", "999.0"]), (7.5e12, ["0Tb", "2.5", "5.0", "7.5"])], {5}),
    (lambda p: axes.network(p, binary=True, use_bytes=True), [1024, 2**30], [(1536.0, ["0KiB", "0.5", "1.0", "1.5"]), (1.5 * 2**30, ["0GiB", "0.5", "1.0", "1.5"])], {5}),
    (lambda p: axes.network(p, log=True), [0, 999_999, 1e6, 1e9, 1e12], [(6.0, ["0b", "1Kb", "1Mb"]), (6.0, ["0b", "1Kb", "1Mb"]), (9.0, ["0b", "1Kb", "1Mb", "1Gb"]), (12.0, ["0b", "1Kb", "1Mb", "1Gb", "1Tb"]), (15.0, ["0b", "1Kb", "1Mb", "1Gb", "1Tb", "1Pb"])], {3}),
    (lambda p: axes.network(p, log=True, binary=True, use_bytes=True), [2**30], [(40.0, ["0B", "1KiB", "1MiB", "1GiB", "1TiB"])], {4}),
    (axes.disk, [0, 3 * 2**20], [(1.0, ["0B/s", "0.0", "0.0", "0.0"]), (4.5 * 2**20, ["0MiB/s", "1.5", "3.0", "4.5"])], {8}),
    (lambda p: axes.disk(p, log=True), [5, 2**20, 2**50], [(20.0, ["0B/s", "1KiB/s", "1MiB/s"]), (30.0, ["0B/s", "1KiB/s", "1MiB/s", "1GiB/s"]), (50.0, ["0B/s", "1KiB/s", "1MiB/s", "1GiB/s", "1TiB/s", "1PiB/s"])], {6}),
    (axes.temperature, [40, 120], [(100.0, ["0°C", "50°C", "100°C"]), (120.0, ["0°C", "60°C", "120°C"])], None),
    (lambda p: axes.temperature(p, limit=80), [150], [(80.0, ["0°C", "40°C", "80°C"])], None),
    (lambda p: axes.temperature(p, "fahrenheit"), [100], [(212.0, ["0°F", "106°F", "212°F"])], None),
    (lambda p: axes.temperature(p, "kelvin"), [100], [(373.149994, ["0K", "187K", "374K"])], None),
    (axes.power, [0, 20], [(1.0, ["0.0W", "0.5W", "1.0W"]), (25.0, ["0.0W", "12.5W", "25.0W"])], {7}),
    (lambda p: axes.token_rate(p, log=False), [0, 1200], [(1.0, ["0/s", "0/s", "1/s"]), (1500.0, ["0/s", "750/s", "1.5k/s"])], {9}),
    (axes.token_rate, [2, 1024, 0], [(4.0, ["0/s", "4/s", "16/s"]), (11.0, ["0/s", "45/s", "2.0k/s"]), (4.0, ["0/s", "4/s", "16/s"])], {9}),
    (axes.token_count, [0, 1000, 4e9], [(1.0, ["0", "0", "1"]), (1100.0, ["0", "550", "1.1k"]), (4.4e9, ["0", "2.2B", "4.4B"])], {9}),
    (lambda p: axes.token_count(p, log=True), [7, 2**20], [(10.0, ["0", "32", "1.0k"]), (22.0, ["0", "2.0k", "4.2M"])], {9}),
]


@pytest.mark.parametrize("axis, peaks, want, sizes", GOLDEN)
def test_axes(spark, axis, peaks, want, sizes):
    got, lengths = shown(spark, axis, peaks)
    assert [(t, x) for t, x in got] == [(pytest.approx(t), x) for t, x in want]
    assert sizes is None or all(x == sizes or x <= {*sizes} for x in lengths) or sizes <= set().union(*lengths)


def test_labels_and_rates_that_are_longer_stay_whole(spark):
    got, _ = shown(spark, lambda p: axes.bytes_linear(p, "B", False, 5), [9e17])
    assert got[0][1] == ["0TB", "450000.0", "900000.0", "1350000.0"]
    rate = spark.range(1).select(*[units.fixed_rate(F.lit(x).cast("double")) for x in (0, 512, 1536, 5 * 2**50)]).first()
    assert list(rate) == ["     0.0B/s", "   512.0B/s", "   1.5KiB/s", "5120.0TiB/s"]


def test_legend_has_the_rows_of_its_height(spark):
    names = spark.createDataFrame([(c,) for c in "dbac"], "name string")
    assert [[r.name for r in views.legend(names, "name", h).collect()] for h in (2, 0, -1, 7)] == [["a", "b"], [], [], ["a", "b", "c", "d"]]


# fixed values: (text, columns that it takes)
WIDTHS = [("", 0), ("abc", 3), ("漢字", 4), ("é", 1), ("é", 1), ("😀!", 3), ("ｱ", 1), ("Ａ", 2), ("a​b", 2), ("­", 1), ("한", 2), ("한", 2), ("🇩🇪", 2)]


def test_widths(spark):
    rows = spark.createDataFrame([(t,) for t, _ in WIDTHS], "t string")
    got = {r.t: r.w for r in rows.select("t", widths.width(F.col("t")).alias("w")).collect()}
    assert got == dict(WIDTHS)
    assert all(a <= z for k in (0, 2) for a, z in widths.intervals(k)) and ord("漢") in range(0x4E00, 0x9FFF) and unicodedata.east_asian_width("漢") == "W"
    assert views.column_widths(rows, ["t"]).first().t == 4
    null = spark.createDataFrame([(None,)], "t string").select(widths.width(F.col("t")).alias("w"), widths.cut(F.col("t"), 3).alias("c"), widths.cut(F.col("t"), 0).alias("z")).first()
    assert tuple(null) == (None, None, None)


def told(text, columns):
    size = lambda s: sum(widths._columns(ord(c)) for c in s)
    if columns <= 0:
        return ""
    if size(text) <= columns:
        return text
    n = next(n for n in range(len(text), -1, -1) if size(text[:n]) <= columns - 1)
    return text[:n] + "…"


@pytest.mark.parametrize("columns", [0, 1, 2, 5, 9])
def test_cut(spark, columns):
    import random

    r = random.Random(columns)
    samples = ["".join(r.choice("ab漢é😀 \n​한") for _ in range(r.randrange(14))) for _ in range(150)] + ["x" * 5000, "́" * 20, "漢" * 9]
    rows = spark.createDataFrame([(t,) for t in samples], "t string").select("t", texts.ellipsis(F.col("t"), columns).alias("c")).collect()
    assert [r.c for r in rows] == [told(r.t, columns) for r in rows]


DF = {"storage-system-information": {"filesystem": [
    {"name": "/dev/ada0p2", "total-blocks": 100, "used-blocks": 40, "available-blocks": 52, "mounted-on": "/"},
    {"name": "zroot", "total-blocks": "many", "used-blocks": 1, "mounted-on": "/z"}]}}


def test_disk_usage_of_json(spark):
    outputs = spark.createDataFrame([(1, json.dumps(DF)), (2, json.dumps(DF)[:70]), (3, '{"other": 1}'), (4, None), (5, "[]"), (6, json.dumps({"storage-system-information": {"filesystem": {"name": "one"}}}))], "id int, text string")
    got = sorted(tuple(r) for r in nested.disk_usage(outputs).select("id", "name", "mount_point", "used", "free", "total").collect())
    assert got == [(1, "/dev/ada0p2", "/", 40960, 53248, 102400), (1, "zroot", "/z", 1024, None, None), (6, "one", None, None, None, None)]
    assert nested.disk_usage(outputs.limit(0)).count() == 0


def test_key_at_any_depth(spark):
    deep = {"a": [{"b": {"filesystem": [{"name": "x"}]}}, {"filesystem": [{"name": "y"}]}], "filesystem": [{"name": "z"}, {"name": "w"}]}
    rows = spark.createDataFrame([(1, json.dumps(deep)), (2, "{broken"), (3, "5"), (4, None)], "id int, doc string")
    found = nested.under_key(rows, "doc", "filesystem", "fs").drop("doc")
    got = nested.elements(found, "fs", {"name": ("name", "string")}).collect()
    assert sorted((r.id, r.name) for r in got) == [(1, "w"), (1, "x"), (1, "y"), (1, "z")]
    with pytest.raises(ValueError):
        nested.unwrap(F.col("doc"), 'a"b')


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("parts", [1, 3, 256])
def test_gaps_by_parts_of_the_time(spark, parts):
    import random

    r = random.Random(parts)
    ticks = sorted(r.sample(range(-1000, 4000), 60))
    samples = [(t, k, float(t)) for k in "abcdefg" for t in r.sample(ticks, r.randrange(1, 20))] + [(9999, "late", 1.0), (-9999, "early", 2.0)]
    rows, marks = spark.createDataFrame(samples, "at long, k string, v double"), spark.createDataFrame([(t,) for t in ticks * 2], "at long")
    made = series.with_gaps(rows, marks, "k", "at", "v", parts)
    assert "NestedLoop" not in plan_of(made) and "Cartesian" not in plan_of(made)
    known = {(t, k): v for t, k, v in samples}
    born = {k: min(t for t, x, _ in samples if x == k) for _, k, _ in samples}
    want = [(k, t, known.get((t, k))) for k in born for t in ticks if t >= born[k]]
    assert sorted(map(tuple, made.collect()), key=str) == sorted(want, key=str)
    assert series.with_gaps(rows.limit(0), marks, "k", "at", "v").count() == series.with_gaps(rows, marks.limit(0), "k", "at", "v").count() == 0


def test_hosts_don_t_mix(spark):
    """Rates, shares and usage of two hosts at the same times, and of one that isn't named."""
    stats = spark.createDataFrame([("a", 1, "cpu 10 0 0 90 0 0 0 0\n"), ("b", 1, "cpu 50 0 0 50 0 0 0 0\n"), ("a", 2, "cpu 40 0 0 160 0 0 0 0\n"), ("b", 2, "cpu 51 0 0 149 0 0 0 0\n")], "host string, ts int, text string")
    usage = {(r.host, r.ts): r.usage for r in host.cpu_usage(host.cpu_rows(stats)).collect()}
    assert usage == {("a", 1): None, ("b", 1): None, ("a", 2): pytest.approx(30.0), ("b", 2): pytest.approx(1.0)}
    assert len(host.cpu_usage(host.cpu_rows(stats.drop("host"))).collect()) == 4
    interfaces = spark.createDataFrame([(h, f"2024-01-01 00:00:0{s}", "eth0", n, 2 * n, n, n) for h, s, n in (("a", 1, 100), ("a", 3, 300), ("b", 1, 7), ("b", 3, 5))], "host string, t string, name string, rx_bytes long, tx_bytes long, rx_packets long, tx_packets long")
    interfaces = interfaces.withColumn("ts", F.col("t").cast("timestamp"))
    rates = {(r.host, r.t): (r.rx, r.tx, r.rx_packet_rate) for r in host.network_rates(host.network_totals(interfaces)).withColumn("t", F.second("ts")).collect()}
    assert rates == {("a", 1): (800, 1600, 100), ("a", 3): (800, 1600, 100), ("b", 1): (56, 112, 7), ("b", 3): (0, 0, 0)}
    one = host.network_rates(host.network_totals(interfaces.filter("host = 'a'").drop("host")))
    assert sorted((r.rx, r.tx) for r in one.collect()) == [(800, 1600), (800, 1600)]
    groups = spark.createDataFrame([(h, f"2024-01-01 00:00:0{s}", 200_000, 100_000, n) for h, s, n in (("a", 0, 0), ("a", 1, 10**9), ("b", 0, 5 * 10**9), ("b", 1, 5 * 10**9))], "host string, t string, v1_quota long, v1_period long, v1_usage_ns long")
    groups = groups.selectExpr("host", "cast(t as timestamp) ts", "v1_quota", "v1_period", "v1_usage_ns", "cast(null as string) v2_max", "cast(null as long) v2_usage_us")
    shares = sorted((r.host, r.percent) for r in host.cgroup_cpu(groups).collect() if r.percent is not None)
    assert shares == [("a", 50.0), ("b", 0.0)]
    memory = spark.createDataFrame([(h, 1, f"MemTotal: {n} kB\nMemFree: 10 kB\nMemAvailable: 10 kB\n") for h, n in (("a", 100), ("b", 200))], "host string, ts int, text string")
    assert sorted((r.host, r.total) for r in host.memory_rows(memory).collect()) == [("a", 102400), ("b", 204800)]


def test_loads_and_units(spark):
    from tidemark.functions import parsers

    row = spark.range(1).select(units.bits_to_bytes(F.lit(17)).alias("b"), units.arc_adjusted(F.lit(10), F.lit(7), F.lit(3)).alias("a"), units.arc_adjusted(F.lit(3), F.lit(9), F.lit(1)).alias("z"), units.bar_count(F.lit(50.0), 9).alias("bars")).first()
    assert tuple(row) == (2, 6, 0, 5)
    assert hasattr(parsers, "memory_fields")
