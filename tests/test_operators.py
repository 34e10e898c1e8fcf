import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import filters, hierarchy, rates, series, tokens, views
from tidemark.sources.logs import parse_records, read_logs, read_registry
from tidemark.sources.tail import TailSource, complete_until


def test_allow_and_deny(spark):
    names = spark.createDataFrame([(n,) for n in ("eth0slab", "virbr0", "eth0", "wlan0", "lo")], "n string")
    assert [r.n for r in names.filter(filters.keep(F.col("n"), ["virbr0", "eth0"], deny=False)).collect()] == ["eth0slab", "virbr0", "eth0"]
    assert names.filter(filters.keep(F.col("n"), ["eth"], deny=True)).count() == 3
    disks = spark.createDataFrame(list(enumerate([("nvme0n1p1", "/boot"), ("nvme0n1p2", "/"), ("nvme0n1p3", "/home"), ("sda1", "/mnt/test"), ("sda2", "/mnt/boot")])), "i int, d struct<n:string,m:string>").coalesce(1)
    kept = lambda a, b: [r.i for r in disks.filter(filters.keep_entry(F.col("d.n"), F.col("d.m"), a, b)).collect()]
    assert kept((["nvme"], True), None) == [3, 4]
    assert kept((["nvme"], True), (["boot"], True)) == [3]
    assert kept((["nvme"], False), (["boot"], True)) == [0, 1, 2, 3]
    assert kept((["nvme"], True), (["boot"], False)) == [0, 3, 4]
    assert kept((["nvme"], False), (["boot"], False)) == [0, 1, 2, 4]


def test_sorting_ties_go_by_id(spark):
    rows = spark.createDataFrame([("A", 1, 0.0, 1.1), ("B", 2, 1.1, 2.2), ("C", 3, 2.2, 0.0), ("D", 4, 0.0, 0.0)], "n string, pid int, cpu double, mem double")
    order = lambda c, d: "".join(r.n for r in views.sorted_rows(rows, F.col(c), d, "pid").collect())
    assert [order("cpu", True), order("cpu", False), order("mem", True), order("mem", False)] == ["CBAD", "ADBC", "BACD", "CDAB"]
    s = views.Sorting({"cpu": True, "name": False}, "cpu")
    assert s.choose("cpu").descending is False and s.choose("name").descending is False
    assert views.scroll_start(12, 5, 3, True) == 8 and views.scroll_start(2, 5, 3, False) == 2


def test_first_sample_and_reset(spark):
    rows = spark.createDataFrame([("a", 0, 10), ("a", 2, 30), ("a", 4, 5)], "k string, s int, c long").withColumn("ts", F.timestamp_seconds("s"))
    for first, value in ((rates.First.ZERO, 0.0), (rates.First.NULL, None), (rates.First.TOTAL, 10.0)):
        got = rates.counter_to_rate(rows, ["k"], "ts", "c", first).orderBy("s").collect()
        assert [r.rate for r in got] == [value, 10.0, 0.0]
    assert rates.counter_to_rate(rows, ["k"], "ts", "c", rates.First.OMIT).count() == 2


def test_visible_peak(spark):
    rows = spark.createDataFrame([(-500, 100.0), (-50, 5.0), (0, 7.0)], "ms long, v double").withColumn("ts", F.timestamp_millis(F.col("ms") + 10**12))
    assert [series.visible_peak(rows, "ts", "v", n).first().peak for n in (100, 1000)] == [7.0, 100.0]
    assert series.visible_peak(rows.withColumn("v", -F.col("v")), "ts", "v", 1000).first().peak == 0.0


def test_forest(spark):
    rows = spark.createDataFrame([(1, None, 5), (2, 1, 1), (3, 1, 9), (4, 3, 2), (5, 99, 7), (6, 7, 1), (7, 6, 1)], "id int, p int, v long")
    closed = hierarchy.closure(rows, "id", "p")
    assert {r.node for r in closed.collect()} == {1, 2, 3, 4, 5}  # 6 and 7 are a cycle
    up = {r.ancestor: r.v for r in hierarchy.rollup(closed, rows.select("id", "v"), "id", ["v"]).collect()}
    assert up == {1: 17, 2: 1, 3: 11, 4: 2, 5: 7}
    placed = hierarchy.depth_first(closed, rows, "id", "v", descending=True)
    assert [r.node for r in placed.orderBy("position").collect()] == [5, 1, 3, 4, 2]
    assert {r.node: r.prefix for r in hierarchy.prefix(placed).collect()} == {5: "", 1: "", 3: "├─ ", 4: "│  └─ ", 2: "└─ "}
    shown = {r.node: r.disabled for r in hierarchy.shown(closed, rows.filter("id = 3"), "id").collect()}
    assert shown == {1: True, 3: False, 4: True}


def record(i, output, ms="2026-08-24T20:03:30Z", model="x-opus", **more):
    return json.dumps({"type": "assistant", "requestId": f"r{i}", "timestamp": ms, "message": {"id": f"m{i}", "model": model, "usage": {"input_tokens": 10, "output_tokens": output, "cache_read_input_tokens": 100, "cache_creation_input_tokens": 5}}} | more)


BASE = 1787601600000


def logged(spark, lines):
    return parse_records(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "ord long, value string"))


def test_token_totals(spark):
    lines = [record(1, 3), record(1, 12), record(1, 20), record(1, 3), "{not json", "", record(2, 5, model="<synthetic>"), record(3, 5, isApiErrorMessage=True), record(4, 5, type="user"), record(5, 1, isSidechain=True, model="a-haiku"), json.dumps({"type": "system", "subtype": "turn_duration", "durationMs": 5783500})]
    rows = logged(spark, lines)
    single = tokens.once(tokens.requests(rows, []), [])
    got = {r.family: r for r in tokens.totals(single, ["family"]).collect()}
    assert (got["Opus"].input, got["Opus"].output, got["Opus"].cache_read, got["Opus"].cache_creation, got["Opus"].main_messages) == (10, 20, 100, 5, 1)
    assert (got["Haiku"].sidechain_messages, set(got)) == (1, {"Opus", "Haiku"})
    assert tokens.last_duration(rows.withColumn("s", F.lit(1)), ["s"]).first().duration_ms == 5783500


@pytest.mark.parametrize("lines,expected", [
    ([record(1, 20)], {(BASE + 180000, "Opus"): 135}),
    ([record(1, 20), record(1, 20)], {(BASE + 180000, "Opus"): 135}),
    ([record(1, 20, "2026-08-24T20:03:59Z"), record(1, 50, "2026-08-24T20:04:01Z")], {(BASE + 180000, "Opus"): 165}),
    ([record(1, 20), record(2, 40, model="b-sonnet")], {(BASE + 180000, "Opus"): 135, (BASE + 180000, "Sonnet"): 155}),
    ([record(1, 20, "2026-08-24T10:03:30Z"), record(2, 20, "soon")], {}),
])
def test_token_history(spark, lines, expected):
    rows = tokens.history(logged(spark, lines), BASE + 600_000).collect()
    assert {(r.start_ms, r.family): r.input + r.output + r.cache_read + r.cache_creation for r in rows} == expected


def test_buckets_are_filled(spark):
    rows = spark.createDataFrame([(BASE, 5)], "start_ms long, total long")
    got = series.fill_buckets(rows, BASE, BASE + 59 * 60_000, 60_000).orderBy("start_ms").collect()
    assert len(got) == 60 and sum(r.total for r in got) == 5
    assert series.clamp_bucket(0, 0) == (1000, 1000)


def test_log_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.jsonl").write_text(record(1, 3) + "\n" + record(1, 9) + "\n{bad\n")
    (tmp_path / "a" / "y.txt").write_text(record(2, 3))
    assert read_logs(spark, str(tmp_path)).count() == 2
    for pid, at in ((1, 5), (2, 9), (3, 9)):
        (tmp_path / f"{pid}.json").write_text(json.dumps({"pid": pid, "sessionId": f"s{pid}", "updatedAt": at}))
    (tmp_path / "4.json").write_text("{oops")
    assert [r.pid for r in read_registry(spark, str(tmp_path)).collect()] == [2, 3, 1]
    assert [r.pid for r in read_registry(spark, str(tmp_path), spark.createDataFrame([(1,), (3,)], "pid int")).collect()] == [3, 1]


def test_tail_source(spark, tmp_path):
    spark.dataSource.register(TailSource)
    logs, out, check = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "check")
    logs.mkdir()
    f = logs / "x.jsonl"

    def run():
        q = spark.readStream.format("tail").option("path", str(logs)).load().writeStream.format("parquet").option("checkpointLocation", check).option("path", out).trigger(processingTime="1 second").start()
        q.processAllAvailable()
        q.stop()
        return sorted(r.value for r in spark.read.parquet(out).collect())

    f.write_text("one\ntwo\npart")
    assert complete_until(str(f), 0) == 8
    assert run() == ["one", "two"]
    with f.open("a") as h:
        h.write("ial\nthree\n")
    assert run() == ["one", "partial", "three", "two"]
    assert run() == ["one", "partial", "three", "two"]


@pytest.mark.parametrize("kind", ["long", "double", "string"])
@pytest.mark.parametrize("descending", [False, True])
def test_depth_first_of_any_column(spark, kind, descending):
    """Siblings by value, nulls smallest, ties by id; a node before what is below it."""
    rows = [("a", None, 5), ("b", None, None), ("c", "gone", 5), ("d", "a", 1), ("e", "a", 7), ("f", "a", None), ("g", "e", 0), ("h", "b", -(2**63)), ("i", "b", 3), ("j", "a", 7)]
    df = spark.createDataFrame(rows, "id string, parent string, v long").withColumn("v", F.col("v").cast(kind))
    got = hierarchy.depth_first(hierarchy.closure(df, "id", "parent"), df, "id", "v", descending)
    text = {i: v if kind != "string" or v is None else str(v) for i, _, v in rows}
    known = {i for i, _, _ in rows}

    def below(parent):
        own = sorted(i for i, p, _ in rows if (p if p in known else None) == parent)
        some = sorted((i for i in own if text[i] is not None), key=lambda i: text[i], reverse=descending)
        none = [i for i in own if text[i] is None]
        return [x for i in (some + none if descending else none + some) for x in (i, *below(i))]

    assert [r.node for r in got.orderBy("position").collect()] == below(None)
