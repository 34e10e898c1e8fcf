"""Streams of many batches with keyed state, which is read back."""

import json
import os
import time
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.operators import series, tokens
from tidemark.operators.rates import First
from tidemark.sources import tail
from tidemark.streaming import keyed
from tidemark.streaming.history import RollingHistory


class Feed:
    """A stream of files that a test adds one by one, a batch each."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema = spark, str(path), schema
        os.makedirs(self.path)
        self.rows = spark.readStream.schema(schema).parquet(self.path)
        self.out, self.n = [], 0

    def start(self, made, checkpoint):
        self.query = keyed.start(made, str(checkpoint), lambda df, batch: self.out.append([tuple(r) for r in df.collect()]), 250, idle_batches=False)
        return self.query

    def add(self, rows):
        """What the stream makes of these rows."""
        self.n += 1
        aside = f"{self.path}/../aside-{self.n}"
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(aside)
        (part,) = [f for f in os.listdir(aside) if f.endswith(".parquet")]
        os.replace(f"{aside}/{part}", f"{self.path}/{self.n}.parquet")
        del self.out[:]
        self.query.processAllAvailable()
        return sorted((r for batch in self.out for r in batch), key=str)


def test_rates_over_batches_forget_silent_keys(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", "host string, id long, at long, n long")
    made = keyed.rates(feed.rows, "host", ["id"], "at", "n", idle_ms=16_000)
    query = feed.start(made, tmp_path / "ck")
    try:
        # samples of a batch come in any order; a fall is a restart of the counter
        assert feed.add([("a", 2, 2_000, 30), ("a", 1, 1_000, 10), ("b", 3, 1_000, 5), ("a", 4, 4_000, 7)]) == [
            ("a", 1, 1_000, None), ("a", 2, 2_000, 20.0), ("a", 4, 4_000, 0.0), ("b", 3, 1_000, None)]
        # the last sample of the batch before is kept; an older one has no rate; one of the same time has rate 0
        assert feed.add([("a", 5, 6_000, 17), ("a", 6, 3_000, 99), ("a", 7, 6_000, 20)]) == [("a", 5, 6_000, 5.0), ("a", 6, 3_000, None), ("a", 7, 6_000, 0.0)]
        # only late ones: state stays
        assert feed.add([("a", 8, 5_000, 1)]) == [("a", 8, 5_000, None)]
        assert keyed.version(spark, str(tmp_path / "ck")) == 2
        held = keyed.state_of(spark, str(tmp_path / "ck"), "last")
        assert {r.key.host for r in held.collect()} == {"a", "b"}
        assert {r.key.host for r in keyed.state_of(spark, str(tmp_path / "ck"), "last", at=0).collect()} == {"a", "b"}
        time.sleep(17)
        assert feed.add([("c", 9, 9_000, 1)]) == [("c", 9, 9_000, None)]
        assert feed.add([("b", 10, 9_000, 50)]) == [("b", 10, 9_000, None)]  # b was silent, so this is its first sample again
        assert {r.key.host for r in keyed.state_of(spark, str(tmp_path / "ck"), "last").collect()} == {"b", "c"}
    finally:
        query.stop()


def test_first_samples(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", "host string, id long, at long, n long")
    with pytest.raises(ValueError):
        keyed.rates(feed.rows, "host", [], "at", "n", First.TOTAL)
    with pytest.raises(ValueError):
        keyed.start(feed.rows, str(tmp_path / "ck"), every_ms=249)
    both = keyed.rates(feed.rows, "host", ["id"], "at", "n", First.ZERO).unionByName(keyed.rates(feed.rows, "host", ["id"], "at", "n", First.OMIT))
    query = feed.start(both, tmp_path / "ck")
    try:
        assert feed.add([("a", 1, 1_000, 10), ("a", 2, 2_000, 30)]) == [("a", 1, 1_000, 0.0), ("a", 2, 2_000, 20.0), ("a", 2, 2_000, 20.0)]
    finally:
        query.stop()


def test_high_water_over_batches(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", "session string, id string, ord long, start_ms long, output long")
    query = feed.start(keyed.high_water(feed.rows, ["session", "id"], idle_ms=16_000), tmp_path / "ck")
    try:
        assert feed.add([("s", "a", 2, 60, 5), ("s", "a", 1, 0, 3), ("s", "b", 3, 60, 1)]) == [("s", "a", 0, 5, 5), ("s", "b", 60, 1, 1)]
        assert feed.add([("s", "a", 0, 120, 4)]) == [("s", "a", 0, 5, 0)]  # the bucket stays, and the output doesn't fall
        assert feed.add([("s", "a", 9, 120, 9), ("t", "a", 9, 120, 2)]) == [("s", "a", 0, 9, 4), ("t", "a", 120, 2, 2)]
        time.sleep(17)
        feed.add([("u", "z", 9, 120, 9)])
        left = keyed.state_of(spark, str(tmp_path / "ck"), "top").select("key.*").collect()
        assert [tuple(r) for r in left] == [("u", "z")]
    finally:
        query.stop()


def test_gap_rows_equal_their_batch_twin(spark, tmp_path):
    """Ticks meet the keys known by then, batch after batch."""
    feed = Feed(spark, tmp_path / "in", "at long, name string, n double, is_tick boolean")
    made = keyed.gap_rows(feed.rows.filter("not is_tick"), feed.rows.filter("is_tick"), "name", "at", "n", shards=5)
    query = feed.start(made, tmp_path / "ck")
    batches = [
        [(1, "a", 1.0), (1, "b", 2.0), (2, "a", 3.0)], [(3, "c", 1.0), (4, "a", 5.0), (4, "c", 1.5)], [(6, None, None)], [(7, "b", 9.0), (8, "é", 0.0)], [(9, "a", 1.0)],
    ]
    got, samples, ticks = [], [], set()
    try:
        for rows in batches:
            own = {r[0] for r in rows} | ({5} if rows[0][0] == 6 else set())
            ticks |= own
            kept = [(at, name, n) for at, name, n in rows if name is not None]
            samples += kept
            got += feed.add([(at, name, n, False) for at, name, n in kept] + [(at, None, None, True) for at in own])
        known = {r.user_map_key.name for r in keyed.state_of(spark, str(tmp_path / "ck"), "known").collect()}
    finally:
        query.stop()
    twin = series.with_gaps(spark.createDataFrame(samples, "at long, name string, n double"), spark.createDataFrame([(t,) for t in ticks], "at long"), "name", "at", "n")
    assert sorted(got, key=str) == sorted(map(tuple, twin.collect()), key=str)
    assert known == {"a", "b", "c", "é"}


def stamp(ms):
    return datetime.fromtimestamp(ms / 1000, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.") + f"{ms % 1000:03d}Z"


def record(m, ms, output, request="r", model="x-opus-1"):
    usage = {"input_tokens": 1, "output_tokens": output, "cache_read_input_tokens": 2, "cache_creation_input_tokens": 3}
    return json.dumps({"type": "assistant", "requestId": request, "timestamp": ms and stamp(ms), "message": {"id": m, "model": model, "usage": usage}})


class Told:
    """What the history should be: records taken in one by one."""

    def __init__(self, width, window):
        self.width, self.window, self.seen, self.buckets = width, window, {}, {}

    def take(self, now, lines):
        for m, ms, output, model in lines:
            family = "opus" if "opus" in model else "haiku"
            if m in self.seen:
                at, top = self.seen[m]
                if output > top:
                    self.buckets[at][1] += output - top
                    self.seen[m] = (at, output)
                continue
            if ms is None or ms < now - self.window:
                continue
            at = (ms - ms % self.width, family)
            self.seen[m] = (at, output)
            sums = self.buckets.setdefault(at, [0] * 4)
            for i, n in enumerate((1, output, 2, 3)):
                sums[i] += n


class Log:
    """The tail source over a folder, and a history fed by it."""

    def __init__(self, spark, tmp_path, width, window):
        spark.dataSource.register(tail.TailSource)
        self.logs = tmp_path / "logs"
        self.logs.mkdir()
        self.lines = spark.readStream.format("tail").load(str(self.logs))
        self.history = RollingHistory(spark, str(tmp_path / "history"), width, window, shards=4)

    def start(self):
        self.query = self.history.start(self.lines, 250, idle_batches=False)

    def append(self, name, *lines, end="\n"):
        with open(self.logs / name, "a") as f:
            f.write("\n".join(lines) + end)
        self.query.processAllAvailable()

    def rows(self):
        return {(r.start_ms, r.family.lower()): [r.input, r.output, r.cache_read, r.cache_creation] for r in self.history.buckets().collect()}


def test_rolling_history_of_the_tail_source(spark, tmp_path):
    """Late, repeated, broken, undated and restarted input against records taken in one by one."""
    log, told = Log(spark, tmp_path, 60_000, 3_600_000), Told(60_000, 3_600_000)
    now = int(time.time() * 1000)
    back = lambda minutes: now - minutes * 60_000
    batches = [
        ("b.jsonl", [("a", back(50), 1, "x-opus-1"), ("b", back(20), 4, "x-haiku"), ("a", back(10), 9, "x-opus-1"), ("c", back(70), 50, "x-opus-1")]),
        ("b.jsonl", [("b", back(90), 6, "x-opus-1"), ("c", back(30), 2, "x-haiku"), ("c", back(5), 1, "x-opus-1"), ("d", None, 9, "x-opus-1")]),
        ("a.jsonl", [("a", back(2), 12, "x-haiku"), ("e", back(2), 3, "x-haiku"), ("d", back(1), 9, "x-opus-1")]),
    ]
    log.start()
    try:
        for name, lines in batches:
            told.take(now, lines)
            log.append(name, *[record(m, ms, out, model=model) for m, ms, out, model in lines], "{broken", '{"type":"user"}')
            assert log.rows() == told.buckets
        log.append("a.jsonl", record("f", back(1), 5)[:30], end="")  # an unfinished line counts for nothing
        assert log.rows() == told.buckets
        # the file is replaced: requests of all files are forgotten, buckets stay
        again = [("a", back(40), 7, "x-opus-1"), ("a", back(40), 8, "x-opus-1")]
        new = tmp_path / "new"
        new.write_text("".join(record(m, ms, out, model=model) + "\n" for m, ms, out, model in again))
        os.replace(new, log.logs / "a.jsonl")
        told.seen.clear()
        told.take(now, again)
        log.query.processAllAvailable()
        assert log.rows() == told.buckets
        more = [("b", back(3), 100, "x-haiku")]
        told.take(now, more)
        log.append("b.jsonl", *[record(m, ms, out, model=model) for m, ms, out, model in more])
        assert log.rows() == told.buckets
    finally:
        log.query.stop()
    # the next start goes on from the checkpoint, and nothing counts twice
    log.start()
    try:
        more = [("b", back(3), 130, "x-haiku"), ("g", back(1), 1, "x-opus-1")]
        told.take(now, more)
        log.append("c.jsonl", *[record(m, ms, out, model=model) for m, ms, out, model in more])
        assert log.rows() == told.buckets
        grid = log.history.window_rows(now).collect()
    finally:
        log.query.stop()
    first = (now - now % 60_000) - 59 * 60_000
    assert sorted({r.start_ms for r in grid}) == [first + k * 60_000 for k in range(60)]
    assert {(r.start_ms, r.family.lower()): [r.input, r.output, r.cache_read, r.cache_creation] for r in grid if r.family} == {k: v for k, v in told.buckets.items() if k[0] >= first}
    assert all([r.input, r.output, r.cache_read, r.cache_creation] == [0] * 4 for r in grid if not r.family)


def test_window_moves_with_the_batches(spark, tmp_path):
    """Buckets and requests leave the state once the clock has passed them."""
    log = Log(spark, tmp_path, 1_000, 8_000)
    log.start()
    try:
        began = int(time.time() * 1000)
        log.append("a.jsonl", record("a", began, 5), record("old", began - 60_000, 9))
        assert [v[1] for v in log.rows().values()] == [5]
        time.sleep(max(0.0, (began + 10_500) / 1000 - time.time()))
        log.append("a.jsonl", record("a", began, 8), record("b", int(time.time() * 1000), 1))
        assert [v[1] for v in log.rows().values()] == [1]
        seen = keyed.state_of(spark, log.history.checkpoint, "seen").select("user_map_key.message_id").collect()
        assert [r.message_id for r in seen if r.message_id != "a"] == ["b"]
    finally:
        log.query.stop()


def test_pause_resume_reset(spark, tmp_path):
    """A paused view stays the same during three batches, then jumps to the newest; a reset begins anew."""
    log, now = Log(spark, tmp_path, 60_000, 3_600_000), int(time.time() * 1000) - 120_000
    log.start()
    try:
        log.append("a.jsonl", record("a", now, 5))
        log.history.pause()
        before = log.rows()
        assert [v[1] for v in before.values()] == [5]
        for k in range(3):
            log.append("a.jsonl", record(f"m{k}", now, 10))
            assert log.rows() == before
        log.history.resume()
        assert [v[1] for v in log.rows().values()] == [35]
        log.history.reset()
        other = RollingHistory(spark, log.history.folder, shards=4)
        assert other.run == 0 and log.history.run == 1
        log.lines = spark.readStream.format("tail").option("glob", "b*").load(str(log.logs))
        log.start()
        log.append("b.jsonl", record("a", now, 2))
        assert [v[1] for v in log.rows().values()] == [2]
        assert RollingHistory(spark, log.history.folder, shards=4).run == 1
    finally:
        log.query.stop()
    assert tokens.FIELDS == ("input", "output", "cache_read", "cache_creation")
