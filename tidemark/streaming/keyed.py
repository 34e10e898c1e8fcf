"""Keyed state of streams: values and maps that expire, timers, and the state itself as a table.

State lies in Spark's own state store, under the query's checkpoint, so it is recovered and versioned with the offsets.
Processors here keep a few numbers a key. What a key that is gone left behind goes by time to live or by a timer.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.rates import First

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Fixed value: the shortest time between two batches.
LEAST_MS = 250


@contextmanager
def _session_settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """A query takes the session's settings with it when it starts; afterwards they are as before."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def start(
    made: DataFrame,
    checkpoint: str,
    each: Callable[[DataFrame, int], None] | None = None,
    every_ms: int | None = None,
    idle_batches: bool = True,
    versions: int = 100,
) -> StreamingQuery:
    """Start a stream whose state lies under checkpoint. each(rows, batch) gets what it makes; a batch may come again.

    every_ms: a batch that often, LEAST_MS at least; with idle_batches timers fire then even if no row came. None: to the end of
    what there is, where timers fire in batches that have rows. versions: how many batches back the state can be read.
    """
    if every_ms is not None and every_ms < LEAST_MS:
        raise ValueError(f"batches come {LEAST_MS} ms apart at least")
    alone = every_ms is not None and idle_batches  # to the end of the input, empty batches would never end
    settings = {
        "spark.sql.streaming.stateStore.providerClass": PROVIDER,
        "spark.sql.streaming.noDataMicroBatches.enabled": str(alone).lower(),
        "spark.sql.streaming.minBatchesToRetain": str(versions),
    }
    out = made.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    out = out.foreachBatch(each) if each else out.format("noop")
    out = out.trigger(availableNow=True) if every_ms is None else out.trigger(processingTime=f"{every_ms} milliseconds")
    with _session_settings(made.sparkSession, settings):
        return out.start()


def _operators(spark: SparkSession, checkpoint: str) -> list:
    return spark.read.format("state-metadata").load(checkpoint).collect()  # a row for each operator


def version(spark: SparkSession, checkpoint: str) -> int:
    """The newest batch whose state can be read."""
    return max(r["maxBatchId"] for r in _operators(spark, checkpoint))


def state_of(spark: SparkSession, checkpoint: str, variable: str, at: int | None = None) -> DataFrame:
    """The state variable of that name, as of batch `at` or the newest: (key, value) of a value state, (key, user_map_key,
    user_map_value) of a map state, and partition_id. The stream may run on meanwhile."""
    named = lambda r: {v["stateName"] for v in json.loads(r["operatorProperties"] or "{}").get("stateVariables", [])}
    (operator,) = {r["operatorId"] for r in _operators(spark, checkpoint) if variable in named(r)}
    reader = spark.read.format("statestore").option("operatorId", operator).option("stateVarName", variable)
    if at is not None:
        reader = reader.option("batchId", at)
    return reader.load(checkpoint)


class _Last(StatefulProcessor):
    """Rate to the sample before, across batches. State: the newest sample of a key, for idle_ms after it came."""

    def __init__(self, key: str, carry: list[str], idle_ms: int | None) -> None:
        self.key, self.carry, self.idle_ms = key, carry, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ms long, value double", self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True).sort_values(["ms", "value"], ignore_index=True)
        ms, value = frame.ms.shift().astype("float64"), frame.value.shift()
        newest = (int(frame.ms.iloc[-1]), float(frame.value.iloc[-1]))
        known = self.last.get() if self.last.exists() else None
        first = pd.Series(False, frame.index)
        if known is None:
            first.iloc[0] = True
        else:
            late = frame.ms < known[0]  # samples before one of an earlier batch have no rate, and that one stays the last
            at = int(late.sum())
            ms[late] = float("nan")
            if at < len(frame):
                ms.iloc[at], value.iloc[at] = known
            if known[0] > newest[0]:
                newest = tuple(known)
        self.last.update(newest)
        rise, seconds = (frame.value - value).clip(lower=0), (frame.ms - ms) / 1000
        rate = (rise / seconds.where(seconds > 0)).where(seconds != 0, 0.0)
        yield pd.DataFrame({self.key: key[0], **{c: frame[c] for c in self.carry}, "ms": frame.ms, "rate": rate, "first": first})

    def close(self) -> None:
        pass


def rates(samples: DataFrame, key: str, carry: list[str], ms: str, value: str, first: First = First.NULL, idle_ms: int | None = None) -> DataFrame:
    """(key, carry, ms, rate) of a stream of counter samples: the rise a second to the sample before of that key, 0 for a fall.

    A key's first sample has no rate, 0 or no row (`first`); so has the first one after the key was silent for idle_ms,
    by when its state is gone (None: kept for ever). Of samples of one time in a batch the
    smaller is first, and the rate between them is 0. A sample older
    than one of an earlier batch has no rate and changes nothing. The rows of one key in one batch are sorted in memory, so the
    source's limit a batch (maxFilesPerTrigger and the like) bounds them.
    """
    if first is First.TOTAL:
        raise ValueError("a stream knows no time before its first sample")
    rows = samples.select(key, *carry, F.col(ms).cast("long").alias("ms"), F.col(value).cast("double").alias("value"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in (key, *carry)] + ["ms long, rate double, first boolean"])
    made = rows.groupBy(key).transformWithStateInPandas(_Last(key, carry, idle_ms), schema, "append", "processingTime")
    made = made.withColumn("rate", F.when(~F.isnan("rate"), F.col("rate")))
    if first is First.OMIT:
        made = made.filter(~F.col("first"))
    elif first is First.ZERO:
        made = made.withColumn("rate", F.when(F.col("first"), F.lit(0.0)).otherwise(F.col("rate")))
    return made.drop("first")


class _Top(StatefulProcessor):
    """The first record by ord names the bucket, for good; the highest output counts."""

    def __init__(self, keys: list[str], idle_ms: int | None) -> None:
        self.keys, self.idle_ms = keys, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.top = handle.getValueState("top", "start_ms long, output long", self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.top.get() if self.top.exists() else None
        start, top, first = (*known, None) if known else (None, 0, None)
        for frame in rows:  # one frame at a time: the smallest ord and the highest output are all that counts
            i = frame.ord.idxmin()
            if known is None and (first is None or frame.ord[i] < first):
                first, start = frame.ord[i], int(frame.start_ms[i])
            top = max(top, int(frame.output.max()))
        self.top.update((start, top))
        before = known[1] if known else 0
        yield pd.DataFrame({**{k: [v] for k, v in zip(self.keys, key)}, "start_ms": [start], "output": [top], "risen": [top - before]})

    def close(self) -> None:
        pass


def high_water(records: DataFrame, keys: list[str], idle_ms: int | None = None) -> DataFrame:
    """(keys, start_ms, output, risen) of a stream of records (keys, ord, start_ms, output): a row for each key of a batch, with the
    bucket of its first record, its highest output so far, and how far this batch raised it. A key that was silent for
    idle_ms is forgotten (None: never). Order within a batch is that of ord; across batches the earlier batch is first."""
    kinds = {f.name: f.dataType.simpleString() for f in records.schema.fields}
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["start_ms long, output long, risen long"])
    rows = records.select(*keys, "ord", "start_ms", "output")
    return rows.groupBy(*keys).transformWithStateInPandas(_Top(keys, idle_ms), schema, "append", "processingTime")


class _Missing(StatefulProcessor):
    """Samples, and an empty one for each known key that a tick lacks. State of a shard: when each key was last there."""

    def __init__(self, kind: str, forget_ms: int | None) -> None:
        self.kind, self.forget_ms = kind, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", f"name {self.kind}", "ms long", self.forget_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True).sort_values("ms", kind="stable", ignore_index=True)
        known = {k[0]: v[0] for k, v in self.known.iterator()}
        for ms, tick in frame.groupby("ms", sort=True):
            there = tick[~tick.is_tick]
            for name in there.name:
                known[name] = int(ms)
                self.known.updateValue((name,), (int(ms),))
            yield pd.DataFrame({"name": there.name, "ms": int(ms), "value": there.value})
            if tick.is_tick.any():
                absent = [k for k, at in known.items() if at < ms and (self.forget_ms is None or ms - at <= self.forget_ms)]
                if absent:
                    yield pd.DataFrame({"name": absent, "ms": int(ms), "value": [None] * len(absent)}).astype({"value": "float64"})

    def close(self) -> None:
        pass


def gap_rows(samples: DataFrame, ticks: DataFrame, key: str, ms: str, value: str, shards: int = 32, forget_ms: int | None = None) -> DataFrame:
    """(key, ms, value) of two streams, samples (key, ms, value) and ticks (ms): the samples, and for each tick a row without
    value for every key that was there before and isn't now. Ticks go to every shard of the keys, so they meet without a
    join; a shard holds a number for each of its keys, for forget_ms after the last sample (None: for ever). A tick and its
    samples come in one batch, ticks in order of time."""
    kind = dict(samples.dtypes)[key]
    none = F.lit(None)
    rows = samples.select(
        F.pmod(F.xxhash64(key), F.lit(shards)).cast("int").alias("shard"), F.col(key).alias("name"), F.col(ms).cast("long").alias("ms"),
        F.col(value).cast("double").alias("value"), F.lit(False).alias("is_tick"),
    )
    each = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    marks = ticks.select(each, none.cast(kind).alias("name"), F.col(ms).cast("long").alias("ms"), none.cast("double").alias("value"), F.lit(True).alias("is_tick"))
    made = rows.unionByName(marks).groupBy("shard").transformWithStateInPandas(_Missing(kind, forget_ms), f"name {kind}, ms long, value double", "append", "processingTime")
    return made.select(F.col("name").alias(key), F.col("ms").alias(ms), F.when(~F.isnan("value"), F.col("value")).alias(value))
