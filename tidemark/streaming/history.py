"""A rolling token history on keyed state: it lives on through batches, late records and restarts of its source.

Two states follow each other. Requests are dealt into shards by hash, and a shard's map knows of each request its family,
bucket and highest output; what a record adds goes on as a difference to its bucket, whose four sums are the second state.
So a batch touches only the requests and buckets that it has records of. A source that begins anew tells every shard,
which forgets its requests; buckets stay. Requests go by time to live, buckets by timers.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import tokens
from ..operators.series import clamp_bucket
from ..sources.logs import parse_records
from . import keyed

SHARDS = 64
_DELTA = "start_ms long, family string, input long, output long, cache_read long, cache_creation long"


class _Requests(StatefulProcessor):
    def __init__(self, width: int, window: int) -> None:
        self.width, self.window = width, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        # a request's bucket has left the window by then, whenever its last record came
        self.seen = handle.getMapState("seen", "request_id string, message_id string", "family string, start_ms long, output long", self.window + 2 * self.width)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        cutoff = timerValues.getCurrentProcessingTimeInMs() - self.window
        stale = cutoff - cutoff % self.width
        frame = pd.concat(list(rows), ignore_index=True).sort_values(["path", "position"], kind="stable")
        known: dict = {}  # what this batch has looked up or changed
        changed: set = set()
        added: dict = {}
        for r in frame.itertuples():
            if r.mark >= 0:  # the source begins anew with this file
                self.seen.clear()
                known, changed = dict.fromkeys(known), set()
                continue
            k = (r.request_id, r.message_id)
            if k not in known:
                known[k] = self.seen.getValue(k)
            old = known[k]
            if old is not None and old[1] >= stale:
                if r.output > old[2]:
                    known[k] = (old[0], old[1], int(r.output))
                    changed.add(k)
                    added.setdefault((old[1], old[0]), [0] * 4)[1] += int(r.output) - old[2]
                continue
            if pd.isna(r.ms) or r.ms < cutoff:  # too late on first sight, or without a time
                continue
            start = int(r.ms) - int(r.ms) % self.width
            known[k] = (r.family, start, int(r.output))
            changed.add(k)
            sums = added.setdefault((start, r.family), [0] * 4)
            for i, field in enumerate(tokens.FIELDS):
                sums[i] += int(getattr(r, field))
        for k in changed:
            self.seen.updateValue(k, known[k])
        yield pd.DataFrame([(*k, *v) for k, v in added.items()], columns=["start_ms", "family", *tokens.FIELDS])

    def close(self) -> None:
        pass


class _Buckets(StatefulProcessor):
    def __init__(self, width: int, window: int) -> None:
        self.width, self.window = width, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "input long, output long, cache_read long, cache_creation long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self.totals.exists():
            sums = list(self.totals.get())
        else:
            sums = [0] * 4
            self.handle.registerTimer(key[0] + self.window + self.width)  # by then the whole bucket is out of the window
        for frame in rows:
            for i, field in enumerate(tokens.FIELDS):
                sums[i] += int(frame[field].sum())
        self.totals.update(tuple(sums))
        yield pd.DataFrame([(*key, *sums)], columns=["start_ms", "family", *tokens.FIELDS])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.totals.clear()
        yield pd.DataFrame([], columns=["start_ms", "family", *tokens.FIELDS])

    def close(self) -> None:
        pass


class RollingHistory:
    """Tokens by bucket and family over the last window_ms, of lines that the tail source reads.

    folder: in the file system that driver and executors share; each run (see `reset`) has its checkpoint there.

    A request belongs to the bucket and family of its first record with a time within the window as of its batch; records
    of it that come later raise its output there, however late they are. Records without a time don't begin a request.
    Records of a batch come in the order of path and position. When a file begins anew (it was replaced or cut), the requests
    of all files are forgotten, so what it repeats counts again, while buckets stay.
    """

    def __init__(self, spark: SparkSession, folder: str, width_ms: int = 60_000, window_ms: int = 3_600_000, shards: int = SHARDS) -> None:
        self.spark, self.folder, self.shards = spark, folder, shards
        self.width, self.window = clamp_bucket(width_ms, window_ms)
        self.query: StreamingQuery | None = None
        self.frozen: int | None = None
        self.run = self._runs() - 1 if self._runs() else 0

    def _runs(self) -> int:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return len([s for s in fs.listStatus(path) if s.getPath().getName().startswith("run-")]) if fs.exists(path) else 0

    @property
    def checkpoint(self) -> str:
        return f"{self.folder}/run-{self.run}"

    def totals(self, lines: DataFrame) -> DataFrame:
        """The stream of (start_ms, family, the four counts): the new sums of the buckets that a batch changed. lines: (path, position,
        restarted, value) as the tail source has them."""
        every = F.sequence(F.lit(0), F.lit(self.shards - 1))
        none = F.array(F.lit(-1))
        marks = F.when(F.col("restarted") & (F.col("position") == 0), F.concat(every, none)).otherwise(none)
        marked = lines.select("path", F.col("position").alias("ord"), "value", F.explode(marks).alias("mark"))
        is_mark = F.col("mark") >= 0
        records = tokens.requests(parse_records(marked, keep=is_mark), ["path", "mark"], keep=is_mark)
        shard = F.when(is_mark, F.col("mark")).otherwise(F.pmod(F.xxhash64("request_id", "message_id"), F.lit(self.shards)).cast("int"))
        rows = records.select(
            shard.alias("shard"), "path", F.when(is_mark, F.lit(-1)).otherwise(F.col("ord")).alias("position"),
            "mark", "request_id", "message_id", "family", "ms", *tokens.FIELDS,
        )
        added = rows.groupBy("shard").transformWithStateInPandas(_Requests(self.width, self.window), _DELTA, "append", "processingTime")
        return added.groupBy("start_ms", "family").transformWithStateInPandas(_Buckets(self.width, self.window), _DELTA, "append", "processingTime")

    def start(self, lines: DataFrame, every_ms: int | None = 1_000, each=None, idle_batches: bool = True) -> StreamingQuery:
        """Begin, or go on from the checkpoint. each(rows, batch) gets changed buckets; see keyed.start for the rest."""
        self.query = keyed.start(self.totals(lines), self.checkpoint, each, every_ms, idle_batches)
        return self.query

    def pause(self) -> None:
        """From now on the view is that of the newest batch there is; the stream runs on. It can be read for as many more batches
        as the query keeps versions."""
        self.frozen = keyed.version(self.spark, self.checkpoint)

    def resume(self) -> None:
        self.frozen = None

    def reset(self) -> None:
        """Forget everything: the stream stops, and what is started next has a new checkpoint."""
        if self.query is not None:
            self.query.stop()
        self.query, self.frozen = None, None
        self.run += 1

    def buckets(self) -> DataFrame:
        """(start_ms, family, the four counts) of the view's batch."""
        return keyed.state_of(self.spark, self.checkpoint, "totals", self.frozen).select("key.*", "value.*")

    def window_rows(self, now_ms: int | None = None) -> DataFrame:
        """(start_ms, family, the four counts), oldest first: exactly window / width buckets (one at least), of which the last holds now_ms.
        A bucket without tokens is a row of zeros without family."""
        now_ms = int(time.time() * 1000) if now_ms is None else now_ms
        newest, count = now_ms - now_ms % self.width, max(self.window // self.width, 1)
        grid = self.spark.range(newest - self.width * (count - 1), newest + 1, self.width).withColumnRenamed("id", "start_ms")
        counts = [F.coalesce(f, F.lit(0)).alias(f) for f in tokens.FIELDS]
        return grid.join(self.buckets(), "start_ms", "left").select("start_ms", "family", *counts).orderBy("start_ms", "family")
