"""Where a session's log and status are: the first of several places that has them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.texts import slug
from ..operators.joins import first_of

STATUS = """session_id STRING, transcript_path STRING, model STRUCT<id STRING, display_name STRING>, cost STRUCT<total_cost_usd DOUBLE>,
context_window STRUCT<used_percentage DOUBLE, context_window_size BIGINT>, rate_limits STRUCT<five_hour STRUCT<used_percentage DOUBLE,
resets_at BIGINT>, seven_day STRUCT<used_percentage DOUBLE, resets_at BIGINT>>"""


def read_status(spark: SparkSession, path: str) -> DataFrame:
    """(key, status) of <key>.json files that parse; a key is a session's id or the slug of its folder."""
    text = spark.read.option("wholetext", "true").option("pathGlobFilter", "*.json").text(path).select("value", F.col("_metadata.file_name").alias("file"))
    parsed = text.select(F.regexp_replace("file", r"\.json$", "").alias("key"), F.from_json("value", STATUS + ", _bad STRING", {"columnNameOfCorruptRecord": "_bad"}).alias("status"))
    return parsed.filter(F.col("status._bad").isNull())


def with_status(sessions: DataFrame, status: DataFrame) -> DataFrame:
    """sessions (sessionId, cwd) with the status of their id, else of their folder, else null."""
    rows = sessions.withColumn("_slug", slug(F.col("cwd")))
    return first_of(rows, [(status, "sessionId"), (status, "_slug")], "status", "status").drop("_slug")


def locate_logs(sessions: DataFrame, logs: DataFrame) -> DataFrame:
    """sessions (sessionId, cwd, status) with log_path: the status's own path, else <slug>/<id>.jsonl, else any <id>.jsonl; of logs
    (path)."""
    part = F.split("path", "/")
    known = logs.select("path", F.regexp_replace(F.element_at(part, -1), r"\.jsonl$", "").alias("id"), F.element_at(part, -2).alias("dir"))
    by_place = known.groupBy(F.concat_ws("/", "dir", "id").alias("key")).agg(F.min("path").alias("path"))
    by_id = known.groupBy(F.col("id").alias("key")).agg(F.min("path").alias("path"))
    rows = sessions.withColumn("_place", F.concat_ws("/", slug(F.col("cwd")), "sessionId"))
    rows = first_of(rows, [(by_place, "_place"), (by_id, "sessionId")], "path", "_found").drop("_place")
    return rows.withColumn("log_path", F.coalesce("status.transcript_path", "_found")).drop("_found")


def rate_limits(sessions: DataFrame) -> DataFrame:
    """The limits of the newest session that has some, newest by updatedAt, then the smaller pid."""
    some = sessions.filter(F.col("status.rate_limits").isNotNull())
    return some.agg(F.max_by("status.rate_limits", F.struct("updatedAt", -F.col("pid"))).alias("rate_limits"))


def subagent_logs(logs: DataFrame) -> DataFrame:
    """Distinct paths of agent-*.jsonl by session: (sessionId, path). The folder <sessionId>/subagents goes before the one
    beside it: where it has any, the others don't count."""
    part = F.split("path", "/")
    own = logs.filter(F.element_at(part, -1).rlike(r"^agent-.*\.jsonl$"))
    inside = F.element_at(part, -2) == "subagents"
    session = F.when(inside, F.element_at(part, -3)).otherwise(F.element_at(part, -2))
    found = own.select(session.alias("sessionId"), "path", F.when(inside, 0).otherwise(1).alias("_place")).distinct()
    first = found.groupBy("sessionId").agg(F.min("_place").alias("_place"))
    return found.join(first, ["sessionId", "_place"], "left_semi").select("sessionId", "path").orderBy("sessionId", "path")
