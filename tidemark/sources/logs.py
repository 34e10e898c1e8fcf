"""Event logs as JSON lines, registries and status files. Parsing is permissive: bad lines are skipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = """type STRING, subtype STRING, durationMs BIGINT, requestId STRING, sessionId STRING, isSidechain BOOLEAN,
isApiErrorMessage BOOLEAN, timestamp STRING, message STRUCT<id STRING, model STRING, usage STRUCT<input_tokens BIGINT,
output_tokens BIGINT, cache_read_input_tokens BIGINT, cache_creation_input_tokens BIGINT>>"""
SESSION = "pid INT, sessionId STRING, cwd STRING, name STRING, status STRING, startedAt BIGINT, updatedAt BIGINT"


def parse_records(lines: DataFrame, column: str = "value", keep: Column | None = None) -> DataFrame:
    """lines with the record's fields; lines that aren't a record of these types, or with a negative count, are dropped, but for
    those of which `keep` holds."""
    schema = RECORD + ", _corrupt STRING"
    parsed = lines.withColumn("_r", F.from_json(column, schema, {"columnNameOfCorruptRecord": "_corrupt"}))
    usage = [F.coalesce(F.col(f"_r.message.usage.{f}"), F.lit(0)) >= 0 for f in ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")]
    good = F.col("_r").isNotNull() & F.col("_r._corrupt").isNull() & usage[0] & usage[1] & usage[2] & usage[3]
    good = good & (F.trim(column) != "")
    return parsed.filter(good if keep is None else F.coalesce(good, F.lit(False)) | keep).select(*[c for c in lines.columns if c != column], "_r.*").drop("_corrupt")


def read_logs(spark: SparkSession, path: str, modified_after: str | None = None) -> DataFrame:
    """Records of all *.jsonl under path, with ord = (path, place in the file). Files not modified since are pruned."""
    reader = spark.read.option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", "true")
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    lines = reader.text(path).select("value", F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("ord"))
    return parse_records(lines)


def read_registry(spark: SparkSession, path: str, live_pids: DataFrame | None = None) -> DataFrame:
    """Sessions of <pid>.json files, newest first, equal ones by pid; only those of live pids if these are given."""
    rows = spark.read.schema(SESSION).option("pathGlobFilter", "*.json").option("multiLine", "true").option("mode", "PERMISSIVE").json(path)
    rows = rows.filter(F.col("pid").isNotNull() & F.col("sessionId").isNotNull())
    if live_pids is not None:
        rows = rows.join(live_pids, "pid", "left_semi")
    return rows.orderBy(F.desc_nulls_last("updatedAt"), "pid")


def flatten_sessions(rows: DataFrame) -> DataFrame:
    return rows.withColumn("name", F.coalesce("name", "sessionId")).withColumn("cwd", F.coalesce("cwd", F.lit(""))).withColumn("status", F.coalesce("status", F.lit("")))
