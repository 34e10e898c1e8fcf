"""Streams over files of events. Each runs to the end of what is there (availableNow), and writes its rows to a table in
the folder that executors share; a second run from the same checkpoint adds nothing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stored import shared_dir
from . import keyed

DAY = 86_400_000


def source(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """A stream of a table's files; timestamps without zone become instants, which watermarks need."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}.parquet*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows


def run(stream: DataFrame, mode: str = "append", at: str | None = None) -> DataFrame:
    """The rows of a stream that is run to the end of its input. In update mode the last row of each key has to be taken
    by the caller, from `batch`."""
    spark = stream.sparkSession
    at = at or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(df: DataFrame, batch: int) -> None:  # a batch that is done again replaces itself
        df.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{at}/rows/b={batch}")

    if mode == "append":
        query = keyed.start(stream, f"{at}/checkpoint", write)
    else:
        query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    schema = stream.schema.add("batch", "long")
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{at}/rows")


def event_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events a day and type."""
    rows = source(spark, sf_dir).withWatermark("ts", "30 days")
    counted = rows.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    flat = counted.select(F.unix_millis("w.start").alias("start_ms"), "event_type", "n")
    out = run(flat, "update")
    return out.groupBy("start_ms", "event_type").agg(F.max_by("n", "batch").alias("n"))


#: A key that was silent for so long (by the clock, not by its samples) is forgotten.
IDLE_MS = 6 * 3_600_000


def event_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rise a second of value by user, 0 for a fall, null for a user's first sample. State is two numbers a user."""
    rows = source(spark, sf_dir).select("event_id", "user_id", F.unix_millis("ts").alias("ms"), "value")
    out = run(keyed.rates(rows, "user_id", ["event_id"], "ms", "value", idle_ms=IDLE_MS))
    return out.select("event_id", F.round("rate", 6).alias("rate"))


def event_high_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a (user, type): the day of its first event and its highest value."""
    rows = source(spark, sf_dir)
    day = F.unix_millis("ts") - F.pmod(F.unix_millis("ts"), F.lit(DAY))
    rows = rows.select("user_id", "event_type", F.col("event_id").alias("ord"), day.alias("start_ms"), F.floor(F.abs("value")).cast("long").alias("output"))
    out = run(keyed.high_water(rows, ["user_id", "event_type"], IDLE_MS))
    return out.groupBy("user_id", "event_type").agg(F.max_by("start_ms", "batch").alias("start_ms"), F.max_by("output", "batch").alias("output"))
