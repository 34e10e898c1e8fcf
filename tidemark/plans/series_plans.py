"""Rates, series and buckets over events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import filters, rates, series
from ..operators.rates import First, Rounding, milliseconds
from ..sources.tables import table

DAY = 86_400_000
TYPES = ["purchase", "click", "view", "signup", "error"]
_ms = "(epoch_us(ts) // 1000)"


def _events(spark, sf):
    return table(spark, sf, "events")


def _counter(spark, sf):
    """events with a counter by user: whole values that add up, and start again at every 37th event."""
    w = Window.partitionBy("user_id").orderBy("ts")
    run = F.sum(F.floor(F.abs("value")).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return _events(spark, sf).select("event_id", "user_id", "ts", F.when(F.col("event_id") % 37 == 0, F.lit(0)).otherwise(run).cast("long").alias("counter"))


_C = """c AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 37 = 0 THEN 0 ELSE
  sum(floor(abs(value))::BIGINT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) END::BIGINT AS counter FROM events),
l AS (SELECT *, lag(counter) OVER w AS prev, ((epoch_us(ts) // 1000) - epoch_us(lag(ts) OVER w) // 1000) / 1000.0::DOUBLE AS sec, row_number() OVER w AS rn FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT *, CASE WHEN rn = 1 THEN NULL WHEN sec = 0 THEN 0.0 ELSE greatest(counter - prev, 0)::DOUBLE / sec END AS v,
  CASE WHEN rn = 1 THEN NULL WHEN floor(sec) = 0 THEN 0.0 ELSE greatest(counter - prev, 0)::DOUBLE / floor(sec) END AS vs FROM l)
"""


def _rate(expr=lambda c: c, **how):
    return lambda spark, sf: rates.counter_to_rate(_counter(spark, sf), ["user_id"], "ts", "counter", **how).select("event_id", expr(F.col("rate")).alias("rate"))


def _baseline(spark, sf):
    return rates.since_start(_counter(spark, sf), ["user_id"], "ts", "counter").select("event_id", "total")


def _high_water(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("n"))
    return rates.high_water_delta(rows, ["conv_id"], "turn", "n")


def _usage(spark, sf):
    rows = _counter(spark, sf).withColumn("system", F.col("event_id") * 100)
    return rates.usage_percent(rows, ["user_id"], "ts", "counter", "system", cores=4).select("event_id", F.round("usage", 6).alias("usage"))


def _gaps(spark, sf):
    """Events an hour of each user; an hour without any of theirs is a gap."""
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour")
    hours = _events(spark, sf).groupBy("user_id", hour).agg(F.count("*").alias("n"))
    return series.with_gaps(hours, hours.select("hour"), "user_id", "hour", "n").select("user_id", F.unix_millis("hour").alias("ms"), "n")


def _locf(spark, sf):
    rows = _events(spark, sf).withColumn("ts", milliseconds(F.col("ts")))
    return series.steps(rows, "user_id", "ts", "value", F.lit(2_000_000_000_000).cast("long"))


def _retention(spark, sf):
    """The operator's own bound is inclusive, as is the SQL's."""
    rows = _events(spark, sf)
    return filters.retained(rows, "ts", F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), 86_400).select("event_id")


def _fill(spark, sf):
    rows = series.bucket_totals(_events(spark, sf), milliseconds(F.col("ts")), 3_600_000, [], F.lit(1).cast("long"))
    return series.fill_between(rows, 3_600_000)


def _buckets(spark, sf):
    return series.bucket_totals(_events(spark, sf), milliseconds(F.col("ts")), DAY, ["event_type"], F.floor(F.abs("value")).cast("long"))


def _stacked(spark, sf):
    place = F.array_position(F.array(*map(F.lit, sorted(TYPES))), F.col("event_type")).cast("int")
    return series.stacked(_buckets(spark, sf).withColumn("ordinal", place), "start_ms", "ordinal", "total")


_B = f"SELECT {_ms} - {_ms} % {DAY} AS start_ms, event_type, sum(floor(abs(value))::BIGINT)::BIGINT AS total FROM events GROUP BY ALL"

PLANS = {
    "rate_null_first": (_rate(lambda c: F.round(c, 6)), f"WITH {_C} SELECT event_id, round(v, 6) AS rate FROM r"),
    "rate_zero_first": (_rate(lambda c: F.round(c, 6), first=First.ZERO), f"WITH {_C} SELECT event_id, round(coalesce(v, 0), 6) AS rate FROM r"),
    "rate_omit_first": (_rate(lambda c: F.round(c, 6), first=First.OMIT), f"WITH {_C} SELECT event_id, round(v, 6) AS rate FROM r WHERE rn > 1"),
    "rate_total_first": (_rate(lambda c: F.round(c, 6), first=First.TOTAL, first_seconds=2.0), f"WITH {_C} SELECT event_id, round(coalesce(v, counter / 2.0), 6) AS rate FROM r"),
    "rate_floor_secs": (_rate(lambda c: c.cast("long"), whole_seconds=True, rounding=Rounding.TRUNCATE), f"WITH {_C} SELECT event_id, floor(vs)::BIGINT AS rate FROM r"),
    "rate_round": (_rate(lambda c: c.cast("long"), rounding=Rounding.HALF_UP), f"WITH {_C} SELECT event_id, round(v)::BIGINT AS rate FROM r"),
    "rate_reset": (lambda spark, sf: _rate()(spark, sf).filter("rate = 0").select("event_id"), f"WITH {_C} SELECT event_id FROM r WHERE v = 0"),
    "baseline_total": (_baseline, f"WITH {_C}, b AS (SELECT user_id, arg_min(counter, ts) AS base FROM c GROUP BY user_id) SELECT event_id, greatest(counter - base, 0)::BIGINT AS total FROM c JOIN b USING (user_id)"),
    "usage_percent": (_usage, f"WITH {_C}, u AS (SELECT *, event_id * 100 - lag(event_id * 100) OVER (PARTITION BY user_id ORDER BY ts) AS ds FROM l) SELECT event_id, round(greatest(counter - prev, 0) / (CASE WHEN ds = 0 THEN 1.0 ELSE ds END)::DOUBLE * 100 / 4, 6) AS usage FROM u"),
    "high_water_delta": (_high_water, "SELECT conv_id, turn, length(text)::BIGINT AS n, greatest(length(text) - coalesce(max(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)::BIGINT AS delta FROM conversations"),
    "series_gaps": (_gaps, f"WITH d AS (SELECT user_id, {_ms} - {_ms} % 3600000 AS ms, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT DISTINCT ms FROM d), b AS (SELECT user_id, min(ms) AS born FROM d GROUP BY 1) "
        "SELECT b.user_id, t.ms, d.n FROM t JOIN b ON t.ms >= born LEFT JOIN d ON d.user_id = b.user_id AND d.ms = t.ms"),
    "locf_steps": (_locf, f"SELECT user_id, {_ms} AS start, coalesce(lead({_ms}) OVER (PARTITION BY user_id ORDER BY ts), 2000000000000)::BIGINT AS stop, value FROM events"),
    "window_max": (lambda spark, sf: series.visible_peak(_events(spark, sf), "ts", "value", 6 * 3_600_000), "SELECT greatest(coalesce(max(value), 0), 0) AS peak FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 6 HOURS"),
    "window_rows_by_key": (lambda spark, sf: filters.recent(_events(spark, sf), "ts", DAY, ["user_id"]).select("event_id"), "SELECT event_id FROM events JOIN (SELECT user_id, max(ts) AS newest FROM events GROUP BY 1) USING (user_id) WHERE ts >= newest - INTERVAL 1 DAY"),
    "retention": (_retention, "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 86400 SECONDS"),
    "has_data_in_window": (lambda spark, sf: series.has_data(_events(spark, sf).withColumn("value", F.when(F.col("event_id") % 4 != 0, F.col("value"))), "user_id", "ts", "value", F.lit("2024-01-29 00:00:00").cast("timestamp_ntz")), "SELECT user_id, coalesce(max(CASE WHEN event_id % 4 <> 0 THEN ts END) >= TIMESTAMP '2024-01-29', false) AS has_data FROM events GROUP BY 1"),
    "latest_per_key": (lambda spark, sf: series.latest(_events(spark, sf).withColumn("value", F.when(F.col("event_id") % 4 != 0, F.col("value"))), "user_id", "ts", "value"), "SELECT user_id, arg_max(value, ts) AS value FROM events WHERE event_id % 4 <> 0 GROUP BY 1"),
    "snapshot_overwrite": (lambda spark, sf: series.latest(_events(spark, sf).withColumn("value", F.when(F.col("event_id") % 4 != 0, F.col("value"))), "user_id", "ts", "value", keep_old=False), "SELECT user_id, arg_max_null(CASE WHEN event_id % 4 <> 0 THEN value END, ts) AS value FROM events GROUP BY 1"),
    "distinct_steps": (lambda spark, sf: series.distinct_steps(_events(spark, sf), "user_id", "ts", "event_type").select("event_id"), "SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events) WHERE b IS NULL OR b <> event_type"),
    "reverse_offset": (lambda spark, sf: series.reverse_offset(_events(spark, sf), "ts").select("event_id", "offset_ms"), f"SELECT event_id, {_ms} - (SELECT max({_ms}) FROM events) AS offset_ms FROM events"),
    "bucket_totals": (_buckets, _B),
    "bucket_gapfill_all": (_fill, f"WITH b AS (SELECT {_ms} - {_ms} % 3600000 AS start_ms, count(*)::BIGINT AS total FROM events GROUP BY 1), g AS (SELECT unnest(range(min(start_ms), max(start_ms) + 1, 3600000)) AS start_ms FROM b) SELECT start_ms, coalesce(total, 0) AS total FROM g LEFT JOIN b USING (start_ms)"),
    "bucket_peak": (lambda spark, sf: series.stacked_peak(_buckets(spark, sf), "start_ms", "total"), f"SELECT coalesce(max(s), 0)::BIGINT AS peak FROM (SELECT sum(total) AS s FROM ({_B}) GROUP BY start_ms)"),
    "clamp_to_top": (lambda spark, sf: series.clamped(_events(spark, sf).select("event_id", "value"), "value", F.lit(400.0)), "SELECT event_id, least(value, 400.0::DOUBLE) AS value FROM events"),
    "bucket_stacked": (_stacked, f"WITH b AS ({_B}), o AS (SELECT *, list_position({sorted(TYPES)}, event_type)::INTEGER AS ordinal FROM b) SELECT *, (sum(total) OVER (PARTITION BY start_ms ORDER BY ordinal ROWS UNBOUNDED PRECEDING))::BIGINT AS stacked FROM o"),
    "family_totals": (lambda spark, sf: filters.ordinal_filter(_events(spark, sf).withColumn("n", F.lit(1).cast("long")), "event_type", "n", ["view", "click"]), "SELECT event_type, count(*)::BIGINT AS n, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END::INTEGER AS ordinal FROM events GROUP BY 1"),
    "ever_reported": (lambda spark, sf: filters.ever_reported(_events(spark, sf).withColumn("v", F.col("value") - 490), "user_id", "v").select("event_id"), "SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM events WHERE value - 490 > 0)"),
}
