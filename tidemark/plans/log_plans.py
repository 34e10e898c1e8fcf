"""Event-log accounting over conversations, read as if each turn were a record, and streaming twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tokens
from ..sources.logs import parse_records
from ..sources.tables import table
from ..streaming import pipelines

BASE = 1_787_601_600_000


def _lines(spark, sf):
    """A JSON line for each turn of every conversation: a request is three turns, and outputs are text lengths."""
    t = table(spark, sf, "conversations")
    family = F.element_at(F.array(*map(F.lit, ("x-opus-1", "x-haiku-2", "other"))), (F.col("conv_id") % 3 + 1).cast("int"))
    stamp = F.date_format(F.timestamp_millis(F.lit(BASE) + (F.col("conv_id") * 7919 + F.col("turn") * 61) * 1000 % 7_200_000), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    usage = F.struct(F.lit(10).alias("input_tokens"), F.length("text").alias("output_tokens"), F.lit(100).alias("cache_read_input_tokens"), F.lit(5).alias("cache_creation_input_tokens"))
    message = F.struct(F.concat(F.lit("m"), F.floor(F.col("turn") / 3)).alias("id"), family.alias("model"), usage.alias("usage"))
    record = F.to_json(F.struct(F.lit("assistant").alias("type"), (F.col("turn") % 4 == 1).alias("isSidechain"), F.concat(F.lit("r"), F.col("conv_id")).alias("requestId"), stamp.alias("timestamp"), message.alias("message")))
    return t.select(F.col("conv_id").alias("session"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), record.alias("value"))


_R = f"""r AS (SELECT conv_id AS session, conv_id * 1000 + turn AS ord, turn // 3 AS m, CASE conv_id % 3 WHEN 0 THEN 'Opus' WHEN 1 THEN 'Haiku' ELSE 'Other' END AS family,
 turn % 4 = 1 AS side, length(text) AS output, {BASE} + (conv_id * 7919 + turn * 61) * 1000 % 7200000 AS ms FROM conversations)"""


def _once(spark, sf):
    return tokens.once(tokens.requests(parse_records(_lines(spark, sf)), ["session"]), ["session"])


def _totals(spark, sf):
    return tokens.totals(_once(spark, sf), ["family"])


def _history(spark, sf):
    return tokens.history(parse_records(_lines(spark, sf)), BASE + 7_200_000)


PLANS = {
    "dedupe_highwater_all": (lambda spark, sf: _once(spark, sf).select("session", "message_id", "family", "ms", "sidechain", "input", "output"), f"WITH {_R} SELECT session, 'm' || m AS message_id, arg_min(family, ord) AS family, arg_min(ms, ord) AS ms, arg_min(side, ord) AS sidechain, 10::BIGINT AS input, max(output)::BIGINT AS output FROM r GROUP BY session, m"),
    "token_totals_all": (_totals, f"WITH {_R}, o AS (SELECT arg_min(family, ord) AS family, arg_min(side, ord) AS side, max(output) AS output FROM r GROUP BY session, m) SELECT family, (10 * count(*))::BIGINT AS input, sum(output)::BIGINT AS output, (100 * count(*))::BIGINT AS cache_read, (5 * count(*))::BIGINT AS cache_creation, count_if(NOT side)::BIGINT AS main_messages, count_if(side)::BIGINT AS sidechain_messages FROM o GROUP BY 1"),
    "token_history_all": (_history, f"WITH {_R}, d AS (SELECT session, m, min(ord) AS born FROM r WHERE ms >= {BASE} + 3660000 GROUP BY ALL), o AS (SELECT arg_min(family, ord) AS family, arg_min(ms, ord) AS ms, max(output) AS output FROM r JOIN d USING (session, m) WHERE ord >= born GROUP BY session, m) SELECT ms - ms % 60000 AS start_ms, family, (10 * count(*))::BIGINT AS input, sum(output)::BIGINT AS output, (100 * count(*))::BIGINT AS cache_read, (5 * count(*))::BIGINT AS cache_creation FROM o GROUP BY ALL"),
    "stream_buckets": (pipelines.event_buckets, "SELECT (epoch_us(ts) // 1000) - (epoch_us(ts) // 1000) % 86400000 AS start_ms, event_type, count(*) AS n FROM events GROUP BY ALL"),
    "stream_rates": (pipelines.event_rates, "SELECT event_id, round(v, 6) AS rate FROM (SELECT event_id, CASE WHEN row_number() OVER w = 1 THEN NULL WHEN (epoch_us(ts) // 1000) = (epoch_us(lag(ts) OVER w) // 1000) THEN 0 ELSE greatest(value - lag(value) OVER w, 0) / (((epoch_us(ts) // 1000) - epoch_us(lag(ts) OVER w) // 1000) / 1000.0::DOUBLE) END AS v FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))"),
    "stream_dedupe": (pipelines.event_high_water, "SELECT user_id, event_type, arg_min((epoch_us(ts) // 1000) - (epoch_us(ts) // 1000) % 86400000, event_id) AS start_ms, max(floor(abs(value))::BIGINT) AS output FROM events GROUP BY 1, 2"),
}
