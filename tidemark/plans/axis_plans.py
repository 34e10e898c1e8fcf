"""Axes, widths, nested JSON and rates of hosts over the tables' rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import axes, widths
from ..operators import orders, session_views
from ..operators.rates import milliseconds
from ..sources import host, nested
from ..sources.tables import table

_ms = "(epoch_us(ts) // 1000)"
#: Peaks of many sizes: the dearest line of each supplier in cents, times a power of a thousand.
_PEAK = "p AS (SELECT l_suppkey, (max(round(l_extendedprice * 100)::BIGINT) * [1, 1000, 1000000, 1000000000][(l_suppkey % 4 + 1)::INTEGER]) // 100000 AS peak FROM lineitem GROUP BY l_suppkey)"


def _peaks(spark, sf):
    lines = table(spark, sf, "lineitem")
    times = F.element_at(F.array(*[F.lit(1000**k).cast("long") for k in range(4)]), (F.col("l_suppkey") % 4 + 1).cast("int"))
    peaks = lines.groupBy("l_suppkey").agg(F.max(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"))
    return peaks.select("l_suppkey", F.floor(F.expr("cents") * times / F.lit(100000)).cast("long").alias("peak"))


def _shown(spark, sf, **made):
    rows = _peaks(spark, sf).select("l_suppkey", *[a.alias(name) for name, a in made.items()])
    columns = []
    for name in made:
        columns += [F.round(F.col(f"{name}.top"), 6).alias(f"{name}_top"), F.array_join(F.col(f"{name}.labels"), "|").alias(f"{name}_labels")]
    return rows.select("l_suppkey", *columns)


def _right(text, width):
    return f"CASE WHEN length({text}) < {width} THEN lpad({text}, {width}, ' ') ELSE {text} END"


def _fixed(x, digits=1):
    return f"round_even({x}, {digits})::DECIMAL(20,{digits})::VARCHAR" if digits else f"round_even({x}, 0)::DECIMAL(20,0)::VARCHAR"


def _linear_sql(base, prefixes, unit, width):
    top = "CASE WHEN peak = 0 THEN 1.0::DOUBLE ELSE peak * 1.5::DOUBLE END"
    step = " + ".join(f"(({top}) >= {base}.0::DOUBLE ** {k})::INTEGER" for k in range(1, 5))
    scaled = f"(peak / ({base}.0::DOUBLE ** ({step})))"
    labels = [_right(f"('0' || {prefixes}[{step} + 1] || '{unit}')", width), *[_right(_fixed(f"{scaled} * {p}::DOUBLE"), width) for p in (0.5, 1.0, 1.5)]]
    return top, " || '|' || ".join(f"({x})" for x in labels)


def _log_sql(fn, per, prefixes, unit, zero):
    log = f"CASE WHEN peak > 0 THEN {fn}(peak::DOUBLE) ELSE 0 END"
    rung = f"CASE WHEN {log} < {2 * per} THEN 2 WHEN {log} < {3 * per} THEN 3 WHEN {log} < {4 * per} THEN 4 ELSE 5 END"
    labels = [zero, *[f"1{p}{unit}" for p in prefixes]]
    return f"({rung}) * {per}.0::DOUBLE", f"array_to_string({labels}[1:({rung}) + 1], '|')"


def _bytes(spark, sf):
    p = F.col("peak")
    return _shown(
        spark, sf, bits=axes.network(p), bytes=axes.network(p, binary=True, use_bytes=True), disk=axes.disk(p),
        bits_log=axes.network(p, log=True), bytes_log=axes.network(p, log=True, binary=True, use_bytes=True), disk_log=axes.disk(p, log=True),
    )


def _columns_sql(parts):
    return ", ".join(f"round(({top})::DOUBLE, 6) AS {name}_top, {labels} AS {name}_labels" for name, (top, labels) in parts.items())


_BYTES = f"WITH {_PEAK} SELECT l_suppkey, " + _columns_sql({
    "bits": _linear_sql(1000, ["", "K", "M", "G", "T"], "b", 5),
    "bytes": _linear_sql(1024, ["", "Ki", "Mi", "Gi", "Ti"], "B", 5),
    "disk": _linear_sql(1024, ["", "Ki", "Mi", "Gi", "Ti"], "B/s", 8),
    "bits_log": _log_sql("log10", 3, ["K", "M", "G", "T", "P"], "b", " 0b"),
    "bytes_log": _log_sql("log2", 10, ["Ki", "Mi", "Gi", "Ti", "Pi"], "B", "  0B"),
    "disk_log": _log_sql("log2", 10, ["Ki", "Mi", "Gi", "Ti", "Pi"], "B/s", "  0B/s"),
}) + " FROM p"


def _others(spark, sf):
    p = F.col("peak")
    return _shown(
        spark, sf, heat=axes.temperature(p % 300), cold=axes.temperature(p % 300, "fahrenheit"), limit=axes.temperature(p % 300, limit=80), power=axes.power(p % 1000),
        rate=axes.token_rate(p, log=False), rate_log=axes.token_rate(p), count=axes.token_count(p), count_log=axes.token_count(p, log=True),
    )


def _abbreviated_sql(x, suffix, billions):
    steps = ([(10**9, "B")] if billions else []) + [(10**6, "M"), (10**3, "k")]
    return "CASE " + " ".join(f"WHEN ({x}) >= {n} THEN {_fixed(f'({x}) / {n}.0::DOUBLE')} || '{c}{suffix}'" for n, c in steps) + f" ELSE {_fixed(x, 0)} || '{suffix}' END"


def _degrees_sql(least, unit):
    top = f"greatest((peak % 300)::DOUBLE, {least}::DOUBLE)"
    return top, f"'0{unit}|' || ceil({top} / 2)::BIGINT || '{unit}|' || ceil({top})::BIGINT || '{unit}'"


def _tokens_sql(slack, floor, suffix, billions, log):
    flat = f"CASE WHEN peak <= 0 THEN 1.0::DOUBLE ELSE peak * {slack}::DOUBLE END"
    top = f"greatest(CASE WHEN peak > 0 THEN log2(peak::DOUBLE) ELSE 0 END * 1.1::DOUBLE, {floor}::DOUBLE)" if log else flat
    at = (lambda p: f"(2.0::DOUBLE ** (({top}) * {p}::DOUBLE))") if log else (lambda p: f"(({top}) * {p}::DOUBLE)")
    texts = [f"'0{suffix}'", *[f"({_abbreviated_sql(at(p), suffix, billions)})" for p in (0.5, 1.0)]]
    return top, " || '|' || ".join(f"({_right(x, 9)})" for x in texts)


_WATTS = "CASE WHEN peak % 1000 = 0 THEN 1.0::DOUBLE ELSE (peak % 1000) * 1.25::DOUBLE END"
_OTHERS = f"WITH {_PEAK} SELECT l_suppkey, " + _columns_sql({
    "heat": _degrees_sql(100, "°C"),
    "cold": _degrees_sql(212, "°F"),
    "limit": ("80", "'0°C|40°C|80°C'"),
    "power": (_WATTS, " || '|' || ".join("(" + _right("(" + _fixed(f"({_WATTS}) * {p}::DOUBLE") + " || 'W')", 7) + ")" for p in ("0.0", "0.5", "1.0"))),
    "rate": _tokens_sql(1.25, 4, "/s", False, False),
    "rate_log": _tokens_sql(1.25, 4, "/s", False, True),
    "count": _tokens_sql(1.1, 10, "", True, False),
    "count_log": _tokens_sql(1.1, 10, "", True, True),
}) + " FROM p"


def _widths(spark, sf):
    """Text, and some of its letters as their wide forms, with a mark that takes no column."""
    d = table(spark, sf, "documents")
    wide = F.translate(F.substring("text", 1, 60), "aeiou", "ａｅｉｏｕ")
    marked = F.replace(wide, F.lit("t"), F.lit("t́"))
    return d.select("doc_id", widths.width(marked).alias("columns"), widths.cut(F.regexp_replace(wide, r"[^ -~ａ-ｚ]", "x"), 20).alias("cut"))


_WIDTHS = """WITH d AS (SELECT doc_id, translate(substr(text, 1, 60), 'aeiou', 'ａｅｉｏｕ') AS w FROM documents),
c AS (SELECT doc_id, w, regexp_replace(w, '[^ -~ａ-ｚ]', 'x', 'g') AS x FROM d),
s AS (SELECT *, [length(x[i]) + (x[i] >= 'ａ')::INTEGER FOR i IN range(1, length(x) + 1)] AS sizes FROM c)
SELECT doc_id, (length(w) + length(regexp_replace(w, '[^ａ-ｚ]', '', 'g')))::INTEGER AS columns,
       CASE WHEN coalesce(list_sum(sizes), 0) <= 20 THEN x
            ELSE array_to_string([x[i] FOR i IN range(1, length(x) + 1) IF list_sum(sizes[1:i]) <= 19], '') || '…' END AS cut FROM s"""


def _disk_json(spark, sf):
    p = table(spark, sf, "part")
    entry = F.struct(F.concat(F.lit("/dev/"), "p_name").alias("name"), F.concat(F.lit("/m/"), "p_brand").alias("mounted-on"), F.col("p_size").alias("total-blocks"), (F.col("p_size") / 2).cast("int").alias("used-blocks"))
    one = F.struct(F.struct(F.array(entry, entry).alias("filesystem")).alias("storage-system-information"))
    text = F.when(F.col("p_partkey") % 4 == 0, F.substring(F.to_json(one), 1, 30)).otherwise(F.to_json(one))  # some are damaged
    return nested.disk_usage(p.select("p_partkey", text.alias("text")))


_DISK_JSON = """SELECT p_partkey, '/dev/' || p_name AS name, '/m/' || p_brand AS mount_point, (p_size // 2)::BIGINT * 1024 AS used, NULL::BIGINT AS free, p_size::BIGINT * 1024 AS total
FROM part, range(2) WHERE p_partkey % 4 <> 0"""


def _interfaces(spark, sf):
    """Counters of two interfaces of each user's machine: what its events add up to."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(F.floor(F.abs("value")).cast("long")).over(w)
    e = table(spark, sf, "events").select(F.col("user_id").alias("host"), "ts", total.alias("n")).withColumn("name", F.explode(F.array(F.lit("eth0"), F.lit("lo"))))
    return e.select("host", "ts", "name", F.col("n").alias("rx_bytes"), (F.col("n") * 2).alias("tx_bytes"), F.col("n").alias("rx_packets"), (F.col("n") * 3).alias("tx_packets"))


def _network_rates(spark, sf):
    totals = host.network_totals(_interfaces(spark, sf), {"items": ["lo"], "deny": True, "whole_word": True})
    return host.network_rates(totals).select("host", milliseconds(F.col("ts")).alias("ms"), "rx_bits", "rx", "tx", "rx_packet_rate", "tx_packet_rate")


_NETWORK_RATES = f"""WITH e AS (SELECT user_id AS host, {_ms} AS ms, sum(floor(abs(value))::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM events),
l AS (SELECT *, lag(n) OVER w AS before, (ms - lag(ms) OVER w) / 1000.0::DOUBLE AS sec FROM e WINDOW w AS (PARTITION BY host ORDER BY ms))
SELECT host, ms, (n * 8)::BIGINT AS rx_bits, {", ".join(f"floor(CASE WHEN before IS NULL THEN (n * {k})::DOUBLE WHEN sec = 0 THEN 0 ELSE ((n - before) * {k})::DOUBLE / sec END)::BIGINT AS {c}" for c, k in (("rx", 8), ("tx", 16), ("rx_packet_rate", 1), ("tx_packet_rate", 3)))} FROM l"""

def _process_table(spark, sf):
    c = table(spark, sf, "customer")
    name = F.when(F.col("c_custkey") % 2 == 0, F.upper("c_mktsegment")).otherwise(F.lower("c_mktsegment"))
    return c.select(
        F.col("c_custkey").alias("pid"), name.alias("name"), F.when(F.col("c_nationkey") > 4, F.concat(F.lit("u"), F.col("c_nationkey").cast("string"))).alias("user"),
        F.col("c_acctbal").alias("cpu_percent"), F.when(F.col("c_acctbal") > 0, F.floor("c_acctbal").cast("long")).alias("mem_bytes"), F.col("c_acctbal").alias("mem_percent"), F.col("c_nationkey").alias("nice"),
    )


#: (column, direction, or None for the one it has at first)
_SORTED = [("cpu_percent", None), ("mem_percent", None), ("mem_percent", False), ("name", None), ("name", True), ("user", None), ("user", True), ("nice", None), ("pid", True)]


def _sort_rules(spark, sf):
    rows = _process_table(spark, sf)
    out = None
    for column, descending in _SORTED:
        made = orders.PROCESSES.numbered(rows, column, descending).select(F.lit(f"{column} {descending}").alias("sorted"), "position", "pid")
        out = made if out is None else out.unionByName(made)
    return out


def _sort_sql(column, descending):
    key = {"cpu_percent": "c_acctbal", "mem_percent": "CASE WHEN c_acctbal > 0 THEN floor(c_acctbal)::BIGINT END", "name": "lower(c_mktsegment)",
           "user": "CASE WHEN c_nationkey > 4 THEN 'u' || c_nationkey END", "nice": "c_nationkey", "pid": "c_custkey"}[column]
    down = column in ("cpu_percent", "mem_percent") if descending is None else descending
    return f"SELECT '{column} {descending}' AS sorted, row_number() OVER (ORDER BY {key} {'DESC NULLS LAST' if down else 'ASC NULLS FIRST'}, c_custkey) AS position, c_custkey AS pid FROM customer"


def _sessions(spark, sf):
    """A session for each customer that may be the owner of a conversation; every other one has a status."""
    from . import log_plans

    payload = "struct<model:struct<id:string>,cost:struct<total_cost_usd:double>,context_window:struct<used_percentage:double>>"
    info = F.struct(F.struct(F.concat(F.lit("x-opus-"), F.col("c_custkey").cast("string"))), F.struct(F.col("c_custkey") / 4.0), F.struct(F.col("c_custkey") % 100 + 0.0))
    sessions = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("sessionId"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("name"), F.concat(F.lit("/home/"), "c_mktsegment", F.lit("/")).alias("cwd"),
        F.lit(None).cast("string").alias("status"), F.concat(F.lit("main:0.%"), F.col("c_nationkey").cast("string")).alias("tmux"), F.when(F.col("c_custkey") % 2 == 0, info.cast(payload)).alias("info"),
    )
    records = log_plans.parse_records(log_plans._lines(spark, sf)).withColumn("session", F.col("session").cast("string"))
    return session_views.session_cells(session_views.session_rows(sessions, records))


def _sessions_sql():
    from . import log_plans

    total = "coalesce(o.total, 0)"
    return f"""WITH {log_plans._R}, q AS (SELECT session, m, arg_min(side, ord) AS side, max(output) AS output FROM r GROUP BY session, m),
o AS (SELECT session, (115 * count(*) + sum(output))::BIGINT AS total, count_if(side) AS agents FROM q GROUP BY 1)
SELECT c_custkey::VARCHAR AS session, CASE WHEN c_custkey % 3 <> 0 THEN c_name ELSE c_custkey::VARCHAR END AS name, c_mktsegment AS directory,
       CASE WHEN c_custkey % 2 = 0 THEN 'Opus' ELSE 'N/A' END AS model, '' AS status, {_abbreviated_sql(total, '', False)} AS tokens,
       CASE WHEN c_custkey % 2 = 0 THEN '$' || round_even(c_custkey / 4.0::DOUBLE, 2)::DECIMAL(20,2) ELSE 'N/A' END AS cost,
       CASE WHEN c_custkey % 2 = 0 THEN (c_custkey % 100) || '%' ELSE 'N/A' END AS context, coalesce(o.agents, 0)::VARCHAR AS agents
FROM customer LEFT JOIN o ON o.session = c_custkey"""


def _batteries(spark, sf):
    """A battery for each part: some tell energy, some charge and voltage, some nothing but their capacity."""
    k, n = F.col("p_partkey"), lambda c: F.col(c).cast("string")
    states = F.element_at(F.array(*map(F.lit, ("Charging", "Discharging", "Full", "odd"))), (k % 4 + 1).cast("int"))
    energy = F.concat(F.lit("ENERGY_NOW="), n("p_size"), F.lit("000000\nPOWER_SUPPLY_ENERGY_FULL=60000000\nPOWER_SUPPLY_ENERGY_FULL_DESIGN=80000000\nPOWER_SUPPLY_POWER_NOW=12000000"))
    charge = F.concat(F.lit("CHARGE_NOW="), n("p_size"), F.lit("0000\nPOWER_SUPPLY_CHARGE_FULL=1000000\nPOWER_SUPPLY_VOLTAGE_NOW=12000000\nPOWER_SUPPLY_CURRENT_NOW=-500000"))
    rest = F.when(k % 3 == 0, energy).when(k % 3 == 1, charge).otherwise(F.concat(F.lit("CAPACITY="), n("p_size")))
    kind = F.when(F.col("p_size") == 7, "Mains").otherwise("Battery")
    text = F.concat(F.lit("POWER_SUPPLY_TYPE="), kind, F.lit("\nPOWER_SUPPLY_STATUS="), states, F.lit("\nPOWER_SUPPLY_"), rest, F.lit("\nbroken\n"))
    made = host.battery_rows(table(spark, sf, "part").select("p_partkey", text.alias("text")))
    return made.select("p_partkey", F.round("charge_percent", 6).alias("charge_percent"), "watts", F.round("health_percent", 6).alias("health_percent"), "state", "seconds")


_BATTERIES = """WITH b AS (SELECT p_partkey, p_partkey % 3 AS kind, p_partkey % 4 AS s, p_size,
  CASE p_partkey % 3 WHEN 0 THEN p_size * 1e6::DOUBLE WHEN 1 THEN p_size * 10000 * 12.0::DOUBLE END AS n, CASE p_partkey % 3 WHEN 0 THEN 6e7::DOUBLE WHEN 1 THEN 12e6::DOUBLE END AS f,
  CASE p_partkey % 3 WHEN 0 THEN 12e6::DOUBLE WHEN 1 THEN 6e6::DOUBLE END AS r FROM part WHERE p_size <> 7)
SELECT p_partkey, round(coalesce(n / f * 100, p_size::DOUBLE), 6) AS charge_percent, r / 1e6 AS watts, CASE WHEN kind = 0 THEN 75.0::DOUBLE END AS health_percent,
['Charging', 'Discharging', 'Full', 'Unknown'][s + 1] AS state, floor(CASE s WHEN 0 THEN greatest(f - n, 0) WHEN 1 THEN n END / r * 3600)::INTEGER AS seconds FROM b"""


def _all_disks(spark, sf):
    """Suppliers' disks are mounted, and parts are the block devices."""
    s = table(spark, sf, "supplier")
    mounted = s.select(F.concat(F.lit("/dev/mapper/d"), F.col("s_suppkey").cast("string")).alias("name"), F.concat(F.lit("/"), "s_name").alias("mount_point"), F.col("s_suppkey").alias("used"), F.col("s_nationkey").cast("long").alias("free"), F.lit(1000).cast("long").alias("total"))
    devices = table(spark, sf, "part").select(F.concat(F.when(F.col("p_size") > 40, "loop").otherwise("d"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_size").cast("long").alias("bytes"))
    return host.all_disks(mounted, devices)


_ALL_DISKS = """SELECT '/dev/mapper/d' || s_suppkey AS name, '/' || s_name AS mount_point, s_suppkey::BIGINT AS used, s_nationkey::BIGINT AS free, 1000::BIGINT AS total FROM supplier
UNION ALL SELECT '/dev/d' || p_partkey, '', NULL, NULL, p_size FROM part WHERE p_size <= 40 AND p_partkey NOT IN (SELECT s_suppkey FROM supplier)"""

PLANS = {
    "sort_rules": (_sort_rules, " UNION ALL ".join(_sort_sql(*x) for x in _SORTED)),
    "session_cells": (_sessions, _sessions_sql()),
    "battery_rows": (_batteries, _BATTERIES),
    "all_disks": (_all_disks, _ALL_DISKS),
    "axis_bytes": (_bytes, _BYTES),
    "axis_others": (_others, _OTHERS),
    "display_widths": (_widths, _WIDTHS),
    "disk_json": (_disk_json, _DISK_JSON),
    "network_rates": (_network_rates, _NETWORK_RATES),
}
