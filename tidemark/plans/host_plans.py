"""Samples of a host made of the tables' rows - kernel text is written out and parsed again - and the views of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import durations, parsers, texts, units
from ..operators import filters, hierarchy, host_views, joins, tokens, views
from ..options import resolve
from ..sources import host
from ..sources.tables import table
from . import log_plans
from .view_plans import _TREE, _tree_rows

_ms = "(epoch_us(ts) // 1000)"


def _s(*parts):
    return F.concat(*[p if not isinstance(p, (str, int)) else F.lit(str(p)) for p in (F.col(x[1:]).cast("string") if isinstance(x, str) and x.startswith("$") else x for x in parts)])


def _stat(spark, sf):
    o = table(spark, sf, "orders").withColumn("flags", F.when(F.col("o_orderkey") % 3 == 0, 0x200000).otherwise(64)).withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
    line = _s("$o_orderkey", " (", "$o_orderpriority", ") x) ", "$o_orderstatus", " ", "$o_custkey", " 1 0 0 0 ", "$flags", " 0 0 0 0 ", "$cents", " 8 0 0 20 5 1 0 ", "$o_orderkey", " 1000 ", "$cents", " 0 0")
    return o.select(parsers.stat_fields(line).alias("s")).select("s.*")


_STAT = """SELECT o_orderkey::INTEGER AS pid, o_orderpriority || ') x' AS comm, o_orderstatus AS state, o_custkey::INTEGER AS ppid, o_orderkey % 3 = 0 AS is_kernel, round(o_totalprice * 100)::BIGINT AS utime,
8::BIGINT AS stime, 20 AS priority, 5 AS nice, o_orderkey AS start_time, 1000::BIGINT AS vsize, round(o_totalprice * 100)::BIGINT AS rss FROM orders"""


def _io(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", parsers.io_fields(_s("rchar: 1\nread_bytes: ", "$o_custkey", "\nwrite_bytes: ", "$o_orderkey", "\n")).alias("s")).select("o_orderkey", "s.*")


def _cpu(spark, sf):
    line = _s("cpu  ", "$l_orderkey", " 0 ", "$l_partkey", " 100 ", "$l_suppkey", " 1 2 3")
    text = F.concat(line, F.lit("\n"), F.regexp_replace(line, "^cpu  ", "cpu0 "), F.lit("\nintr 5 6\n"))
    ts = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ts")
    return host.cpu_rows(table(spark, sf, "lineitem").select(ts, text.alias("text")))


def _arc(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", parsers.arc_size(_s("name type data\nc_min 4 ", "$p_size", "\nsize 4 ", "$p_partkey", "\nc_max 4 9\n")).alias("s")).select("p_partkey", "s.*")


def _mounts(spark, sf):
    p = table(spark, sf, "part")
    line = _s("/dev/", "$p_partkey", " /mnt/", F.replace("p_name", F.lit(" "), F.lit("\\040")), " ext4 rw 0 0")
    return p.select("p_partkey", parsers.mount_fields(line).alias("s")).select("p_partkey", "s.*")


def _diskstats(spark, sf):
    p = table(spark, sf, "part")
    return p.select(parsers.disk_counters(_s("   8  0 sd", "$p_partkey", " 1 2 ", "$p_size", " 4 5 6 ", "$p_partkey", " 8")).alias("s")).select("s.*")


def _unmounted(spark, sf):
    name = F.when(F.col("p_partkey") % 5 == 0, _s("loop", "$p_partkey")).otherwise(_s("sd", "$p_partkey"))
    parts = table(spark, sf, "part").select(parsers.partition_fields(F.concat(F.lit(" 8 1 "), F.col("p_size").cast("string"), F.lit(" "), name)).alias("s")).select("s.*")
    used = table(spark, sf, "lineitem").filter("l_quantity = 7").select(_s("sd", "$l_partkey").alias("name"))
    return host.unmounted(parts, used).select("name", "mount_point", "total")


def _meminfo(spark, sf):
    p = table(spark, sf, "part").withColumn("free", F.col("p_size") * 10)
    text = _s("MemTotal: 9000 kB\nMemFree: ", "$free", " kB\nMemAvailable: ", (F.col("free") * 2).cast("string"), " kB\nSwapTotal: 100 kB\nSwapFree: ", "$p_size", " kB\n")
    groups = table(spark, sf, "part").filter("p_partkey % 4 = 0").select(F.col("p_partkey").alias("ts"), F.col("p_partkey").alias("ram_used"), F.lit(4_000_000).cast("long").alias("ram_limit"), F.lit(None).cast("long").alias("swap_used"), F.lit(10**12).alias("swap_limit"))
    return host.memory_rows(p.select(F.col("p_partkey").alias("ts"), text.alias("text")), groups, show_cache=True).select("ts", "kind", "used", "total", F.round("percent", 6).alias("percent"))


_MEM = """WITH m AS (SELECT p_partkey AS ts, p_size::BIGINT AS s, p_partkey % 4 = 0 AS g FROM part),
k AS (SELECT ts, 'RAM' AS kind, CASE WHEN g THEN ts ELSE (9000 - 20 * s) * 1024 END AS used, CASE WHEN g THEN 4000000 ELSE 9216000 END::BIGINT AS total FROM m
UNION ALL SELECT ts, 'SWP', (100 - s) * 1024, 102400 FROM m UNION ALL SELECT ts, 'CACHE', 10 * s * 1024, 9216000 FROM m)
SELECT ts, kind, used, total, round(used / total::DOUBLE * 100, 6) AS percent FROM k"""


def _cgroup(spark, sf):
    p, n = table(spark, sf, "part"), F.lit(None).cast("long")
    first = lambda c: F.when(F.col("p_partkey") % 3 == 0, c)
    size = F.col("p_size").cast("long")
    rows = p.select(
        F.col("p_partkey").alias("ts"), first(size * 100).alias("v1_usage"), first(F.lit(2500).cast("long")).alias("v1_limit"), first(size * size).alias("v1_inactive"), first(size * 150).alias("v1_memsw_usage"),
        first(F.lit(9000).cast("long")).alias("v1_memsw_limit"), (size * 7).alias("v2_current"), F.when(size > 20, "max").otherwise("5000").alias("v2_max"), size.alias("v2_inactive"), n.alias("v2_swap_current"), F.lit("max").alias("v2_swap_max"),
        F.lit(3000).cast("long").alias("total_memory"), F.lit(4000).cast("long").alias("total_swap"),
    )
    return host.cgroup_memory(rows)


_CGROUP = """SELECT p_partkey AS ts, CASE WHEN v1 THEN CASE WHEN s * s < s * 100 THEN s * 100 - s * s ELSE s * 100 END ELSE s * 6 END AS ram_used,
CASE WHEN v1 THEN 2500 WHEN s > 20 THEN NULL ELSE 5000 END::BIGINT AS ram_limit, CASE WHEN v1 THEN s * 50 END AS swap_used, CASE WHEN v1 THEN 4500 END::BIGINT AS swap_limit
FROM (SELECT p_partkey, p_size::BIGINT AS s, p_partkey % 3 = 0 AS v1 FROM part)"""


def _network(spark, sf):
    l = table(spark, sf, "lineitem")  # noqa: E741
    line = _s("  ", F.lower("l_returnflag"), "th0: ", "$l_orderkey", " ", "$l_linenumber", " 0 0 0 0 0 0 ", "$l_partkey", " 7 0 0")
    rows = l.select(F.col("l_shipdate").alias("ts"), parsers.interface_counters(line).alias("s")).select("ts", "s.*")
    return host.network_totals(rows, {"items": ["^r"], "regex": True}).withColumn("ts", F.unix_millis(F.col("ts").cast("timestamp")))


_NET = """SELECT epoch_us(l_shipdate) // 1000 AS ts, coalesce(sum(CASE WHEN l_returnflag <> 'R' THEN l_orderkey * 8 END), 0)::BIGINT AS rx_bits, coalesce(sum(CASE WHEN l_returnflag <> 'R' THEN l_partkey * 8 END), 0)::BIGINT AS tx_bits,
coalesce(sum(CASE WHEN l_returnflag <> 'R' THEN l_linenumber END), 0)::BIGINT AS rx_packets, coalesce(sum(CASE WHEN l_returnflag <> 'R' THEN 7 END), 0)::BIGINT AS tx_packets FROM lineitem GROUP BY 1"""


def _sensors(spark, sf):
    p = table(spark, sf, "part")
    chip = p.select(
        F.lit("h0").alias("dir"), F.col("p_partkey").alias("ord"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")).alias("chip"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).alias("label"), F.col("p_type").alias("fallback"), F.col("p_size").cast("double").alias("celsius"),
    )
    core = chip.withColumn("dir", F.when(F.col("ord") % 2 == 0, "h0").otherwise("c0")).filter("ord % 50 = 1")
    zones = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("ord"), F.col("n_name").alias("type"), F.lit(1.0).alias("celsius"))
    return host.temperatures(chip, core, zones, ({"items": ["Brand#1"], "deny": False}, {"items": ["widget"], "deny": False}), "kelvin")


_SENSORS = """WITH p AS (SELECT 0 AS f, p_partkey AS o, CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS chip, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS label, p_type AS fb, p_size AS c FROM part),
a AS (FROM p UNION ALL SELECT 1, o, chip, label, fb, c FROM p WHERE o % 50 = 1),
n AS (SELECT f, o, c, coalesce(chip, fb) || coalesce(': ' || upper(label[1]) || label[2:], '') AS name FROM a),
k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY f, o) - 1 AS i FROM n),
l AS (SELECT CASE WHEN i = 0 THEN name ELSE name || ' (' || i || ')' END AS name, ceil(c::FLOAT + 273.15::FLOAT)::INTEGER AS value FROM k)
SELECT * FROM l WHERE name ILIKE '%Brand#1%' OR name ILIKE '%widget%'"""


def _gpu(spark, sf):
    l = table(spark, sf, "lineitem")  # noqa: E741
    text = _s("pos: 0\ndrm-driver: x\ndrm-client-id:\t", "$l_linenumber", "\ndrm-memory-vram:\t", "$l_partkey", " KiB\ndrm-engine-gfx:\t", "$l_suppkey", " ns\ndrm-engine-enc_1:\t5 ns\ndrm-engine-compute:\t9 ns\n")
    rows = l.select(F.lit(0).alias("ts"), F.lit("d").alias("device"), F.col("l_orderkey").alias("pid"), F.struct("l_partkey", "l_suppkey").alias("fd"), text.alias("text"))
    return host.gpu_clients(rows).select("pid", "busy_ns", "vram_bytes")


_GPU = """WITH c AS (SELECT l_orderkey AS pid, l_linenumber, min((l_partkey, l_suppkey)) AS m FROM lineitem GROUP BY ALL)
SELECT pid, sum(m[2] + 5)::BIGINT AS busy_ns, sum(m[1] * 1024)::BIGINT AS vram_bytes FROM c GROUP BY pid"""


def _samples(spark, sf):
    """Events as samples of processes, a user being one."""
    e = table(spark, sf, "events")
    return e.select(
        "ts", F.col("event_id").alias("id"), F.col("user_id").cast("int").alias("pid"), F.lit(1).alias("ppid"), F.col("event_type").alias("name"), F.concat(F.lit("/bin/"), "event_type").alias("command"), (F.col("user_id") % 30).cast("int").alias("uid"),
        F.lit("D").alias("state"), F.when(F.col("user_id") % 5 == 0, "Kernel").otherwise("Regular").alias("process_type"), F.col("value").alias("cpu_percent"), F.floor("value").cast("long").alias("mem_bytes"), F.lit(2000).cast("long").alias("mem_total"),
        (F.col("event_id") * 1_000_000).alias("read_bytes"), F.lit(5).cast("long").alias("write_bytes"), F.col("event_id").alias("start_ticks"), F.lit(100).cast("long").alias("uptime"),
    )


def _processes(spark, sf):
    users = table(spark, sf, "nation").select(F.col("n_nationkey").cast("int").alias("uid"), F.col("n_name").alias("name"))
    rows = host_views.process_rows(_samples(spark, sf), resolve({"hide_kernel_threads": True, "process_command": True}), users)
    return rows.select("id", "pid", "shown", "user", "state_name", "read_rate", "write_rate", F.round("mem", 6).alias("mem"), "seconds")


_PROC = f"""WITH e AS (SELECT *, floor(({_ms} - lag({_ms}) OVER w) / 1000.0::DOUBLE) AS sec, event_id * 1000000 - lag(event_id * 1000000) OVER w AS rise FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))
SELECT event_id AS id, user_id::INTEGER AS pid, '/bin/' || event_type AS shown, n_name AS "user", 'UninterruptibleDiskSleep' AS state_name,
CASE WHEN sec > 0 THEN floor(greatest(rise, 0) / sec)::BIGINT ELSE 0 END::BIGINT AS read_rate, 0::BIGINT AS write_rate, round(floor(value)::BIGINT / 2000.0::DOUBLE * 100, 6) AS mem, greatest(100 - event_id // 100, 0)::BIGINT AS seconds
FROM e LEFT JOIN nation ON n_nationkey = user_id % 30 WHERE user_id % 5 <> 0"""


def _cells(spark, sf):
    options = resolve({"mem_as_value": True})
    rows = host_views.process_rows(_samples(spark, sf), options).withColumn("pid", F.col("id"))
    return host_views.process_cells(rows, options, width=4).select("pid", "name", "state", "user", "mem", "time")


_CELLS = """SELECT event_id::VARCHAR AS pid, event_type AS name, 'D' AS state, 'N/A' AS "user", CASE WHEN v >= 1024 THEN round_even(v / 1024.0::DOUBLE, 0)::BIGINT || 'KiB' ELSE v || 'B' END AS mem,
CASE WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || '.00s' ELSE s || '.000s' END AS time FROM (SELECT *, floor(value)::BIGINT AS v, greatest(100 - event_id // 100, 0) AS s FROM events)"""


def _disks(spark, sf):
    e = table(spark, sf, "events")
    disks = e.select("ts", F.col("event_id").alias("id"), F.concat(F.lit("/dev/sd"), F.col("user_id").cast("string")).alias("name"), F.when(F.col("user_id") % 7 == 0, "").otherwise("/m").alias("mount_point"),
                     F.when(F.col("event_id") % 3 != 0, F.floor(F.abs("value"))).cast("long").alias("used"), (F.col("event_id") % 100).alias("free"), F.lit(1).cast("long").alias("total"))
    counters = e.filter("user_id % 4 <> 0").select("ts", F.concat(F.lit("sd"), F.col("user_id").cast("string")).alias("device"), (F.col("event_id") * 1000).alias("read_bytes"), F.lit(3).cast("long").alias("write_bytes"))
    rows = host_views.disk_rows(disks, counters, resolve())
    return rows.select("id", "device", "summed_total", "read_rate", "write_rate", F.round("used_percent", 6).alias("used_percent"))


_DISKS = f"""WITH e AS (SELECT *, ({_ms} - lag({_ms}) OVER w) / 1000.0::DOUBLE AS sec, event_id * 1000 - lag(event_id * 1000) OVER w AS rise, CASE WHEN event_id % 3 <> 0 THEN floor(abs(value))::BIGINT END AS used, event_id % 100 AS free
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)) SELECT event_id AS id, 'sd' || user_id AS device, used + free AS summed_total, CASE WHEN user_id % 4 = 0 THEN NULL WHEN sec > 0 THEN round(greatest(rise, 0) / sec)::BIGINT ELSE 0 END::BIGINT AS read_rate,
CASE WHEN user_id % 4 <> 0 THEN 0 END::BIGINT AS write_rate, CASE WHEN used + free > 0 THEN round(used / (used + free)::DOUBLE * 100, 6) END AS used_percent FROM e WHERE user_id % 7 <> 0"""


def _legend(spark, sf):
    data = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.expr("max(c_acctbal) > 9000").alias("has_data"))
    mounts = table(spark, sf, "nation").filter("n_regionkey > 0").select(F.col("n_nationkey").alias("k"), F.when(F.col("n_regionkey") > 1, F.col("n_name")).otherwise("").alias("mount_point"))
    return filters.legend_series(data, mounts, "k", by_mount=True)


def _help(spark, sf):
    lines = table(spark, sf, "conversations").select(F.col("conv_id").alias("section"), F.col("turn").alias("line"), "text")
    return filters.sections_with(lines, " THE ").select("section", "line", "matches")


def _glyphs(spark, sf):
    rows = _tree_rows(spark, sf)
    placed = hierarchy.depth_first(hierarchy.closure(rows, "id", "parent"), rows, "id", "cents", descending=True)
    return hierarchy.prefix(placed).select("node", "prefix")


_GLYPHS = f"""WITH RECURSIVE {_TREE}, k AS (SELECT id, row_number() OVER (PARTITION BY parent ORDER BY cents, id DESC) = 1 AS last FROM t), p AS (SELECT node, unnest(path) AS a, unnest(range(len(path))) AS place FROM c)
SELECT node, coalesce(string_agg(CASE WHEN a = node THEN CASE WHEN last THEN '└─ ' ELSE '├─ ' END WHEN last THEN '   ' ELSE '│  ' END, '' ORDER BY place) FILTER (WHERE place > 0), '') AS prefix FROM p JOIN k ON k.id = p.a GROUP BY node"""


def _duration(spark, sf):
    t = table(spark, sf, "conversations")
    rows = t.select(F.col("conv_id").alias("session"), F.col("turn").alias("ord"), F.lit("system").alias("type"), F.when(F.col("turn") % 2 == 0, "turn_duration").otherwise("other").alias("subtype"), F.length("text").cast("long").alias("durationMs"))
    return tokens.last_duration(rows, ["session"])


def _formatted(spark, sf):
    v = F.floor(F.col("l_extendedprice") * F.col("l_quantity")).cast("long")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", units.format_bytes(v).alias("size"), units.abbreviate(v).alias("count"), units.fixed_rate(F.col("l_partkey")).alias("rate"))


_FORMATTED = """WITH l AS (SELECT *, floor(l_extendedprice * l_quantity)::BIGINT AS v FROM lineitem) SELECT l_orderkey, l_linenumber,
CASE WHEN v >= 1000000000 THEN round_even(v / 1e9, 1)::DECIMAL(20,1) || 'GB' WHEN v >= 1000000 THEN round_even(v / 1e6, 0)::BIGINT || 'MB' WHEN v >= 1000 THEN round_even(v / 1e3, 0)::BIGINT || 'KB' ELSE v || 'B' END AS size,
CASE WHEN v >= 1000000 THEN round_even(v / 1e6, 1)::DECIMAL(20,1) || 'M' WHEN v >= 1000 THEN round_even(v / 1e3, 1)::DECIMAL(20,1) || 'k' ELSE v::VARCHAR END AS count,
lpad(CASE WHEN l_partkey >= 1048576 THEN round_even(l_partkey / 1048576.0::DOUBLE, 1)::DECIMAL(20,1) || 'MiB' WHEN l_partkey >= 1024 THEN round_even(l_partkey / 1024.0::DOUBLE, 1)::DECIMAL(20,1) || 'KiB'
ELSE l_partkey || '.0B' END || '/s', 11, ' ') AS rate FROM l"""


def _scalars(spark, sf):
    p = table(spark, sf, "part")
    return p.select(
        "p_partkey", texts.unescape_mount(F.replace("p_name", F.lit(" "), F.lit("\\040"))).alias("mount"), texts.pane(F.concat(F.lit("a:1."), F.col("p_size").cast("string"))).alias("pane"),
        units.temperature(F.col("p_size"), "fahrenheit").alias("fahrenheit"), F.round(units.cpu_quota(F.concat(F.col("p_size").cast("string"), F.lit(" 7"))), 6).alias("quota"), durations.battery_time(F.col("p_partkey") * 13).alias("short"), durations.battery_time_long(F.col("p_partkey") * 13).alias("long"),
        texts.binary_name(F.concat(F.lit("/a -b/"), "p_name", F.lit(" -c"))).alias("binary"), texts.equal_ignoring_case(F.upper("p_name"), F.col("p_name")).alias("same"), texts.padded(F.col("p_brand"), 12, right=True).alias("padded"),
        durations.running_seconds(F.lit(10), F.col("p_partkey")).alias("running"), parsers.is_physical(F.when(F.col("p_size") > 25, "NILFS").otherwise("tmpfs")).alias("physical"),
    )


_SCALARS = """WITH p AS (SELECT *, p_partkey * 13 AS t, p_partkey * 13 // 3600 AS h, p_partkey * 13 // 60 % 60 AS m, p_partkey * 13 % 60 AS s FROM part)
SELECT p_partkey, p_name AS mount, p_size::VARCHAR AS pane, ceil(p_size::FLOAT * 1.8::FLOAT + 32)::INTEGER AS fahrenheit, round(CASE WHEN p_size > 0 THEN p_size / 7.0::DOUBLE END, 6) AS quota,
CASE WHEN h > 0 THEN h || 'h ' ELSE '' END || m || 'm ' || s || 's' AS short,
CASE WHEN h > 0 THEN h || ' hour' || CASE WHEN h = 1 THEN '' ELSE 's' END || ', ' ELSE '' END || m || ' minute' || CASE WHEN m = 1 THEN '' ELSE 's' END || ', ' || s || ' second' || CASE WHEN s = 1 THEN '' ELSE 's' END AS "long",
p_name AS "binary", true AS same, CASE WHEN length(p_brand) < 12 THEN lpad(p_brand, 12, ' ') ELSE p_brand END AS padded, greatest(10 - p_partkey // 100, 0)::BIGINT AS running, p_size > 25 AS physical FROM p"""


def _patched_ci(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.concat("p_name", F.col("p_partkey").cast("string")).alias("k"), F.col("p_size").alias("v"))
    patches = rows.filter("p_partkey % 5 = 0").select(F.upper("k").alias("k"), F.lit(-1).alias("v"))
    return joins.patch_ignoring_case(rows, patches, "k", "v").select("p_partkey", "v")


_O = log_plans._R + ", o AS (SELECT session, m, arg_min(family, ord) AS family, arg_min(side, ord) AS side, max(output) AS output FROM r GROUP BY session, m)"
_SUMS = "(10 * count(*))::BIGINT AS input, sum(output)::BIGINT AS output, (100 * count(*))::BIGINT AS cache_read, (5 * count(*))::BIGINT AS cache_creation, count_if(NOT side)::BIGINT AS main_messages, count_if(side)::BIGINT AS sidechain_messages"

PLANS = {
    "proc_stat": (_stat, _STAT),
    "proc_io": (_io, "SELECT o_orderkey, o_custkey AS read_bytes, o_orderkey AS write_bytes FROM orders"),
    "cpu_times": (_cpu, "WITH l AS (SELECT l_orderkey * 10 + l_linenumber AS ts, (100 + l_suppkey)::DOUBLE AS idle, (l_orderkey + l_partkey + 6)::DOUBLE AS non_idle FROM lineitem) SELECT ts, c AS core, idle, non_idle FROM l, (SELECT unnest([-1, 0]) AS c)"),
    "arc_stats": (_arc, "SELECT p_partkey, p_partkey AS size, 9::BIGINT AS c_max, p_size::BIGINT AS c_min FROM part"),
    "mount_table": (_mounts, "SELECT p_partkey, '/dev/' || p_partkey AS device, '/mnt/' || p_name AS mount_point, 'ext4' AS fs_type FROM part"),
    "disk_counters": (_diskstats, "SELECT 'sd' || p_partkey AS name, p_size::BIGINT * 512 AS read_bytes, p_partkey * 512 AS write_bytes FROM part"),
    "unmounted_disks": (_unmounted, "SELECT '/dev/sd' || p_partkey AS name, '' AS mount_point, p_size::BIGINT * 1024 AS total FROM part WHERE p_partkey % 5 <> 0 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 7)"),
    "memory_rows": (_meminfo, _MEM),
    "cgroup_memory": (_cgroup, _CGROUP),
    "network_totals": (_network, _NET),
    "sensor_names": (_sensors, _SENSORS),
    "gpu_clients": (_gpu, _GPU),
    "process_view": (_processes, _PROC),
    "process_cells": (_cells, _CELLS),
    "disk_view": (_disks, _DISKS),
    "legend_by_mount": (_legend, "SELECT c_nationkey AS k, max(c_acctbal) > 9000 AS has_data, any_value(n_name) AS mount_point FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey > 1 GROUP BY 1 HAVING max(c_acctbal) > 9000"),
    "help_search": (_help, "WITH m AS (SELECT conv_id AS section, turn AS line, contains(lower(text), 'the') AS matches FROM conversations WHERE conv_id > 0) SELECT * FROM m WHERE (matches OR line = 0) AND section IN (SELECT section FROM m WHERE matches)"),
    "cpu_series_choice": (lambda spark, sf: filters.chosen_series(table(spark, sf, "nation").select("n_nationkey", (F.col("n_regionkey") - 1).alias("core")), "core", 2, True), "SELECT n_nationkey, n_regionkey - 1 AS core FROM nation WHERE n_regionkey = 1"),
    "tree_prefix": (_glyphs, _GLYPHS),
    "last_duration": (_duration, "SELECT conv_id AS session, arg_max(length(text), turn)::BIGINT AS duration_ms FROM conversations WHERE turn % 2 = 0 GROUP BY 1"),
    "format_sizes": (_formatted, _FORMATTED),
    "scalar_texts": (_scalars, _SCALARS),
    "patch_ignoring_case": (_patched_ci, "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN -1 ELSE p_size END AS v FROM part"),
    "token_family_order": (lambda spark, sf: tokens.by_family(log_plans._once(spark, sf)), f"WITH {_O} SELECT family, {_SUMS}, CASE family WHEN 'Opus' THEN 1 WHEN 'Haiku' THEN 3 ELSE 5 END AS ordinal FROM o GROUP BY 1"),
    "token_sessions": (lambda spark, sf: tokens.by_session(log_plans._once(spark, sf)), f"WITH {_O} SELECT session, {_SUMS}, (115 * count(*) + sum(output))::BIGINT AS total FROM o GROUP BY 1"),
    "token_grand_total": (lambda spark, sf: tokens.grand_total(log_plans._once(spark, sf)), f"WITH {_O} SELECT {_SUMS} FROM o"),
    "sort_processes": (lambda spark, sf: views.sorted_processes(table(spark, sf, "part").select(F.col("p_partkey").alias("pid"), F.initcap("p_name").alias("name")), "name", True), "SELECT p_partkey AS pid, list_reduce(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || x[2:]), lambda a, b: a || ' ' || b) AS name FROM part"),
    "group_members_or_self": (lambda spark, sf: joins.members_or_self(table(spark, sf, "nation").select("n_nationkey"), joins.children(table(spark, sf, "customer"), "c_custkey", "c_nationkey").select(F.col("c_nationkey").alias("n_nationkey"), F.col("children").cast("array<int>").alias("ids")), "n_nationkey").select("n_nationkey", F.array_join("ids", ",").alias("ids")), "SELECT n_nationkey, coalesce((SELECT array_to_string(list_sort(list(c_custkey)), ',') FROM customer WHERE c_nationkey = n_nationkey), n_nationkey::VARCHAR) AS ids FROM nation"),
}
