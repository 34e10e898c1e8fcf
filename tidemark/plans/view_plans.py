"""Grouped, sorted and paged views, hierarchies, joins, unions and scalar functions over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import durations, texts, units
from ..operators import filters, hierarchy, joins, views
from ..sources.tables import table


def _t(name):
    return lambda spark, sf: table(spark, sf, name)


def flagship(spark, sf):
    """Events found by a search, grouped by type, the largest sum first."""
    from ..search import compile_query
    from .search_plans import EVENTS

    rows = table(spark, sf, "events").filter(compile_query("value > 100 and (error or purchase)", EVENTS)).withColumn("value", F.col("value").cast("decimal(18,4)"))
    made = views.group_rows(rows, "event_type", "event_id", ["value"], ["ts"], ["user_id"])
    return made.select("event_type", "event_id", "num_similar", F.col("value").cast("double").alias("value"), F.unix_millis(F.col("ts").cast("timestamp")).alias("last_ms"), "user_id").orderBy(F.desc("value"), "event_type").limit(10)


FLAGSHIP_SQL = """SELECT event_type, min(event_id) AS event_id, count(*) AS num_similar, sum(value::DECIMAL(18,4))::DOUBLE AS value, epoch_us(max(ts)) // 1000 AS last_ms, arg_min(user_id, event_id) AS user_id
FROM events WHERE value > 100 AND (event_type ILIKE '%error%' OR event_type ILIKE '%purchase%') GROUP BY 1 ORDER BY value DESC, event_type LIMIT 10"""


def _by_part(spark, sf):
    """Order and line repeat in lineitem; of rows that share them the first in the files counts, as in the SQL on one thread."""
    rows = table(spark, sf, "lineitem").withColumn("row", F.col("l_orderkey") * 10 + F.col("l_linenumber")).withColumn("cents", F.round(F.col("l_extendedprice") * 100).cast("long"))
    in_files = [F.col("_metadata.file_name"), F.col("_metadata.row_index")]
    return views.group_rows(rows, "l_partkey", "row", ["cents"], ["l_quantity"], ["l_returnflag"], in_files)


def _tree_rows(spark, sf):
    """Regions, nations, suppliers and customers as one forest of text keys."""
    r = table(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("cents"))
    n = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), F.lit(0).cast("long"))
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    s = table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("n"), "s_nationkey"), cents("s_acctbal"))
    c = table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"), cents("c_acctbal"))
    return r.union(n).union(s).union(c)


_TREE = """t AS (SELECT 'r' || r_regionkey AS id, NULL::VARCHAR AS parent, 0::BIGINT AS cents FROM region
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 0 FROM nation
UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, round(s_acctbal * 100)::BIGINT FROM supplier
UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, round(c_acctbal * 100)::BIGINT FROM customer),
c(root, node, parent, depth, path) AS (SELECT id, id, parent, 0, [id] FROM t WHERE parent IS NULL
UNION ALL SELECT c.root, t.id, t.parent, c.depth + 1, list_append(c.path, t.id) FROM c JOIN t ON t.parent = c.node)"""


def _closure(spark, sf):
    return hierarchy.closure(_tree_rows(spark, sf), "id", "parent").select("root", "node", "depth")


def _shown(spark, sf):
    rows = _tree_rows(spark, sf)
    return hierarchy.shown(hierarchy.closure(rows, "id", "parent"), rows.filter("cents > 900000 or id = 'n3'"), "id").select("node", "disabled")


def _rollup(spark, sf):
    rows = _tree_rows(spark, sf)
    return hierarchy.rollup(hierarchy.closure(rows, "id", "parent"), rows.select("id", "cents"), "id", ["cents"])


def _order(spark, sf):
    rows = _tree_rows(spark, sf)
    return hierarchy.depth_first(hierarchy.closure(rows, "id", "parent"), rows, "id", "cents", descending=True).select("node", F.col("position").cast("long").alias("position"))


def _labels_or(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    a = table(spark, sf, "labels").filter("quality = 1").select("doc_id", F.lit("label").alias("v"))
    b = docs.select("source").distinct().filter("source <> 'src0'").select("source", F.col("source").alias("v"))
    return joins.first_of(docs, [(a, "doc_id"), (b, "source")], "v", "found").select("doc_id", "found")


def _patched(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return joins.patch(rows, rows.filter("c_custkey % 5 = 0").withColumn("c_acctbal", F.lit(0.0)), "c_custkey", "c_acctbal")


def _summed(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), F.lit(1).cast("long").alias("n"))
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("n_nationkey"), F.lit(1).cast("long").alias("n"))
    return joins.summed_dimension(table(spark, sf, "nation").select("n_nationkey", "n_name"), [s, c], "n_nationkey", "n")


def _sorted(spark, sf):
    """All orders with their places in the order; the operator numbers ranges, so no task sees all rows."""
    rows = table(spark, sf, "orders").select("o_orderkey", F.lower("o_orderpriority").alias("p"))
    return views.ordinals(rows, [F.col("p").desc_nulls_last(), F.col("o_orderkey").asc()])


def _orphans(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")).alias("p"))
    return joins.orphans(rows, "k", "p")


def _sized(spark, sf):
    v = F.floor(F.col("l_extendedprice") * F.col("l_quantity") * F.col("l_quantity")).cast("long")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", v.alias("v"))


def _scaled(spark, sf):
    s = units.scale(F.col("v"), binary=True)
    return _sized(spark, sf).select("l_orderkey", "l_linenumber", F.floor(s["value"]).cast("long").alias("whole"), s["unit"].alias("unit"))


def _durations(spark, sf):
    return table(spark, sf, "documents").select("doc_id", durations.format_duration(F.col("n_chars") * 977).alias("text"))


_D = """SELECT doc_id, CASE WHEN s >= 86400 THEN (s // 86400) || 'd ' || (s // 3600 % 24) || 'h ' || (s // 60 % 60) || 'm'
WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s // 60 % 60) || 'm ' || (s % 60) || 's'
WHEN s >= 60 THEN (s // 60) || 'm ' || (ms % 60000 // 10 // 100) || '.' || lpad((ms % 60000 // 10 % 100)::VARCHAR, 2, '0') || 's'
ELSE s || '.' || lpad((ms % 1000)::VARCHAR, 3, '0') || 's' END AS text FROM (SELECT doc_id, n_chars * 977 AS ms, n_chars * 977 // 1000 AS s FROM documents)"""


def _iso(spark, sf):
    t = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    text = F.when(F.col("event_id") % 5 == 0, F.concat(t, F.lit("+02:00"))).otherwise(F.concat(t, F.lit("Z")))
    return table(spark, sf, "events").select("event_id", durations.iso_to_ms(text).alias("ms"))


def _basename(spark, sf):
    return table(spark, sf, "pages").select("page_id", texts.last_part(F.col("url")).alias("base"))


def _json(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k BIGINT")["k"].alias("k"))


def _pivot(spark, sf):
    return views.key_value_counts(table(spark, sf, "events"), ["user_id"], "event_type", ["click", "view", "purchase"])


def _conditional(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").alias("n_assistant"), F.count_if(F.col("role") != "assistant").alias("n_other"), F.max_by(F.length("text").cast("long"), "turn").alias("last_length"))


PLANS = {
    "flagship": (flagship, FLAGSHIP_SQL),
    "group_by_id": (_by_part, "SELECT l_partkey, min(l_orderkey * 10 + l_linenumber) AS row, count(*) AS num_similar, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS cents, max(l_quantity) AS l_quantity, arg_min(l_returnflag, l_orderkey * 10 + l_linenumber) AS l_returnflag FROM lineitem GROUP BY 1"),
    "group_ids": (lambda spark, sf: views.group_members(table(spark, sf, "orders"), "o_custkey", "o_orderkey").select("o_custkey", F.array_join("ids", ",").alias("ids")), "SELECT o_custkey, array_to_string(list_sort(list(o_orderkey)), ',') AS ids FROM orders GROUP BY 1"),
    "cond_counts": (_conditional, "SELECT conv_id, count_if(role = 'assistant')::BIGINT AS n_assistant, count_if(role <> 'assistant')::BIGINT AS n_other, arg_max(length(text), turn)::BIGINT AS last_length FROM conversations GROUP BY 1"),
    "key_value_pivot": (_pivot, "SELECT user_id, count_if(event_type = 'click')::BIGINT AS click, count_if(event_type = 'view')::BIGINT AS view, count_if(event_type = 'purchase')::BIGINT AS purchase FROM events GROUP BY 1"),
    "unpivot_long": (lambda spark, sf: views.unpivot(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax"), ["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"]), "SELECT l_orderkey, l_linenumber, 'l_discount' AS channel, l_discount AS watts FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem"),
    "sort_all": (_sorted, "SELECT o_orderkey, lower(o_orderpriority) AS p, row_number() OVER (ORDER BY lower(o_orderpriority) DESC, o_orderkey) AS position FROM orders"),
    "page_slice": (lambda spark, sf: views.page(views.sorted_rows(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), F.col("o_totalprice"), True, "o_orderkey"), 40, 20), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40"),
    "column_choice": (lambda spark, sf: views.choose_columns(table(spark, sf, "nation"), ["NAME", "n_regionkey"], {"name": "n_name"}), "SELECT n_name, n_regionkey FROM nation"),
    "column_widths": (lambda spark, sf: views.column_widths(table(spark, sf, "part"), ["p_name", "p_brand"]), "SELECT max(length(p_name))::INTEGER AS p_name, max(length(p_brand))::INTEGER AS p_brand FROM part"),
    "total_row": (lambda spark, sf: views.with_total_row(table(spark, sf, "nation").select("n_name", F.col("n_regionkey").cast("double").alias("v")), "All", "n_name", "v"), "SELECT 'All' AS n_name, avg(n_regionkey)::DOUBLE AS v, 0 AS ordinal FROM nation UNION ALL SELECT n_name, n_regionkey::DOUBLE, 1 FROM nation"),
    "tree_closure": (_closure, f"WITH RECURSIVE {_TREE} SELECT root, node, depth FROM c"),
    "tree_keep_rule": (_shown, f"WITH RECURSIVE {_TREE}, k AS (SELECT id FROM t WHERE cents > 900000 OR id = 'n3'), v AS (SELECT unnest(path) AS node FROM c WHERE node IN (SELECT id FROM k) UNION SELECT node FROM (SELECT node, unnest(path) AS a FROM c) WHERE a IN (SELECT id FROM k)) SELECT node, node NOT IN (SELECT id FROM k) AS disabled FROM v"),
    "tree_rollup": (_rollup, f"WITH RECURSIVE {_TREE}, p AS (SELECT node, unnest(path) AS ancestor FROM c) SELECT ancestor, sum(cents)::BIGINT AS cents FROM p JOIN t ON t.id = p.node GROUP BY 1"),
    "tree_path_order": (_order, f"WITH RECURSIVE {_TREE}, k AS (SELECT id, row_number() OVER (PARTITION BY parent ORDER BY cents DESC, id) AS rank FROM t), p AS (SELECT node, unnest(path) AS a, unnest(range(len(path))) AS place FROM c), q AS (SELECT node, list(rank ORDER BY place) AS ranks FROM p JOIN k ON k.id = p.a GROUP BY 1) SELECT node, row_number() OVER (ORDER BY ranks) AS position FROM q"),
    "join_left_dim": (lambda spark, sf: joins.with_dimension(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), ["doc_id"]), "SELECT doc_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)"),
    "join_semi_live": (lambda spark, sf: joins.live(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), table(spark, sf, "orders").filter("o_orderstatus = 'O'"), ["o_custkey"]), "SELECT c_custkey AS o_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')"),
    "join_anti_orphan": (_orphans, "WITH t AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS p FROM orders) SELECT k, p FROM t WHERE p IS NULL OR NOT EXISTS (SELECT 1 FROM t u WHERE u.k = t.p)"),
    "join_children": (lambda spark, sf: joins.children(table(spark, sf, "nation"), "n_nationkey", "n_regionkey").select("n_regionkey", F.array_join("children", ",").alias("children")), "SELECT n_regionkey, array_to_string(list_sort(list(n_nationkey)), ',') AS children FROM nation GROUP BY 1"),
    "join_fallback_coalesce": (_labels_or, "SELECT doc_id, coalesce(CASE WHEN quality = 1 THEN 'label' END, nullif(source, 'src0')) AS found FROM documents LEFT JOIN labels USING (doc_id)"),
    "join_ci_update": (_patched, "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer"),
    "join_summed_all": (_summed, "SELECT n_nationkey, n_name, ((SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) + (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey))::BIGINT AS n FROM nation"),
    "union_all_tagged": (lambda spark, sf: joins.tagged_union({"s": table(spark, sf, "supplier").select(F.col("s_name").alias("name")), "c": table(spark, sf, "customer").select(F.col("c_name").alias("name"))}), "SELECT s_name AS name, 's' AS origin FROM supplier UNION ALL SELECT c_name, 'c' FROM customer"),
    "union_distinct": (lambda spark, sf: joins.distinct_union([table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")), table(spark, sf, "customer").select("c_nationkey")]), "SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer"),
    "dup_name_counter": (lambda spark, sf: filters.numbered(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", "p_partkey").select("p_partkey", "label"), "SELECT p_partkey, CASE WHEN n = 0 THEN p_name ELSE p_name || ' (' || n || ')' END AS label FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS n FROM part)"),
    "unit_scale": (_scaled, "WITH v AS (SELECT l_orderkey, l_linenumber, floor(l_extendedprice * l_quantity * l_quantity)::BIGINT AS v FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN v >= 1024**3 THEN v // (1024**3)::BIGINT WHEN v >= 1024**2 THEN v // (1024**2)::BIGINT WHEN v >= 1024 THEN v // 1024 ELSE v END AS whole, CASE WHEN v >= 1024**3 THEN 'GiB' WHEN v >= 1024**2 THEN 'MiB' WHEN v >= 1024 THEN 'KiB' ELSE 'B' END AS unit FROM v"),
    "fmt_duration": (_durations, _D),
    "iso_parse_strict": (_iso, "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN (epoch_us(ts) // 1000) END AS ms FROM events"),
    "family_fold": (lambda spark, sf: table(spark, sf, "part").select("p_partkey", texts.fold(F.col("p_type"), ("promo", "econ", "small")).alias("family")), "SELECT p_partkey, CASE WHEN lower(p_type) LIKE '%promo%' THEN 'Promo' WHEN lower(p_type) LIKE '%econ%' THEN 'Econ' WHEN lower(p_type) LIKE '%small%' THEN 'Small' ELSE 'Other' END AS family FROM part"),
    "sat_log2": (lambda spark, sf: table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(units.saturating_log2(F.col("l_discount") - 0.05), 6).alias("v")), "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount - 0.05::DOUBLE > 0 THEN log2(l_discount - 0.05::DOUBLE) ELSE 0 END, 6) AS v FROM lineitem"),
    "percent_of_sum": (lambda spark, sf: table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(units.percent(F.col("l_discount"), F.col("l_discount") + F.col("l_tax")), 6).alias("pct")), "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount + l_tax <> 0 THEN round(l_discount / (l_discount + l_tax) * 100, 6) END AS pct FROM lineitem"),
    "average_packet": (lambda spark, sf: table(spark, sf, "events").groupBy("user_id").agg(units.average_packet(F.sum(F.col("event_id")), F.count_if(F.col("event_type") == "click")).alias("size")), "SELECT user_id, coalesce(round(sum(event_id)::DOUBLE / nullif(count_if(event_type = 'click'), 0)), 0)::BIGINT AS size FROM events GROUP BY 1"),
    "slug": (lambda spark, sf: table(spark, sf, "pages").select("page_id", texts.slug(F.col("url")).alias("slug")), "SELECT page_id, translate(url, '/._', '---') AS slug FROM pages"),
    "pages_basename": (_basename, "SELECT page_id, list_extract(string_split(rtrim(url, '/'), '/'), -1) AS base FROM pages"),
    "json_permissive": (_json, "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events"),
}
