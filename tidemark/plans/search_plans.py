"""Searches bound to the tables, and allow and deny lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters
from ..search import Attribute, Binding, Kind, SearchOptions, filter_rows
from ..sources.tables import table

EPS = "2.220446049250313e-16"
EVENTS = Binding(Attribute("event_type", Kind.TEXT), {"value": Attribute("value", Kind.NUMBER), "user": Attribute("user_id", Kind.TEXT), "id": Attribute("event_id", Kind.NUMBER)})
PART = Binding(Attribute("p_name", Kind.TEXT), {"size": Attribute("p_size", Kind.NUMBER), "price": Attribute("p_retailprice", Kind.NUMBER), "brand": Attribute("p_brand", Kind.TEXT), "type": Attribute("p_type", Kind.TEXT)})
ORDERS = Binding(Attribute("o_orderpriority", Kind.TEXT), {"price": Attribute("o_totalprice", Kind.NUMBER), "state": Attribute("o_orderstatus", Kind.TEXT), "cust": Attribute("o_custkey", Kind.TEXT)})
DOCS = Binding(Attribute("source", Kind.TEXT), {"chars": Attribute("n_chars", Kind.SIZE), "lang": Attribute("lang", Kind.TEXT), "quality": Attribute("quality", Kind.TEXT, absent="N/A"), "time": Attribute("n_chars", Kind.DURATION)})


def _search(name, binding, text, columns, **options):
    return lambda spark, sf: filter_rows(table(spark, sf, name), text, binding, SearchOptions(**options)).select(*columns)


def _labelled(text):
    def run(spark, sf):
        rows = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars").join(table(spark, sf, "labels"), "doc_id", "left")
        return filter_rows(rows, text, DOCS).select("doc_id", "quality")

    return run


def _kept(name, column, items, deny, columns, **how):
    return lambda spark, sf: table(spark, sf, name).filter(filters.keep(F.col(column), items, deny, **how)).select(*columns)


def _two_lists(spark, sf):
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.filter(filters.keep_entry(F.col("c_mktsegment"), F.col("n_name"), (["BUILDING"], False), (["CHINA", "NATION_1"], True))).select("c_custkey", "c_mktsegment", "n_name")


E_, P_, O_ = ["event_id", "event_type", "value"], ["p_partkey", "p_name"], ["o_orderkey", "o_orderpriority", "o_orderstatus"]
_e = "SELECT event_id, event_type, value FROM events WHERE "
_p = "SELECT p_partkey, p_name FROM part WHERE "
_o = "SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders WHERE "

PLANS = {
    "dsl_num_cmp": (_search("events", EVENTS, "value > 50 and value <= 120.5", E_), _e + "value > 50 AND value <= 120.5"),
    "dsl_eps_eq": (_search("part", PART, "size = 15", P_), _p + f"abs(p_size::DOUBLE - 15) < {EPS}"),
    "dsl_neq": (_search("part", PART, "size != 15 price < 1200", P_), _p + f"abs(p_size::DOUBLE - 15) >= {EPS} AND p_retailprice < 1200"),
    "dsl_units": (_search("documents", DOCS, "chars >= 1.5 KiB chars < 10 kb", ["doc_id", "n_chars"]), "SELECT doc_id, n_chars FROM documents WHERE n_chars >= 1536 AND n_chars < 10000"),
    "dsl_duration": (_search("documents", DOCS, "time > 2s and time != 5m", ["doc_id", "n_chars"]), "SELECT doc_id, n_chars FROM documents WHERE n_chars > 2000 AND n_chars <> 300000"),
    "dsl_name_regex": (_search("part", PART, "^[a-m].*e", P_, regex=True), _p + "regexp_matches(p_name, '(?i)^[a-m].*e')"),
    "dsl_whole_word": (_search("part", PART, "type = promo", P_, whole_word=True), _p + "regexp_matches(p_type, '(?i)^promo$')"),
    "dsl_case": (_search("orders", ORDERS, "HIGH", O_, ignore_case=False), _o + "regexp_matches(o_orderpriority, 'HIGH')"),
    "dsl_and_or_prec": (_search("orders", ORDERS, "high and state = f or urgent", O_), _o + "(o_orderpriority ILIKE '%high%' AND o_orderstatus ILIKE '%f%') OR o_orderpriority ILIKE '%urgent%'"),
    "dsl_juxtapose": (_search("orders", ORDERS, "state = o high or low", O_), _o + "o_orderstatus ILIKE '%o%' AND (o_orderpriority ILIKE '%high%' OR o_orderpriority ILIKE '%low%')"),
    "dsl_paren": (_search("events", EVENTS, "(value > 100 or value < 5) and (click or view)", E_), _e + "(value > 100 OR value < 5) AND (event_type ILIKE '%click%' OR event_type ILIKE '%view%')"),
    "dsl_negate": (_search("events", EVENTS, "!(value > 20 or click) and !view", E_), _e + "NOT (value > 20 OR event_type ILIKE '%click%') AND NOT event_type ILIKE '%view%'"),
    "dsl_quoted": (_search("orders", ORDERS, '"not specified" or "1-urgent"', O_), _o + "o_orderpriority ILIKE '%not specified%' OR o_orderpriority ILIKE '%1-urgent%'"),
    "dsl_empty_quotes": (_search("orders", ORDERS, '"" or nothing', O_), _o + "true"),
    "dsl_text_key": (_search("events", EVENTS, "user = 12", [*E_, "user_id"]), "SELECT event_id, event_type, value, user_id FROM events WHERE user_id::VARCHAR LIKE '%12%'"),
    "dsl_null_na": (_labelled("quality = n/a or quality = 0"), "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR quality = 0"),
    "filter_deny": (_kept("customer", "c_mktsegment", ["auto", "house"], True, ["c_custkey", "c_mktsegment"]), "SELECT c_custkey, c_mktsegment FROM customer WHERE NOT (c_mktsegment ILIKE '%auto%' OR c_mktsegment ILIKE '%house%')"),
    "filter_allow": (_kept("customer", "c_mktsegment", ["BUILD"], False, ["c_custkey", "c_mktsegment"], case_sensitive=True), "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment LIKE '%BUILD%'"),
    "filter_none": (_kept("nation", "n_name", None, True, ["n_nationkey", "n_name"]), "SELECT n_nationkey, n_name FROM nation"),
    "filter_allow_beats_deny": (_two_lists, "SELECT c_custkey, c_mktsegment, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment ILIKE '%building%' OR NOT (n_name ILIKE '%china%' OR n_name ILIKE '%nation\\_1%' ESCAPE '\\')"),
}
