"""Rows out of nested JSON by key, as VARIANT: the outer structure may be anything, damaged input gives nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How deep below the top a key is looked for.
DEPTH = 8


def unwrap(document: Column, *keys: str) -> Column:
    """The VARIANT under a path of keys of a JSON text; null if the text is damaged or a key isn't there. Keys may hold anything
    but a double quote."""
    if any('"' in k for k in keys):
        raise ValueError("a key can't hold a double quote")
    return F.try_variant_get(F.try_parse_json(document), "$" + "".join(f'["{k}"]' for k in keys), "variant")


def under_key(rows: DataFrame, document: str, key: str, out: str, depth: int = DEPTH) -> DataFrame:
    """rows, and what lies under `key` in the JSON text `document`, at whatever depth (up to `depth`) as VARIANT `out`: a row for each
    place that has the key, one with null for a text that has none or is damaged. Objects and arrays are opened level by
    level; only those levels that still hold some travel on."""
    mark = "_u"
    while any(c.startswith(mark) for c in rows.columns):
        mark += "_"
    at, value, name, pos, found = (f"{mark}{k}" for k in ("id", "value", "key", "pos", "found"))
    start = rows.withColumn(value, F.try_parse_json(document)).withColumn(found, F.lit(False)).withColumn(at, F.lit(0))
    view = f"{mark}_level"
    level, places = start, None
    for _ in range(depth):
        opened = level.filter(~F.col(found) & F.schema_of_variant(value).rlike("^(OBJECT|ARRAY)"))
        opened.createOrReplaceTempView(view)
        kept = ", ".join(f"l.`{c}`" for c in rows.columns)
        below = rows.sparkSession.sql(f"SELECT {kept}, v.value AS `{value}`, v.key AS `{name}`, v.pos AS `{pos}` FROM {view} l, LATERAL variant_explode(l.`{value}`) v")
        rows.sparkSession.catalog.dropTempView(view)
        level = below.select(*rows.columns, value, F.coalesce(F.col(name) == key, F.lit(False)).alias(found), F.col(pos).alias(at))
        hits = level.filter(found).select(*rows.columns, F.col(value).alias(out))
        places = hits if places is None else places.unionByName(hits)
    return places


def elements(rows: DataFrame, variant: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """A row for each element of a VARIANT list (an object counts as a list of one), with columns out: (key, type) of it; null where the
    key isn't there or isn't of that type."""
    kept = [c for c in rows.columns if c != variant]
    one = F.try_variant_get(variant, "$", "array<variant>")
    items = F.when(one.isNotNull(), one).otherwise(F.array(F.col(variant)))
    opened = rows.filter(F.col(variant).isNotNull()).select(*kept, F.explode(items).alias("_item"))
    return opened.select(*kept, *[F.try_variant_get("_item", f'$["{key}"]', kind).alias(out) for out, (key, kind) in fields.items()])


# Where df's structured output has what.
XO, FILE_SYSTEM = "storage-system-information", "filesystem"
DF_FIELDS = {
    "name": ("name", "string"), "mount_point": ("mounted-on", "string"), "total_blocks": ("total-blocks", "long"),
    "used_blocks": ("used-blocks", "long"), "available_blocks": ("available-blocks", "long"),
}


def disk_usage(outputs: DataFrame, text: str = "text") -> DataFrame:
    """(name, mount_point, used, free, total) in bytes, and the other columns, of texts that `df --libxo json -k` wrote. A text that
    is damaged, or without that key, has no rows; a figure that is missing is null."""
    held = outputs.withColumn("_fs", unwrap(F.col(text), XO, FILE_SYSTEM)).drop(text)
    rows = elements(held, "_fs", DF_FIELDS)
    size = lambda c: (F.col(c) * 1024)
    return rows.withColumns({"used": size("used_blocks"), "free": size("available_blocks"), "total": size("total_blocks")}).drop("used_blocks", "available_blocks", "total_blocks")
