"""Parent-child tables: closure, the rows a search keeps, roll-ups and depth-first order."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import orphans
from .stored import stored
from .views import ordinals


def closure(rows: DataFrame, key: str, parent: str, most_levels: int = 1000) -> DataFrame:
    """(root, node, parent, depth, path) of every node that a root reaches; roots have no parent among the rows.

    Cycles aren't reached from a root and so aren't there. One recursive query, whose rows are written once, for every
    use of them would run it anew; its levels are as many as the forest is deep."""
    spark = rows.sparkSession
    limits = {"spark.sql.cteRecursionLevelLimit": str(most_levels), "spark.sql.cteRecursionRowLimit": "-1"}
    before = {k: spark.conf.get(k) for k in limits}
    name = "t" + uuid.uuid4().hex
    rows.select(F.col(key).alias("k"), F.col(parent).alias("p")).createOrReplaceTempView(name)
    orphans(rows, key, parent).select(F.col(key).alias("k"), F.col(parent).alias("p")).createOrReplaceTempView(name + "r")
    for k, v in limits.items():
        spark.conf.set(k, v)
    try:
        return stored(spark.sql(f"""
        WITH RECURSIVE c(root, node, parent, depth, path) AS (
          SELECT k, k, p, 0, array(k) FROM {name}r
          UNION ALL
          SELECT c.root, t.k, t.p, c.depth + 1, array_append(c.path, t.k)
          FROM c JOIN {name} t ON t.p = c.node WHERE NOT array_contains(c.path, t.k))
        SELECT * FROM c"""))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        spark.catalog.dropTempView(name)
        spark.catalog.dropTempView(name + "r")


def shown(closed: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """Nodes to show for the kept ones: those, their ancestors and their descendants; disabled if not kept themselves."""
    k = kept.select(F.col(key).alias("node")).distinct().withColumn("_kept", F.lit(True))
    marked = closed.join(k, "node", "left")
    hits = marked.filter("_kept")
    up = hits.select(F.explode("path").alias("node"))
    below = closed.select("node", F.explode("path").alias("a")).join(k.select(F.col("node").alias("a")), "a", "left_semi").select("node")
    visible = up.union(below).distinct()
    return marked.join(visible, "node", "left_semi").withColumn("disabled", F.col("_kept").isNull()).drop("_kept")


def rollup(closed: DataFrame, values: DataFrame, key: str, sums: list[str], maxima: list[str] = ()) -> DataFrame:
    """For every node the sums and maxima over itself and all below. Rows meet their values before they go to the nodes of their
    paths, and what goes there is summed within each task first."""
    wanted = [*sums, *maxima]
    own = closed.join(values.select(F.col(key).alias("node"), *wanted), "node")
    each = own.select(F.explode("path").alias("ancestor"), *wanted)
    return each.groupBy("ancestor").agg(*[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in maxima])


def depth_first(closed: DataFrame, values: DataFrame, key: str, by: str, descending: bool = False) -> DataFrame:
    """Nodes with `position` from 1: siblings by a column, then id; a node before what is below it.

    A node's place is that of the sort keys along its path, so siblings, and roots among each other, need no numbers: no task
    holds all of them. Only a descending order of texts has no such key; there all nodes are numbered once, by ranges."""
    v = closed.join(values.select(F.col(key).alias("node"), by), "node")
    kind, c = dict(v.dtypes)[by], F.col(by)
    if not descending:
        keys = v.select(F.col("node").alias("a"), F.struct(c.isNotNull(), c, "node").alias("key"))
    elif kind in ("tinyint", "smallint", "int", "bigint"):
        keys = v.select(F.col("node").alias("a"), F.struct(c.isNull(), F.bitwise_not(c), "node").alias("key"))  # falls as c rises, whatever c
    elif kind in ("float", "double") or kind.startswith("decimal"):
        keys = v.select(F.col("node").alias("a"), F.struct(c.isNull(), -c, "node").alias("key"))
    else:
        keys = ordinals(v.select("node", by), [c.desc(), F.col("node")], "key").select(F.col("node").alias("a"), "key")
    along = closed.select("node", F.posexplode("path").alias("at", "a")).join(keys, "a")
    path = along.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "key"))), lambda x: x["key"]).alias("keys"))
    return ordinals(v.join(path, "node"), [F.col("keys")])


def prefix(df: DataFrame) -> DataFrame:
    """Adds the glyphs before a node's name, from depth_first()'s rows: its own branch, and for each ancestor below
    the root whether more siblings follow."""
    last = df.select("node", (F.row_number().over(Window.partitionBy("parent").orderBy(F.desc("position"))) == 1).alias("last"))
    marks = df.select("node", F.posexplode("path").alias("at", "a")).join(last.withColumnRenamed("node", "a"), "a").filter("at > 0")
    glyph = F.when(F.col("a") == F.col("node"), F.when(F.col("last"), "└─ ").otherwise("├─ ")).otherwise(F.when(F.col("last"), "   ").otherwise("│  "))
    lines = marks.groupBy("node").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("at", glyph.alias("g")))), lambda x: x["g"])).alias("prefix"))
    return df.join(lines, "node", "left").withColumn("prefix", F.coalesce("prefix", F.lit("")))
