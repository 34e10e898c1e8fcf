import pytest

import __spark_entry__ as entry
from parity import database, rows
from tidemark import registry


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_agrees_with_its_sql(spark, sf_dir, name):
    got = registry.queries()[name](spark, sf_dir).toPandas()
    assert rows(got) == rows(database(sf_dir).execute(registry.oracle_sql()[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(registry.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_group_by_id_takes_the_first_of_equal_rows_in_the_files_and_skips_absent_flags(spark, tmp_path):
    import duckdb

    columns = "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_extendedprice double, l_returnflag string"
    path = tmp_path / "lineitem.parquet"
    path.mkdir()
    db = duckdb.connect(config={"threads": 1})
    for part in range(3):  # each part's lowest order and line stands in every file, six times, with other flags
        made = spark.range(600).selectExpr("(id DIV 100) DIV 6 AS l_orderkey", "1 AS l_linenumber", "id % 100 AS l_partkey", "1D AS l_quantity", "2D AS l_extendedprice", f"CASE WHEN id % 7 = 0 OR {part} = 0 AND id % 5 = 0 THEN NULL ELSE substr('NRA', 1 + CAST((id + id DIV 100 + {2 - part}) % 3 AS INT), 1) END AS l_returnflag")
        made = made.selectExpr(*(f"CAST({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in columns.split(", ")))
        made.coalesce(1).toPandas().to_parquet(path / f"part-{part}.parquet", index=False)
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{path}/*.parquet')")
    want = rows(db.execute(registry.oracle_sql()["group_by_id"]).df())
    assert rows(registry.queries()["group_by_id"](spark, str(tmp_path)).toPandas()) == want
    assert len(want[1]) == 100
