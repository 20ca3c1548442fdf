"""Every layout query with SQL against DuckDB, row by row."""

import math
from pathlib import Path

import duckdb
import pytest

from loomspan.plans import catalog, kernel_queries, layout_queries, pixel_queries, text_queries, value_queries  # noqa: F401 (all but the first register queries)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    value = lambda x: round(x, 4) if isinstance(x, float) and not math.isnan(x) else x
    return sorted((tuple(value(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    table = duck.sql(catalog.ORACLE_SQL[name]).to_arrow_table()
    assert sorted(got.columns) == sorted(table.column_names)
    want = rows(table.column_names, [tuple(r.values()) for r in table.to_pylist()])
    have = rows(got.columns, [tuple(r.values()) for r in got.toArrow().to_pylist()])
    assert have == want


def test_wrapped_lines_hold_all_words(spark):
    source = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    for r in catalog.QUERIES["wrap_greedy"](spark, SF).collect():
        lines = r["wrapped"].split("\n")
        assert " ".join(lines).split() == source[r["item_id"]].split()
        assert all(len(x) <= 40 or " " not in x for x in lines)
