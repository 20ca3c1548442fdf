"""Ends of long lines whose inner letters are all of one height, against the query's SQL."""

import duckdb
from pyspark.sql import functions as F

from loomspan.plans import catalog, layout_queries  # noqa: F401 (registers queries)


def test_ends_of_a_line_of_equal_inner_letters_are_as_in_the_sql(spark, tmp_path):
    part = spark.range(100).select(F.col("id").alias("p_partkey"), F.when(F.col("id").between(10, 19), 2).otherwise(F.col("id") * 7 % 50 + 1).cast("int").alias("p_size"))
    part.write.parquet(f"{tmp_path}/part.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = dict(db.execute(catalog.ORACLE_SQL["trimmed_ends"]).fetchall())
    got = {r["id"]: r["stays"] for r in catalog.QUERIES["trimmed_ends"](spark, str(tmp_path)).collect()}
    assert got == want and [k for k in sorted(got) if got[k] is None] == [10, 19]
