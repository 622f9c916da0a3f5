"""Results on values and sizes that the small tables do not hold."""

import duckdb
import pytest
from pyspark.sql import functions as F

from kestrelite import catalog
from kestrelite.functions import text as X


def both(spark, name, folder, *tables):
    """Rows of a query and of its SQL as they print, so that the sign of zero and the form of numbers count."""
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    got = catalog.queries()[name](spark, str(folder)).collect()
    return sorted(repr(tuple(r)) for r in got), sorted(repr(r) for r in con.execute(catalog.oracle_sql()[name]).fetchall())


def test_large_sums_print_without_exponent(spark, tmp_path):
    spark.createDataFrame([(1, 68206111.14), (2, 2.36)], "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(0, "A"), (1, "B")], "r_regionkey int, r_name string").write.parquet(f"{tmp_path}/region.parquet")
    got, want = both(spark, "a8_reduce", tmp_path, "customer", "region")
    assert got == want
    values = [0.0, 0.5, 12.25, -9999999.99, 1e7, 12345678.9, -4093366668.45, 1e15 + 0.25, 9999999999999998.0, 1e16, 1.5e17, 1e22]
    texts = [r[0] for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").orderBy("k").select(X.number(F.col("v"))).collect()]
    assert texts == [duckdb.connect().execute(f"select ({v!r})::double::varchar").fetchall()[0][0] for v in values]


def test_small_negative_coordinates_round_as_in_sql(spark, tmp_path):
    rows = [(1, [-1e-7, 1e-7, -4.9e-7, 1.0]), (2, [-6e-7, 6e-7, 0.0, -1.0]), (3, [0.6, -0.8, 0.0, 0.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got, want = both(spark, "k8_normalize", tmp_path, "embeddings")
    assert got == want and "-0.0" in got[0]
