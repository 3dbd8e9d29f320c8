"""Ranks of sums: totals do not depend on the order of rows, and the queries state the rules of their SQL."""

import duckdb
import pytest

from millrace.operators import ranking
from millrace.plans import registry

#: 12.50 to the cent in either order; added as doubles the first is less.
LOW, HIGH = (5.18, 4.95, 1.26, 1.11), (1.11, 1.26, 4.95, 5.18)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("ranks"))
    of = {1: LOW, 2: HIGH, 3: (12.0,), 4: (13.0,), 5: (0.3,), 6: (None,), 7: (6.0, 6.0)}
    orders = [(i, m, price) for i, (m, price) in enumerate((m, x) for m, prices in of.items() for x in prices)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double").coalesce(1).write.parquet(f"{at}/orders.parquet")
    spark.createDataFrame([(m, 1) for m in of], "c_custkey long, c_nationkey int").coalesce(1).write.parquet(f"{at}/customer.parquet")
    return at


def both(spark, folder, name):
    con = duckdb.connect()
    for t in ("orders", "customer"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got = registry.queries()[name](spark, folder)
    return sorted(map(tuple, got.collect()), key=str), sorted(con.sql(registry.oracle_sql()[name]).fetchall(), key=str)


def test_rank_points_of_equal_sums(spark, folder):
    got, want = both(spark, folder, "rank_points")
    assert got == want == [(1, 1, 13, 4), (1, 2, 13, 4), (1, 3, 12, 2), (1, 4, 13, 4), (1, 5, 0, 0), (1, 6, None, 0), (1, 7, 12, 2)]


def test_standings_of_equal_sums(spark, folder):
    got, want = both(spark, folder, "mvp_standings")
    assert got == want == [(1, 1, 10, 1), (1, 2, 10, 1), (1, 3, 3, 5), (1, 4, 5, 4), (1, 5, 1, 6), (1, 6, 1, 6), (1, 7, 7, 3)]


@pytest.mark.parametrize(("best", "points"), [("most", [3, 2, 0, 0]), ("fewest", [1, 2, 3, 0])])
def test_members_without_a_value(spark, best, points):
    rows = spark.createDataFrame([(1, "a", 5), (1, "b", 2), (1, "c", 0), (1, "d", None)], "party int, member string, v long")
    got = {r.member: r.points for r in ranking.rank_points(rows, ["party"], "v", best).collect()}
    assert [got[m] for m in "abcd"] == points
