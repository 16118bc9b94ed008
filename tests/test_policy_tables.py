"""Policies' examples and faults come from the rows of a table."""

from tessera.functions.policy import Compiled
from tessera.plans import QUERIES
from tessera.plans.policies import SHIPPING


def test_results_grow_with_their_tables(spark, tmp_path):
    spark.range(1, 31).selectExpr("id AS p_partkey", "cast(id % 50 AS int) AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(1, 22).selectExpr("id AS o_orderkey", "cast(id * 100.5 AS double) AS o_totalprice", "'1-URGENT' AS o_orderpriority", "'O' AS o_orderstatus").write.parquet(f"{tmp_path}/orders.parquet")
    assert QUERIES["policy_diagnostics"](spark, str(tmp_path)).count() == 30
    assert {r.o_orderkey for r in QUERIES["policy_examples"](spark, str(tmp_path)).collect() if not r.passed} == {7, 14, 21}


def test_an_example_with_a_wrong_or_no_expectation_fails(spark):
    rows = spark.createDataFrame([("2000.00", "100.00"), ("2000.00", "100.01"), ("2000.00", None)], "total string, want string")
    given = rows.selectExpr("cast(total AS decimal(18,8)) AS total", "true AS urgent", "true AS open", "cast(want AS decimal(18,8)) AS want")
    assert [r.passed for r in Compiled(SHIPPING).check_examples(given, {"fee": "want"}).collect()] == [True, False, False]
