"""Quantiles by group against numpy and against Spark's own."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import series as S
from ledgerloom.operators.quantiles import exact_quantiles

SHARES = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


def test_every_group_equals_numpy(spark):
    rng = np.random.default_rng(5)
    rows = [("hot", float(x)) for x in rng.normal(size=3000)] + [("ties", float(x)) for x in rng.integers(0, 3, 500)] + [("one", 2.5), ("pair", 1.0), ("pair", 2.0), ("none", None), ("some", None), ("some", 4.0)] + [(None, float(x)) for x in range(7)]
    got = {r[0]: r for r in exact_quantiles(spark.createDataFrame(rows, "g string, x double").repartition(5), "x", SHARES, ["g"]).collect()}
    assert set(got) == {"hot", "ties", "one", "pair", "none", "some", None}
    for g, r in got.items():
        xs = [x for h, x in rows if h == g and x is not None]
        assert r["n"] == len(xs)
        assert r["quantiles"] is None if not xs else np.allclose(r["quantiles"], np.quantile(xs, SHARES), atol=1e-12)


def test_two_group_columns_and_a_column_called_n(spark):
    df = spark.range(4000).select((F.col("id") % 3).alias("a"), F.when(F.col("id") % 2 == 0, "x").alias("b"), (F.col("id") * 37 % 1009).cast("decimal(12,2)").alias("n"))
    want = df.groupBy("a", "b").agg(F.percentile(F.col("n").cast("double"), F.array(*map(F.lit, SHARES))).alias("q"))
    assert {(r.a, r.b): r.quantiles for r in exact_quantiles(df, "n", SHARES, ["a", "b"]).collect()} == {(r.a, r.b): r.q for r in want.collect()}


def test_infinite_values_empty_tables_and_wrong_shares(spark):
    df = spark.createDataFrame([(1, float("inf"))] * 3 + [(1, -float("inf")), (1, 0.0), (1, -0.0)], "g int, x double")
    assert exact_quantiles(df, "x", [0.0, 0.3, 1.0], ["g"]).first()["quantiles"] == [-math.inf, 0.0, math.inf]
    assert exact_quantiles(df.limit(0), "x", [0.5], ["g"]).collect() == []
    for shares, by in (([1.5], ["g"]), ([0.5], [])):
        with pytest.raises(ValueError):
            exact_quantiles(df, "x", shares, by)


def test_no_task_holds_a_large_group(spark):
    """A group of 40,000 different values lies in several ranges, and equal values are one row before the shuffle."""
    df = spark.range(40_000, numPartitions=4).select(F.lit("hot").alias("g"), F.col("id").alias("x"), F.lit(1.0).alias("same"))
    plan = exact_quantiles(df, "x", [0.5], ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan
    counted = df.groupBy("g", "x").count().repartitionByRange(4, "g", "x").groupBy(F.spark_partition_id()).count().collect()
    assert len(counted) == 4 and max(r["count"] for r in counted) < 20_000
    assert exact_quantiles(df, "same", [0.5], ["g"]).first().asDict() == {"g": "hot", "n": 40_000, "quantiles": [1.0]}


def test_scaling_of_two_columns_by_group(spark):
    df = spark.createDataFrame([(1, float(x), float(x * x)) for x in range(9)] + [(2, 5.0, None)], "g int, a double, b double")
    got = {(r.g, r.a): r for r in S.robust_scaled(df, ["a", "b"], ["g"]).collect()}
    assert len(got) == 10 and (got[1, 4.0].a_scaled, got[1, 4.0].b_scaled) == (0.0, 0.0)
    assert got[1, 8.0].a_scaled == 1.0 and got[1, 8.0].b_scaled == (64 - 16) / (36 - 4)
    assert (got[2, 5.0].a_scaled, got[2, 5.0].b_scaled) == (0.0, None)
