"""Exact quantiles by group, in built-in functions: no task holds a group, however large, nor all rows of one value.

Equal values are counted before anything is moved, the different ones are dealt by ranges of (group, value), so that a large
group lies in as many partitions as its values fill, and ranks are running counts within a range plus what lies before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import materialize


def exact_quantiles(df: DataFrame, column: str, shares: list[float], by: list[str]) -> DataFrame:
    """(*by, n, quantiles): n counts the values that aren't null; quantiles are linear between neighbours, null for groups without values.

    A null in `by` is a group like any other. NaN is the largest value. An empty table gives no rows.
    """
    if not by or not all(0 <= q <= 1 for q in shares):
        raise ValueError("quantiles by group take at least one column of groups, and shares from 0 to 1")
    g = F.struct(*[F.col(c) for c in by]).alias("__g")
    counted = df.select(g, F.col(column).cast("double").alias("__x")).groupBy("__g", "__x").agg(F.count("__x").alias("__n"))
    # -0.0 and 0.0 are one key of a group already; a null value has __n = 0 and only keeps its group
    parts = materialize(counted.repartitionByRange("__g", "__x").withColumn("__p", F.spark_partition_id()), "values")
    held = parts.groupBy("__g", "__p").agg(F.sum("__n").alias("__c"))
    # a row for each partition that a group lies in
    group = Window.partitionBy("__g")
    before = F.coalesce(F.sum("__c").over(group.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = held.select("__g", "__p", before.alias("__before"), F.sum("__c").over(group).alias("n"))
    upto = F.sum("__n").over(Window.partitionBy("__g", "__p").orderBy("__x").rowsBetween(Window.unboundedPreceding, 0))
    ranked = parts.withColumn("__r", upto).join(base, ["__g", "__p"]).withColumn("__r", F.col("__r") + F.col("__before"))

    def at(rank):  # the value whose rows take the places from __r - __n + 1 to __r
        return F.max(F.when((F.col("__r") >= rank) & (F.col("__r") - F.col("__n") < rank), F.col("__x")))

    place = lambda q: (F.col("n") - 1) * F.lit(float(q))
    found = ranked.groupBy("__g").agg(F.max("n").alias("n"), *[at(f(place(q)) + 1).alias(f"__{i}_{s}") for i, q in enumerate(shares) for s, f in (("lo", F.floor), ("hi", F.ceil))])
    lo, hi = (lambda i: F.col(f"__{i}_lo")), (lambda i: F.col(f"__{i}_hi"))
    # equal neighbours are taken as they are: infinity less infinity is no number
    between = [F.when(lo(i) == hi(i), lo(i)).otherwise(lo(i) + (hi(i) - lo(i)) * (place(q) - F.floor(place(q)))) for i, q in enumerate(shares)]
    return found.select(*[F.col(f"__g.{c}").alias(c) for c in by], "n", F.when(F.col("n") > 0, F.array(*between)).alias("quantiles"))
