"""Categories on the Poincare ball: means, nearest centroids, k-means, discovery, taxonomy, prediction.

Points stay in the DataFrame; only centroids (k vectors) and their sums come to the driver.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions import vectors as X
from ..functions.text import clean_description, first_listed, salary_guard
from ..functions.vocabulary import KEYWORD_RULES
from ..staging import materialize
from .ledger import global_rank

#: Depths that differ by less are the same depth.
SAME_DEPTH = 1e-9
# Phrases from which the labels' anchors are made.
ANCHOR_PHRASES = {
    "Food": ["swiggy order", "zomato payment", "restaurant bill"],
    "Transport": ["uber ride", "ola trip", "metro recharge"],
    "Utilities": ["electricity bill", "water bill", "airtel recharge"],
    "Salary": ["salary credited", "monthly payroll", "salary transfer"],
    "Shopping": ["amazon purchase", "flipkart order", "retail shopping"],
    "Entertainment": ["netflix subscription", "spotify payment", "movie ticket"],
    "Health": ["pharmacy purchase", "hospital bill", "clinic payment"],
    "Education": ["course payment", "tuition fee", "school fee"],
    "Finance": ["loan emi", "insurance premium", "investment transfer"],
    "People": ["transfer to friend", "gift payment", "family transfer"],
}


def _dims(df: DataFrame, vector: str) -> int:
    """How many numbers the vectors hold, by the first that isn't null."""
    row = df.where(F.col(vector).isNotNull()).select(F.size(vector)).first()
    return row[0] if row else 0


def mean_vectors(df: DataFrame, label: str, vector: str, dims: int | None = None) -> DataFrame:
    """AGG-18: the mean vector of each label: one mean for each place, combined before the shuffle."""
    n = dims or _dims(df, vector)
    means = df.select(label, X.doubles(vector).alias("__v")).groupBy(label).agg(*[F.avg(F.get("__v", F.lit(i))).alias(f"__{i}") for i in range(n)])
    return means.select(label, F.array(*[F.col(f"__{i}") for i in range(n)]).alias("mean"))


def literal(v) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def _centroid_column(centroids: list[list[float]]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("i"), literal(c).alias("c")) for i, c in enumerate(centroids)])


def nearest(df: DataFrame, vector: Column, centroids: list[list[float]], threshold: float = 0.7) -> DataFrame:
    """JOI-10, MDL-07: label (ties: the lower), distance, confidence exp(-distance) and is_known; centroids are k literals."""
    best = X.let(vector, lambda v: F.array_min(F.transform(_centroid_column(centroids), lambda e: F.struct(X.distance(v, e["c"]).alias("d"), e["i"].alias("i")))))
    return df.withColumn("__b", best).withColumns({"label": F.col("__b.i"), "distance": F.col("__b.d"), "confidence": F.exp(-F.col("__b.d")), "is_known": F.exp(-F.col("__b.d")) > threshold}).drop("__b")


def nearest_anchor(df: DataFrame, vector: str, anchors: DataFrame, anchor: str = "label", mean: str = "mean", most: int = 10_000) -> DataFrame:
    """MDL-04: the anchor at the least Euclidean distance (ties: the least anchor), null without anchors.

    anchors has a row for each label, at most `most` of them, else an error. They are worked out once and meet each row as one array, so no row is multiplied or moved.
    """
    pairs = anchors.select(F.col(anchor).alias("a"), X.doubles(mean).alias("m"))
    held = pairs.limit(most + 1).collect()
    if len(held) > most:
        raise ValueError(f"more than {most} anchors")
    listed = df.sparkSession.createDataFrame(held, pairs.schema).agg(F.collect_list(F.struct("a", "m")).alias("__anchors"))
    gap = lambda v, m: F.aggregate(F.zip_with(v, m, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    best = X.let(X.doubles(vector), lambda v: F.array_min(F.transform("__anchors", lambda e: F.struct(gap(v, e["m"]).alias("d"), e["a"].alias("a")))))
    keys = [c for c in df.columns if c != vector]
    return df.join(F.broadcast(listed)).withColumn("__b", best).select(*keys, F.col("__b.a").alias("nearest"), F.sqrt("__b.d").alias("distance"))


def np_exp0(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v)
    return v if n == 0 else v * np.tanh(n) / n


def np_mobius_add(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    xy, xx, yy = x @ y, x @ x, y @ y
    return ((1 + 2 * xy + yy) * x + (1 - xx) * y) / max(1 + 2 * xy + xx * yy, 1e-15)


def np_exp(at: np.ndarray, v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v)
    return at if n == 0 else np_mobius_add(at, np.tanh(n / (1 - at @ at)) * v / n)


def log_at(point: Column, c: Column) -> Column:
    """The tangent vector at c that leads to the point, as array expressions."""

    def step(xy: Column, xx: Column, yy: Column) -> Column:
        den = F.greatest(1 + 2 * xy + xx * yy, F.lit(1e-15))
        sub = F.zip_with(X.scaled(c, -(1 + 2 * xy + yy) / den), X.scaled(point, (1 - xx) / den), lambda a, b: a + b)
        return X.let(sub, lambda v: X.scaled(v, X.let(X.norm(v), lambda n: F.when(n > 0, (1 - xx) * X.atanh(n) / n).otherwise(0.0))))

    return X.let(-X.dot(c, point), lambda xy: X.let(X.dot(c, c), lambda xx: X.let(X.dot(point, point), lambda yy: step(xy, xx, yy))))


def _sums(df: DataFrame, label: str, vector: Column, dims: int) -> dict[int, tuple[int, np.ndarray]]:
    """n and the vector sum of each label: k rows, combined before they come to the driver."""
    rows = df.select(label, vector.alias("__v")).groupBy(label).agg(F.count(F.lit(1)).alias("__n"), *[F.sum(F.get("__v", F.lit(i))).alias(f"__{i}") for i in range(dims)]).collect()
    return {r[label]: (r["__n"], np.array([r[f"__{i}"] for i in range(dims)])) for r in rows}


def frechet_means(df: DataFrame, label: str, vector: str, steps: int = 10, tol: float = 1e-5) -> dict[int, np.ndarray]:
    """MDL-06: the mean on the ball of each label's points: from the tangent mean, along the mean direction to all points."""
    dims = _dims(df, vector)
    at = {k: np_exp0(s / n) for k, (n, s) in _sums(df, label, X.logmap0(F.col(vector)), dims).items()}
    for _ in range(steps):
        own = F.create_map(*[x for k, c in at.items() for x in (F.lit(k), literal(c))])
        move = {k: s / n for k, (n, s) in _sums(df.withColumn("__c", own[F.col(label)]), label, log_at(F.col(vector), F.col("__c")), dims).items()}
        at = {k: np_exp(c, move[k]) for k, c in at.items()}
        if max(float(np.linalg.norm(m)) for m in move.values()) < tol:
            break
    return at


def np_distance(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.arccosh(1 + 2 * ((a - b) @ (a - b)) / (max(1 - a @ a, X.EDGE) * max(1 - b @ b, X.EDGE))))


def seeds(df: DataFrame, key: str, vector: str, k: int, seed: int = 0) -> list[list[float]]:
    """k points of different value, by a hash of the key: the same whatever the partitioning. All values are grouped only if the first points repeat too much."""
    order = F.struct(F.xxhash64(F.col(key), F.lit(seed)).alias("h"), F.col(key).alias("k")).alias("o")
    first = df.select(order, vector).orderBy("o").limit(8 * k).collect()
    different = list(dict.fromkeys(tuple(r[vector]) for r in first))
    if len(different) < k:
        rows = df.groupBy(vector).agg(F.min(order).alias("o")).orderBy("o").limit(k).collect()
        different = [tuple(r[vector]) for r in rows]
    return [list(v) for v in different[:k]]


def kmeans(df: DataFrame, key: str, vector: str, k: int, max_iter: int = 20, tol: float = 1e-4, seed: int = 0) -> list[list[float]]:
    """MDL-05: centroids; an empty cluster keeps its own. Points are read once an iteration and step."""
    points = df.select(key, X.doubles(vector).alias(vector)).persist()
    try:
        at = seeds(points, key, vector, k, seed)
        for _ in range(max_iter):
            placed = nearest(points, F.col(vector), at).select(key, vector, "label").persist()
            means = frechet_means(placed, "label", vector, steps=3)
            placed.unpersist()
            new = [list(means[i]) if i in means else c for i, c in enumerate(at)]
            shift = max(np_distance(np.array(a), np.array(b)) for a, b in zip(at, new, strict=True))
            at = new
            if shift < tol:
                break
        return at
    finally:
        points.unpersist()


def discover(df: DataFrame, key: str, vector: str, text: str, k: int, seed: int = 0) -> DataFrame:
    """MDL-08, AGG-19, TOP-08: (cluster_id, n, confidence, samples, centroid); at least two texts a cluster are needed. Empty clusters have n 0."""
    if df.limit(2 * k).count() < 2 * k:
        raise ValueError(f"{k} clusters need at least {2 * k} texts")
    at = kmeans(df, key, vector, k, seed=seed)
    placed = nearest(df, X.doubles(vector), at)
    own = placed.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("confidence"))
    # the five least keys of each cluster: one text for each of a bounded number of slots, then the least of them
    slot = placed.groupBy("label", F.pmod(F.xxhash64(key), F.lit(64)).alias("s")).agg(F.min(F.struct(key, text)).alias("t"))
    samples = slot.groupBy("label").agg(F.transform(F.slice(F.array_sort(F.collect_list("t")), 1, 5), lambda t: t[text]).alias("samples"))
    base = df.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(at)], "cluster_id int, centroid array<double>")
    return base.join(own, base.cluster_id == own.label, "left").drop("label").join(samples, F.col("cluster_id") == samples.label, "left").select("cluster_id", F.coalesce("n", F.lit(0)).alias("n"), "confidence", "samples", "centroid")


def taxonomy(df: DataFrame, label: str, vector: str) -> DataFrame:
    """MDL-09, AGG-20: macro categories lie nearer to the origin than the lower median depth, micro ones don't. The median is that of all rows, found by rank.

    Depths within SAME_DEPTH of the median count as it: what is as deep may differ in the last places of its sum.
    """
    deep = materialize(df.select(label, X.depth(X.doubles(vector)).alias("norm")), "depths")
    n = deep.where("norm is not null").count()
    mid = global_rank(deep.where("norm is not null"), ["norm", label]).where(F.col("rank") == (n + 1) // 2).select(F.col("norm").alias("mid"))
    macro = F.col("norm") < F.col("mid") - SAME_DEPTH
    return deep.join(F.broadcast(mid)).select(label, "norm", F.when(macro, "macro").otherwise("micro").alias("level"), F.when(macro, "center").otherwise("boundary").alias("depth"))


@F.pandas_udf(ArrayType(DoubleType()))
def _hashed(text: pd.Series, dims: pd.Series) -> pd.Series:
    n = int(dims.iloc[0]) if len(dims) else 1
    rows, places, signs = [], [], []
    for i, words in enumerate(text.fillna("").str.lower().str.split()):
        terms = [*words, *(w[j : j + 3] for w in words for j in range(max(1, len(w) - 2)))]
        h = np.array([zlib.crc32(t.encode()) for t in terms], np.int64)
        rows.append(np.full(len(h), i))
        places.append(h % n)
        signs.append(1 - 2 * (h >> 20 & 1))
    flat = [np.concatenate(x or [np.zeros(0, np.int64)]) for x in (rows, places, signs)]
    v = np.bincount(flat[0] * n + flat[1], flat[2], len(text) * n).reshape(len(text), n)
    length = np.sqrt((v * v).sum(1, keepdims=True))
    return pd.Series(list(v / np.where(length > 0, length, 1.0)))


def hashed_embedding(text: Column, dims: int = 64) -> Column:
    """MDL-01: an embedding without a model: each word and each three letters count at a hashed place, with a hashed sign; unit length."""
    return _hashed(text, F.lit(dims))


def anchors(spark, dims: int = 64) -> DataFrame:
    """The mean embedding of each label's phrases."""
    rows = [(k, p) for k, ps in ANCHOR_PHRASES.items() for p in ps]
    return mean_vectors(spark.createDataFrame(rows, "label string, phrase string").withColumn("v", hashed_embedding(F.col("phrase"), dims)), "label", "v", dims)


def predict(df: DataFrame, text: str, dims: int = 64) -> DataFrame:
    """MDL-03: category and confidence: a keyword rule on the cleaned text counts 1; for the rest the nearest anchor decides, with the salary guard.

    Each different text is classified once; the anchors, one for each label, are literals in the expression.
    """
    names = sorted((r["label"], r["mean"]) for r in anchors(df.sparkSession, dims).collect())
    listed = F.array(*[F.struct(F.lit(n).alias("n"), literal(v).alias("v")) for n, v in names])
    gap = lambda v, a: F.sqrt(F.aggregate(F.zip_with(v, a, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    best = F.array_min(F.transform(listed, lambda e: F.struct(gap(F.col("__e"), e["v"]).alias("d"), e["n"].alias("n"))))
    cleaned = X.let(clean_description("__t"), lambda c: F.when(c == "", F.coalesce("__t", F.lit(""))).otherwise(c))
    each = materialize(df.select(F.col(text).alias("__t")).distinct().withColumn("__c", cleaned), "texts")
    each = each.withColumn("__r", X.let(F.lower("__c"), lambda low: first_listed(low, KEYWORD_RULES, 4)))
    ruled = each.where("__r is not null").select("__t", F.col("__r").alias("category"), F.lit(1.0).alias("confidence"))
    near = each.where("__r is null").withColumn("__e", hashed_embedding(F.col("__c"), dims)).withColumn("__b", best)
    found = ruled.unionByName(near.select("__t", salary_guard(F.col("__b.n"), F.col("__c")).alias("category"), F.exp(-F.col("__b.d")).alias("confidence")))
    return df.join(found, F.col(text).eqNullSafe(F.col("__t")), "left").drop("__t")


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """AGG-21"""
    return df.agg(F.avg((F.col(a) == F.col(b)).cast("double")).alias("rate"), F.count(F.lit(1)).alias("n"))


def thin_classes(df: DataFrame, label: str, least: int) -> DataFrame:
    """AGG-22: classes with fewer rows than `least`."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < least)


def project(df: DataFrame, vector: str, weight: list[list[float]], bias: list[float], clip: float = 0.98) -> DataFrame:
    """MDL-02, VEC-04: an affine map and ReLU in the tangent space, clipped and put on the ball, as array expressions."""
    rows = F.array(*[F.struct(literal(r).alias("r"), F.lit(float(b)).alias("b")) for r, b in zip(weight, bias, strict=True)])
    hidden = F.transform(rows, lambda w: F.greatest(X.dot(w["r"], X.doubles(vector)) + w["b"], F.lit(0.0)))
    return df.withColumn("projected", X.expmap0(X.clip(hidden, clip)))


def classify_tangent(df: DataFrame, vector: str, weight: list[list[float]], labels: list[str]) -> DataFrame:
    """VEC-05: softmax of a linear layer over the tangent vector; category and confidence."""
    rows = F.array(*[literal(r) for r in weight])
    p = X.softmax(X.let(X.logmap0(X.doubles(vector)), lambda v: F.transform(rows, lambda r: X.dot(r, v))))
    names = F.array(*[F.lit(x) for x in labels])
    return df.withColumn("__p", p).withColumns({"category": F.element_at(names, (X.argmax(F.col("__p")) + 1).cast("int")), "confidence": F.array_max("__p")}).drop("__p")
