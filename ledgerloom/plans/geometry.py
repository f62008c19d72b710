"""Vector queries on the embeddings, and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import augment as A
from ..functions import vectors as X
from ..operators import clusters as C
from .adapters import adapted, table
from .registry import query

_V = "list_transform(embedding, lambda x: x::DOUBLE)"
_NORM = "sqrt(list_sum(list_transform({v}, lambda x: x * x)))"


def _norm(v: str) -> str:
    return _NORM.replace("{v}", v)


_CLIPPED = f"(SELECT vec_id, label, CASE WHEN n > 0.98 THEN list_transform(v, lambda x: x * (0.98 / (n + 1e-8))) ELSE v END AS v FROM (SELECT vec_id, label, {_V} AS v, {_norm(_V)} AS n FROM embeddings))"
_BALL = f"(SELECT vec_id, label, list_transform(v, lambda x: x * (tanh(n) / n)) AS v FROM (SELECT vec_id, label, v, {_norm('v')} AS n FROM {_CLIPPED}))"
_SPREAD = f"(SELECT vec_id, label, list_transform(v, lambda x: x * (tanh(n) / n)) AS v FROM (SELECT vec_id, label, v, {_norm('v')} AS n FROM (SELECT vec_id, label, list_transform({_V}, lambda x: x * ((label + 1) / 11.0)) AS v FROM embeddings)))"


def _ball(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", X.expmap0(X.clip(X.doubles("embedding"))).alias("v"))


def _spread(spark, d):
    v = X.scaled(X.doubles("embedding"), (F.col("label") + 1) / F.lit(11.0))
    return table(spark, d, "embeddings").select("vec_id", "label", X.expmap0(v).alias("v"))


@query(f"SELECT vec_id, round(v[1], 5) AS first, round({_norm('v')}, 5) AS norm FROM {_CLIPPED}")
def vec01_clip(spark, d):
    v = X.clip(X.doubles("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.round(v[0], 5).alias("first"), F.round(X.norm(v), 5).alias("norm"))


@query(f"SELECT vec_id, round(v[1], 5) AS first, round({_norm('v')}, 5) AS norm FROM {_BALL}")
def vec02_expmap0(spark, d):
    return _ball(spark, d).select("vec_id", F.round(F.col("v")[0], 5).alias("first"), F.round(X.norm(F.col("v")), 5).alias("norm"))


@query(f"WITH b AS (SELECT * FROM {_SPREAD}), o AS (SELECT v AS c FROM b WHERE vec_id = 0) SELECT vec_id, round(acosh(greatest(1 + 2 * list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) / ((1 - list_sum(list_transform(v, lambda x: x * x))) * (1 - list_sum(list_transform(c, lambda x: x * x)))), 1)), 4) AS distance FROM b, o WHERE vec_id <> 0")
def vec02_distance(spark, d):
    b = _spread(spark, d)
    one = b.where("vec_id = 0").select(F.col("v").alias("c"))
    return b.where("vec_id <> 0").join(F.broadcast(one)).select("vec_id", F.round(X.distance(F.col("v"), F.col("c")), 4).alias("distance"))


@query(f"SELECT vec_id, round(2 * atanh({_norm('v')}), 4) AS depth FROM {_SPREAD}")
def vec03_depth(spark, d):
    return _spread(spark, d).select("vec_id", F.round(X.depth(F.col("v")), 4).alias("depth"))


@query(f"WITH e AS (SELECT vec_id, list_transform({_V}[1:10], lambda x: exp(x)) AS e, {_V}[1:10] AS v FROM embeddings) SELECT vec_id, CAST(list_position(v, list_max(v)) - 1 AS BIGINT) AS label, round(list_max(e) / list_sum(e), 5) AS confidence FROM e")
def vec05_softmax(spark, d):
    v = F.slice(X.doubles("embedding"), 1, 10)
    p = X.softmax(v)
    return table(spark, d, "embeddings").select("vec_id", X.argmax(v).cast("bigint").alias("label"), F.round(F.array_max(p), 5).alias("confidence"))


@query("WITH f AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) SELECT label, CAST(pos - 1 AS INT) AS pos, round(avg(x), 4) + 0 AS x FROM f GROUP BY 1, 2")
def agg18_anchor_means(spark, d):
    return C.mean_vectors(table(spark, d, "embeddings"), "label", "embedding").select("label", F.posexplode("mean").alias("pos", "x")).select("label", "pos", (F.round("x", 4) + 0).alias("x"))


@query("""WITH f AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings), m AS (SELECT label, list(x ORDER BY pos) AS m FROM (SELECT label, pos, avg(x) AS x FROM f GROUP BY 1, 2) GROUP BY 1),
p AS (SELECT e.vec_id, m.label AS nearest, list_sum(list_transform(range(1, 65), lambda i: (e.embedding[i]::DOUBLE - m.m[i]) * (e.embedding[i]::DOUBLE - m.m[i]))) AS d FROM embeddings e, m) SELECT vec_id, arg_min(nearest, d) AS nearest, round(sqrt(min(d)), 4) AS distance FROM p GROUP BY 1""")
def mdl04_nearest_anchor(spark, d):
    e = table(spark, d, "embeddings")
    return C.nearest_anchor(e.select("vec_id", "embedding"), "embedding", C.mean_vectors(e, "label", "embedding")).select("vec_id", "nearest", F.round("distance", 4).alias("distance"))


@query(f"WITH s AS (SELECT vec_id, 2 * atanh({_norm('v')}) AS n FROM {_SPREAD}), q AS (SELECT list_sort(list(n)) AS l FROM s) SELECT vec_id, CASE WHEN n < l[ceil(len(l) / 2.0)::INT] - 1e-9 THEN 'macro' ELSE 'micro' END AS level FROM s, q")
def agg20_taxonomy(spark, d):
    return C.taxonomy(_spread(spark, d), "vec_id", "v").select("vec_id", "level")


@query(f"WITH b AS (SELECT label, {_V} AS v FROM embeddings), p AS (SELECT a.vec_id, a.label = 0 AS same, sqrt(list_sum(list_transform({_V}, lambda x: x * x))) AS n FROM embeddings a) SELECT vec_id, round(CASE WHEN same THEN n * n ELSE greatest(1.5 - n, 0) * greatest(1.5 - n, 0) END, 4) AS loss FROM p")
def los01_contrastive(spark, d):
    n = X.norm(X.doubles("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.round(X.contrastive_loss(n, F.col("label") == 0, 1.5), 4).alias("loss"))


@query()
def mdl05_kmeans(spark, d):
    points = _spread(spark, d)
    at = C.kmeans(points, "vec_id", "v", 5)
    return C.nearest(points, F.col("v"), at).select("vec_id", "label", F.round("confidence", 4).alias("confidence"), "is_known")


@query()
def mdl08_discover(spark, d):
    points = _spread(spark, d).withColumn("text", F.concat(F.lit("t"), F.col("vec_id").cast("string")))
    return C.discover(points, "vec_id", "v", "text", 4).select("cluster_id", "n", "confidence", "samples")


@query()
def mdl03_predict(spark, d):
    return C.predict(adapted(spark, d, "lines").select("id", "description"), "description").select("id", "category", F.round("confidence", 4).alias("confidence"))


@query()
def aug01_dropout(spark, d):
    x = adapted(spark, d, "lines").select("id", "description")
    return A.frequency_dropout(x, "id", "description", A.term_frequency(x, "description"))


@query()
def aug01_substring(spark, d):
    return adapted(spark, d, "lines").select("id", A.substring_view(F.col("id"), F.col("description")).alias("view"))
