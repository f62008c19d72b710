"""Losses, layers, nearest centroids, jobs and scans: queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as X
from ..operators import clusters as C
from ..operators import dashboard as D
from ..operators import jobs as J
from ..operators.metric import MetricLearner
from ..sources import readers as R
from ..staging import fresh_path
from .adapters import adapted, duck, table
from .registry import query

_L, _P = duck("ledger"), duck("purchases")
_V = "list_transform(embedding, lambda x: x::DOUBLE)"


def _soft(v: str) -> str:
    return f"list_transform({v}, lambda x: exp(x) / list_sum(list_transform({v}, lambda y: exp(y))))"


def _slice(v, begin: int, n: int = 10):
    return F.slice(v, begin, n)


def _embeddings(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", X.doubles("embedding").alias("v"))


@query(f"WITH e AS (SELECT vec_id, {_V} AS v FROM embeddings), p AS (SELECT vec_id, {_soft('list_transform(v[1:10], lambda x: x / 4)')} AS s, {_soft('list_transform(v[11:20], lambda x: x / 4)')} AS t, v FROM e) SELECT vec_id, round(0.7 * 16 * list_sum(list_transform(range(1, 11), lambda i: t[i] * (ln(t[i]) - ln(s[i])))) + 0.3 * list_sum(list_transform(range(1, 11), lambda i: pow(v[20 + i] - v[30 + i], 2))) / 10, 5) AS loss FROM p")
def los02_distillation(spark, d):
    v = F.col("v")
    loss = X.distillation_loss(_slice(v, 1), _slice(v, 11), _slice(v, 21), _slice(v, 31))
    return _embeddings(spark, d).select("vec_id", F.round(loss, 5).alias("loss"))


@query(f"WITH p AS (SELECT vec_id, label, {_soft(_V + '[1:10]')} AS p FROM embeddings) SELECT vec_id, round(0.7 * -ln(p[label + 1]) + 0.3 * list_sum(list_transform(range(1, 11), lambda i: p[i] * (1 + abs(i - 1 - label) / 10.0))), 5) AS loss FROM p")
def los03_hierarchical(spark, d):
    penalties = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.abs(i - F.col("label")) / 10.0)
    return _embeddings(spark, d).select("vec_id", F.round(X.hierarchical_loss(X.softmax(_slice(F.col("v"), 1)), F.col("label"), penalties), 5).alias("loss"))


@query(f"WITH e AS (SELECT vec_id, {_V} AS v FROM embeddings) SELECT vec_id, round(ln(list_sum(list_transform(v[1:6], lambda x: exp(x / 0.1)))) - v[1] / 0.1, 4) AS loss FROM e")
def los01_info_nce(spark, d):
    v = F.col("v")
    return _embeddings(spark, d).select("vec_id", F.round(X.info_nce(v[0], _slice(v, 2, 5)), 4).alias("loss"))


@query(f"WITH e AS (SELECT vec_id, {_V}[1:16] AS a, {_V}[17:32] AS b FROM embeddings), n AS (SELECT vec_id, list_sum(list_transform(range(1, 17), lambda i: a[i] * b[i])) AS ab, sqrt(list_sum(list_transform(a, lambda x: x * x))) AS na, sqrt(list_sum(list_transform(b, lambda x: x * x))) AS nb FROM e) SELECT vec_id, round(0.5 * na * na + 0.5 * pow(1 - ab / greatest(na * nb, 1e-8), 2), 4) AS loss FROM n")
def los01_hybrid(spark, d):
    a, b = _slice(F.col("v"), 1, 16), _slice(F.col("v"), 17, 16)
    gap = 1 - X.cosine(a, b)
    return _embeddings(spark, d).select("vec_id", F.round(X.hybrid_loss(X.contrastive_loss(X.norm(a), F.lit(True)), gap * gap), 4).alias("loss"))


_W, _BIAS = [[((r + 1) * (i + 1) % 7 - 3) / 10 for i in range(64)] for r in range(3)], [0.1, 0.0, -0.1]
_HIDDEN = "list_transform(range(1, 4), lambda r: greatest(list_sum(list_transform(range(1, 65), lambda i: (r * i % 7 - 3) / 10.0 * v[i])) + (2 - r) / 10.0, 0))"


@query(f"WITH e AS (SELECT vec_id, {_V} AS v FROM embeddings), h AS (SELECT vec_id, {_HIDDEN} AS h FROM e), n AS (SELECT vec_id, h, sqrt(list_sum(list_transform(h, lambda x: x * x))) AS n FROM h), c AS (SELECT vec_id, h, n, CASE WHEN n > 0.98 THEN 0.98 * n / (n + 1e-8) ELSE n END AS m FROM n) SELECT vec_id, CAST(k - 1 AS INT) AS pos, round(CASE WHEN n = 0 THEN 0 ELSE h[k] / n * tanh(m) END, 5) + 0 AS x FROM c, range(1, 4) r(k)")
def vec04_projected(spark, d):
    out = C.project(_embeddings(spark, d), "v", _W, _BIAS)
    return out.select("vec_id", F.posexplode("projected").alias("pos", "x")).select("vec_id", "pos", (F.round("x", 5) + 0).alias("x"))


@query(f"WITH e AS (SELECT vec_id, list_transform({_V}, lambda x: x / 20) AS v FROM embeddings), t AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM e), l AS (SELECT vec_id, list_transform(range(1, 4), lambda r: atanh(n) / n * list_sum(list_transform(range(1, 65), lambda i: (r * i % 7 - 3) / 10.0 * v[i]))) AS l FROM t), p AS (SELECT vec_id, l, {_soft('l')} AS p FROM l) SELECT vec_id, ['a', 'b', 'c'][list_position(l, list_max(l))] AS category, round(list_max(p), 5) AS confidence FROM p")
def vec05_tangent_classes(spark, d):
    small = _embeddings(spark, d).select("vec_id", X.scaled(F.col("v"), F.lit(1 / 20)).alias("v"))
    return C.classify_tangent(small, "v", _W, ["a", "b", "c"]).select("vec_id", "category", F.round("confidence", 5).alias("confidence"))


_AT = [[0.01 * (k + 1) * (1 if i % (k + 2) else -1) for i in range(64)] for k in range(3)]
_GAP = "acosh(1 + 2 * list_sum(list_transform(range(1, 65), lambda i: pow(v[i] - c[i], 2))) / (greatest(1 - list_sum(list_transform(v, lambda x: x * x)), 1e-5) * greatest(1 - list_sum(list_transform(c, lambda x: x * x)), 1e-5)))"
_PLACED = f"e AS (SELECT vec_id, list_transform({_V}, lambda x: x / 100) AS v FROM embeddings), c AS (SELECT CAST(k AS INT) AS label, list_transform(range(64), lambda i: 0.01 * (k + 1) * CASE WHEN i % (k + 2) = 0 THEN -1 ELSE 1 END) AS c FROM range(3) r(k)), g AS (SELECT vec_id, label, {_GAP} AS d FROM e, c), b AS (SELECT vec_id, arg_min(label, d) AS label, min(d) AS d FROM g GROUP BY 1)"


def _placed(spark, d):
    points = _embeddings(spark, d).select("vec_id", X.scaled(F.col("v"), F.lit(1 / 100)).alias("v"))
    return C.nearest(points, F.col("v"), _AT)


@query(f"WITH {_PLACED} SELECT vec_id, label, round(exp(-d), 5) AS confidence, exp(-d) > 0.7 AS is_known FROM b")
def mdl07_nearest_centroid(spark, d):
    return _placed(spark, d).select("vec_id", "label", F.round("confidence", 5).alias("confidence"), "is_known")


@query(f"WITH {_PLACED} SELECT label, count(*) AS n, round(avg(exp(-d)), 5) AS confidence FROM b WHERE exp(-d) > 0.5 GROUP BY 1")
def flt11_known_only(spark, d):
    known = _placed(spark, d).where("confidence > 0.5")
    return known.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 5).alias("confidence"))


@query(f"SELECT round(avg(CAST(category = CASE id % 5 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' ELSE '5-LOW' END AS INT)), 6) AS rate, count(*) AS n FROM {_L}")
def agg21_agreement(spark, d):
    guess = F.when(F.col("id") % 5 == 0, "1-URGENT").when(F.col("id") % 5 == 1, "2-HIGH").otherwise("5-LOW")
    return C.agreement(adapted(spark, d, "ledger").withColumn("guess", guess), "category", "guess").select(F.round("rate", 6).alias("rate"), "n")


@query(f"SELECT category, count(*) AS n FROM {_P} GROUP BY 1 HAVING count(*) < 40")
def agg22_thin_classes(spark, d):
    return C.thin_classes(adapted(spark, d, "purchases"), "category", 40)


@query(f"SELECT DISTINCT category AS name FROM {_L} WHERE id % 7 = 0")
def agg27_updated_categories(spark, d):
    return D.distinct_sorted(adapted(spark, d, "ledger").where("id % 7 = 0"), F.col("category"), "name")


def _jobs(spark, d):
    status = F.when(F.col("status") == "O", "pending").when(F.col("status") == "F", "completed").otherwise("processing")
    return adapted(spark, d, "ledger").select("id", "user_id", status.alias("status"), F.lit(2).alias("attempts"), F.col("transaction_date").alias("created_at"))


@query(f"SELECT id, transaction_date AS created_at FROM {_L} WHERE status = 'O' ORDER BY transaction_date, id LIMIT 1")
def top05_next_pending(spark, d):
    return J.next_pending(_jobs(spark, d)).select("id", "created_at")


@query(f"SELECT id, CASE WHEN id = 3 AND status NOT IN ('O', 'F') THEN 'failed' WHEN id = 1 AND status = 'O' THEN 'processing' WHEN status = 'O' THEN 'pending' WHEN status = 'F' THEN 'completed' ELSE 'processing' END AS status FROM {_L}")
def mdl17_moves(spark, d):
    return J.failed_or_retried(J.moved(_jobs(spark, d), 1, "pending", "processing").where("id <> 1"), 3).unionByName(J.moved(_jobs(spark, d), 1, "pending", "processing").where("id = 1")).select("id", "status")


@query(f"SELECT id, amount FROM {_L} WHERE user_id = 7")
def src12_scan(spark, d):
    path = fresh_path(spark, "scan")
    adapted(spark, d, "ledger").write.parquet(path)
    return R.ledger_scan(spark, path, 7, ["id", "amount"])


@query(f"SELECT id FROM {_L} WHERE id % 3 = 0 AND transaction_date > DATE '1997-06-30'")
def src14_changed(spark, d):
    rows = adapted(spark, d, "ledger").withColumns({"is_manual": F.col("id") % 3 == 0, "updated_at": F.col("transaction_date")})
    return R.changed_since(rows, "1997-06-30").select("id")


_SEG = "upper(trim(s))"
_NOISE = ", ".join(f"'{x}'" for x in T.V.NOISE_SEGMENTS)


@query(f"SELECT DISTINCT s, {_SEG} = '' OR regexp_matches({_SEG}, '^[A-Z0-9._-]{{10,}}$') OR regexp_matches({_SEG}, '^[0-9]{{6,}}$') OR regexp_matches({_SEG}, '^ICI[A-Z0-9]+$') OR regexp_matches({_SEG}, '^[A-Z]{{2,5}}\\d{{6,}}$') OR {_SEG} IN ({_NOISE}) AS noise FROM (SELECT unnest(string_split(description, '/')) AS s FROM {duck('lines')})")
def cln05_noise(spark, d):
    parts = adapted(spark, d, "lines").select(F.explode(F.split("description", "/")).alias("s")).distinct()
    return parts.select("s", T.is_noise_segment(F.col("s")).alias("noise"))


@query()
def mdl10_metric_fit(spark, d):
    """Every vector's place on the ball under the fitted projection, and how far out it is."""
    df = table(spark, d, "embeddings")
    model = MetricLearner("vec_id", "embedding", "label", 64, epochs=10).fit(df)
    return model.transform(df).select("vec_id", "label", F.transform("projected", lambda x: F.round(x, 6)).alias("projected"), F.round(X.norm(F.col("projected")), 6).alias("norm"))
