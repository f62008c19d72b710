"""Models and random views against plain versions of themselves."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import augment as A
from ledgerloom.functions import text as T
from ledgerloom.operators import clusters as C


def points(n=60, seed=3):
    rng = np.random.default_rng(seed)
    middles = np.array([[0.5, 0.1, 0.0], [-0.4, 0.3, 0.1], [0.0, -0.5, 0.2]])
    return [(i, (middles[i % 3] + 0.05 * rng.normal(size=3)).tolist()) for i in range(n)]


def np_log(c, p):
    sub = C.np_mobius_add(-c, p)
    n = np.linalg.norm(sub)
    return sub * 0 if n == 0 else (1 - c @ c) * np.arctanh(n) * sub / n


def np_mean(ps, steps):
    at = C.np_exp0(np.mean([np.arctanh(np.linalg.norm(p)) * p / np.linalg.norm(p) for p in ps], 0))
    for _ in range(steps):
        move = np.mean([np_log(at, p) for p in ps], 0)
        at = C.np_exp(at, move)
        if np.linalg.norm(move) < 1e-5:
            break
    return at


def test_frechet_mean(spark):
    df = spark.createDataFrame([(0, v) for _, v in points(20)], "label long, v array<double>")
    got = C.frechet_means(df, "label", "v", 10)[0]
    ps = [np.array(v) for _, v in points(20)]
    assert np.allclose(got, np_mean(ps, 10), atol=1e-9)
    assert np.linalg.norm(np.mean([np_log(got, p) for p in ps], 0)) < 1e-4


def test_kmeans_equals_numpy(spark):
    df = spark.createDataFrame(points(), "id long, v array<double>").repartition(3)
    at = [np.array(c) for c in C.seeds(df, "id", "v", 3)]
    ps = [np.array(v) for _, v in points()]
    for _ in range(20):
        label = [int(np.argmin([C.np_distance(p, c) for c in at])) for p in ps]
        new = [np_mean([p for p, x in zip(ps, label, strict=True) if x == k], 3) if k in label else c for k, c in enumerate(at)]
        shift = max(C.np_distance(a, b) for a, b in zip(at, new, strict=True))
        at = new
        if shift < 1e-4:
            break
    assert np.allclose(C.kmeans(df, "id", "v", 3), at, atol=1e-6)


def test_seeds_of_repeated_points(spark):
    df = spark.createDataFrame([(i, [0.1, 0.0]) for i in range(50)] + [(50, [0.2, 0.0])], "id long, v array<double>")
    assert sorted(C.seeds(df, "id", "v", 2)) == [[0.1, 0.0], [0.2, 0.0]]


def test_discovered_clusters(spark):
    df = spark.createDataFrame([(i, v, f"t{i}") for i, v in points()], "id long, v array<double>, t string")
    found = C.discover(df, "id", "v", "t", 3).collect()
    placed = {r.id: r.label for r in C.nearest(df, F.col("v"), C.kmeans(df, "id", "v", 3)).collect()}
    for r in found:
        own = sorted(i for i, k in placed.items() if k == r.cluster_id)
        assert r.n == len(own) and r.samples == [f"t{i}" for i in own[:5]]
    with pytest.raises(ValueError):
        C.discover(df.limit(5), "id", "v", "t", 3)


def embedded(text, dims=64):
    v = np.zeros(dims)
    ws = text.lower().split()
    for t in [*ws, *(w[j : j + 3] for w in ws for j in range(max(1, len(w) - 2)))]:
        h = zlib.crc32(t.encode())
        v[h % dims] += 1 - 2 * (h >> 20 & 1)
    return v / (np.linalg.norm(v) or 1)


def test_predictions_in_plain_python(spark):
    texts = ["qzx blorp", "hospital visit zz", "", None, "qqq salary thing", "NETFLIX.COM", "xx yy zz", "xx yy zz"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, d string")
    anchors = {k: np.mean([embedded(p) for p in ps], 0) for k, ps in C.ANCHOR_PHRASES.items()}
    cleaned = {r.id: (r.c or r.d or "", r.rule) for r in df.select("id", "d", T.clean_description("d").alias("c"), T.keyword_category(T.clean_description("d")).alias("rule")).collect()}
    got = {r.id: r for r in C.predict(df, "d").collect()}
    assert set(got) == set(range(len(texts)))
    for i, (text, rule) in cleaned.items():
        if rule is not None:
            assert (got[i].category, got[i].confidence) == (rule, 1.0)
            continue
        gap, name = min((np.linalg.norm(embedded(text) - v), k) for k, v in anchors.items())
        assert abs(got[i].confidence - np.exp(-gap)) < 1e-9
        guarded = name if name != "Salary" or any(w in text.lower() for w in ("salary", "payroll", "stipend", "credited", "wage")) else "Misc"
        assert got[i].category == guarded


def test_dropout_follows_its_chances(spark):
    df = spark.createDataFrame([(i, "a b a c d e a") for i in range(40)], "id long, t string")
    chances = {r.id: list(r.c) for r in df.select("id", F.array(*[A.chance(F.col("id"), F.lit(k), 0) for k in range(7)]).alias("c")).collect()}
    tf = {"a": 1.0} | dict.fromkeys("bcde", 1 / 3)
    for r in A.frequency_dropout(df, "id", "t", A.term_frequency(df, "t"), p=0.6).collect():
        left = [w for w, c in zip("abacdea", chances[r.id], strict=True) if c >= 0.6 * tf[w]]
        assert r.view == " ".join(left or "abacdea")


def test_substring_views(spark):
    df = spark.createDataFrame([(i, "a b c d e f") for i in range(50)] + [(50, "a b"), (51, "")], "id long, t string")
    views = {r.id: r.v for r in df.select("id", A.substring_view(F.col("id"), F.col("t")).alias("v")).collect()}
    assert all(v in "a b c d e f" and len(v.split()) >= 2 for i, v in views.items() if i < 50) and len(set(views.values())) > 5
    assert (views[50], views[51]) == ("a b", "")


def test_progress_of_a_stream(spark, tmp_path):
    import time

    from ledgerloom.streaming import ingest as I

    rows = spark.range(200).select((F.col("id") % 7).alias("user_id"), F.col("id").cast("string").alias("fingerprint"), "id")
    rows.repartition(1).write.parquet(f"{tmp_path}/in")
    said = []
    listener = I.Progress(400, said.append)
    spark.streams.addListener(listener)
    try:
        I.ingest(spark, f"{tmp_path}/in", rows.schema, f"{tmp_path}/ledger", f"{tmp_path}/state", ["user_id", "fingerprint"], "id").awaitTermination()
        for _ in range(50):
            if said[-1:] == [100]:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert said == [50, 100]
    steps = I.Progress(1000, said.append)
    for _ in range(25):
        steps.seen(40)
    assert said[2:] == [10, 20, 30, 40, 50, 60, 70, 80, 90, 100]
