"""Operators and pipeline stages against plain versions of themselves."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_dedup import brute_classes, prose, words
from test_operators import check_packing, crc, encoded

from ledgerloom.llm import bitplane, langbloom, quality_rff, token_count, vp8l, webp_columns, wu_manber
from ledgerloom.llm import gear_dedup as G
from ledgerloom.llm.shared import temporary
from ledgerloom.llm.tokenization import public_path, tokenizer

TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


# ---- repeated passages by comparing all places of all texts


def common_runs(a: bytes, b: bytes, least: int) -> list[tuple[int, int, int]]:
    """(start in a, end in a, words) of the longest runs of whole words, and what stands between them, that both hold."""
    wa, wb = ([(m.start(), m.end()) for m in TOKEN.finditer(t)] for t in (a, b))
    out = []
    for i in range(len(wa)):
        for j in range(len(wb)):
            same = lambda x, y: x >= 0 and y >= 0 and x < len(wa) and y < len(wb) and a[slice(*wa[x])] == b[slice(*wb[y])]
            joined = lambda x, y: a[wa[x][1] : wa[x + 1][0]] == b[wb[y][1] : wb[y + 1][0]]
            if not same(i, j) or (same(i - 1, j - 1) and joined(i - 1, j - 1)):
                continue
            n = 1
            while same(i + n, j + n) and joined(i + n - 1, j + n - 1):
                n += 1
            if n >= least:
                out.append((wa[i][0], wa[i + n - 1][1], n))
    return out


def plain_passages(texts: dict[int, str | None], least: int = 50) -> set[tuple[int, int, int]]:
    """(doc_id, start, words): the later occurrences, for texts of which no passage occurs more than twice."""
    ids = sorted(texts)
    raw = {i: (texts[i] or "").encode() for i in ids}
    return {(i, s, n) for k, i in enumerate(ids) for j in ids[:k] for s, _, n in common_runs(raw[i], raw[j], least)}


def passage_texts(rng):
    shared = [prose(rng, 55 + 2 * i) for i in range(12)]
    texts = [f"{prose(rng, 20)} {x}, {prose(rng, 15)}" for x in shared]
    texts += [f"{prose(rng, 9)}; {x}! {prose(rng, 25)}" for x in shared]
    texts += [prose(rng, 60) for _ in range(6)] + [None, "", "few words", "ü " * 300]
    return dict(enumerate(texts))


def test_passages_equal_all_places_compared(docs_of):
    texts = passage_texts(random.Random(31))
    got = G.repeated_passages(docs_of(list(texts.items()))).collect()
    assert {(r.doc_id, r.start, r.n_words) for r in got} == plain_passages(texts)
    for r in got:
        kept = texts[r.keep_doc_id].encode()
        assert kept[r.keep_start : r.keep_start + r.length] == r.passage.encode() and (r.keep_doc_id, r.keep_start) < (r.doc_id, r.start)


def maximal_passages(texts, least=50):
    """(doc_id, start, words) of each text's longest runs with any text before it, those within longer ones left out."""
    ids = sorted(texts)
    raw = {i: (texts[i] or "").encode() for i in ids}
    out = set()
    for k, i in enumerate(ids):
        found = sorted({(s, e, n) for j in ids[:k] for s, e, n in common_runs(raw[i], raw[j], least)}, key=lambda x: (x[0], -x[1]))
        reach = -1
        for s, e, n in found:
            if e > reach:
                reach = e
                out.add((i, s, n))
    return out


def check_kept(got, texts):
    for r in got:
        assert texts[r.keep_doc_id].encode()[r.keep_start : r.keep_start + r.length] == r.passage.encode() == texts[r.doc_id].encode()[r.start : r.start + r.length]


def test_parts_from_different_texts_make_no_passage(docs_of):
    rng = random.Random(77)
    texts = []
    for _ in range(30):
        a, b, c = (prose(rng, 24) for _ in range(3))
        texts += [f"{prose(rng, 9)} {a} {b} {prose(rng, 9)}", f"{prose(rng, 9)} {b} {c} {prose(rng, 9)}", f"{prose(rng, 9)} {a} {b} {c} {prose(rng, 9)}"]
    docs = docs_of(texts)
    assert maximal_passages(dict(enumerate(texts))) == set() and G.repeated_passages(docs).count() == 0
    assert {r.doc_id: r.text for r in G.remove_repeats(docs).collect()} == dict(enumerate(texts))


def test_passages_that_overlap_and_occur_often(docs_of):
    rng = random.Random(78)
    texts = []
    for _ in range(8):
        a, b, c = (prose(rng, rng.choice([24, 40, 70])) for _ in range(3))
        parts = [[a, b], [b, c], [a, b, c], [c, a, b]]
        texts += [" ".join([prose(rng, 9), *p, prose(rng, 9)]) for p in parts]
    # and passages that stand in many texts and, last, twice in one
    often = prose(rng, 66)
    texts += [f"{prose(rng, 12)} {often} {prose(rng, 12)}" for _ in range(6)]
    texts = dict(enumerate(texts))
    got = G.repeated_passages(docs_of(list(texts.items()))).collect()
    check_kept(got, texts)
    assert {(r.doc_id, r.start, r.n_words) for r in got} == maximal_passages(texts) and len(got) > 15
    twice = {0: f"{prose(rng, 12)} {often} {prose(rng, 12)} {often} {prose(rng, 3)}"}
    got = G.repeated_passages(docs_of(list(twice.items()))).collect()
    check_kept(got, twice)
    assert [(r.n_words, r.keep_start < r.start) for r in got] == [(66, True)]


def test_two_texts_under_one_id_are_two_documents(docs_of):
    rng = random.Random(79)
    shared, own = prose(rng, 80), prose(rng, 300)
    rows = [(1, f"{prose(rng, 9)} {shared} {prose(rng, 9)}"), (5, f"{prose(rng, 90)} {shared} {prose(rng, 30)}"), (5, own), (5, own)]
    cut = sorted(r.text for r in G.remove_repeats(docs_of(rows)).collect())
    assert cut == sorted([rows[0][1], rows[1][1].replace(f"{shared} ", ""), own, own]) or cut == sorted([rows[0][1], rows[1][1].replace(shared, ""), own, own])


# ---- the pipeline's stages


def corpus():
    rng = random.Random(5)
    good = [prose(rng, 90) + ". " + prose(rng, 30) for _ in range(30)]
    near = [" ".join(w if k else "changed" for k, w in enumerate(t.split())) for t in good[:8]]
    texts = [*good, *near, *good[:4]]
    texts += [x for x in passage_texts(rng).values() if x and len(x) > 200]
    texts += [prose(rng, 20) + " one two three four five six seven eight nine ten eleven " + prose(rng, 20) for _ in range(3)]
    junk = ["$$ ## 12 !! 9 @@ 77 %% " * 10 + str(i) for i in range(20)]
    return [*enumerate([*texts, *junk, None, ""], 100)]


def plain_hit(text, window=["one two three four five six seven eight nine ten".split(), "two three four five six seven eight nine ten eleven".split()]):
    w = [m.decode().lower() for m in TOKEN.findall((text or "").encode())]
    return any(w[i : i + 10] in window for i in range(len(w) - 9))


def test_stages_equal_plain_versions(spark, docs_of, tmp_path):
    import corpus_pipeline as P

    rows = corpus()
    n_good = len(rows) - 22
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(k < n_good), 0) for k, (i, _) in enumerate(rows)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("b", "One two three four five six seven eight nine ten eleven")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages, sf = dict(P.STAGES), str(tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    take = lambda df: {r.doc_id: r.text for r in df.collect()}

    scored = {r.doc_id for r in quality_rff.score_table(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect() if r.score >= 0.5}
    good = stages["quality"](spark, docs, sf).cache()
    assert set(take(good)) == scored
    # clean ones stay, junk goes
    assert {i for i, _ in rows[:n_good]} <= scored and not scored & {i for i, _ in rows[n_good:-2]}

    classes = brute_classes(sorted(take(good).items()))
    one = stages["near_dedup"](spark, good, sf).cache()
    assert set(take(one)) == set(classes.values())

    texts, cut = take(one), stages["substring_dedup"](spark, one, sf).cache()
    want = {}
    for i, t in texts.items():
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for j in texts:
            for s, e, _ in common_runs(raw, (texts[j] or "").encode(), 50) if j < i else []:
                gone[s:e] = True
        want[i] = t if not gone.any() else raw, gone
    got = take(cut)
    assert set(got) == set(want)
    for i, (t, gone) in want.items():
        # what stands after a passage's last word may be common too
        assert words(got[i]) == words(t if not gone.any() else np.frombuffer(t, np.uint8)[~gone].tobytes().decode())

    clean = stages["decontamination"](spark, cut, sf).cache()
    assert take(clean) == {i: t for i, t in got.items() if not plain_hit(t)}

    order = {i: k for k, i in enumerate(sorted(take(clean)))}
    from pyspark.sql import Row

    packed = [Row(**{**r.asDict(), "doc_id": order[r.doc_id]}) for r in stages["packing"](spark, clean, sf).collect()]
    check_packing([take(clean)[i] for i in order], packed)
    assert P.run(spark, sf).count() == len(packed)


CLASH = "doc_id long, text string, lang string, source string, n_chars long, __id long, __hash string, __text string, __runs string, id string, runs string, _id string, stats string, doc string, text_hash string, block string, spans string, stays boolean"


@pytest.mark.parametrize("n", [0, 9])
def test_stages_keep_odd_rows_and_columns(spark, tmp_path, n):
    import corpus_pipeline as P

    long = " ".join(f"w{i % 977}" for i in range(60_000))
    base = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "other words under one id"), (None, "t"), (2, None), (3, ""), (4, "ü " * 3000), (5, long), (6, long + " end")]
    rows = [(i, t, None, None, None if t is None else len(t), 7, "x", "y", "z", "i", "r", "_", "s", "d", "h", "b", "p", True) for i, t in base[:n]]
    docs = spark.createDataFrame(rows, CLASH)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (4, None, None), (None, 1, 1)][:n], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "zebra d e f"), (None, "x"), (2, None)][:n], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == [c.split()[0] for c in CLASH.split(", ")]
        left = Counter((r.doc_id, r.text and r.text[:9]) for r in docs.collect())
        assert (sum(left.values()) > 0) == (n > 0), name
    if n:
        # one row of the repeated one, the other text under its id, the rows without words or id, and one of the long copies
        assert left == Counter({(1, "a b c d e"): 1, (1, "other wor"): 1, (None, "t"): 1, (2, None): 1, (3, ""): 1, (4, "ü ü ü ü ü"): 1, (5, long[:9]): 1})


# ---- quality


def test_statistics_in_plain_python():
    text = "Two words.\nTwo WORDS again again\nTwo words."
    data = np.frombuffer(text.encode(), np.uint8)
    got = quality_rff.statistics(data, np.array([0, len(data)]))[0]
    own = words(text)
    plain = [w.group() for w in re.finditer(r"[0-9A-Za-z]+", text)]
    lens = [len(w) for w in own]
    mean = sum(lens) / len(lens)
    want = [math.log1p(len(text)), 2 / 3, math.log1p(len(text) / 3), math.log1p(len(own)), len(set(own)) / len(own), max(Counter(own).values()) / len(own), mean, math.sqrt(sum((x - mean) ** 2 for x in lens) / len(lens)), sum(w.isupper() for w in plain) / len(own), 1 / len(own)]
    assert np.allclose(got[len(quality_rff._GROUPS) :], want)
    share = lambda group: math.sqrt(sum(c in group for c in text) / len(text))
    assert np.allclose(got[: len(quality_rff._GROUPS)], [share(g.decode("latin-1")) for g in quality_rff._GROUPS])


def test_fit_solves_the_normal_equations(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, quality_rff.N_STATS))
    y = (x[:, 0] + 0.3 * rng.normal(size=300) > 0.4).astype(float)
    df = spark.createDataFrame([(list(map(float, r)), float(t)) for r, t in zip(x, y, strict=True)], "stats array<double>, y double").repartition(5)
    model = quality_rff.fit(df)
    phi = quality_rff.Fourier(x.mean(0), x.std(0))(x)
    weight = np.where(y > 0.5, 300 / (2 * y.sum()), 300 / (2 * (300 - y.sum())))
    direct = np.linalg.solve(phi.T @ (phi * weight[:, None]) + quality_rff.RIDGE * np.eye(phi.shape[1]), phi.T @ (weight * y))
    assert np.allclose(model.beta, direct, atol=1e-6)
    score = model.score(x)
    order = np.argsort(phi @ direct)
    assert (np.diff(score[order]) >= 0).all() and ((score >= 0.5) == (y > 0.5)).mean() > 0.85


# ---- languages


def test_filters_against_exact_sets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text or "", r.lang) for r in docs.collect()]
    fold = lambda t: bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in t.encode())

    def grams(t):
        raw = b" " + fold(t) + b"   "
        return [raw[i : i + 4] for i in range(len(raw) - 3) if raw[i : i + 4].count(b" ") < 3]

    import zlib

    counts = defaultdict(Counter)
    for i, t, lang in rows:
        if lang is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            counts[lang].update(grams(t))
    totals = {k: sum(c.values()) for k, c in counts.items()}
    langs = sorted(totals, key=lambda k: (-totals[k], k))
    share = {k: {g: n / totals[k] for g, n in counts[k].items()} for k in langs}
    kept = {k: {g for g, p in share[k].items() if p >= langbloom.MIN_SHARE} for k in langs}
    got = {r.doc_id: r for r in langbloom.identify(docs).collect()}
    same = near = n = 0
    for i, t, _ in rows:
        if not any(c.isalpha() for c in t):
            assert got[i].lang_pred == "und"
            continue
        hits = [sum(g in kept[k] for g in grams(t)) for k in langs]
        n += 1
        same += langs[int(np.argmax(hits))] == got[i].lang_pred
        near += abs(max(hits) / max(1, sum(hits)) - got[i].score) < 0.03
    assert same >= 0.98 * n and near >= 0.95 * n


# ---- the others


def test_many_test_items_take_one_pass_at_a_time(spark, docs_of):
    items = spark.createDataFrame([(f"i{i}", prose(random.Random(i), 12)) for i in range(30)], "item_id string, text string")
    found = wu_manber.find_contamination(docs_of([prose(random.Random(i), 12) for i in range(25, 35)]), items, block_bytes=400)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert sorted(r.doc_id for r in found.where("contaminated").collect()) == [0, 1, 2, 3, 4]


def test_files_of_ids_roll(docs_of):
    texts = [None, "", *(prose(random.Random(i), 5 + i) for i in range(60))]
    files = bitplane.write_ids(docs_of(texts).repartition(3), block=64, file_docs=7, files=2)
    assert files.count() >= 9
    start = 0
    got = {r.doc_id: r for r in bitplane.read_ids(files).collect()}
    for i, t in enumerate(texts):
        ids = [*encoded(t), 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)


def test_token_counts_with_special_strings_and_odd_letters(docs_of):
    tok = tokenizer(public_path("word_bpe_49k.json"))
    rng = random.Random(8)
    letters = "abcXYZ'.,!19 \n\t\x1cİıक़é́ßσΣ東🎉ﬁ  "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 60))) for _ in range(1500)]
    texts += ["<|endoftext|>", "a<|endoftext|>b <|startoftext|>", "word İ " * 9000 + "<|endoftext|>" + "more, words. " * 6000, "<|startoftext|>" * 3000]
    got = {r.doc_id: r.n_tokens for r in token_count.count_tokens(docs_of(texts)).collect()}
    assert got == {i: len(tok.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
    for t in texts[:300]:
        if len(t) > 20:
            assert token_count.spliced_count(tok, t * 3, 40, 8) == len(tok.encode(t * 3, add_special_tokens=False).ids)


def by_hand(width, height, *pieces):
    """A file of bits, given as (value, bits)."""
    value = at = 0
    for v, n in [(0x2F, 8), (width - 1, 14), (height - 1, 14), (0, 1), (0, 3), *pieces]:
        value |= v << at
        at += n
    body = value.to_bytes(-(-at // 8), "little")
    body += b"\0" * (len(body) & 1)
    return b"RIFF" + (12 + len(body)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body


def one_colour(green, red, blue, alpha, main=True):
    """An image without cache or groups, all of whose codes have one symbol, so that no pixel takes a bit."""
    code = lambda s: [(1, 1), (0, 1), (1, 1), (s, 8)]
    return [(0, 1), *([(0, 1)] if main else []), *code(green), *code(red), *code(blue), *code(alpha), *code(0)]


def test_files_made_by_hand():
    assert vp8l.decode(by_hand(2, 2, (0, 1), *one_colour(0x12, 0x34, 0x56, 255))).tolist() == [[0xFF341256] * 2] * 2
    # predictor of the left pixel; the first one is black
    left = [(1, 1), (0, 2), (0, 3), *one_colour(1, 0, 0, 255, False)]
    assert vp8l.decode(by_hand(3, 1, *left, (0, 1), *one_colour(5, 1, 0, 0))).tolist() == [[0xFF010500, 0xFF020A00, 0xFF030F00]]
    # green to red with factor 32/32
    cross = [(1, 1), (1, 2), (0, 3), *one_colour(0, 0, 32, 255, False)]
    assert vp8l.decode(by_hand(1, 1, *cross, (0, 1), *one_colour(5, 1, 2, 255))).tolist() == [[0xFF060502]]
    assert vp8l.decode(by_hand(1, 1, (1, 1), (2, 2), (0, 1), *one_colour(5, 250, 2, 255))).tolist() == [[0xFFFF0507]]
    # one colour in the palette, eight indices in a pixel
    palette = [(1, 1), (3, 2), (0, 8), *one_colour(7, 8, 9, 255, False)]
    assert vp8l.decode(by_hand(9, 1, *palette, (0, 1), *one_colour(0, 0, 0, 255))).tolist() == [[0xFF080709] * 9]


def test_layouts_and_features(docs_of):
    rng = random.Random(3)
    texts = ["", "aaaa", prose(rng, 300), prose(rng, 300) * 2, prose(rng, 4000), "é" * 9000, "ab" * 20_000]
    for t in texts:
        payload = webp_columns.payload_of(t.encode())
        assert webp_columns.decode_payload(webp_columns.encode_payload(payload)) == payload
    row = webp_columns.media_digests(docs_of([texts[2]])).first()
    x = texts[2].encode() + b" " * (-len(texts[2].encode()) % 192)
    mean = sum(x) / len(x)
    deviation = math.sqrt(sum((b - mean) ** 2 for b in x) / len(x))
    entropy = -sum(n / len(x) * math.log2(n / len(x)) for n in Counter(x).values())
    bits = "".join(str(int(sum(x[i * len(x) // 64 : (i + 1) * len(x) // 64]) > mean * ((i + 1) * len(x) // 64 - i * len(x) // 64))) for i in range(64))
    assert row.feature == f"{mean:.4f}:{deviation:.4f}:{entropy:.4f}:{int(bits, 2):016x}"
    assert row.payload_sha256 == hashlib.sha256(x).hexdigest()


def test_temporary_tables_go(spark, docs_of, tmp_path):
    from pathlib import Path

    from ledgerloom import staging

    docs = docs_of([prose(random.Random(1), 60)] * 2)
    folder = Path(staging.shared_dir(spark).removeprefix("file://")) / "ledgerloom"
    before = set(folder.iterdir()) if folder.exists() else set()
    with temporary(spark):
        G.repeated_passages(docs).write.parquet(f"{tmp_path}/out")
    assert set(folder.iterdir()) == before and spark.read.parquet(f"{tmp_path}/out").count() == 1


def test_long_texts_are_scored_whole(spark, docs_of):
    rng = random.Random(2)
    long = prose(rng, 200_000)
    docs = docs_of([long, prose(rng, 60), "$$ ## 12 !! " * 20, None])
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (2, 0, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in quality_rff.score_table(docs, labels).collect())
    got = {r.doc_id: r for r in langbloom.identify(docs).collect()}
    assert got[0].lang_pred == got[1].lang_pred == "aa" and got[3].lang_pred == "und"
    data = np.frombuffer(long.encode(), np.uint8)
    assert math.isclose(quality_rff.statistics(data, np.array([0, len(data)]))[0][len(quality_rff._GROUPS)], math.log1p(len(data)))


def test_preferences_of_empty_tables_and_extra_columns(spark):
    from ledgerloom.llm import preference

    turns = spark.createDataFrame([(1, 0, "user", "q", "x", 1), (1, 1, "assistant", "a", "y", 2)], "pair_id long, turn long, role string, text string, c string, n long")
    assert preference.preference_pairs(turns.limit(0), turns).count() == 0
    other = turns.withColumn("text", turns.c)
    r = preference.preference_pairs(turns, other).first()
    assert (r.n_prefix_turns, r.prompt) == (0, "") and r.chosen.startswith("<|im_start|>user\nq")
    same = preference.preference_pairs(turns, turns).first()
    assert (same.n_prefix_turns, same.chosen, same.rejected) == (2, "", "")
