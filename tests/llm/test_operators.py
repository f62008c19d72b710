"""The other operators against the libraries, brute force, round trips and held-out labels."""

import hashlib
import random
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest

from ledgerloom.llm import bitplane, langbloom, packing, preference, quality_rff, queries, token_count, vp8l, webp_columns, wu_manber
from ledgerloom.llm.tokenization import public_path, tokenizer

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SF = "/root/testdata/sf0.001"
TEXTS = [None, "", " ", "a", "Hello, world.  Two  blanks\n\nand\tlines\r\n", "naïve café — “quotes” 東京 🎉", "<|endoftext|> said <|startoftext|>", "x" * 5000, "end ", " begin", "don't we'll 12,345.67 A.B.C", "word " * 3000, "a\0b", "É.", "ab,cd. ef\n gh\n"]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def encoded(text):
    return tokenizer(public_path("byte_bpe_50k.json")).encode(text or "", add_special_tokens=False).ids


def random_texts(n, seed=4):
    rng = random.Random(seed)
    letters = "abcdefgh ABC.,\n éß1239-_'\"()  \t日本🎉"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 400))) for _ in range(n)]


def test_media_round_trip(docs_of):
    texts = TEXTS + random_texts(20) + ["ab" * 200_000]
    rows = {r.doc_id: r for r in webp_columns.media_digests(docs_of(texts)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert rows[0].media_sha256 == rows[1].media_sha256


@pytest.mark.parametrize("colours", [2, 5, 300, 1 << 20])
def test_webp_images(colours):
    rng = np.random.default_rng(colours)
    px = (rng.integers(0, colours, (37, 53)).astype(np.uint32) * np.uint32(2654435761)) | np.uint32(0xFF000000)
    assert (vp8l.decode(vp8l.encode(px)) == px).all()
    assert (vp8l.decode(vp8l.encode(px, cache_bits=7)) == px).all()


@pytest.mark.parametrize("seed", [1, 2])
def test_webp_transforms_and_groups(seed):
    rng = np.random.default_rng(seed)
    px = rng.integers(0, 1 << 24, (37, 53)).astype(np.uint32) | np.uint32(0xFF000000)
    modes = (np.arange(10 * 14).reshape(10, 14) % 14).astype(np.uint32)
    elements = rng.integers(0, 1 << 24, (10, 14)).astype(np.uint32) | np.uint32(0xFF000000)
    predictor, cross, green = (vp8l.PREDICTOR, modes, 2), (vp8l.CROSS_COLOR, elements, 2), (vp8l.SUBTRACT_GREEN,)
    for transforms in ((predictor,), (cross,), (green,), (predictor, cross, green), (green, cross, predictor)):
        assert (vp8l.decode(vp8l.encode(px, transforms)) == px).all()
    groups = rng.integers(0, 3, (10, 14))
    assert (vp8l.decode(vp8l.encode(px, (predictor,), groups=groups, block=2)) == px).all()


def test_decontamination_is_brute_force(spark, docs_of):
    items = [("1", "one two three four five six seven eight nine ten eleven twelve"), ("2", "Short, item!"), ("3", ""), ("4", None), ("5", "solo"), ("6", "one two three four five six seven eight nine ten eleven twelve")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    rng = random.Random(3)
    pool = "one two three four five six seven eight nine ten eleven twelve short item solo é".split()
    texts = [None, "", "x ONE-two three four five six seven eight nine TEN! y", "short item", "shortitem", "solo"] + [" ".join(rng.choice(pool) for _ in range(rng.randrange(0, 60))) for _ in range(60)]
    texts.append(" ".join(pool * 3000))

    def found(text):
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        w = WORD.findall(low)
        hit, ids = set(), set()
        for item, t in items:
            p = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
            for win in [p[i : i + 10] for i in range(len(p) - 9)] if len(p) >= 10 else [p] if p else []:
                for a in range(len(w) - len(win) + 1):
                    if w[a : a + len(win)] == win:
                        hit.update(range(a, a + len(win)))
                        ids.add(item)
        return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)

    docs = docs_of(texts)
    for block in (1 << 20, 40):
        got = {r.doc_id: r[1:6] for r in wu_manber.find_contamination(docs, bench, block_bytes=block).collect()}
        assert got == {i: found(t) for i, t in enumerate(texts)}
    kept = {r.doc_id for r in wu_manber.drop_contaminated(docs, bench).collect()}
    assert kept == {i for i, t in enumerate(texts) if not found(t)[4]}
    assert wu_manber.find_contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def check_packing(texts, rows, length=1024):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(range(len(texts)))
    for i, t in enumerate(texts):
        ids = [*encoded(t), 0]
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= length
    return sum(r.length for r in rows) / (length * len(sequences))


def test_packing(docs_of):
    texts = TEXTS + random_texts(300)
    rows = packing.pack(docs_of(texts).repartition(7)).collect()
    assert check_packing(texts, rows) > 0.95
    assert packing.pack(docs_of(["a"]).limit(0)).count() == 0


@pytest.mark.parametrize("unit", ["bit", "byte"])
def test_bit_planes_round_trip(docs_of, unit):
    texts = TEXTS + random_texts(50)
    docs = docs_of(texts).repartition(5)
    got = {r.doc_id: r for r in bitplane.read_ids(bitplane.write_ids(docs, block=500, unit=unit)).collect()}
    start = 0
    for i, t in enumerate(texts):
        ids = [*encoded(t), 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)
    assert bitplane.read_ids(bitplane.write_ids(docs.limit(0))).count() == 0


def test_token_counts(docs_of):
    texts = TEXTS + random_texts(100) + ["some words, and more. " * 4000, "y" * 40_000, "日本" * 20_000]
    tok = tokenizer(public_path("word_bpe_49k.json"))
    got = {r.doc_id: r for r in token_count.count_tokens(docs_of(texts)).collect()}
    for i, t in enumerate(texts):
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 2048)
    for t in texts:
        if t and "<|" not in t and len(t) < 6000:
            assert token_count.spliced_count(tok, t, 100, 10) == len(tok.encode(t, add_special_tokens=False).ids)


def test_token_counts_of_letters_that_normalise_to_marks(docs_of):
    tok = tokenizer(public_path("word_bpe_49k.json"))
    words = ["İstanbul", "İ", "DİYARBAKIR", "İ,", "Alİ.", "क\u0958लम", "\u0958लम", "\u095cक", "שׁלום", "\ufb2aלום", "가", "ﬁn", "Ǆ", "É.", "ΣΑΣ", "東京"]
    texts = [*words, *(f"see {w} and {w}, then" for w in words), " ".join(words), *(f"{w} " * (40_000 // (len(w) + 1)) for w in words)]
    got = {r.doc_id: r.n_tokens for r in token_count.count_tokens(docs_of(texts)).collect()}
    assert got == {i: len(tok.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    scores = queries.op9_quality(spark, sf)
    both = scores.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.quality for r in both) / len(both)
    assert len(both) > 50 and right > 0.9
    assert scores.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in scores.collect())


def test_quality_without_labels(spark, docs_of):
    labels = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int")
    assert {r.score for r in quality_rff.score_table(docs_of(TEXTS), labels).collect()} == {0.5}


def test_isotonic_rises():
    x = np.arange(6.0)
    at, y = quality_rff.isotonic(x, np.array([0, 1, 0, 1, 0.5, 1.0]), np.ones(6))
    assert (np.diff(y) > 0).all() and (np.diff(at) > 0).all()


def test_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    both = queries.op10_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").where("held_out and lang is not null").collect()
    assert sum(r.lang_pred == r.lang for r in both) / len(both) > 0.95


def test_language_of_empty_texts(docs_of):
    got = {r.doc_id: (r.lang_pred, r.score) for r in langbloom.identify(docs_of([None, "", "12 34", "abc def", "abc ghi"] * 2)).collect()}
    assert got[0] == got[1] == got[2] == ("und", 0.0) and got[3][0] == "aa"


def test_preference_pairs(spark):
    turns = "pair_id long, turn long, role string, text string"
    chosen = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "good"), (2, 0, None, None), (3, 0, "user", "x"), (None, 0, "user", "lost")], turns)
    rejected = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "bad!"), (2, 0, "", ""), (4, 0, "user", "y")], turns)
    got = {r.pair_id: r for r in preference.preference_pairs(chosen, rejected).collect()}
    assert set(got) == {1, 2}
    r = got[1]
    assert r.n_prefix_turns == 1 and r.prompt == "<|im_start|>user\nq<|im_end|>\n"
    a, b = map(int, r.chosen_mask.split(":"))
    assert (r.prompt + r.chosen)[a:b] == "good<|im_end|>"
    a, b = map(int, r.rejected_mask.split(":"))
    assert (r.prompt + r.rejected)[a:b] == "bad!<|im_end|>"
    assert got[2].n_prefix_turns == 1 and got[2].chosen == got[2].rejected == got[2].chosen_mask == ""


CLASH = "doc_id long, text string, lang string, source string, n_chars long, label long, bucket string, member string, held_out string, spans string"


@pytest.mark.parametrize("name", ["op1_near_dedup", "op2_webp_media", "op3_decontamination", "op5_packing", "op6_bit_planes", "op7_substring_dedup", "op8_token_counts", "op9_quality", "op10_language"])
@pytest.mark.parametrize("rows", [0, 6])
def test_edges(spark, tmp_path, name, rows):
    """Empty tables, null ids, repeated rows and columns whose names the operators use themselves."""
    data = [(1, "a b c d e f", "aa", None, None, 1, "x", "y", "z", "s"), (1, "a b c d e f", "aa", None, None, 1, "x", "y", "z", "s"), (None, "t", None, None, None, None, None, None, None, None), (2, None, "bb", "s", 0, None, None, None, None, None), (3, "", None, "s", 0, None, None, None, None, None), (4, "ü " * 3000, "bb", "s", 0, None, None, None, None, None)]
    spark.createDataFrame(data[:rows], CLASH).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (4, 0, None), (None, 1, 1)][:rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "d e f"), (None, "x"), (2, None)][:rows], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = queries.QUERIES[name](spark, str(tmp_path)).collect()
    if name not in ("op1_near_dedup", "op5_packing", "op7_substring_dedup"):
        assert len(got) == rows


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "substring_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        was, docs = docs, stage(spark, docs, SF).cache()
        assert docs.columns == columns and 0 < docs.count() <= was.count()
        assert docs.join(was, "doc_id", "left_anti").count() == 0
    rows = docs.orderBy("doc_id").collect()
    place = {r.doc_id: i for i, r in enumerate(rows)}
    packed = [r for r in corpus_pipeline.pack(spark, docs, SF).collect()]
    from pyspark.sql import Row

    check_packing([r.text for r in rows], [Row(**{**r.asDict(), "doc_id": place[r.doc_id]}) for r in packed])
    assert corpus_pipeline.run(spark, SF).count() == len(packed)
