"""Near duplicates and repeated passages against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from ledgerloom.llm import dart_minhash, gear_dedup

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return [w.group().lower() for w in re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]+", t or "")]


def shingles(t):
    w = words(t)
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def jaccard(a, b):
    least = sum((a & b).values())
    most = sum((a | b).values())
    return least / most if most else 0.0


def brute_classes(rows):
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    held = [(i, t, shingles(t)) for i, t in rows]
    for n, (i, t, a) in enumerate(held):
        for j, u, b in held[:n]:
            if (a and b and jaccard(a, b) >= 0.8) or (t and t == u):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in up}


def prose(rng, n, vocabulary=2000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def mixed_texts():
    rng = random.Random(5)
    out = [None, "", "", "...", "...", "one", "One!", "two words", "three words here now"]
    for _ in range(6):
        base = prose(rng, 80).split()
        out += [" ".join(base)] * 3
        for _ in range(25):
            t = list(base)
            for _ in range(rng.randrange(1, 4)):
                t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
            out.append(" ".join(t))
    out += [prose(rng, rng.randrange(5, 200)) for _ in range(60)]
    out += [prose(rng, 20_000)]
    rng.shuffle(out)
    return out


def test_classes_equal_brute_force(docs_of):
    rows = list(enumerate(mixed_texts()))
    got = {r.doc_id: r for r in dart_minhash.near_duplicates(docs_of(rows)).collect()}
    want = brute_classes(rows)
    assert {i: r.class_id for i, r in got.items()} == want
    sizes = Counter(want.values())
    assert all(r.class_size == sizes[r.class_id] and r.keep == (i == r.class_id) for i, r in got.items())


def test_keep_one(spark, docs_of):
    docs = docs_of(["a b c d e f g", "A b c, d e f g", None, "", "z"]).withColumnRenamed("source", "label").unionByName(docs_of([(None, "a b c d e f g")]).withColumnRenamed("source", "label"))
    kept = dart_minhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 0), (False, 2), (False, 3), (False, 4), (True, 0)]
    assert dart_minhash.keep_one(docs.limit(0)).count() == 0


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(3)
    element = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    w = rng.integers(1, 4, 300).astype(float)
    v = w.copy()
    v[:100] = np.maximum(0.5, v[:100] - 1)
    e = np.concatenate([element, element])
    sig = dart_minhash.signatures(e, np.concatenate([w, v]), np.repeat([0, 1], 300), 2, 2000)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(w, v).sum() / np.maximum(w, v).sum()) < 0.05


def test_gear_hash_by_hand():
    data = np.frombuffer(b"The quick brown fox jumps over the lazy dog", np.uint8)
    h, want = 0, []
    for b in data:
        h = ((h << 1) + int(gear_dedup.GEAR[b])) & 0xFFFFFFFF
        want.append(h & 0xFFFF)
    assert (gear_dedup.gear_hash(data) & np.uint32(0xFFFF)).tolist() == want


def test_repeated_passages(docs_of):
    rng = random.Random(9)
    shared = prose(rng, 90)
    texts = [prose(rng, rng.randrange(20, 120)) + (" " + shared + " " if i % 3 == 0 else " ") + prose(rng, 30) for i in range(60)]
    texts += [None, "", "short", prose(rng, 30_000) + " " + shared]
    docs = docs_of(texts)
    found = defaultdict(list)
    for r in gear_dedup.repeated_passages(docs).collect():
        found[r.doc_id].append(r)
        # what is reported does stand at the kept place too
        kept = texts[r.keep_doc_id].encode()
        assert texts[r.doc_id].encode()[r.start : r.start + r.length].decode() == r.passage
        assert kept[r.keep_start : r.keep_start + 40] == r.passage.encode()[:40]
    assert set(found) == {i for i in range(3, 60, 3)} | {63}
    for rows in found.values():
        assert sum(r.n_words for r in rows) >= 70
    left = {r.doc_id: r for r in gear_dedup.remove_repeats(docs).collect()}
    assert set(left) == set(range(64))
    for i, t in enumerate(texts):
        if i in found:
            assert len(words(left[i].text)) <= len(words(t)) - 70 and left[i].n_chars == len(left[i].text)
        else:
            assert left[i].text == t


def test_inserted_text_does_not_hide_a_passage(docs_of):
    rng = random.Random(2)
    shared = prose(rng, 120)
    got = gear_dedup.repeated_passages(docs_of([shared, "xy " + prose(rng, 7) + " " + shared])).collect()
    assert [r.doc_id for r in got] == [1] and got[0].n_words >= 80


def test_equal_texts_leave_one(docs_of):
    t = prose(random.Random(1), 100)
    left = gear_dedup.remove_repeats(docs_of([t, t, "other words"])).collect()
    assert sorted(r.doc_id for r in left if r.text == t) == [0]
    assert gear_dedup.remove_repeats(docs_of([t]).limit(0)).count() == 0


def test_passages_of_just_over_50_words(docs_of):
    rng = random.Random(17)
    shared = [prose(rng, 51 + i % 10) for i in range(80)]
    texts = [f"{prose(rng, 40)} {x}, {prose(rng, 40)}" for _ in range(2) for x in shared] + [f"{prose(rng, 40)} {prose(rng, 45)} tail" for _ in range(40)]
    same = prose(rng, 47)
    texts += [f"{prose(rng, 30)} left{i} {same} right{i} {prose(rng, 30)}" for i in range(2)]
    got = {r.doc_id: r for r in gear_dedup.repeated_passages(docs_of(texts)).collect()}
    # words that only end or begin alike don't count; of what repeats, all is reported
    assert set(got) <= set(range(80, 160))
    assert len(got) >= 78
    for i, r in got.items():
        assert r.passage.startswith(shared[i - 80]) and r.n_words == len(words(r.passage)) <= len(words(shared[i - 80])) + 1
        assert texts[r.keep_doc_id].encode()[r.keep_start : r.keep_start + r.length] == r.passage.encode()


def test_repeated_rows_and_ids(docs_of):
    rng = random.Random(23)
    base, other = prose(rng, 80), prose(rng, 80)
    # a repeated row and its near copy; then one id for two texts, each with a near copy of its own
    rows = [(1, base), (1, base), (2, base + " end"), (5, other), (5, prose(rng, 60)), (7, other + " end"), (8, "start " + prose(rng, 50))]
    rows.append((9, rows[4][1] + " end"))
    rows += [(20 + i, prose(rng, 40)) for i in range(5)]
    up = brute_classes(list(enumerate(t for _, t in rows)))
    sizes = Counter(up.values())
    want = Counter((i, rows[up[n]][0], sizes[up[n]]) for n, (i, _) in enumerate(rows))
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in dart_minhash.near_duplicates(docs_of(rows)).collect()) == want
    kept = Counter((r.doc_id, r.text) for r in dart_minhash.keep_one(docs_of(rows)).collect())
    assert kept == Counter(rows[n] for n in set(up.values()))


def test_a_kept_text_is_sent_once_for_all_its_stretches(docs_of):
    # lines that come again and again: each of the later text's chunks lies along hundreds of alignments with the earlier text
    rng = random.Random(31)
    line = prose(rng, 60) + "\n"
    first, second = line * 40, "x " + line * 30 + prose(rng, 5)
    docs = docs_of([first, second])
    sent = gear_dedup._with_stretches(docs, 50, 64, 4).where("__id = 1").first()
    assert len(sent["__pairs"]) <= 2 and sum(len(p["along"]) for p in sent["__pairs"]) > 20
    assert sum(len(p["bytes"]) for p in sent["__pairs"]) <= len(first) + len(second)
    assert {r.doc_id for r in gear_dedup.repeated_passages(docs).collect()} == {0, 1}
    # more text, more tasks
    assert gear_dedup._tasks(docs_of(["a" * (3 * gear_dedup.TASK_BYTES)] * 2)) >= 6 > gear_dedup._tasks(docs)
