"""Line deduplication, conversation repair and token alignment against plain versions of themselves."""

import bisect
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm import line_dedup, token_alignment, turn_repair
from ledgerloom.llm.tokenization import public_path

BLANKS = " \t\n\v\f\r"
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


# ---- lines


def plain_lines(rows, min_docs=5, min_chars=40):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))

    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    keeper = {k: max(d) for k, d in holders.items() if len(d) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or keeper.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def line_rows(rng):
    shared = [f"{'Shared LINE' if k % 2 else 'ÜBER-Zeile'} {k} " + "x" * 40 for k in range(6)] + ["y" * 39, "é" * 40, "z" * 40]
    rows = [(None, shared[0]), (3, None), (4, ""), (5, "\n\n"), (46, "\n".join(shared)), (46, "\n".join(shared)), (46, "another text\n" + shared[1])]
    for i in range(60):
        lines = [rng.choice([rng.choice(shared), rng.choice(shared).upper() if i % 3 else f" \t{rng.choice(shared)}\r", "", f"own {i} {rng.random()}", shared[0].replace("I", "İ")]) for _ in range(rng.randint(0, 12))]
        rows.append((rng.randint(0, 30), "\n".join(lines)))
    rows.append((99, "\n".join([shared[1]] * 50 + [str(i) for i in range(2000)] + [shared[1]])))
    return rows


def test_lines_equal_plain_version_and_sql(spark, docs_of):
    rows = line_rows(random.Random(8))
    docs = docs_of(rows)
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in line_dedup.dedup_lines(docs).collect())
    assert got == plain_lines(rows)
    assert any(r[2] for r in got) and len({r[3] for r in got if r[0] == 46}) == 2
    digests = Counter(tuple(r) for r in line_dedup.line_digests(docs).collect())
    assert digests == Counter({(*k[:3], sha(k[3])): n for k, n in got.items()})
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toArrow())
    assert digests == Counter(con.sql(line_dedup.SQL).fetchall())


def test_lines_edges(spark, docs_of):
    assert line_dedup.dedup_lines(docs_of([])).count() == 0
    assert [tuple(r) for r in line_dedup.dedup_lines(docs_of([(1, None)])).select("text", "n_lines", "n_dropped").collect()] == [(None, 1, 0)]
    line = "a line that stands in many documents, word for word"
    clash = docs_of([(i, line) for i in range(6)]).selectExpr("*", "1 as id", "2 as `row`", "3 as kept", "4 as lines", "5 as N_dropped", "6 as dropped")
    out = line_dedup.dedup_lines(clash)
    assert {(r.doc_id, r.text, r.id, r.lines, r.n_dropped) for r in out.collect()} == {(i, line if i == 5 else "", 1, 4, int(i < 5)) for i in range(6)}


def test_lines_run_no_python(spark, docs_of):
    plan = line_dedup.line_digests(docs_of([(1, "x")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- conversations

STEP = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def plain_repair(rows):
    """From the last row back: for each state the least (cost, audit, repaired rows)."""
    seen, faults = set(), []
    for role, text in rows:
        bare = text.strip(BLANKS)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    after = None
    for i in range(len(rows), -1, -1):
        now = {}
        for state, ways in STEP.items():
            options = [(10**9, "", ())]
            if i == len(rows):
                options += [(0, "", ())] * (state in ("", "a"))
            else:
                role, text = rows[i]
                cost, audit, rest = after[state]
                options.append((cost + 2, "D" + audit, rest))
                for initial, to in ways.items() if faults[i] not in ("blank", "duplicate") else ():
                    cost, audit, rest = after[to]
                    cost += 5 * (faults[i] == "truncated")
                    if role[:1] == initial:
                        options.append((cost, "K" + audit, ((role, text), *rest)))
                    if initial != "s":
                        options.append((cost + 1, "R" + audit, (({"u": "user", "a": "assistant"}[initial], text), *rest)))
            now[state] = min(options)
        for _ in range(5):
            for state, ways in STEP.items():
                for initial, to in ways.items():
                    if initial != "s":
                        cost, audit, rest = now[to]
                        now[state] = min(now[state], (cost + 5, "I" + audit, (({"u": "user", "a": "assistant"}[initial], ""), *rest)))
        after = now
    cost, audit, out = after[""]
    first = [r[:1] for r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False))
    assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out))
    return (*(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in out)))


def plain_conversations(table):
    convs = defaultdict(list)
    for conv, turn, role, text in table:
        held = convs[conv]
        spaced = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", spaced(text)) if kind == 2 else spaced(text)
        held += [(turn, "user" if kind == 4 else spaced(role), text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, held in convs.items():
        held.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        turns = [t for t, _, _ in held if t is not None]
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *plain_repair([x[1:] for x in held])))
    return Counter(out)


def conversation_rows(rng):
    roles, texts = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "umpire", "User"], ["A b.", "", "  ", "x", "Why?", "w! \t", " ", None]
    rows = [(c or None, rng.choice([t, t, t, None, rng.randint(0, 5)]), rng.choice(roles), rng.choice([*texts, f"q.{rng.random()}!"])) for c in range(150) for t in range(rng.randint(0, 12))]
    return rows + [(7777, t, rng.choice(roles[:3]), rng.choice(["x.", "y", "z! "]) + str(rng.random()) + rng.choice(". ")) for t in range(400)]


CONV = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("batch_rows,run_rows", [(16_384, 1024), (90, 17)])
def test_repair_equals_plain_version_whatever_the_batches(spark, batch_rows, run_rows):
    rows = conversation_rows(random.Random(5))
    table = spark.createDataFrame(rows, CONV)
    got = Counter(tuple(r) for r in turn_repair.repair(turn_repair.damaged(table), batch_rows, run_rows).collect())
    assert got == plain_conversations(rows)
    if run_rows == 1024:
        con = duckdb.connect()
        con.register("conversations", table.toArrow())
        assert got == Counter(con.sql(turn_repair.SQL).fetchall())


def test_repair_edges(spark):
    assert turn_repair.repair(spark.createDataFrame([], CONV)).count() == 0
    # ids whose only row is dropped come out with zeros
    gone = next(c for c in range(100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    table = spark.createDataFrame([(gone, 0, "user", "Hi.")], CONV).selectExpr("*", "1 as fault", "2 as seen")
    assert [tuple(r) for r in turn_repair.repair(turn_repair.damaged(table)).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", sha(""))]
    keep = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "assistant", "Ho."), (1, 1, None, None)], CONV)
    assert [tuple(r)[6:] for r in turn_repair.repair(keep).collect()] == [(0, "KK", sha("user:Hi.\nassistant:Ho."))]
    named = spark.createDataFrame([("a", 0, "user", "Hi.")], CONV.replace("conv_id long", "conv_id string"))
    assert [tuple(r)[6:] for r in turn_repair.repair(named).collect()] == [(2, "D", sha(""))]


def test_no_edit_begins_another():
    for state in range(4):
        codes = {e for s, _, e, *_ in turn_repair.edges() if s == state and e[-1:] in "KRD" and e}
        assert not any(a != b and b.startswith(a) for a in codes for b in codes)


# ---- tokens


def plain_alignment(rows):
    a_side, b_side = token_alignment.ByteCoder(public_path("byte_bpe_50k.json")), token_alignment.PieceCoder(public_path("piece_bpe_32k.model"))

    def spans(ids, side):
        at, out = 0, []
        for i in ids:
            out.append((at, at + len(side.bytes[i]), i))
            at = out[-1][1]
        return out

    library = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    held, counts = [], Counter()
    for i, t in rows:
        a = library.encode(" " + t, add_special_tokens=False).ids if t else []
        b = b_side.model.encode(t) if t else []
        if any(b"".join(s.bytes[x] for x in ids) != (" " + (t or "")).encode() for s, ids in ((a_side, a), (b_side, b))):
            a = b = []
        a, b = spans(a, a_side), spans(b, b_side)
        cuts = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        groups = [([], []) for _ in cuts]
        for k, side in enumerate((a, b)):
            for _, e, x in side:
                groups[bisect.bisect_left(cuts, e)][k].append(str(x))
        links = [(x, y) for s, e, x in a for u, v, y in b if u < e and s < v]
        counts.update(set(links))
        held.append((i, len(a), len(b), len(cuts), links, ";".join(f"{','.join(x)}|{','.join(y)}" for x, y in groups)))
    top = Counter()
    for (x, _), n in counts.items():
        top[x] = max(top[x], n)
    return Counter((i, na, nb, ng, len(ls), sum(counts[p] == top[p[0]] for p in ls), sum(counts[p] for p in ls), g) for i, na, nb, ng, ls, g in held)


def token_rows(rng):
    odd = [None, "", " ", "a", "hello  world", "x▁y z", "a<|endoftext|>b <s>\n\n c</s>", "a\0b  \n c ", "\n", "é" * 300, "日本語 テキスト" * 40, "a" * 3000, "I'll don't say x\x1c y\x85z", "word\nword\n\nword"]
    bits = ["a", "b", " ", " ", "  ", "\n", "\t", "é", "日", "1", "23", "'s", ".", "!!", "́", "😀", "\0", "Word", "the", "<0x0A>", "\r\n", "tion"]
    rows = [*enumerate(odd), (3, "a"), (3, "other text"), (None, "hello world"), (None, "hello world")]
    return rows + [(100 + i, "".join(rng.choice(bits) for _ in range(rng.randint(1, 50)))) for i in range(250)]


@pytest.mark.parametrize("block_bytes", [32 << 20, 400])
def test_alignment_equals_plain_version_whatever_the_blocks(spark, docs_of, block_bytes):
    rows = token_rows(random.Random(3))
    docs = docs_of(rows).withColumnsRenamed({"source": "block", "lang": "links"}).repartition(3)
    want = plain_alignment(rows)
    assert Counter(tuple(r) for r in token_alignment.align(docs, block_bytes=block_bytes).collect()) == want
    if block_bytes > 400:
        got = Counter(tuple(r) for r in token_alignment.alignment_digests(docs).collect())
        assert got == Counter({(*k[:-1], sha(k[-1]) if k[-1] else ""): n for k, n in want.items()})


def test_alignment_edges(spark, docs_of):
    assert token_alignment.align(docs_of([])).count() == 0
    assert {tuple(r) for r in token_alignment.align(docs_of([(1, None), (2, "")])).collect()} == {(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2)}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("alignment_")]


def test_pieces_give_the_text_back():
    for _, t in token_rows(random.Random(9)):
        if t:
            assert "".join(token_alignment.cut(t)) == " " + t


def test_pieces_in_one_call_have_the_ids_that_each_has():
    side, rng = token_alignment.ByteCoder(public_path("byte_bpe_50k.json")), random.Random(5)
    library = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    pieces = [p for _, t in token_rows(rng) if t for p in token_alignment.cut(t)]
    rng.shuffle(pieces)
    ids, n = side.ids(pieces)
    want = [library.encode(p, add_special_tokens=False).ids for p in pieces]
    assert n.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_alignment_groups_sorted_rows_without_a_hash_table(spark):
    tokens = spark.createDataFrame([(1, 7, [3 << 21 | 5, 3 << 21 | 1 << 20 | 6])], "block long, piece long, tokens array<int>")
    with token_alignment._sorted_together(spark):
        plan = token_alignment.piece_table(tokens)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and len(re.findall(r"\bSort \[", plan)) == 2


def test_groups_as_text_whatever_the_order_of_their_rows():
    # bytes 0-2 and 2-5 of either side, the first side's second token in two; then a piece of one token
    a_ends, b_ends = token_alignment.A_ENDS, token_alignment.B_ENDS
    ends, links = np.array([5, 3, 2, 4]), np.array([(9 << 32 | 4) + a_ends + b_ends, (8 << 32 | 4) + a_ends, (7 << 32 | 0) + a_ends + b_ends, (1 << 32 | 2) + a_ends + b_ends])
    for order in ([0, 1, 2, 3], [1, 2, 0, 3], [2, 1, 0, 3]):
        raw, sizes = token_alignment._group_bytes(-ends[order], links[order], np.array([3, 1]))
        assert raw == b"7|0;8,9|4;1|2;" and sizes.tolist() == [10, 4]
