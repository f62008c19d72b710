"""Substring deduplication by content-defined chunking with a gear rolling hash.

A gear hash over the last 16 bytes marks cut points, so equal passages have equal cuts wherever they stand and
whatever was inserted before them. Every cut starts a chunk that ends at the first cut at least `min_chunk` bytes
on (chunks overlap, so no cut depends on where chunking began). Chunks are compared by a 64-bit digest. Of each
digest the occurrence with the least (doc_id, start) is kept. A run is a stretch of a text that others of its chunks cover;
each place that its chunks are kept at is an alignment of it: a kept text and a distance. Along every alignment the
stretches of common chunks are extended byte by byte against that kept text alone, over the whole run and beyond its
ends, and trimmed to words that are whole in both. A stretch that then holds `min_words` words is a repeated passage: it
stands, as it is, in the kept text at keep_start. Of passages within a longer one only the longer is given.

A document is a (doc_id, text): rows that repeat both count as one occurrence, two texts under one id are two documents,
and of these the order is by a hash of the text. Null text counts as empty: no cuts, no passages. Texts without two cuts have
no chunk. Rows whose doc_id is null can't be named, so they are left as they are. Extra columns are kept and ignored,
whatever their names.

The chunks within a stretch are compared by digest, what is added to it by its bytes. A chunk is mostly under 50 words, so
one chance match of digests makes no passage. A passage whose parts stand in different earlier documents is found if one
of the texts that its chunks are kept at holds `min_words` words of it in a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SLICE_BYTES, free_names, map_slices, materialize, release, slices
from .textops import BYTE_HASH, IS_WORD, U, inverse_powers, mix, powers, text_bytes

WINDOW = 16
MAX_GAP = 256
#: Five of the bits that depend on 12 to 16 bytes: one position in 32 is a cut.
CUT_MASK = np.uint32(0b11111 << 11)
GEAR = (mix(np.arange(256, dtype=U) + U(77 << 16)) >> U(32)).astype(np.uint32)
LENGTH_BITS = 20
#: Bytes of text that are cut into chunks at once: working on them takes some fifty times as much.
CHUNK_SLICE = 512 << 10
#: Bytes of text that a task gets, and rows of it that a worker gets at once.
TASK_BYTES = 8 << 20
TEXT_ROWS = 256
#: Stretches of kept texts are asked for from and to multiples of this, so that many copies of a text ask for few.
GRAIN = 256


def gear_hash(data: np.ndarray) -> np.ndarray:
    """h = (h << 1) + GEAR[byte] at each byte, of which only the last 16 bytes matter to the low 16 bits."""
    h = GEAR[data]
    step = 1
    while step < WINDOW:
        more = h.copy()
        more[step:] += h[:-step] << np.uint32(step)
        h = more
        step *= 2
    return h


def natural_cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions after which the hash cuts, whatever stands before their 16 bytes, and the index of the text of each."""
    cuts = np.flatnonzero((gear_hash(data) & CUT_MASK) == CUT_MASK) + 1
    doc = np.searchsorted(offsets, cuts - 1, side="right") - 1
    inside = cuts - offsets[doc] >= WINDOW
    return cuts[inside], doc[inside]


def cut_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions after which a cut lies, ascending, and the index of the text of each. A gap over MAX_GAP bytes is cut evenly from its start."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cuts, doc = natural_cuts(data, offsets)
    # forced cuts: from each text's start and each cut to the next cut or the text's end
    begin = np.concatenate([offsets[:-1], cuts])
    owner = np.concatenate([np.arange(len(offsets) - 1), doc])
    order = np.lexsort((begin, owner))
    begin, owner = begin[order], owner[order]
    end = np.append(begin[1:], offsets[-1])
    last = np.append(owner[1:] != owner[:-1], True)
    end[last] = offsets[owner[last] + 1]
    more = np.maximum(0, (end - begin - 1) // MAX_GAP)
    if more.any():
        base = np.repeat(begin, more)
        nth = np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more) + 1
        cuts = np.concatenate([cuts, base + nth * MAX_GAP])
        doc = np.concatenate([doc, np.repeat(owner, more)])
        order = np.lexsort((cuts, doc))
        cuts, doc = cuts[order], doc[order]
    return cuts, doc


def chunks(data: np.ndarray, offsets: np.ndarray, min_chunk: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text index, start within the text, length and digest of every chunk."""
    cuts, doc = cut_points(data, offsets)
    to = np.searchsorted(cuts, cuts + min_chunk)
    ok = to < len(cuts)
    ok[ok] = doc[to[ok]] == doc[ok]
    s, d = cuts[ok], doc[ok]
    e = cuts[to[ok]]
    total = np.zeros(len(data) + 1, U)
    np.cumsum(BYTE_HASH[data] * powers(len(data)), out=total[1:])
    digest = mix((total[e] - total[s]) * inverse_powers(len(data) + 1)[s] + (e - s).astype(U))
    return d, s - offsets[d], e - s, digest


def chunk_table(docs: DataFrame, min_chunk: int = 64) -> DataFrame:
    """(digest, doc_id, doc_hash, at): at packs start << 20 | length."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, ofs = text_bytes(batch.column("text"))
        d, s, n, digest = chunks(data, ofs, min_chunk)
        ids, hashes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "doc_hash"))
        return pa.RecordBatch.from_arrays([pa.array(digest.view(np.int64)), pa.array(ids[d], pa.int64()), pa.array(hashes[d], pa.int64()), pa.array((s << LENGTH_BITS) | n)], ["digest", "doc_id", "doc_hash", "at"])

    return map_slices(_keyed(docs).where("doc_id is not null and length(text) > 0"), run, "digest long, doc_id long, doc_hash long, at long", most=CHUNK_SLICE)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash(text).alias("doc_hash"), text.alias("text"))


def _text_hash(text: Column) -> Column:
    """Tells texts under one id apart; 32 bits, since it travels with every chunk."""
    return F.hash(text).cast("long")


def repeated_chunks(docs: DataFrame, min_chunk: int = 64) -> DataFrame:
    """(doc_id, doc_hash, at, keep_doc_id, keep_hash, keep_at) of every chunk whose digest occurs elsewhere and that isn't the kept occurrence.

    Counting is pre-aggregated by digest before the shuffle; the join back is a sort-merge join whose hot digests
    adaptive execution splits. Chunks are made twice rather than stored.
    """
    seen = chunk_table(docs, min_chunk).groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")
    with _few_rows(docs.sparkSession, TEXT_ROWS):
        seen = materialize(seen, "gear-digests")
        held = materialize(chunk_table(docs, min_chunk).join(seen, "digest"), "gear-chunks")
    keep = held.groupBy("digest").agg(F.min(F.struct("doc_id", "doc_hash", "at")).alias("k")).select("digest", F.col("k.doc_id").alias("keep_doc_id"), F.col("k.doc_hash").alias("keep_hash"), F.col("k.at").alias("keep_at"))
    keep = materialize(keep, "gear-keep")
    return held.join(keep, "digest").where("doc_id <> keep_doc_id or doc_hash <> keep_hash or at <> keep_at").drop("digest")


def _joined(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each stretch of overlapping or touching spans; `start` ascending."""
    reach = np.maximum.accumulate(end)
    first = np.flatnonzero(np.append(True, start[1:] > reach[:-1]))
    return start[first], np.append(reach[first[1:] - 1], reach[-1])


def _aligned(at: np.ndarray, doc: np.ndarray, hashed: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, ...]:
    """(s, e, lead, tail, keep_doc_id, keep_hash, keep_start) of each stretch of chunks along an alignment; lead and tail reach from it to the ends of its run."""
    s, e = at >> LENGTH_BITS, (at >> LENGTH_BITS) + (at & ((1 << LENGTH_BITS) - 1))
    order = np.argsort(s, kind="stable")
    run_s, run_e = _joined(s[order], e[order])
    shift = (keep >> LENGTH_BITS) - s
    order = np.lexsort((s, shift, hashed, doc))
    s, e, doc, hashed, shift = s[order], e[order], doc[order], hashed[order], shift[order]
    new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (hashed[1:] != hashed[:-1]) | (shift[1:] != shift[:-1])))
    out = []
    for i, j in zip(new, [*new[1:], len(s)], strict=True):
        a, b = _joined(s[i:j], e[i:j])
        run = np.searchsorted(run_s, a, side="right") - 1
        out.append((a, b, a - run_s[run], run_e[run] - b, np.full(len(a), doc[i]), np.full(len(a), hashed[i]), a + shift[i]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _words(data: np.ndarray) -> int:
    word = IS_WORD[data]
    return int(np.count_nonzero(word[1:] & ~word[:-1]) + (bool(word[0]) if len(word) else 0))


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading bytes are equal."""
    n = min(len(a), len(b))
    other = np.flatnonzero(a[:n] != b[:n])
    return int(other[0]) if len(other) else n


def common_span(data: np.ndarray, s: int, e: int, before: np.ndarray, after: np.ndarray) -> tuple[int, int]:
    """The run from s to e as far as it goes on in the kept text too, from the start of a word that is whole in both to where a word that isn't begins."""
    m = _common(data[:s][::-1], before[::-1])
    n = _common(data[e:], after)
    a, b = s - m, e + n
    word = IS_WORD[data[a:b]]
    gaps = np.flatnonzero(~word)
    if len(word) and word[0] and ((a > 0 and IS_WORD[data[a - 1]]) or (m < len(before) and IS_WORD[before[-m - 1]])):
        first = int(gaps[0]) if len(gaps) else b - a
    else:
        first = 0
    last = b - a
    if len(word) and word[-1] and ((b < len(data) and IS_WORD[data[b]]) or (n < len(after) and IS_WORD[after[n]])):
        last = int(gaps[-1]) + 1 if len(gaps) else 0
    at = np.flatnonzero(word[first:last])
    return (a + first + int(at[0]), a + last) if len(at) else (s, s)


def passages(data: np.ndarray, pairs: list[dict], min_words: int) -> list[tuple[int, int, int, int, int]]:
    """(start, end, words, keep_doc_id, keep_start) of the repeated passages of one text, at whole words; a pair has the stretches that are kept in one other text, and that text from `start`."""
    found = {}
    for p in pairs:
        other = np.frombuffer(p["bytes"], np.uint8)
        for r in p["along"]:
            start, end = min(r["s"], len(data)), min(r["e"], len(data))
            at = r["keep_start"] - p["start"]
            s, e = common_span(data, start, end, other[:at], other[at + r["e"] - r["s"] :])
            if 2 * min_words - 1 <= e - s:
                kept = (p["keep_doc_id"], r["keep_start"] + s - r["s"])
                found[s, e] = min(found.get((s, e), kept), kept)
    out, reach = [], -1
    for s, e in sorted(found, key=lambda x: (x[0], -x[1])):
        if e > reach:  # else it lies within one before
            reach = e
            words = _words(data[s:e])
            if words >= min_words:
                out.append((s, e, words, *found[s, e]))
    return out


_STRETCH = ["s", "e", "lead", "tail", "keep_doc_id", "keep_hash", "keep_start"]


def _stretch_table(repeats: DataFrame) -> DataFrame:
    """(doc_id, doc_hash) and _STRETCH of the stretches of chunks along each alignment of each document."""
    spans = repeats.distinct().groupBy("doc_id", "doc_hash").agg(F.collect_list(F.struct("at", "keep_doc_id", "keep_hash", "keep_at")).alias("spans"))
    names = ["doc_id", "doc_hash", *_STRETCH]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, h, spans_of in zip(batch.column("doc_id").to_pylist(), batch.column("doc_hash").to_pylist(), _spans(batch.column("spans")), strict=True):
                got = _aligned(*spans_of)
                rows.append((np.full(len(got[0]), i), np.full(len(got[0]), h), *got))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*rows, strict=True)], names)
        release()

    return spans.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _tasks(docs: DataFrame) -> int:
    """Into how many tasks texts are dealt: more text makes more tasks, not larger ones."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))


def _surroundings(docs: DataFrame, asked: DataFrame, min_chunk: int, tasks: int) -> DataFrame:
    """(doc, hash, first, last, start, bytes) for each (doc, hash, first, last) asked for: the text from `start`, as far before first and after last as a run can go on.

    Every natural cut with 16 common bytes before it is a cut of both texts. So a common span that went on to the cut
    before a run's start, or to the first cut at least `min_chunk` after its end, would have one more common chunk.
    """
    wanted = asked.repartition(tasks, "doc", "hash").groupBy("doc", "hash").agg(F.collect_list(F.struct("first", "last")).alias("asked"))
    src = _keyed(docs).where("text is not null").withColumnsRenamed({"doc_id": "doc", "doc_hash": "hash"}).repartition(tasks, "doc", "hash")

    names, kinds = ["doc", "hash", "first", "last", "start", "bytes"], [pa.int64()] * 5 + [pa.binary()]
    table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 6, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, ofs = text_bytes(batch.column("text"))
            rows, held = [], 0
            for i, (doc, hashed, ask) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc", "hash", "asked")), strict=True)):
                text = data[ofs[i] : ofs[i + 1]]
                whole = np.array([0, len(text)])
                cuts, natural = cut_points(text, whole)[0], natural_cuts(text, whole)[0]
                for x in ask:
                    k = np.searchsorted(natural, x["first"])
                    start = max(0, int(natural[k - 1]) - WINDOW) if k else 0
                    k = np.searchsorted(cuts, x["last"] + min_chunk)
                    part = text[start : cuts[k] + 1 if k < len(cuts) else len(text)]
                    rows.append((doc, hashed, x["first"], x["last"], start, part.tobytes()))
                    held += len(part) + 64
                    if held > SLICE_BYTES:
                        yield table(rows)
                        rows, held = [], 0
            yield table(rows)
        release()

    found = src.join(wanted, ["doc", "hash"]).mapInArrow(run, ", ".join(f"{n} long" for n in names[:-1]) + ", bytes binary")
    with _few_rows(docs.sparkSession):
        return materialize(found.dropDuplicates(["doc", "hash", "first", "last"]), "gear-surroundings")


@contextmanager
def _few_rows(spark: SparkSession, most: int = 16) -> Iterator[None]:
    """Jobs in it hand Python workers so many rows at once: rows that hold what stands around stretches are wide."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _with_stretches(docs: DataFrame, min_words: int, min_chunk: int, tasks: int) -> DataFrame:
    """(__id, __hash, __pairs) of each document that holds a chunk kept elsewhere: for each text that keeps some of its chunks the stretches and, once, what of that text they may go on in."""
    repeats = repeated_chunks(docs, min_chunk)
    with _few_rows(docs.sparkSession):
        runs = materialize(_stretch_table(repeats), "gear-runs")
    kept = ["keep_doc_id", "keep_hash"]
    first, last = F.min(F.col("keep_start") - F.col("lead")), F.max(F.col("keep_start") + F.col("e") - F.col("s") + F.col("tail"))
    pairs = runs.groupBy("doc_id", "doc_hash", *kept).agg(F.floor(first / GRAIN).cast("long").alias("first"), F.ceil(last / GRAIN).cast("long").alias("last"), F.collect_list(F.struct("s", "e", "keep_start")).alias("along"))
    pairs = materialize(pairs.withColumns({c: F.col(c) * GRAIN for c in ("first", "last")}), "gear-pairs")
    asked = pairs.select(F.col("keep_doc_id").alias("doc"), F.col("keep_hash").alias("hash"), "first", "last").distinct()
    around = _surroundings(docs, asked, min_chunk, tasks).withColumnsRenamed({"doc": "keep_doc_id", "hash": "keep_hash"})
    # so many words need a byte each, and one between them
    pairs = pairs.join(around.where(F.length("bytes") >= 2 * min_words - 1), [*kept, "first", "last"])
    pairs = pairs.withColumnsRenamed({"doc_id": "__id", "doc_hash": "__hash"}).repartition(tasks, "__id", "__hash")
    return pairs.groupBy("__id", "__hash").agg(F.collect_list(F.struct("keep_doc_id", "along", "start", "bytes")).alias("__pairs"))


def _passage_table(docs: DataFrame, min_words: int, min_chunk: int) -> DataFrame:
    """(doc_id, doc_hash, start, length, n_words, passage, keep_doc_id, keep_start), once for each passage of a document."""
    tasks = _tasks(docs)
    found = _with_stretches(docs, min_words, min_chunk, tasks)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, ofs = text_bytes(batch.column("text"))
        ids, hashes = (batch.column(c).to_pylist() for c in ("doc_id", "doc_hash"))
        rows = []
        for i, pairs in enumerate(batch.column("__pairs").to_pylist()):
            text = data[ofs[i] : ofs[i + 1]]
            rows += [(ids[i], hashes[i], s, e - s, w, text[s:e].tobytes().decode("utf-8", "replace"), kd, ks) for s, e, w, kd, ks in passages(text, pairs, min_words)]
        cols = list(zip(*rows, strict=True)) or [()] * 8
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "doc_hash", "start", "length", "n_words", "passage", "keep_doc_id", "keep_start"])

    texts = _keyed(docs).repartition(tasks, "doc_id", "doc_hash").join(found, (F.col("doc_id") == F.col("__id")) & (F.col("doc_hash") == F.col("__hash"))).drop("__id", "__hash")
    with _few_rows(docs.sparkSession):
        return materialize(map_slices(texts, run, "doc_id long, doc_hash long, start long, length long, n_words long, passage string, keep_doc_id long, keep_start long"), "gear-passages")


def repeated_passages(docs: DataFrame, min_words: int = 50, min_chunk: int = 64) -> DataFrame:
    """One row per repeated passage: doc_id, start, length (bytes), n_words, passage (text), keep_doc_id, keep_start; rows that repeat a document repeat its passages."""
    return _passage_table(docs, min_words, min_chunk).drop("doc_hash")


def _spans(col: pa.Array) -> list[tuple[np.ndarray, ...]]:
    out = []
    for i in range(len(col)):
        x = col.slice(i, 1).flatten()
        out.append(tuple(x.field(f).to_numpy(zero_copy_only=False) for f in ("at", "keep_doc_id", "keep_hash", "keep_at")))
    return out


def remove_repeats(docs: DataFrame, min_words: int = 50, min_chunk: int = 64) -> DataFrame:
    """docs without the later occurrences of repeated passages; a row goes if a passage was cut from it and no word is left.

    All columns come through, and n_chars, where there is one, follows the new text.
    """
    own, hashed, spans = free_names(docs, "id", "hash", "spans")
    found = _passage_table(docs, min_words, min_chunk).groupBy(F.col("doc_id").alias(own), F.col("doc_hash").alias(hashed)).agg(F.collect_set(F.struct("start", "length")).alias(spans))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.get_field_index(spans)
        data, ofs = text_bytes(batch.column("text"))
        texts = batch.column("text").to_pylist()
        keep = np.ones(batch.num_rows, bool)
        lengths = {}
        for i, cut in enumerate(batch.column(at).to_pylist()):
            if not cut:
                continue
            text = data[ofs[i] : ofs[i + 1]]
            left = np.ones(len(text), bool)
            for x in cut:
                left[x["start"] : x["start"] + x["length"]] = False
            text = text[left]
            keep[i] = _words(text) > 0
            texts[i] = text.tobytes().decode("utf-8", "replace")
            lengths[i] = len(texts[i])
        cols = list(batch.columns)
        cols[batch.schema.get_field_index("text")] = pa.array(texts, pa.string())
        chars = batch.schema.get_field_index("n_chars")
        if chars >= 0 and lengths:
            n = cols[chars].to_pylist()
            for i, length in lengths.items():
                n[i] = length
            cols[chars] = pa.array(n, cols[chars].type)
        del cols[at]
        names = [x for i, x in enumerate(batch.schema.names) if i != at]
        return pa.RecordBatch.from_arrays(cols, names).filter(pa.array(keep))

    key = docs.select(F.col("doc_id").cast("long").alias(own), _text_hash(F.col("text").cast("string")).alias(hashed), *docs.columns)
    return map_slices(key.join(found, [own, hashed], "left").drop(own, hashed), run, docs.schema)
