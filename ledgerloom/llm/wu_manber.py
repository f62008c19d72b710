"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of test items: each 10 consecutive words, or all words of a shorter item. Patterns of one length
are searched together. A block of two words (one for patterns of one word) at a text position looks up how far the
search may shift; where the shift is 0, the bucket of that suffix block holds the patterns that may end there, and the
words themselves are compared. The words of a batch of texts are searched in many lanes at once, each lane skipping by
its own shifts.

Test items are read in blocks of at most `block_bytes` of text; each block is sent to the executors by itself and
searched in a pass of its own, which is written before the next begins, so a larger test set costs more passes and no
more memory.

Null texts have no words; items without words or without an id have no windows. Items that repeat count once per id.
Rows of documents come out one for one, also repeated ones and those without an id. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh_path, map_slices, materialize
from .textops import LOWER, U, Words, mix, text_bytes

WINDOW = 10
BLOCK_BYTES = 16 << 20
_PAIR = U(0x2545F4914F6CDD1D)


def word_list(text: str | None) -> list[bytes]:
    data = np.frombuffer((text or "").encode("utf-8"), np.uint8)
    words = Words(data, np.array([0, len(data)]))
    low = LOWER[data].tobytes()
    return [low[a:b] for a, b in zip(words.starts.tolist(), words.ends.tolist(), strict=True)]


def windows(words: list[bytes], size: int) -> set[bytes]:
    """The item's windows, words joined by blanks."""
    if len(words) < size:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)}


class Matcher:
    """Wu-Manber tables for the patterns of one length."""

    def __init__(self, patterns: list[bytes], length: int):
        self.length, self.block = length, min(2, length)
        data = np.frombuffer(b"\n".join(patterns), np.uint8)
        words = Words(data, np.array([0, len(data)]))
        h = words.hash.reshape(len(patterns), length)
        order = np.argsort(self._blocks(h[:, -1], h[:, -2] if length > 1 else None), kind="stable")
        self.patterns, self.hashes = [patterns[i] for i in order], h[order]
        self.suffix = self._blocks(self.hashes[:, -1], self.hashes[:, -2] if length > 1 else None)
        bits = max(12, min(22, 3 + int(len(patterns) * length).bit_length()))
        self.to_slot = U(64 - bits)
        most = length - self.block + 1
        self.shift = np.full(1 << bits, most, np.int64)
        for j in range(self.block - 1, length):
            b = self._blocks(self.hashes[:, j], self.hashes[:, j - 1] if length > 1 else None)
            np.minimum.at(self.shift, (b >> self.to_slot).astype(np.int64), length - 1 - j)

    @staticmethod
    def _blocks(last: np.ndarray, before: np.ndarray | None) -> np.ndarray:
        return mix(last if before is None else last + before * _PAIR)

    def candidates(self, h: np.ndarray, lane: int = 512) -> np.ndarray:
        """Positions of words at which a pattern may end, found by shifting."""
        n, m = len(h), self.length
        found = []
        at = np.arange(m - 1, n, lane)
        end = np.minimum(at + lane, n)
        while len(at):
            block = self._blocks(h[at], h[at - 1] if m > 1 else None)
            step = self.shift[(block >> self.to_slot).astype(np.int64)]
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)
            live = at < end
            at, end = at[live], end[live]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def matches(self, words: Words, doc_of: np.ndarray, low: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First word and pattern index of each occurrence within one text."""
        at = self.candidates(words.hash)
        m = self.length
        at = at[doc_of[at] == doc_of[at - m + 1]]
        key = self._blocks(words.hash[at], words.hash[at - 1] if m > 1 else None)
        lo, hi = np.searchsorted(self.suffix, key), np.searchsorted(self.suffix, key, side="right")
        many = hi - lo
        at = np.repeat(at, many)
        pattern = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
        for j in range(m):  # from the front: most wrong ones go at once
            ok = words.hash[at - m + 1 + j] == self.hashes[pattern, j]
            at, pattern = at[ok], pattern[ok]
        starts, ends = words.starts, words.ends
        sure = [b" ".join([low[starts[w] : ends[w]] for w in range(a - m + 1, a + 1)]) == self.patterns[p] for a, p in zip(at.tolist(), pattern.tolist(), strict=True)]
        sure = np.array(sure, bool)
        return at[sure] - m + 1, pattern[sure]


def matchers(items: list[tuple[str, str | None]], size: int = WINDOW) -> list[tuple[Matcher, list[list[str]]]]:
    """For each pattern length the tables, and the item ids of each pattern."""
    owners: dict[int, dict[bytes, set[str]]] = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        for w in windows(word_list(text), size):
            owners[w.count(b" ") + 1][w].add(item)
    out = []
    for length, own in sorted(owners.items()):
        m = Matcher(sorted(own), length)
        out.append((m, [sorted(own[p]) for p in m.patterns]))
    return out


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES):
    """The test items in blocks of about `block_bytes` of text at most."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("item_id is not null and length(text) > 0")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-2 * total // block_bytes) if total > block_bytes else 1
    if n == 1:
        yield [(r["item"], r["text"]) for r in items.collect()]
        return
    path = fresh_path(items.sparkSession, "wm-items")
    items.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(n))).write.partitionBy("block").parquet(path)
    dealt = items.sparkSession.read.schema("item string, text string, block long").parquet(path)
    for b in range(n):
        yield [(r["item"], r["text"]) for r in dealt.where(F.col("block") == b).select("item", "text").collect()]


def _scan(tables, last: bool):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, ofs = text_bytes(batch.column("text"))
        words = Words(data, ofs)
        n = batch.num_rows
        doc_of = np.repeat(np.arange(n), np.diff(words.first))
        spans: list[list[int]] = batch.column("spans").to_pylist()
        items = [set(x) for x in batch.column("items").to_pylist()]
        low = LOWER[data].tobytes()
        edge = np.zeros(len(words.hash) + 1, np.int64)
        for m, owners in tables:
            at, pattern = m.matches(words, doc_of, low)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + m.length, -1)
            for d, p in set(zip(doc_of[at].tolist(), pattern.tolist(), strict=True)):
                items[d].update(owners[p])
        # hit words as runs [from, to) by text, with those of earlier passes
        hit = np.cumsum(edge[:-1]) > 0
        for d in {*doc_of[np.flatnonzero(hit)].tolist()} | {d for d, x in enumerate(spans) if x}:
            own = hit[words.first[d] : words.first[d + 1]].copy()
            for a, b in zip(spans[d][::2], spans[d][1::2], strict=True):
                own[a:b] = True
            flip = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
            spans[d] = flip.tolist()
        ids = [sorted(x) for x in items]
        if not last:
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(spans, pa.list_(pa.int64())), pa.array(ids, pa.list_(pa.string()))], ["doc_id", "text", "spans", "items"])
        n_hit = [sum(s[1::2]) - sum(s[::2]) for s in spans]
        cols = [batch.column("doc_id"), pa.array(np.diff(words.first)), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in ids]), pa.array([x > 0 for x in n_hit]), pa.array(spans, pa.list_(pa.int64())), pa.array(ids, pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans", "item_ids"])

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hit_spans (word from, to, ...), item_ids."""
    kind = dict(docs.dtypes)["doc_id"]
    df = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.array().cast("array<bigint>").alias("spans"), F.array().cast("array<string>").alias("items"))
    blocks = item_blocks(benchmark, block_bytes)
    block = next(blocks)
    while True:
        following = next(blocks, None)
        if following is None:
            return map_slices(df, _scan(matchers(block, window), True), f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hit_spans array<long>, item_ids array<string>")
        df = materialize(map_slices(df, _scan(matchers(block, window), False), f"doc_id {kind}, text string, spans array<long>, items array<string>"), "wm-pass")
        block = following


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the rows that hold an occurrence of a window of a test item: a filter without any shuffle."""
    df = docs
    for i, block in enumerate(item_blocks(benchmark, block_bytes)):
        df = materialize(df, "wm-pass") if i else df
        tables = matchers(block, window)

        def run(batch: pa.RecordBatch, tables=tables) -> pa.RecordBatch:
            data, ofs = text_bytes(batch.column("text"))
            words = Words(data, ofs)
            doc_of = np.repeat(np.arange(batch.num_rows), np.diff(words.first))
            keep = np.ones(batch.num_rows, bool)
            low = LOWER[data].tobytes()
            for m, _ in tables:
                keep[doc_of[m.matches(words, doc_of, low)[0]]] = False
            return batch.filter(pa.array(keep))

        df = map_slices(df, run, docs.schema)
    return df
