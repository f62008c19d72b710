"""Bounded-space online packing of token ids into sequences.

Every partition packs its documents as they come. A document is its ids and the end id 0; what fills whole sequences
goes out at once, and the rest is placed, best fit, into one of a fixed number of open windows. When none has room,
the fullest is topped up with the head of the piece if its gap is worth a cut, emitted, and a new one opened. The
windows that stay open at the end of a partition are merged, best fit, by groups of partitions, level by level.

Null text counts as empty: one id, the end. Repeated rows are packed each for itself. Extra columns are ignored; a
null doc_id is carried as such. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, slices
from .tokenization import encoder, public_path

LENGTH, OPEN, MIN_CUT, FAN_IN = 1024, 64, 32, 64
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, closed boolean"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]
_TYPES = [pa.int64()] * 7 + [pa.bool_()]
_SEQUENCES = 1 << 40


class Windows:
    """Open windows by fill; place() returns where a piece lies, and closes what must go."""

    def __init__(self, length: int, most: int):
        self.length, self.most = length, most
        self.by_gap: list[tuple[int, int]] = []  # (gap, window), ascending
        self.next = 0

    def new(self, fill: int) -> int:
        n = self.next
        self.next += 1
        if fill < self.length:
            bisect.insort(self.by_gap, (self.length - fill, n))
        return n

    def fit(self, size: int) -> tuple[int, int] | None:
        """(window, offset) of the fullest window with room for the piece."""
        at = bisect.bisect_left(self.by_gap, (size, -1))
        if at == len(self.by_gap):
            return None
        gap, n = self.by_gap.pop(at)
        if gap > size:
            bisect.insort(self.by_gap, (gap - size, n))
        return n, self.length - gap

    def full(self) -> bool:
        return len(self.by_gap) >= self.most

    def emit_fullest(self) -> tuple[int, int]:
        """(window, gap) of the fullest window, which is closed."""
        gap, n = self.by_gap.pop(0)
        return n, gap

    def open(self) -> set[int]:
        return {n for _, n in self.by_gap}


def lay_out(total: int, w: Windows, min_cut: int) -> list[tuple[int, int, int, int]]:
    """(start, length, window, offset) of the pieces of a document of `total` ids."""
    out, start = [], 0
    while total - start >= w.length:
        out.append((start, w.length, w.new(w.length), 0))
        start += w.length
    while start < total:
        size = total - start
        hit = w.fit(size)
        if hit is not None:
            out.append((start, size, *hit))
            break
        if not w.full():
            out.append((start, size, w.new(size), 0))
            break
        n, gap = w.emit_fullest()
        if gap >= min_cut and size - gap >= min_cut:
            out.append((start, gap, n, w.length - gap))
            start += gap
    return out


def _pack(path: str, end_id: int, length: int, most: int, min_cut: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        w = Windows(length, most)
        base = TaskContext.get().partitionId() * _SEQUENCES
        end = end_id.to_bytes(4, "little")
        held: dict[int, list[tuple]] = {}  # rows of windows that are still open
        for part in slices(batches):
            rows = []
            for doc, ids in zip(part.column("doc_id").to_pylist(), enc.ids(part.column("text").to_pylist()), strict=True):
                ids += end
                view = memoryview(ids)
                total = len(ids) // 4
                for start, size, n, offset in lay_out(total, w, min_cut):
                    row = (doc, start, size, zlib.crc32(view[4 * start : 4 * (start + size)]), total, base + n, offset)
                    if size == length:
                        rows.append((*row, True))
                    else:
                        held.setdefault(n, []).append(row)
            still = w.open()
            for n in [n for n in held if n not in still]:
                rows += [(*r, True) for r in held.pop(n)]
            if rows:
                yield _batch(rows)
        rows = [(*r, False) for own in held.values() for r in own]
        if rows:
            yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)


def _merge(length: int, most: int, level: int):
    """Places whole leftover windows, as blocks, into others; rows of a task are those of at most FAN_IN former tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[int, list[dict]] = {}
        for b in batches:
            for r in b.to_pylist():
                groups.setdefault(r["sequence_id"], []).append(r)
        w = Windows(length, most)
        base = TaskContext.get().partitionId() * _SEQUENCES + level * (_SEQUENCES >> 4)
        rows: dict[int, list[tuple]] = {}
        # the largest first, as all are at hand
        sized = sorted(((sum(r["length"] for r in own), s) for s, own in groups.items()), key=lambda x: (-x[0], x[1]))
        for size, s in sized:
            while (hit := w.fit(size)) is None and w.full():
                w.emit_fullest()
            n, offset = hit if hit is not None else (w.new(size), 0)
            rows.setdefault(n, []).extend((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"], base + n, offset + r["offset"]) for r in groups[s])
        still = w.open()
        out = [(*r, n not in still) for n, own in rows.items() for r in own]
        if out:
            yield _batch(out)

    return run


def pack(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 0, length: int = LENGTH, open_windows: int = OPEN, min_cut: int = MIN_CUT) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = tokenizer_path or public_path("byte_bpe_50k.json")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed = materialize(slim.mapInArrow(_pack(path, end_id, length, open_windows, min_cut), _SCHEMA), "packed")
    done = packed.where("closed")
    rest = packed.where("not closed")
    group = F.floor(F.col("sequence_id") / F.lit(_SEQUENCES))
    parts = (rest.agg(F.max(group)).first()[0] or 0) + 1
    level = 0
    while True:
        level += 1
        parts = -(-parts // FAN_IN)
        # a group of tasks meets in one task: a fixed number of open windows each
        merged = materialize(rest.repartition(parts, F.floor(group / F.lit(FAN_IN))).mapInArrow(_merge(length, open_windows, level), _SCHEMA) if parts > 1 else rest.coalesce(1).mapInArrow(_merge(length, open_windows, level), _SCHEMA), "packed")
        if parts == 1:
            return done.unionByName(merged).drop("closed")
        done, rest = done.unionByName(merged.where("closed")), merged.where("not closed")
