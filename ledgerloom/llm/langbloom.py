"""Language identification by n-gram filters with one bit for each language.

The n-grams are four bytes of text, lower-cased in ASCII, with anything but letters as blanks. Each language has a
Bloom filter of the n-grams that are common in it, and the filters are bit-sliced: a slot holds one bit per language,
so the bitwise and of an n-gram's slots names all languages that contain it. A text's bits are counted per language,
corrected for the filters' false positives, and the largest corrected count decides; its share is the score.

An n-gram enters a language's filter if its share among that language's n-grams is at least `min_share`, so a filter
holds at most 1/min_share n-grams, and that many come to the driver for each language. Counts cover all training rows.

Null text, and text without a letter, is `und` with score 0; so is all text if there is nothing to learn from. Text in
which no n-gram is known goes to the most frequent learned language, with score 1/languages. Ties go to the more
frequent language, then by name. Rows come out one for one; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_slices, materialize, slices
from .textops import LOWER, U, crc32_mod, mix, text_bytes

N, MIN_SHARE, HASHES, BITS_EACH = 4, 4e-6, 4, 12
HELD_MOD, HELD = 4, 2

#: Letters and bytes beyond ASCII as they are, lower-cased; all others as blanks.
_FOLD = np.full(256, 0x20, np.uint8)
for _b in [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    _FOLD[_b] = LOWER[_b]


def grams(data: np.ndarray, ofs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Four-byte n-grams of each text, set between blanks, and their texts; those of three blanks or more are left out."""
    n = len(ofs) - 1
    size = np.diff(ofs)
    to = np.full(len(data) + 4 * n, 0x20, np.uint8)
    doc = np.repeat(np.arange(n), size)
    to[np.arange(len(data)) + 4 * doc + 1] = _FOLD[data]
    if len(to) < 4:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    w = to.astype(np.uint32)
    g = w[:-3] | w[1:-2] << np.uint32(8) | w[2:-1] << np.uint32(16) | w[3:] << np.uint32(24)
    blank = to == 0x20
    few = blank[:-3].astype(np.int8) + blank[1:-2] + blank[2:-1] + blank[3:] < 3
    own = np.repeat(np.arange(n), size + 4)[:-3]
    return g[few], own[few]


def gram_counts(train: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows of train (text, lang): counted in each task first, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for part in slices(batches, most=8 << 20):
            langs = np.array(part.column("lang").to_pylist(), object)
            for lang in sorted(set(langs.tolist())):
                rows = part.filter(pa.array(langs == lang))
                g, _ = grams(*text_bytes(rows.column("text")))
                own = held.setdefault(lang, [])
                own.append(np.unique(g, return_counts=True))
                if len(own) > 8:
                    held[lang] = [_summed(own)]
        for lang, own in held.items():
            g, c = _summed(own)
            for i in range(0, len(g), 65536):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g[i : i + 65536]), pa.string()), pa.array(g[i : i + 65536].astype(np.int64)), pa.array(c[i : i + 65536].astype(np.int64))], ["lang", "gram", "n"])

    return train.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _summed(own: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    g, at = np.unique(np.concatenate([x for x, _ in own]), return_inverse=True)
    return g, np.bincount(at, np.concatenate([c for _, c in own]), len(g))


class Filters:
    """Bit-sliced Bloom filters: slots x words of 64 bits, one bit for each language."""

    def __init__(self, langs: list[str], members: list[tuple[int, np.ndarray]], hashes: int = HASHES, bits_each: int = BITS_EACH):
        self.langs, self.hashes = langs, hashes
        most = max((len(g) for _, g in members), default=1)
        self.bits = max(10, int(most * bits_each - 1).bit_length())
        self.table = np.zeros((1 << self.bits, max(1, -(-len(langs) // 64))), U)
        for lang, g in members:
            for slot in self._slots(g):
                np.bitwise_or.at(self.table[:, lang // 64], slot, U(1 << (lang % 64)))
        fill = np.array([np.count_nonzero(self.table[:, i // 64] & U(1 << (i % 64))) for i in range(len(langs))]) / len(self.table)
        self.false = fill**hashes

    def _slots(self, g: np.ndarray) -> list[np.ndarray]:
        h = mix(g.astype(U) + U(1 << 33))
        step = mix(h) | U(1)
        return [((h + U(i) * step) >> U(64 - self.bits)).astype(np.int64) for i in range(self.hashes)]

    def masks(self, g: np.ndarray) -> np.ndarray:
        """For each n-gram the languages whose filters contain it, as bits."""
        first, *rest = self._slots(g)
        out = self.table[first].copy()
        for slot in rest:
            out &= self.table[slot]
        return out

    def counts(self, g: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
        """Per text and language the n-grams contained, less the false positives to expect."""
        m = self.masks(g)
        total = np.bincount(doc, minlength=n_docs)
        out = np.empty((n_docs, len(self.langs)))
        for i in range(len(self.langs)):
            hit = np.bincount(doc[(m[:, i // 64] >> U(i % 64) & U(1)).astype(bool)], minlength=n_docs)
            out[:, i] = np.maximum(0, (hit - self.false[i] * total) / (1 - self.false[i]))
        return out


def learn(train: DataFrame, min_share: float = MIN_SHARE) -> Filters | None:
    """The filters of the languages in train (text, lang), those with more n-grams first."""
    counts = gram_counts(train.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null"))
    counts = materialize(counts, "lang-grams")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(totals, key=lambda x: (-totals[x], x))
    if not langs:
        return None
    share = F.col("n") / F.element_at(F.create_map(*[F.lit(x) for k, v in totals.items() for x in (k, float(v))]), F.col("lang"))
    kept = counts.where(share >= min_share).select("lang", "gram").toArrow()
    lang, gram = np.array(kept.column("lang").to_pylist(), object), kept.column("gram").to_numpy().astype(np.uint32)
    return Filters(langs, [(i, np.sort(gram[lang == x])) for i, x in enumerate(langs)])


def identify(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score. Rows with crc32(doc_id) mod 4 = 2 are not learned from."""
    held = crc32_mod("doc_id", HELD_MOD) == HELD
    filters = learn(docs.where(~held))
    kind = dict(docs.dtypes)["doc_id"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, ofs = text_bytes(batch.column("text"))
        n = batch.num_rows
        ascii_letter = np.concatenate([[0], np.cumsum((LOWER[data] >= 0x61) & (LOWER[data] <= 0x7A))])
        letters = ascii_letter[ofs[1:]] > ascii_letter[ofs[:-1]]
        for i in np.flatnonzero(~letters):
            letters[i] = any(c.isalpha() for c in data[ofs[i] : ofs[i + 1]].tobytes().decode("utf-8", "replace"))
        pred, score = np.full(n, "und", object), np.zeros(n)
        if filters is not None:
            c = filters.counts(*grams(data, ofs), n)
            total = c.sum(1)
            best = c.argmax(1)
            pred[letters] = np.array(filters.langs, object)[best[letters]]
            score = np.where(letters, np.where(total > 0, c[np.arange(n), best] / np.where(total > 0, total, 1), 1 / len(filters.langs)), 0.0)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(pred.tolist(), pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return map_slices(docs.select("doc_id", held.alias("held_out"), F.col("text").cast("string").alias("text")), run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
