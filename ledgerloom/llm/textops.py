"""Byte-level text helpers in numpy. Texts are UTF-8; letters beyond ASCII count as word characters."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
_M1, _M2, _GOLD = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)

#: Words are runs of digits, ASCII letters and anything beyond ASCII.
IS_WORD = np.zeros(256, bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x41:0x5B] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: 64-bit values to well spread 64-bit values."""
    x = x + _GOLD
    x = (x ^ (x >> U(30))) * _M1
    x = (x ^ (x >> U(27))) * _M2
    return x ^ (x >> U(31))


def mixed(value: int) -> np.uint64:
    return mix(np.array([value], U))[0]


BYTE_HASH = mix(np.arange(256, dtype=U) + U(1 << 20))
_BASE = U(0x5851F42D4C957F2D)


@lru_cache(maxsize=2)
def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, U)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(n: int) -> np.ndarray:
    """The first n powers of the odd hash base, modulo 2**64."""
    return _powers(max(1024, 1 << (n - 1).bit_length() if n > 1 else 1024))[:n]


_INVERSE = U(pow(int(_BASE), -1, 1 << 64))


@lru_cache(maxsize=2)
def _inverse_powers(n: int) -> np.ndarray:
    out = np.full(n, _INVERSE, U)
    out[0] = 1
    return np.multiply.accumulate(out)


def inverse_powers(n: int) -> np.ndarray:
    return _inverse_powers(max(1024, 1 << (n - 1).bit_length() if n > 1 else 1024))[:n]


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the n+1 offsets of its values; null counts as empty."""
    if not (pa.types.is_string(col.type) or pa.types.is_binary(col.type)):
        col = col.cast(pa.string())
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) else b"")
    n = len(col)
    _, ofs, data = col.buffers()
    offsets = np.frombuffer(ofs, np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words of a batch of texts: byte spans, 64-bit hashes of their lower-cased bytes, and first words per text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        word = IS_WORD[data]
        before = np.zeros(len(data), bool)
        before[1:] = word[:-1]
        after = np.zeros(len(data), bool)
        after[:-1] = word[1:]
        if len(data):
            first = offsets[:-1]
            before[first[first < len(data)]] = False
            last = offsets[1:] - 1
            after[last[last >= 0]] = False
        self.starts = np.flatnonzero(word & ~before)
        self.ends = np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        lens = self.ends - self.starts
        self.hash = np.zeros(0, U)
        if len(lens):
            at = np.cumsum(lens) - lens
            pos = np.arange(int(lens.sum())) - np.repeat(at, lens)
            self.hash = mix(np.add.reduceat(BYTE_HASH[LOWER[data[word]]] * powers(int(lens.max()))[pos], at))

    def shingles(self, k: int) -> np.ndarray:
        """At each word the hash of it and the k-1 that follow; only the caller knows which lie in one text."""
        h = self.hash
        out = h.copy()
        for j in range(1, k):
            out *= _BASE
            out[:-j or None] += h[j:]
        return mix(out)


def crc32_mod(column: str, modulus: int):
    """crc32 of an id written as text, modulo `modulus`, as a Spark column; null ids count as empty text."""
    from pyspark.sql import functions as F

    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))
