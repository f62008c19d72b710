"""Token counts of whole texts, huge ones by overlap resynchronisation.

A text of more than `huge` characters is encoded in chunks that overlap, with offsets. Two neighbouring chunks are
spliced at a boundary in their overlap at which both begin a token and before which stands white space: the tokenizer
drops white space and never merges across it, so what stands on either side cannot change the other. The left chunk counts up
to there and the right one from there on, and both have to give the same tokens from the boundary to the overlap's
last white space. When no such boundary exists or the tokens differ, the overlap is widened, up to the rest of the text.
Other texts are encoded whole, each distinct unit between blanks once per worker. A text that holds the string of a special
token is taken apart there first, as the library does, so that its parts go either way too.

Null text counts as empty. Rows come out one for one, also repeated ones and those without an id; extra columns are
ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_slices
from .textops import text_bytes
from .tokenization import counter, public_path

LIMIT, CHUNK, OVERLAP = 2048, 16_384, 256


def _encode(tok, text: str, lo: int, hi: int) -> list[tuple[int, int]]:
    """(start in the whole text, id) of the tokens of text[lo:hi]."""
    e = tok.encode(text[lo:hi], add_special_tokens=False)
    return [(lo + a, i) for (a, _), i in zip(e.offsets, e.ids, strict=True)]


def _blank(c: str) -> bool:
    """White space to the tokenizer: the four separators from U+001C on are none."""
    return c.isspace() and not "\x1c" <= c <= "\x1f"


def _splice(text: str, lo: int, hi: int, left: list[tuple[int, int]], right: list[tuple[int, int]]) -> int | None:
    """The first proven boundary in the overlap text[lo:hi], if there is one."""
    stop = hi
    while stop > lo and not _blank(text[stop - 1]):
        stop -= 1
    ours, theirs = ([t for t in x if lo < t[0] < stop] for x in (left, right))
    begins = {t[0] for t in theirs}
    for p, _ in ours:
        if _blank(text[p - 1]) and p in begins:
            return p if [t for t in ours if t[0] >= p] == [t for t in theirs if t[0] >= p] else None
    return None


def spliced_count(tok, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """The number of tokens of a text of any length, with about one chunk's encoding in memory."""
    total, begin, reach = 0, 0, min(len(text), chunk)  # tokens that begin before `begin` are counted
    tokens = _encode(tok, text, 0, reach)
    while reach < len(text):
        wide = overlap
        while True:
            lo = max(begin, reach - wide)
            end = min(len(text), reach + chunk)
            following = _encode(tok, text, lo, end)
            p = _splice(text, lo, reach, tokens, following)
            if p is not None:
                total += sum(begin <= s < p for s, _ in tokens)
                begin, tokens, reach = p, following, end
                break
            if lo == begin:  # the overlap is all there is since the last boundary: go on from that as one chunk
                reach = min(len(text), reach + max(chunk, reach - begin))
                tokens = _encode(tok, text, begin, reach)
                break
            wide *= 4
    return total + sum(s >= begin for s, _ in tokens)


def count_tokens(docs: DataFrame, tokenizer_path: str | None = None, limit: int = LIMIT, huge: int = 2 * CHUNK, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit."""
    path = tokenizer_path or public_path("word_bpe_49k.json")
    kind = dict(docs.dtypes)["doc_id"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        count = counter(path)
        _, ofs = text_bytes(batch.column("text"))
        n = [0] * batch.num_rows
        small: list[tuple[int, str]] = []
        for i, t in enumerate(batch.column("text").to_pylist()):
            parts = count.special.split(t or "")
            n[i] = len(parts) - 1
            for part in parts:
                if len(part) <= huge:
                    small.append((i, part))
                else:
                    n[i] += spliced_count(count.tok, part, chunk, overlap)
        for (i, _), x in zip(small, count.count([p for _, p in small]), strict=True):
            n[i] += x
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ofs[1:] - ofs[:-1]), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_slices(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
