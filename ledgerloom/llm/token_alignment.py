"""Alignment of two tokenizers' tokens by byte offsets, as relations of exploded tokens.

A text with its leading space is cut into pieces before a blank, and on both sides of a line break, that stand between
visible characters. Both tokenizers end a token at each such place, whatever stands around it: the byte-level one splits
there before it merges, and no entry of the other has a blank after another character (`PieceCoder` checks its
vocabulary). So the tokens of a piece don't depend on its text, and a text's groups and links are those of its pieces in
a row. Each distinct piece of a block of texts is encoded and aligned once; the rest is sums over where it occurs.

Tokens are exploded with their positions; running sums of their lengths give their ends; both sides meet by piece and end, in
one grouping (a full outer join would forget how its rows lie, and shuffle them). Between two neighbouring ends there is
one token of either side, so every row that comes of it is one link: of the tokens that end there or, seen from the text's end, began last before it. Running counts
of common ends number the groups. No pairs within a group are tried, so a group of any length is linear.

The tables of a block are bucketed by it and stay where they are: nothing of a piece or a document is shuffled. A block's pieces
and documents meet in one task of bounded size, which counts documents by id pair, and strings the pieces of each document
together; only those counts are shuffled.

A row is a document, whether or not its id is null or repeated. Null and empty texts, and texts that either side's bytes don't give
back (those with U+2581, which the second side reads as a blank), have zeros and ''. A block has about `block_bytes` of
text, a longer text alone. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import fresh_path, materialize, release, slices, temporary
from .tokenization import odd_space, public_path

#: A token travels as length, one bit for its side, id.
ID_BITS = 20
#: In a link, whose ids have bits 32 and 0 on: whether a token of the first, of the second side ends with it.
A_ENDS, B_ENDS = 1 << ID_BITS, 2 << ID_BITS
#: A piece's number: its partition, the block within that, the piece within the block.
PIECE_BITS, BLOCK_BITS = 30, 13
#: Pieces encoded, or written as text, in one call.
AT_ONCE = 1 << 15
_CUT = re.compile(r"(?<=\S)(?= \S)|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")
#: Fixed value: how byte-level tokenizers of this kind split a text before they merge.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BYTE_PIECE = re.compile(r"<0x([0-9A-Fa-f]{2})>")


def _marked(text: str) -> str:
    """The pieces of a text without NUL, with NUL between them."""
    if odd_space(text):
        return "\0".join(_CUT.split(" " + text))
    return " " + text.replace("\n", "\0\n\0").replace(" ", "\0 ")


def cut(text: str) -> list[str]:
    """The pieces of a text with its leading space; together they give it back."""
    return _CUT.split(" " + text) if "\0" in text else _marked(text).split("\0")


def _numbered(texts: list[str | None]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct pieces of the texts; the numbers of the pieces that they hold, in order; how many each text holds."""
    split = pa.compute.split_pattern(pa.array([_marked(t) if t and "\0" not in t else None for t in texts], pa.string()), "\0")
    size = split.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    begin, pieces = np.cumsum(size) - size, [split.flatten()]
    del split
    at = len(pieces[0])
    for i, t in enumerate(texts):
        if t and "\0" in t:
            pieces.append(pa.array(cut(t), pa.string()))
            begin[i], size[i] = at, len(pieces[-1])
            at += len(pieces[-1])
    coded = pa.concat_arrays(pieces).dictionary_encode()
    inside = coded.indices.to_numpy(zero_copy_only=False)
    return coded.dictionary, inside if len(pieces) == 1 else inside[_spread(begin, size)], size


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For every row its places: size[i] of them from begin[i] on."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _flatten(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    n = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.int32, int(n.sum())), n


class ByteCoder:
    """Ids of a byte-level tokenizer, special strings being plain text, and the bytes of its entries.

    The merges of its file are worked by tiktoken, which is several times quicker on short pieces; ids that don't follow
    the merges, or other settings than those checked here, are refused.
    """

    def __init__(self, path: str):
        import tiktoken

        from .tokenization import BYTE_ALPHABET

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges, split = spec["model"]["vocab"], spec["model"]["merges"], spec["pre_tokenizer"]
        plain = spec["normalizer"] is None and split["type"] == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
        special = {x["content"] for x in spec["added_tokens"]}
        if not plain or any(vocab["".join(m if isinstance(m, list) else m.split(" "))] != 256 + i for i, m in enumerate(merges)):
            raise ValueError("not a plain byte-level vocabulary in the order of its merges")
        byte_of = {c: b for b, c in BYTE_ALPHABET.items()}
        self.bytes = {i: bytes(byte_of[c] for c in entry) for entry, i in vocab.items() if entry not in special}
        self.length = np.array([len(self.bytes.get(i, b"")) for i in range(max(self.bytes) + 1)])
        self.model = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks={b: i for i, b in self.bytes.items()}, special_tokens={})

    def ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each piece has.

        Pieces of a blank and visible characters at both ends go in one call, as the split ends a match before such a blank.
        """
        plain = np.fromiter((p[0] == " " and not p[1:2].isspace() and not p[-1].isspace() for p in pieces), bool, len(pieces))
        joined = list(compress(pieces, plain))
        text = "".join(joined)
        flat = np.array(self.model.encode_ordinary(text), np.int32)
        ends = np.cumsum([len(p) for p in joined] if text.isascii() else [len(p.encode()) for p in joined], dtype=np.int64)
        at = np.searchsorted(np.cumsum(self.length[flat]), ends, side="right")
        rest, n_rest = _flatten([self.model.encode_ordinary(p) for p in compress(pieces, ~plain)])
        n = np.zeros(len(pieces), np.int64)
        n[plain], n[~plain] = np.diff(at, prepend=0), n_rest
        begin = np.zeros(len(pieces), np.int64)
        begin[plain], begin[~plain] = at - n[plain], len(flat) + np.cumsum(n_rest) - n_rest
        return np.concatenate([flat, rest])[_spread(begin, n)], n


class PieceCoder:
    """Ids of a piece tokenizer, which puts a blank before a text itself, and the bytes of its entries."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = {}
        for i in range(self.model.get_piece_size()):
            entry = self.model.id_to_piece(i)
            if "▁" in entry.lstrip("▁") or "\n" in entry or " " in entry:
                raise ValueError("an entry of the vocabulary reaches over a place at which texts are cut")
            byte = _BYTE_PIECE.fullmatch(entry) if self.model.is_byte(i) else None
            self.bytes[i] = bytes([int(byte[1], 16)]) if byte else entry.replace("▁", " ").encode()

    def ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each piece has."""
        # a line break joins nothing; the blank before it and itself are dropped again
        own = [p[0] == " " and len(p) > 1 for p in pieces]
        got = self.model.encode([p[1:] if o else "\n" + p for p, o in zip(pieces, own, strict=True)], num_threads=1)
        return _flatten([x if o else x[2:] for x, o in zip(got, own, strict=True)])


class Aligner:
    """tokens(pieces): both sides' packed tokens of all pieces in a row, how many each piece has, and which pieces a side doesn't give back."""

    def __init__(self, a_path: str, b_path: str):
        self.sides = ByteCoder(a_path), PieceCoder(b_path)
        self.packed = []
        self.entries = [pa.array([side.bytes.get(i, b"") for i in range(max(side.bytes) + 1)], pa.binary()) for side in self.sides]
        for k, side in enumerate(self.sides):
            table = np.zeros(max(side.bytes) + 1, np.int32)
            for i, raw in side.bytes.items():
                table[i] = len(raw) << (ID_BITS + 1) | k << ID_BITS | i
            self.packed.append(table)

    def tokens(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = pa.compute.binary_length(pieces).to_numpy().astype(np.int64)
        names, raw, ends = pieces.to_pylist(), _bytes(pieces), np.cumsum(size)
        lost = np.zeros(len(size), bool)
        flat, counts = [], []
        for side, entries, table in zip(self.sides, self.entries, self.packed, strict=True):
            ids, n = side.ids(names)
            total = np.concatenate([[0], np.cumsum(table[ids] >> (ID_BITS + 1))])
            end = np.cumsum(n)
            lost |= total[end] - total[end - n] != size
            back = _bytes(entries.take(pa.array(ids)))
            if back != raw:
                lost |= np.array([back[t:u] != raw[v:w] for t, u, v, w in zip(total[end - n], total[end], ends - size, ends, strict=True)], bool)
            flat.append(table[ids])
            counts.append(n)
        n = counts[0] + counts[1]
        out = np.empty(int(n.sum()), np.int32)
        at = np.cumsum(n) - n
        for tokens, k, begin in zip(flat, counts, (at, at + counts[0]), strict=True):
            out[_spread(begin, k)] = tokens
        return out, n, lost


def _bytes(values: pa.Array) -> bytes:
    """The bytes of an array of strings in a row."""
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int32)[values.offset : values.offset + len(values) + 1]
    return data[int(at[0]) : int(at[-1])].to_pybytes() if len(values) and data is not None else b""


_ALIGNERS: dict[tuple[str, str], Aligner] = {}
_NAMES = ["block", "piece", "tokens", "row", "doc_id", "held"]


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, pa.int32()))


def _block(aligner: Aligner, batch: pa.RecordBatch, block: int) -> list[pa.RecordBatch]:
    """The distinct pieces of the texts with their tokens, and the documents with the pieces that they hold, in order."""
    names, inside, begun = _numbered(batch.column("text").to_pylist())
    # few at a time: lists of Python's numbers take many times the bytes of their text
    parts = [aligner.tokens(names.slice(i, AT_ONCE)) for i in range(0, max(1, len(names)), AT_ONCE)]
    tokens, n_tokens, lost = map(np.concatenate, zip(*parts, strict=True))
    if lost.any():
        of = np.repeat(np.arange(len(begun)), begun)
        whole = np.bincount(of[lost[inside]], minlength=len(begun)) == 0
        inside, begun = inside[whole[of]], np.where(whole, begun, 0)
    used = np.bincount(inside, minlength=len(names)) > 0
    pieces = np.flatnonzero(used)
    rows, k = batch.num_rows, len(pieces)
    ids = batch.column("doc_id")
    of_pieces = [pa.array(np.full(k, block)), pa.array(block << PIECE_BITS | pieces), _lists(tokens[np.repeat(used, n_tokens)], n_tokens[used]), pa.nulls(k, pa.int32()), pa.nulls(k, ids.type), pa.nulls(k, pa.list_(pa.int32()))]
    of_docs = [pa.array(np.full(rows, block)), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.list_(pa.int32())), pa.array(np.arange(rows), pa.int32()), ids, _lists(inside, begun)]
    return [pa.RecordBatch.from_arrays(x, _NAMES) for x in (of_pieces, of_docs)]


def token_table(docs: DataFrame, a_path: str, b_path: str, block_bytes: int) -> DataFrame:
    """Rows of pieces (block, piece, tokens) and of documents (block, row, doc_id, held: numbers of pieces in the block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (a_path, b_path) not in _ALIGNERS:
            _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
        aligner, partition = _ALIGNERS[a_path, b_path], TaskContext.get().partitionId()
        for i, part in enumerate(slices(batches, "text", block_bytes)):
            if i >> BLOCK_BITS or partition >> (63 - PIECE_BITS - BLOCK_BITS):
                raise ValueError("too many blocks to number: make them larger, or partitions smaller")
            yield from _block(aligner, part, partition << BLOCK_BITS | i)
        release()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"block long, piece long, tokens array<int>, row int, doc_id {kind}, held array<int>")


@contextmanager
def _sorted_together(spark: SparkSession) -> Iterator[None]:
    """Jobs in it join tables that are bucketed by block on block and more without a shuffle, and group rows that lie in order as they lie."""
    wanted = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.execution.replaceHashWithSortAgg": "true"}
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def _parts(spark: SparkSession) -> int:
    """Buckets and partitions: several to a shuffle partition, so that few hold more than one block."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def _bucketed(spark: SparkSession) -> Iterator:
    """store(df, name): writes df bucketed by block to the shared folder; the catalog's entries go at the end."""
    names = []

    def store(df: DataFrame, name: str) -> DataFrame:
        table = f"{name}_{uuid.uuid4().hex}"
        names.append(table)
        df.write.format("parquet").option("compression", "zstd").bucketBy(_parts(spark), "block").option("path", fresh_path(spark, name)).saveAsTable(table)
        return spark.table(table)

    try:
        yield store
    finally:
        for table in names:
            spark.sql(f"DROP TABLE IF EXISTS {table}")


def aligned(pieces: DataFrame) -> DataFrame:
    """(block, piece, rest, a, b, link, group) of (block, piece, tokens): a row for each end of either side, with the ids of the tokens that end there; rest is the end, negative; link packs the ids of the tokens that hold the bytes before it, group counts from the text's end.

    Rows are sorted twice: by place in the tokens, and by rest, which both the grouping and the way back from the text's end want.
    """
    length, side, id_ = F.shiftright("token", ID_BITS + 1), F.shiftright("token", ID_BITS).bitwiseAND(1), F.col("token").bitwiseAND((1 << ID_BITS) - 1)
    exploded = pieces.select("block", "piece", F.posexplode("tokens").alias("pos", "token"))
    # the piece leads, as its number tells rows apart: a task has few blocks
    running = Window.partitionBy("piece", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    # the second side's tokens follow the first's, which have the whole piece
    rest = F.when(side == 0, F.lit(0)).otherwise(F.sum(F.when(side == 0, length)).over(running)) - F.sum(length).over(running)
    # a hash table of all ends would fill the memory; sorted, they are grouped as they lie (max() would have the sort dropped)
    of = lambda k, name: F.first(F.when(side == k, id_), ignorenulls=True).alias(name)
    ends = exploded.select("block", "piece", rest.alias("rest"), "token").sortWithinPartitions("piece", "block", "rest")
    both = ends.groupBy("piece", "block", "rest").agg(of(0, "a"), of(1, "b"))
    back = Window.partitionBy("piece", "block").orderBy("rest").rowsBetween(Window.unboundedPreceding, 0)
    holds = lambda side: F.last(side, ignorenulls=True).over(back)
    link = F.shiftleft(holds("a").cast("long"), 32).bitwiseOR(holds("b").cast("long"))
    return both.select("block", "piece", "rest", "a", "b", link.alias("link"), F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).over(back).alias("group"))


def piece_table(pieces: DataFrame) -> DataFrame:
    """(block, piece, n_a, n_b, n_groups, n_links, rests, links) of (block, piece, tokens); a link also has a bit for each side that ends a token there."""
    ends = lambda c, bit: F.when(F.col(c).isNull(), F.lit(0)).otherwise(F.lit(bit))
    rows = aligned(pieces).withColumn("link", F.col("link").bitwiseOR(ends("a", A_ENDS) + ends("b", B_ENDS)))
    return rows.groupBy("piece", "block").agg(F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.max("group").alias("n_groups"), F.count(F.lit(1)).alias("n_links"), F.collect_list(F.col("rest").cast("int")).alias("rests"), F.collect_list("link").alias("links"))


def _flat(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """A column of lists as all values and, by row, how many."""
    column = table.column(name)
    parts = [c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]
    sizes = [c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for c in column.chunks]
    return np.concatenate([*parts, np.zeros(0, np.int32)]) if parts else np.zeros(0, np.int64), np.concatenate([*sizes, np.zeros(0, np.int32)]).astype(np.int64)


def _pairs(pieces: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All id pairs of a block's pieces and, by piece, how many."""
    links, size = _flat(pieces, "links")
    np.bitwise_and(links, ~(A_ENDS | B_ENDS), out=links)
    return links, size


def _rows(pieces: pa.Table) -> np.ndarray:
    """Where each piece of a block stands in its table, by its number in the block."""
    number = pieces.column("piece").to_numpy() & ((1 << PIECE_BITS) - 1)
    at = np.zeros(int(number.max(initial=-1)) + 1, np.int32)
    at[number] = np.arange(len(number))
    return at


def _texts(docs: pa.Table) -> Iterator[np.ndarray]:
    """The pieces of each document of a block."""
    held, size = _flat(docs, "held")
    end = np.cumsum(size)
    for e, n in zip(end.tolist(), size.tolist(), strict=True):
        yield held[e - n : e]


def _holders(key: tuple, pieces: pa.Table, docs: pa.Table) -> pa.Table:
    """(block, link, n): in how many of a block's documents each id pair is linked."""
    links, size = _pairs(pieces)
    begin, at = np.cumsum(size) - size, _rows(pieces)
    coded = pa.array(links, pa.int64()).dictionary_encode()
    pairs, pair = coded.dictionary, coded.indices.to_numpy()
    del links
    count = np.zeros(len(pairs), np.int64)
    for held in _texts(docs):
        if len(held):
            rows = at[np.unique(held)]
            count[pair[_spread(begin[rows], size[rows])]] += 1  # one for a document, however often a pair is there
    release()
    return pa.table({"block": pa.array(np.full(len(pairs), key[0].as_py(), np.int64)), "link": pairs, "n": count})


def link_counts(holders: DataFrame) -> DataFrame:
    """(link, n, best): in how many documents each id pair is linked, and whether that is the most of its first id."""
    counts = holders.groupBy("link").agg(F.sum("n").alias("n"))
    return counts.withColumn("best", (F.col("n") == F.max("n").over(Window.partitionBy(F.shiftright("link", 32)))).cast("long"))


_SUMS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


@lru_cache(maxsize=None)
def _numerals(n: int) -> pa.Array:
    """Each number below n with each mark that can follow it."""
    return pa.array([f"{i}{mark}" for i in range(n) for mark in ",|;"], pa.large_binary())


def _group_bytes(rests: np.ndarray, links: np.ndarray, size: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The groups of pieces in a row, a semicolon after each, and how many bytes each piece has; both lists are in one order within a piece."""
    piece = np.repeat(np.arange(len(size)), size)
    # they come from the piece's end on, though nothing says that they must
    falls = ((np.diff(rests) <= 0) & (np.diff(piece) == 0)).any()
    links = links[np.lexsort((-rests, piece)) if falls else np.repeat(2 * np.cumsum(size) - size - 1, size) - np.arange(len(links))]
    ends = (links & A_ENDS) > 0, (links & B_ENDS) > 0
    both = ends[0] & ends[1]
    group, last = np.cumsum(both) - both, np.flatnonzero(both)
    rows = [np.flatnonzero(e) for e in ends]
    n_a, n_b = (np.bincount(group[r], minlength=len(last)) for r in rows)
    begin = np.cumsum(n_a + n_b) - n_a - n_b
    tokens = np.empty(int((n_a + n_b).sum()), np.int64)
    for r, n, first, ids, mark in ((rows[0], n_a, begin, links >> 32, 1), (rows[1], n_b, begin + n_a, links & ((1 << ID_BITS) - 1), 2)):
        tokens[_spread(first, n)] = 3 * ids[r] + mark * both[r]
    numerals = _numerals(1 << int(tokens.max(initial=0) // 3).bit_length())
    text = numerals.take(pa.array(tokens))
    at = np.frombuffer(text.buffers()[1], np.int64)[: len(tokens) + 1]
    in_groups = np.bincount(piece[last], weights=n_a + n_b, minlength=len(size)).astype(np.int64)
    return text.buffers()[2][: int(at[-1])].to_pybytes() if len(tokens) else b"", np.diff(at[np.concatenate([[0], np.cumsum(in_groups)])])


def _group_texts(pieces: pa.Table) -> pa.Array:
    """The groups of each piece of a block as text, a semicolon after each."""
    (rests, size), (links, _) = _flat(pieces, "rests"), _flat(pieces, "links")
    to, parts = np.concatenate([[0], np.cumsum(size)]), [(b"", np.zeros(1, np.int64))]
    for i in range(0, len(size), AT_ONCE):
        here = slice(int(to[i]), int(to[min(i + AT_ONCE, len(size))]))
        parts.append(_group_bytes(rests[here], links[here], size[i : i + AT_ONCE]))
    texts, lengths = zip(*parts, strict=True)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.cumsum(np.concatenate(lengths))), pa.py_buffer(b"".join(texts))])


def _joined(groups: pa.Array, rows: np.ndarray, digest: bool) -> str:
    """The groups of pieces strung together, without the last semicolon, or the digest of that."""
    if not len(rows):
        return ""
    state, parts = hashlib.sha256(), []
    for i in range(0, len(rows), AT_ONCE):
        part = groups.take(pa.array(rows[i : i + AT_ONCE]))
        data = memoryview(part.buffers()[2])[: int(np.frombuffer(part.buffers()[1], np.int64)[len(part)]) - (i + AT_ONCE >= len(rows))]
        state.update(data) if digest else parts.append(bytes(data))
    return state.hexdigest() if digest else b"".join(parts).decode()


def _assembled(pieces: pa.Table, docs: pa.Table, digest: bool) -> pa.Table:
    """A block's documents with their sums and groups; the row numbered 0 has the counts of the block's id pairs."""
    links, size = _pairs(pieces)
    first = docs.filter(pa.compute.equal(docs.column("row"), 0))
    pair, n, best = (_flat(first, c)[0] for c in ("pairs", "counts", "bests"))
    weight = pa.compute.index_in(pa.array(links, pa.int64()), value_set=pa.array(pair, pa.int64())).to_numpy()
    del links
    total = lambda x: np.add.reduceat(x[weight], np.cumsum(size) - size)
    sums = np.stack([*(pieces.column(c).to_numpy() for c in _SUMS[:4]), total(best), total(n)], axis=1).astype(np.int64) if pieces.num_rows else np.zeros((0, 6), np.int64)
    del weight
    groups, at = _group_texts(pieces), _rows(pieces)
    of_docs, texts = np.zeros((docs.num_rows, 6), np.int64), []
    for i, held in enumerate(_texts(docs)):
        rows = at[held] if len(held) else held
        of_docs[i] = sums[rows].sum(axis=0)
        texts.append(_joined(groups, rows, digest))
    release()
    return pa.table({"doc_id": docs.column("doc_id"), **{c: of_docs[:, k] for k, c in enumerate(_SUMS)}, "groups": pa.array(texts, pa.string())})


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, block_bytes: int = 16 << 20, digest: bool = False) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups (text: a1,a2|b1;a3|b2,b3; with digest its SHA-256, '' without tokens)."""
    spark = docs.sparkSession
    path = fresh_path(spark, "alignment")
    kind = docs.schema["doc_id"].dataType.simpleString()
    with temporary(spark), _bucketed(spark) as store, _sorted_together(spark):
        table = store(token_table(docs, a_path or public_path("byte_bpe_50k.json"), b_path or public_path("piece_bpe_32k.model"), block_bytes), "alignment_tokens")
        texts = table.where("row is not null").select("block", "row", "doc_id", "held")
        found = store(piece_table(table.where("piece is not null").select("block", "piece", "tokens")), "alignment_pieces")
        holders = found.select("block", "piece", "links").groupBy("block").cogroup(texts.select("block", "held").groupBy("block")).applyInArrow(_holders, "block long, link long, n long")
        holders = materialize(holders, "alignment-holders")
        weights = holders.select("block", "link").join(link_counts(holders), "link").groupBy("block").agg(F.collect_list(F.struct("link", "n", "best")).alias("all"))
        weights = weights.select("block", F.lit(0).alias("row"), F.col("all.link").alias("pairs"), F.col("all.n").alias("counts"), F.col("all.best").alias("bests"))
        whole = texts.join(weights, ["block", "row"], "left")
        assemble = lambda pieces, texts: _assembled(pieces, texts, digest)
        out = found.groupBy("block").cogroup(whole.groupBy("block")).applyInArrow(assemble, f"doc_id {kind}, {', '.join(f'{c} long' for c in _SUMS)}, groups string")
        out.write.parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def alignment_digests(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, the counts of align(), groups_sha256 ('' without tokens)."""
    return align(docs, digest=True).withColumnRenamed("groups", "groups_sha256")
