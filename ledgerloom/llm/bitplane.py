"""Token ids in files of bit planes.

File format (little-endian): magic "LLBP0001"; then chunks; then the index as zstandard-compressed JSON; then its length
(8 bytes) and the magic again. A chunk is a block of a fixed number of ids (the last one may be shorter). Its ids are
taken apart into bit planes (or byte planes): plane p holds bit p of every id, packed eight to a byte. Each plane is
compressed with zstandard by itself. The index lists, per chunk, its place, number of ids and plane sizes, and, per
document, doc_id and number of ids, in file order.

Documents are dealt by ranges of doc_id, so that files and the documents in them ascend. A task begins another file after
`FILE_IDS` ids or `FILE_DOCS` documents, so that no index outgrows memory. Each file is written under a temporary name and
renamed, so a task that runs again leaves the same files. Ids go through files in the shared folder. What stands in a
file, and so where its documents start, is read from its index.

Null text counts as empty: the end id alone. Null doc_ids come first. Repeated rows are written each; rows of one
doc_id stand in the order of their text's hash. Extra columns are ignored. An empty table gives no file and no row.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh_path, materialize, slices
from .tokenization import encoder, public_path

MAGIC = b"LLBP0001"
BLOCK, FILE_IDS, FILE_DOCS = 1 << 16, 1 << 28, 1 << 20


def planes(ids: np.ndarray, unit: str = "bit") -> list[bytes]:
    """The planes of unsigned 32-bit ids, lowest first; highest planes that are all 0 are left out."""
    top = int(ids.max(initial=0)).bit_length()
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if unit == "byte":
        return [raw[:, i].tobytes() for i in range(-(-top // 8))]
    return [np.packbits((ids >> np.uint32(p)).astype(np.uint8) & np.uint8(1), bitorder="little").tobytes() for p in range(top)]


def from_planes(parts: list[bytes], n: int, unit: str = "bit") -> np.ndarray:
    out = np.zeros(n, np.uint32)
    for p, raw in enumerate(parts):
        data = np.frombuffer(raw, np.uint8)
        if unit == "bit":
            data = np.unpackbits(data, count=n, bitorder="little")
        out |= data.astype(np.uint32) << np.uint32(p if unit == "bit" else 8 * p)
    return out


class Writer:
    """Appends documents of ids to an open binary file."""

    def __init__(self, file, block: int = BLOCK, unit: str = "bit", level: int = 3):
        self.file, self.block, self.unit = file, block, unit
        self.zip = zstandard.ZstdCompressor(level=level)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0
        self.at = file.write(MAGIC)
        self.chunks: list[list] = []
        self.docs: list[tuple[int | None, int]] = []
        self.n_ids = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id, len(ids) // 4))
        self.n_ids += len(ids) // 4
        self.waiting.append(np.frombuffer(ids, "<u4"))
        self.n_waiting += len(ids) // 4
        if self.n_waiting >= self.block:
            every = np.concatenate(self.waiting)
            whole = len(every) // self.block * self.block
            for i in range(0, whole, self.block):
                self._chunk(every[i : i + self.block])
            self.waiting, self.n_waiting = [every[whole:].copy()], len(every) - whole

    def _chunk(self, ids: np.ndarray) -> None:
        parts = [self.zip.compress(p) for p in planes(ids, self.unit)]
        self.chunks.append([self.at, len(ids), [len(p) for p in parts]])
        for p in parts:
            self.at += self.file.write(p)

    def close(self) -> None:
        if self.n_waiting:
            self._chunk(np.concatenate(self.waiting))
        index = self.zip.compress(json.dumps({"unit": self.unit, "chunks": self.chunks, "docs": self.docs}).encode())
        self.file.write(index + len(index).to_bytes(8, "little") + MAGIC)
        self.file.close()


class Reader:
    """Reads the index of an open, seekable binary file, then ids chunk by chunk."""

    def __init__(self, file):
        self.file = file
        size = file.seek(0, 2)
        size = file.tell() if size is None else size
        file.seek(size - 16)
        tail = file.read(16)
        if tail[8:] != MAGIC:
            raise ValueError("no bit-plane file")
        n = int.from_bytes(tail[:8], "little")
        file.seek(size - 16 - n)
        index = json.loads(zstandard.ZstdDecompressor().decompress(file.read(n)))
        self.unit, self.chunks, self.docs = index["unit"], index["chunks"], index["docs"]

    def chunk(self, i: int) -> np.ndarray:
        at, n, sizes = self.chunks[i]
        self.file.seek(at)
        d = zstandard.ZstdDecompressor()
        return from_planes([d.decompress(self.file.read(s)) for s in sizes], n, self.unit)

    def documents(self) -> Iterator[tuple[int | None, int, int]]:
        """doc_id, number of ids and crc32 of the ids, in file order, with one chunk in memory."""
        chunk, at, nth = memoryview(b""), 0, 0
        for doc_id, n in self.docs:
            crc, left = 0, 4 * n
            while left:
                if at == len(chunk):
                    chunk, at, nth = memoryview(self.chunk(nth).astype("<u4").tobytes()), 0, nth + 1
                take = min(left, len(chunk) - at)
                crc = zlib.crc32(chunk[at : at + take], crc)
                at += take
                left -= take
            yield doc_id, n, crc


def _open_fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "", 1) if uri.startswith("file:") else uri)


def _write(folder: str, path: str, end_id: int, block: int, unit: str, file_ids: int, file_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        enc, end = encoder(path), end_id.to_bytes(4, "little")
        where, root = _open_fs(folder)
        out, name, nth = None, "", 0

        def done() -> pa.RecordBatch:
            out.close()
            where.move(f"{root}/{name}.{attempt}.tmp", f"{root}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([nth], pa.int64()), pa.array([f"{folder}/{name}"])], ["part", "nth", "file"])

        for batch in slices(batches):
            for doc, ids in zip(batch.column("doc_id").to_pylist(), enc.ids(batch.column("text").to_pylist()), strict=True):
                if out is not None and (out.n_ids >= file_ids or len(out.docs) >= file_docs):
                    yield done()
                    out, nth = None, nth + 1
                if out is None:
                    where.create_dir(root, recursive=True)
                    name = f"part-{part:06d}-{nth:04d}.llbp"
                    out = Writer(where.open_output_stream(f"{root}/{name}.{attempt}.tmp"), block, unit)
                out.add(doc, ids + end)
        if out is not None:
            yield done()

    return run


def write_ids(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 2, block: int = BLOCK, unit: str = "bit", files: int | None = None, file_ids: int = FILE_IDS, file_docs: int = FILE_DOCS) -> DataFrame:
    """Writes docs' ids in ascending doc_id order; the files in their order: part, nth (of the part), file."""
    spark = docs.sparkSession
    path = tokenizer_path or public_path("byte_bpe_50k.json")
    folder = fresh_path(spark, "bitplanes")
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("__tie", F.xxhash64("text"))
    dealt = slim.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "__tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "__tie").drop("__tie")
    return materialize(dealt.mapInArrow(_write(folder, path, end_id, block, unit, file_ids, file_docs), "part long, nth long, file string"), "files")


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of ids in each file, by its index."""
    for batch in batches:
        n = []
        for file in batch.column("file").to_pylist():
            where, name = _open_fs(file)
            with where.open_input_file(name) as f:
                n.append(sum(x for _, x, _ in Reader(f).chunks))
        yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("nth"), batch.column("file"), pa.array(n, pa.int64())], ["part", "nth", "file", "n"])


def read_ids(files: DataFrame) -> DataFrame:
    """Per document, from the files (part, nth, file): doc_id, start, n_tokens, ids_crc32."""
    # one row per file
    base, placed = 0, []
    for r in sorted(files.mapInArrow(_totals, "part long, nth long, file string, n long").collect()):
        placed.append((r["file"], base))
        base += r["n"]
    manifest = files.sparkSession.createDataFrame(placed, "file string, base long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                where, name = _open_fs(file)
                with where.open_input_file(name) as f:
                    rows = []
                    for doc_id, n, crc in Reader(f).documents():
                        rows.append((doc_id, start, n, crc))
                        start += n
                        if len(rows) == 50_000:
                            yield _rows(rows)
                            rows = []
                    if rows:
                        yield _rows(rows)

    return manifest.repartition(max(1, len(placed)), "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])
