"""Near-duplicate detection with DartMinHash.

A document is the multiset of its five-word shingles: the weight of a shingle is how often it occurs. Every shingle
owns an area of weight x rank into which hashing throws darts, a Poisson number in each unit of weight and
rank, the same for every document that holds the shingle. A document sees the darts under its weights and below a rank
that grows until each of its `k` coordinates has one; the least rank of a coordinate gives its value. Two documents
agree in a coordinate with their weighted Jaccard similarity as probability. Bands of coordinates propose candidates,
whose exact similarity decides.

Texts with equal word sequences are one class from the start. In each bucket of a band a few hubs are compared with all
members of other classes, and leave the bucket; similar pairs merge classes. A bucket whose members are in one class
then is done. The first rounds take hubs of the bucket's most common class, which soon gathers what is alike; the later
ones take 64 times as many hubs each, of all its other classes, until no bucket holds two, so there are few rounds
whatever a bucket's size. Every pair of a bucket is either compared, or in one class already, or can't be similar.

The last is proved before a pair is made. Shingles that no other candidate holds count for nothing; a document's weight
in the others is kept in `PROFILE` parts, by the shingle's hash. The sum of the lesser weights, part by part, is no less
than what two documents have in common, so it bounds their similarity. In a group of near copies whose similarities lie
about the threshold the copies differ in different parts, so the pairs made are those that are similar, and few others.

Null or empty texts and texts without words are compared by their raw text alone; null and empty texts are never
duplicates. Texts of one to four words have one shingle, all their words. Rows whose doc_id is null are left out of the
classes, and kept by the filter. Rows that repeat an id, with the same text or another, count by their texts: two texts
under one id are two documents. Extra columns are ignored and kept, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import free_names, map_slices, materialize
from .textops import U, Words, mix, text_bytes

SHINGLE, K, ROWS, THRESHOLD = 5, 120, 5, 0.8
#: Parts of a document's weight by its shingles' hashes; in one part at most so much is told apart.
PROFILE, MOST = 64, 32_767
#: Hubs of a bucket in each round, and whether they are of its most common class or of all others.
_ROUNDS = [(1, True), (8, True)]
#: Cells into which darts are thrown at once.
CELLS = 1 << 20
_EXACT = 2.0**-53
_STEP, _CELL, _MAX = U(0xD1342543DE82EF95), U(0xC2B2AE3D27D4EB4F), (1 << 64) - 1


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> U(11)).astype(np.float64) * _EXACT


def throw_darts(element: np.ndarray, weight: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, rank and hash of each dart that lies under its row's weight and rank theta.

    Weights are any positive numbers. Each region of unit weight and unit rank gets a Poisson(1) number of darts.
    """
    units = np.ceil(weight).astype(np.int64)
    row = np.repeat(np.arange(len(element)), units)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(units) - units, units)
    cells = np.ceil(theta[row]).astype(np.int64)
    unit = np.repeat(np.arange(len(row)), cells)
    cell = np.arange(len(unit)) - np.repeat(np.cumsum(cells) - cells, cells)
    h = mix(mix(element[row] + nth.astype(U) * _STEP)[unit] ^ (cell.astype(U) * _CELL))
    u = _unit(h)
    term = below = np.exp(-1.0)
    found = []
    at = np.flatnonzero(u > below)  # those with a dart more than n
    n = 0
    while len(at) and n < 64:
        n += 1
        dart = mix(h[at] + U(n * int(_STEP) & _MAX))
        found.append((unit[at], cell[at] + _unit(dart), dart))
        term /= n
        below += term
        at = at[u[at] > below]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, U)
    at, rank, dart = (np.concatenate(x) for x in zip(*found, strict=True))
    ok = rank <= theta[row[at]]
    at, rank, dart = at[ok], rank[ok], mix(dart[ok])
    ok = nth[at] + _unit(dart) < weight[row[at]]
    return row[at[ok]], rank[ok], mix(dart[ok])


def signatures(element: np.ndarray, weight: np.ndarray, doc: np.ndarray, n_docs: int, k: int = K) -> np.ndarray:
    """An n_docs x k array; documents without elements stay 0. `doc` ascends.

    A short document has few elements and so needs high ranks: documents go in groups of about CELLS cells of unit weight and rank.
    """
    sig = np.zeros((n_docs, k), U)
    total = np.bincount(doc, weight, n_docs)
    darts = k * (np.log(k) + 3)
    cells = np.cumsum(np.bincount(doc, np.ceil(weight) * np.ceil(darts / np.maximum(total, 1e-300))[doc], n_docs))
    at = np.searchsorted(doc, np.arange(n_docs + 1))
    i = 0
    while i < n_docs:
        j = max(i + 1, int(np.searchsorted(cells, (cells[i - 1] if i else 0) + CELLS, side="right")))
        own = slice(at[i], at[j])
        sig[i:j] = _signatures(element[own], weight[own], doc[own] - i, total[i:j], k, darts)
        i = j
    return sig


def _signatures(element: np.ndarray, weight: np.ndarray, doc: np.ndarray, total: np.ndarray, k: int, first: float) -> np.ndarray:
    n_docs = len(total)
    sig = np.zeros((n_docs, k), U)
    darts = np.where(total > 0, first, 0.0)
    open_docs = total > 0
    while open_docs.any():
        use = open_docs[doc]
        e, w, d = element[use], weight[use], doc[use]
        row, rank, h = throw_darts(e, w, (darts / np.maximum(total, 1e-300))[d])
        slot = d[row] * k + (h % U(k)).astype(np.int64)
        order = np.argsort(-rank, kind="stable")
        flat = np.zeros(n_docs * k, U)
        hit = np.zeros(n_docs * k, bool)
        flat[slot[order]] = h[order] | U(1)  # the last, of least rank, stays
        hit[slot] = True
        full = hit.reshape(n_docs, k).all(1) & open_docs
        sig[full] = flat.reshape(n_docs, k)[full]
        open_docs &= ~full
        darts *= 2
    return sig


def band_hashes(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    n, k = sig.shape
    bands = k // rows
    out = np.broadcast_to(mix(np.arange(bands, dtype=U) + U(1 << 50)), (n, bands)).copy()
    for j in range(rows):
        out = mix(out * U(0x5851F42D4C957F2D) + sig[:, j : bands * rows : rows])
    return out.view(np.int64)


def weighted_shingles(words: Words, n_docs: int, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, count and text of each distinct shingle, by text and ascending hash."""
    full = words.shingles(size)
    es, ws, ds = [], [], []
    for d in range(n_docs):
        a, b = words.first[d], words.first[d + 1]
        if b - a >= size:
            e, c = np.unique(full[a : b - size + 1], return_counts=True)
        elif b > a:
            e, c = np.array([int.from_bytes(hashlib.blake2b(words.hash[a:b].tobytes(), digest_size=8).digest(), "little")], U), np.array([1])
        else:
            continue
        es.append(e)
        ws.append(c)
        ds.append(np.full(len(e), d))
    if not es:
        return np.zeros(0, U), np.zeros(0), np.zeros(0, np.int64)
    return np.concatenate(es), np.concatenate(ws).astype(np.float64), np.concatenate(ds)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two shingle multisets (ascending hashes, counts)."""
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    same = b[0][at] == a[0]
    least = np.minimum(a[1][same], b[1][at[same]]).sum()
    most = a[1].sum() + b[1].sum() - least
    return float(least / most) if most else 0.0


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")


def _text_keys(words: Words, data: np.ndarray, ofs: np.ndarray, ids: list[int]) -> list[bytes]:
    """A digest for each text, equal for equal word sequences."""
    keys = []
    for i, doc_id in enumerate(ids):
        a, b = words.first[i], words.first[i + 1]
        raw = words.hash[a:b].tobytes() if b > a else b"raw" + data[ofs[i] : ofs[i + 1]].tobytes() if ofs[i + 1] > ofs[i] else b"id%d" % doc_id
        keys.append(hashlib.blake2b(raw, digest_size=16).digest())
    return keys


def _nodes(keys: list[bytes]) -> pa.Array:
    """The keys' first 64 bits, by which texts go in the graph."""
    return pa.array(np.frombuffer(b"".join(keys), np.int64)[::2])


def signature_table(docs: DataFrame, k: int = K, rows: int = ROWS) -> DataFrame:
    """(doc_id, text_hash, key, node, bands): key and node are equal for equal word sequences; bands is empty without words."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, ofs = text_bytes(batch.column("text"))
        words = Words(data, ofs)
        n = batch.num_rows
        e, w, d = weighted_shingles(words, n)
        bands = band_hashes(signatures(e, w, d, n, k), rows)
        ids = batch.column("doc_id").to_pylist()
        keys = _text_keys(words, data, ofs, ids)
        has = np.diff(words.first) > 0
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(has, bands.shape[1], 0))]), pa.int32()), pa.array(bands[has].ravel()))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), batch.column("text_hash"), pa.array(keys, pa.binary()), _nodes(keys), lists], ["doc_id", "text_hash", "key", "node", "bands"])

    return map_slices(_slim(docs).withColumn("text_hash", F.xxhash64("text")), run, "doc_id long, text_hash long, key binary, node long, bands array<long>", most=1 << 19)


def shingle_table(docs: DataFrame) -> DataFrame:
    """(node, shingles, counts, parts), a row for each text: ascending 64-bit hashes and 32-bit counts, as bytes, and the counts' sums by the hash's residue."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, ofs = text_bytes(batch.column("text"))
        words = Words(data, ofs)
        e, w, d = weighted_shingles(words, batch.num_rows)
        nodes = _nodes(_text_keys(words, data, ofs, batch.column("doc_id").to_pylist()))
        cut = np.searchsorted(d, np.arange(batch.num_rows + 1))
        c = w.astype(np.uint32)
        parts = np.bincount(d * PROFILE + (e % U(PROFILE)).astype(np.int64), w, batch.num_rows * PROFILE)
        parts = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * PROFILE, pa.int32()), pa.array(parts))
        return pa.RecordBatch.from_arrays([nodes, pa.array([e[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary()), pa.array([c[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary()), parts], ["node", "shingles", "counts", "parts"])

    return map_slices(docs, run, "node long, shingles binary, counts binary, parts array<double>").dropDuplicates(["node"])


def _compare(pairs: DataFrame) -> DataFrame:
    """(member, hub, sim) of pairs that carry both sides' shingles."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = [batch.column(c).to_pylist() for c in ("sa", "ca", "sb", "cb")]
        sims = [similarity((np.frombuffer(sa, U), np.frombuffer(ca, np.uint32)), (np.frombuffer(sb, U), np.frombuffer(cb, np.uint32))) for sa, ca, sb, cb in zip(*cols, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("member"), batch.column("hub"), pa.array(sims, pa.float64())], ["member", "hub", "sim"])

    return map_slices(pairs, run, "member long, hub long, sim double", "sa")


def _compared(pairs: DataFrame, shingles: DataFrame) -> DataFrame:
    """(member, hub, sim) of pairs of documents."""
    side = lambda c, s: shingles.select(F.col("node").alias(c), F.col("shingles").alias(f"s{s}"), F.col("counts").alias(f"c{s}"))
    return _compare(pairs.join(side("member", "a"), "member").join(side("hub", "b"), "hub"))


def shared_weights(shingles: DataFrame) -> DataFrame:
    """(member, weight, common, parts): each document's weight, how much of it lies in shingles that other documents hold too, and that part by part.

    A shingle's documents are counted with partial sums before the shuffle; what only one holds goes back to it, as one
    sum for each part. `parts` is null where a sum is too large for it.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        e, w = (np.frombuffer(b"".join(batch.column(c).to_pylist()), t) for c, t in (("shingles", np.int64), ("counts", np.uint32)))
        n = [len(x) // 8 for x in batch.column("shingles").to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(e), pa.array(np.repeat(batch.column("node").to_numpy(), n)), pa.array(w.astype(np.float64))], ["e", "node", "w"])

    flat = map_slices(shingles.select("node", "shingles", "counts"), run, "e long, node long, w double", "shingles")
    own = flat.groupBy("e").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node"), F.min("w").alias("w"))
    # the residue of the hash without its sign
    part = F.col("e").bitwiseAND(F.lit(PROFILE - 1)).cast("int")
    alone = own.where("n = 1").groupBy("node", part.alias("part")).agg(F.sum("w").alias("w"))
    alone = alone.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("part", "w"))).alias("alone"))
    left = F.when(F.col("alone").isNull(), F.col("parts")).otherwise(F.transform("parts", lambda x, i: x - F.coalesce(F.col("alone")[i], F.lit(0.0))))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda x, y: x + y)
    found = shingles.select("node", "parts").join(alone, "node", "left").select(F.col("node").alias("member"), total("parts").alias("weight"), left.alias("left"))
    return found.select("member", "weight", total("left").alias("common"), F.when(F.array_max("left") <= MOST, F.col("left").cast("array<smallint>")).alias("parts"))


def _may_be_alike(threshold: float) -> Column:
    """Whether a member and a hub can be similar: twice what they have in common, at most, against both weights."""
    enough = threshold * (F.col("weight") + F.col("hub_weight")) - 1e-6
    least = F.aggregate(F.zip_with("parts", "hub_parts", lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y.cast("int"))
    return ((1 + threshold) * F.least("common", "hub_common") >= enough) & F.coalesce((1 + threshold) * least >= enough, F.lit(True))


def similar_classes(active: DataFrame, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame | None:
    """(node, label) of the texts that a chain of similar pairs connects; active: (bucket, member, doc_id). None without any.

    Rounds, as the module says. Only buckets of two members or more count, and only the texts in them are read again.
    """
    crowded = active.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    active = materialize(active.join(crowded, "bucket"), "dart-active")
    candidates = docs.join(active.select("doc_id").distinct(), "doc_id", "left_semi")
    active = active.select("bucket", "member")
    shingles = materialize(shingle_table(candidates), "dart-shingles")
    # who holds too much of its own, for its size and that of the lightest in the bucket, can't be similar to any there
    reach = (1 + threshold) / threshold * F.col("common") - F.col("weight")
    held = active.join(shared_weights(shingles), "member")
    held = held.where(reach >= threshold * F.col("weight") - 1e-6)
    least = held.groupBy("bucket").agg(F.min("weight").alias("least"))
    own = ["member", "label", "weight", "common", "parts"]
    # a document's buckets, as many as bands at most: a pair that meets in several is compared in the least of them.
    # They stay as they are when it leaves one as a hub, for then it has met who is there
    mine = F.collect_list("bucket").over(Window.partitionBy("member")).alias("buckets")
    held = materialize(held.join(least, "bucket").where(reach >= F.col("least") - 1e-6).withColumn("label", F.col("member")).select("bucket", *own, mine), "dart-held")
    labels = None
    for slots, common in itertools.chain(_ROUNDS, ((64**n, False) for n in itertools.count(1))):
        # an open bucket holds two labels at least
        shares = held.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
        split = shares.groupBy("bucket").agg(F.count(F.lit(1)).alias("k"), F.max(F.struct("n", "label")).alias("most")).where("k > 1").select("bucket", F.col("most.label").alias("most"))
        split = materialize(split, "dart-open")
        if split.isEmpty():
            return labels
        held = held.join(split, "bucket")
        slot = F.pmod(F.xxhash64("member"), F.lit(slots)).alias("slot")
        pick = held.where("label = most" if common else "label <> most").groupBy("bucket", slot).agg(F.min(F.struct(*own)).alias("p"))
        hubs = pick.select("bucket", *[F.col(f"p.{c}").alias(f"hub_{c}") for c in own])
        hubs = materialize(hubs.withColumn("hub_buckets", F.collect_list("bucket").over(Window.partitionBy("hub_member"))), "dart-hubs")
        meet = held.alias("h").join(hubs.alias("u"), (F.col("h.bucket") == F.col("u.bucket")) & (F.col("label") != F.col("hub_label")) & (F.array_min(F.array_intersect("buckets", "hub_buckets")) == F.col("h.bucket")) & _may_be_alike(threshold))
        pairs = meet.select(F.greatest("member", "hub_member").alias("member"), F.least("member", "hub_member").alias("hub")).distinct()
        sims = materialize(_compared(materialize(pairs, "dart-pairs"), shingles), "dart-sims")
        merged = _merged(labels, sims.where(F.col("sim") >= threshold))
        rest = held.join(hubs.select("bucket", F.col("hub_member").alias("member")), ["bucket", "member"], "left_anti")
        if merged is not labels:
            labels = merged
            rest = rest.withColumnRenamed("label", "was").join(labels, rest.member == labels.node, "left").withColumn("label", F.coalesce("label", "member"))
        held = materialize(rest.select("bucket", *own, "buckets"), "dart-held")


def _merged(labels: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """Labels after more links: the links between the labels so far give the components of a smaller graph."""
    if links.isEmpty():
        return labels
    if labels is None:
        return components(links)
    at = lambda c: F.coalesce(f"{c}_label", c)
    lifted = links
    for c in ("member", "hub"):
        own = labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
        lifted = lifted.join(own, c, "left")
    lifted = materialize(lifted.select(at("member").alias("member"), at("hub").alias("hub")).where("member <> hub").distinct(), "dart-lifted")
    if lifted.isEmpty():
        return labels
    up = components(lifted).select(F.col("node").alias("was"), F.col("label").alias("now"))
    old = labels.join(up, labels.label == up.was, "left").select("node", F.coalesce("now", "label").alias("label"))
    new = up.join(labels.select("node"), up.was == F.col("node"), "left_anti").select(F.col("was").alias("node"), F.col("now").alias("label"))
    return materialize(old.unionByName(new), "dart-labels")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node that each linked node is connected to. Least labels spread and jump until none changes."""
    edges = materialize(links.select(F.col("member").alias("a"), F.col("hub").alias("b")).unionByName(links.select(F.col("hub").alias("a"), F.col("member").alias("b"))).distinct(), "cc-edges")
    labels = edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label"))
    while True:
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        heard = edges.join(labels, edges.b == labels.node).groupBy("a").agg(F.min("label").alias("heard"))
        step = labels.join(jump, "label", "left").join(heard, labels.node == heard.a).select("node", F.col("label").alias("old"), F.least("label", "up", "heard").alias("label"))
        step = materialize(step, "cc-labels")
        if step.where("label <> old").isEmpty():
            return step.select("node", "label")
        labels = step.select("node", "label")


def _rows_and_classes(docs: DataFrame, k: int = K, rows: int = ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of docs: doc_id, text_hash, and its class: first (least doc_id and text_hash), class_size, n_texts."""
    sigs = materialize(signature_table(docs, k, rows), "dart-signatures")
    reps = sigs.groupBy("key").agg(F.min("node").alias("node"), F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.count(F.lit(1)).alias("copies"), F.min_by("bands", "doc_id").alias("bands"))
    reps = materialize(reps, "dart-texts")
    active = reps.where("bands is not null").select(F.explode("bands").alias("bucket"), F.col("node").alias("member"), F.col("rep.doc_id").alias("doc_id")).distinct()
    label = similar_classes(active, _slim(docs), threshold)
    texts = reps.select("key", F.col("node").alias("own"), "rep", "copies")
    if label is None:
        texts = texts.withColumn("label", F.col("own"))
    else:
        texts = texts.join(label, F.col("own") == F.col("node"), "left").select("key", "rep", "copies", F.coalesce("label", "own").alias("label"))
    texts = materialize(texts, "dart-classes")
    sizes = materialize(texts.groupBy("label").agg(F.min("rep").alias("first"), F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("n_texts")), "dart-sizes")
    wide = materialize(texts.join(sizes, "label").select("key", "first", "class_size", "n_texts"), "dart-wide")
    return sigs.select("doc_id", "text_hash", "key").join(wide, "key").drop("key")


def near_duplicates(docs: DataFrame, k: int = K, rows: int = ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, class_id (least doc_id of its class), class_size (rows), n_texts (different texts in it), keep (its text is the class's first)."""
    found = _rows_and_classes(docs, k, rows, threshold)
    return found.select("doc_id", F.col("first.doc_id").alias("class_id"), "class_size", "n_texts", (F.struct("doc_id", "text_hash") == F.col("first")).alias("keep"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each class of near duplicates, that of the least doc_id; rows without an id stay."""
    doc, text = free_names(docs, "doc", "text_hash")
    kept = materialize(_rows_and_classes(docs).select(F.col("first.doc_id").alias(doc), F.col("first.text_hash").alias(text)).distinct(), "dart-kept")
    hashed = docs.withColumns({doc: F.col("doc_id").cast("long"), text: F.xxhash64(F.col("text").cast("string"))})
    first = hashed.join(kept, [doc, text], "left_semi").dropDuplicates([doc, text]).select(docs.columns)
    return first.unionByName(docs.where("doc_id is null"))
