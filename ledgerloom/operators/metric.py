"""A metric learned on the Poincare ball: a projection under which vectors of one label lie together.

The fit is synchronous and data-parallel. Rows are dealt by a hash of their key to groups of about `GROUP`, written once; in
every epoch each task adds up the gradients of its groups, as whole multiples of 2^-30, so that sums are the same in any order
and a fit gives the same bits however the rows are partitioned. A task sends on one row for each weight, combined by weight
before the driver reads them; the driver holds the weights and Adam's two moments, nothing that grows with the rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as X
from ..sources.sinks import ModelStore
from ..staging import materialize
from .clusters import project
from .jobs import stops_early

GROUP, UNIT, TINY = 256, 2.0**30, 1e-8


def partners(labels: np.ndarray, turn: int, others: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of anchors, of one partner of the same label each, and of `others` rows of other labels each.

    Rows stand in a circle: the partner is the row's (turn + 1)th next one of its label, the others are the next ones after
    `turn` more (again from the first where there are fewer). Rows without a partner or without others are no anchors.
    """
    n = len(labels)
    none = np.zeros(0, int)
    if n < 2:
        return none, none, np.zeros((0, others), int)
    steps = np.arange(1, n)
    at = (np.arange(n)[:, None] + steps) % n
    same = labels[at] == labels[:, None]
    alike, unlike = same.sum(1), (~same).sum(1)
    anchors = np.flatnonzero((alike > 0) & (unlike > 0))
    by_kind = np.argsort(~same, axis=1, kind="stable")
    pick = lambda rows, col: at[rows, by_kind[rows, col]]
    partner = pick(anchors, turn % alike[anchors]) if len(anchors) else none
    col = alike[anchors][:, None] + (turn + np.arange(others)) % unlike[anchors][:, None]
    return anchors, partner, pick(anchors[:, None], col)


def _onto_ball(x: np.ndarray, w: np.ndarray, b: np.ndarray, most: float):
    """The tangent vectors and their places on the ball, as `clusters.project` makes them, and what the way back needs."""
    h = np.maximum(x @ w.T + b, 0.0)
    nh = np.sqrt((h * h).sum(1, keepdims=True))
    s = np.where(nh > most, most / (nh + TINY), 1.0)
    t = h * s
    nt = np.sqrt((t * t).sum(1, keepdims=True))
    f = np.where(nt > 0, np.tanh(nt) / np.where(nt > 0, nt, 1.0), 1.0)
    return h, nh, s, t, nt, f, f * t


def _apart(u: np.ndarray, v: np.ndarray):
    """Distances on the ball and their slopes by u and by v; 0 where both are one point."""
    a, b, gap = 1 - (u * u).sum(-1, keepdims=True), 1 - (v * v).sum(-1, keepdims=True), u - v
    g = (gap * gap).sum(-1, keepdims=True)
    x = 1 + 2 * g / (a * b)
    root = np.sqrt(np.maximum(x * x - 1, 0.0))
    k = np.where(root > 0, 4 / (a * b * np.where(root > 0, root, 1.0)), 0.0)
    return np.arccosh(x)[..., 0], k * (gap + g * u / a), k * (-gap + g * v / b)


def group_loss(x: np.ndarray, labels: np.ndarray, weights: np.ndarray, w: np.ndarray, b: np.ndarray, turn: int, others: int, share: float, most: float, slopes: bool = True):
    """The anchors' weight, their weighted loss, and its slopes by w and b.

    An anchor's loss: `share` times (distance to its partner + log of the sum of exp(-distance) over the others), and the rest
    times (1 - cosine to its partner in the tangent space).
    """
    i, j, ks = partners(labels, turn, others)
    if not len(i):
        return 0.0, 0.0, np.zeros_like(w), np.zeros_like(b)
    h, nh, s, t, nt, f, z = _onto_ball(x, w, b, most)
    c = weights[i]
    near, near_i, near_j = _apart(z[i], z[j])
    far, far_i, far_k = _apart(z[i][:, None, :], z[ks])
    least = far.min(1, keepdims=True)
    e = np.exp(least - far)
    total = e.sum(1, keepdims=True)
    ti, tj, ni, nj = t[i], t[j], nt[i], nt[j]
    both = np.maximum(ni * nj, TINY)
    cos = (ti * tj).sum(1, keepdims=True) / both
    loss = share * (near + (np.log(total) - least)[:, 0]) + (1 - share) * (1 - cos[:, 0])
    if not slopes:
        return float(c.sum()), float((c * loss).sum()), None, None
    dz, dt = np.zeros_like(z), np.zeros_like(t)
    cd = (share * c)[:, None]
    part = -(cd * (e / total))[:, :, None]
    np.add.at(dz, i, cd * near_i + (part * far_i).sum(1))
    np.add.at(dz, j, cd * near_j)
    np.add.at(dz, ks.ravel(), (part * far_k).reshape(-1, z.shape[1]))
    ca, turns = ((1 - share) * c)[:, None], ni * nj > TINY
    fall = lambda own, n: np.where(turns, cos * own / np.where(turns, n * n, 1.0), 0.0)
    np.add.at(dt, i, -ca * (tj / both - fall(ti, ni)))
    np.add.at(dt, j, -ca * (ti / both - fall(tj, nj)))
    # onto the ball: z = f(|t|) t
    safe = np.where(nt > 0, nt, 1.0)
    bend = np.where(nt > 1e-6, (nt / np.cosh(nt) ** 2 - np.tanh(nt)) / safe**3, 0.0)
    dt += f * dz + bend * (t * dz).sum(1, keepdims=True) * t
    # clipped: t = most / (|h| + TINY) h beyond `most`
    long = nh > most
    dh = s * dt - np.where(long, most / ((nh + TINY) ** 2 * np.where(long, nh, 1.0)), 0.0) * (h * dt).sum(1, keepdims=True) * h
    da = np.where(h > 0, dh, 0.0)
    return float(c.sum()), float((c * loss).sum()), da.T @ x, da.sum(0)


def _whole(values) -> list[int]:
    return [int(v) for v in np.rint(np.asarray(values) * UNIT)]


def _totals(groups: DataFrame, w: np.ndarray, b: np.ndarray, turn: int, others: int, share: float, most: float, slopes: bool) -> dict[tuple[bool, int], float]:
    """Sums over all groups by (held out or not, place): -2 weight, -1 loss, from 0 the slopes of the rows that aren't held out."""
    dims = w.shape[1]

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[bool, int], int] = {}
        for batch in batches:
            for held, labels, weights, flat in zip(batch["held_out"], batch["labels"], batch["weights"], batch["flat"], strict=True):
                x = np.asarray(flat, float).reshape(-1, dims)
                weight, loss, dw, db = group_loss(x, np.asarray(labels), np.asarray(weights), w, b, turn, others, share, most, slopes and not held)
                found = [weight, loss] if dw is None else [weight, loss, *dw.ravel(), *db]
                for place, v in enumerate(_whole(found), -2):
                    sums[held, place] = sums.get((held, place), 0) + v
        if sums:
            yield pd.DataFrame({"held_out": [k[0] for k in sums], "place": [k[1] for k in sums], "v": [str(v) for v in sums.values()]})

    parts = groups.mapInPandas(added, "held_out boolean, place int, v string")
    rows = parts.groupBy("held_out", "place").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    return {(r["held_out"], r["place"]): float(r["v"]) / UNIT for r in rows}


def grouped(df: DataFrame, key: str, vector: str, label: str, dims: int, held_out: int = 5, most_labels: int = 10_000, seed: int = 0) -> DataFrame:
    """(held_out, group, labels, weights, flat): rows in groups of about GROUP, those whose crc32(key as text) mod `held_out` is 0 in groups of their own.

    Rows with a null, or with another number of dimensions, take no part; of rows with one key the least does. A label's rows
    weigh the same together whatever their number. More than `most_labels` labels are an error.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(label).isNotNull() & (F.size(vector) == dims) & ~F.exists(vector, lambda v: v.isNull() | F.isnan(v)))
    one = rows.groupBy(F.col(key).cast("string").alias("k")).agg(F.min(F.struct(F.col(label).cast("string").alias("l"), X.doubles(vector).alias("v"))).alias("r"))
    one = materialize(one.select("k", "r.l", "r.v", (F.crc32(F.col("k").cast("binary")) % held_out == 0).alias("held_out")), "points")
    counts = one.groupBy("held_out", "l").agg(F.count(F.lit(1)).alias("c"))
    sizes = counts.limit(2 * most_labels + 1).collect()
    if len(sizes) > 2 * most_labels:
        raise ValueError(f"more than {most_labels} labels")
    n = {h: sum(r["c"] for r in sizes if r["held_out"] == h) for h in (False, True)}
    labels = {h: sum(r["held_out"] == h for r in sizes) for h in (False, True)}
    by = F.when(F.col("held_out"), F.lit(n[True] / max(labels[True], 1))).otherwise(F.lit(n[False] / max(labels[False], 1)))
    deals = F.when(F.col("held_out"), math.ceil(n[True] / GROUP) or 1).otherwise(math.ceil(n[False] / GROUP) or 1)
    h = F.xxhash64("k", F.lit(seed))
    weighed = one.join(F.broadcast(counts), ["held_out", "l"]).select("held_out", F.pmod(h, deals.cast("long")).alias("group"), F.struct(h.alias("h"), "k", "l", (by / F.col("c")).alias("w"), "v").alias("r"))
    lists = weighed.groupBy("held_out", "group").agg(F.sort_array(F.collect_list("r")).alias("r"))
    return materialize(lists.select("held_out", "group", F.col("r.l").alias("labels"), F.col("r.w").alias("weights"), F.flatten("r.v").alias("flat")), "groups")


def untrained(out: int, dims: int, seed: int) -> dict:
    """The state before the first epoch; `out` weights for each of `dims` places."""
    w = np.random.default_rng(seed).normal(size=(out, dims)) * math.sqrt(2 / dims)
    zero = [0.0] * (out * dims + out)
    return {"epoch": 0, "theta": [*w.ravel().tolist(), *([0.0] * out)], "first": zero, "second": zero, "history": []}


def adam(state: dict, slope: np.ndarray, rate: float, decay: tuple[float, float] = (0.9, 0.999)) -> dict:
    k = state["epoch"] + 1
    m = decay[0] * np.array(state["first"]) + (1 - decay[0]) * slope
    v = decay[1] * np.array(state["second"]) + (1 - decay[1]) * slope * slope
    move = rate * (m / (1 - decay[0] ** k)) / (np.sqrt(v / (1 - decay[1] ** k)) + 1e-8)
    return state | {"epoch": k, "theta": (np.array(state["theta"]) - move).tolist(), "first": m.tolist(), "second": v.tolist()}


class MetricModel(Model):
    """`transform` adds `projected`, the row's place on the ball. history: (epoch, training loss, held-out loss), the first before any step."""

    def __init__(self, state: dict, vector: str, out: int, dims: int, most: float):
        super().__init__()
        self.vector, self.most, self.history = vector, most, [tuple(h) for h in state["history"]]
        self.epoch, theta = state["best_epoch"], np.array(state["best"])
        self.weight, self.bias = theta[: out * dims].reshape(out, dims), theta[out * dims :]

    def _transform(self, df: DataFrame) -> DataFrame:
        return project(df, self.vector, self.weight.tolist(), self.bias.tolist(), self.most)


class MetricLearner(Estimator):
    """MDL-10, MDL-11: fits the projection, for at most `epochs` steps of Adam over all rows.

    With a folder for `store`, the state of each epoch is kept there and a later fit goes on from the last one, to the same
    model as a fit that ran through. The model has the weights of the least held-out loss (training loss where nothing is held
    out); the fit ends where that hasn't fallen for `patience` epochs. Without any anchor all losses are 0 and the weights stay.
    """

    def __init__(self, key: str, vector: str, label: str, dims: int, out: int = 8, epochs: int = 20, rate: float = 0.02, others: int = 4, share: float = 0.5, most: float = 0.98, patience: int = 10, seed: int = 0, store: str | None = None):
        super().__init__()
        self.key, self.vector, self.label, self.dims, self.out = key, vector, label, dims, out
        self.epochs, self.rate, self.others, self.share, self.most = epochs, rate, others, share, most
        self.patience, self.seed, self.store = patience, seed, store

    def _fit(self, df: DataFrame) -> MetricModel:
        groups = grouped(df, self.key, self.vector, self.label, self.dims, seed=self.seed)
        kept = ModelStore(df.sparkSession, self.store) if self.store else None
        state = (kept.latest() if kept and kept.holds() else None) or untrained(self.out, self.dims, self.seed)
        if len(state["theta"]) != self.out * (self.dims + 1):
            raise ValueError("the store holds a fit of another shape")
        size = self.out * self.dims
        while True:
            theta, turn = np.array(state["theta"]), state["epoch"]
            t = _totals(groups, theta[:size].reshape(self.out, self.dims), theta[size:], turn, self.others, self.share, self.most, turn < self.epochs)
            mean = {held: t.get((held, -1), 0.0) / (t.get((held, -2), 0.0) or 1.0) for held in (False, True)}
            if len(state["history"]) == turn:  # a resumed fit may have this one already
                state["history"] = [*state["history"], [turn, mean[False], mean[True]]]
            marks = [h[2] if t.get((True, -2)) else h[1] for h in state["history"]]
            if marks[-1] <= min(marks):
                state |= {"best": state["theta"], "best_epoch": turn}
            if turn >= self.epochs or stops_early(marks, self.patience):
                return MetricModel(state, self.vector, self.out, self.dims, self.most)
            slope = np.array([t.get((False, i), 0.0) for i in range(len(theta))]) / (t.get((False, -2), 0.0) or 1.0)
            state = adam(state, slope, self.rate)
            if kept:
                kept.save(json.loads(json.dumps(state)), marks[-1])
