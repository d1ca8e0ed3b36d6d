"""Word contexts: non-negative factors of windows by roots, fitted over all windows wherever they lie."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillmark.session import cut_lineage

#: Windows a root must be found in, and every how many verses a window is fitted.
LEAST_WINDOWS, FIT_STEP = 5, 5
#: Rounds at most, and the change of the factors, as a share of them, at which they stand.
ROUNDS, STILL = 60, 1e-3
_INNER = 50
#: Vectors a task of a round takes; rounds are short, so that smaller tasks would cost more to start than to run.
PART = 4096


def terms(fit: DataFrame, least: int = LEAST_WINDOWS) -> tuple[list[str], np.ndarray, int]:
    """Roots in ``least`` windows of ``fit`` or more, in order, their weights by rarity, and the number of windows. To the driver: the vocabulary, which a longer text doesn't lengthen much."""
    n = fit.count()
    kept = fit.select(F.explode(F.array_distinct("roots")).alias("root")).groupBy("root").agg(F.count("*").alias("df")).where(F.col("df") >= least).toArrow().to_pylist()
    kept.sort(key=lambda r: r["root"])
    return [r["root"] for r in kept], np.array([np.log((1 + n) / (1 + r["df"])) + 1 for r in kept]), n


def vectors(rows: DataFrame, roots: list[str], idf: np.ndarray) -> DataFrame:
    """``rows`` with their array ``roots`` as a vector of length 1: places ``at`` and values ``x``, (1 + ln count) by rarity."""
    shared = rows.sparkSession.sparkContext.broadcast(({r: i for i, r in enumerate(roots)}, idf))
    keys = [c for c in rows.columns if c != "roots"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, weight = shared.value
        for b in batches:
            at, x = [], []
            for items in b.column("roots").to_pylist():
                i, n = np.unique(np.array([place[r] for r in items or () if r in place], np.int32), return_counts=True)
                v = (1 + np.log(n)) * weight[i]
                at.append(i)
                x.append(v / np.linalg.norm(v) if len(v) else v)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keys), pa.array(at, pa.list_(pa.int32())), pa.array(x, pa.list_(pa.float64()))], names=[*keys, "at", "x"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keys)
    return rows.mapInArrow(run, f"{kinds}, at array<int>, x array<double>")


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at, x = b.column("at"), b.column("x")
    sizes = np.diff(at.offsets.to_numpy())
    return np.repeat(np.arange(b.num_rows), sizes), at.flatten().to_numpy(), x.flatten().to_numpy()


def _mix(h: np.ndarray, n: int, row: np.ndarray, at: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Non-negative weights of the contexts ``h`` in each of ``n`` vectors, by multiplicative updates from an even start."""
    num = np.stack([np.bincount(row, x * h[j, at], minlength=n) for j in range(len(h))], axis=1)
    gram = h @ h.T
    w = np.full(num.shape, 0.1)
    for _ in range(_INNER):
        w *= num / np.maximum(w @ gram, 1e-12)
    return w


def fit(vecs: DataFrame, width: int, k: int = 6, seed: int = 1) -> np.ndarray:
    """The ``k`` contexts (k by ``width``) that rebuild the vectors best by squares.

    The weights of a vector depend on the contexts alone, so a round is one pass: each task weighs its vectors and gives their sums
    by root (k numbers) and k by k; the contexts then follow from the sums. No vector reaches the driver, but k numbers for each root do.
    """
    h = np.random.default_rng(seed).random((k, width)) + 1e-3
    h /= np.linalg.norm(h, axis=1, keepdims=True)
    sc = vecs.sparkSession.sparkContext
    names = [f"s{j}" for j in range(k)]
    for _ in range(ROUNDS):
        shared = sc.broadcast(h)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            h = shared.value
            sums, gram = np.zeros((width, k)), np.zeros((k, k))
            for b in batches:
                row, at, x = _flat(b)
                w = _mix(h, b.num_rows, row, at, x)
                gram += w.T @ w
                for j in range(k):
                    sums[:, j] += np.bincount(at, x * w[row, j], minlength=width)
            full = np.concatenate([sums, gram])
            slots = np.flatnonzero(full.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), *(pa.array(full[slots, j]) for j in range(k))], names=["slot", *names])

        got = vecs.mapInArrow(run, "slot long, " + ", ".join(f"{c} double" for c in names)).groupBy("slot").agg(*(F.sum(c).alias(c) for c in names)).toArrow()
        full = np.zeros((width + k, k))
        full[got["slot"].to_numpy()] = np.stack([got[c].to_numpy() for c in names], axis=1)
        shared.unpersist()
        before, num, gram = h, full[:width].T, full[width:]
        for _ in range(_INNER):
            h = h * num / np.maximum(gram @ h, 1e-12)
        if np.linalg.norm(h - before) <= STILL * np.linalg.norm(before):
            break
    return h


def mixes(vecs: DataFrame, h: np.ndarray) -> DataFrame:
    """(keys, context, share): the contexts' weights in each vector, made to add up to 1; all 0 in a vector without a known root."""
    shared = vecs.sparkSession.sparkContext.broadcast(h)
    keys = [c for c in vecs.columns if c not in ("at", "x")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = _mix(shared.value, b.num_rows, *_flat(b))
            w = w / np.maximum(w.sum(axis=1, keepdims=True), 1e-12)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keys), pa.array(list(w), pa.list_(pa.float64()))], names=[*keys, "mix"])

    kinds = ", ".join(f"{c} {vecs.schema[c].dataType.simpleString()}" for c in keys)
    return vecs.mapInArrow(run, f"{kinds}, mix array<double>").select(*keys, F.posexplode("mix").alias("context", "share"))


class Contexts:
    """Contexts fitted on every ``FIT_STEP``-th window of (book, start, roots), and the mix of any rows that have ``roots``."""

    def __init__(self, windows: DataFrame, k: int = 6):
        self.windows = cut_lineage(windows.select("book", "start", "roots"))
        some = self.windows.where(F.col("start") % FIT_STEP == 0)
        self.roots, self.idf, n = terms(some)
        self.h = fit(cut_lineage(vectors(some, self.roots, self.idf).coalesce(n // PART + 1)), len(self.roots), k) if self.roots else np.zeros((k, 0))

    def of(self, rows: DataFrame) -> DataFrame:
        return mixes(vectors(rows, self.roots, self.idf), self.h)
