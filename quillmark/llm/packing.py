"""Filling containers of fixed capacity: best-fit decreasing with a segment tree over remaining capacities."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from quillmark.llm.bpe import TOKENIZERS, SpeculativeBPE, encoder
from quillmark.llm.rows import slices
from quillmark.session import cut_lineage


class CapacityTree:
    """Which remaining capacities have an open bin; finds the least one of at least ``need`` in logarithmic time."""

    def __init__(self, capacity: int):
        self.width = 1 << (capacity + 1).bit_length()
        self.any = [False] * (2 * self.width)

    def set(self, at: int, there: bool) -> None:
        i = at + self.width
        self.any[i] = there
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        i = need + self.width
        if self.any[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.width:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.width
            i //= 2
        return None


@dataclass
class Plan:
    """Items of ``size`` with rank in [start, end) go to bins first_bin + (rank - start) // per."""

    size: list[int] = field(default_factory=list)
    start: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    first_bin: list[int] = field(default_factory=list)
    per: list[int] = field(default_factory=list)
    bins: int = 0

    def add(self, *row: int) -> None:
        for column, v in zip((self.size, self.start, self.end, self.first_bin, self.per), row):
            column.append(v)


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing over all items, given as numbers of items by size.

    Items of one size are interchangeable, and so are bins with one history; the packing of each single item in turn is therefore
    followed in runs. Each size splits one run of bins and opens two at most, so there are at most 3 * ``capacity`` runs,
    whatever the number of items, and each run takes few different sizes: the plan is bounded by the capacity alone.
    """
    plan, tree = Plan(), CapacityTree(capacity)
    open_runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def put(left: int, first: int, count: int) -> None:
        if count and left:
            open_runs[left].append((first, count))
            tree.set(left, True)

    for size in sorted((s for s in histogram if s > 0), reverse=True):
        todo, at = histogram[size], 0
        while todo:
            left = tree.tightest(size)
            if left is None:
                left, first, count = capacity, plan.bins, -(-todo // (capacity // size))
                plan.bins += count
            else:
                first, count = open_runs[left].pop()
                if not open_runs[left]:
                    tree.set(left, False)
            per = left // size
            full = min(count, todo // per)
            if full:
                plan.add(size, at, at + full * per, first, per)
                put(left - per * size, first, full)
                at, todo, first, count = at + full * per, todo - full * per, first + full, count - full
            if todo and count:
                plan.add(size, at, at + todo, first, todo)
                put(left - todo * size, first, 1)
                at, todo, first, count = at + todo, 0, first + 1, count - 1
            put(left, first, count)
    return plan


def cut_pieces(bpe: SpeculativeBPE, text: str, capacity: int) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of the pieces of ``text``, in characters; a text within the capacity is one piece.

    A longer text is cut at the last word border where the piece, encoded by itself, still fits; a single word that is too
    long is cut between characters.
    """
    words = bpe.split(text)
    bpe.learn(set(words))
    n = [len(bpe.known[w]) for w in words]
    if sum(n) <= capacity:
        return [(0, len(text), sum(n))]
    out, at, i = [], 0, 0
    while i < len(words):
        j, total = i, 0
        while j < len(words) and total + n[j] <= capacity:
            total += n[j]
            j += 1
        while j > i:
            piece = "".join(words[i:j])
            if (tokens := bpe.count(piece)) <= capacity:
                break
            j -= 1
        if j == i:
            w = words[i]
            lo = 1
            hi = min(len(w), capacity * bpe.longest)
            while lo < hi:
                mid = (lo + hi + 1) // 2
                lo, hi = (mid, hi) if bpe.count(w[:mid]) <= capacity else (lo, mid - 1)
            while lo > 1 and bpe.count(w[:lo]) > capacity:
                lo -= 1
            piece, tokens = w[:lo], bpe.count(w[:lo])
            if w[lo:]:
                words[i], n[i] = w[lo:], bpe.count(w[lo:])
            else:
                i += 1
        else:
            i = j
        out.append((at, at + len(piece), tokens))
        at += len(piece)
    return out


def measure(df: DataFrame, key: str, text: str, capacity: int, tokenizers: str, vocabulary: str) -> DataFrame:
    """(key, start, length, size, block, place): the pieces of each row; ``place`` counts the pieces of one size in one task."""
    path = f"{tokenizers}/{vocabulary}.json"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, block, seen = encoder(path), TaskContext.get().partitionId(), {}
        for b in batches:
            for part in slices(b, 1):
                texts = part.column(1).to_pylist()
                bpe.words(texts)
                rows, cols = [], ([], [], [], [])
                for i, t in enumerate(texts):
                    for start, end, size in cut_pieces(bpe, t, capacity) if t else [(0, 0, 0)]:
                        rows.append(i)
                        for c, v in zip(cols, (start, end - start, size, seen.get(size, 0))):
                            c.append(v)
                        seen[size] = seen.get(size, 0) + 1
                start, length, size, place = (pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.int64())))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int32())), start, length, size, pa.array([block] * len(rows), pa.int64()), place], names=["key", "start", "length", "size", "block", "place"])

    out = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return out.mapInArrow(run, f"key {out.schema['key'].dataType.simpleString()}, start int, length int, size int, block long, place long")


def fill_containers(df: DataFrame, key: str, text: str, capacity: int = 2048, tokenizers: str = TOKENIZERS, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """(container, key, piece, start, size): every text in containers of at most ``capacity`` tokens.

    All texts together are packed best-fit decreasing. Their sizes are counted by Spark, at most ``capacity`` + 1 numbers reach the
    driver, and the plan made of them is bounded by the capacity; each piece then finds its container from its size and its
    rank among the pieces of that size. The rank is the place in its task plus the number in the tasks before, so a hot size
    is never gathered. The measured pieces, without their text, are kept in the shared folder, so that ranks don't change
    when a task runs again.

    Only a text of more than ``capacity`` tokens is cut. Empty and null texts hold no tokens; each comes out once, with its text as
    the piece, spread over the containers (container 0 where there is none). ``key`` is unique; a null key is a key as any other.
    """
    pieces = cut_lineage(measure(df, key, text, capacity, tokenizers, vocabulary))
    per_block = pieces.groupBy("size", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("size").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.select("size", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    plan = best_fit_decreasing({r["size"]: r["n"] for r in per_block.groupBy("size").agg(F.sum("n").alias("n")).collect()}, capacity)
    held = {name: np.array(getattr(plan, name), np.int64) for name in ("size", "start", "end", "first_bin", "per")}
    by_size: dict[int, tuple[np.ndarray, ...]] = {}
    for s in np.unique(held["size"]).tolist():
        at = np.flatnonzero(held["size"] == s)
        by_size[s] = (held["start"][at], held["first_bin"][at], held["per"][at])
    shared = df.sparkSession.sparkContext.broadcast((by_size, plan.bins))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, bins = shared.value
        for b in batches:
            size, rank = b.column(3).to_numpy(), b.column(4).to_numpy()
            out = np.zeros(len(size), np.int64)
            for s in np.unique(size).tolist():
                at = np.flatnonzero(size == s)
                if s == 0:
                    out[at] = rank[at] % max(1, bins)
                    continue
                start, first, per = runs[s]
                i = np.searchsorted(start, rank[at], "right") - 1
                out[at] = first[i] + (rank[at] - start[i]) // per[i]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(out)], names=["key", "start", "length", "size", "container"])

    ranked = pieces.join(offsets, ["size", "block"]).select("key", "start", "length", "size", (F.col("place") + F.col("offset")).alias("rank"))
    kind = pieces.schema["key"].dataType.simpleString()
    placed = ranked.mapInArrow(assign, f"key {kind}, start int, length int, size int, container long")
    texts = df.select(F.col(key).alias("doc_key"), F.col(text).cast("string").alias("doc_text"))
    out = placed.join(texts, F.col("key").eqNullSafe(F.col("doc_key")))
    piece = F.when(F.length("doc_text") == F.col("length"), F.col("doc_text")).otherwise(F.substring("doc_text", F.col("start") + 1, F.col("length")))
    return out.select("container", F.col("key").alias(key), piece.alias("piece"), "start", "size")
