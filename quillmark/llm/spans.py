"""Long exact spans shared between records: content-defined chunks by a gear rolling hash."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from quillmark.llm.rows import slices

_B1, _B2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F  # odd, so that they have inverses modulo 2**64


@dataclass(frozen=True)
class Chunking:
    """Where chunks begin and end.

    A border lies where the gear hash of the last ``reach`` symbols has zeros in ``bits`` of its bits, and, where ``gap`` positions
    passed without one, at every position until the next. Borders thus depend on the last ``reach`` + ``gap`` symbols alone, and any
    ``reach`` + ``gap`` symbols in a row hold one. A chunk runs from a border to the first one ``least`` symbols on, or to ``most``.
    """

    span: int
    reach: int
    bits: int
    gap: int
    least: int

    @property
    def most(self) -> int:
        """Every span of ``span`` symbols has a border early enough for a whole chunk of this length, in whatever record it stands."""
        return self.span - (self.reach - 1) - self.gap


CHARACTERS = Chunking(span=70, reach=4, bits=2, gap=9, least=44)
UNITS = Chunking(span=12, reach=1, bits=1, gap=2, least=8)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x + np.uint64(_B1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def character_symbols(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def unit_symbols(text: str) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(u) for u in text.split(" ") if u), np.uint64)


class Layout:
    """Several sequences laid end to end, with gear values, prefix sums for digests of any slice, and borders."""

    def __init__(self, sequences: list[np.ndarray], c: Chunking):
        self.c = c
        self.lengths = np.array([len(s) for s in sequences], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.g = g = _mix(np.concatenate(sequences)) if len(sequences) else np.zeros(0, np.uint64)
        m = len(g)
        self.owner = np.repeat(np.arange(len(sequences)), self.lengths)
        self.offset = np.arange(m) - self.starts[self.owner]
        self.end = (self.starts + self.lengths)[self.owner]
        self.sums, self.inverse = [], []
        for b in (_B1, _B2):
            power = np.cumprod(np.full(m, b, np.uint64))
            self.sums.append(np.concatenate([[np.uint64(0)], np.cumsum(g * power, dtype=np.uint64)]))
            self.inverse.append(np.cumprod(np.full(m, pow(b, -1, 1 << 64), np.uint64)))

    def digest(self, start: np.ndarray, end: np.ndarray, k: int) -> np.ndarray:
        s = (self.sums[k][end] - self.sums[k][start]) * self.inverse[k][start]
        return _mix(s + (end - start).astype(np.uint64)).view(np.int64)

    def borders(self) -> np.ndarray:
        c, g = self.c, self.g
        h = g.copy()
        for j in range(1, c.reach):
            h[j:] += g[:-j] << np.uint64(j)
        low = np.uint64(((1 << c.bits) - 1) << (c.reach - c.bits)) if c.reach >= c.bits else np.uint64((1 << c.bits) - 1)
        natural = ((h & low) == 0) & (self.offset >= c.reach - 1)
        at = np.arange(len(g))
        last = np.maximum.accumulate(np.where(natural, at, -1)) if len(g) else at
        forced = ~natural & (at - last > c.gap) & (self.offset >= c.reach - 1 + c.gap)
        return np.flatnonzero(natural | forced)

    def chunks(self) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of all chunks that lie whole in their sequence."""
        c = self.c
        b = self.borders()
        if not len(b):
            return b, b
        nxt = np.searchsorted(b, b + c.least)
        to = np.where(nxt < len(b), b[np.minimum(nxt, len(b) - 1)], np.iinfo(np.int64).max)
        end = np.minimum(to, b + c.most)
        keep = end <= self.end[b]
        return b[keep], end[keep]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield from slices(b, 1)


def _chunker(symbols: Callable[[str], np.ndarray], c: Chunking):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _groups(batches):
            lay = Layout([symbols(t) for t in b.column(1).to_pylist()], c)
            start, end = lay.chunks()
            own = lay.owner[start]
            base = lay.starts[own]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(own)), pa.array(lay.digest(start, end, 0)), pa.array((start - base) << 32 | (end - base))], names=["id", "chunk", "place"]
            )

    return run


def _windows(b: pa.RecordBatch, symbols: Callable[[str], np.ndarray], c: Chunking) -> tuple[Layout, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The windows of ``span`` symbols around the chunks of each record: (layout, starts, first start of the same window in the record, two digests)."""
    lay = Layout([symbols(t) for t in b.column(1).to_pylist()], c)
    place = b.column(2).flatten().to_numpy()
    own = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column(2)).to_numpy())
    a, e = (place >> 32) + lay.starts[own], (place & 0xFFFFFFFF) + lay.starts[own]
    first = np.maximum(e - c.span, lay.starts[own])
    final = np.minimum(a, lay.starts[own] + lay.lengths[own] - c.span)
    ok = first <= final
    mark = np.zeros(len(lay.g) + 1, np.int64)
    np.add.at(mark, first[ok], 1)
    np.add.at(mark, final[ok] + 1, -1)
    s = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
    w1, w2, who = lay.digest(s, s + c.span, 0), lay.digest(s, s + c.span, 1), lay.owner[s]
    order = np.lexsort((w2, w1, who))
    new = np.ones(len(s), bool)
    new[1:] = (w1[order][1:] != w1[order][:-1]) | (w2[order][1:] != w2[order][:-1]) | (who[order][1:] != who[order][:-1])
    again = np.empty(len(s), np.int64)
    again[order] = s[order][np.flatnonzero(new)][np.cumsum(new) - 1] if len(s) else s
    return lay, s, again, w1, w2


def _digests(symbols: Callable[[str], np.ndarray], c: Chunking):
    """Each window of a record once, with the place where it comes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _groups(batches):
            lay, s, first, w1, w2 = _windows(b, symbols, c)
            at = np.flatnonzero(s == first)
            who = lay.owner[s[at]]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(who)), pa.array(w1[at]), pa.array(w2[at]), pa.array((s[at] - lay.starts[who]).astype(np.int32))], names=["id", "w1", "w2", "at"])

    return run


def _shared(symbols: Callable[[str], np.ndarray], c: Chunking, totals: bool):
    """The windows of each record less those that it alone holds; with ``totals`` how many symbols they cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _groups(batches):
            lay, s, first, _, _ = _windows(b, symbols, c)
            alone = b.column(3).flatten().to_numpy() + np.repeat(lay.starts, pc.fill_null(pc.list_value_length(b.column(3)), 0).to_numpy())
            s = s[~np.isin(first, alone)]
            who = lay.owner[s]
            if not totals:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(who)), pa.array((s - lay.starts[who]).astype(np.int32)), pa.array(lay.lengths[who].astype(np.int32))], names=["id", "at", "length"])
                continue
            step = np.full(len(s), c.span)
            step[:-1] = np.where(who[1:] == who[:-1], np.minimum(np.diff(s), c.span), c.span)
            records, begin = np.unique(who, return_index=True)
            sums = np.add.reduceat(step, begin) if len(s) else step
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(records)), pa.array(sums.astype(np.int64)), pa.array(lay.lengths[records])], names=["id", "shared", "length"])

    return run


def _searched(df: DataFrame, key: str, text: str, units: bool, chunking: Chunking | None, totals: bool) -> DataFrame:
    c = chunking or (UNITS if units else CHARACTERS)
    symbols = unit_symbols if units else character_symbols
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text")).where("id is not null and text is not null").groupBy("id").agg(F.max("text").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    chunks = rows.mapInArrow(_chunker(symbols, c), f"id {kind}, chunk long, place long")
    common = chunks.groupBy("chunk").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("chunk")
    near = chunks.join(common, "chunk", "left_semi").groupBy(F.col("id").alias("rid")).agg(F.collect_list("place").alias("places"))
    texts = rows.join(near, F.col("id") == F.col("rid")).select("id", "text", "places")
    windows = texts.mapInArrow(_digests(symbols, c), f"id {kind}, w1 long, w2 long, at int")
    alone = windows.groupBy("w1", "w2").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.min("at").alias("at")).where("a = b")
    alone = alone.groupBy(F.col("a").alias("aid")).agg(F.collect_list(F.col("at").cast("long")).alias("alone"))
    found = texts.join(alone, F.col("id") == F.col("aid"), "left").select("id", "text", "places", "alone")
    return found.mapInArrow(_shared(symbols, c, totals), f"id {kind}, shared long, length long" if totals else f"id {kind}, at int, length int")


def shared_windows(df: DataFrame, key: str, text: str, units: bool = False, chunking: Chunking | None = None) -> DataFrame:
    """(id, at, length): where each record holds a span of ``chunking.span`` symbols that another record holds too.

    Symbols are code points, or the blank-separated units of the text. Chunks are found where the records are read; the digests
    of all chunks are grouped, and those of two different records or more are candidates. Around candidate chunks every
    window of the span is hashed to 128 bits and grouped likewise, which checks the whole span exactly. Neither step makes
    pairs: a group of any size is two partial aggregates, least and greatest id. What goes back to the records are the windows
    that turned out to be theirs alone, which are few around shared chunks.

    A shared span always holds a chunk that both records cut alike, so nothing is missed. Null ids and null texts take no part; an
    id with several texts counts with the greatest; a span repeated inside one record alone isn't shared; empty gives empty.
    """
    return _searched(df, key, text, units, chunking, False)


def shared_share(df: DataFrame, key: str, text: str, units: bool = False, chunking: Chunking | None = None) -> DataFrame:
    """(id, shared, length, share) of the records that hold a shared span: how many of their symbols stand in one."""
    return _searched(df, key, text, units, chunking, True).withColumn("share", F.col("shared") / F.col("length"))
