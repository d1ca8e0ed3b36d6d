"""Frequency of every distinct value or run of values: suffix arrays with common-prefix intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: Positions of a record in one segment; a longer record is cut into segments.
SEGMENT = 8192
#: Rows that are gathered before a suffix array is built.
BLOCK = 1 << 18


def ngram_counts(df: DataFrame, record: str, position: str, fields: list[str], n_max: int | None = 1, segment: int = SEGMENT) -> DataFrame:
    """Occurrences and records of every n-gram (n consecutive positions without a null) of ``fields``, n up to ``n_max`` (None: of any length).

    ``df`` has one row for each (record, position). Records are laid out in blocks; for each block the suffix array over its terms
    is built by prefix doubling, whole suffixes whatever ``n_max``. The common prefixes of adjacent suffixes give the intervals of all
    n-grams: an interval's width is the number of occurrences, and the number of records is that less the suffixes whose
    last neighbour of the same record lies in the interval too. ``n_max`` says which intervals are read. Blocks are added up by Spark.

    Out come ``field``, ``n``, ``gram`` (array), ``occurrences``, ``records``. Every n-gram comes out, none is dropped for its
    count. Nulls break runs and aren't counted; values are taken as stored, empty strings too; keys of records are of any type; an
    empty input gives an empty result. A record longer than ``segment`` positions is spread over tasks; each segment also sees the first
    ``n_max`` - 1 positions of the next, and only for such records the pairs of n-gram and record are kept until the end, so that a
    record counts once. Without ``n_max`` a record is one piece, as its n-grams are as long as itself.
    """
    rows = df.select(F.col(record).alias("rec"), F.col(position).cast("long").alias("pos"), *fields).where("rec is not null and pos is not null")
    kind = rows.schema["rec"].dataType.simpleString()
    rows = rows.withColumn("seg", F.floor(F.col("pos") / segment) if n_max else F.lit(0).cast("long"))
    long = rows.where(F.col("seg") != 0)
    rows_split = n_max is not None and not long.limit(1).isEmpty()
    if not rows_split:
        rows = rows.withColumn("ctx", F.lit(False)).withColumn("split", F.lit(False))
    else:
        ids = long.select("rec").distinct().withColumn("split", F.lit(True))
        rows = rows.join(ids, "rec", "left").withColumn("split", F.coalesce("split", F.lit(False)))
        here = F.struct(F.col("seg").alias("seg"), F.lit(False).alias("ctx"))
        back = F.struct((F.col("seg") - 1).alias("seg"), F.lit(True).alias("ctx"))
        rows = rows.withColumn("at", F.when(F.pmod("pos", F.lit(segment)) < n_max - 1, F.array(here, back)).otherwise(F.array(here)))
        rows = rows.select("rec", "pos", "split", *fields, F.explode("at").alias("at")).select("rec", "pos", "split", *fields, "at.seg", "at.ctx")
    rows = rows.select("rec", "seg", "pos", "ctx", "split", *(F.col(c).cast("string").alias(f"f{i}") for i, c in enumerate(fields)))
    rows = rows.repartition("rec", "seg").sortWithinPartitions("rec", "seg", "pos")
    part = rows.mapInArrow(_counter(n_max, len(fields)), f"field int, gram array<string>, occurrences long, records long, rec {kind}")
    if rows_split:
        part = part.groupBy("field", "gram", "rec").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    out = part.groupBy("field", "gram").agg(F.sum("occurrences").alias("occurrences"), (F.coalesce(F.sum("records"), F.lit(0)) + F.count("rec")).alias("records"))
    names = F.array(*(F.lit(c) for c in fields))
    return out.select(F.element_at(names, F.col("field") + 1).alias("field"), F.size("gram").alias("n"), "gram", "occurrences", "records")


def _counter(n_max: int | None, n_fields: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            if b.num_rows == 0:
                continue
            held.append(b)
            size += b.num_rows
            if size < BLOCK:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            piece = _pieces(t)
            cut = int(np.searchsorted(piece, piece[-1]))
            if cut:
                yield from _block(t.slice(0, cut), n_max, n_fields)
            held = t.slice(cut).to_batches()
            size = t.num_rows - cut
        if size:
            yield from _block(pa.Table.from_batches(held).combine_chunks(), n_max, n_fields)

    return run


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Numbers of the distinct values (-1 for null), and the values by number."""
    words = column.combine_chunks()
    words = (words.chunk(0) if isinstance(words, pa.ChunkedArray) else words).dictionary_encode()
    return pc.fill_null(words.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary


def _pieces(t: pa.Table) -> np.ndarray:
    """Running number of the (record, segment) of each row."""
    rec, seg = _codes(t["rec"])[0], t["seg"].to_numpy()
    return np.cumsum(np.concatenate([[False], (rec[1:] != rec[:-1]) | (seg[1:] != seg[:-1])]))


def _block(t: pa.Table, n_max: int | None, n_fields: int) -> Iterator[pa.RecordBatch]:
    rec, keys = _codes(t["rec"])
    piece, pos = _pieces(t), t["pos"].to_numpy()
    follows = np.zeros(len(pos), bool)
    follows[:-1] = (piece[1:] == piece[:-1]) & (pos[1:] == pos[:-1] + 1)
    ctx, split = (t[c].to_numpy().astype(bool) for c in ("ctx", "split"))
    for k in range(n_fields):
        yield from _intervals(*_codes(t[f"f{k}"]), follows, rec, keys, ctx, split, n_max, k)


def suffix_array(codes: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of all suffixes, and the length of each one's common prefix with the one before it.

    ``reach`` is how many terms each suffix has; those without any are left out. Prefix doubling: ranks by the first k terms give
    the ranks by the first 2 k, until all differ or none is longer; the ranks of all rounds then give the common prefixes.
    """
    m, k = len(codes), 1
    some = np.flatnonzero(reach > 0)
    rank = np.where(reach > 0, codes, -1)
    rounds = [(k, rank)]
    while len(some) and k < reach.max():
        after = np.full(m, -1, np.int64)
        on = some[reach[some] > k]
        after[on] = rank[on + k]
        distinct, place = np.unique((rank[some] + 1) * (m + 2) + after[some] + 1, return_inverse=True)
        rank = np.full(m, -1, np.int64)
        rank[some] = place
        k *= 2
        rounds.append((k, rank))
        if len(distinct) == len(some):
            break
    order = some[np.argsort(rank[some], kind="stable")]
    common = np.zeros(len(order), np.int64)
    a, b = order[:-1], order[1:]
    got = np.zeros(len(a), np.int64)
    for k, rank in reversed(rounds):
        live = np.flatnonzero((got < reach[a]) & (got < reach[b]))
        same = live[rank[a[live] + got[live]] == rank[b[live] + got[live]]]
        got[same] = np.minimum(got[same] + k, reach[a[same]])
    common[1:] = got
    return order, common


def _with_own(common: np.ndarray, who: np.ndarray) -> np.ndarray:
    """How long a prefix each suffix shares with the last one of the same record before it in the order (0 if there is none)."""
    least = [common]  # least[j][i]: smallest common prefix of the 2**j places up to i
    while 2 << (len(least) - 1) <= len(common):
        w = 1 << (len(least) - 1)
        level = least[-1].copy()
        level[w:] = np.minimum(level[w:], least[-1][:-w])
        least.append(level)
    s = np.argsort(who, kind="stable")
    own = np.zeros(len(common), np.int64)
    i = np.flatnonzero(who[s][1:] == who[s][:-1])
    here, before = s[i + 1], s[i]
    level = np.floor(np.log2(here - before)).astype(np.int64)
    for j in np.unique(level).tolist():
        h, b = here[level == j], before[level == j]
        own[h] = np.minimum(least[j][h], least[j][b + (1 << j)])
    return own


def _intervals(codes, words: pa.Array, follows, rec, keys: pa.Array, ctx, split, n_max: int | None, field: int) -> Iterator[pa.RecordBatch]:
    """The n-grams of one block, read from the intervals of common prefixes of its suffix array."""
    m = len(codes)
    goes_on = follows & (codes >= 0)
    goes_on[:-1] &= codes[1:] >= 0
    ends = np.where(goes_on, m, np.arange(m))
    reach = np.where(codes >= 0, np.minimum.accumulate(ends[::-1])[::-1] - np.arange(m) + 1, 0)
    order, common = suffix_array(codes, reach)
    if len(order):
        counted = ~ctx[order]
        gaps = np.flatnonzero(counted)  # positions that are context only begin no n-gram here
        if len(gaps) == 0:
            return
        common = np.minimum.reduceat(common[: gaps[-1] + 1], np.concatenate([[0], gaps[:-1] + 1]))
        order = order[gaps]
        who, parted = rec[order], split[order]
        own = _with_own(common, who)
    for n in range(1, min(n_max or m, int(reach.max(initial=0))) + 1):
        interval = np.cumsum(common < n)
        long = reach[order] >= n
        for parts, kept in ((long & ~parted, False), (long & parted, True)):
            at = np.flatnonzero(parts)
            if not len(at):
                continue
            iv = interval[at]
            if kept:
                at = at[np.lexsort((who[at], iv))]
                iv = interval[at]
            new = np.ones(len(at), bool)
            new[1:] = iv[1:] != iv[:-1]
            if kept:
                new[1:] |= who[at[1:]] != who[at[:-1]]
            starts = np.flatnonzero(new)
            width = np.diff(np.append(starts, len(at)))
            less = np.add.reduceat((own[at] >= n).astype(np.int64), starts)  # within-record duplicate adjacencies
            index = (order[at[starts]][:, None] + np.arange(n)).ravel()
            grams = pa.ListArray.from_arrays(pa.array(np.arange(0, len(index) + 1, n, dtype=np.int32)), words.take(pa.array(codes[index])).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(starts), field, np.int32)),
                    grams,
                    pa.array(width.astype(np.int64)),
                    pa.nulls(len(starts), pa.int64()) if kept else pa.array(width - less),
                    keys.take(pa.array(who[at[starts]])) if kept else pa.nulls(len(starts), keys.type),
                ],
                names=["field", "gram", "occurrences", "records", "rec"],
            )
