"""Parallel verses: every verse is held against all others in blocks, so neither keys nor candidate pairs are shuffled.

The text is packed once: a verse is two lists of numbers, one of its roots and one of the stems of its words. Blocks of verses meet each other, in any
number of tasks, and a task counts what a verse shares with all verses of a block at once, a bit for each of them. What is written is the packed text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from quillmark.session import cut_lineage, let_go

#: Verses of a block, and blocks there are at least. Bytes of the bits of a block's units, and of one operation on them. Pairs judged at a time, and those compared word by word together.
BLOCK, LEAST_BLOCKS = 65_536, 4
BITS, CACHE = 64 << 20, 256 << 10
PAIRS, ROUND = 1 << 17, 1 << 14
KINDS = ("root", "stem")


def _blob(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as w:
        w.write_table(t.combine_chunks())
    return sink.getvalue().to_pybytes()


def _table(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def _one(x: pa.ChunkedArray | pa.Array) -> pa.Array:
    return x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x


def _pack(t: pa.Table) -> dict:
    """A piece of text from rows (verse_id, book, layer, w), with its roots, the words to be stemmed and all words; w has (position, root, word), of which those with a root count."""
    w = _one(t["w"])
    n = pc.list_value_length(w).to_numpy(zero_copy_only=False)
    x = w.flatten()
    position, root, word = (x.field(c) for c in ("position", "root", "word"))
    verse = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((position.to_numpy(zero_copy_only=False), verse))
    order = order[root.is_valid().to_numpy(zero_copy_only=False)[order]]
    own = np.bincount(verse[order], minlength=len(n))
    ends = pa.array(np.concatenate([[0], np.cumsum(own)]), pa.int32())
    out = t.select(["verse_id", "book", "layer"])
    names = {}
    for kind, values in (("root", root), ("stem", pc.fill_null(word, ""))):
        d = values.take(pa.array(order)).dictionary_encode()
        names[kind] = d.dictionary
        out = out.append_column(kind, pa.ListArray.from_arrays(ends, d.indices.cast(pa.int32())))
    out = out.filter(pa.array(own > 0))
    return {"verses": len(out), "blob": _blob(out), "roots": names["root"].to_pylist(), "asked": names["stem"].to_pylist(), "words": word.drop_null().unique().to_pylist()}


def packed(rows: DataFrame) -> DataFrame:
    """(verses, blob, roots, asked, words): pieces of the text, each with the names its numbers stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        schema = pa.schema([("verses", pa.int64()), ("blob", pa.binary()), *((c, pa.list_(pa.string())) for c in ("roots", "asked", "words"))])
        piece = lambda: pa.RecordBatch.from_pylist([_pack(pa.Table.from_batches(held))], schema)
        for b in batches:
            held.append(b)
            if sum(map(len, held)) >= BLOCK:
                yield piece()
                held = []
        if held:
            yield piece()

    return rows.mapInArrow(run, "verses long, blob binary, roots array<string>, asked array<string>, words array<string>")


def _renumbered(t: pa.Table, kind: str, numbers: np.ndarray) -> pa.Table:
    x = _one(t[kind])
    x = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(pc.list_value_length(x).to_numpy(zero_copy_only=False))]), pa.int32()), pa.array(numbers[x.flatten().to_numpy(zero_copy_only=False)], pa.int32()))
    return t.set_column(t.schema.get_field_index(kind), kind, x)


def blocked(pieces: DataFrame, names: DataFrame, n: int) -> DataFrame:
    """(blob): the text in ``n`` partitions of one block each, with the same numbers everywhere; ``names`` has one row: roots, and words with their stems."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                value = lambda c: b[c][i].values
                stem = pc.struct_field(value("stems"), "stem").dictionary_encode().indices.to_numpy(zero_copy_only=False)
                at = lambda c, among: pc.index_in(value(c), value_set=among).to_numpy(zero_copy_only=False)
                t = _table(b["blob"][i].as_py())
                t = _renumbered(t, "root", at("roots", value("all_roots")))
                t = _renumbered(t, "stem", stem[at("asked", pc.struct_field(value("stems"), "word"))])
                for k in range(min(n, len(t))):
                    yield pa.RecordBatch.from_pylist([{"block": k, "blob": _blob(t.take(pa.array(np.arange(k, len(t), n))))}], pa.schema([("block", pa.int32()), ("blob", pa.binary())]))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_table(x.as_py()) for b in batches for x in b["blob"]]
        if parts:
            yield pa.RecordBatch.from_pylist([{"blob": _blob(pa.concat_tables(parts))}], pa.schema([("blob", pa.binary())]))

    x = pieces.where("verses > 0").select("blob", "roots", "asked").crossJoin(F.broadcast(names))
    return x.mapInArrow(split, "block int, blob binary").repartitionById(n, "block").select("blob").mapInArrow(merge, "blob binary")


def by_book(blocks: DataFrame) -> DataFrame:
    """(kind, book, unit, n): in how many verses of a book a unit stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b["blob"]:
                t = _table(x.as_py())
                d = _one(t["book"]).dictionary_encode()
                for kind in KINDS:
                    v = Verses(t, kind)
                    row, unit = v.distinct()
                    key, n = np.unique(d.indices.to_numpy()[row].astype(np.int64) * v.top + unit, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * len(key), pa.string()), d.dictionary.take(pa.array(key // v.top)), pa.array(key % v.top, pa.int32()), pa.array(n, pa.int64())], ["kind", "book", "unit", "n"])

    return blocks.mapInArrow(run, "kind string, book string, unit int, n long").groupBy("kind", "book", "unit").agg(F.sum("n").alias("n"))


class Verses:
    """The lists of one kind of a block: those of row i are ``units[at[i] : at[i] + n[i]]``."""

    def __init__(self, t: pa.Table, kind: str) -> None:
        x = _one(t[kind])
        self.n = pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64)
        self.units = x.flatten().to_numpy(zero_copy_only=False)
        self.top = int(self.units.max(initial=0)) + 1
        self.place()

    def place(self) -> None:
        self.at = np.cumsum(self.n) - self.n

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n)), self.n)

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        key = np.sort(self.rows() * self.top + self.units)
        key = key[np.diff(key, prepend=-1) != 0]
        return key // self.top, key % self.top

    def keep(self, those: np.ndarray) -> None:
        """Only the units for which ``those`` is true."""
        self.n = np.bincount(self.rows()[those], minlength=len(self.n))
        self.units = self.units[those]
        self.place()

    def nth(self, rows: np.ndarray, i: int, none: int) -> np.ndarray:
        """The i-th unit of each of the rows, ``none`` where there are not so many."""
        inside = i < self.n[rows]
        return np.where(inside, self.units[np.where(inside, self.at[rows] + i, 0)], none)


def _meetings(row: np.ndarray, unit: np.ndarray, other_row: np.ndarray, other_unit: np.ndarray, others: int, top: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row, other row) that share ``least`` units, from distinct (row, unit) ordered by row and (other row, other unit); ``others`` rows of the second side, units under ``top``.

    A unit's rows are bits. The units of a row are added up in as many levels as are asked for: level j has the rows with more than j of the units so far.
    """
    number = np.full(top, -1, np.int64)
    there = np.flatnonzero(np.bincount(other_unit, minlength=top))
    number[there] = np.arange(len(there))
    width = -(-others // 64)
    bits = np.zeros((len(there), width), np.uint64)
    np.bitwise_or.at(bits.reshape(-1), number[other_unit] * width + (other_row >> 6), np.uint64(1) << (other_row & 63).astype(np.uint64))
    unit = number[unit]
    row, unit = row[unit >= 0], unit[unit >= 0]
    heads, start, n = np.unique(row, return_index=True, return_counts=True)
    many = max(1, CACHE // (8 * width))
    for size in np.unique(n[n >= least]):
        chosen = np.flatnonzero(n == size)
        for part in np.array_split(chosen, -(-len(chosen) // many)):
            level = [np.empty((len(part), width), np.uint64) for _ in range(least)]
            x, y = np.empty_like(level[0]), np.empty_like(level[0])
            for s in range(size):
                np.take(bits, unit[start[part] + s], axis=0, out=x, mode="clip")
                for j in range(min(s, least - 1), max(0, least - size + s) - 1, -1):  # levels that can still matter
                    if j == s:
                        np.bitwise_and(level[j - 1], x, out=level[j]) if j else np.copyto(level[0], x)
                    elif j:
                        np.bitwise_or(level[j], np.bitwise_and(level[j - 1], x, out=y), out=level[j])
                    else:
                        np.bitwise_or(level[0], x, out=level[0])
            words = level[-1].reshape(-1)
            full = np.flatnonzero(words != 0)
            if len(full):
                bit = np.flatnonzero(np.unpackbits(words[full].astype("<u8").view(np.uint8), bitorder="little"))
                k = full[bit >> 6]
                yield heads[part[k // width]], (k % width) * 64 + (bit & 63)


def common_units(a: Verses, b: Verses, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each pair of rows (i of a, j of b), many pairs at a time."""
    out = np.empty(len(i), np.int64)
    order = np.lexsort((a.n[i], b.n[j]))
    for k in range(0, len(order), ROUND):
        part = order[k : k + ROUND]
        x, y = i[part], j[part]
        high, wide = int(a.n[x].max()), int(b.n[y].max())
        kind = np.uint8 if min(high, wide) < 255 else np.int32
        theirs = [b.nth(y, c, -2) for c in range(wide)]
        row = [np.zeros(len(part), kind) for _ in range(wide + 1)]
        for r in range(high):
            mine = a.nth(x, r, -1)
            before = row[0]  # of the row above, one to the left
            for c in range(wide):
                here = np.maximum(before + (mine == theirs[c]), np.maximum(row[c], row[c + 1]))
                before, row[c + 1] = row[c + 1], here
        out[part] = row[wide]
    return out


def _pairs(left: pa.Table, right: pa.Table, skip: pa.Array, least: int, share: float) -> Iterator[pa.RecordBatch]:
    code = lambda c: pa.concat_arrays([_one(left[c]), _one(right[c])]).dictionary_encode(null_encoding="encode")
    books, layers = code("book"), code("layer")
    book_a, book_b = np.split(books.indices.to_numpy(), [len(left)])
    layer_a, layer_b = np.split(layers.indices.to_numpy(), [len(left)])
    of = {c: pc.struct_field(skip, c) for c in ("kind", "book", "unit")}
    for kind in KINDS:
        a, b = Verses(left, kind), Verses(right, kind)
        top = max(a.top, b.top)
        mine = pc.equal(of["kind"], kind)
        skip_book, skip_unit = pc.index_in(of["book"].filter(mine), value_set=books.dictionary), of["unit"].filter(mine)
        known = skip_book.is_valid()
        set_aside = np.unique(skip_book.filter(known).to_numpy(zero_copy_only=False).astype(np.int64) * (top + 1) + np.minimum(skip_unit.filter(known).to_numpy(zero_copy_only=False), top))

        def aside(book: np.ndarray, unit: np.ndarray, keys: np.ndarray = set_aside, top: int = top) -> np.ndarray:
            key = book.astype(np.int64) * (top + 1) + unit
            return keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key if len(keys) else np.zeros(len(key), bool)

        a.keep(~aside(book_a[a.rows()], a.units))
        row, unit = a.distinct()
        other_row, other_unit = b.distinct()

        def judged(i: np.ndarray, j: np.ndarray, kind_a: Verses = a, kind_b: Verses = b, aside: Callable = aside) -> pa.RecordBatch:
            apart = book_a[i] != book_b[j]
            i, j = i[apart], j[apart]
            common = common_units(kind_a, kind_b, i, j)
            i, j, common = i[common >= least], j[common >= least], common[common >= least]
            place = np.repeat(kind_b.at[j], kind_b.n[j]) + np.arange(kind_b.n[j].sum()) - np.repeat(np.cumsum(kind_b.n[j]) - kind_b.n[j], kind_b.n[j])
            pair = np.repeat(np.arange(len(j)), kind_b.n[j])
            rest = np.bincount(pair[~aside(book_a[i][pair], kind_b.units[place])], minlength=len(j))  # b's units without those set aside for the book of a
            likeness = common / np.maximum(np.minimum(kind_a.n[i], rest), 1)
            i, j, common, likeness = (x[likeness >= share] for x in (i, j, common, likeness))
            take = lambda t, c, at: _one(t[c]).take(pa.array(at))
            return pa.RecordBatch.from_arrays([take(left, "verse_id", i), take(left, "book", i), take(right, "verse_id", j), take(right, "book", j), pa.array(common, pa.int32()), pa.array(likeness, pa.float64())], ["verse_a", "book_a", "verse_b", "book_b", "common", "likeness"])

        for layer in np.unique(layer_b):
            mine = (layer_a[row] == layer) == (kind == "root")
            rows = np.flatnonzero(layer_b == layer)
            used = max(1, np.count_nonzero(np.bincount(other_unit[layer_b[other_row] == layer])))
            size = min(BLOCK, max(64, BITS // used // 8 * 64))
            for k in range(0, len(rows), size):
                part = rows[k : k + size]
                within = np.full(len(layer_b), -1, np.int64)
                within[part] = np.arange(len(part))
                inside = within[other_row] >= 0
                held, n = [], 0
                for i, j in _meetings(row[mine], unit[mine], within[other_row[inside]], other_unit[inside], len(part), top, least):
                    held.append((i, part[j]))
                    n += len(i)
                    if n >= PAIRS:
                        yield judged(*map(np.concatenate, zip(*held)))
                        held, n = [], 0
                if held:
                    yield judged(*map(np.concatenate, zip(*held)))


def parallels(words: DataFrame, layers: DataFrame, sizes: DataFrame, stemmed: Callable[[DataFrame, DataFrame], DataFrame], least: int = 3, share: float = 0.3, common: float = 0.1) -> DataFrame:
    """(verse_a, book_a, verse_b, book_b, common, likeness): for each verse the verses of other books whose words follow each other likewise.

    ``words`` has (verse_id, book, position, root, word), the root only where the word counts. Verses of one layer (``layers``: book, layer; say a testament)
    are compared by roots, others by stems, which ``stemmed`` adds to words from all words. Units in more than ``common`` of the verses of
    book_a (``sizes``: book, verses) are set aside on both sides, or a book's formulas would pair all its verses. What remains shares
    ``least`` different units, and a common subsequence of ``least`` units and of ``share`` of the shorter verse.

    The relation has a direction, as the units set aside are those of book_a. Verses are bounded by what they are; nothing is capped. The time grows with
    the square of the verses, as do the results; what is written and sent grows with the text. Books and the vocabulary are held by each task.
    """
    spark = words.sparkSession
    of_verse = words.groupBy("verse_id", "book").agg(F.collect_list(F.struct("position", "root", "word")).alias("w")).join(F.broadcast(layers), "book", "left")
    pieces = cut_lineage(packed(of_verse.select("verse_id", "book", "layer", "w")))
    let_go(spark)
    every = lambda c: pieces.select(F.explode(c).alias("word")).distinct()
    stems = stemmed(every("asked"), every("words")).agg(F.sort_array(F.collect_list(F.struct("word", "stem"))).alias("stems"))
    names = every("roots").agg(F.sort_array(F.collect_list("word")).alias("all_roots")).crossJoin(stems)
    n = max(LEAST_BLOCKS, -(-(pieces.agg(F.sum("verses")).first()[0] or 0) // BLOCK))
    blocks = cut_lineage(blocked(pieces, names, n))
    skip = by_book(blocks).join(F.broadcast(sizes), "book").where(F.col("n") > common * F.col("verses"))
    skip = cut_lineage(skip.agg(F.collect_list(F.struct("kind", "book", "unit")).alias("skip")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                yield from _pairs(_table(b["a"][i].as_py()), _table(b["b"][i].as_py()), b["skip"][i].values, least, share)

    kind = dict(words.dtypes)["verse_id"]
    met = blocks.select(F.col("blob").alias("a")).crossJoin(blocks.select(F.col("blob").alias("b"))).crossJoin(F.broadcast(skip))
    return met.mapInArrow(run, f"verse_a {kind}, book_a string, verse_b {kind}, book_b string, common int, likeness double")
