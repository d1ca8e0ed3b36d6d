"""Sets of words searched root by root: whatever is asked of a set is answered where its occurrences lie, which are never shuffled.

A set belongs to its rarest root. Each unit is sent once for each of its roots, with the roots after it in the order of rarity, and the sets of
a root are grown there from array to array. So what is shuffled is at most half the square of a unit's roots, whatever the number of sets.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from quillmark.functions.lists import MIN_LIFT

#: Rows that are grown together, and occurrences of sets made at a time (more where one set alone has more).
ROWS, MOST = 100_000, 2_000_000


def by_root(words: DataFrame, vocab: DataFrame, of_unit: DataFrame | None, order: list[str], at: bool = False) -> DataFrame:
    """Rows of each root, in ``order``: the columns of ``of_unit``, where there are any, and ``roots``, the unit's roots from this one on, rarest first.

    ``words`` has (unit, root), with ``at`` also the place ``at`` of each occurrence, and a row for each of them.
    """
    held = words.join(vocab.select("root", F.col("support").cast("int").alias("own")), "root")
    item = F.struct("own", "root", *(["at"] if at else []))
    r = held.groupBy("unit").agg(F.sort_array(F.collect_list(item)).alias("r")).where("size(r) > 1")
    other = lambda x, y: F.coalesce(F.element_at(F.col("r"), x)["root"] != F.element_at(F.col("r"), y)["root"], F.lit(True))
    r = (r if of_unit is None else r.join(of_unit, "unit", "left")).drop("unit").withColumn("k", F.explode(F.sequence(F.lit(1), F.size("r"))))
    k = F.col("k")
    fresh = (k == 1) | other(F.greatest(k - 1, F.lit(1)), k)
    r = r.where(fresh & other(k, F.lit(-1))).withColumn("r", F.slice("r", k, F.size("r"))).drop("k")
    fields = {"roots": "root", **({"at": "at", "own": "own"} if at else {})}
    r = r.withColumns({name: F.col("r")[field] for name, field in fields.items()}).drop("r")
    return r.repartition(F.element_at("roots", 1)).sortWithinPartitions(F.element_at("roots", 1), *order)


def grown(starts: np.ndarray, items: np.ndarray, least: int, largest: int, most: int = MOST) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(sets, first, rows, path): all sets that ``least`` rows hold, of the first item of a row and up to ``largest`` - 1 after it.

    ``items`` of row i stand at ``starts[i]`` to ``starts[i + 1]``; rows of one first item follow each other. ``first`` is where the occurrences of
    each set begin in ``rows``, in which they are in the order of the rows; ``path`` has the places of the members in ``items``.
    """
    end, v = starts[1:], int(items.max()) + 1
    heads, sid = np.unique(items[starts[:-1]], return_inverse=True)
    back = np.argsort(sid, kind="stable")
    todo = [(heads[:, None], sid[back], back, starts[:-1][back][:, None])]
    while todo:
        sets, sid, row, path = todo.pop()
        room = end[row] - path[:, -1] - 1
        upto = np.cumsum(room)
        if upto[-1] > most and len(sets) > 1:  # in halves, between sets
            cut = min(max(int(sid[np.searchsorted(upto, upto[-1] // 2)]), 1), len(sets) - 1)
            k = int(np.searchsorted(sid, cut))
            todo += [(sets[cut:], sid[k:] - cut, row[k:], path[k:]), (sets[:cut], sid[:k], row[:k], path[:k])]
            continue
        if not upto[-1]:
            continue
        old = np.repeat(np.arange(len(row)), room)
        at = np.arange(len(old)) - np.repeat(upto - room, room) + path[old, -1] + 1
        key = sid[old] * v + items[at]
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n = np.diff(np.append(first, len(key)))
        good = n >= least
        if not good.any():
            continue
        order, found, n = order[np.repeat(good, n)], key[first[good]], n[good]
        old, at = old[order], at[order]
        sets = np.column_stack([sets[found // v], found % v])
        row, path = row[old], np.column_stack([path[old], at])
        yield sets, np.cumsum(n) - n, row, path
        if sets.shape[1] < largest:
            todo.append((sets, np.repeat(np.arange(len(n)), n), row, path))


def _array(t: pa.Table, name: str) -> pa.Array:
    a = t.column(name).combine_chunks()
    return pa.concat_arrays(a.chunks) if isinstance(a, pa.ChunkedArray) else a


def _apart(i: np.ndarray, begin: np.ndarray, gap: int) -> np.ndarray:
    """Where a place begins: at each of ``begin``, and after more than ``gap``."""
    new = np.ones(len(i), bool)
    new[1:] = np.diff(i) > gap
    new[begin] = True
    return new


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Tables of ``size`` rows or so that end where a root ends; a root of more rows is one table."""
    held, n, want = [], 0, size
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < want:
            continue
        t = pa.Table.from_batches(held)
        h = pc.list_element(_array(t, "roots"), 0)
        cut = pc.index(pc.equal(h, h[-1]), True).as_py()
        if cut:
            yield t.slice(0, cut)
        held, n = t.slice(cut).to_batches(), len(t) - cut
        want = max(size, 2 * n)
    if held:
        yield pa.Table.from_batches(held)


def _names(sets: np.ndarray, roots: pa.Array) -> pa.Array:
    """Members joined by blanks; ids are in the order of the roots."""
    each = np.sort(sets, axis=1)
    return pc.binary_join_element_wise(*(roots.take(pa.array(each[:, k])) for k in range(each.shape[1])), " ")


def _by_part(first: np.ndarray, n: int, *parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, set): where a set or one of ``parts`` changes in ``n`` occurrences, and the set of each such stretch."""
    new = np.zeros(n, bool)
    new[first] = True
    for p in parts:
        new[1:] |= p[1:] != p[:-1]
    begin = np.flatnonzero(new)
    return begin, np.searchsorted(first, begin, "right") - 1


def _each(rows: DataFrame, least: int, largest: int, answer: Callable, schema: str) -> DataFrame:
    """``answer(table, roots, starts, items)`` gives, for a block of rows, (make, starts, items); ``make`` has the columns of what ``grown`` finds in them."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _blocks(batches, ROWS):
            lists = _array(t, "roots")
            starts = lists.offsets.to_numpy().astype(np.int64)
            d = lists.flatten().dictionary_encode()
            order = pc.sort_indices(d.dictionary)
            place = np.empty(len(order), np.int64)
            place[order.to_numpy()] = np.arange(len(order))
            make, starts, items = answer(t, d.dictionary.take(order), starts - starts[0], place[d.indices.to_numpy()])
            for found in grown(starts, items, least, largest):
                columns = make(*found)
                if len(columns[0]):
                    yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, schema)


def _coded(t: pa.Table, name: str) -> tuple[np.ndarray, pa.Array]:
    """The codes of a column of strings, -1 for null, and what they stand for."""
    d = _array(t, name).dictionary_encode()
    return d.indices.fill_null(-1).to_numpy(), d.dictionary


def places(rows: DataFrame, least: int, largest: int, gap: int = 1) -> DataFrame:
    """(members, book, places) of rows by (book, i): units of a set that follow each other within ``gap`` are one place."""

    def answer(t: pa.Table, roots: pa.Array, starts: np.ndarray, items: np.ndarray) -> tuple:
        (book, books), i = _coded(t, "book"), _array(t, "i").fill_null(-1).to_numpy()

        def make(sets: np.ndarray, first: np.ndarray, row: np.ndarray, _: np.ndarray) -> list[pa.Array]:
            b = book[row]
            begin, s = _by_part(first, len(row), b)
            n = np.add.reduceat(_apart(i[row], begin, gap).astype(np.int64), begin)
            held = b[begin] >= 0
            return [_names(sets, roots).take(pa.array(s[held])), books.take(pa.array(b[begin][held])), pa.array(n[held])]

        return make, starts, items

    return _each(rows, least, largest, answer, "members string, book string, places long")


def inclusio(rows: DataFrame, least: int, largest: int, gap: int = 1) -> DataFrame:
    """(members, book) of rows by (book, i) with ``edge``, 1 for the first chapters of a book, 2 for the last, 3 for both, else 0: sets whose places each
    lie in the first or in the last, some in each."""

    def answer(t: pa.Table, roots: pa.Array, starts: np.ndarray, items: np.ndarray) -> tuple:
        (book, books), i, edge = _coded(t, "book"), _array(t, "i").fill_null(-1).to_numpy(), _array(t, "edge").fill_null(0).to_numpy()

        def make(sets: np.ndarray, first: np.ndarray, row: np.ndarray, _: np.ndarray) -> list[pa.Array]:
            b = book[row]
            begin, s = _by_part(first, len(row), b)
            place = np.flatnonzero(_apart(i[row], begin, gap))
            e, part = np.bitwise_and.reduceat(edge[row], place), np.searchsorted(place, begin)
            held = (b[begin] >= 0) & np.logical_and.reduceat(e > 0, part) & (np.bitwise_or.reduceat(e, part) == 3)
            return [_names(sets, roots).take(pa.array(s[held])), books.take(pa.array(b[begin][held]))]

        return make, starts, items

    return _each(rows, least, largest, answer, "members string, book string")


def of_books(rows: DataFrame, least: int, largest: int) -> DataFrame:
    """(members, testament, book, n, all_n) of rows by (testament, book): the ``least`` or more units of a book that hold a set, and those of its testament."""

    def answer(t: pa.Table, roots: pa.Array, starts: np.ndarray, items: np.ndarray) -> tuple:
        (book, books), (layer, layers) = _coded(t, "book"), _coded(t, "testament")

        def make(sets: np.ndarray, first: np.ndarray, row: np.ndarray, _: np.ndarray) -> list[pa.Array]:
            b, y = book[row], layer[row]
            wide, _ = _by_part(first, len(row), y)
            begin, s = _by_part(first, len(row), y, b)
            n, every = np.diff(np.append(begin, len(row))), np.diff(np.append(wide, len(row)))
            held = (n >= least) & (b[begin] >= 0) & (y[begin] >= 0)
            begin, s, n = begin[held], s[held], n[held]
            every = every[np.searchsorted(wide, begin, "right") - 1]
            return [_names(sets, roots).take(pa.array(s)), layers.take(pa.array(y[begin])), books.take(pa.array(b[begin])), pa.array(n), pa.array(every)]

        return make, starts, items

    return _each(rows, least, largest, answer, "members string, testament string, book string, n long, all_n long")


def _closest(places: list[np.ndarray]) -> int:
    """Length of the shortest stretch with one of each of ``places``, which are sorted."""
    best, all_of = 0, [p.tolist() for p in places]
    for end in (x for p in all_of for x in p):
        since = [p[k - 1] if (k := bisect_right(p, end)) else -1 for p in all_of]
        if min(since) >= 0 and (not best or end - min(since) + 1 < best):
            best = end - min(since) + 1
    return best


def widths(rows: DataFrame, least: int, largest: int, units: int, span: int = 12) -> DataFrame:
    """(members, size, support, own, tight, near) of rows with ``at`` and ``own``: in how many units a set stands side by side, and within ``span`` words.

    Of sets that may reach the floor of lift, which is left to the reader; ``own`` has the support of each member.
    """

    def answer(t: pa.Table, roots: pa.Array, starts: np.ndarray, items: np.ndarray) -> tuple:
        at, own = (_array(t, x).flatten().to_numpy() for x in ("at", "own"))
        new = np.ones(len(items), bool)
        new[1:] = items[1:] != items[:-1]
        new[starts[:-1]] = True
        begin = np.flatnonzero(new)  # of each root in a unit, which may stand there more than once
        end = np.append(begin[1:], len(items))
        at_first, again, own = at[begin], end - begin > 1, own[begin]

        def make(sets: np.ndarray, first: np.ndarray, row: np.ndarray, path: np.ndarray) -> list[pa.Array]:
            size, n = sets.shape[1], np.diff(np.append(first, len(row)))
            each = own[path[first]]
            may = n >= MIN_LIFT[size] * (1 - 1e-9) * units * np.exp(np.log(each / units).sum(axis=1))
            sets, each, path, n = sets[may], each[may], path[np.repeat(may, n)], n[may]
            if not len(n):
                return [[]]
            where = at_first[path]
            width = where.max(axis=1) - where.min(axis=1) + 1
            for k in np.flatnonzero(again[path].any(axis=1)):
                width[k] = _closest([at[begin[j] : end[j]] for j in path[k]])
            first = np.cumsum(n) - n
            tight, near = (np.add.reduceat(x.astype(np.int64), first) for x in (width == size, width <= span))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * size, pa.int32()), pa.array(each.ravel(), pa.int32()))
            return [_names(sets, roots), pa.array(np.full(len(n), size, np.int32)), pa.array(n), lists, pa.array(tight), pa.array(near)]

        return make, np.searchsorted(begin, starts), items[begin]

    return _each(rows, least, largest, answer, "members string, size int, support long, own array<int>, tight long, near long")
