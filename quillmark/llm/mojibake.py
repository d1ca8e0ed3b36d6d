"""Garbled text from wrong character encodings: best-first search over encode, decode and unescape operations."""

from __future__ import annotations

import heapq
import html
import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from quillmark.llm.rows import slices

#: Counters of the character model; bounds on what it holds and on what reaches the driver, whatever the text.
PAIRS, SINGLES = 1 << 20, 0x110000
#: Encodings that text is commonly read in by mistake (fixed values: names of codecs).
READ_AS = ("cp1252", "latin-1", "cp437", "mac_roman", "cp1251", "cp1250", "cp850", "cp866", "koi8_r", "cp1253", "cp1254", "iso8859_15")
#: Single-byte encodings that text was written in (fixed values: names of codecs).
WRITTEN_IN = ("cp1252", "cp1250", "cp1251", "cp1253", "cp1255", "iso8859_2", "koi8_r", "cp866", "cp437", "mac_roman")
#: Nats a repair must save: where bytes form UTF-8, which hardly happens by chance; and where only another table of letters is tried.
UTF8_GAIN, TABLE_GAIN = 2.0, 18.0
#: A character pair outside ASCII is odd when it costs this much; other tables are tried where the odd pairs of a text cost ``TABLE_GAIN``, as no less could be saved.
ODD_PAIR = 8.0
#: Nats a character not seen anywhere may cost a word that decodes whole, where the same operation is proved by another word.
UNSEEN = 12.0
#: States that are taken from the queue before the cheapest found so far is taken; the search then starts again from it, until nothing is saved.
POPS = 48
#: Characters of words that a worker remembers, and characters that are costed in one array; without effect on results.
REMEMBERED, STRETCH = 1 << 21, 1 << 13

_BLANKS = regex.compile(r"([\t-\r ]+)")
Move = tuple[str, float, bool]
_LOST = "�"


@lru_cache(maxsize=None)
def _bytes_of(codec: str) -> dict[str, int]:
    """Character to byte; bytes that the codec leaves open stand for the control characters of that number."""
    out: dict[str, int] = {}
    for b in range(256):
        try:
            c = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            c = chr(b)
        out.setdefault(c, b)
    return out


@lru_cache(maxsize=None)
def _table(read: str, written: str) -> dict[int, str]:
    """Translation from what was read to what was written, where both tables have the byte."""
    out = {}
    for c, b in _bytes_of(read).items():
        if b >= 0x80:
            try:
                out[ord(c)] = bytes([b]).decode(written)
            except UnicodeDecodeError:
                out[ord(c)] = _LOST
    return out


@lru_cache(maxsize=None)
def _as_bytes(read: str) -> dict[int, str]:
    """Translation of characters to the bytes they were read from, written as characters below U+0100; others become NUL."""
    table = _bytes_of(read)
    return {c: "\0" for c in range(0x80, 0x100)} | {ord(c): chr(b) for c, b in table.items()}


def _near() -> regex.Pattern:
    """Finds the first two characters of a UTF-8 sequence as any of the encodings shows them."""
    parts = []
    for read in READ_AS:
        lead, follow = ("".join(c for c, b in _bytes_of(read).items() if lo <= b < hi) for lo, hi in ((0xC2, 0xF5), (0x80, 0xC0)))
        parts.append(f"[{regex.escape(lead)}][{regex.escape(follow)}]")
    return regex.compile("|".join(parts))


_NEAR = _near()
_SEQUENCE = regex.compile("[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")


def undo_utf8(word: str, read: str) -> tuple[str, bool]:
    """``word`` with every run of bytes that is valid multi-byte UTF-8 decoded, and whether that leaves nothing outside ASCII as it was."""
    raw = word.translate(_as_bytes(read))
    if not _SEQUENCE.search(raw):
        return word, False
    out, at, rest = [], 0, ""
    for m in _SEQUENCE.finditer(raw):
        try:
            c = m.group().encode("latin-1").decode("utf-8")
        except UnicodeDecodeError:
            continue
        rest += word[at : m.start()]
        out += [word[at : m.start()], c]
        at = m.end()
    out.append(word[at:])
    return "".join(out), (rest + word[at:]).isascii()


def _pair_slots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a.astype(np.uint64) * np.uint64(0x9E3779B1) ^ b.astype(np.uint64) * np.uint64(0x85EBCA77)) >> np.uint64(7)).astype(np.int64) & (PAIRS - 1)


def character_counts(df: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Counts of character pairs and of characters over all texts, in hashed counters: at most ``PAIRS`` + ``SINGLES`` sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, singles = np.zeros(PAIRS, np.int64), np.zeros(SINGLES, np.int64)
        for batch in batches:
            for part in slices(batch, 0):
                c = np.frombuffer("\n".join(part.column(0).to_pylist()).encode("utf-32-le"), np.uint32)
                if len(c) > 1:
                    pairs += np.bincount(_pair_slots(c[:-1], c[1:]), minlength=PAIRS)
                singles += np.bincount(c, minlength=SINGLES)
        for base, held in ((0, pairs), (PAIRS, singles)):
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array(at + base), pa.array(held[at])], names=["slot", "n"])

    rows = df.select(F.col(text).alias("t")).where("t is not null and t <> ''").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    got = rows.toArrow()
    held = np.zeros(PAIRS + SINGLES, np.int64)
    held[got["slot"].to_numpy()] = got["n"].to_numpy()
    return held[:PAIRS], held[PAIRS:]


class Repairer:
    """Searches the cheapest text that encode, decode and unescape operations lead to.

    What is known of a word (its cost, its odd pairs, what each operation makes of it) is kept between texts, up to ``REMEMBERED``
    characters of words; ``learn`` fills it for many words at once, so that the costs under all tables are array operations.
    """

    def __init__(self, pairs: np.ndarray, singles: np.ndarray):
        self.pairs, self.singles, self.total = pairs, singles, max(1, int(singles.sum()))
        self.swaps = [(r, w) for r in READ_AS for w in WRITTEN_IN if r != w]
        tables = [_table(*op) for op in self.swaps]
        moved = sorted({c for t in tables for c in t})
        self.index = np.zeros(0x110000, np.int16)
        self.index[moved] = np.arange(1, len(moved) + 1)
        self.moved = np.array([[0, *(ord(t.get(c, chr(c))) for c in moved)] for t in tables], np.uint32)
        self.forget()

    def forget(self) -> None:
        self.held = 0
        self.word_cost: dict[str, float] = {}
        self.odd: dict[str, float] = {}
        self.garbled: dict[str, bool] = {}
        self.undone: dict[str, dict[tuple, Move]] = {}
        self.row: dict[str, int] = {}
        self.gains = np.zeros((1024, len(self.swaps)))

    def _costs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Nats of each character ``b`` after ``a``; control characters and lost ones cost more."""
        single = (self.singles[b] + 0.1) / (self.total + 1000.0)
        return 6.0 * ((b == ord(_LOST)) | ((b >= 0x7F) & (b < 0xA0))) - np.log(0.95 * self.pairs[_pair_slots(a, b)] / (self.singles[a] + 20.0) + 0.05 * single)

    def _laid_out(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The words with blanks between, in stretches: (characters, places of pairs outside ASCII, word of each pair)."""
        codes = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), np.uint32)
        owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)) + 1)
        for p in range(0, len(codes) - 1, STRETCH):
            c = codes[p : p + STRETCH + 1]
            yield c, owner[p : p + STRETCH], np.flatnonzero((c[:-1] >= 0x80) | (c[1:] >= 0x80))

    def learn(self, words: Iterable[str]) -> None:
        """Costs, odd pairs and readings of UTF-8 of words not known yet."""
        if new := [w for w in dict.fromkeys(words) if w not in self.garbled]:
            cost, odd = np.zeros(len(new)), np.zeros(len(new))
            for c, owner, outside in self._laid_out(new):
                each = self._costs(c[:-1], c[1:])
                np.add.at(cost, owner, each)
                dear = outside[each[outside] >= ODD_PAIR]
                np.add.at(odd, owner[dear], each[dear])
            self.word_cost.update(zip(new, cost.tolist()))
            self.odd.update(zip(new, odd.tolist()))
            self.garbled.update((w, self._garbled(w)) for w in new)
            self.held += sum(map(len, new))

    def learn_swaps(self, words: Iterable[str]) -> None:
        """What every other table of letters saves, of words not known yet."""
        if new := [w for w in dict.fromkeys(words) if w not in self.row]:
            at = len(self.row)
            self.row.update(zip(new, range(at, at + len(new))))
            while len(self.row) > len(self.gains):
                self.gains = np.concatenate([self.gains, np.zeros_like(self.gains)])
            self.gains[at : at + len(new)] = 0.0
            for c, owner, outside in self._laid_out(new):
                if len(outside):
                    i = self.index[c]
                    after = np.where(i > 0, self.moved[:, i], c)
                    saved = self._costs(c[outside], c[outside + 1]) - self._costs(after[:, outside], after[:, outside + 1])
                    starts = np.flatnonzero(np.diff(owner[outside], prepend=-1))
                    self.gains[at + owner[outside][starts]] += np.add.reduceat(saved, starts, axis=1).T

    def cost(self, word: str) -> float:
        """Sum of the costs of the character pairs of a word between blanks."""
        if (c := self.word_cost.get(word)) is None:
            x = np.frombuffer(f" {word} ".encode("utf-32-le"), np.uint32)
            c = self.word_cost[word] = float(self._costs(x[:-1], x[1:]).sum())
            self.held += len(word)
        return c

    def undo(self, word: str) -> dict[tuple, Move]:
        """What undoing a reading of UTF-8, or an HTML escape, makes of a word: (text, nats saved, nothing left as it was)."""
        if (m := self.undone.get(word)) is None:
            m = {}
            if _NEAR.search(word):
                for read in READ_AS:
                    after, whole = undo_utf8(word, read)
                    if after != word:
                        m["utf8", read] = (after, self.cost(word) - self.cost(after), whole)
            if "&" in word and (after := html.unescape(word)) != word:
                m["unescape",] = (after, self.cost(word) - self.cost(after), True)
            self.undone[word] = m
            self.held += len(word)
        return m

    def _garbled(self, word: str) -> bool:
        """Whether undoing readings of UTF-8 or escapes could save enough in this word."""
        for op, (after, gain, _) in self.undo(word).items():
            gain = gain if op[0] == "utf8" else 0.0
            if gain >= UTF8_GAIN or gain + max((g for o, (_, g, _) in self.undo(after).items() if o[0] == "utf8"), default=-math.inf) >= UTF8_GAIN:
                return True
        return False

    def odd_enough(self, words: Iterable[str]) -> bool:
        """Whether another table of letters could save enough."""
        return sum(map(self.odd.__getitem__, words)) >= TABLE_GAIN

    def tables(self, words: tuple[str, ...]) -> Iterator[tuple[float, tuple[str, ...]]]:
        """What each other table of letters makes of the runs of words it saves most in.

        A table holds for a passage, so words that it spoils count against it; each run of words saves ``TABLE_GAIN`` at least, and where
        words between two runs would lose more than that, they are two runs.
        """
        at = [i for i, w in enumerate(words) if not w.isascii()]
        self.learn_swaps(words[i] for i in at)
        saved = self.gains[[self.row[words[i]] for i in at]]
        sums = np.cumsum(saved, axis=0)
        most = (sums - np.minimum(0.0, np.minimum.accumulate(np.concatenate([np.zeros((1, sums.shape[1])), sums[:-1]])))).max(axis=0)
        for k in np.flatnonzero(most >= TABLE_GAIN).tolist():
            table, out, gain = _table(*self.swaps[k]), list(words), 0.0
            for j in _runs(saved[:, k].tolist(), TABLE_GAIN):
                out[at[j]] = words[at[j]].translate(table)
                gain += saved[j, k]
            yield float(gain), tuple(out)

    def steps(self, words: tuple[str, ...]) -> Iterator[tuple[float, bool, tuple[str, ...]]]:
        """Neighbours of a state: one operation on the words, or on the passages, where it saves most."""
        self.learn(words)
        seen: dict[tuple, list[tuple[int, str, float, bool]]] = {}
        for i, w in enumerate(words):
            for op, move in self.undone[w].items():
                seen.setdefault(op, []).append((i, *move))
        for op, hits in seen.items():  # UTF-8 proves itself word by word; where it did, words of nothing else follow
            best = max(h[2] for h in hits)
            if best >= -UNSEEN:  # a step may cost something where the next one saves more
                proved = best >= UTF8_GAIN
                chosen = [h for h in hits if h[2] > 0 or (h[2] > -UNSEEN * len(h[1]) if proved and h[3] else not proved and h[2] == best)]
                out = list(words)
                for i, after, _, _ in chosen:
                    out[i] = after
                yield sum(h[2] for h in chosen), op[0] != "unescape", tuple(out)
        if self.odd_enough(words):
            for saved, out in self.tables(words):
                yield saved, True, out

    def search(self, words: tuple[str, ...]) -> tuple[str, ...] | None:
        """Best-first: the cheapest state is taken next, states seen are not taken again, and the cheapest one met is the result.

        An HTML escape by itself is markup, so a state counts only once an encoding was undone on the way to it. States dearer than
        the text by more than ``UNSEEN`` are not gone on from. With something found, the search ends after ``POPS`` states, to start
        again from there; without, it goes on until no state is left.
        """
        first = sum(map(self.cost, words))
        queue: list[tuple[float, int, bool, tuple[str, ...]]] = [(first, 0, False, words)]
        visited, best, count, taken = {(hash(words), False)}, (math.inf, words), 0, 0
        while queue and queue[0][0] < best[0] and (taken < POPS or best[0] == math.inf):
            cost, _, undone, state = heapq.heappop(queue)
            taken += 1
            if undone and cost < best[0] and cost <= first - UTF8_GAIN:
                best = (cost, state)
            for saved, encoding, nxt in self.steps(state):
                if cost - saved <= first + UNSEEN and (h := (hash(nxt), undone or encoding)) not in visited:
                    visited.add(h)
                    count += 1
                    heapq.heappush(queue, (cost - saved, count, undone or encoding, nxt))
        return best[1] if best[0] < math.inf else None

    def repair_all(self, texts: list[str]) -> list[str | None]:
        """The restored texts; None where nothing is found to be garbled."""
        if self.held > REMEMBERED:
            self.forget()
        split = [_BLANKS.split(t) for t in texts]  # words at even places, the blanks between them at odd ones
        at = [[i for i in range(0, len(parts), 2) if not parts[i].isascii() or "&" in parts[i]] for parts in split]
        self.learn(parts[i] for parts, places in zip(split, at) for i in places)
        suspects, odd = [], []
        for k, (parts, places) in enumerate(zip(split, at)):
            words = [parts[i] for i in places]
            if strange := self.odd_enough(words):
                odd += [w for w in words if not w.isascii()]
            suspects.append(strange or any(map(self.garbled.__getitem__, words)))
        self.learn_swaps(odd)
        return [self._restored(parts, places) if s else None for parts, places, s in zip(split, at, suspects)]

    def _restored(self, parts: list[str], places: list[int]) -> str | None:
        words = out = tuple(parts[i] for i in places)
        while (better := self.search(out)) is not None and better != out:  # each search saves something, so it ends
            out = better
        if out == words:
            return None
        for i, w in zip(places, out):
            parts[i] = w
        return "".join(parts)

    def repair(self, text: str) -> str | None:
        """The restored text, or None where nothing is found to be garbled."""
        return self.repair_all([text])[0]


def _runs(saved: list[float], price: float) -> list[int]:
    """The places in the runs that save most together, where each run costs ``price``."""
    off, on, began = 0.0, -math.inf, []
    closed = []
    for g in saved:  # best sums so far, outside and inside a run
        opened = off - price > on
        on_now = (off - price if opened else on) + g
        ended = on > off
        off = max(off, on)
        began.append(opened)
        closed.append(ended)
        on = on_now
    inside, out = on > off, []
    for k in range(len(saved) - 1, -1, -1):
        if inside:
            out.append(k)
            inside = not began[k]
        else:
            inside = closed[k]
    return out[::-1]


def find_garbled(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, restored, whole) of the rows some part of whose text was read in a wrong encoding.

    Words with characters outside ASCII are the states' parts; operations undo a reading of UTF-8 as another encoding, a reading
    of one single-byte table as another, or an HTML escape, once or several times over. The plausibility of a text is the cost of its
    character pairs under counts of the whole column. ``restored`` is the cheapest text reached; ``whole`` is false where
    replacement characters show that something is lost, such a text is reported even if nothing can be restored.

    Null and empty texts are never garbled; repeated rows come out repeated; an empty table gives an empty result. Texts are
    searched where they are read, without a shuffle.
    """
    pairs, singles = character_counts(df, text)
    shared = df.sparkSession.sparkContext.broadcast((pairs, singles))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Repairer(*shared.value)
        for b in (part for batch in batches for part in slices(batch, 1)):
            at, restored, whole = [], [], []
            texts = b.column(1).to_pylist()
            for i, (t, out) in enumerate(zip(texts, r.repair_all(texts))):
                if out is not None or _LOST in t:
                    at.append(i)
                    restored.append(t if out is None else out)
                    whole.append(_LOST not in (t if out is None else out))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), pa.array(restored, pa.string()), pa.array(whole, pa.bool_())], names=["key", "restored", "whole"])

    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("t")).where(F.col("t").rlike(r"[^\x00-\x7F]|&#?\w+;"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, restored string, whole boolean").select(F.col("key").alias(key), "restored", "whole")
