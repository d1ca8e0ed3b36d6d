"""Byte-level BPE by speculation: greedy longest match proposes tokens, pair checks accept them, exact merging mends the rest."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from quillmark.llm.rows import slices

#: Where the public vocabularies lie; every query takes it as a parameter.
TOKENIZERS = "/opt/tokenizers"
#: The published split pattern of the 50k byte-level vocabulary (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct words that a Python worker remembers before it starts anew; a bound on memory, without effect on results.
REMEMBERED = 1 << 22


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins for bytes in the vocabulary file: printable Latin-1 stands for itself, the others follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class SpeculativeBPE:
    """Encoder of one vocabulary file; the ids equal those of exact merging in rank order."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        vocab = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        n = max(vocab.values()) + 1
        self.left, self.right = np.arange(n, dtype=np.int64), np.arange(n, dtype=np.int64)
        self.rank = np.full(n, -1, np.int64)  # bytes merge before everything else
        self.ids: dict[bytes, int] = {}
        pairs: dict[tuple[int, int], int] = {}
        for b in letters:
            self.ids[raw(b)] = vocab[b]
        for k, (a, b) in enumerate(merges):
            c = vocab[a + b]
            pairs[vocab[a], vocab[b]] = c
            self.left[c], self.right[c], self.rank[c] = vocab[a], vocab[b], k
            self.ids[raw(a) + raw(b)] = c
        self.pairs = pairs
        self.ranks = self.rank.tolist()
        keys = np.array([(a << 32) | b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ids = keys[order], np.fromiter(pairs.values(), np.int64, len(pairs))[order]
        self.longest = max(map(len, self.ids))
        self.split = regex.compile(PATTERN).findall
        self.known: dict[str, tuple[int, ...]] = {}
        self.held = 0
        self.mended = 0

    def greedy(self, word: bytes) -> list[int]:
        """Longest match first, from the left; every single byte is a token, so it always ends."""
        ids, out, at, n = self.ids, [], 0, len(word)
        while at < n:
            end = min(n, at + self.longest)
            while (t := ids.get(word[at:end])) is None:
                end -= 1
            out.append(t)
            at = end
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens: would merging, run on both together, leave the border between them alone?

        The merges that built either token are undone from the last to the first; at each moment the two pieces at the border
        must not form a merge that comes before the one just undone.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        good = np.ones(len(a), bool)
        limit = np.full(len(a), np.iinfo(np.int64).max)  # rank of the merge undone last
        at_right = np.zeros(len(a), bool)  # undone in the right token; on equal rank the left one of two merges runs first
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            key = (x << 32) | y
            i = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            hit = self.pair_keys[i] == key
            r = np.where(hit, self.rank[self.pair_ids[i]], np.iinfo(np.int64).max)
            early = hit & ((r < limit[live]) | ((r == limit[live]) & at_right[live]))
            good[live[early]] = False
            ra, rb = self.rank[x], self.rank[y]
            go = ~early & ((ra >= 0) | (rb >= 0))
            live, ra, rb = live[go], ra[go], rb[go]
            undo_left = ra > rb
            l, r_ = live[undo_left], live[~undo_left]
            limit[l], at_right[l] = ra[undo_left], False
            a[l] = self.right[a[l]]
            limit[r_], at_right[r_] = rb[~undo_left], True
            b[r_] = self.left[b[r_]]
        return good

    def merge(self, word: bytes) -> list[int]:
        """Exact merging, the lowest rank first and the leftmost of equals."""
        pairs, ranks = self.pairs, self.ranks
        parts = [self.ids[word[i : i + 1]] for i in range(len(word))]
        if len(parts) > 400:
            return self._merge_long(parts)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                c = pairs.get((parts[i], parts[i + 1]))
                if c is not None and (best is None or ranks[c] < ranks[best]):
                    best, at = c, i
            if best is None:
                break
            parts[at : at + 2] = [best]
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same with a heap and links, for runs of thousands of characters."""
        import heapq

        n = len(parts)
        nxt, prv, gone = list(range(1, n + 1)), list(range(-1, n - 1)), [False] * n
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = nxt[i]
            if j < n and (c := self.pairs.get((parts[i], parts[j]))) is not None:
                heapq.heappush(heap, (self.ranks[c], i, parts[i], parts[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = nxt[i]
            if gone[i] or j >= n or parts[i] != x or parts[j] != y:
                continue
            parts[i] = self.pairs[x, y]
            gone[j] = True
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            offer(i)
            if prv[i] >= 0:
                offer(prv[i])
        return [p for p, g in zip(parts, gone) if not g]

    def learn(self, words: set[str]) -> None:
        """Encode the words that aren't known yet, all border checks of the batch at once."""
        if self.held > REMEMBERED:
            self.known.clear()
            self.held = 0
        new = [w for w in words if w not in self.known]
        self.held += sum(map(len, new)) + 16 * len(new)
        if not new:
            return
        raw = [w.encode("utf-8") for w in new]
        guess = [self.greedy(w) for w in raw]
        n = np.fromiter(map(len, guess), np.int64, len(guess))
        flat = np.fromiter(chain.from_iterable(guess), np.int64, int(n.sum()))
        owner = np.repeat(np.arange(len(guess)), n)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        bad: set[int] = set()
        if len(inner):
            pair, back = np.unique((flat[inner] << 32) | flat[inner + 1], return_inverse=True)
            ok = self.compatible(pair >> 32, pair & 0xFFFFFFFF)
            bad = set(owner[inner[~ok[back]]].tolist())
        self.mended += len(bad)
        for i, w in enumerate(new):
            self.known[w] = tuple(self.merge(raw[i]) if i in bad else guess[i])

    def words(self, texts: list[str | None]) -> list[list[str]]:
        """The words of each text, all of them learnt."""
        out = [self.split(t) if t else [] for t in texts]
        self.learn(set().union(*out))
        return out

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        known = self.words(texts)
        return [list(chain.from_iterable(map(self.known.__getitem__, w))) for w in known]

    def count(self, text: str) -> int:
        w = self.split(text)
        self.learn(set(w))
        return sum(len(self.known[x]) for x in w)


@lru_cache(maxsize=4)
def encoder(path: str) -> SpeculativeBPE:
    """One encoder for each vocabulary and Python worker."""
    return SpeculativeBPE(path)


def encode(df: DataFrame, key: str, text: str, tokenizers: str = TOKENIZERS, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """(key, ids) of every row: the ids of the vocabulary without special tokens; an empty list for an empty and for a null text.

    Rows are encoded where they are read, without a shuffle. Strings of special tokens in a text are ordinary text. Repeated rows
    come out repeated; a text of any length is encoded whole.
    """
    path = f"{tokenizers}/{vocabulary}.json"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for b in batches:
            for part in slices(b, 1):
                ids = bpe.encode(part.column(1).to_pylist())
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["key", "ids"])

    out = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return out.mapInArrow(run, f"key {out.schema['key'].dataType.simpleString()}, ids array<int>").select(F.col("key").alias(key), "ids")
