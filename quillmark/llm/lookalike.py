"""One form for texts that look the same: compatibility normalisation, then a Viterbi search of look-alike lattices."""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from quillmark.session import cut_lineage

# Letters of Latin, Greek and Cyrillic with one shape; each row is one lattice class.
LOOKALIKES = """
a а
c с ϲ
d ԁ
e е
h һ
i і
j ј ϳ
l ӏ
o ο о
p ρ р
q ԛ
s ѕ
v ν ѵ
w ԝ
x х
y у
A Α А
B Β В
C С Ϲ
E Ε Е
F Ϝ
G Ԍ
H Η Н
I Ι І Ӏ
J Ј Ϳ
K Κ К
M Μ М
N Ν
O Ο О
P Ρ Р
Q Ԛ
S Ѕ
T Τ Т
V Ѵ
W Ԝ
X Χ Х
Y Υ У Ү
Z Ζ
Γ Г
Π П
Φ Ф
"""
# Other characters that stand for a sequence of the same look without being its compatibility form.
SAME_SHAPE = {"װ": "וו", "ױ": "וי", "ײ": "יי", "‐": "-", "ʼ": "’", "\t": " "}

_IGNORABLE = regex.compile(r"\p{Default_Ignorable_Code_Point}+")
_SEEN = ("<super>", "<sub>", "<fraction>", "<circle>", "<square>", "<vertical>")  # forms whose shape differs to the eye
_CLASS = {c: row.split() for row in LOOKALIKES.split("\n") for c in row.split()}
_SHAPE = {ord(c): row[0] for c, row in _CLASS.items()}
_SWITCH = 1e4  # a change of script weighs more than any n-gram score of a word
#: Characters of words that a worker remembers; without effect on results.
REMEMBERED = 1 << 22


@lru_cache(maxsize=None)
def script(c: str) -> str:
    """L, G or C for letters of the three scripts, else the empty string."""
    return "L" if regex.match(r"\p{Latin}", c) else "G" if regex.match(r"\p{Greek}", c) else "C" if regex.match(r"\p{Cyrillic}", c) else ""


@lru_cache(maxsize=1 << 16)
def _plain(c: str) -> str:
    """The character in its plain form, decomposed: width, ligature and kind of blank go, accents stay."""
    if c in SAME_SHAPE:
        return SAME_SHAPE[c]
    if unicodedata.category(c) == "Zs":
        return " "
    d = unicodedata.decomposition(c)
    if d.startswith(_SEEN):
        return c
    return unicodedata.normalize("NFKD", c)


def plain(text: str) -> str:
    """``text`` without ignorable characters, in compatibility form with decomposed and ordered marks."""
    if text.isascii():
        return text.replace("\t", " ")
    return unicodedata.normalize("NFD", "".join(map(_plain, _IGNORABLE.sub("", text))))


class Lattice:
    """Chooses the letters of a word among look-alikes; words of one shape get one spelling."""

    def __init__(self, counts: dict[tuple[str, str], int]):
        self.total: Counter[str] = Counter()
        for (a, _), n in counts.items():
            self.total[a] += n
        self.counts = counts
        self.known: dict[str, str] = {}
        self.held = 0

    def score(self, a: str, b: str) -> float:
        return math.log((self.counts.get((a, b), 0) + 0.5) / (self.total[a] + 64.0))

    def word(self, w: str) -> str:
        """The best path: fewest changes of script, then the highest sum of character bigram scores; of equal ones the same for every word of the shape."""
        shape = w.translate(_SHAPE)
        if (out := self.known.get(shape)) is None:
            if self.held > REMEMBERED:
                self.known.clear()
                self.held = 0
            out = self.known[shape] = self._search(shape)
            self.held += len(shape)
        return out

    def _search(self, shape: str) -> str:
        fixed = {script(c) for c in shape if c not in _CLASS} - {""}
        if len(fixed) == 1:
            (only,) = fixed
            if all(any(script(x) == only for x in _CLASS[c]) for c in shape if c in _CLASS):
                return "".join(next(x for x in _CLASS[c] if script(x) == only) if c in _CLASS else c for c in shape)
        # per step: (last letter, its script) -> (cost, the state before); letters are read back from the end, so a word of any length is one pass
        paths: dict[tuple[str, str], tuple[float, tuple[str, str]]] = {("^", ""): (0.0, ("", ""))}
        trail: list[dict[tuple[str, str], tuple[float, tuple[str, str]]]] = []
        for c in shape:
            if c not in _CLASS and not script(c):  # marks, digits and signs don't break a word's script
                continue
            step = {}
            for x in _CLASS.get(c, [c]):
                s = script(x)
                step[x, s] = min((cost + (_SWITCH if was and was != s else 0.0) - self.score(*_pair(was, last, x)), (last, was)) for (last, was), (cost, _) in paths.items())
            trail.append(step)
            paths = step
        at, letters = min(paths, key=lambda k: (paths[k][0], k)), []
        for step in reversed(trail):
            letters.append(at[0])
            at = step[at][1]
        return "".join(letters.pop() if c in _CLASS or script(c) else c for c in shape)

    def form(self, text: str) -> str:
        return unicodedata.normalize("NFC", " ".join([self.word(w) for w in plain(text).split(" ")]))


def _letter(c: str) -> str:
    return c if c in _CLASS or c == "^" else "*" + script(c)


def _pair(was: str, last: str, c: str) -> tuple[str, str]:
    """The bigram that the model holds: letters outside the classes count together, a word's start stands before each script."""
    return _letter(last), _letter(c)


def bigram_counts(df: DataFrame, text: str) -> dict[tuple[str, str], int]:
    """Bigrams of the words of one script over the whole column.

    The keys are pairs of the fixed look-alike letters, of a stand-in for each script's others and of the word start, some
    10,000 at most, whatever the text; only these sums reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: Counter[tuple[str, str]] = Counter()
        words: Counter[str] = Counter()
        held = 0

        def spend() -> None:
            nonlocal held
            held = 0
            for w, n in words.items():
                letters = [c for c in w if script(c)]
                if letters and len({script(c) for c in letters}) == 1:
                    last = "^"
                    for c in letters:
                        out[_letter(last), _letter(c)] += n
                        last = c
            words.clear()

        for b in batches:
            for t in b.column(0).to_pylist():
                words.update(plain(t).split(" "))
                held += len(t)  # an upper bound of what the words hold
                if held > REMEMBERED:
                    spend()
        spend()
        keys = list(out)
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in keys], pa.string()), pa.array([b for _, b in keys], pa.string()), pa.array([out[k] for k in keys], pa.int64())], names=["a", "b", "n"])

    rows = df.select(F.col(text).alias("t")).where("t is not null and t <> ''").mapInArrow(run, "a string, b string, n long")
    return {(r["a"], r["b"]): r["n"] for r in rows.groupBy("a", "b").agg(F.sum("n").alias("n")).collect()}


def one_form(df: DataFrame, text: str, counts: dict[tuple[str, str], int], form: str = "form") -> DataFrame:
    """``df`` with the one form of ``text``: texts that look the same get the same form, others differ.

    Case, accents, vowel signs and shapes stay; width, kind of blank, ignorable characters, order and composition of marks and
    look-alike letters are brought to one. Null stays null, an empty text empty; extra columns pass through.
    """
    shared = df.sparkSession.sparkContext.broadcast(counts)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lattice = Lattice(shared.value)
        for s in batches:
            yield s.map(lattice.form, na_action="ignore")

    return df.withColumn(form, run(F.col(text)))


def united(rows: DataFrame) -> DataFrame:
    """Rows (field_name, key, text, form) whose form unites different texts, as (field_name, form_id, text_id, key).

    The digests are written once, since forms are costly and every later step starts from them.
    """
    r = cut_lineage(rows.select("field_name", F.unhex(F.md5("form")).alias("form_id"), F.unhex(F.md5("text")).alias("text_id"), "key").distinct())
    several = r.groupBy("field_name", "form_id").agg(F.min("text_id").alias("a"), F.max("text_id").alias("b")).where("a <> b").select("field_name", "form_id")
    return r.join(several, ["field_name", "form_id"], "left_semi")


def lookalike_pairs(rows: DataFrame) -> DataFrame:
    """Pairs ``key_a`` < ``key_b`` with different texts of one form.

    Texts are compared once for each form, as classes, and only the classes' keys are then joined, so copies of a text are
    never set against each other. Null keys, null texts and empty texts take no part.
    """
    kept = united(rows.where("key is not null and text is not null and text <> ''"))
    c = kept.select("field_name", "form_id", "text_id").distinct()
    a = c.withColumnRenamed("text_id", "text_a")
    b = c.withColumnRenamed("text_id", "text_b")
    pairs = a.join(b, ["field_name", "form_id"]).where("text_a < text_b")
    ka = kept.select("field_name", "form_id", F.col("text_id").alias("text_a"), F.col("key").alias("x"))
    kb = kept.select("field_name", "form_id", F.col("text_id").alias("text_b"), F.col("key").alias("y"))
    out = pairs.join(ka, ["field_name", "form_id", "text_a"]).join(kb, ["field_name", "form_id", "text_b"]).where("x <> y")
    return out.select("field_name", F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()
