"""Sequence functions that Catalyst has no expression for, as Arrow functions over arrays, and their plain forms."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence; matches of each item are walked as a longest rising run, so unlike parts cost nothing."""
    where: dict = {}
    for j, y in enumerate(b):
        where.setdefault(y, []).append(j)
    tails: list[int] = []
    for x in a:
        for j in reversed(where.get(x, ())):
            k = bisect_left(tails, j)
            tails[k : k + 1] = [j]
    return len(tails)


def longest_common_run(a: list, b: list, breaks: int = 0) -> int:
    """Longest run both hold side by side; with ``breaks`` = 1 one item may be changed or added inside it."""
    best, here = 0, {}
    for i, x in enumerate(a):
        row = {}
        for j, y in enumerate(b):
            if x == y:
                row[j] = here.get(j - 1, 0) + 1
                best = max(best, row[j])
        here = row
    if not breaks:
        return best
    ends = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    starts = [[0] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a)):
        for j in range(len(b)):
            if a[i] == b[j]:
                ends[i + 1][j + 1] = ends[i][j] + 1
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            if a[i] == b[j]:
                starts[i][j] = starts[i + 1][j + 1] + 1
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if ends[i][j]:
                for p, q in ((1, 1), (1, 0), (0, 1)):
                    if i + p <= len(a) and j + q <= len(b):
                        best = max(best, ends[i][j] + starts[i + p][j + q])
    return best


def smallest_window(items: list, wanted: list) -> int:
    """Length of the shortest stretch of ``items`` with every wanted item; 0 where one is missing or none is wanted."""
    need = set(wanted)
    last: dict = {}
    best = 0
    for i, x in enumerate(items):
        if x in need:
            last[x] = i
            if len(last) == len(need):
                span = i - min(last.values()) + 1
                best = span if not best else min(best, span)
    return best


def without(items: list, leave_out: frozenset) -> tuple[list, list[int]]:
    """Items less those left out, with the places they stood in."""
    kept = [(x, i) for i, x in enumerate(items) if x not in leave_out]
    return [x for x, _ in kept], [i for _, i in kept]


@F.pandas_udf(IntegerType())
def lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_length(list(x), list(y)) for x, y in zip(a, b)])


@F.pandas_udf(IntegerType())
def common_run(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([longest_common_run(list(x), list(y)) for x, y in zip(a, b)])


@F.pandas_udf(IntegerType())
def bridged_run(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([longest_common_run(list(x), list(y), 1) for x, y in zip(a, b)])


@F.pandas_udf(IntegerType())
def tightest_span(items: pd.Series, wanted: pd.Series) -> pd.Series:
    return pd.Series([smallest_window(list(x), list(y)) for x, y in zip(items, wanted)])


def sql_lcs(a: str, b: str) -> str:
    """DuckDB: length of the longest common subsequence of two lists, row by row of the table of prefixes."""
    rows = f"list_transform({a}, lambda x: list_transform({b}, lambda y: (x = y)::INT))"
    step = "list_transform(range(1, len(m) + 1), lambda j: greatest(acc[j], list_max(list_transform(range(1, j + 1), lambda k: m[k] * (coalesce(acc[k - 1], 0) + 1)))))"
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 ELSE list_max(list_reduce(list_prepend(list_transform({b}, lambda y: 0), {rows}), lambda acc, m: {step})) END"


def sql_common_run(a: str, b: str) -> str:
    """DuckDB: length of the longest run of items that two lists share side by side."""
    rows = f"list_transform({a}, lambda x: list_transform({b}, lambda y: (x = y)::INT))"
    step = "list_concat(list_transform(range(1, len(m) + 1), lambda j: m[j] * (coalesce(acc[j - 1], 0) + 1)), acc[len(m) + 1 :])"
    best = f"list_reduce(list_prepend(list_transform({b}, lambda y: 0), {rows}), lambda acc, m: list_append(({step})[1 : len(m)], greatest(list_max(acc), list_max(list_transform(range(1, len(m) + 1), lambda j: m[j] * (CASE WHEN j > 1 THEN acc[j - 1] ELSE 0 END + 1))))))"
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 ELSE list_max({best}) END"
