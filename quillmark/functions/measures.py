"""Measures as column expressions, so that they stay in generated code.

Each takes columns or names; a null in any argument gives null. Where a total is zero the measure is 0, as there is nothing to compare.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

Value = Column | str | float | int


def _c(x: Value) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def _d(x: Value) -> Column:
    return _c(x).cast("double")


def _part(k: Column, e: Column) -> Column:
    return F.when(k > 0, k * F.log(k / e)).otherwise(F.lit(0.0))


def g2(a: Value, b: Value, n1: Value, n2: Value) -> Column:
    """Signed log-likelihood of ``a`` in ``n1`` words against ``b`` in ``n2``: below zero where the first rate is lower."""
    a, b, n1, n2 = map(_d, (a, b, n1, n2))
    value = 2 * (_part(a, n1 * (a + b) / (n1 + n2)) + _part(b, n2 * (a + b) / (n1 + n2)))
    return F.when((n1 == 0) | (n2 == 0), F.lit(0.0)).when(a * n2 >= b * n1, value).otherwise(-value)


def g2_binomial(observed: Value, expected: Value, units: Value) -> Column:
    """Signed log-likelihood of ``observed`` units of ``units`` where ``expected`` were to be expected."""
    k, e, n = map(_d, (observed, expected, units))
    value = 2 * (_part(k, e) + _part(n - k, n - e))
    return F.when((n == 0) | (e <= 0) | (e >= n), F.lit(0.0)).when(k >= e, value).otherwise(-value)


def rarity(weight: Value, total: Value) -> Column:
    return -F.log(_d(weight) / _d(total))


def lift(observed: Value, expected: Value, cushion: float = 2.0) -> Column:
    return (_d(observed) + cushion) / (_d(expected) + cushion)


def per_thousand(count: Value, total: Value) -> Column:
    return F.when(_d(total) == 0, F.lit(0.0)).otherwise(F.round(1000 * _d(count) / _d(total), 2))


def occurrence_floor(words: Value) -> Column:
    """min(5, max(3, words / 1500)), halves rounded to even."""
    return F.least(F.lit(5), F.greatest(F.lit(3), F.bround(_d(words) / 1500).cast("int")))


def mid_rank(below: Value, equal: Value, n: Value) -> Column:
    """Percentile with ties counted half."""
    return (_d(below) + 0.5 * _d(equal)) / _d(n)


def hellinger(a: str, b: str) -> Column:
    """Distance of two mixes given as arrays of shares."""
    parts = F.zip_with(a, b, lambda x, y: F.pow(F.sqrt(x.cast("double")) - F.sqrt(y.cast("double")), 2))
    return F.sqrt(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / 2)


def cosine(a: str, b: str) -> Column:
    """Cosine similarity of two arrays; 0 where either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded, with zero never signed."""
    return F.round(c, digits) + F.lit(0.0)


def sql_g2(a: str, b: str, n1: str, n2: str) -> str:
    """The signed log-likelihood as SQL text."""
    part = lambda k, n: f"CASE WHEN ({k}) > 0 THEN ({k}) * ln(({k})::DOUBLE / (({n})::DOUBLE * (({a}) + ({b})) / (({n1}) + ({n2})))) ELSE 0 END"
    return f"CASE WHEN ({n1}) = 0 OR ({n2}) = 0 THEN 0.0 ELSE (CASE WHEN ({a})::DOUBLE * ({n2}) >= ({b})::DOUBLE * ({n1}) THEN 2 ELSE -2 END) * ({part(a, n1)} + {part(b, n2)}) END"


def sql_g2_binomial(k: str, e: str, n: str) -> str:
    part = lambda x, y: f"CASE WHEN ({x}) > 0 THEN ({x}) * ln(({x})::DOUBLE / ({y})) ELSE 0 END"
    return f"CASE WHEN ({n}) = 0 OR ({e}) <= 0 OR ({e}) >= ({n}) THEN 0.0 ELSE (CASE WHEN ({k}) >= ({e}) THEN 2 ELSE -2 END) * ({part(k, e)} + {part(f'({n}) - ({k})', f'({n}) - ({e})')}) END"
