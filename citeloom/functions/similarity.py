"""Similarities and test statistics that SQL has no function for, as Arrow functions."""

from __future__ import annotations

import math
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jaro_winkler_score(a: str, b: str, scale: float = 0.1) -> float:
    """Jaro–Winkler likeness; the common start counts up to four letters, above 0.7 only."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, u in zip(b, used) if u]
    m, swaps = len(left), sum(x != y for x, y in zip(left, right)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    start = 0
    while start < min(4, len(a), len(b)) and a[start] == b[start]:
        start += 1
    return jaro + start * scale * (1 - jaro) if jaro > 0.7 else jaro


def jaro_winkler_scores(a: pa.Array, b: pa.Array, rows: int = 8192) -> np.ndarray:
    """jaro_winkler_score of many pairs, null as NaN: ASCII pairs of the same two lengths are compared together."""
    a, b = (x.cast(pa.string()) for x in (a, b))
    out = np.full(len(a), np.nan)
    n, m = (pc.fill_null(pc.binary_length(x), -1).to_numpy(zero_copy_only=False) for x in (a, b))
    plain = np.logical_and(*(pc.fill_null(pc.string_is_ascii(x), False).to_numpy(zero_copy_only=False) for x in (a, b)))
    there = (n >= 0) & (m >= 0)
    alone = [np.flatnonzero(there & ~plain)]
    kinds, of = np.unique(np.stack([n, m], 1)[plain], axis=0, return_inverse=True)
    order = np.flatnonzero(plain)[np.argsort(of, kind="stable")]
    for (i, j), at in zip(kinds, np.split(order, np.cumsum(np.bincount(of, minlength=len(kinds)))[:-1])):
        if not i or not j:
            out[at] = float(i == j)
        elif len(at) < 24:
            alone.append(at)
        else:
            for k in range(0, len(at), rows):
                x = at[k : k + rows]
                out[x] = _same_lengths(*(np.frombuffer("".join(s.take(pa.array(x)).to_pylist()).encode(), np.uint8).reshape(len(x), -1) for s in (a, b)))
    for k in np.concatenate(alone):
        out[k] = jaro_winkler_score(a[k].as_py(), b[k].as_py())
    return out


def _same_lengths(a: np.ndarray, b: np.ndarray, scale: float = 0.1) -> np.ndarray:
    """jaro_winkler_score of the rows of two tables of letters."""
    rows, (n, m) = len(a), (a.shape[1], b.shape[1])
    reach = max(max(n, m) // 2 - 1, 0)
    x, y = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    open_a, open_b, hit = np.ones((n, rows), bool), np.ones((m, rows), bool), np.empty(rows, bool)
    for i in range(n):
        for j in range(max(0, i - reach), min(m, i + reach + 1)):
            np.equal(x[i], y[j], out=hit)
            hit &= open_b[j]
            hit &= open_a[i]
            open_a[i] ^= hit
            open_b[j] ^= hit
    left, right = (np.ascontiguousarray(~o.T) for o in (open_a, open_b))
    common = left.sum(1)
    swaps = np.bincount(np.repeat(np.arange(rows), common), a[left] != b[right], rows) // 2
    jaro = np.where(common > 0, (common / n + common / m + (common - swaps) / np.maximum(common, 1)) / 3, 0.0)
    start = np.logical_and.accumulate(x[: min(4, n, m)] == y[: min(4, n, m)], 0).sum(0)
    return np.where((x[:m] == y[:n]).all(0) & (n == m), 1.0, np.where(jaro > 0.7, jaro + start * scale * (1 - jaro), jaro))


def indel_ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over both lengths, in percent."""
    if not a and not b:
        return 100.0
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return 200.0 * row[-1] / (len(a) + len(b))


def token_set_score(a: str, b: str) -> float:
    """Best ratio among the common words and the common words with each side's rest, 0 to 1."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    one, two = (" ".join(sorted(s - t)) for s, t in ((x, y), (y, x)))
    if both and (not one or not two):
        return 1.0
    first, second = (f"{both} {r}".strip() for r in (one, two))
    scores = [indel_ratio(first, second)]
    if both:
        scores += [indel_ratio(both, first), indel_ratio(both, second)]
    return max(scores) / 100


def _pairwise(f):  # noqa: ANN001, ANN202
    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b)], dtype=float)

    return run


@F.arrow_udf(T.DoubleType())
def jaro_winkler(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array(jaro_winkler_scores(a, b), pa.float64(), from_pandas=True)


# else a filter on the likeness would have it computed twice
jaro_winkler = jaro_winkler.asNondeterministic()
token_set_ratio = _pairwise(token_set_score)
sequence_ratio = _pairwise(lambda a, b: SequenceMatcher(None, a, b).ratio())


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            total *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * total


def upper_gamma(s: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + s * math.log(x) - math.lgamma(s))
    if x < s + 1:
        term = total = 1 / s
        k = s
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= x / k
            total += term
        return 1 - total * front
    b, c = x + 1 - s, 1e300
    d = 1 / b
    total = d
    for i in range(1, 500):
        top = -i * (i - s)
        b += 2
        d = 1 / (top * d + b)
        c = b + top / c
        total *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * total


def p_value_of(test: str, value: float, df1: float, df2: float) -> float:
    """Two-sided p of t, r and Z, upper p of F and chi2; NaN for anything else."""
    if test == "t" and df1 > 0:
        return incomplete_beta(df1 / 2, 0.5, df1 / (df1 + value * value))
    if test == "F" and df1 > 0 and df2 > 0:
        return incomplete_beta(df2 / 2, df1 / 2, df2 / (df2 + df1 * max(value, 0)))
    if test == "chi2" and df1 > 0:
        return upper_gamma(df1 / 2, max(value, 0) / 2)
    if test == "r" and df1 > 0 and abs(value) < 1:
        return p_value_of("t", value * math.sqrt(df1 / (1 - value * value)), df1, 0)
    if test == "Z":
        return math.erfc(abs(value) / math.sqrt(2))
    return math.nan


@F.pandas_udf(T.DoubleType())
def p_value(test: pd.Series, value: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    """p-values of reported tests (test, statistic, degrees of freedom)."""
    return pd.Series([p_value_of(*x) if not any(pd.isna(v) for v in x[:2]) else np.nan for x in zip(test, value, df1.fillna(0), df2.fillna(0))], dtype=float)
