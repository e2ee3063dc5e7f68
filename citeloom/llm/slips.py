"""Words that are one slip apart, found without comparing all pairs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def near(a: str, b: str) -> bool:
    """At most one edit or swap of neighbours apart."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    x, y = a[k:], b[k:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (len(x) > 1 and len(y) > 1 and x[0] == y[1] and x[1] == y[0] and x[2:] == y[2:])


def plain(word: str) -> str:
    """With 'oe', 'ae' and 'ue' as the vowels they may stand for."""
    return re.sub(r"([aou])e", r"\1", word)


@F.pandas_udf(T.BooleanType())
def _near(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([near(x, y) or plain(x) == plain(y) for x, y in zip(a, b)], dtype=bool)


LONG = 48  # letters; one slip leaves the first or the last twenty of a longer word as they are


def gapped(word: str) -> Column:
    """Hashes of a word and of the word with each letter left out; of a long one, of its two ends."""
    w, n = F.col(word), F.length(word)
    each = F.transform(F.sequence(F.lit(1), n), lambda k: F.concat(F.substring(w, F.lit(1), k - 1), F.substring(w, k + 1, n)))
    ends = F.array(F.concat(F.lit("^"), F.left(w, F.lit(20))), F.concat(F.lit("$"), F.right(w, F.lit(20))))
    cut_out = F.when(n >= LONG, ends).when(n == LONG - 1, F.concat(ends, each)).otherwise(each)
    return F.array_distinct(F.transform(F.concat(F.array(w, F.regexp_replace(w, "([aou])e", "$1")), cut_out), lambda x: F.xxhash64(x)))


def slips(left: DataFrame, right: DataFrame, least: int = 5) -> DataFrame:
    """(a, b): different words of left (word) and right (word), of at least `least` letters, that are one slip apart.

    Strings one edit or swap apart become equal when the right letter is left out of each
    or of one, so joining these gapped grams loses none. Empty sides give an empty table.
    """
    marks = [x.where(F.length("word") >= least).select(F.col("word").alias(k), F.explode(gapped("word")).alias("gram")) for k, x in (("a", left), ("b", right))]
    met = marks[0].join(marks[1], "gram").where("a <> b").where(F.abs(F.length("a") - F.length("b")) < 3).select("a", "b").distinct()
    return met.where(_near("a", "b"))
