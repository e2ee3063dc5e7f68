"""Matching references to registry records by sorted neighbourhoods.

Both sides are reduced to their different titles. Every title enters one globally sorted
list under several composite keys: itself, itself read backwards, and its longest word
followed by itself; a window slides over the list and compares neighbours of the two sides.
Beside these keys of text there are keys of two words, the rarest of a title (a word counts
with those one slip away, so a slip makes none rare) with another of its rarest; under
them all titles with the same key are neighbours, however many, which is a join. A word
may be one slip away there, and a title may lack what follows its colon.

Titles that are alike bring their forms (title, year, venue) together, which get a weighted
confidence. Registry forms of one work are grouped, and in each bibliography its entries
and the works are assigned to one another one to one, with the greatest total confidence.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.llm.slips import gapped
from citeloom.operators import graph
from citeloom.session import cut

WINDOW = 12  # entries on each side that the window looks at
MEET = 2  # registry titles before and behind a title that it meets within the window
KEYS = 3  # rarest words of a title: the rarest is paired with each of the others
WEIGHTS = {"title": 0.75, "year": 0.15, "venue": 0.10}
LEAST = 0.72  # confidence of a match
SURE = 0.85  # confidence beyond doubt

# Words that authors of references exchange or leave out.
SMALL = frozenset("a an the of on in for from to with and by at".split())
_ROMAN = re.compile(r"(?:i{1,3}|iv|v|vi{0,3}|ix|x)$")



def fold(text: Column) -> Column:
    """Lower-case words of letters and digits; '|' where a subtitle may begin."""
    low = F.regexp_replace(F.lower(text), r"\s+", " ")
    low = F.replace(F.replace(low, F.lit("&amp;"), F.lit("&")), F.lit("&"), F.lit(" and "))
    low = F.regexp_replace(low, r" ?(?:[:?]|\.(?= )|(?<= )[-–—]+(?= )) ?", " | ")
    low = F.translate(low, "-‐‑–—'’\"“”`", "")
    low = F.replace(F.regexp_replace(low, r"[^\p{L}\p{M}\p{N}|]+", " "), F.lit("isation"), F.lit("ization"))
    return F.btrim(F.regexp_replace(low, r"(?: ?\|)+ ?", " | "), F.lit(" |"))


def year_of(text: Column) -> Column:
    """The first year in a typed year field, two-digit years after 1960; null where there is none."""
    full = F.regexp_extract(text, r"(?<!\d)((?:1[89]|20)\d\d)(?!\d)", 1)
    short = F.regexp_extract(text, r"^\s*'(\d\d)\b", 1)
    two = short.try_cast("int")
    return F.when(full != "", full.try_cast("int")).when(short != "", F.when(two < 60, 2000 + two).otherwise(1900 + two))


def venue_of(text: Column) -> Column:
    """Venue words in lower case without years, volumes and punctuation."""
    low = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M} ]+", " ")
    return F.trim(F.regexp_replace(low, r"\s+", " "))


def distance(a: str, b: str, most: int) -> int:
    """Edits between two strings, swaps of neighbours counted once; most + 1 where above most."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    lo = 0
    hi = min(len(a), len(b))
    while lo < hi and a[lo] == b[lo]:
        lo += 1
    end = 0
    while end < hi - lo and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[lo : len(a) - end], b[lo : len(b) - end]
    if not a or not b:
        return max(len(a), len(b))
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i] + [0] * len(b)
        best = i
        for j in range(max(1, i - most - 1), min(len(b), i + most + 1) + 1):
            left = row[j - 1] if j > i - most - 1 else most + 1
            up = before[j] if j <= i + most else most + 1
            v = min(up + 1, left + 1, before[j - 1] + (x != b[j - 1]))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == b[j - 1]:
                v = min(v, older[j - 2] + 1)
            row[j] = v
            best = min(best, v)
        if best > most:
            return most + 1
        for j in range(1, max(1, i - most - 1)):
            row[j] = most + 1
        for j in range(min(len(b), i + most + 1) + 1, len(b) + 1):
            row[j] = most + 1
    return min(row[-1], most + 1)


class Title:
    """What the comparison needs of one folded title."""

    __slots__ = ("breaks", "comment", "core", "numbers", "words")

    def __init__(self, folded: str):
        parts = folded.split()
        self.words, self.breaks, numbers, at = [], [], [], 0
        for k, w in enumerate(parts):
            if w == "|":
                self.breaks.append(at)  # a subtitle may begin here
            elif w not in SMALL:
                self.words.append(w)
                at += len(w)
                if any(c.isdigit() for c in w) or _ROMAN.match(w) and parts[k - 1] == "part":
                    numbers.append(w)
        self.numbers = tuple(sorted(numbers))
        self.comment = "comment" in parts[:2]
        self.core = "".join(self.words)


def title_likeness(a: Title, b: Title) -> float:
    """1 for equal titles down to 0; parts, editions and comments are never alike.

    Each word may have one slip, a long one two, the whole title three. One side may lack a subtitle.
    """
    if a.comment != b.comment or not a.core or not b.core:
        return 0.0
    if a.core == b.core:
        return 1.0
    if a.numbers == b.numbers:
        if len(a.words) == len(b.words):
            total = 0
            for x, y in zip(a.words, b.words):
                if x != y:
                    most = 2 if min(len(x), len(y)) >= 8 else 1
                    slips = distance(x, y, most) if min(len(x), len(y)) > 2 else 9
                    total += slips if slips <= most else 9
                    if total > 3:
                        break
            if total <= 3:
                return 1 - 0.05 * total
        most = 1 if min(len(a.core), len(b.core)) < 24 else 2
        if len(a.words) != len(b.words) and (d := distance(a.core, b.core, most)) <= most:
            return 1 - 0.05 * d
    for x, y in ((a, b), (b, a)):
        if len(y.core) + 6 <= len(x.core) and len(y.core) >= 8 and set(y.numbers) <= set(x.numbers):
            for at in x.breaks:
                tail = 0  # what both share behind the missing subtitle
                while tail < len(y.core) - at and tail < len(x.core) - at and x.core[-1 - tail] == y.core[-1 - tail]:
                    tail += 1
                most = 1 if at < 24 else 2
                d = distance(x.core[:at], y.core[: len(y.core) - tail], most)
                if d <= most and at >= 8:
                    return 0.9 - 0.05 * d
    return 0.0


def year_likeness(a: int | None, b: int | None) -> float:
    if not a or not b:
        return 0.5
    return max(0.0, 1 - 0.3 * abs(a - b))


@lru_cache(maxsize=100_000)
def venue_likeness(a: str, b: str) -> float:
    """1 for equal, abbreviated or initialled venues, 0.5 where one is missing."""
    if not a or not b:
        return 0.5
    if a == b:
        return 1.0
    x, y = ([w for w in v.split() if w not in SMALL] for v in (a, b))
    for p, q in ((x, y), (y, x)):
        if len(p) == 1 and p[0] == "".join(w[0] for w in q)[: len(p[0])] and len(p[0]) > 1:
            return 1.0
    hits = sum(any(p.startswith(q[:3]) or q.startswith(p[:3]) for q in y) for p in x)
    return hits / max(len(x), len(y), 1)


def distinctive(a: Title, b: Title) -> bool:
    """False for a title such as 'editorial', which names no work alone."""
    return min(len(a.core), len(b.core)) >= 14 or bool(a.breaks or b.breaks)


def confidence(a: tuple, b: tuple) -> float:
    """Weighted likeness of two forms (Title, year, venue)."""
    t = title_likeness(a[0], b[0])
    if t == 0:
        return 0.0
    y, v = year_likeness(a[1], b[1]), venue_likeness(a[2] or "", b[2] or "")
    if not distinctive(a[0], b[0]) and (y < 0.7 or v < 0.5):
        return 0.0
    return WEIGHTS["title"] * t + WEIGHTS["year"] * y + WEIGHTS["venue"] * v


def typed_forms(refs: DataFrame, works: DataFrame) -> DataFrame:
    """(side, id, file, t, title, year, venue) of the rows with a title, and t, the title's id; side is 1 for works."""
    parts = [fold(F.col("title")).alias("title"), year_of(F.col("year")).alias("year"), venue_of(F.col("venue")).alias("venue")]
    file = F.col("bib_file") if "bib_file" in refs.columns else F.lit(None).cast("string")
    a = refs.where(F.trim("title") != "").select(F.lit(0).alias("side"), F.col("ref_id").alias("id"), file.alias("file"), *parts)
    b = works.where(F.trim("title") != "").select(F.lit(1).alias("side"), F.col("work_id").alias("id"), F.lit(None).cast("string").alias("file"), *parts)
    return a.unionByName(b).where("title <> ''").withColumn("t", F.xxhash64("title"))


def word_pairs(titles: DataFrame) -> DataFrame:
    """(a, b): a title and a registry title under one key of two words.

    titles: (t, title, in_works). A title has a whole and, where a colon may stand, the
    parts before it; a part meets wholes only. Words of at most three letters play no part.
    """
    core = F.array_join(F.filter(F.split("title", " "), lambda w: ~w.isin("", "|", *SMALL)), "")
    ends = F.filter(F.sequence(F.lit(1), F.size(F.split("title", r"\|"))), lambda k: k < F.size(F.split("title", r"\|")))
    heads = F.filter(F.transform(ends, lambda k: F.array_join(F.slice(F.split("title", r"\|"), F.lit(1), k), "|")), lambda p: F.length(p) >= 8)
    part = F.explode(F.concat(F.array(F.struct(F.lit(True).alias("whole"), F.col("title").alias("part"))), F.transform(heads, lambda p: F.struct(F.lit(False).alias("whole"), p.alias("part")))))
    parts = titles.select("t", "in_works", core.alias("core"), part.alias("p")).select("t", "in_works", "core", F.col("p.whole").alias("whole"), F.xxhash64("p.part").alias("part"), F.array_distinct(F.filter(F.split("p.part", " "), lambda w: F.length(w) > 3)).alias("words"))
    words = cut(parts.select("t", "in_works", "whole", "part", F.explode("words").alias("word")))
    # a word counts with those that share one of its gapped grams, so a slip makes none rare
    grams = cut(words.where("whole").groupBy("word").agg(F.count("*").alias("n")).select("word", "n", F.explode(gapped("word")).alias("gram")))
    around = grams.groupBy("gram").agg(F.sum("n").alias("n"))
    weight = grams.select("word", "gram").join(around, "gram").groupBy("word").agg(F.max("n").alias("n"))
    rare = words.join(weight, "word").groupBy("t", "part", "whole", "in_works").agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "word"))), 1, KEYS).alias("top"))
    # the rarest word, perhaps with a slip, and each of the others; the rarest and the next, perhaps with a slip
    named = rare.select("t", "whole", "in_works", F.col("top")[0].word.alias("x"), F.coalesce(F.get("top", F.lit(1)).word, F.lit("")).alias("y"), F.transform(F.slice("top", F.lit(2), F.lit(KEYS)), lambda w: w.word).alias("others"))
    others = F.when(F.size("others") > 0, F.col("others")).otherwise(F.array(F.lit("")))
    one = F.flatten(F.transform(gapped("x"), lambda g: F.transform(others, lambda w: F.xxhash64(g, w))))
    two = F.transform(gapped("y"), lambda g: F.xxhash64(F.col("x"), g))
    keyed = cut(named.select("t", "whole", "in_works", F.explode(F.array_distinct(F.concat(one, two))).alias("key")))
    of_works = keyed.where("in_works").select("key", F.col("t").alias("b"), F.col("whole").alias("whole_b"))
    met = keyed.select("key", F.col("t").alias("a"), F.col("whole").alias("whole_a")).join(of_works, "key").where("(whole_a OR whole_b) AND a <> b").select("a", "b")
    cores = parts.where("whole").select(F.xxhash64("core").alias("key"), "t", "in_works")
    same = cores.select("key", F.col("t").alias("a")).join(cores.where("in_works").select("key", F.col("t").alias("b")), "key").where("a <> b").select("a", "b")
    return met.unionByName(same).distinct()


class Window:
    """Slides over sorted entries (t, title, in_works) and compares each with registry titles nearby."""

    def __init__(self, window: int = WINDOW, meet: int = MEET):
        self.window, self.meet = window, meet
        self.at = 0
        self.works: deque = deque(maxlen=meet)  # the last registry entries
        self.waiting: deque = deque()  # entries that may still meet some: [place, entry, number met]

    def add(self, entry: tuple, out: dict) -> None:
        self.at += 1
        for place, other in self.works:
            if self.at - place <= self.window:
                self._compare(entry, other, out)
        while self.waiting and (self.waiting[0][2] >= self.meet or self.at - self.waiting[0][0] > self.window):
            self.waiting.popleft()
        if entry[2]:
            for w in self.waiting:
                if w[2] < self.meet and self.at - w[0] <= self.window:
                    w[2] += 1
                    self._compare(w[1], entry, out)
            self.works.append((self.at, entry))
        self.waiting.append([self.at, entry, 0])

    @staticmethod
    def _compare(a: tuple, b: tuple, out: dict) -> None:
        key = (a[0], b[0])
        if a[0] != b[0] and key not in out:
            x, y = read(a[1]), read(b[1])
            # without a subtitle to lack, titles alike are of nearly one length
            near_by = x.breaks or y.breaks or abs(len(x.core) - len(y.core)) < 4
            out[key] = (title_likeness(x, y), distinctive(x, y)) if near_by else (0.0, True)


PAIR = "a long, b long, likeness double, distinctive boolean"


def neighbours(titles: DataFrame, window: int = WINDOW, parts: int | None = None) -> DataFrame:
    """(a, b, likeness, distinctive): titles and registry titles alike, from the sorted list.

    The list is cut into ranges of keys, and the window slides within each; the first and
    last entries of all ranges, so many as a window holds, are then looked at together, so
    no neighbourhood is lost at a border.
    """
    words = F.filter(F.split("title", " "), lambda w: F.length(w) > 3)
    plain = F.regexp_replace("title", r"[ |]+", "")
    # the longest word stands in for the rarest: a list needs no counts
    longest = F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))).w
    keys = F.array(F.concat(F.lit("f:"), plain), F.concat(F.lit("r:"), F.reverse(plain)), F.concat(F.lit("w:"), longest, F.lit(" "), plain))
    entries = titles.select(F.explode(keys).alias("key"), "t", "title", "in_works").where("key IS NOT NULL")
    wide = parts or int(titles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    listed = entries.repartitionByRange(wide, "key").sortWithinPartitions("key", "t").withColumn("range_no", F.spark_partition_id())

    def rows(found: dict, edge: list) -> pa.RecordBatch:
        pairs = [(a, b, *x, None, None, None, None) for (a, b), x in found.items() if x[0] > 0] + [(None, None, None, None, *e) for e in edge]
        kinds = (("a", pa.int64()), ("b", pa.int64()), ("likeness", pa.float64()), ("distinctive", pa.bool_()), ("key", pa.string()), ("t", pa.int64()), ("title", pa.string()), ("in_works", pa.bool_()))
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], kind) for k, (_, kind) in enumerate(kinds)], names=[n for n, _ in kinds])

    def slide(batches: Iterator[pa.RecordBatch], edges: bool) -> Iterator[pa.RecordBatch]:
        view, first, last = Window(window), [], deque(maxlen=window)
        for batch in batches:
            found: dict = {}
            for key, *entry in zip(*(batch.column(k).to_pylist() for k in range(4))):
                view.add(tuple(entry), found)
                if len(first) < window:
                    first.append((key, *entry))
                else:
                    last.append((key, *entry))
            yield rows(found, [])
        if edges:
            yield rows({}, [*first, *last])

    shape = f"{PAIR}, key string, t long, title string, in_works boolean"
    once = cut(listed.select("key", "t", "title", "in_works").mapInArrow(lambda b: slide(b, True), shape))
    border = once.where("t IS NOT NULL").select("key", "t", "title", "in_works").repartition(1).sortWithinPartitions("key", "t")
    across = border.mapInArrow(lambda b: slide(b, False), shape)
    return once.where("a IS NOT NULL").unionByName(across.where("a IS NOT NULL")).select("a", "b", "likeness", "distinctive")


_titles: dict[str, Title] = {}


def read(folded: str) -> Title:
    """A title's parts; the last ones read are kept."""
    got = _titles.get(folded)
    if got is None:
        if len(_titles) > 50_000:
            _titles.clear()
        got = _titles[folded] = Title(folded)
    return got


@F.pandas_udf(T.StructType([T.StructField("likeness", T.DoubleType()), T.StructField("distinctive", T.BooleanType())]))
def _compared(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    both = [(read(x), read(y)) for x, y in zip(a, b)]
    return pd.DataFrame({"likeness": [title_likeness(x, y) for x, y in both], "distinctive": [distinctive(x, y) for x, y in both]})


@F.pandas_udf(T.DoubleType())
def _venue_likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([venue_likeness(x or "", y or "") for x, y in zip(a, b)], dtype=float)


def alike_titles(titles: DataFrame) -> DataFrame:
    """(a, b, likeness, distinctive): titles and registry titles that are alike, equal ones included."""
    text = titles.select("t", "title")
    keyed = cut(word_pairs(titles)).join(text.toDF("a", "title_a"), "a").join(text.toDF("b", "title_b"), "b").withColumn("c", _compared("title_a", "title_b"))
    by_words = keyed.where("c.likeness > 0").select("a", "b", "c.likeness", "c.distinctive")
    own = titles.where("in_works").withColumn("c", _compared("title", "title")).select(F.col("t").alias("a"), F.col("t").alias("b"), "c.likeness", "c.distinctive").where("likeness > 0")
    return by_words.unionByName(neighbours(titles)).unionByName(own).groupBy("a", "b").agg(F.max("likeness").alias("likeness"), F.max("distinctive").alias("distinctive"))


def form_pairs(rows: DataFrame) -> DataFrame:
    """(side, form, other, confidence): forms and registry forms of at least LEAST confidence.

    rows: as typed_forms() gives them, with form, their id as (side, title, year, venue).
    """
    titles = cut(rows.groupBy("t").agg(F.first("title").alias("title"), F.max(F.col("side") == 1).alias("in_works")))
    alike = cut(alike_titles(titles))
    each = rows.groupBy("form").agg(*(F.first(c).alias(c) for c in ("side", "t", "year", "venue")))
    works = each.where("side = 1").select(F.col("t").alias("b"), F.col("form").alias("other"), F.col("year").alias("y"), F.col("venue").alias("v"))
    both = alike.join(each.withColumnRenamed("t", "a"), "a").join(works, "b").where("form <> other")
    year = F.when(F.col("year").isNull() | F.col("y").isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), 1 - 0.3 * F.abs(F.col("year") - F.col("y"))))
    scored = both.select("side", "form", "other", "likeness", "distinctive", year.alias("year"), _venue_likeness("venue", "v").alias("venue"))
    named = scored.where("distinctive OR (year >= 0.7 AND venue >= 0.5)")
    sure = WEIGHTS["title"] * F.col("likeness") + WEIGHTS["year"] * F.col("year") + WEIGHTS["venue"] * F.col("venue")
    return named.select("side", "form", "other", sure.alias("confidence")).where(F.col("confidence") >= LEAST)


def best_assignment(weights: np.ndarray) -> list[tuple[int, int]]:
    """(row, column) pairs, each at most once, with the greatest sum of weights; weights of 0 are no pair.

    Shortest augmenting paths, one for each line of the shorter side.
    """
    if weights.shape[0] > weights.shape[1]:
        return sorted((r, c) for c, r in best_assignment(weights.T))
    n, m = weights.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    row_of, way = np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        row_of[0], at = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=bool)
        while True:
            used[at] = True
            r = row_of[at]
            cost = -weights[r - 1] - u[r] - v[1:]
            free = ~used[1:]
            better = free & (cost < least[1:])
            least[1:][better] = cost[better]
            way[1:][better] = at
            step = np.where(free, least[1:], np.inf)
            to = int(step.argmin()) + 1
            delta = step[to - 1]
            u[row_of[used]] += delta
            v[used] -= delta
            least[1:][free] -= delta
            at = to
            if row_of[at] == 0:
                break
        while at:
            row_of[at] = row_of[way[at]]
            at = way[at]
    return sorted((int(row_of[c]) - 1, c - 1) for c in range(1, m + 1) if row_of[c] and weights[row_of[c] - 1, c - 1] > 0)


def assigned(wishes: DataFrame) -> DataFrame:
    """(file, form, work): in each file one work for an entry and one entry for a work, with the greatest total confidence.

    wishes: (file, form, work, confidence). Forms of a file that name one work beyond doubt
    are one entry typed several times and count as one, with the greatest confidence. What
    no one else wishes for is assigned at once; only what competes comes together, in
    groups that competition itself connects.
    """
    best = wishes.groupBy("file", "form").agg(F.max(F.struct("confidence", (-F.col("work")).alias("w"))).alias("x")).select("file", "form", (-F.col("x.w")).alias("first"), F.col("x.confidence").alias("top"))
    entry = F.when(F.col("top") >= SURE, F.xxhash64("file", F.lit("work"), "first")).otherwise(F.xxhash64("file", F.lit("form"), "form"))
    typed = best.select("file", "form", entry.alias("entry"))
    edges = cut(wishes.join(typed, ["file", "form"]).groupBy("file", "entry", "work").agg(F.max("confidence").alias("confidence")))
    of_entry = edges.groupBy("entry").agg(F.count("*").alias("works"))
    of_work = edges.groupBy("file", "work").agg(F.count("*").alias("entries"))
    counted = cut(edges.join(of_entry, "entry").join(of_work, ["file", "work"]))
    alone = counted.where("works = 1 AND entries = 1").select("entry", "work")
    open_ = cut(counted.where("works > 1 OR entries > 1").select("entry", "work", "confidence", F.xxhash64("file", "work").alias("place")))
    if open_.limit(1).count():
        group = graph.components(open_.select(F.col("entry").alias("src"), F.col("place").alias("dst")))
        rooted = open_.join(group.withColumnRenamed("id", "entry"), "entry")

        def settle(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            left, right = sorted(rows.entry.unique()), sorted(rows.work.unique())
            table = np.zeros((len(left), len(right)))
            table[np.searchsorted(left, rows.entry), np.searchsorted(right, rows.work)] = rows.confidence
            return pd.DataFrame([(left[r], right[c]) for r, c in best_assignment(table)], columns=["entry", "work"])

        alone = alone.unionByName(rooted.groupBy("component").applyInPandas(settle, "entry long, work long"))
    return typed.join(alone, "entry").select("file", "form", "work")


def match(refs: DataFrame, works: DataFrame) -> DataFrame:
    """(ref_id, work_id, confidence): references and the registry rows of the same work.

    A bibliography (bib_file) has one entry for a work, typed once or several times; rows
    without one are a bibliography each. A work may have several registry rows. Rows with
    a null, empty or signless title match nothing; missing years and venues count as
    neither for nor against; repeated rows are matched each; empty tables give an empty
    result.
    """
    rows = cut(typed_forms(refs, works).withColumn("form", F.xxhash64("side", "title", "year", "venue")))
    pairs = cut(form_pairs(rows))
    of_work = rows.where("side = 1").select("form", F.col("id").alias("work_id"))
    # registry forms of one work are connected
    linked = graph.components(pairs.where("side = 1").select(F.col("form").alias("src"), F.col("other").alias("dst")))
    group = cut(of_work.select("form").distinct().join(linked.withColumnRenamed("id", "form"), "form", "left").select("form", F.coalesce("component", "form").alias("work")))
    scored = cut(pairs.where("side = 0").join(group.withColumnRenamed("form", "other"), "other").groupBy("form", "work").agg(F.max("confidence").alias("confidence")))
    entries = rows.where("side = 0").select("form", F.coalesce("file", F.concat(F.lit("#"), "id")).alias("file"), F.col("id").alias("ref_id"))
    wishes = entries.select("form", "file").distinct().join(scored, "form")
    chosen = assigned(wishes).join(entries, ["file", "form"]).join(scored, ["form", "work"])
    return chosen.join(group.join(of_work, "form").select("work", "work_id"), "work").select("ref_id", "work_id", F.round("confidence", 4).alias("confidence"))


def found(refs: DataFrame, works: DataFrame) -> DataFrame:
    """(ref_id, work_id) of all matches."""
    return match(refs, works).select("ref_id", "work_id").distinct()
