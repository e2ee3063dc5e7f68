"""Test passages inside a training corpus, by BM25 retrieval with block-max WAND.

The test items are few against the corpus, so they are the inverted index and the corpus
is the stream of queries: each document is cut into overlapping passages of words, every
passage retrieves all items that score at least their threshold, and what is retrieved
must then share `stretch` successive words. An item's threshold is the lowest score that
any of its stretches of that length reaches, so nothing that shares one is lost.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.lookalike import JOINED, ONE_TO_ONE

STRETCH = 12  # successive words that make a leak
PASSAGE = 30  # words in a passage
K1, B = 1.2, 0.75
BLOCK = 16  # postings in a block
ROWS = 256  # passages whose bounds are summed at once
#: ranges of items with similar thresholds, at most, and numbers in the table of their bounds
RANGES, TABLE = 256, 4_000_000
#: items that one index holds; more items are searched in several passes
INDEX_ITEMS = 50_000

_MAP = str.maketrans(ONE_TO_ONE | JOINED)
_UNSEEN = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ]")
_MAPPED = re.compile("[" + "".join(sorted(map(re.escape, ONE_TO_ONE | JOINED))) + "]")
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\[nrt]")
_HYPHEN_BREAK = re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n\s*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Runs of letters and digits, apart from case and from look-alike characters."""
    if "\\" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] else " ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFC", _UNSEEN.sub("", text))
        if _MAPPED.search(text):
            text = text.translate(_MAP)
    return _WORD.findall(text.lower())


class Index:
    """Postings with impacts in blocks, each with its highest impact and lowest threshold."""

    def __init__(self, items: list[tuple[int, str]], stretch: int = STRETCH):
        bags = [(i, w) for i, t in items if len(w := words(t or "")) >= stretch]
        self.stretch = stretch
        n, mean = len(bags), sum(len(w) for _, w in bags) / max(1, len(bags))
        df = Counter(t for _, w in bags for t in set(w))
        self.postings: dict[str, list[tuple[int, float]]] = {}
        scored = []
        for i, w in bags:
            tf = Counter(w)
            norm = K1 * (1 - B + B * len(w) / mean)
            impact = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + norm) for t, f in tf.items()}
            spans = [w[k : k + stretch] for k in range(len(w) - stretch + 1)]
            least = min(sum(impact[t] for t in set(s)) for s in spans) - 1e-6
            scored.append((least, i, impact, frozenset(map(tuple, spans))))
        scored.sort(key=lambda x: (x[0], x[1]))  # neighbours have like thresholds
        self.least = [x[0] for x in scored]
        self.ids = [x[1] for x in scored]
        self.grams = [x[3] for x in scored]
        for at, (_, _, impact, _) in enumerate(scored):
            for t, x in impact.items():
                self.postings.setdefault(t, []).append((at, x))
        #: by term: (last item, highest impact) of each block
        self.blocks = {t: [(b[-1][0], max(x for _, x in b)) for k in range(0, len(p), BLOCK) if (b := p[k : k + BLOCK])] for t, p in self.postings.items()}
        # highest impact of each term in each range of items, and each range's floor
        width = max(1, -(-n // max(16, min(RANGES, TABLE // max(1, len(self.postings))))))
        self.starts = list(range(0, n, width))
        self.width = width
        self.floors = np.array([self.least[k] for k in self.starts])
        self.number = {t: k for k, t in enumerate(self.postings)}
        self.terms = list(self.postings)
        self.top = np.zeros((len(self.number) + 1, len(self.starts)), dtype=np.float32)
        for t, p in self.postings.items():
            row = self.top[self.number[t]]
            for at, x in p:
                row[at // width] = max(row[at // width], x)

    def search(self, ids: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """(row, items): of each row of terms (-1 for none) the items that score at least their threshold.

        The bounds of all rows and ranges are summed at once; the walk follows only where a
        bound reaches the floor.
        """
        ids = np.sort(ids, axis=1)
        ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1  # a term counts once
        bounds = self.top[ids].sum(axis=1) + 1e-4  # float32 sums; the last row of top is that of no term
        hits = bounds >= self.floors
        for row in np.flatnonzero(hits.any(axis=1)):
            rows = ids[row][ids[row] >= 0].tolist()
            terms = [self.terms[k] for k in rows]
            items: list[int] = []
            for r in np.flatnonzero(hits[row]):
                lo = self.starts[r]
                # the bound of a range of one item is its score
                items += [lo] if self.width == 1 else self._wand(terms, rows, lo, lo + self.width, r)
            if items:
                yield int(row), items

    def _wand(self, terms: list[str], rows: list[int], lo: int, hi: int, r: int) -> list[int]:
        """The items of one range that score at least their threshold.

        Block-max WAND: cursors in order of their item; the pivot is the first item at
        which the terms' highest impacts can add up to the floor; the blocks around the
        pivot are asked next, and only then is the item scored.
        """
        floor, cursors = float(self.floors[r]), []
        for t, row in zip(terms, rows):
            if self.top[row, r] > 0:
                p = self.postings[t]
                at = bisect_left(p, (lo, 0.0))
                cursors.append([p, self.blocks[t], at, at // BLOCK, float(self.top[row, r]), bisect_left(p, (hi, 0.0))])
        out = []
        while cursors:
            cursors.sort(key=lambda c: c[0][c[2]][0])
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += c[4]
                if bound >= floor:
                    pivot = k
                    break
            if pivot < 0:
                return out
            item = cursors[pivot][0][cursors[pivot][2]][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0][cursors[pivot + 1][2]][0] == item:
                pivot += 1
            bound, until = 0.0, None
            for c in cursors[: pivot + 1]:
                blocks, b = c[1], c[3]
                while b < len(blocks) and blocks[b][0] < item:
                    b += 1
                c[3] = b
                if b < len(blocks):
                    bound += blocks[b][1]
                    until = blocks[b][0] if until is None else min(until, blocks[b][0])
            if bound >= floor:
                score, goal = 0.0, item + 1
                for c in cursors[: pivot + 1]:
                    self._forward(c, item)
                    if c[2] < c[5] and c[0][c[2]][0] == item:
                        score += c[0][c[2]][1]
                if score >= self.least[item]:
                    out.append(item)
            else:
                goal = item + 1 if until is None else until + 1
                if pivot + 1 < len(cursors):
                    goal = max(item + 1, min(goal, cursors[pivot + 1][0][cursors[pivot + 1][2]][0]))
            for c in cursors[: pivot + 1]:
                self._forward(c, goal)
            cursors = [c for c in cursors if c[2] < c[5]]
        return out

    @staticmethod
    def _forward(c: list, item: int) -> None:
        postings, at, end = c[0], c[2], c[5]
        while at < end and postings[at][0] < item:
            at += 1
        c[2] = at

    def leaked(self, text: str, passage: int = PASSAGE) -> set[int]:
        """Ids of the items that share a stretch of words with the text.

        Every stretch lies whole in one of the passages, which overlap. A passage is a query
        where so many of its words in a row are indexed at all.
        """
        w = words(text)
        hits: set[int] = set()
        if len(w) < self.stretch or not self.ids:
            return hits
        number = self.number.get
        ids = np.array([number(x, -1) for x in w], dtype=np.int32)
        indexed = np.concatenate([[0], np.cumsum(ids >= 0)])
        starts = np.flatnonzero(indexed[self.stretch :] - indexed[: -self.stretch] == self.stretch)
        step = passage - self.stretch + 1
        places = np.unique(starts // step) * step
        padded = np.concatenate([ids, np.full(passage, -1, dtype=np.int32)])
        for at in range(0, len(places), ROWS):
            here = places[at : at + ROWS]
            for row, found in self.search(padded[here[:, None] + np.arange(passage)]):
                left = [i for i in found if self.ids[i] not in hits]
                if left:
                    part = w[here[row] : here[row] + passage]
                    spans = {tuple(part[j : j + self.stretch]) for j in range(len(part) - self.stretch + 1)}
                    hits.update(self.ids[i] for i in left if not spans.isdisjoint(self.grams[i]))
        return hits


def found(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", stretch: int = STRETCH) -> DataFrame:
    """(doc_id, item_id): documents that hold at least `stretch` successive words of an item.

    Whole texts are searched. Null, empty and shorter texts and items give no row; equal
    items are reported each, and so are equal documents; no items give an empty result.
    """
    known = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    passes = max(1, -(-known.count() // INDEX_ITEMS))
    out = None
    for k in range(passes):
        held = known.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k).collect()  # about INDEX_ITEMS
        shared = docs.sparkSession.sparkContext.broadcast(Index([(r.item_id, r.text) for r in held], stretch))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                ids, hits = [], []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for item in sorted(index.leaked(text)):
                        ids.append(doc)
                        hits.append(item)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hits, pa.int64())], names=["doc_id", "item_id"])

        part = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, item_id long")
        out = part if out is None else out.unionByName(part)
    return out.distinct()
