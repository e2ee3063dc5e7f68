"""Markup residue in texts: HTML, JATS, Markdown, wiki and LaTeX, by a recurrent labeller.

A scanner cuts a text into leaves: whatever might be markup in any of the five notations,
and the prose between. Each leaf has a tag path, its words and its surroundings. A
bidirectional LSTM in numpy reads the whole sequence of leaves and labels every one, so
that what a sign means is decided with the rest of the document in view: ``# x`` is a
heading beside Markdown and a list item beside wiki text, ``$5 to $9`` is prose. The
network is trained by markup_training.py on texts made there; its weights lie beside it.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROSE, MARKUP, HEADING, LIST, CODE, FORMULA = range(6)
ELEMENTS = {HEADING: "heading", LIST: "list_item", CODE: "code", FORMULA: "formula"}
WEIGHTS = Path(__file__).with_name("markup_weights.npz")
PATH_DIM, WORD_DIM, SHAPE_DIM = 64, 32, 16
FEATURES = PATH_DIM + WORD_DIM + SHAPE_DIM
#: a text without any of these signs holds no markup; prose of any length is skipped at once
SUSPECT = r"""[<>&\\{}$*#`=_|~^]|''|\]\(|\]\[|(?m:^\s*(?:[-+•]|\d{1,3}[.)])\s)|(?m:^-{3,}\s*$)"""

_GROUP = r"\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\}"
_TOKEN = re.compile(
    rf"""
  (?P<comment><!--.*?-->)
 |(?P<pre><(?P<pre_>pre|syntaxhighlight|source|(?:jats:)?preformat|(?:jats:)?code)\b[^<>]*>.*?</(?P=pre_)\s*>)
 |(?P<math><(?P<math_>math|mml:math|(?:jats:)?(?:inline|disp)-formula|(?:jats:)?tex-math)\b[^<>]*>.*?</(?P=math_)\s*>)
 |(?P<tag></?[A-Za-z][\w:.-]*(?:\s[^<>]*)?/?>)
 |(?P<entity>&(?:\#\d+|\#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]{{1,20}});)
 |(?P<fence>^(?P<fence_>```|~~~)[^\n]*\n.*?^(?P=fence_)[ \t]*$)
 |(?P<env>\\begin\{{(?P<env_>verbatim|lstlisting|minted|equation|align|gather|multline|eqnarray|displaymath|math)(?P<star_>\*?)\}}.*?\\end\{{(?P=env_)(?P=star_)\}})
 |(?P<bracket>\\\[.*?\\\]|\\\(.*?\\\))
 |(?P<double>\$\$.+?\$\$)
 |(?P<dollar>(?<![\\$])\$(?![\s$])(?:[^$\n\\]|\\.)*?[^\s$\\]\$(?!\d)|(?<![\\$])\$[^\s$\\]\$(?!\d))
 |(?P<ensure>\\ensuremath\s*{_GROUP})
 |(?P<section>\\(?:part|chapter|(?:sub){{0,2}}section|(?:sub)?paragraph)\*?\s*(?:\[[^\]]*\])?\s*{_GROUP})
 |(?P<item>\\item\b(?:\[[^\]\n]*\])?)
 |(?P<edge>\\(?:begin|end)\s*\{{\w+\*?\}})
 |(?P<command>\\[a-zA-Z]+\*?)
 |(?P<escape>\\[^\sa-zA-Z0-9])
 |(?P<setext>^[^\n]*\S[^\n]*\n(?:={{3,}}|-{{3,}})[ \t]*$)
 |(?P<equals>^={{1,6}}[^=\n]+={{1,6}}[ \t]*$)
 |(?P<hashes>^\#{{1,6}}[:*]?[ \t]+\S[^\n]*$)
 |(?P<bullet>^[ \t]*(?:\*{{1,4}}|[-+•])[ \t]+(?=\S))
 |(?P<number>^[ \t]*\d{{1,3}}[.)][ \t]+(?=\S))
 |(?P<wikilink>\[\[[^\[\]\n]+\]\])
 |(?P<template>\{{\{{[A-Za-z][^{{}}\n]*\|[^{{}}\n]*\}}\}})
 |(?P<link>!?\[[^\[\]\n]*\](?:\([^()\s]*\)|\[[^\[\]\n]*\]))
 |(?P<quotes>``(?!`)(?:(?!``)[^\n])+?'')
 |(?P<tick>`[^`\n]+`)
 |(?P<apostrophes>(?<!\w)'{{2,5}}(?=[^\s'])(?:(?!'')[^\n])+?'{{2,5}})
 |(?P<stars>(?<![\w*])(?P<stars_>\*{{1,3}})(?=[^\s*])(?:(?!\*)[^\n])*?[^\s*](?P=stars_)(?![\w*]))
 |(?P<under>(?<![\w])(?P<under_>_{{1,3}})(?=[^\s_])(?:(?!_)[^\n])*?[^\s_](?P=under_)(?!\w))
 |(?P<strike>~~(?=\S)[^\n]+?~~)
 |(?P<tie>~)
 |(?P<brace>\{{)
""",
    re.X | re.S | re.M | re.I,
)
_ESCAPED_TAG = re.compile(r"&(?:amp;)*lt;\s*/?[A-Za-z][^<>]*?&(?:amp;)*gt;|&lt;!--", re.S)
_WORD = re.compile(r"\w+")
_NAME = re.compile(r"</?\s*(?:jats:|mml:)?([A-Za-z][\w.-]*)", re.I)
_ENV = re.compile(r"\{(\w+)")


class Leaf(NamedTuple):
    kind: str
    name: str
    parent: str
    start: int
    end: int


def unescaped(text: str) -> str:
    """The text with tags that were delivered in escaped form as tags again."""
    for _ in range(2):
        if "&" not in text or not _ESCAPED_TAG.search(text):
            return text
        text = html.unescape(text.replace("&amp;lt;", "&lt;").replace("&amp;gt;", "&gt;"))
    return text


def leaves(text: str) -> list[Leaf]:
    """All leaves in text order: candidates for markup and the prose between them."""
    out: list[Leaf] = []
    stack: list[str] = []
    last = 0
    for m in _TOKEN.finditer(text):
        start, end = m.span()
        kind = m.lastgroup or ""
        if kind.endswith("_"):
            kind = next(k for k, v in m.groupdict().items() if v is not None and not k.endswith("_"))
        if start > last and not text[last:start].isspace():
            out.append(Leaf("text", "", stack[-1] if stack else "", last, start))
        name, parent = "", stack[-1] if stack else ""
        if kind in ("tag", "pre", "math"):
            name = _NAME.match(m.group()).group(1).lower()
            if kind == "tag":
                if m.group()[1] == "/":
                    if name in stack:
                        del stack[len(stack) - 1 - stack[::-1].index(name) :]
                    name = "/" + name
                elif not m.group().endswith("/>") and name not in ("br", "p", "li", "hr", "img"):
                    stack.append(name)
        elif kind in ("env", "edge"):
            name = _ENV.search(m.group()).group(1).lower()
        elif kind == "command":
            name = m.group()[1:].rstrip("*").lower()
        elif kind == "bullet":
            name = m.group().strip()[:2]
        elif kind == "hashes":
            name = str(len(m.group()) - len(m.group().lstrip("#")))
        elif kind == "stars":
            name = str(len(m["stars_"]))
        out.append(Leaf(kind, name, parent, start, end))
        last = end
    if last < len(text) and not text[last:].isspace():
        out.append(Leaf("text", "", stack[-1] if stack else "", last, len(text)))
    return out


_hashes: dict[str, tuple[int, float]] = {}


def _hash(key: str) -> tuple[int, float]:
    got = _hashes.get(key)
    if got is None:
        h = zlib.crc32(key.encode())
        if len(_hashes) > 200_000:
            _hashes.clear()
        got = _hashes[key] = (h >> 1, 1.0 if h & 1 else -1.0)
    return got


def vectors(text: str, seq: list[Leaf]) -> np.ndarray:
    """One row of features per leaf: hashed tag path, hashed words, shape."""
    x = np.zeros((len(seq), FEATURES), dtype=np.float32)
    n = len(text)
    for row, (kind, name, parent, start, end) in zip(x, seq):
        for key in (f"k:{kind}", f"n:{kind}:{name}", f"p:{parent}"):
            h, s = _hash(key)
            row[h % PATH_DIM] += s
        body = text[start:end]
        words = _WORD.findall(body)
        share = 0.3 * min(1.0, 8 / max(1, len(words)))  # long leaves weigh no more than short ones
        for w in words:
            h, s = _hash("w:" + w.lower())
            row[PATH_DIM + h % WORD_DIM] += share * s
        shape = row[PATH_DIM + WORD_DIM :]
        size = end - start
        shape[0] = min(size, 60) / 60
        shape[1] = min(len(words), 12) / 12
        shape[2] = "\n" in body.strip()
        if kind != "text":
            before = text[start - 1] if start else "\n"
            after = text[end] if end < n else "\n"
            shape[3] = before == "\n"
            shape[4] = before.isalnum()
            shape[5] = before.isspace()
            shape[6] = after == "\n"
            shape[7] = after.isalnum()
            shape[8] = after.isspace()
            shape[9] = "\\" in body[1:]
            shape[10] = any(c in body[1:-1] for c in "^_=+")
            inner = body.strip("$*_{}[] ")
            shape[11] = inner[:1].isdigit()
            shape[12] = bool(words) and all(w.isdigit() for w in words)
            follow = text[end : end + 24].lstrip()
            shape[13] = follow[:1].isdigit()
            shape[14] = kind == "brace" and bool(re.match(r"[\d\s.,;]+\}", text[end : end + 60]))
            shape[15] = "," in body
    return x


class Labeller:
    """A bidirectional LSTM with one hidden layer each way and a softmax on top."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = {k: np.asarray(v, dtype=np.float32) for k, v in weights.items()}

    @classmethod
    def load(cls, path: Path = WEIGHTS) -> Labeller:
        with np.load(path) as f:
            return cls(dict(f))

    def _run(self, x: np.ndarray, mask: np.ndarray, side: str) -> np.ndarray:
        wx, wh, b = (self.w[f"{side}_{k}"] for k in ("wx", "wh", "b"))
        n, t, _ = x.shape
        size = wh.shape[0]
        z_all = x @ wx + b
        h = c = np.zeros((n, size), dtype=np.float32)
        out = np.zeros((n, t, size), dtype=np.float32)
        for k in range(t) if side == "f" else range(t - 1, -1, -1):
            z = z_all[:, k] + h @ wh
            gates = 1 / (1 + np.exp(-z[:, : 3 * size]))
            i, f, o = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :]
            m = mask[:, k, None]
            c = np.where(m, f * c + i * np.tanh(z[:, 3 * size :]), c)
            h = np.where(m, o * np.tanh(c), h)
            out[:, k] = h
        return out

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        h = np.concatenate([self._run(x, mask, "f"), self._run(x, mask, "b"), x], axis=2)
        return h @ self.w["out_w"] + self.w["out_b"]

    def label(self, sequences: list[np.ndarray], room: int = 6000) -> list[np.ndarray]:
        """The label of each leaf of each sequence; sequences of like length run together."""
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(sequences)
        order = sorted(range(len(sequences)), key=lambda k: len(sequences[k]))
        at = 0
        while at < len(order):
            # how many of the following sequences, padded to the longest, fit the room
            end, longest = at, 1
            while end < len(order) and max(longest, len(sequences[order[end]])) * (end - at + 1) <= max(room, len(sequences[order[end]])):
                longest = max(longest, len(sequences[order[end]]))
                end += 1
            group = order[at:end]
            x = np.zeros((len(group), longest, FEATURES), dtype=np.float32)
            mask = np.zeros((len(group), longest), dtype=bool)
            for k, g in enumerate(group):
                x[k, : len(sequences[g])] = sequences[g]
                mask[k, : len(sequences[g])] = True
            best = self.scores(x, mask).argmax(2)
            for k, g in enumerate(group):
                out[g] = best[k, : len(sequences[g])]
            at = end
        return out


def render(text: str, seq: list[Leaf], labels: np.ndarray) -> str:
    """Clean text: headings, list items, code and formulas kept in one plain notation."""
    out: list[str] = []
    drop: list[bool] = []  # for each open brace, whether its partner is markup
    last = 0
    for leaf, label in zip(seq, labels):
        out.append(text[last : leaf.start])  # white space alone is no leaf
        last = leaf.end
        body = text[leaf.start : leaf.end]
        kind, name = leaf.kind, leaf.name
        if kind == "brace":
            drop.append(label != PROSE)
            out.append("" if label != PROSE else "{")
        elif label == PROSE or kind == "text":
            for piece in re.split(r"([{}])", body):
                if piece == "{":
                    drop.append(False)
                elif piece == "}" and drop and drop.pop():
                    continue
                out.append(piece)
        elif label == HEADING:
            title = re.sub(r"^\\\w+\*?\s*(?:\[[^\]]*\])?\s*\{(.*)\}$", r"\1", body.strip(), flags=re.S) if kind == "section" else body.split("\n")[0].strip("=# \t") if kind != "tag" else ""
            out.append(f"\n\n# {title}" + "\n\n" * (kind != "tag"))
        elif label == LIST:
            above = next((x for x in reversed(out) if x), "\n")
            out.append(("" if above.endswith("\n") else "\n") + "- " + (body.lstrip("#*: ") if kind == "hashes" else ""))
        elif label == CODE:
            inner = re.sub(r"^(?:<[^>]*>\s*)+|(?:\s*</[^>]*>)+$|^```[^\n]*\n|\n?```\s*$|^\\begin\{[^}]*\}\n?|\n?\\end\{[^}]*\}$", "", body)
            out.append(f"\n\n```\n{html.unescape(inner)}\n```\n\n")
        elif label == FORMULA:
            inner = re.sub(r"<[^>]*>|^\$+|\$+$|^\\[\[(]|\\[\])]$|^\\begin\{[^}]*\}|\\end\{[^}]*\}$", "", body)
            inner = re.sub(r"^\\ensuremath\s*\{(.*)\}$", r"\1", inner, flags=re.S)
            out.append(f"${html.unescape(inner).strip()}$")
        elif kind == "entity":
            out.append(html.unescape(body))
        elif kind == "tag":
            out.append("\n\n" if name.strip("/") in ("p", "div", "sec", "title", "list", "ul", "ol") or re.match(r"/h[1-6]$", name) else "\n" if name in ("br", "/li", "/list-item") else "")
        elif kind == "wikilink":
            out.append(body[2:-2].rpartition("|")[2])
        elif kind == "link":
            out.append(re.match(r"!?\[([^\[\]]*)\]", body).group(1))
        elif kind == "escape":
            out.append(" " if body[1] in ",;:! " else body[1] if body[1] in "%$&_#{}~^-" else "")
        elif kind == "tie":
            out.append(" ")
        elif kind in ("stars", "under", "strike", "apostrophes", "tick", "quotes"):
            inner = body.strip("*_~`'")
            out.append(f'"{inner}"' if kind == "quotes" else inner)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]{2,}", " ", re.sub(r"[ \t]+\n", "\n", "".join(out)))).strip()


def _texts(raw: DataFrame, refs: DataFrame, scan: DataFrame) -> DataFrame:
    message = F.get_json_object("body", "$.message")
    # a message delivered as a string holds the object in turn
    abstract = F.coalesce(F.get_json_object("body", "$.message.abstract"), F.get_json_object(message, "$.abstract"))
    a = raw.where(F.col("body").contains("abstract")).select(F.lit("crossref_raw").alias("src"), F.col("raw_id").alias("row_id"), F.when(F.try_parse_json("body").isNotNull(), abstract).alias("text"))
    b = refs.select(F.lit("bib_references").alias("src"), F.col("ref_id").alias("row_id"), F.col("title_raw").alias("text"))
    c = scan.select(F.lit("scan_sentences").alias("src"), F.col("sentence_id").alias("row_id"), "text")
    return a.unionByName(b).unionByName(c).where(F.col("text").isNotNull())


def _labelled(batch: pa.RecordBatch, model: Labeller) -> Iterator[tuple[str, int, str, list[Leaf], np.ndarray]]:
    rows = list(zip(*(c.to_pylist() for c in batch.columns)))
    for at in range(0, len(rows), 2000):
        part = rows[at : at + 2000]
        texts = [unescaped(t) for _, _, t in part]
        seqs = [leaves(t) for t in texts]
        labels = model.label([vectors(t, s) for t, s in zip(texts, seqs)])
        for (src, row_id, _), t, s, y in zip(part, texts, seqs, labels):
            yield src, row_id, t, s, y


def elements(texts: DataFrame) -> DataFrame:
    """(src, row_id, element, element_no) of texts (src, row_id, text).

    A row ('markup', 0) for each text that holds any, and one for each heading, list item,
    code block and formula, numbered within its kind. Null, empty and plain texts give no
    row; repeated texts give theirs each.
    """
    model = texts.sparkSession.sparkContext.broadcast(Labeller.load())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for src, row_id, _, seq, labels in _labelled(batch, model.value):
                rows, count = [], {}
                for leaf, y in zip(seq, labels.tolist()):
                    if leaf.kind == "text" or y == PROSE:
                        continue
                    if not rows:
                        rows.append(("markup", 0))
                    if y in ELEMENTS:
                        count[y] = count.get(y, 0) + 1
                        rows.append((ELEMENTS[y], count[y]))
                for element, no in rows:
                    for column, value in zip(out, (src, row_id, element, no)):
                        column.append(value)
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["src", "row_id", "element", "element_no"])

    return texts.where(F.col("text").rlike(SUSPECT)).select("src", "row_id", "text").mapInArrow(run, "src string, row_id long, element string, element_no int")


def clean(texts: DataFrame) -> DataFrame:
    """(src, row_id, clean) of texts (src, row_id, text); plain texts come out unchanged."""
    model = texts.sparkSession.sparkContext.broadcast(Labeller.load())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(src, row_id, t if not any(y != PROSE and x.kind != "text" for x, y in zip(seq, labels)) else render(t, seq, labels)) for src, row_id, t, seq, labels in _labelled(batch, model.value)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["src", "row_id", "clean"])

    held = F.col("text").rlike(SUSPECT)
    known = texts.where(F.col("text").isNotNull())
    plain = known.where(~held).select("src", "row_id", F.col("text").alias("clean"))
    return plain.unionByName(known.where(held).select("src", "row_id", "text").mapInArrow(run, "src string, row_id long, clean string"))


def found(raw: DataFrame, refs: DataFrame, scan: DataFrame) -> DataFrame:
    """(src, row_id, element, element_no) over abstracts, raw titles and scanned sentences."""
    return elements(_texts(raw, refs, scan))


def clean_texts(raw: DataFrame, refs: DataFrame, scan: DataFrame) -> DataFrame:
    """(src, row_id, clean) over abstracts, raw titles and scanned sentences."""
    return clean(_texts(raw, refs, scan))
