"""Sentence units across languages and scripts, by document-centred disambiguation.

A first pass looks at every short word before a period and counts, for each document and
for the whole corpus, the places where its role is beyond doubt: followed by a lower-case
word, a comma or a number it is an abbreviation there; at the very end of a text, or
standing without a period, it is an ordinary word. The doubtful places are then decided
by the document's own counts, where it has none by the corpus, and last by a short list.
An abbreviation that may end a sentence does not before a proper name, which is a word
that the text has with a capital inside a sentence and never without.
Scripts have their own terminators; Thai, which has none, divides at white space.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.session import cut

#: letters of the longest abbreviation; a longer word before a period is an ordinary one
LONGEST = 10

# Frequent abbreviations, used where neither document nor corpus has evidence.
KNOWN = frozenset(
    "dr mr mrs ms prof sr sra dra st jr fig figs eq eqs tab sec ref refs vol no nos pp ed eds al cf vs approx ca ch dept est inc ltd rev hon gen col sgt "
    "nr abb bzw vgl hrsg bd mio mrd núm pág págs aprox art cap mme mlle chap рис табл см стр тыс млн гг руб др डॉ श्री e.g i.e u.s u.k z.b d.h u.a p.ej p.ex т.е".split()
)
#: German words before which a number with a period is an ordinal
BEFORE_ORDINAL = frozenset("am zum vom im der den dem des das die bis beim ab seit jeder jeden".split())
MONTHS = frozenset("januar februar märz april mai juni juli august september oktober november dezember jänner".split())

_RUN = re.compile(r"[.!?…。！？｡．।॥؟۔]+")
_CLOSE = re.compile(
    r"(?:[\"”»’)\]}」』）】〕》]|''|[¹²³⁰-⁹]+|\[\d+(?:\s*[,;–-]\s*\d+)*\]|\(\d{1,3}(?:\s*[,;–-]\s*\d{1,3})*\)"
    r"|[~ ]?\\(?:cite[a-zA-Z]*|footnotemark|footnote|ref)\*?(?:\[[^\]\n]*\])*(?:\{[^{}]*\})|\\footnotemark(?![a-zA-Z])|<sup>[^<]{0,12}</sup>|</\w+>)+"
)
_MARK_AFTER_SPACE = re.compile(r" \[\d+(?:\s*[,;–-]\s*\d+)*\](?=\s|$|[.!?])")
_OPENERS = "\"“”«„‘'(¿¡[「『（{`<"
# a word and its chain, read backwards from a period
_BACKWARDS = re.compile(r"(?:[̀-ͯऀ-ःऺ-ॏ]*[^\W\d_])+(?:\.(?:[̀-ͯऀ-ःऺ-ॏ]*[^\W\d_])+)*")
_PERIOD = re.compile(r"(?<!\.)\.(?![.\w])|(?<!\.)\.(?=_)")
_WORD = re.compile(r"(?:[^\W\d_][̀-ͯऀ-ःऺ-ॏ]*)+")
_MIXED = re.compile(r"[a-z]{1,2}(?:[A-Z]|\d+\b)")
_PAIRS = {"“": "”", "«": "»", "„": "“”", "「": "」", "『": "』", "(": ")", "（": "）", "《": "》", "[": "]"}
_INSIDE = re.compile(r"(?<=[^\W\d_A-Z][ \n])([A-ZÀ-ÖØ-ÞĀ-ŽА-Я]\w+)")
_PARAGRAPH = re.compile(r"[ \t]*\r?\n[ \t]*\r?\n\s*")
_THAI = re.compile("[฀-๿]")
_QUOTES = set("”»“\"」』")


def spans(text: str) -> list[tuple[int, int]]:
    """(open, close) places of matching quotes and brackets; what has no partner is left out."""
    out, stack, straight = [], [], -1
    n = len(text)
    for i, c in enumerate(text):
        if c == '"':
            before = text[i - 1] if i else " "
            after = text[i + 1] if i + 1 < n else " "
            if straight >= 0 and not (before.isspace() and not after.isspace()):
                out.append((straight, i))
                straight = -1
            else:
                straight = i
        elif stack and c in _PAIRS[text[stack[-1]]]:
            out.append((stack.pop(), i))
        elif c in _PAIRS:
            stack.append(i)
        elif c in ")]」』）》»”" and len(stack) > 1 and c in _PAIRS[text[stack[-2]]]:
            stack.pop()
            out.append((stack.pop(), i))
    return out


def token_before(text: str, at: int) -> tuple[str, int]:
    """The word that ends at `at`, in lower case, and its start; chains such as 'т. д' are one."""
    m = _BACKWARDS.match(text[max(0, at - 40) : at][::-1])
    if not m:
        return "", at
    start = at - m.end()
    token = text[start:at]
    if "." in token and max(map(len, token.split("."))) > 2:  # two words without a space
        last = token.rpartition(".")[2]
        start, token = at - len(last), last
    while len(token.split(".")[0]) <= 2 and start >= 3 and text[start - 1].isspace() and text[start - 2] == ".":
        p = _BACKWARDS.match(text[max(0, start - 12) : start - 2][::-1])
        if not p or p.end() > 1 or token.count(".") > 3:
            break
        start, token = start - 2 - p.end(), f"{p.group()}.{token}"
    return token.lower(), start


def _first(text: str, at: int) -> tuple[str, int]:
    """The first character after openers from `at`, and its place; '' at the end."""
    while at < len(text) and text[at] in _OPENERS:
        at += 1
    return (text[at], at) if at < len(text) else ("", at)


def _chain(token: str) -> bool:
    return all(len(x) == 1 for x in token.split("."))


_BARE = re.compile(rf"(?<![^\s{re.escape(_OPENERS)}])(?:[^\W\d_][̀-ͯऀ-ःऺ-ॏ]*){{1,{LONGEST}}}(?=[ \n,;])")


def evidence(text: str) -> tuple[dict[str, list[int]], set[str], set[str]]:
    """What one text shows: token -> numbers of places as (abbreviation, end, doubtful); tokens asked for; bare words."""
    counts: dict[str, list[int]] = {}
    asked: set[str] = set()
    n = len(text)
    for m in _PERIOD.finditer(text):
        i = m.start()
        token, _ = token_before(text, i)
        if not token or max(map(len, token.split("."))) > LONGEST:
            continue
        if i + 1 < n and text[i + 1].isspace():
            asked.add(token)
        c = _CLOSE.match(text, i + 1)
        p = c.end() if c else i + 1
        while p < n and text[p].isspace():
            p += 1
        if p >= n:
            kind = 1
        elif c:
            continue
        elif text[p] in ",;:" or text[p].isdigit() or (text[p] == "(" and text[p + 1 : p + 2].isdigit()):
            kind = 0
        elif text[p].islower():
            if _MIXED.match(text, p):
                continue
            kind = 0
        else:
            kind = 2
        counts.setdefault(token, [0, 0, 0])[kind] += 1
    return counts, asked, set(_BARE.findall(text.lower()))


def role(token: str, doc: tuple | None, corpus: tuple | None) -> int:
    """0 an ordinary word, 1 an abbreviation, 2 an abbreviation that may end a sentence.

    doc and corpus: counts (a, e, d, b) of the token there.
    """
    a, e, d, b = corpus or (0, 0, 0, 0)
    if _chain(token):
        return 2 if e > 0 and e >= a else 1
    closing = e > 0 and e >= 0.1 * (a + e + d)
    if doc:
        da, de, _, db = doc
        if da and not de and not db:
            return 2 if closing else 1
        if (de or db) and not da:
            return 0
    if a and a >= 0.2 * (a + e):
        return 2 if closing else 1
    if not e and not b and d >= 3:
        return 1
    return 1 if token in KNOWN and not e else 0


def split(text: str, roles: dict[str, int]) -> list[tuple[int, int]]:
    """(start, end) of each sentence in code points, without surrounding white space."""
    n = len(text)
    cuts: list[int] = []
    pairs = spans(text)
    begin = 0  # of the sentence that is open

    def started() -> int:
        p = begin
        while p < n and text[p].isspace():
            p += 1
        return p

    def boundary(m: re.Match) -> int:
        """Where a sentence ends at this run of terminators, or -1."""
        i, j = m.span()
        run = m.group()
        c = _CLOSE.match(text, j)
        k = c.end() if c else j
        if any(o < i and e >= k for o, e in pairs):
            return -1
        if s := _MARK_AFTER_SPACE.match(text, k):
            if _RUN.match(text, s.end()):
                return -1  # the mark stands before the last terminator
            if not text[s.end() :].strip() or text[s.end() :].lstrip()[0].isupper():
                k = s.end()
        p = k
        while p < n and text[p].isspace():
            p += 1
        if p >= n:
            return k
        ch, q = _first(text, p)
        if not ch:
            return k
        spaced = p > k
        cased = ch.isupper() or ch.islower()
        # a quotation that opened inside the sentence does not end it, unless a capital follows
        if c and any(o > started() and i < e < k and text[e] in _QUOTES for o, e in pairs) and not (ch.isupper() and spaced) and not (ch.isdigit() and spaced):
            return -1
        if ch in ",;:、，；：":
            return -1
        if run[0] in "。！？｡．।॥؟۔":
            return k
        if run[0] in "!?":
            if ch.islower():
                return k if spaced and _MIXED.match(text, q) else -1
            return k if spaced or ch.isupper() or not cased and ch.isalpha() or text[p] in "¿¡" else -1
        dots = len(run) > 1 or run == "…"
        if ch.islower() and not _MIXED.match(text, q):
            return -1
        if not spaced:
            if dots and "…" in run:
                return k if not ch.isdigit() else -1
            if ch.isdigit() and (q == p or not c):
                return -1
            left, _ = token_before(text, i)
            if ch.islower() and not (len(left) >= 3 and "." not in left) and not c:
                return -1
            if not (cased or ch.isalpha()):
                return -1
            right = re.match(r"\S*", text[q:]).group()
            if re.search(r"\w\.\w|/|@", right) and not re.match(r"[A-Z]\.[A-Z]\.", right) or re.search(r"[/@]\S*$", text[max(0, i - 60) : i]) and not c:
                return -1
            if not c and left and (len(left) == 1 or "." in left):
                return -1
            return k
        if dots or c:
            token, _ = token_before(text, i)
            return k if dots or roles.get(token, 0) != 1 or ch.isupper() else -1
        if i and text[i - 1].isdigit():
            w = re.search(r"(?:^|[^\d.,\w])(\d+)$", text[max(0, i - 12) : i])
            if w:
                number_at = i - len(w[1])
                if len(w[1]) <= 3 and number_at == started():
                    return -1  # the number of a list item
                if len(w[1]) <= 2:
                    before = re.search(r"(\w+)\s+$", text[max(0, number_at - 20) : number_at])
                    after = _WORD.match(text, q)
                    if before and before[1].lower() in BEFORE_ORDINAL or after and after.group().lower() in MONTHS:
                        return -1
            return k
        token, at = token_before(text, i)
        if not token:
            return k
        kind = roles.get(token)
        if kind is None:
            kind = role(token, None, None)
        if kind == 1 or kind == 2 and (w := _WORD.match(text, q)) and w.group() in proper():
            return -1
        return k

    named: list[set[str]] = []

    def proper() -> set[str]:
        """Words with a capital inside a sentence, that never stand without one here."""
        if not named:
            inside = {m[1] for m in _INSIDE.finditer(text)}
            named.append({w for w in inside if not re.search(rf"(?<!\w){re.escape(w.lower())}(?!\w)", text)})
        return named[0]

    found = [(m.start(), m) for m in _RUN.finditer(text)]
    breaks = [(m.start(), m) for m in _PARAGRAPH.finditer(text)]
    if _THAI.search(text):
        for m in re.finditer(r"(?<=\S)\s+(?=\S)", text):
            left = re.search(r"\S+$", text[: m.start()]).group()
            right = re.match(r"\S+", text[m.end() :]).group()
            if _THAI.search(left) and _THAI.search(right):
                breaks.append((m.start(), m))
    for at, m in sorted(found + breaks, key=lambda x: x[0]):
        if at < begin:
            continue
        if m.re is _RUN:
            end = boundary(m)
        else:
            end = -1 if any(o < at < e for o, e in pairs) else at
        if end > begin:
            cuts.append(end)
            begin = end
    out, last = [], 0
    for end in [*cuts, n]:
        piece = text[last:end]
        lead = len(piece) - len(piece.lstrip())
        body = piece.strip()
        if body:
            out.append((last + lead, last + lead + len(body)))
        last = end
    return out


def role_of(token: str, doc: dict[str, str], corpus: dict[str, str]) -> Column:
    """role() as an expression over columns of counts."""
    c, d = ({k: F.coalesce(F.col(v), F.lit(0)) for k, v in x.items()} for x in (corpus, doc))
    closing = F.when((c["e"] > 0) & (c["e"] >= 0.1 * (c["a"] + c["e"] + c["d"])), 2).otherwise(1)
    return (
        F.when(F.col(token).rlike(r"^.(?:\..)*$"), F.when((c["e"] > 0) & (c["e"] >= c["a"]), 2).otherwise(1))
        .when((d["a"] > 0) & (d["e"] == 0) & (d["b"] == 0), closing)
        .when(((d["e"] > 0) | (d["b"] > 0)) & (d["a"] == 0), 0)
        .when((c["a"] > 0) & (c["a"] >= 0.2 * (c["a"] + c["e"])), closing)
        .when((c["e"] == 0) & (c["b"] == 0) & (c["d"] >= 3), 1)
        .when(F.col(token).isin(*KNOWN) & (c["e"] == 0), 1)
        .otherwise(0)
    )


def default_role(token: str) -> Column:
    """role() without any evidence."""
    return F.when(F.col(token).rlike(r"^.(?:\..)*$") | F.col(token).isin(*KNOWN), 1).otherwise(0)


_SEEN = "src string, row_id long, doc long, token string, word long, a int, e int, d int, b int"


def units(texts: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """(src, row_id, sent_no, start_pos, end_pos) of texts (src, row_id, doc, text).

    more: (doc, text) rows that serve as evidence only. Null, empty and blank texts give no
    row; a text without a terminator is one sentence; repeated rows are divided each.
    Positions are code points in the stored text.
    """
    wanted = texts.where(F.col("text").isNotNull()).select("src", "row_id", "doc", "text")
    every = wanted if more is None else wanted.unionByName(more.where(F.col("text").isNotNull()).select(F.lit(None).cast("string").alias("src"), F.lit(None).cast("long").alias("row_id"), "doc", "text"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One pass over the texts: what each asks for, and what the batch shows of each document."""
        for batch in batches:
            out: list[list] = [[] for _ in range(9)]
            seen: dict[tuple[int, str], list[int]] = {}
            bare: set[tuple[int, str]] = set()
            for src, row_id, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                counts, asked, words = evidence(text)
                for token, (a, e, d) in counts.items():
                    n = seen.setdefault((doc, token), [0, 0, 0])
                    n[0] += a
                    n[1] += e
                    n[2] += d
                bare.update((doc, w) for w in words)
                if src is not None:
                    for token in asked:
                        for column, value in zip(out, (src, row_id, doc, token, None, None, None, None, None)):
                            column.append(value)
            for (doc, token), n in seen.items():
                for column, value in zip(out, (None, None, doc, token, None, *n, int((doc, token) in bare))):
                    column.append(value)
            for doc, w in bare.difference(seen):
                for column, value in zip(out, (None, None, doc, w, None, 0, 0, 0, 1)):
                    column.append(value)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["src", "row_id", "doc", "token", "word", "a", "e", "d", "b"])

    seen = every.select("src", "row_id", F.xxhash64("doc").alias("doc"), "text").mapInArrow(look, _SEEN)
    seen = cut(seen.withColumn("word", F.xxhash64("token")))
    marks = seen.where("a IS NOT NULL")
    # of the bare words only those count that stand before a period somewhere
    doubtful = marks.where("a + e + d > 0").select("word").distinct()
    kept = marks.select("doc", "word", "a", "e", "d", "b").join(doubtful, "word", "left_semi")
    per_doc = cut(kept.groupBy("doc", "word").agg(*(F.sum(k).alias(k) for k in "aedb")))
    corpus = per_doc.groupBy("word").agg(*(F.sum(k).alias(f"all_{k}") for k in "aedb")).where("all_a + all_e + all_d > 0")
    asked = seen.where("src IS NOT NULL").select("src", "row_id", "doc", "token", "word")
    both = asked.join(per_doc, ["doc", "word"], "left").join(corpus, "word", "left")
    decided = both.select("src", "row_id", "token", role_of("token", {k: k for k in "aedb"}, {k: f"all_{k}" for k in "aedb"}).alias("kind"), default_role("token").alias("usual"))
    verdicts = decided.where("kind <> usual").groupBy("src", "row_id").agg(F.collect_set(F.struct("token", "kind")).alias("roles"))
    joined = wanted.select("src", "row_id", "text").join(verdicts, ["src", "row_id"], "left")

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for src, row_id, text, roles in zip(*(c.to_pylist() for c in batch.columns)):
                known = {r["token"]: r["kind"] for r in roles or ()}
                for no, (start, end) in enumerate(split(text, known), 1):
                    for column, value in zip(out, (src, row_id, no, start, end)):
                        column.append(value)
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["src", "row_id", "sent_no", "start_pos", "end_pos"])

    return joined.select("src", "row_id", "text", "roles").mapInArrow(cut_up, "src string, row_id long, sent_no int, start_pos int, end_pos int")


def found(scan: DataFrame, nli: DataFrame) -> DataFrame:
    """(src, row_id, sent_no, start_pos, end_pos) of all passages and premises.

    Sentences of scans, which are sentence-long already, serve as evidence only.
    """
    of_scan = scan.select(F.lit("scan_sentences").alias("src"), F.col("sentence_id").alias("row_id"), F.coalesce("pdf_sha256", F.lit("")).alias("doc"), "text", "slice_kind")
    of_nli = nli.select(F.lit("nli_results").alias("src"), F.col("result_id").alias("row_id"), F.concat(F.lit("nli:"), F.coalesce(F.col("ref_id").cast("string"), F.lit(""))).alias("doc"), F.col("premise").alias("text"), F.lit("passage").alias("slice_kind"))
    both = of_scan.unionByName(of_nli)
    passage = F.coalesce(F.col("slice_kind") == "passage", F.lit(False))
    return units(both.where(passage), both.where(~passage))
