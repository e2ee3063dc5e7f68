"""Variant spellings of names: weighted n-gram vectors, sparse cosine joins, average linkage.

Spellings that read alike (case, accents, TeX, order of the parts) are one form. A form has
a vector of character n-grams weighted by rarity, hashed into a table of fixed length.
The join runs on the rarest part of the vectors, the grams with one letter left out: any two
surnames that are one slip apart share one, so the candidates are complete without a cap.
They are joined among the different surnames first, and forms then meet under a surname (or
one a slip away) and a mark of the given name: two full ones under the name with a letter
left out, others under an initial. Organisations meet under a word, or one with a letter
left out, and the initials of the others. Pairs whose parts contradict each other
get no link; the others have the mean of their cosine and the agreement of their parts.

Each form's best links lead the search for connected groups, what else there is only
joins groups that are still apart. Forms with a full given name are clustered by average
linkage within their group, groups of any size by rounds of mutually nearest clusters.
Initials join a cluster only where it is the one that fits, and bare surnames, which have
no initials, the one entity that has the surname, or else one a slip away.
"""

from __future__ import annotations

import heapq
import math
import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.llm.slips import gapped, near, plain, slips
from citeloom.session import cut, drop

GRAM = 3  # characters of an n-gram
BUCKETS = 1 << 16  # n-grams are hashed into so many, which bounds the table of their weights
COMMON = 8  # an n-gram weighs no more than one of so many forms, for slips make rare ones
TOP = 8  # best links of a form that lead the search for connected groups
MERGE = 0.5  # clusters merge while their average likeness is at least this
ALONE = 2_000  # links of a group that one task clusters; larger groups are clustered in rounds

# Short forms of given names.
NICKNAMES = {
    "joe": "joseph", "joey": "joseph", "jo": "joseph", "nick": "nicholas", "nicky": "nicholas", "rob": "robert", "bob": "robert", "bobby": "robert", "robbie": "robert", "bert": "robert",
    "sam": "samuel", "sammy": "samuel", "fred": "frederik", "freddy": "frederik", "fritz": "frederik", "frederick": "frederik", "friedrich": "frederik", "dima": "dmitri", "mitya": "dmitri", "vanya": "ivan",
    "ted": "theodore", "theo": "theodore", "teddy": "theodore", "ed": "edward", "eddie": "edward", "ned": "edward", "liz": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "lisa": "elizabeth", "eliza": "elizabeth", "lizzie": "elizabeth",
    "mike": "michael", "mick": "michael", "misha": "mikhail", "kate": "katherine", "kathy": "katherine", "cathy": "katherine", "katie": "katherine", "katya": "ekaterina", "maggie": "margaret", "meg": "margaret", "peggy": "margaret", "greta": "margaret", "gosia": "malgorzata", "leo": "leonardo",
    "greg": "gregory", "dan": "daniel", "danny": "daniel", "dave": "david", "tom": "thomas", "tommy": "thomas", "tomek": "tomasz", "will": "william", "bill": "william", "billy": "william", "jim": "james", "jimmy": "james", "jack": "john", "johnny": "john",
    "alex": "alexander", "sasha": "alexander", "sandy": "alexander", "al": "albert", "andy": "andrew", "tony": "anthony", "ben": "benedikt", "chris": "christopher", "val": "valentina", "valya": "valentina", "vicky": "victoria", "vika": "victoria", "tori": "victoria", "sue": "susanna", "susan": "susanna", "susie": "susanna", "zanna": "susanna",
    "nadya": "nadia", "nadezhda": "nadia", "pepe": "jose", "paco": "francisco", "gianni": "giovanni", "beppe": "giuseppe", "peppe": "giuseppe", "lukasz": "lukasz", "luke": "lukasz", "steve": "stephen", "pat": "patricia", "trish": "patricia", "tricia": "patricia", "jen": "jennifer", "jenny": "jennifer", "becky": "rebecca", "debbie": "deborah", "gabi": "gabriele", "hans": "johannes", "klaus": "nikolaus", "seb": "sebastian", "manu": "manuel", "max": "maximilian", "matt": "matthew", "phil": "philip", "rick": "richard", "dick": "richard", "ron": "ronald", "tim": "timothy", "vera": "veronika", "zosia": "zofia", "kasia": "katarzyna", "asia": "joanna", "ola": "aleksandra", "olek": "aleksander", "kolya": "nikolai", "volodya": "vladimir", "vova": "vladimir", "seryozha": "sergei", "lyosha": "alexei", "alyosha": "alexei", "natasha": "natalia", "tanya": "tatiana", "masha": "maria", "anya": "anna", "lena": "elena", "olya": "olga", "yura": "yuri", "petya": "pyotr",
}
# Short forms that stand for further names.
ALSO = {
    "ted": "edward", "kate": "ekaterina", "katya": "katherine", "mike": "mikhail", "misha": "michael", "nick": "nikolai", "nicky": "nicola", "al": "alexander", "alex": "alexei", "sasha": "aleksandra", "uschi": "ursula", "ulla": "ursula", "ursel": "ursula", "lena": "helena",
    "leo": "leonard", "max": "maxim", "dan": "daniela", "sam": "samantha", "chris": "christina", "pat": "patrick", "val": "valerie", "theo": "theodor", "fred": "alfred", "bert": "albert", "ed": "edmund", "liz": "elisabeth", "lisa": "elisabeth", "hans": "johann", "meg": "megan", "will": "wilhelm", "tom": "tomas", "nadya": "nadezhda", "gosia": "malgosia", "zeyno": "zeynep", "wandzia": "wanda",
}
#: words that make a name an organisation's, in full
BODIES = frozenset(
    "university department institute centre center consortium society association committee council group collaboration network laboratory agency office ministry foundation alliance initiative team project board school college faculty library hospital academy bureau commission union".split()
)
SHORT_BODIES = frozenset("univ uni dept dpt inst ctr cent consort consrt soc assoc comm coun coll collab lab labs found fdn min div dep grp netw".split())
SMALL = frozenset("of for the and on in de la du des der fur und von at &".split())
PARTICLES = frozenset("von van de der den del della di da dos du la le al el bin ibn ter ten zu zum af av".split())

_ACCENT = re.compile(r"\{?\\(?P<a>['`^\"~=.uvHcdrk])\s*\{?\\?(?P<l>[A-Za-z])\}?\}?")
_COMBINING = dict(zip("'`^\"~=.uvHcdrk", "̧̨̣́̀̂̈̃̄̇̆̌̋̊"))
_TEX_LETTERS = {"\\l": "ł", "\\L": "Ł", "\\o": "ø", "\\O": "Ø", "\\ss": "ß", "\\ae": "æ", "\\aa": "å", "\\i": "i", "\\j": "j"}
_PLAIN = str.maketrans({"ł": "l", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "’": "'"})
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")


def untex(name: str) -> str:
    """LaTeX accents as letters; braces dropped."""
    if "\\" in name:
        name = _ACCENT.sub(lambda m: unicodedata.normalize("NFC", m["l"] + _COMBINING[m["a"]]), name)
        for k, v in _TEX_LETTERS.items():
            name = re.sub(re.escape("{" + k + "}") + "|" + re.escape(k) + r"(?![A-Za-z])\s*", v, name)
    return re.sub(r"[{}]", "", name)


def fold(text: str) -> str:
    """Lower case without accents."""
    if text.isascii():
        return text.lower()
    low = unicodedata.normalize("NFKD", text.casefold().translate(_PLAIN))
    return "".join(c for c in low if not unicodedata.combining(c))


def word_grams(word: str) -> list[str]:
    """n-grams of a padded word; a short word is one."""
    w = f"^{word}$"
    return [w[k : k + GRAM] for k in range(max(1, len(w) - GRAM + 1))]


def formal(given: str) -> set[str]:
    """A given name and the names it is short for."""
    return {given, NICKNAMES.get(given, given), ALSO.get(given, given)}


class Name:
    """The parts of one spelling: an organisation's words, or ways to read a person's name."""

    __slots__ = ("acronym", "body", "org", "readings", "spelling", "vector")

    def __init__(self, spelling: str):
        self.spelling = spelling
        text = untex(spelling).strip()
        words = _WORD.findall(fold(text))
        self.vector: dict[int, float] | None = None
        body = any(w in BODIES or w in SHORT_BODIES for w in words)
        self.org = body and len(words) >= 3 or (spelling.strip().startswith("{") and spelling.strip().endswith("}") and len(words) >= 3 and "\\" not in spelling)
        self.body = [w for w in words if w not in SMALL]
        caps = _WORD.findall(text)
        self.acronym = next((fold(w) for w in caps if 2 <= len(w) <= 6 and w.isupper()), "") if not all(w.isupper() for w in caps) else ""
        self.readings: list[tuple[str, tuple[str, ...]]] = []
        if not self.org:
            self._read(text)

    def _read(self, text: str) -> None:
        """(surname, given parts) in every way the spelling can be read; initials are one letter."""
        if "," in text:
            before, _, after = text.partition(",")
            surname = " ".join(_WORD.findall(fold(before)))
            self.readings.append((surname, self._given(after)))
            return
        raw = [w for w in re.split(r"[\s.]+|(?<=\.)", re.sub(r"(?<=[^\W\d_])\.(?=[^\W\d_]{2})", ". ", text)) if w]
        tokens = [(fold(w), w) for w in raw if _WORD.search(w)]
        if not tokens:
            return
        if len(tokens) == 1:
            self.readings.append((tokens[0][0], ()))
            return
        low = [t for t, _ in tokens]
        last = tokens[-1][1]
        if re.fullmatch(r"[^\W\d_](?:-?[^\W\d_]){0,3}", last) and last.isupper() and len(tokens[0][0]) > 1 and not all(w.isupper() for _, w in tokens[:-1]):
            self.readings.append((" ".join(low[:-1]), tuple(fold(last).replace("-", ""))))  # 'Surname GM'
            return
        k = len(low) - 1
        while k > 1 and low[k - 1] in PARTICLES:
            k -= 1
        if low[0] in PARTICLES and all(w in PARTICLES for w in low[:-1]):
            self.readings.append((" ".join(low), ()))  # a bare surname with its particle
            return
        self.readings.append((" ".join(low[k:]), self._given(" ".join(w for _, w in tokens[:k]))))
        n = 1
        while n < len(low) - 1 and low[n - 1] in PARTICLES:
            n += 1
        if len(low[0]) > 1 and n < len(low):
            self.readings.append((" ".join(low[:n]), self._given(" ".join(w for _, w in tokens[n:]))))

    @staticmethod
    def _given(text: str) -> tuple[str, ...]:
        out: list[str] = []
        for w in _WORD.findall(text):
            f = fold(w)
            if len(w) in (2, 3) and w.isupper() and len(_WORD.findall(text)) == 1 and not re.search("[aeiou]", f[1:]):
                out.extend(f)
            else:
                out.append(f)
        return tuple(out)

    @property
    def full(self) -> bool:
        """Whether some reading has a full given name."""
        return self.org or any(g and len(g[0]) > 1 for _, g in self.readings)

    @property
    def bare(self) -> bool:
        return not self.org and all(not g for _, g in self.readings)

    @property
    def form(self) -> str:
        """What the comparison sees: spellings of one form are alike to the same names."""
        if self.org:
            return f"o:{' '.join(sorted(self.body))}|{self.acronym}"
        read = sorted({f"{s}, {' '.join(g)}" for s, g in self.readings if g or self.bare})
        return f"p:{' / '.join(read)}|{' '.join(sorted(self.body))}|{self.acronym if len(self.body) > 1 else ''}"

    def grams(self) -> list[str]:
        """The n-grams of the words; an initial is a short word."""
        if self.org or not self.readings:
            words = self.body
        else:
            surname, given = self.readings[0]
            words = [*surname.split(), *given]
        return [g for w in words for g in word_grams(w)]


def given_alike(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    """How well the given names agree; 0 where they contradict each other."""
    if not a or not b:
        return 0.5
    score = 1.0
    for k, (x, y) in enumerate(zip(a, b)):
        if len(x) > 1 and len(y) > 1:
            if x == y or formal(x) & formal(y) or plain(x) == plain(y):
                continue
            if max(len(x), len(y)) >= 3 and (min(len(x), len(y)) >= 3 or x[0] == y[0]) and any(near(v, w) or near(plain(v), plain(w)) for v in formal(x) for w in formal(y) if min(len(v), len(w)) > 2 or v[0] == w[0]):
                score -= 0.1
                continue
            if min(len(x), len(y)) >= 3 and abs(len(x) - len(y)) > 1 and (x.startswith(y) or y.startswith(x)):
                score -= 0.15  # 'Raj' and 'Rajesh'
                continue
            joined = ["".join(w for w in g if len(w) > 1) for g in (a, b)]
            if k == 0 and len(joined[0]) > 4 and near(*joined):
                return 0.85  # 'Li-Wei' and 'Liwei'
            return 0.0
        if x[0] != y[0] and not (len(x) > 1 or len(y) > 1) or not {w[0] for w in formal(x)} & {w[0] for w in formal(y)}:
            return 0.0
        score -= 0.15 if k == 0 and (len(x) > 1 or len(y) > 1) else 0.03
    return score - 0.05 * (len(a) != len(b))


def _short_for(a: str, b: str) -> bool:
    """a abbreviates b: the same first letter, and its letters in b in order."""
    if len(a) < 2 or len(a) >= len(b) or a[0] != b[0]:
        return False
    it = iter(b)
    return all(c in it for c in a)


def body_alike(a: Name, b: Name) -> float:
    """Agreement of two organisations' words in any order, with abbreviations and an acronym."""
    x, y = (a.body, b.body) if len(a.body) >= len(b.body) else (b.body, a.body)
    short = b if len(a.body) >= len(b.body) else a
    if len(x) < 3:
        return 0.0
    if short.acronym and len(y) < len(x) and short.acronym in y:
        rest = [w for w in y if w != short.acronym]
        left = list(x)
        for w in rest:
            hit = next((v for v in left if v == w or (len(w) > 4 and near(v, w))), None)
            if hit is None:
                return 0.0
            left.remove(hit)
        return 0.9 if rest and "".join(w[0] for w in left) == short.acronym else 0.0
    if len(x) != len(y):
        return 0.0
    left, slips = list(x), 0
    for w in sorted(y, key=len, reverse=True):
        hit = next((v for v in left if v == w), None) or next((v for v in left if len(w) > 3 and len(v) > 3 and near(v, w)), None) or next((v for v in left if (w in SHORT_BODIES or v in SHORT_BODIES or len(w) > 2) and (_short_for(w, v) or _short_for(v, w))), None)
        if hit is None:
            return 0.0
        slips += hit != w
        left.remove(hit)
    return 1 - 0.05 * slips


def after_initials(given: tuple[str, ...]) -> int:
    """Where the first full name behind leading initials stands; 0 where there are no such initials or names."""
    return next((k for k, w in enumerate(given) if len(w) > 1), 0)


def alike(a: Name, b: Name) -> float:
    """Likeness of two spellings from their parts: 0 where they cannot be one entity's.

    'Anna T. Brandt' may be a T. Brandt of the family Anna. Against a spelling whose order is
    a guess as well ('Anna Torvik', 'Torvik Anna') that takes more than the T.: Brandt has to
    agree with something.
    """
    if a.org or b.org:
        return body_alike(a, b)
    best = 0.0
    guess = len(a.readings) > 1 and len(b.readings) > 1
    for k, (sa, ga) in enumerate(a.readings):
        for m, (sb, gb) in enumerate(b.readings):
            if sa == sb:
                s = 1.0
            elif min(len(sa), len(sb)) >= 5 and (near(sa, sb) or plain(sa) == plain(sb)):
                s = 0.85
            elif sa.rpartition(" ")[2] == sb.rpartition(" ")[2] and (" " in sa or " " in sb) and all(w in PARTICLES for w in (sa + " " + sb).split() if w not in (sa.rpartition(" ")[2],)):
                s = 0.9  # with and without its particle
            else:
                continue
            if guess and (k and 0 < len(gb) <= after_initials(ga) or m and 0 < len(ga) <= after_initials(gb)):
                continue
            g = given_alike(ga, gb)
            if g:
                best = max(best, s * g)
    return best


def bucket(gram: str) -> int:
    return zlib.crc32(gram.encode()) % BUCKETS


def vector(name: Name, weight: np.ndarray) -> dict[int, float]:
    """The unit vector of a name's n-grams; kept with the name."""
    if name.vector is None:
        sums: dict[int, float] = defaultdict(float)
        for g in name.grams():
            k = bucket(g)
            sums[k] += float(weight[k])
        norm = math.sqrt(sum(x * x for x in sums.values())) or 1.0
        name.vector = {k: x / norm for k, x in sums.items()}
    return name.vector


def cosine(a: Name, b: Name, weight: np.ndarray) -> float:
    x, y = vector(a, weight), vector(b, weight)
    if len(x) > len(y):
        x, y = y, x
    return sum(w * y[k] for k, w in x.items() if k in y)


def likeness(a: Name, b: Name, weight: np.ndarray) -> float:
    """The mean of cosine and agreement of the parts; 0 where the parts contradict each other."""
    agree = alike(a, b)
    return (agree + cosine(a, b, weight)) / 2 if agree else 0.0


def average_linkage(links: list[tuple[int, int, float]], least: float = MERGE) -> dict[int, int]:
    """node -> smallest node of its cluster, after merging the most alike clusters.

    links (a, b, likeness) hold each pair once, pairs without one have likeness 0. Clusters
    merge while the average over all their pairs is at least `least`; of equal averages the
    pair with the smallest nodes comes first.
    """
    total: dict[int, dict[int, float]] = defaultdict(dict)
    for a, b, w in links:
        total[a][b] = total[b][a] = w
    size = dict.fromkeys(total, 1)
    label = {n: n for n in total}
    heap = [(-w, min(a, b), max(a, b)) for a, b, w in links if w >= least]
    heapq.heapify(heap)
    while heap:
        w, a, b = heapq.heappop(heap)
        if a not in size or b not in size or b not in total[a] or -w != total[a][b] / (size[a] * size[b]):
            continue  # of clusters that have changed since
        for other, x in total.pop(b).items():
            del total[other][b]
            if other != a:
                total[a][other] = total[other][a] = total[a].get(other, 0.0) + x
        size[a] += size.pop(b)
        label[b] = a
        for other, x in total[a].items():
            average = x / (size[a] * size[other])
            if average >= least:
                heapq.heappush(heap, (-average, min(a, other), max(a, other)))

    def root(n: int) -> int:
        while label[n] != n:
            label[n] = label[label[n]]
            n = label[n]
        return n

    return {n: root(n) for n in label}


def surname_keys(name: Name) -> list[str]:
    """The surnames a spelling may have, with and without particles."""
    out = []
    for s, _ in name.readings:
        out += [s, s.rpartition(" ")[2]] if all(w in PARTICLES for w in s.split()[:-1]) else [s]
    return list(dict.fromkeys(out))


def part_keys(part: str, first: str = "") -> set[str]:
    """Marks of a full given name: `=` the names it is compared as, `<` what may be short for it or it be short for."""
    names = formal(part)
    return {f"={first}{w}" for w in {*names, *map(plain, names)}} | ({f"<{first}{part}"} if len(part) > 2 else set())


def given_keys(given: tuple[str, ...], order: str, guess: bool) -> set[str]:
    """Marks of given names: those that given_alike() accepts meet in one (see tokens()).

    Full names meet where they are a slip apart or begin with one another. An initial asks
    (`?`) for those of all names (`!`). order: 'o' where the order of the spelling is open,
    else 'f'. A guess, see alike(), asks for spellings of a fixed order by its initial, and
    for the others by its second part too.
    """
    letters = {w[0] for w in formal(given[0]) if w}
    out = {f"!{order}{i}" for i in letters}
    if len(given[0]) > 1:
        out |= part_keys(given[0]) | {"=" + "".join(w for w in given if len(w) > 1)}
    else:
        out |= {f"?f{i}" for i in letters} | (set() if guess else {f"?o{i}" for i in letters})
    if order == "o" and len(given) > 1:
        for i in letters:
            out |= {f"!{i}|{w[0]}" for w in formal(given[1])} | (part_keys(given[1], f"{i}|") if len(given[1]) > 1 else {f"?{i}|{given[1]}"})
    return out


def person_keys(name: Name) -> list[tuple[str, str]]:
    """(surname, mark of the given name) of each reading, with and without particles.

    Any two persons' spellings that alike() accepts meet in a mark under one surname, or
    under two of at least five letters that are one slip apart.
    """
    out: set[tuple[str, str]] = set()
    order = "o" if len(name.readings) > 1 else "f"
    for k, (s, given) in enumerate(name.readings):
        if given:
            head, _, last = s.rpartition(" ")
            surnames = {s, last} if all(w in PARTICLES or w == last for w in head.split()) else {s}
            marks = given_keys(given, order, k > 0 and after_initials(given) > 0)
            out.update((x, g) for x in surnames for g in marks)
    return sorted(out)


def body_keys(name: Name) -> list[str]:
    """Marks of a spelling that may be an organisation's: a word or one with a letter left out, and the initials of the rest.

    An acronym also stands for its letters. Spellings that show neither give whole words only.
    """
    words = name.body
    if len(words) < 3 and not (name.acronym and len(words) > 1):
        return []
    out: set[str] = set()
    for k, w in enumerate(words):
        rest = words[:k] + words[k + 1 :]
        forms = {w} | ({w[:i] + w[i + 1 :] for i in range(len(w))} if (name.org or name.acronym) and len(w) > 3 else set())
        for letters in [[v[0] for v in rest]] + ([[v[0] for v in rest if v != name.acronym] + list(name.acronym)] if name.acronym in rest else []):
            out.update(f"{f}|{''.join(sorted(letters))}" for f in forms)
    return sorted(out)


def typed_names(refs: DataFrame, entries: DataFrame, matches: DataFrame) -> DataFrame:
    """(name): every different spelling in the three tables.

    Pieces of author fields between the words `and`, and elements of the two arrays,
    trimmed; a closing `others`, null and empty pieces are none.
    """
    pieces = F.split("author", r"\s+and\s+")
    last = F.trim(F.element_at(pieces, -1)) == "others"
    a = refs.where(F.col("author").isNotNull()).select(F.explode(F.when(last, F.slice(pieces, F.lit(1), F.size(pieces) - 1)).otherwise(pieces)).alias("name"))
    b = entries.select(F.explode("surnames").alias("name"))
    c = matches.select(F.explode("authors").alias("name"))
    trimmed = F.regexp_replace("name", r"^\s+|\s+$", "")
    # each table's names are made distinct before they meet
    each = [x.where(F.col("name").isNotNull()).distinct() for x in (a, b, c)]
    return each[0].unionByName(each[1]).unionByName(each[2]).select(trimmed.alias("name")).where("name <> ''").distinct()


_LISTS = T.ArrayType(T.StringType())
_KEYS = T.ArrayType(T.StructType([T.StructField("surname", T.StringType()), T.StructField("mark", T.StringType())]))


@F.pandas_udf(
    T.StructType(
        [T.StructField(k, T.BooleanType()) for k in ("bare", "org", "whole")] + [T.StructField("form", T.StringType()), T.StructField("keys", _LISTS), T.StructField("person", _KEYS), T.StructField("body", _LISTS)]
    )
)
def _parts(names: pd.Series) -> pd.DataFrame:
    """What a spelling is: a bare surname or an organisation's, with a full given name or not; its form, surnames and marks."""
    found = [Name(n) for n in names]
    person = [[] if x.org or x.bare else [{"surname": s, "mark": g} for s, g in person_keys(x)] for x in found]
    return pd.DataFrame(
        {"bare": [x.bare for x in found], "org": [x.org for x in found], "whole": [x.full for x in found], "form": [x.form for x in found], "keys": [surname_keys(x) for x in found], "person": person, "body": [body_keys(x) for x in found]}
    )


_read: dict[str, Name] = {}


def read(spelling: str) -> Name:
    """A spelling's parts; the last ones read are kept."""
    got = _read.get(spelling)
    if got is None:
        if len(_read) > 100_000:
            _read.clear()
        got = _read[spelling] = Name(spelling)
    return got


def gram_weights(forms: DataFrame) -> np.ndarray:
    """The weight of each bucket of n-grams by the number of forms (rep) that have one.

    Counted in the tasks; the driver receives at most one number per bucket.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS + 1, dtype=np.int64)  # the last one counts the forms
        for batch in batches:
            for rep in batch.column(0).to_pylist():
                seen[BUCKETS] += 1
                for k in {bucket(g) for g in Name(rep).grams()}:
                    seen[k] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["bucket", "n"])

    rows = forms.select("rep").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(BUCKETS + 1)
    for r in rows:
        n[r.bucket] = r.n
    return np.log1p(max(n[BUCKETS], 1.0) / np.maximum(n[:BUCKETS], COMMON))


def tokens(persons: DataFrame) -> DataFrame:
    """(id, surname, token, asks, holds) of persons (id, surname, mark): a token that asks meets the same one that holds.

    `=w` is w and w with a letter left out, on both sides; `<w` asks for w and holds what w
    begins with, from three letters on; `?i` asks, and `!i` holds.
    """
    word = F.col("word")
    one = lambda token, asks, holds: F.struct(token.alias("token"), F.lit(asks).alias("asks"), F.lit(holds).alias("holds"))
    starts = F.transform(F.sequence(F.lit(3), F.greatest(F.length("word") - 2, F.lit(3))), lambda n: one(F.xxhash64(F.lit("<"), F.left(word, n)), False, True))
    kinds = {
        "=": F.transform(gapped("word"), lambda x: one(x, True, True)),
        "<": F.concat(F.array(one(F.xxhash64(F.lit("<"), word), True, False)), starts),
        "?": F.array(one(F.xxhash64(F.lit("?"), word), True, False)),
    }
    of = F.array(one(F.xxhash64(F.lit("?"), word), False, True))
    for kind, marks in kinds.items():
        of = F.when(F.left("mark", F.lit(1)) == kind, marks).otherwise(of)
    each = persons.withColumn("word", F.expr("substring(mark, 2)")).select("id", "surname", F.explode(of).alias("t"))
    return each.select("id", "surname", "t.token", "t.asks", "t.holds")


def links(forms: DataFrame, weight: np.ndarray) -> DataFrame:
    """(a, b, likeness, same, whole_a, whole_b), a < b: all pairs of forms that meet in a mark and agree.

    forms: (id, rep, org, whole, person, body). same: whether they share a surname.
    """
    persons = cut(tokens(forms.select("id", F.explode("person").alias("p")).select("id", "p.surname", "p.mark")))
    words = persons.select(F.col("surname").alias("word")).distinct()
    asking = persons.where("asks")
    # what both asks and holds meets in either direction, so one is enough
    moved = slips(words, words).join(asking.withColumnRenamed("surname", "a"), "a").where("a < b OR NOT holds").select(F.col("b").alias("surname"), "token", "id")
    key = F.xxhash64("surname", "token").alias("key")
    stay = persons.where("holds").select(key, F.col("id").alias("y"))
    here, there = asking.select(key, F.col("id").alias("x"), F.col("holds").alias("once")), moved.select(key, F.col("id").alias("x"), F.lit(False).alias("once"))
    of_persons = here.unionByName(there).join(stay, "key").where("x < y OR x > y AND NOT once").select("x", "y")
    bodies = forms.select("id", "org", F.explode("body").alias("mark")).select("id", "org", F.xxhash64("mark").alias("key"))
    # marks of words count only where one of the two is an organisation's
    of_bodies = bodies.where("org").select("key", F.col("id").alias("x")).join(bodies.select("key", F.col("id").alias("y")), "key").where("x <> y").select("x", "y")
    met = of_persons.unionByName(of_bodies).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    shared = forms.sparkSession.sparkContext.broadcast(weight)  # BUCKETS numbers

    @F.pandas_udf("struct<likeness: double, same: boolean>")
    def compared(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        both = [(read(x), read(y)) for x, y in zip(a, b)]
        same = [not {s for s, _ in x.readings}.isdisjoint(s for s, _ in y.readings) for x, y in both]
        return pd.DataFrame({"likeness": [likeness(x, y, shared.value) for x, y in both], "same": same})

    side = {k: forms.select(F.col("id").alias(k), F.col("rep").alias(f"rep_{k}"), F.col("whole").alias(f"whole_{k}")) for k in "ab"}
    scored = met.join(side["a"], "a").join(side["b"], "b").withColumn("c", compared("rep_a", "rep_b"))
    return scored.where("c.likeness > 0").select("a", "b", "c.likeness", "c.same", "whole_a", "whole_b")


def spread(pairs: DataFrame) -> DataFrame:
    """(id, root): the smallest id that pairs (a, b) connect each id to.

    Labels spread along links and jump to their label's label, so chains of any length
    settle in few rounds; each round is written to the shared folder.
    """
    both = cut(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    now = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).select(F.col("a").alias("id"), "root", F.lit(True).alias("moved")))
    while True:
        labels = now.select("id", "root")
        near_by = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("root").alias("near"))
        low = labels.join(near_by.withColumnRenamed("a", "id"), "id", "left").select("id", F.least("root", F.coalesce("near", "root")).alias("low"), "root")
        jump = labels.select(F.col("id").alias("low"), F.col("root").alias("far"))
        new = low.join(jump, "low", "left").select("id", F.least("low", F.coalesce("far", "low")).alias("new"), "root")
        now = cut(new.select("id", F.col("new").alias("root"), (F.col("new") != F.col("root")).alias("moved")), now)
        if not now.where("moved").limit(1).count():
            drop(both)
            return now.select("id", "root")


def components(pairs: DataFrame, top: int = TOP) -> DataFrame:
    """(id, root): what pairs (a, b, likeness) connect.

    The rounds run on each id's `top` best links. Other links change nothing but where they
    connect two groups; those few are what a second search starts from, so none is lost.
    """
    ends = F.explode(F.array(F.struct(F.col("a").alias("id")), F.struct(F.col("b").alias("id"))))
    each = pairs.select("a", "b", "likeness", ends.alias("e")).select("a", "b", "likeness", "e.id")
    best = W.partitionBy("id").orderBy(F.desc("likeness"), "a", "b")
    ranked = each.withColumn("rank", F.row_number().over(best)).groupBy("a", "b").agg(F.min("rank").alias("rank"))
    ranked = cut(ranked)
    labels = spread(ranked.where(F.col("rank") <= top))
    side = lambda k: labels.select(F.col("id").alias(k), F.col("root").alias(f"root_{k}"))
    rest = ranked.where(F.col("rank") > top).join(side("a"), "a").join(side("b"), "b").where("root_a <> root_b")
    apart = cut(rest.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct())
    if not apart.limit(1).count():
        return labels
    joined = spread(apart).select(F.col("id").alias("root"), F.col("root").alias("last"))
    return labels.join(joined, "root", "left").select("id", F.coalesce("last", "root").alias("root"))


def merge_rounds(pairs: DataFrame, least: float = MERGE) -> DataFrame:
    """(id, cluster) of the average linkage of pairs (a, b, likeness), without a group in one task.

    In each round every cluster asks for the one it is most alike to, and those that ask
    for each other merge: average linkage gives the same clusters in whatever order mutually
    nearest ones merge. Sums of likeness and sizes are all that is carried on.
    """
    nodes = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().select("id", F.col("id").alias("cluster")))
    sums = cut(pairs.select("a", "b", F.col("likeness").alias("total")))
    while True:
        size = nodes.groupBy("cluster").agg(F.count("*").alias("n"))
        of = lambda k: size.select(F.col("cluster").alias(k), F.col("n").alias(f"n_{k}"))
        open_ = sums.join(of("a"), "a").join(of("b"), "b").select("a", "b", (F.col("total") / (F.col("n_a") * F.col("n_b"))).alias("average")).where(F.col("average") >= least)
        ends = F.explode(F.array("a", "b")).alias("me")
        # of equal averages the pair with the smallest ids comes first, the same pair on both sides
        wish = open_.select("a", "b", "average", ends).groupBy("me").agg(F.max(F.struct("average", (-F.col("a")).alias("x"), (-F.col("b")).alias("y"))).alias("w")).select((-F.col("w.x")).alias("a"), (-F.col("w.y")).alias("b"))
        agreed = cut(wish.groupBy("a", "b").agg(F.count("*").alias("k")).where("k = 2").select("a", "b"))
        if not agreed.limit(1).count():
            return nodes
        into = lambda k: agreed.select(F.col("b").alias(k), F.col("a").alias(f"into_{k}"))
        nodes = cut(nodes.join(into("cluster"), "cluster", "left").select("id", F.coalesce("into_cluster", "cluster").alias("cluster")), nodes)
        now = sums.join(into("a"), "a", "left").join(into("b"), "b", "left").select(F.coalesce("into_a", "a").alias("a"), F.coalesce("into_b", "b").alias("b"), "total").where("a <> b")
        sums = cut(now.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.sum("total").alias("total")).select(F.col("x").alias("a"), F.col("y").alias("b"), "total"), sums)


def linkage(pairs: DataFrame, alone: int = ALONE) -> DataFrame:
    """(id, cluster) of all ids in pairs (a, b, likeness) by average linkage.

    Clusters merge by an average, so never without a link of at least MERGE between them:
    groups are what such links connect, and weaker links count inside a group only.
    Groups of at most `alone` links are clustered by one task each, larger ones in rounds.
    """
    roots = cut(components(pairs.where(F.col("likeness") >= MERGE)))
    weak = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(roots, "id", "left_anti").select("id", F.col("id").alias("cluster"))
    rooted = pairs.join(roots.select(F.col("id").alias("a"), "root"), "a").join(roots.select(F.col("id").alias("b"), "root"), ["b", "root"]).select("root", "a", "b", "likeness")
    large = cut(rooted.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > alone).select("root"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Clusters of each run of links with one root; a run may go on in the next batch."""
        root, held = None, []
        for batch in batches:
            out: list[tuple[int, int]] = []
            for r, *link in zip(*(c.to_pylist() for c in batch.columns)):
                if r != root:
                    out += average_linkage(held).items()
                    root, held = r, []
                held.append(tuple(link))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["id", "cluster"])
        out = list(average_linkage(held).items())
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["id", "cluster"])

    small = rooted.join(large, "root", "left_anti").repartition("root").sortWithinPartitions("root", "a", "b")
    done = small.mapInArrow(run, "id long, cluster long").unionByName(weak)
    if not large.limit(1).count():
        return done
    return done.unionByName(merge_rounds(rooted.join(large, "root", "left_semi")))


def attached(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """(id, fits, cluster) of the forms with initials only: how many clusters fit, and one of them.

    edges: (a, b, same, whole_a, whole_b); clusters: (id, cluster) of the forms with a full
    given name. A cluster fits where at least half its members agree; clusters that share
    the surname count before others.
    """
    mixed = edges.where("whole_a <> whole_b").select(F.when(F.col("whole_a"), F.col("b")).otherwise(F.col("a")).alias("id"), F.when(F.col("whole_a"), F.col("a")).otherwise(F.col("b")).alias("member"), "same")
    size = clusters.groupBy("cluster").agg(F.count("*").alias("size"))
    met = mixed.join(clusters.withColumnRenamed("id", "member"), "member").groupBy("id", "cluster").agg(F.count("*").alias("n"), F.max("same").alias("same"))
    good = met.join(size, "cluster").where("n * 2 >= size")
    by = good.groupBy("id", "same").agg(F.count("*").alias("fits"), F.min("cluster").alias("cluster"))
    return by.groupBy("id").agg(F.max(F.struct("same", "fits", "cluster")).alias("x")).select("id", "x.fits", "x.cluster")


def bare_entities(bare: DataFrame, known: DataFrame) -> DataFrame:
    """(name, entity) of bare surnames (name, keys) that fit one entity of known (entity, key).

    A whole surname counts before one without its particle, and both before one that is a
    slip away; a surname that several entities share is left out.
    """
    asked = bare.select("name", F.posexplode("keys").alias("rank", "key"))
    hits = asked.join(known, "key").select("name", "rank", "entity")
    first = hits.groupBy("name", "rank").agg(F.count_distinct("entity").alias("n"), F.min("entity").alias("entity"))
    best = cut(first.groupBy("name").agg(F.min(F.struct("rank", "n", "entity")).alias("b")).select("name", "b.n", "b.entity"))
    rest = asked.join(best.select("name"), "name", "left_anti")
    close = slips(rest.select(F.col("key").alias("word")).distinct(), known.select(F.col("key").alias("word")).distinct())
    far = rest.join(close.toDF("key", "other"), "key").join(known.withColumnRenamed("key", "other"), "other").groupBy("name").agg(F.count_distinct("entity").alias("n"), F.min("entity").alias("entity"))
    return best.unionByName(far).where("n = 1").select("name", "entity")


def entities(names: DataFrame) -> DataFrame:
    """(name, entity): spellings of one person or organisation share the entity.

    names has a column `name` without repeats, nulls or empty strings. Spellings that fit
    none or several entities are left out; so are spellings alone, but for those that a
    bare surname stands for.
    """
    # the names are small in bytes and dear in time: a fixed number of partitions keeps all cores at work
    wide = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 2
    parts = cut(names.repartition(wide, "name").withColumn("p", _parts("name")).select("name", "p.*").withColumn("id", F.xxhash64("form")))
    read_ = parts.where("NOT bare")
    forms = cut(read_.groupBy("id").agg(F.min_by(F.struct("name", "org", "whole", "person", "body"), "name").alias("x")).select("id", F.col("x.name").alias("rep"), "x.org", "x.whole", "x.person", "x.body"))
    edges = cut(links(forms, gram_weights(forms)))
    # what has a full given name first
    linked = linkage(edges.where("whole_a AND whole_b").select("a", "b", "likeness"))
    known = cut(forms.where("whole").select("id").join(linked, "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster")))
    fits = cut(attached(edges, known))
    loose = forms.where("NOT whole").select("id").join(fits.select("id"), "id", "left_anti")
    among = edges.where("NOT whole_a AND NOT whole_b").join(loose.withColumnRenamed("id", "a"), "a", "left_semi").join(loose.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b", "likeness")
    together = loose.join(linkage(cut(among)), "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster"))
    cluster = known.unionByName(fits.where("fits = 1").select("id", "cluster")).unionByName(together)
    owned = cut(read_.select("name", "id", "keys").join(cluster, "id").select("name", F.col("cluster").alias("entity"), "keys"))
    keys = owned.select("entity", F.explode("keys").alias("key")).distinct()
    bare = bare_entities(parts.where("bare").select("name", "keys"), keys)
    return owned.select("name", "entity").unionByName(bare)


def found(refs: DataFrame, entries: DataFrame, matches: DataFrame) -> DataFrame:
    """(name_a, name_b), name_a < name_b: different spellings of one person or organisation."""
    e = entities(typed_names(refs, entries, matches))
    other = e.withColumnRenamed("name", "name_b")
    return e.withColumnRenamed("name", "name_a").join(other, "entity").where("name_a < name_b").select("name_a", "name_b")
