"""Deeply nested JSON records as flat child tables that keep parent and position.

Each record is scanned once, token by token, into (path, ordinals, value) triples. The
path names the keys only; ordinals hold one number per key: the place in the array under
that key, 0 where a single value stands in place of an array. An array straight inside an
array, or at the root, adds the key ``#``. Which paths are repeated is read from the triples;
paths below one repeated ancestor form a group, share their leading ordinals, and pivot
into one flat table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.session import cut

TRIPLES = "rec_id long, path string, ordinals array<int>, kind string, value string"
_SPACE = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?")
_WORDS = {"true": "bool", "false": "bool", "null": "null"}


class BadRecord(ValueError):
    """The text is no JSON document."""


def _digits(m: re.Match) -> str:
    """A number as decimal digits, without an exponent where that is possible."""
    if m.group(1) is None and m.group(2) is None:
        return m.group()
    from decimal import Decimal

    text = format(Decimal(m.group()), "f")
    return text.rstrip("0").rstrip(".") if "." in text else text


def scan(text: str, unwrap: frozenset[str] = frozenset()) -> list[tuple[str, list[int], str, str | None]]:
    """All scalar values of one JSON text as (path, ordinals, kind, value).

    In a path the keys stand between dots; a dot inside a key is written ~1, a tilde ~0. A string at a path in `unwrap` is scanned in turn as JSON. Empty objects and arrays
    give a triple of kind 'empty', so that a record's presence stays visible.
    """
    out: list[tuple[str, list[int], str, str | None]] = []
    keys: list[str] = []
    places: list[int] = []
    stack: list[tuple[bool, int]] = []  # (is array, number of keys when it was opened)
    space, n = _SPACE.match, len(text)
    i = space(text, 0).end()
    want = True  # a value comes next; else a comma or an end
    fresh = False  # just after an opening bracket

    def put(kind: str, value: str | None) -> None:
        path = ".".join(keys)
        if kind == "str" and path in unwrap:
            for p, o, k, v in scan(value or ""):
                out.append((f"{path}.{p}" if p else path, [*places, *o], k, v))
        else:
            out.append((path, places.copy(), kind, value))

    def after_value() -> None:
        nonlocal want
        want = False

    while True:
        i = space(text, i).end()
        if i >= n:
            if stack or want:
                raise BadRecord("cut")
            return out
        c = text[i]
        if want:
            if stack and not stack[-1][0]:  # inside an object: a key first
                if c == "}" and fresh:
                    stack.pop()
                    put("empty", None)
                    _leave(stack, keys, places)
                    i, fresh = i + 1, False
                    after_value()
                    continue
                if c != '"':
                    raise BadRecord("key")
                try:
                    key, i = scanstring(text, i + 1, True)
                except ValueError as e:
                    raise BadRecord("string") from e
                i = space(text, i).end()
                if i >= n or text[i] != ":":
                    raise BadRecord("colon")
                i = space(text, i + 1).end()
                if i >= n:
                    raise BadRecord("cut")
                keys.append(key.replace("~", "~0").replace(".", "~1") if "." in key or "~" in key else key)
                places.append(0)
                c = text[i]
            elif stack and c == "]" and fresh:
                stack.pop()
                put("empty", None)
                _leave(stack, keys, places)
                i, fresh = i + 1, False
                after_value()
                continue
            elif stack and not fresh:
                pass
            fresh = False
            if c == "{":
                stack.append((False, len(keys)))
                i, fresh = i + 1, True
                continue
            if c == "[":
                if not stack or stack[-1][0]:  # an array in an array, or at the root
                    keys.append("#")
                    places.append(0)
                stack.append((True, len(keys)))
                i, fresh = i + 1, True
                continue
            if c == '"':
                try:
                    value, i = scanstring(text, i + 1, True)
                except ValueError as e:
                    raise BadRecord("string") from e
                put("str", value)
            elif (m := _NUMBER.match(text, i)) and m.end() > i:
                put("num", _digits(m))
                i = m.end()
            else:
                for word, kind in _WORDS.items():
                    if text.startswith(word, i):
                        put(kind, None if kind == "null" else word)
                        i += len(word)
                        break
                else:
                    raise BadRecord("value")
            _leave(stack, keys, places)
            after_value()
        else:
            if not stack:
                raise BadRecord("more after the end")
            is_array = stack[-1][0]
            if c == ",":
                if is_array and places:
                    places[-1] += 1
                i, want = i + 1, True
            elif c == ("]" if is_array else "}"):
                stack.pop()
                _leave(stack, keys, places)
                i += 1
            else:
                raise BadRecord("comma")


def _leave(stack: list[tuple[bool, int]], keys: list[str], places: list[int]) -> None:
    """A value has ended: forget the keys opened for it."""
    depth = stack[-1][1] if stack else 0
    del keys[depth:], places[depth:]


def shred(df: DataFrame, id_col: str, json_col: str, unwrap: tuple[str, ...] = (), under: tuple[str, ...] = ()) -> DataFrame:
    """(rec_id, path, ordinals, kind, value) triples of every valid record of df.

    under: paths to keep with all below them, so that no other value leaves the scan; all by default.

    Null, empty, cut and otherwise invalid texts give no triple; repeated rows give theirs
    each. Other columns of df play no part, whatever their names. Narrow: no shuffle.
    """
    inner, below = frozenset(unwrap), tuple(f"{p}." for p in under)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, paths, places, kinds, values = [], [], [], [], []
            for rec, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                try:
                    found = scan(text, inner)
                except (BadRecord, RecursionError):
                    continue
                for p, o, k, v in found:
                    if below and not f"{p}.".startswith(below):
                        continue
                    ids.append(rec)
                    paths.append(p)
                    places.append(o)
                    kinds.append(k)
                    values.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(paths, pa.string()), pa.array(places, pa.list_(pa.int32())), pa.array(kinds, pa.string()), pa.array(values, pa.string())],
                names=["rec_id", "path", "ordinals", "kind", "value"],
            )

    return df.select(F.col(id_col).cast("long").alias("rec_id"), F.col(json_col).cast("string").alias("body")).mapInArrow(run, TRIPLES)


def repeated_ancestors(triples: DataFrame) -> DataFrame:
    """(ancestor, records): the paths that hold several values in some record, by how many records."""
    at = F.posexplode("ordinals").alias("level", "place")
    steps = triples.select("rec_id", "path", at).where("place > 0")
    name = F.array_join(F.slice(F.split("path", r"\."), F.lit(1), F.col("level") + 1), ".")
    return steps.select("rec_id", name.alias("ancestor")).distinct().groupBy("ancestor").agg(F.count("*").alias("records"))


def grouped_paths(triples: DataFrame) -> DataFrame:
    """(path, ancestor, depth): each path with its nearest repeated ancestor and how many keys that has; '' and 0 where none is."""
    paths = triples.select("path").distinct().withColumn("keys", F.split("path", r"\."))
    steps = paths.select("path", F.explode(F.sequence(F.lit(1), F.size("keys"))).alias("depth"), "keys").withColumn("ancestor", F.array_join(F.slice("keys", F.lit(1), F.col("depth")), "."))
    near = steps.join(repeated_ancestors(triples), "ancestor").groupBy("path").agg(F.max(F.struct("depth", "ancestor")).alias("a"))
    return paths.select("path").join(near, "path", "left").select("path", F.coalesce("a.ancestor", F.lit("")).alias("ancestor"), F.coalesce("a.depth", F.lit(0)).alias("depth"))


def flat_tables(triples: DataFrame) -> DataFrame:
    """(rec_id, ancestor, places, fields): the rows of all groups' tables, each group of paths pivoted into one.

    places: the row's place under every key of the ancestor. fields: value by the rest of
    the path, '' for the ancestor's own. Null and empty values are no field; a row without
    a field is left out; of values with one place the smallest counts. No triples give no rows.
    """
    rows = triples.where(F.col("value") != "").join(grouped_paths(triples), "path")
    rest = F.when(F.col("path") == F.col("ancestor"), F.lit("")).otherwise(F.when(F.col("depth") == 0, F.col("path")).otherwise(F.substring("path", F.length("ancestor") + 2, F.length("path"))))
    keyed = rows.select("rec_id", "ancestor", F.slice("ordinals", F.lit(1), F.col("depth")).alias("places"), rest.alias("field"), "value")
    row = keyed.groupBy("rec_id", "ancestor", "places").agg(F.array_sort(F.collect_list(F.struct("field", "value"))).alias("cells"))
    first = F.filter("cells", lambda x, i: (i == 0) | (F.get("cells", i - 1).field != x.field))
    return row.select("rec_id", "ancestor", "places", F.map_from_entries(first).alias("fields"))


def child_table(triples: DataFrame, ancestor: str, fields: dict[str, str], numbers: dict[str, str]) -> DataFrame:
    """One flat table for the group of paths below `ancestor`.

    fields: path below the ancestor ('' for the ancestor itself) to column name. numbers:
    path of a repeated ancestor to the column that gets its place. Null and empty values
    leave their columns null; a row of which all fields are so is left out.
    """
    full = {(f"{ancestor}.{p}" if p else ancestor): c for p, c in fields.items()}
    level: dict[str, Column] = {c: F.element_at("ordinals", len(p.split("."))) for p, c in numbers.items()}
    rows = triples.where(F.col("path").isin(*full) & (F.col("value") != ""))
    keyed = rows.select("rec_id", *(x.alias(c) for c, x in level.items()), "path", "value")
    return keyed.groupBy("rec_id", *level).agg(*(F.min(F.when(F.col("path") == p, F.col("value"))).alias(c) for p, c in full.items()))


#: child name: path of the value; its parent is the second key
CHILDREN = {"funder_award": "message.funder.award", "license_url": "message.license.URL", "isbn_value": "message.isbn-type.value"}


def answer_children(raw: DataFrame, id_col: str = "raw_id", body_col: str = "body") -> DataFrame:
    """(raw_id, child, parent_no, child_no, value) of registry answers.

    Awards of funders, URLs of licences and values of ISBN entries, read from the flat
    tables of whatever ancestors are repeated. Invalid bodies and bodies without a message
    give no row, null and empty values neither, but they keep their place. An empty table
    gives an empty one.
    """
    parents = tuple(dict.fromkeys(p.rpartition(".")[0] for p in CHILDREN.values()))
    triples = cut(shred(raw, id_col, body_col, unwrap=("message",), under=parents))
    cells = flat_tables(triples).select("rec_id", "ancestor", "places", F.explode("fields").alias("field", "value"))
    # ancestors and fields make the path again; what is not repeated has place 0
    path = F.concat_ws(".", F.nullif("ancestor", F.lit("")), F.nullif("field", F.lit("")))
    child = F.coalesce(*(F.when(path == p, F.lit(c)) for c, p in CHILDREN.items()))
    place = lambda k: F.coalesce(F.get("places", F.lit(k)), F.lit(0))
    rows = cells.select("rec_id", child.alias("child"), place(1).alias("parent_no"), place(2).alias("child_no"), "value").where("child IS NOT NULL")
    return rows.withColumnRenamed("rec_id", "raw_id")
