import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from citeloom.operators import nested

VALUES = st.recursive(st.none() | st.booleans() | st.integers(-(10**18), 10**18) | st.text(max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from("abc"), x, max_size=3), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(VALUES)
def test_round_trip_of_scalars(value):
    def walk(v):
        if isinstance(v, dict):
            return [x for y in v.values() for x in walk(y)] or [None]
        if isinstance(v, list):
            return [x for y in v for x in walk(y)] or [None]
        return [None if v is None else str(v).lower() if isinstance(v, bool) else str(v)]

    assert [v for _, _, _, v in nested.scan(json.dumps(value))] == walk(value)


@settings(max_examples=300, deadline=None)
@given(VALUES, st.integers(0, 10**6), st.sampled_from('{}[],:"1 x'))
def test_rejects_what_is_no_json(value, at, sign):
    text = json.dumps(value)
    at %= len(text) + 1
    text = text[:at] + sign + text[at + 1 :]
    try:
        json.loads(text)
        valid = True
    except ValueError:
        valid = False
    try:
        nested.scan(text)
        assert valid
    except nested.BadRecord:
        assert not valid


def test_places():
    assert nested.scan('{"a":[{"b":1},{"b":[5,6]}],"c":[[1],[2]]}') == [("a.b", [0, 0], "num", "1"), ("a.b", [1, 0], "num", "5"), ("a.b", [1, 1], "num", "6"), ("c.#", [0, 0], "num", "1"), ("c.#", [1, 0], "num", "2")]
    assert nested.scan('{"a":1e3,"b":2.50}') == [("a", [0], "num", "1000"), ("b", [0], "num", "2.5")]


def body(message):
    return json.dumps({"message": message})


def test_children(spark, rows):
    data = [
        (1, body({"funder": [{"name": "x"}, {"award": ["A", None, "", 7]}], "license": {"URL": " u "}}), "z"),
        (2, body(json.dumps({"funder": {"award": "B"}, "isbn-type": [{"value": None}, {"value": 9780000000000}]})), "z"),
        (3, body({"funder": []})[:-3], "z"), (4, None, "z"), (5, "", "z"), (6, '{"status": 1}', "z"), (7, "[1]", "z"), (8, body("no json"), "z"), (8, body(None), "z"),
        (9, body({"funder": [{"award": "B"}]}), "z"), (10, body({"funder": [{"award": "B" * 100_000}]}), "z"),
    ]
    df = spark.createDataFrame(data, "raw_id long, body string, value string")  # `value` clashes
    got = rows(nested.answer_children(df), "raw_id", "child", "parent_no", "child_no", "value")
    assert [r for r in got if r[0] != 10] == sorted(
        [(1, "funder_award", 1, 0, "A"), (1, "funder_award", 1, 3, "7"), (1, "license_url", 0, 0, " u "), (2, "funder_award", 0, 0, "B"), (2, "isbn_value", 1, 0, "9780000000000"), (9, "funder_award", 0, 0, "B")], key=repr
    )
    assert [len(r[4]) for r in got if r[0] == 10] == [100_000]
    assert nested.answer_children(df.limit(0)).count() == 0


def test_child_table_and_ancestors(spark, rows):
    df = spark.createDataFrame([(1, '{"m":[{"n":"x","d":"1"},{"n":"y"}]}')], "id long, body string")
    t = nested.shred(df, "id", "body")
    assert rows(nested.child_table(t, "m", {"n": "n", "d": "d"}, {"m": "no"})) == [(1, 0, "x", "1"), (1, 1, "y", None)]
    assert rows(nested.repeated_ancestors(t)) == [("m", 1)]


@pytest.mark.parametrize("text", ["", "nul", '{"a"}', "01", '"\\x"', "[1,]", '{"a":1,}', "1 2", '{"a":"\n"}'])
def test_bad(text):
    with pytest.raises(nested.BadRecord):
        nested.scan(text)


def test_dotted_keys_keep_their_places(spark, rows):
    assert nested.scan('{"a.b":[{"c~d":1},{"c~d":2}]}') == [("a~1b.c~0d", [0, 0], "num", "1"), ("a~1b.c~0d", [1, 0], "num", "2")]
    df = spark.createDataFrame([(1, body({"fun.der": [{"award": "X"}], "funder": [{"x.y": "q"}, {"award": ["A", "B"]}]}))], "raw_id long, body string")
    assert rows(nested.answer_children(df), "child", "parent_no", "child_no", "value") == [("funder_award", 1, 0, "A"), ("funder_award", 1, 1, "B")]


def test_flat_tables(spark, rows):
    df = spark.createDataFrame([(1, '{"t":"x","m":[{"n":"a","k":["p","q"]},{"n":"b","o":{"z":1}}]}'), (2, '{"t":null,"m":{"n":"c"}}')], "id long, body string")
    t = nested.shred(df, "id", "body")
    assert rows(nested.grouped_paths(t)) == [("m.k", "m.k", 2), ("m.n", "m", 1), ("m.o.z", "m", 1), ("t", "", 0)]
    got = {(r.rec_id, r.ancestor, tuple(r.places)): r.fields for r in nested.flat_tables(t).collect()}
    assert got == {(1, "", ()): {"t": "x"}, (1, "m", (0,)): {"n": "a"}, (1, "m", (1,)): {"n": "b", "o.z": "1"}, (1, "m.k", (0, 0)): {"": "p"}, (1, "m.k", (0, 1)): {"": "q"}, (2, "m", (0,)): {"n": "c"}}
    assert nested.flat_tables(t.limit(0)).count() == 0


def test_nothing_repeated(spark, rows):
    df = spark.createDataFrame([(1, body({"funder": {"award": "A"}, "license": {"URL": "u"}, "isbn-type": {"value": "9"}}))], "raw_id long, body string")
    assert rows(nested.answer_children(df), "child", "parent_no", "child_no", "value") == [("funder_award", 0, 0, "A"), ("isbn_value", 0, 0, "9"), ("license_url", 0, 0, "u")]
