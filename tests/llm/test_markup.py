import pytest

from citeloom.llm import markup as M
from citeloom.llm import markup_training as MT

MODEL = M.Labeller.load()


def read(text):
    text = M.unescaped(text)
    seq = M.leaves(text)
    labels = MODEL.label([M.vectors(text, seq)])[0] if seq else []
    found = [M.ELEMENTS.get(int(y), "markup") for x, y in zip(seq, labels) if x.kind != "text" and y != M.PROSE]
    return found, M.render(text, seq, labels) if seq else text


@pytest.mark.parametrize(
    "text",
    [
        "Stars mark levels: * for 0.05 and ** for 0.01.", "The fee rose from $5 to $9 per page.", "Items [3] and [4] agree.", "We used C++ and C# bindings under R&D rules.", "Files follow the raw_ref_list pattern.", "Only cells with a < b and c > d were kept.",
        "The range {1, 2, 3} was scanned.", "The factors 2 * 3 * 4 were multiplied.", "Ticket #42 stays open.", "Robust annotation at p < 0.05", "Plain prose without any sign.", "",
    ],
)
def test_plain(text):
    assert read(text)[0] == []


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("## Results\n\nWe *saw* it: $x^2$ holds.\n\n- one thing we saw\n- two things we saw\n\n```\nprint(1)\n```", ["heading", "markup", "formula", "list_item", "list_item", "code"]),
        ("== Results ==\nIt ''is'' [[Main|so]].\n* first item of it\n# second item of it", ["heading", "markup", "markup", "list_item", "list_item"]),
        ("<jats:title>Aim</jats:title><jats:p>See <jats:disp-formula>a+b</jats:disp-formula></jats:p>", ["heading", "markup", "markup", "formula", "markup"]),
        ("&lt;h2&gt;Aim&lt;/h2&gt;&lt;pre&gt;x = 1&lt;/pre&gt;", ["heading", "markup", "code"]),
        ("\\section{Aim}\n\\begin{itemize}\n\\item the first one\n\\end{itemize}\n\\[a\\]", ["heading", "markup", "list_item", "markup", "formula"]),
        ("Towards {Robust} ranking~with $L_2$ norms", ["markup", "markup", "formula"]),
        ("It cost \\$5 or 3\\%.", ["markup", "markup"]),
    ],
)
def test_elements(text, found):
    assert read(text)[0] == found


def test_clean():
    assert read("## Results\n\nWe *saw* [it](http://x):\n\n- one thing\n- two things\n\n```\nx = 1\n```")[1] == "# Results\n\nWe saw it:\n\n- one thing\n- two things\n\n```\nx = 1\n```"
    assert read("\\section{Aim} The {\\em big} \\emph{one}, 5\\% of $x$")[1] == "# Aim\n\n The big one, 5% of $x$"
    assert read("<h1>Aim</h1><p>A &amp; B</p>")[1] == "# Aim\n\nA & B"


def test_held_out_accuracy():
    assert MT.accuracy(MODEL.w, n=400, seed=12345) > 0.995


def test_training_learns():
    w = MT.train(documents=2000, epochs=3, seed=3)
    assert MT.accuracy(w, n=100, seed=4) > 0.8


def test_batches_do_not_matter():
    xs, _ = MT.sample(60, 8)
    alone = [MODEL.label([x])[0].tolist() for x in xs]
    assert [y.tolist() for y in MODEL.label(xs)] == alone


def test_frames(spark, rows):
    data = [("s", 1, "{A} b", "x"), ("s", 2, None, "x"), ("s", 3, "", "x"), ("s", 4, "plain", "x"), ("s", 5, "{A} b", "x"), ("s", 6, "word " * 40_000 + "$x$ end", "x")]
    df = spark.createDataFrame(data, "src string, row_id long, text string, element string")
    assert rows(M.elements(df)) == [("s", 1, "markup", 0), ("s", 5, "markup", 0), ("s", 6, "formula", 1), ("s", 6, "markup", 0)]
    assert [r[:3] for r in rows(M.clean(df)) if r[1] < 6] == [("s", 1, "A b"), ("s", 3, ""), ("s", 4, "plain"), ("s", 5, "A b")]
    assert M.elements(df.limit(0)).count() == 0
