import random

import pytest

from citeloom.llm import sentences as S


def cut(text, **roles):
    return [text[a:b] for a, b in S.split(text, roles)]


@pytest.mark.parametrize(
    "parts",
    [
        ["Dr. Kun reported it on 7 March 2014.", "The end."], ["See Fig. 2, e.g. the left side.", "It falls by 3.5 points."], ['"The DOI resolves. We could not find it," wrote Kun in the report.', "Next."], ["(Kun was excluded.)", "We went on."],
        ["Why so quickly?", "“We compared titles.”", "Good!"], ["It rose.[3,14]", "Then it fell.(46)", "At last.¹", "The end."], ["J. R. Kun and P. Nil proposed it.", "A. B. Lee did not."], ["mRNA levels were low.", "p53 was not."], ["Am 25. Mai 2012 kam es, z. B. hier.", "Die Prüfung dauerte bis zum 1. Quartal!"],
        ["Prof. Dr. Kun nannte es „unvollständig. Es fehlt“ und ging.", "Laut Abb. 2 stimmt es."], ["¿Por qué falta?", "¡No se halló!"], ["По данным А. В. Kun, доля выросла.", "См. рис. 2."],
    ],
)
def test_spaced(parts):
    assert cut(" ".join(parts)) == parts
    assert cut("\n".join(parts)) == parts
    assert cut("  " + "  ".join(parts) + "\n") == parts


@pytest.mark.parametrize("parts", [["作者认为不可靠。", "图2显示；表3给出。", "编辑说：“不存在。请更正。”随后关闭了。", "为什么？"], ["編集部は「ない。ほしい。」と回答した。", "なぜか？", "誤りは0.5%だ。"], ["Version 5.9.3 fixed the parser.", "Reviewer 3 left."], ["It ended.[2]", "Then more."]])
def test_without_spaces(parts):
    assert cut("".join(parts)) == parts


def test_more():
    assert cut("이 논문은 철회되었다. 편집자는 \"없다. 달라.\"라고 답했다.") == ["이 논문은 철회되었다.", "편집자는 \"없다. 달라.\"라고 답했다."]
    assert cut("नाम क्यों नहीं है? डॉ. Kun ने लिया। विवरण है।") == ["नाम क्यों नहीं है?", "डॉ. Kun ने लिया।", "विवरण है।"]
    assert cut("ไม่พบแหล่งข้อมูล ตารางที่2แสดง\n\nปี2006") == ["ไม่พบแหล่งข้อมูล", "ตารางที่2แสดง", "ปี2006"]
    assert cut("لماذا؟ قال د. Kun إن المقال سحب.") == ["لماذا؟", "قال د. Kun إن المقال سحب."]
    assert cut("A copy is at archive.Kun.example/v1.2 now. Good.") == ["A copy is at archive.Kun.example/v1.2 now.", "Good."]
    assert cut("") == cut("  \n") == []
    assert cut("no end") == ["no end"]


def test_document_decides():
    assert S.role("inc", (1, 0, 0, 0), (0, 5, 5, 5)) == 2
    assert S.role("inc", (1, 0, 0, 0), (5, 0, 5, 5)) == 1
    assert S.role("no", (0, 1, 0, 3), (50, 1, 1, 0)) == 0
    assert S.role("xyz", None, (0, 0, 9, 0)) == 1
    assert S.role("ties", None, (0, 4, 3, 0)) == 0
    assert S.role("etc", None, (3, 3, 1, 0)) == 2
    assert S.role("j.r", None, None) == 1


def test_proper_names_follow_abbreviations():
    roles = {"u.s": 2}
    assert len(S.split("He met the Senate. The U.S. Senate sat.", roles)) == 2
    assert len(S.split("He left the U.S. Then he sat, and then he went.", roles)) == 2
    assert len(S.split("He left the U.S. Nobody saw it.", roles)) == 2


def test_positions_are_ordered():
    text = 'One. “Two? Three!” (Four.) Five' * 50
    spans = S.split(text, {})
    assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    assert "".join(text[a:b] for a, b in spans).replace(" ", "") == text.replace(" ", "")


def test_frames(spark, rows):
    scan = spark.createDataFrame(
        [(1, "p", "passage", "See abb. Next. The abb. is", "x"), (2, "p", "passage", None, "x"), (3, "p", "passage", "", "x"), (4, "p", "sentence", "It is abb, not more.", "x"), (5, None, "passage", "A. B", "x"), (6, "p", "passage", "w " * 60_000 + "end. More.", "x"), (7, "p", "passage", "Same. Same.", "x"), (8, "p", "passage", "Same. Same.", "x")],
        "sentence_id long, pdf_sha256 string, slice_kind string, text string, token string",
    )
    nli = spark.createDataFrame([(1, 5, "One. Two."), (2, None, None)], "result_id long, ref_id long, premise string")
    got = rows(S.found(scan, nli))
    assert [r for r in got if r[0] == "nli_results"] == [("nli_results", 1, 1, 0, 4), ("nli_results", 1, 2, 5, 9)]
    assert [r[3:] for r in got if r[1] == 7] == [r[3:] for r in got if r[1] == 8] == [(0, 5), (6, 11)]
    assert {r[1] for r in got if r[0] == "scan_sentences"} == {1, 5, 6, 7, 8}
    assert [r[2] for r in got if r[1] == 6] == [1, 2]
    assert S.found(scan.limit(0), nli.limit(0)).count() == 0


def test_roles_as_expressions(spark):
    rng = random.Random(5)
    tokens = ["no", "dr", "xyz", "j.r", "e.g", "т.е", "डॉ"]
    data = [(rng.choice(tokens), *(rng.choice([0, 0, 1, 2, 5, 30]) if rng.random() > 0.2 else None for _ in range(8))) for _ in range(600)]
    df = spark.createDataFrame(data, "token string, a long, e long, d long, b long, aa long, ae long, ad long, ab long")
    got = df.select("*", S.role_of("token", {k: k for k in "aedb"}, {k: f"a{k}" for k in "aedb"}).alias("kind"), S.default_role("token").alias("usual")).collect()
    for r in got:
        doc, corpus = (tuple(r[k] or 0 for k in (f"{p}a", f"{p}e", f"{p}d", f"{p}b")) for p in ("", "a"))
        assert r.kind == S.role(r.token, doc, corpus), r
        assert r.usual == S.role(r.token, None, None)


def test_evidence():
    counts, asked, bare = S.evidence("See abb. 3 and the abb. It is so. Abb is it, not Bundesges. but so.")
    assert counts == {"abb": [1, 0, 1], "so": [0, 1, 1], "bundesges": [1, 0, 0]}
    assert asked == {"abb", "so", "bundesges"} and {"see", "abb", "it", "not"} <= bare and "bundesges" not in bare
