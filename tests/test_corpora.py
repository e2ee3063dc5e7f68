import gzip
import io
import json
import tarfile
import zipfile

import pytest

from citeloom.sources import corpora as C


def docx(*lines):
    out = io.BytesIO()
    body = "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in lines)
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://x"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_sniff():
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w") as t:
        t.addfile(tarfile.TarInfo("a.tex"))
    assert C.sniff(b"%PDF-1.4") == "pdf" and C.sniff(gzip.compress(b"x")) == "gz" and C.sniff(gzip.compress(tar.getvalue())) == C.sniff(tar.getvalue()) == "tar"
    assert C.sniff(gzip.compress(b"x" * 99)[:-6]) is None and C.sniff(docx("a")) == "zip" and C.sniff(b"") is None


def test_docx(spark, rows, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx("Text before it all.", "References", "[1] Kun, B. (2001). A long title of a work.", "Figure 3: not a reference at all here", "2. Nil, H. Another long title, 2003.", "short"))
    (tmp_path / "b.docx").write_bytes(b"no file of that kind")
    assert rows(C.read_docx(spark, str(tmp_path)), "place", "raw") == [(0, "Kun, B. (2001). A long title of a work."), (2, "Nil, H. Another long title, 2003.")]
    assert rows(C.sniffed(spark, str(tmp_path)), "kind") == [("zip",), (None,)]


def test_tex(spark, rows):
    t = spark.createDataFrame([("m.tex", "\\input{a} % \\input{no}\n\\include{b.tex}\\begin{abstract} A \\emph{short} one.\\end{abstract}"), ("x", "none")], "path string, text string")
    assert rows(C.included(t)) == [("m.tex", "a.tex"), ("m.tex", "b.tex")]
    assert rows(t.select(C.tex_abstract("text").alias("a"))) == [("A short one.",), (None,)]
    b = spark.createDataFrame([(1, "\\bibitem[Kun(2001)]{kun} Kun. arXiv:2001.01234. \\bibitem{nil} Nil. Journal.")], "id int, text string")
    assert rows(C.bbl_arxiv_ids(b, "id", "text")) == [(1, "kun", "2001.01234")]


def test_manifest(spark, rows, tmp_path):
    (tmp_path / "m.xml").write_text("<m><file><filename>a.tar</filename><yymm>2401</yymm><size>5</size><num_items>2</num_items><content_md5sum>f</content_md5sum></file></m>")
    assert rows(C.read_manifest(spark, str(tmp_path / "m.xml"))) == [("a.tar", "2401", 5, 2, "f")]


def test_labelled_corpora(spark, rows, tmp_path):
    lines = lambda name, *xs: (tmp_path / name).write_text("\n".join(json.dumps(x) for x in xs))
    lines("c", {"id": 1, "claim": "It holds.", "evidence": {"7": [{"sentences": [1], "label": "SUPPORT"}, {"sentences": [0, 1], "label": "CONTRADICT"}]}, "cited_doc_ids": [7]}, {"id": 2, "claim": "Open.", "evidence": {}, "cited_doc_ids": [7, 9]})
    lines("d", {"doc_id": 7, "title": "T", "abstract": ["One.", "Two.", "Three."]})
    assert rows(C.read_claim_pairs(spark, str(tmp_path / "c"), str(tmp_path / "d"))) == [(1, 7, "It holds.", "One. Two.", "CONTRADICTED"), (2, 7, "Open.", "One. Two. Three.", "NOT_ENOUGH_INFO")]
    lines("i", {"unique_id": "a", "string": "s", "label": "method"}, {"id": "b", "string": "s", "label": "odd"})
    assert rows(C.read_intents(spark, str(tmp_path / "i"))) == [("a", "s", "supporting")]
    lines("v", {"id": 1, "claim": "c", "label": "REFUTES"}, {"id": 2, "claim": "c", "label": None})
    assert rows(C.read_verdicts(spark, str(tmp_path / "v"))) == [(1, "c", "CONTRADICTED")]


def test_results(spark, rows, tmp_path):
    df = spark.createDataFrame([("a", 1)], "k string, n int")
    C.write_results(df, str(tmp_path / "r"))
    assert rows(C.read_results(spark, str(tmp_path / "r"), "k STRING, n INT")) == [("a", 1)]
    C.write_json_lines(df, str(tmp_path / "j"))
    C.write_json_lines(df, str(tmp_path / "j"), append=True)
    with pytest.raises(Exception, match="unknown format_version"):
        C.read_results(spark, str(tmp_path / "j"), "k STRING, n INT").collect()
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_worklist_and_phrases(spark, rows):
    r = spark.createDataFrame([("a", "found", None, None, "x"), ("b", "found", "supported", False, "x"), ("c", "found", "contradicted", True, "x"), ("d", "absent", None, None, "x"), ("e", "found", "supported", True, "x")], "record_id string, status string, opinion string, quote_found boolean, text string")
    assert rows(C.worklist(r), "bucket", "place") == [(0, "b"), (1, "c"), (3, "a"), (4, "d"), (5, "e")]
    assert C.merged_phrases({"a b": "x", "c": "c"}, {"a b": "y", "d": "e"}) == {"a b": "y", "d": "e"}
