import json

from citeloom.sources import files, registry

BIB = """@string{x = {y}}
@Article{a1, title = {The {B}ig \\emph{Test}}, author="A, B and C", year = 2001, doi = {10.1000/x}, journal = "J" # " Two"}
% a comment
@misc{a2, title={Cut}, eprint = {2301.12345v2}}
@misc{a3, title = {never closed
"""


def test_bibtex(spark, tmp_path, rows):
    (tmp_path / "a.bib").write_text(BIB)
    (tmp_path / "b.bib").write_text("")
    got = rows(files.read_bibtex(spark, str(tmp_path)), "cite_key", "entry_type", "title", "author", "year", "venue", "arxiv_id")
    assert got == [("a1", "article", "The Big Test", "A, B and C", "2001", "J Two", None), ("a2", "misc", "Cut", None, None, None, "2301.12345v2")]


def test_bibtex_round_trip(spark, tmp_path, rows):
    df = spark.createDataFrame([("k", "Misc", "T {x}", "A and B", "2000", None, "")], "cite_key string, entry_type string, title string, author string, year string, doi string, url string")
    text = files.bibtex_text(df).first().entry
    assert files.split_entries(text) == [("misc", "k", {"title": "T {x}", "author": "A and B", "year": "2000"})]


TEI = """<TEI><listBibl>
<biblStruct><analytic><title>One</title><author><persName><forename>Ann</forename><surname>Lee</surname></persName></author><idno type="DOI">10.1000/abc</idno></analytic><monogr><title>J</title><imprint><date when="2010-05"/></imprint></monogr></biblStruct>
<biblStruct><monogr><title>Book</title><imprint><date when="1999"/></imprint></monogr></biblStruct></listBibl></TEI>"""


def test_tei(spark, tmp_path, rows):
    (tmp_path / "x.xml").write_text(TEI)
    assert rows(files.read_tei(spark, str(tmp_path / "x.xml"))) == [("Book", None, "1999", None, None), ("One", "Ann Lee", "2010", "10.1000/abc", "J")]


def test_json_lines(spark, tmp_path, rows):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nbroken\n{"a": 2}\n')
    assert rows(files.read_json_lines(spark, str(tmp_path / "x.jsonl"), "a int")) == [(1,), (2,)]


def test_reference_section(spark, rows):
    df = spark.createDataFrame([(1, "Text\nReferences\n[1] Smith, A title that is long, 2001.\n[2] Jones, Another title of note,\n 2002.\n"), (2, "none"), (3, None)], "id long, t string")
    assert rows(files.reference_section(df, "id", "t"), "id", "raw") == [(1, "Jones, Another title of note, 2002."), (1, "Smith, A title that is long, 2001.")]


def test_tex_citations(spark, rows):
    df = spark.createDataFrame([(1, "First \\cite{a, b}. % \\cite{z}\nSecond \\citep[see][]{c}.")], "id long, t string")
    assert [r[1] for r in rows(files.tex_citations(df, "id", "t"), "sent_no", "cite_key")] == ["a", "b", "c"]


def test_report(spark):
    df = spark.createDataFrame([(2, "year", "OK"), (1, "title", "FAIL")], "ref_id long, field string, status string")
    assert files.report(df).first().line == "- **FAIL** reference 1: title"


def test_registry_source(spark, tmp_path, rows):
    data = [("arxiv", "arxiv", "1", "{}"), ("crossref", "doi", "d", json.dumps({"t": 1})), ("epo", "patent_number", "p", "{}")]
    spark.createDataFrame(data, "registry string, id_type string, id_value string, entity string").write.parquet(str(tmp_path / "s"))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(registry.RegistrySource)
    load = lambda **o: spark.read.format("citeloom_registry").options(path=str(tmp_path / "s"), **o).load()
    assert rows(load(), "registry") == [("arxiv",), ("crossref",), ("epo",)]
    assert rows(load(domain="academic").where("id_type = 'doi' AND id_value IN ('d', 'e')"), "registry") == [("crossref",)]
    assert len(registry.REGISTRIES) == 61


OAI = """<OAI-PMH><ListRecords>
<record><header><identifier>a</identifier></header><metadata><oai_dc:dc xmlns:oai_dc="u" xmlns:dc="v"><dc:title>One</dc:title><dc:creator>Lee, A</dc:creator><dc:creator>Kim, B</dc:creator><dc:date>2003-02-01</dc:date><dc:identifier>https://doi.org/10.1000/z</dc:identifier></oai_dc:dc></metadata></record>
<record><header status="deleted"><identifier>b</identifier></header></record>
<record><header><identifier>c</identifier></header><metadata><oai_dc:dc xmlns:oai_dc="u" xmlns:dc="v"><dc:creator>X</dc:creator></oai_dc:dc></metadata></record></ListRecords></OAI-PMH>"""


def test_oai(spark, tmp_path, rows):
    (tmp_path / "x.xml").write_text(OAI)
    assert rows(files.read_oai(spark, str(tmp_path / "x.xml")), "identifier", "title", "authors", "year", "doi") == [("a", "One", ["Lee, A", "Kim, B"], 2003, "10.1000/z")]


def test_harvest_goes_on(spark, tmp_path):
    (tmp_path / "in").mkdir()

    def run(name):
        (tmp_path / "in" / f"{name}.jsonl").write_text(json.dumps({"id": name}) + "\n")
        q = files.harvest(spark, str(tmp_path / "in"), "id string").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(60)
        return sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run("a") == ["a"]
    assert run("b") == ["a", "b"]
