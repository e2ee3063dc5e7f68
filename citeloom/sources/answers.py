"""Entities from the answers of registries, one table of paths for each registry.

What a registry answers for one work is JSON or XML of its own shape. A reading names the
paths of title, authors, year, venue and identifiers in it; parsing is `get_json_object`,
`from_json` and `xpath`, so it stays in the JVM and one plan serves all registries.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Reading:
    """Paths of one registry's answer.

    authors: a path and how names stand there: 'texts', 'one', ';' (one text with
    semicolons), a field of objects ('name', 'author.display_name'), or 'given+family'.
    venue: paths, or with a leading '=' a constant. xml: paths are XPath.
    """

    title: tuple[str, ...]
    authors: tuple[str, str] | None = None
    year: tuple[str, ...] = ()
    venue: tuple[str, ...] = ()
    ids: dict[str, str] = field(default_factory=dict)
    xml: bool = False


_OAI = Reading(("//title/text()",), ("//creator/text()", "texts"), ("//date/text()",), (), {"oai_id": "//identifier/text()"}, xml=True)
# Where each registry's answer holds what.
READINGS = {
    "arxiv": Reading(("/entry/title/text()",), ("/entry/author/name/text()", "texts"), ("/entry/published/text()",), ("=arXiv",), {"arxiv": "/entry/id/text()"}, xml=True),
    "base": _OAI,
    "biorxiv": Reading(("$.title",), ("$.authors", ";"), ("$.date",), ("=bioRxiv",), {"doi": "$.biorxiv_doi"}),
    "cinii": Reading(("$['dc:title']",), ("$['dc:creator']", "texts"), ("$['prism:publicationDate']",), ("$['prism:publicationName']",), {"doi": "$['prism:doi']", "naid": "$['dc:identifier']"}),
    "clinicaltrials": Reading(("$.protocolSection.identificationModule.officialTitle", "$.protocolSection.identificationModule.briefTitle"), ("$.protocolSection.sponsorCollaboratorsModule.leadSponsor.name", "one"), ("$.protocolSection.statusModule.startDateStruct.date",), ("=ClinicalTrials.gov",), {"nct_id": "$.protocolSection.identificationModule.nctId"}),
    "core": Reading(("$.title",), ("$.authors", "name"), ("$.yearPublished",), ("$.publisher",), {"doi": "$.doi"}),
    "crossref": Reading(("$.title[0]",), ("$.author", "given+family"), ("$.issued.date-parts[0][0]",), ("$.container-title[0]",), {"doi": "$.DOI"}),
    "cyberleninka": _OAI,
    "datacite": Reading(("$.titles[0].title",), ("$.creators", "name"), ("$.publicationYear",), ("$.publisher",), {"doi": "$.doi"}),
    "dblp": Reading(("$.info.title",), ("$.info.authors.author", "text"), ("$.info.year",), ("$.info.venue",), {"doi": "$.info.doi", "dblp_key": "$.info.key"}),
    "dergipark": Reading(("$.title",), ("$.authors", "name"), ("$.year", "$.publicationYear"), ("$.journal", "$.journalTitle"), {"doi": "$.doi"}),
    "dialnet": _OAI,
    "diva": _OAI,
    "doaj": Reading(("$.bibjson.title",), ("$.bibjson.author", "name"), ("$.bibjson.year",), ("$.bibjson.journal.title",), {"doi": "$.bibjson.identifier[0].id"}),
    "europe_pmc": Reading(("$.title",), ("$.authorList.author", "fullName"), ("$.pubYear",), ("$.journalTitle",), {"doi": "$.doi", "pmid": "$.pmid"}),
    "europeana": Reading(("$.title[0]",), ("$.dcCreator", "texts"), ("$.year[0]",), ("$.dataProvider[0]",), {"europeana_id": "$.id"}),
    "garuda": _OAI,
    "hal": Reading(("$.title_s[0]", "$.title_s"), ("$.authFullName_s", "texts"), ("$.producedDateY_i",), ("$.journalTitle_s",), {"doi": "$.doiId_s", "hal_id": "$.halId_s"}),
    "inspire_hep": Reading(("$.metadata.titles[0].title",), ("$.metadata.authors", "full_name"), ("$.metadata.earliest_date",), ("$.metadata.publication_info[0].journal_title",), {"doi": "$.metadata.dois[0].value"}),
    "jstage": Reading(("/entry/title/text()", "/entry/article_title/text()"), ("/entry/author/name/text()", "texts"), ("/entry/pubyear/text()",), ("/entry/cdjournal/text()",), {"doi": "/entry/doi/text()"}, xml=True),
    "kci": Reading(("/record/articleTitle/text()",), ("/record/author/text()", "texts"), ("/record/pubYear/text()",), ("/record/journalTitle/text()",), {"doi": "/record/doi/text()"}, xml=True),
    "nasa_ads": Reading(("$.title[0]",), ("$.author", "texts"), ("$.year",), ("$.pub",), {"doi": "$.doi[0]", "bibcode": "$.bibcode"}),
    "openalex": Reading(("$.title",), ("$.authorships", "author.display_name"), ("$.publication_year",), ("$.primary_location.source.display_name",), {"doi": "$.doi", "openalex": "$.id"}),
    "persee": Reading(("$.title",), ("$.author", ";"), ("$.year",), ("$.journal",), {"doi": "$.doi", "persee_id": "$.perseeId"}),
    "pubmed": Reading(("//Article/ArticleTitle/text()",), ("//AuthorList/Author/CollectiveName/text()", "texts"), ("//Journal/JournalIssue/PubDate/Year/text()",), ("//Journal/Title/text()",), {"doi": "//ArticleId[@IdType='doi']/text()"}, xml=True),
    "redalyc": _OAI,
    "scielo": Reading(("$.title",), ("$.authors", "name"), ("$.year", "$.publication_year"), ("$.journal", "$.journal_title"), {"doi": "$.doi", "pid": "$.pid"}),
    "semantic_scholar": Reading(("$.title",), ("$.authors", "name"), ("$.year",), ("$.venue",), {"doi": "$.externalIds.DOI", "arxiv": "$.externalIds.ArXiv", "pmid": "$.externalIds.PubMed"}),
    "shodhganga": _OAI,
    "theses_fr": Reading(("$.title",), ("$.author", "one"), ("$.year",), ("$.discipline",), {"nnt": "$.nnt"}),
    "unpaywall": Reading(("$.title",), ("$.z_authors", "given+family"), ("$.year",), ("$.journal_name",), {"doi": "$.doi"}),
    "zbmath": Reading(("$.title",), ("$.authors", "name"), ("$.year",), ("$.source.series",), {"doi": "$.doi", "zbmath_id": "$.id"}),
    "zenodo": Reading(("$.metadata.title",), ("$.metadata.creators", "name"), ("$.metadata.publication_date",), (), {"doi": "$.metadata.doi", "zenodo_id": "$.id"}),
    "epo": Reading(("//invention-title/text()",), ("//applicant/applicant-name/name/text()", "texts"), ("//publication-date/text()",), (), {"patent_number": "//doc-number/text()"}, xml=True),
    "kipris": Reading(("//inventionTitle/text()",), ("//applicantName/text()", "texts"), ("//openDate/text()",), (), {"patent_number": "//applicationNumber/text()"}, xml=True),
    "lens": Reading(("$.title",), ("$.authors", "display_name"), ("$.year_published",), ("$.source.title",), {"doi": "$.external_ids[0].value"}),
    "uspto": Reading(("$.patent_title",), None, ("$.patent_date",), ("=USPTO",), {"patent_number": "$.patent_id"}),
    "courtlistener": Reading(("$.case_name", "$.caseName"), None, ("$.date_filed", "$.dateFiled"), ("$.court",), {"courtlistener_id": "$.id"}),
    "eurlex": Reading(("$.title.value",), None, ("$.date.value",), ("=EUR-Lex",), {"celex": "$.celex.value"}),
    "federal_register": Reading(("$.title",), ("$.agencies", "name"), ("$.publication_date",), ("=Federal Register",), {"fr_document_number": "$.document_number"}),
    "govinfo": Reading(("$.title",), None, ("$.dateIssued",), ("=GovInfo",), {"govinfo_package": "$.packageId"}),
    "indian_kanoon": Reading(("$.title",), None, ("$.publishdate",), ("$.docsource",), {"case_cite": "$.tid"}),
    "korean_law": Reading(("$.lawNm",), None, ("$.proclamationDate",), (), {"law_id": "$.lawId"}),
    "legifrance": Reading(("$.title", "$.titre"), None, ("$.datePubli", "$.dateTexte"), (), {"eli": "$.cid"}),
    "open_legal_de": Reading(("$.name",), None, ("$.date",), ("$.court.name",), {"case_cite": "$.file_number"}),
    "egov_japan": Reading(("//LawName/text()",), None, ("//PromulgationDate/text()",), (), {"law_number": "//LawNo/text()"}, xml=True),
    "estat_japan": Reading(("$.TITLE['$']", "$.TITLE"), None, ("$.SURVEY_DATE",), (), {"stat_id": "$['@id']"}),
    "imf": Reading(("$.label",), None, (), ("=IMF DataMapper",), {"imf_indicator": "$.id"}),
    "un_digital_library": Reading(("//datafield[@tag='245']/subfield[@code='a']/text()",), None, ("//datafield[@tag='269']/subfield[@code='a']/text()",), (), {"un_doc_symbol": "//datafield[@tag='191']/subfield[@code='a']/text()"}, xml=True),
    "who_gho": Reading(("$.IndicatorName",), None, (), ("=WHO GHO",), {"gho_indicator": "$.IndicatorCode"}),
    "world_bank": Reading(("$.name",), None, (), ("=World Bank",), {"indicator": "$.id"}),
    "edgar": Reading(("$.display_names[0]", "$.file_description"), None, ("$.file_date",), ("=SEC EDGAR",), {"accession_number": "$.file_num"}),
    "fred": Reading(("$.title",), None, ("$.observation_start",), ("=FRED",), {"fred_series": "$.id"}),
    "inpi": Reading(("$.title",), ("$.applicant", "one"), ("$.publicationDate",), (), {"patent_number": "$.publicationNumber"}),
    "ietf_rfc": Reading(("$.title",), None, ("$.time",), ("=IETF",), {"rfc_number": "$.name"}),
    "nist": Reading(("$.cve.descriptions[0].value",), None, ("$.cve.published",), ("=NVD",), {"cve": "$.cve.id"}),
    "open_library": Reading(("$.title",), ("$.author_name", "texts"), ("$.first_publish_year",), ("$.publisher[0]",), {"isbn": "$.isbn[0]"}),
    "wikidata": Reading(("$.labels.en.value",), None, (), (), {"wikidata": "$.id"}),
}


def _first(body: str, paths: tuple[str, ...], xml: bool) -> Column:
    """The first of the paths that holds text; null where none does."""
    if not paths:
        return F.lit(None).cast("string")
    if paths[0].startswith("="):
        return F.lit(paths[0][1:])
    read = (lambda p: F.xpath_string(F.col(body), F.lit(p))) if xml else (lambda p: F.get_json_object(body, p))
    # a null inside an array is read as the word
    return F.coalesce(*(F.nullif(F.nullif(F.trim(read(p)), F.lit("")), F.lit("null")) for p in paths))


def _authors(body: str, spec: tuple[str, str] | None, xml: bool) -> Column:
    if spec is None:
        return F.lit(None).cast("array<string>")
    path, kind = spec
    if xml:
        names = F.xpath(F.col(body), F.lit(path))
    else:
        raw = F.get_json_object(body, path)
        if kind == "texts":  # one text may stand in place of a list
            names = F.when(raw.startswith("["), F.from_json(raw, "array<string>")).otherwise(F.array(raw))
        elif kind == "one":
            names = F.array(raw)
        elif kind == ";":
            names = F.split(raw, ";")
        elif kind == "given+family":
            names = F.transform(F.from_json(raw, "array<struct<given:string,family:string>>"), lambda a: F.concat_ws(" ", a.given, a.family))
        else:
            keys = kind.split(".")
            shape = "string"
            for k in reversed(keys):
                shape = f"struct<`{k}`:{shape}>"
            names = F.transform(F.from_json(raw, f"array<{shape}>"), lambda a: a[keys[0]] if len(keys) == 1 else a[keys[0]][keys[1]])
    return F.filter(F.transform(names, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def parse(answers: DataFrame, registry: str, readings: dict[str, Reading] = READINGS) -> DataFrame:
    """(rec_id, registry, title, authors, year, venue, ids) of one registry's answers (rec_id, body).

    Answers without a title, and those that are no JSON or XML, give no row. ids maps kinds
    of identifiers to values.
    """
    r = readings[registry]
    year = F.nullif(F.regexp_extract(_first("body", r.year, r.xml), r"((?:1[89]|20)\d\d|2100)", 1), F.lit(""))
    ids = F.map_filter(F.create_map(*(x for k, p in r.ids.items() for x in (F.lit(k), _first("body", (p,), r.xml)))), lambda k, v: v.isNotNull())
    ok = F.col("body").startswith("<") if r.xml else F.try_parse_json("body").isNotNull()
    parsed = answers.where(ok).select("rec_id", F.lit(registry).alias("registry"), _first("body", r.title, r.xml).alias("title"), _authors("body", r.authors, r.xml).alias("authors"), year.alias("year"), _first("body", r.venue, r.xml).alias("venue"), ids.alias("ids"))
    return parsed.where("title IS NOT NULL")


def _steps(path: str) -> list[str | int]:
    import re

    return [int(m[2]) if m[2] else m[1] or m[3] for m in re.finditer(r"\.([^.\[\]]+)|\[(\d+)\]|\['([^']+)'\]", path)]


def _nest(leaves: dict[tuple, Column]) -> Column:
    """A struct or array of the leaves by their steps."""
    if () in leaves:
        return leaves[()]
    by: dict = {}
    for steps, c in leaves.items():
        by.setdefault(steps[0], {})[steps[1:]] = c
    if all(isinstance(k, int) for k in by):
        return F.array(*(_nest(by[k]) for k in sorted(by)))
    return F.struct(*(_nest(v).alias(k) for k, v in by.items()))


def render(works: DataFrame, registry: str, readings: dict[str, Reading] = READINGS) -> DataFrame:
    """(rec_id, body): works (rec_id, title, authors, year, venue, id) as the registry would answer; the inverse of parse().

    For snapshots and round trips. JSON registries only.
    """
    r = readings[registry]
    leaves = {tuple(_steps(r.title[0])): F.col("title")}
    if r.authors:
        path, kind = r.authors
        if kind == "one":
            value = F.try_element_at("authors", F.lit(1))
        elif kind == ";":
            value = F.array_join("authors", "; ")
        elif kind == "texts":
            value = F.col("authors")
        elif kind == "given+family":
            value = F.transform("authors", lambda a: F.struct(a.alias("family")))
        else:
            keys = kind.split(".")
            value = F.transform("authors", lambda a: F.struct(a.alias(keys[0])) if len(keys) == 1 else F.struct(F.struct(a.alias(keys[1])).alias(keys[0])))
        leaves[tuple(_steps(path))] = value
    for paths, c in ((r.year, "year"), (r.venue, "venue")):
        if paths and not paths[0].startswith("="):
            leaves[tuple(_steps(paths[0]))] = F.col(c)
    for p in r.ids.values():
        leaves[tuple(_steps(p))] = F.col("id")
    return works.select("rec_id", F.to_json(_nest(leaves)).alias("body"))
