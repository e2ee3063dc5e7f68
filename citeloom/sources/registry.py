"""A registry of works as a Python data source with pushed-down identifier filters.

Offline it reads a snapshot: a parquet folder of (registry, id_type, id_value, entity).
``spark.read.format("citeloom_registry").option("path", ...).option("name", "...").load()``
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

# What each registry serves: domain, kinds of identifiers, whether it can be searched.
REGISTRIES = {
    "arxiv": ("academic", "arxiv", True), "base": ("academic", "doi oai_id", True), "biorxiv": ("academic", "doi", False), "cinii": ("academic", "doi naid", True), "clinicaltrials": ("academic", "nct_id", True), "core": ("academic", "doi core", True),
    "crossref": ("academic", "doi", True), "cyberleninka": ("academic", "oai_id", False), "datacite": ("academic", "doi", True), "dblp": ("academic", "dblp_key", True), "dergipark": ("academic", "doi", True), "dialnet": ("academic", "oai_id", False),
    "diva": ("academic", "doi oai_id", False), "doaj": ("academic", "doi", True), "europe_pmc": ("academic", "pmid doi pmc", True), "europeana": ("academic", "europeana_id", True), "garuda": ("academic", "oai_id", False), "hal": ("academic", "doi hal_id", True),
    "inspire_hep": ("academic", "doi arxiv", True), "jstage": ("academic", "doi", True), "kci": ("academic", "doi", True), "nasa_ads": ("academic", "doi arxiv bibcode", True), "openalex": ("academic", "doi openalex pmid", True), "opencitations": ("academic", "", False),
    "orcid": ("academic", "orcid", False), "persee": ("academic", "doi persee_id", True), "pubmed": ("academic", "pmid doi", True), "redalyc": ("academic", "oai_id", False), "scielo": ("academic", "doi pid", True), "semantic_scholar": ("academic", "doi arxiv pmid s2_id", True),
    "shodhganga": ("academic", "oai_id", False), "theses_fr": ("academic", "nnt", True), "unpaywall": ("academic", "doi", False), "zbmath": ("academic", "doi zbmath_id", True), "zenodo": ("academic", "doi zenodo_id", True),
    "epo": ("patents", "patent_number", True), "kipris": ("patents", "patent_number", True), "lens": ("patents", "doi patent_number", True), "uspto": ("patents", "patent_number", True), "wipo": ("patents", "patent_number pct_number", False),
    "courtlistener": ("legal", "courtlistener_id case_cite", True), "eurlex": ("legal", "celex", True), "federal_register": ("legal", "fr_document_number", True), "govinfo": ("legal", "govinfo_package public_law", True), "indian_kanoon": ("legal", "case_cite", True),
    "korean_law": ("legal", "law_id", True), "legifrance": ("legal", "celex eli", True), "open_legal_de": ("legal", "case_cite", True), "egov_japan": ("government", "law_number", True), "estat_japan": ("government", "stat_id", True), "imf": ("government", "imf_indicator", True),
    "un_digital_library": ("government", "un_doc_symbol", True), "who_gho": ("government", "gho_indicator", True), "world_bank": ("government", "indicator", True), "edgar": ("financial", "accession_number cik", True), "fred": ("financial", "fred_series", True),
    "inpi": ("financial", "patent_number", True), "ietf_rfc": ("standards", "rfc_number", True), "nist": ("standards", "cve nist_sp", True), "open_library": ("standards", "isbn open_library", True), "wikidata": ("standards", "wikidata doi pmid arxiv patent_number iso_number rfc_number", True),
}


class Slice(InputPartition):
    """One file of the snapshot."""


class SnapshotReader(DataSourceReader):
    """Reads one file per partition and only the row groups that the filters can match."""

    def __init__(self, options: dict[str, str]):
        self.path, self.name, self.domain = options.get("path"), options.get("name"), options.get("domain")
        self.wanted: dict[str, list[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute in (("id_type",), ("id_value",), ("registry",)):
                self._keep(f.attribute[0], [f.value])
            elif isinstance(f, In) and f.attribute == ("id_value",):
                self._keep("id_value", list(f.value))
            else:
                yield f

    def _keep(self, column: str, values: list[str]) -> None:
        """Filters on one column all hold: only the values they share are wanted."""
        held = self.wanted.get(column)
        self.wanted[column] = values if held is None else [v for v in held if v in values]

    def _names(self) -> list[str] | None:
        if self.name:
            return [self.name]
        if self.domain:
            return [n for n, (d, _, _) in REGISTRIES.items() if d == self.domain]
        return None

    def partitions(self) -> list[Slice]:
        import pyarrow.dataset as ds

        return [Slice(f) for f in sorted(ds.dataset(self.path).files)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds

        keep = None
        for column, values in [*self.wanted.items(), *([("registry", self._names())] if self._names() else [])]:
            one = ds.field(column).isin(values)
            keep = one if keep is None else keep & one
        yield from ds.dataset([partition.value]).to_batches(columns=["registry", "id_type", "id_value", "entity"], filter=keep)


class RegistrySource(DataSource):
    """Format `citeloom_registry`; options path, and name or domain of the registries wanted."""

    @classmethod
    def name(cls) -> str:
        return "citeloom_registry"

    def schema(self) -> str:
        return "registry string, id_type string, id_value string, entity string"

    def reader(self, schema) -> SnapshotReader:  # noqa: ANN001
        return SnapshotReader(self.options)
