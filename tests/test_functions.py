import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from citeloom.functions import similarity as S
from citeloom.functions import text as X


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f("v").alias("r")).first().r


@pytest.mark.parametrize(("value", "kind"), [("10.1000/x", "doi"), ("2301.12345v2", "arxiv"), ("hep-th/0401234", "arxiv"), ("123", "pmid"), ("US 7", "patent_number"), ("RFC 2616", "rfc_number"), ("CVE-2020-1", "cve"), ("32022R2065", "celex"), ("ISO 9001", "iso_number"), ("978-3-16-148410-0", "isbn"), ("0001234567", "isbn"), ("410 U.S. 113", "case_cite"), ("0000-0002-1825-0097", "orcid"), ("", None), (None, None)])
def test_id_type(spark, value, kind):
    assert one(spark, value, X.id_type) == kind


@pytest.mark.parametrize(("value", "doi"), [("https://doi.org/10.1000/A", "10.1000/A"), (" doi: 10.1000/a\n", "10.1000/a"), ("10.1/a", None), (None, None)])
def test_clean_doi(spark, value, doi):
    assert one(spark, value, X.clean_doi) == doi


def test_texts(spark):
    assert one(spark, "Smith, Jane", X.surname) == "Smith"
    assert one(spark, "Jane  van Smith", X.surname) == "Smith"
    assert one(spark, "A and  B and ", X.authors) == ["A", "B"]
    assert one(spark, r"\emph{A} {B} \& $x$", X.strip_latex) == "A B & x"
    assert one(spark, r"x~\cite{a,b} y [1, 2]", X.mask_citations) == "x [CIT] y [CIT]"
    assert one(spark, "See Fig. 2. It falls. Good!", X.sentences) == ["See Fig. 2.", "It falls.", "Good!"]
    assert one(spark, "J. Mach. Learn. Res.  2", X.venue_name) == "journal of machine learning research"
    assert one(spark, None, X.title_key) is None
    assert spark.range(1).select(X.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"))).alias("r")).first().r == 0.5
    assert spark.range(1).select(X.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("r")).first().r == 0


def test_similarities():
    assert round(S.jaro_winkler_score("MARTHA", "MARHTA"), 4) == 0.9611
    assert round(S.jaro_winkler_score("DIXON", "DICKSONX"), 4) == 0.8133
    assert S.jaro_winkler_score("", "a") == 0 and S.jaro_winkler_score("", "") == 1
    assert S.token_set_score("a b", "b a c") == 1
    assert S.indel_ratio("abc", "abd") == pytest.approx(66.6667, abs=1e-3)


@pytest.mark.parametrize(("args", "p"), [(("t", 2.086, 20, 0), 0.05), (("F", 4.351, 1, 20), 0.05), (("chi2", 3.8415, 1, 0), 0.05), (("Z", 1.95996, 0, 0), 0.05), (("chi2", 15.507, 8, 0), 0.05), (("F", 0, 3, 9), 1.0), (("t", 0, 5, 0), 1.0)])
def test_p_values(args, p):
    assert S.p_value_of(*args) == pytest.approx(p, abs=2e-5)


def test_p_value_of_unknown():
    assert math.isnan(S.p_value_of("x", 1, 1, 1))


def test_jaro_winkler_of_many():
    r = random.Random(1)
    some = [None, *("".join(r.choice("aabbcé" if r.random() < 0.1 else "aabbc") for _ in range(r.choice((0, 1, 2, 3, 5, 8)))) for _ in range(40))]
    a, b = ([r.choice(some) for _ in range(6000)] for _ in range(2))
    got = S.jaro_winkler_scores(pa.array(a), pa.array(b), 50)
    assert [None if math.isnan(v) else v for v in got] == [None if x is None or y is None else S.jaro_winkler_score(x, y) for x, y in zip(a, b)]
    assert len(S.jaro_winkler_scores(pa.array([], pa.string()), pa.array([], pa.string()))) == 0


def test_names_are_compared_in_many_tasks_and_once(spark):
    """Short tables make many pairs, so the size of the tables must not set the number of tasks."""
    from citeloom.plans.text_queries import jaro_winkler_names

    df = jaro_winkler_names(spark, "/root/testdata/sf0.001")
    assert df.rdd.getNumPartitions() >= 48
    assert df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
