import pytest

from citeloom.llm.queries import oracle_sql, queries
from tests.gate import FOLDER, compare, here


@here
@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_as_sql(spark, name):
    compare(spark, queries()[name], oracle_sql()[name])


@here
@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_runs(spark, name):
    df = queries()[name](spark, FOLDER)
    assert df.count() == df.distinct().count() or not name.endswith("_found")


COLUMNS = {
    "p1_found": ["name_a", "name_b"], "p2_found": ["src", "row_id", "element", "element_no"], "p4_found": ["src", "keep_id", "copy_id"], "p5_found": ["ref_id", "work_id"],
    "p6_found": ["src", "row_id", "sent_no", "start_pos", "end_pos"], "p7_found": ["spec_id", "doc_id"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_a", "doc_b"],
}


@here
@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    assert queries()[name](spark, FOLDER).columns == COLUMNS[name]
