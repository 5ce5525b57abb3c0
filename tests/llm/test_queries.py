import pytest

from tests.oracle import compare, connect
from veinstone.llm import queries


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_on_the_smallest_tables(spark, sf, name):
    df = queries.queries()[name](spark, sf)
    if name in queries.oracle_sql():
        compare(df, queries.oracle_sql()[name], connect(sf))
    else:
        assert df.count() > 0


@pytest.mark.parametrize("name,columns", [("p1_found", "chunk_id_a chunk_id_b"), ("p3_found", "id"), ("p4_found", "field id_a id_b"), ("p6_found", "source_table id"), ("p7_ids", "doc_id ids"), ("p9_found", "doc_id")])
def test_columns(spark, sf, name, columns):
    assert queries.queries()[name](spark, sf).columns == columns.split()
