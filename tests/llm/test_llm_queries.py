import pytest
from conftest import rows_of

from boxfold.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_twin(spark, sf, duck, name):
    ours = queries.QUERIES[name](spark, sf).toPandas()
    assert rows_of(ours) == rows_of(duck.execute(queries.SQL[name]).fetchdf())


COLUMNS = {"p1_found": ["field", "code", "mark"], "p3_found": ["sid_a", "sid_b"], "p4_found": ["target_id", "category"], "p6_found": ["spec_id", "doc_id"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id_a", "doc_id_b"]}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).columns == COLUMNS[name]
