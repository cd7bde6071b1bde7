import pytest

import corpus_pipeline
from panelcast.llm import queries as Q
from tests.oracle import compare, duck

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_query_equals_sql(spark, name):
    res = compare(spark, duck(FOLDER), Q.QUERIES[name], Q.ORACLE[name], FOLDER)
    assert res["ok"], res.get("why")


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in Q.QUERIES) == list(range(1, 14))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
