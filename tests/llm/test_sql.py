import pytest
from check import compare, duck

from tickloom.llm import merkle, mixing, veccodes
from tickloom.llm.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", ["op1_mix_sources", "op5_merkle_fingerprints", "op11_vector_codes"])
def test_query_equals_sql(spark, sf, name):
    assert mixing and merkle and veccodes
    df = QUERIES[name](spark, sf)
    res = duck(sf).execute(ORACLES[name])
    assert compare(df.columns, [tuple(r) for r in df.collect()], [c[0] for c in res.description], res.fetchall()) == ""
