import pytest
from helpers import SMALL
from twin_check import difference, duck

import __spark_entry__ as entry_points
from tidemark.llm.queries import llm_oracles, llm_queries


@pytest.mark.parametrize("name", sorted(llm_oracles()))
def test_twin(spark, name):
    assert difference(llm_queries()[name](spark, SMALL), duck(SMALL), llm_oracles()[name]) is None


def test_registered():
    names = entry_points.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in llm_queries()} == {f"op{i}" for i in range(1, 14)}
