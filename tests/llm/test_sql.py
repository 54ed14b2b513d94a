"""The queries of the package that have SQL, against it."""

import pytest

from compare import connect, difference
from conftest import SF
from tagspark.llm.queries import llm_oracles, llm_queries


@pytest.mark.parametrize("name", sorted(llm_oracles()))
def test_query_equals_sql(spark, name):
    assert difference(llm_queries()[name](spark, SF), connect(SF), llm_oracles()[name]) is None
