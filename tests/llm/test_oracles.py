import pytest

from loomline.llm import queries
from tests.compare import differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_like_the_oracle(spark, name):
    assert not differences(queries.QUERIES[name](spark, SF), SF, queries.ORACLES[name])
