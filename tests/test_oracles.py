import pytest

from loomline.plans import catalogue
from tests.compare import differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_like_the_oracle(spark, name):
    found = differences(catalogue.QUERIES[name](spark, SF), SF, catalogue.ORACLES[name])
    assert not [f for f in found if f != "no rows"]


def test_every_oracle_has_a_query():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES) and catalogue.FLAGSHIP in catalogue.QUERIES
