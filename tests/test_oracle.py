import oracle
import pytest

from wayloom.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return oracle.database(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE_SQL:
        assert oracle.difference(df, ORACLE_SQL[name], db) is None
    else:
        assert df.count() >= 0
