import pytest

from quillspark.catalog import ORACLE_SQL, QUERIES

from .oracle import assert_same


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(spark, sf, name):
    df = QUERIES[name](spark, sf)
    if name in ORACLE_SQL:
        assert_same(df, ORACLE_SQL[name], sf)
    else:
        assert df.count() > 0
