import pytest

from quillframe.llm import queries, sql
from tests.oracle import same


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_base_secrets_equal_sql(spark):
    same(spark, lambda spark, sf: queries.op3_secret_scan(spark, sf).drop("spans"), sql.OP3_BASE)
