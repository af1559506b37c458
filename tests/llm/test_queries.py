"""The registered queries that have SQL, against another engine on the same tables."""

import os

import pytest

from layerlode.llm.queries import ORACLE_SQL, QUERIES
from tests.test_queries import FOLDER, duck, rows_of  # noqa: F401

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables aren't here")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):  # noqa: F811
    df = QUERIES[name](spark, FOLDER)
    cursor = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(names, cursor.fetchall())


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
