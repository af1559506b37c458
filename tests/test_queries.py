"""Every registered query that has SQL, against another engine on the same tables; the others run and have columns."""

import math
import os

import pytest

from layerlode.plans import catalogue

FOLDER = os.environ.get("QUERY_TABLES", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables aren't here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return [plain(x) for x in v] if isinstance(v, list | tuple) else v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    cursor = duck.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(names, cursor.fetchall())


#: The other queries without SQL have tests of their own in this folder.
RUN = ("tokenizer_ngrams", "embedded_names", "rename_groups", "model_round_trip", "longest_keyphrases", "mutual_reachability_tree")


@pytest.mark.parametrize("name", RUN)
def test_query_runs(spark, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    assert df.columns and df.count() >= 0


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(catalogue.QUERIES) <= set(e.queries())
    assert e.entry(spark).count() == 10
