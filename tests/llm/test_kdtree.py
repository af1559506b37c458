import random

import pytest

from layerlode.llm.kdtree import kd_tree_shards, write_shards

from tests.llm.conftest import prose


def brute(rows, target):
    """rows: (id, bytes, coordinates). The tree by plain recursion."""
    dims = len(rows[0][2])
    span = [max(r[2][d] for r in rows) - min(r[2][d] for r in rows) for d in range(dims)]
    out = {}

    def split(own, path):
        widths = [(max(r[2][d] for r in own) - min(r[2][d] for r in own)) / span[d] if span[d] else 0 for d in range(dims)]
        if sum(r[1] for r in own) <= target or max(widths) == 0:
            out.update({r[0]: path for r in own})
            return
        axis = widths.index(max(widths))
        total, run = sum(r[1] for r in own), 0
        values = sorted({r[2][axis] for r in own})
        for v in values:
            run += sum(r[1] for r in own if r[2][axis] == v)
            if 2 * run >= total:
                break
        cut = v if v != values[-1] else values[-2]
        split([r for r in own if r[2][axis] <= cut], path + "0")
        split([r for r in own if r[2][axis] > cut], path + "1")

    split(rows, "")
    return out


@pytest.mark.parametrize("local_rows", [10, 100_000])
def test_shards_equal_brute_force(spark, local_rows):
    r = random.Random(5)
    rows = [(i, prose(i, r.randint(1, 60)), r.choice(["a", "b", None, "c"]), r.choice(["s1", "s2"]), r.choice([10, 20, 30, r.randint(0, 10**6)])) for i in range(160)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    langs, sources = {None: 0, "a": 1, "b": 2, "c": 3}, {"s1": 1, "s2": 2}
    want = brute([(i, len(t.encode()), (n, sources[s], langs[g], i)) for i, t, g, s, n in rows], 2000)
    got = {x["doc_id"]: x["shard_path"] for x in kd_tree_shards(df, target_bytes=2000, local_rows=local_rows).collect()}
    assert got == want


def test_leaves_reach_the_target_and_can_be_written(spark, tmp_path):
    df = spark.createDataFrame([(i, prose(i, 40), "en", f"src{i % 5}", i) for i in range(200)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    shards = kd_tree_shards(df, target_bytes=3000)
    sums = {r["shard_path"]: r["s"] for r in shards.groupBy("shard_path").agg({"bytes": "sum"}).withColumnRenamed("sum(bytes)", "s").collect()}
    assert max(sums.values()) <= 3000 and len(sums) > 1
    write_shards(df, shards, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 200


def shards(spark, rows, kind, dims, target, local_rows):
    df = spark.createDataFrame([(i, "x" * n, *c) for i, n, c in rows], kind)
    return {r["doc_id"]: r["shard_path"] for r in kd_tree_shards(df, dims, target, local_rows).collect()}


@pytest.mark.parametrize("local_rows", [1, 10, 100_000])
def test_numbers_of_any_width(spark, local_rows):
    r = random.Random(3)
    ids = [-(2**62) + k for k in range(3)] + [2**62 - k for k in range(3)] + [0, 1, 2**61, -(2**63), 2**63 - 1] + [r.randrange(-(2**63), 2**63) for _ in range(40)]
    rows = [(i, 100, ()) for i in ids]
    want = brute([(i, 100, (i,)) for i in ids], 150)
    got = shards(spark, rows, "doc_id bigint, text string", ("doc_id",), 150, local_rows)
    assert got == want and len(set(got.values())) == len(ids)


@pytest.mark.parametrize("local_rows", [1, 10, 100_000])
def test_fractions_nan_and_infinities(spark, local_rows):
    r = random.Random(4)
    values = [k / 10 for k in range(10)] + [None, float("nan"), 5e-324, 0.0, -0.5, 1e-300] + [r.random() for _ in range(30)]
    plain = [-1.0 if v is None or v != v else v for v in values]
    got = shards(spark, [(i, 100, (v,)) for i, v in enumerate(values)], "doc_id bigint, text string, score double", ("score",), 150, local_rows)
    assert got == brute([(i, 100, (v,)) for i, v in enumerate(plain)], 150)
    ends = shards(spark, [(i, 100, (v,)) for i, v in enumerate([float("inf"), 1.0, float("-inf"), 2.0, 1e308])], "doc_id bigint, text string, score double", ("score",), 150, local_rows)
    assert len(set(ends.values())) == 5


def test_times_flags_lists_and_text_ids(spark):
    from datetime import date, datetime, timedelta

    rows = [(f"id{i}", 100, (date(2020, 1, 1) + timedelta(days=i % 7), datetime(2021, 1, 1) + timedelta(seconds=i), i % 2 == 0, [i % 3])) for i in range(30)] + [("none", 100, (None, None, None, None)), (None, 100, (None, None, None, None))]
    kind = "doc_id string, text string, day date, at timestamp, flag boolean, tags array<int>"
    for local_rows in (1, 1000):
        got = shards(spark, rows, kind, ("day", "at", "flag", "tags", "doc_id"), 150, local_rows)
        assert len(got) == 32 and len({v for k, v in got.items() if k and k != "none"}) == 30


def test_a_thousand_nodes_by_distributed_counting(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "repeat('x', 10) as text", "hash(id) as n_chars")
    rows = kd_tree_shards(df, ("n_chars",), 30, 2).collect()
    sums = {}
    for r in rows:
        sums[r["shard_path"]] = sums.get(r["shard_path"], 0) + r["bytes"]
    assert len(rows) == 4000 and len(sums) > 1000 and max(sums.values()) <= 30
