import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from layerlode.llm.mixing import DIMENSIONS, cell_probabilities, mix_documents, rake, sample_documents

from tests.llm.conftest import prose


def facts(spark):
    rng = np.random.default_rng(3)
    rows = [(f"s{a}", f"l{b}", f"t{c}", int(rng.integers(50, 5000))) for a in range(4) for b in range(3) for c in range(3)]
    return spark.createDataFrame(rows, "source string, lang string, topic string, tokens bigint")


TARGETS = {"source": {"s0": 0.4, "s1": 0.3, "s2": 0.2, "s3": 0.1}, "lang": {"l0": 0.6, "l1": 0.3, "l2": 0.1}, "topic": {"t0": 1 / 3, "t1": 1 / 3, "t2": 1 / 3}}


@pytest.mark.parametrize("driver_rows", [1_000_000, 0])
def test_marginals_meet_the_targets(spark, driver_rows):
    df = facts(spark)
    iterations = 60 if driver_rows else 5
    cells = cell_probabilities(df, TARGETS, iterations=iterations, driver_rows=driver_rows).join(df, list(DIMENSIONS)).toPandas()
    cells["w"] = cells["weight"] * cells["tokens"]
    for d in DIMENSIONS:
        shares = cells.groupby(d)["w"].sum() / cells["w"].sum()
        for value, want in TARGETS[d].items():
            assert shares[value] == pytest.approx(want, abs=1e-9 if driver_rows else 2e-3)
    assert cells["probability"].max() == pytest.approx(1)
    frame = df.orderBy(*DIMENSIONS).toPandas()
    plain = dict(zip(map(tuple, frame[list(DIMENSIONS)].to_numpy()), rake(frame, TARGETS, iterations), strict=True))
    for r in cells.itertuples():
        assert r.weight == pytest.approx(plain[r.source, r.lang, r.topic], rel=1e-9)


def test_sampled_tokens_come_near_the_targets(spark):
    rng = np.random.default_rng(1)
    rows = [(i, prose(i % 50, 30), f"l{rng.choice(3, p=[0.7, 0.2, 0.1])}", f"s{rng.choice(4, p=[0.6, 0.2, 0.1, 0.1])}", 1) for i in range(6000)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]))
    vectors = spark.range(6000).select(F.col("id").alias("vec_id"), (F.col("id") % 3).cast("int").alias("label"))
    topics = {str(i): 1 / 3 for i in range(3)}
    out = mix_documents(df, vectors, {"source": TARGETS["source"], "lang": TARGETS["lang"], "topic": topics}).toPandas()
    for d in ("source", "lang"):
        shares = out.groupby(d)["n_tokens"].sum() / out["n_tokens"].sum()
        for value, want in TARGETS[d].items():
            assert shares[value] == pytest.approx(want, abs=0.05)
    again = mix_documents(df.repartition(7), vectors, {"source": TARGETS["source"], "lang": TARGETS["lang"], "topic": topics}).toPandas()
    assert set(again["doc_id"]) == set(out["doc_id"])


def test_tables_without_tokens(spark):
    df = spark.createDataFrame([(1, "", "en", "s", 0), (2, None, "en", "s", 0)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    vectors = spark.createDataFrame([], "vec_id bigint, label int")
    assert mix_documents(df, vectors).count() == 0


def test_one_odd_row_leaves_the_others(spark):
    rng = np.random.default_rng(5)
    texts = [prose(i, 30) for i in range(50)]
    rows = [(i, texts[i % 50], ["en", "fr"][int(rng.random() < 0.3)], f"s{rng.choice(3, p=[0.6, 0.3, 0.1])}") for i in range(3000)]
    vectors = spark.range(3000).select(F.col("id").alias("vec_id"), (F.col("id") % 3).cast("int").alias("label"))
    kind = "doc_id bigint, text string, lang string, source string"
    plain = sample_documents(spark.createDataFrame(rows, kind), vectors).count()
    odd = sample_documents(spark.createDataFrame([*rows, (3000, "just three words", "en", None)], kind), vectors)
    assert plain == pytest.approx(1500, rel=0.08) and odd.count() == pytest.approx(plain, rel=0.05)
    assert odd.where("doc_id = 3000").count() == 1


@pytest.mark.parametrize("driver_rows", [1_000_000, 0])
def test_kept_tokens_meet_the_budget_and_the_targets(spark, driver_rows):
    df = facts(spark).unionByName(spark.createDataFrame([("odd", "l0", "t0", 3)], "source string, lang string, topic string, tokens bigint"))
    targets = TARGETS | {"source": {"s0": 0.3, "s1": 0.3, "s2": 0.2, "s3": 0.1, "odd": 0.1}}
    cells = cell_probabilities(df, targets, iterations=60 if driver_rows else 4, driver_rows=driver_rows, keep=0.3).join(df, list(DIMENSIONS)).toPandas()
    assert cells["probability"].max() <= 1 + 1e-9
    cells["w"] = cells["probability"] * cells["tokens"]
    assert cells["w"].sum() == pytest.approx(0.3 * cells["tokens"].sum(), rel=1e-6)
    assert cells.loc[cells["source"] == "odd", "probability"].item() == pytest.approx(1, abs=0.02)
    shares = cells.groupby("source")["w"].sum() / cells["w"].sum()
    for value in ("s0", "s1", "s2", "s3"):
        assert shares[value] == pytest.approx(targets["source"][value] / 0.9, abs=0.02)
