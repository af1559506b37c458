"""Counts of n-grams by hashes, packed cells and sums of vectors, against plain Python."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from layerlode.functions.text import STOP_WORDS
from layerlode.operators import clustering, grams, keyphrases, ranking


def texts():
    rng = np.random.default_rng(5)
    common = [f"w{i}" for i in (rng.zipf(1.4, 4000) % 60)] + ["the", "of", "été", "don't"] * 60
    rng.shuffle(common)
    out = [" ".join(common[i : i + int(k)]) for i, k in enumerate(rng.integers(0, 90, 120))]
    return [*out, None, "", "the", "one two", "x", "of one two the", "same same same same same", " ".join(common)]


def plain(rows, low=1, high=4, stop=STOP_WORDS):
    import re

    for i, text in rows:
        w = re.findall(r"\w[-'\w]*\w", (text or "").lower())
        for n in range(low, high + 1):
            for k in range(len(w) - n + 1):
                if w[k] not in stop and w[k + n - 1] not in stop:
                    yield i, " ".join(w[k : k + n])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(texts())), "object_id bigint, text string").repartition(3)


def best(counted, most, least=1):
    ranked = sorted(((t, n) for t, n in counted.items() if n >= least), key=lambda x: (-x[1], x[0].encode()))
    return [(k, t, n) for k, (t, n) in enumerate(ranked[:most])]


@pytest.mark.parametrize("run, most, least", [(grams.RUN, 50_000, 2), (40, 30, 1), (200, 100, 2), (40, 5, 1), (300, 400, 3), (40, 50_000, 1)])
def test_vocabulary_equals_plain_counts_however_runs_are_cut(docs, run, most, least):
    tokens = keyphrases.tokens_of(docs)
    counted = grams.top_grams(tokens, most=most, min_occurrences=least, run=run)
    got = sorted(map(tuple, keyphrases._numbered(counted, most).collect()))
    assert got == best(Counter(t for _, t in plain(enumerate(texts()))), most, least)


def test_counts_that_runs_keep_back_are_asked_for(docs, monkeypatch):
    monkeypatch.setattr(grams, "SENT", 0)
    tokens = keyphrases.tokens_of(docs)
    got = sorted(map(tuple, keyphrases._numbered(grams.top_grams(tokens, most=20, run=60), 20).collect()))
    assert got == best(Counter(t for _, t in plain(enumerate(texts()))), 20)


def test_too_many_candidates_are_counted_as_strings(docs, monkeypatch):
    tokens = keyphrases.tokens_of(docs)
    assert grams.top_grams(tokens, most=10, candidates=3) is None
    monkeypatch.setattr(keyphrases, "top_grams", lambda *a: None)
    assert sorted(map(tuple, keyphrases.vocabulary_of(tokens, max_features=50).collect())) == best(Counter(t for _, t in plain(enumerate(texts()))), 50)


def test_ties_of_the_last_count_stay(docs):
    counted = Counter(t for _, t in plain(enumerate(texts())))
    least = sorted(counted.values(), reverse=True)[39]
    got = {tuple(r) for r in keyphrases.tie_keeping_top_of(keyphrases.tokens_of(docs), 40).collect()}
    assert got == {(t, n) for t, n in counted.items() if n >= least}


@pytest.mark.parametrize("low, high, stop", [(1, 4, STOP_WORDS), (2, 3, ()), (1, 1, ("w1",))])
def test_cells_equal_plain_counts(docs, low, high, stop):
    tokens = keyphrases.tokens_of(docs)
    terms = keyphrases.vocabulary_of(tokens, low, high, stop, 70)
    ids = {r["term"]: r["term_id"] for r in terms.collect()}
    got = sorted(map(tuple, grams.unpacked(keyphrases.packed_counts_of(tokens, terms, low, high, stop, 70), "object_id").collect()))
    want = Counter((i, ids[t]) for i, t in plain(enumerate(texts()), low, high, stop) if t in ids)
    assert got == sorted((i, t, n) for (i, t), n in want.items())


def test_rows_of_one_id_are_one_object(spark):
    tokens = keyphrases.tokens_of(spark.createDataFrame([(1, "red fish"), (1, "red dog"), (2, "red red"), (None, "dog dog")], "object_id bigint, text string"))
    terms = spark.createDataFrame([(0, "red"), (7, "dog"), (3, None), (5, "red fish"), (6, "")], "term_id int, term string")
    got = {tuple(r) for r in grams.unpacked(keyphrases.packed_counts_of(tokens, terms), "object_id").collect()}
    assert got == {(1, 0, 2), (1, 7, 1), (1, 5, 1), (2, 0, 2), (None, 7, 2)}


def test_no_texts(spark):
    tokens = keyphrases.tokens_of(spark.createDataFrame([(1, None), (2, "x")], "object_id bigint, text string"))
    terms = keyphrases.vocabulary_of(tokens)
    assert terms.count() == 0 and keyphrases.packed_counts_of(tokens, terms).count() == 0
    none = tokens.limit(0)
    assert keyphrases.vocabulary_of(none).count() == 0 and keyphrases.tie_keeping_top_of(none, 5).count() == 0


def cells_of(spark):
    rng = np.random.default_rng(2)
    return [(int(i), int(t), int(n)) for i in range(40) for t, n in zip(rng.choice(3000, 30, replace=False), rng.integers(1, 5, 30), strict=True)]


@pytest.mark.parametrize("kind", ["cells", "packed"])
def test_term_vectors_equal_plain_means(spark, kind):
    cells = cells_of(spark)
    x = np.random.default_rng(3).normal(size=(38, 5))
    counts = spark.createDataFrame(cells, "object_id bigint, term_id int, n bigint").repartition(3)
    vectors = spark.createDataFrame([*((i, r.tolist()) for i, r in enumerate(x)), (38, None)], "object_id bigint, embedding array<double>")
    found = ranking.term_vectors(grams.packed(counts) if kind == "packed" else counts, vectors)
    got = {r["term_id"]: r["vector"] for r in found.collect()}
    sums, weights = {}, Counter()
    for i, t, n in cells:
        if i < 38:
            sums[t] = sums.get(t, 0) + n * x[i]
            weights[t] += n
    assert set(got) == set(sums)
    assert all(np.allclose(got[t], sums[t] / weights[t], atol=1e-12) for t in sums)


def test_term_vectors_sum_before_vectors_move_and_are_made_once(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(ranking, "written", lambda df, name: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or df)
    counts = spark.createDataFrame(cells_of(spark), "object_id bigint, term_id int, n bigint")
    vectors = spark.range(40).select(F.col("id").alias("object_id"), F.array(F.col("id").cast("double")).alias("embedding"))
    ranking.term_vectors(counts, vectors)
    # An aggregate of vectors by term in the JVM sorts a vector for each cell once a task has more than 128 terms.
    assert len(plans) == 1 and "ObjectHashAggregate" not in plans[0] and "SortAggregate" not in plans[0]


def test_sums_of_a_task_by_term(spark):
    sums = ranking._Sums(2)
    sums.add(np.array([5, 2]), np.array([1.0, 2.0]), np.array([[1.0, 1.0], [2.0, 2.0]]))
    sums.add(np.array([2, 900]), np.array([3.0, 4.0]), np.array([[1.0, 0.0], [9.0, 9.0]]))
    import pyarrow as pa

    rows = [r for b in sums.rows(pa.int32()) for r in b.to_pylist()]
    assert rows == [{"term_id": 5, "weight": 1.0, "vector": [1.0, 1.0]}, {"term_id": 2, "weight": 5.0, "vector": [3.0, 2.0]}, {"term_id": 900, "weight": 4.0, "vector": [9.0, 9.0]}]


def test_class_counts_and_trimmed_counts_equal_plain_sums(spark):
    cells = cells_of(spark)
    layers = [(i, layer, c) for i in range(35) for layer, c in ((0, i % 4), (1, -1 if i % 4 == 3 else i % 2))]
    counts = spark.createDataFrame(cells, "object_id bigint, term_id int, n bigint")
    assignments = spark.createDataFrame(layers, "object_id bigint, layer int, cluster int")
    held = {}
    for i, layer, c in layers:
        if c >= 0:
            held.setdefault(i, []).append((layer, c))
    c, s = Counter(), Counter()
    for i, t, n in cells:
        for place in held.get(i, []):
            c[(*place, t)] += n
            s[(*place, t)] += math.log1p(n)
    got = {tuple(r)[:3]: (r["c"], r["s"]) for r in ranking.class_counts(counts, assignments).collect()}
    assert set(got) == set(c) and all(got[k][0] == c[k] and abs(got[k][1] - s[k]) < 1e-9 for k in c)
    trimmed = keyphrases.trimmed_counts(counts, assignments).collect()
    assert sorted(map(tuple, trimmed)) == sorted((*place, i, t, n) for i, t, n in cells for place in held.get(i, []))
    assert clustering.places(assignments).select("kind").distinct().count() == 4
