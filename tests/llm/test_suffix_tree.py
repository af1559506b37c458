import random
from collections import Counter, defaultdict
from math import log, log2

import numpy as np
import pyarrow as pa
import pytest

from layerlode.llm import suffix_tree
from layerlode.llm.suffix_tree import BASE, LOOKAHEAD, SMOOTHING, suffix_tree_scores

from tests.llm.conftest import prose

DEPTH = 3


def brute(texts):
    """Scores by dictionaries of contexts."""
    counts = defaultdict(Counter)
    for t in texts:
        raw = [0] * DEPTH + [b + 1 for b in (t or "").encode()]
        for i in range(DEPTH, len(raw)):
            for d in range(DEPTH + 1):
                counts[tuple(raw[i - d : i])][raw[i]] += 1
    total = sum(counts[()].values())
    states = {()}
    for ctx, own in counts.items():
        if ctx:
            n, above = sum(own.values()), counts[ctx[1:]]
            m = sum(above.values())
            gain = sum(c * log((c / n) / (above[s] / m)) for s, c in own.items())
            if gain >= 0.5 * len(own) * log(total) - 1e-9:
                states |= {ctx[k:] for k in range(len(ctx) + 1)}

    def prob(ctx, s):
        above = prob(ctx[1:], s) if ctx else 1 / 256
        own = counts[ctx]
        return (own[s] + SMOOTHING * above) / (sum(own.values()) + SMOOTHING)

    out = []
    for t in texts:
        raw, score = [0] * DEPTH + [b + 1 for b in (t or "").encode()], 0.0
        for i in range(DEPTH, len(raw)):
            ctx = next(tuple(raw[i - d : i]) for d in range(DEPTH, -1, -1) if tuple(raw[i - d : i]) in states)
            score += log2(prob(ctx, raw[i]))
        out.append(score)
    return out


@pytest.mark.parametrize("table_bytes", [1 << 30, 0])
def test_scores_equal_brute_force(spark, table_bytes):
    texts = [prose(i, 60, 30) for i in range(25)] + [prose(3, 60, 30), "zzzz zzzz", "é", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["log2_prob"] for r in suffix_tree_scores(df, depth=DEPTH, table_bytes=table_bytes).collect()}
    for i, want in enumerate(brute(texts)):
        assert got[i] == pytest.approx(want, rel=1e-4, abs=1e-3)


def test_likely_text_scores_better(spark):
    texts = [prose(i, 80, 40) for i in range(30)] + ["qzx!jw# vvq@k 9~zq kqj xz" * 4]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {r["doc_id"]: r["bits_per_byte"] for r in suffix_tree_scores(df).collect()}
    assert rows[30] > max(v for k, v in rows.items() if k < 30)


def test_what_is_counted_follows_the_input(spark):
    from layerlode.llm.suffix_tree import gram_counts

    small = spark.createDataFrame([(i, prose(i, 200)) for i in range(5)], "doc_id bigint, text string")
    large = spark.createDataFrame([(i, prose(i, 200)) for i in range(20)], "doc_id bigint, text string")
    total = lambda df: sum(r["n"] for r in gram_counts(df).collect())
    assert total(small) == sum(len(prose(i, 200)) for i in range(5)) and total(large) == sum(len(prose(i, 200)) for i in range(20))


def brute_grown(texts, lookahead=LOOKAHEAD):
    """Scores of the tree that grows a symbol at a time past ``BASE``, by dictionaries; and its longest state."""
    rows = [[0] + [b + 1 for b in (t or "").encode()] for t in texts]
    total = sum(len(r) - 1 for r in rows)
    counts, fails, states, tree = {(): Counter(s for r in rows for s in r[1:])}, {(): 0}, {()}, {()}
    open_, d = {()}, 0
    while open_:
        d += 1
        level = defaultdict(Counter)
        for r in rows:
            for i in range(d, len(r)):  # contexts of up to BASE symbols beyond a text's start say nothing new
                if tuple(r[i - d + 1 : i]) in open_:
                    level[tuple(r[i - d : i])][r[i]] += 1
        open_ = set()
        for ctx, own in level.items():
            n, above = sum(own.values()), counts[ctx[1:]]
            m = sum(above.values())
            gain = sum(c * log((c / n) / (above[s] / m)) for s, c in own.items())
            passed = gain >= 0.5 * len(own) * log(total) - 1e-9
            fails[ctx] = 0 if passed else fails[ctx[1:]] + 1
            counts[ctx] = own
            if passed:
                tree |= {ctx[k:] for k in range(len(ctx) + 1)}
            varied = n * log(n) - sum(c * log(c) for c in own.values()) >= 0.5 * log(total) - 1e-9
            if d < BASE or (varied and fails[ctx] <= lookahead):
                open_.add(ctx)

    def prob(ctx, s):
        above = prob(ctx[1:], s) if ctx else 1 / 256
        own = counts[ctx]
        return (own[s] + SMOOTHING * above) / (sum(own.values()) + SMOOTHING)

    out = []
    for r in rows:
        score = 0.0
        for i in range(1, len(r)):
            k = 0
            while k < i and tuple(r[i - k - 1 : i]) in tree:
                k += 1
            score += log2(prob(tuple(r[i - k : i]), r[i]))
        out.append(score)
    return out, max(map(len, tree))


@pytest.mark.parametrize(("table_bytes", "local_rows"), [(1 << 30, 1_000_000), (20_000, 0)])
def test_tree_grows_past_the_base_as_far_as_the_test_says(spark, table_bytes, local_rows):
    r = random.Random(8)
    rule = {f"{k:08b}": r.choice("01") for k in range(256)}
    made = []
    for _ in range(20):  # the next digit hangs on the eight before it
        text = "".join(r.choices("01", k=8))
        while len(text) < 800:
            text += rule[text[-8:]] if r.random() < 0.9 else r.choice("01")
        made.append(text)
    texts = [*made, *[prose(i, 60, 12) for i in range(10)], made[0], "é", "", None]
    want, deepest = brute_grown(texts)
    assert deepest > BASE + 1
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["log2_prob"] for r in suffix_tree_scores(df, table_bytes=table_bytes, local_rows=local_rows).collect()}
    for i, score in enumerate(want):
        assert got[i] == pytest.approx(score, rel=1e-10, abs=1e-9)


def test_parts_of_the_tree_change_no_score(spark):
    texts = [prose(i, 100, 20) for i in range(30)]
    df = spark.createDataFrame([(f"id{i}", t) for i, t in enumerate(texts)], "doc_id string, text string")
    one, many = [{r["doc_id"]: r["log2_prob"] for r in suffix_tree_scores(df, table_bytes=b).collect()} for b in (1 << 30, 3000)]
    assert one.keys() == many.keys() and all(many[k] == pytest.approx(v, rel=1e-12) for k, v in one.items())


def test_depth_is_a_bound_only_where_given(spark):
    texts = [prose(i, 60, 30) for i in range(10)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for depth in (0, 1, 7):
        assert all(r["log2_prob"] < 0 for r in suffix_tree_scores(df, depth=depth).collect())
    with pytest.raises(ValueError):
        suffix_tree_scores(df, depth=-1)


def test_base_contexts_are_looked_up_once_and_forgetting_changes_nothing(spark, monkeypatch):
    r = random.Random(8)
    rule = {f"{k:07b}": r.choice("01") for k in range(128)}
    texts = ["\0" * 40, "\0\0ab" * 20, "é", "", None]
    for i in range(20):  # the next digit hangs on the seven before it
        text = "".join(r.choices("01", k=7))
        while len(text) < 800:
            text += rule[text[-7:]] if r.random() < 0.9 else r.choice("01")
        texts += [text, prose(i, 60, 12)]
    base, entries = suffix_tree.grown(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))

    def logs(scorer):
        return np.concatenate([scorer.log2(own, own.texts()) for own, *_ in suffix_tree._cut(pa.array(texts), 500)])

    scorer = suffix_tree._scorer(entries, base, SMOOTHING)
    assert scorer.deepest > base
    first, asked = logs(scorer), []
    in_base = suffix_tree.Scorer._in_base
    monkeypatch.setattr(suffix_tree.Scorer, "_in_base", lambda self, grams: asked.append(len(grams)) or in_base(self, grams))
    assert np.array_equal(logs(scorer), first) and sum(asked) < len(first) / 100
    monkeypatch.setattr(suffix_tree, "_KNOWN_BITS", 2)
    asked.clear()
    assert np.array_equal(logs(suffix_tree._scorer(entries, base, SMOOTHING)), first) and sum(asked) > len(first) / 100


def test_equal_texts_have_equal_scores_wherever_they_are(spark):
    texts = [prose(1, 50)] + [prose(i, 20 + i) for i in range(40)]
    mixed = [t for text in texts[1:] for t in (text, texts[0], "")]
    rows = suffix_tree_scores(spark.createDataFrame(list(enumerate(mixed)), "doc_id bigint, text string").coalesce(1)).collect()
    assert len({r["log2_prob"] for r in rows if r["doc_id"] % 3 == 1}) == 1
    assert {r["log2_prob"] for r in rows if r["doc_id"] % 3 == 2} == {0.0}
