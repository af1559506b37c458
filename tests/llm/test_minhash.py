import random
import re

import numpy as np
import pytest

from layerlode.llm.minhash import BITS, PERMUTATIONS, equal_minima, estimate, minima, near_duplicate_groups, pack, similar_nodes, signatures
from layerlode.llm.common import utf8_column
from tests.llm.conftest import prose


def shingles(text):
    words = re.findall(r"[a-z0-9_\u0080-\U0010ffff]+", text.lower())
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def corpus():
    r = random.Random(7)
    texts = [prose(i, 120, 3000) for i in range(40)]
    for i in range(12):  # near copies, some of copies
        words = texts[i].split()
        for _ in range(6):
            words[r.randrange(len(words))] = "other"
        texts.append(" ".join(words))
    texts += [texts[20]] * 3
    return texts


def brute(texts, threshold):
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= threshold:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    groups = {}
    for i in range(len(texts)):
        groups.setdefault(find(i), []).append(i)
    return {tuple(g) for g in groups.values() if len(g) > 1}


@pytest.mark.parametrize("chunk", [2048, 4])
def test_groups_equal_brute_force(spark, chunk):
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {tuple(r["doc_ids"]) for r in near_duplicate_groups(df, chunk=chunk).collect()}
    assert got == brute(texts, 0.5)


def test_every_pair_of_a_bucket_counts_however_it_is_cut(spark):
    base = prose(1, 150, 3000).split()
    rows = [(i, " ".join([*base[:40], f"w{i}", *base[40:]])) for i in range(60)]
    sigs = signatures(spark.createDataFrame(rows, "doc_id bigint, text string"))
    from layerlode.llm.components import connected_components

    for chunk in (5, 2048):
        found = connected_components(similar_nodes(sigs, 0.5, chunk)).collect()
        assert len(found) == sigs.select("node").distinct().count() > 50 and len({r["component"] for r in found}) == 1


def test_estimate_is_near_the_similarity():
    r = random.Random(3)
    words = prose(5, 400, 5000).split()
    errors = []
    for change in (5, 20, 40, 80):
        other = list(words)
        for k in r.sample(range(len(words)), change):
            other[k] = f"x{k}"
        import pyarrow as pa

        raw, offsets = utf8_column(pa.array([" ".join(words), " ".join(other)]), lower=True)
        packed = pack(minima(raw, offsets)[1]).view(np.uint64)
        got = float(estimate(equal_minima(packed[0], packed[1:]))[0])
        errors.append(got - jaccard(" ".join(words), " ".join(other)))
    assert max(map(abs, errors)) < 0.15 and packed.shape[1] * 64 == PERMUTATIONS * BITS


def test_components_by_stars_equal_union_find(spark):
    from layerlode.llm.components import connected_components

    r = random.Random(2)
    edges = spark.createDataFrame([(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(None, 1), (4, None), (9, 9)], "a bigint, b bigint")
    small = {(x["node"], x["component"]) for x in connected_components(edges).collect()}
    assert {(x["node"], x["component"]) for x in connected_components(edges, driver_rows=0).collect()} == small
