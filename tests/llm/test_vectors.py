import numpy as np
import pytest
from pyspark.sql import functions as F

from layerlode.llm.ann import nearest_neighbours
from layerlode.llm.quantisation import near_duplicate_vectors

KIND = "vec_id bigint, embedding array<float>, label int"


def frame(spark, x, extra=()):
    rows = [(i, [float(v) for v in row], 0) for i, row in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, KIND).withColumns({"v": F.lit(1), "dim": F.lit("x"), "node": F.lit(2), "block": F.lit(3), "rank": F.lit(4), "codes": F.lit("y")})


ODD = [
    (900, None, 1), (901, [], 1), (902, [1.0, None, 2.0], 1), (903, [float("nan"), 1.0, 1.0], 1), (904, [float("inf"), 1.0, 1.0], 1), (None, [1.0, 2.0, 3.0], 1),
    (905, [1.0, 2.0], None), (906, [2.0, 4.0], None), (0, [9.0] * 16, 5),
]


def exact(x, k):
    x = x.astype(np.float32).astype(float)
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    unit = np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)
    cos = np.round(unit @ unit.T, 6) + 0.0
    out = {}
    for i in range(len(x)):
        order = sorted((j for j in range(len(x)) if j != i), key=lambda j: (-cos[i, j], j))
        out[i] = [(j, cos[i, j]) for j in order[:k]]
    return out


@pytest.mark.parametrize("block_bytes", [32 << 20, 4000])
def test_neighbours_equal_brute_force(spark, block_bytes):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(150, 16)), np.zeros((2, 16))])
    x = np.concatenate([x, x[:5], np.repeat(x[7:8], 20, axis=0), 1e-30 * x[:2], 1e30 * x[3:5]])  # ties, zeros, tiny and huge
    x[0] = np.minimum(x[0], 9.0)
    odd = [o for o in ODD if o[0] != 0]
    rows = nearest_neighbours(frame(spark, x, odd), 10, block_bytes=block_bytes).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["vec_id"], r["rank"])):
        got.setdefault(r["vec_id"], []).append((r["neighbour_id"], r["cosine"]))
    want = exact(x, 10)
    for i, near in want.items():
        assert [j for j, _ in got[i]] == [j for j, _ in near]
        assert np.allclose([c for _, c in got[i]], [c for _, c in near], atol=1e-6)
    assert got[905] == [(906, 1.0)] and got[906] == [(905, 1.0)]
    assert not {900, 901, 902, 903, 904} & set(got)


def test_few_rows(spark):
    assert nearest_neighbours(frame(spark, np.zeros((0, 3)))).count() == 0
    assert nearest_neighbours(frame(spark, np.ones((1, 3)))).count() == 0
    assert nearest_neighbours(frame(spark, np.ones((3, 3))), 5).count() == 6
    assert near_duplicate_vectors(frame(spark, np.zeros((0, 3)))).count() == 0
    assert near_duplicate_vectors(frame(spark, np.ones((1, 3)))).count() == 0


def planted(n, dims, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    copies = []
    for i in range(0, n // 4):
        for _ in range(rng.integers(1, 4)):
            copies.append(x[i] + rng.normal(size=dims) * rng.uniform(0.02, 0.35) * np.linalg.norm(x[i]) / np.sqrt(dims))
    hot = x[n - 1] + rng.normal(size=(150, dims)) * 0.1
    return np.concatenate([x, copies, hot, np.repeat(x[:1], 3, axis=0)])


def pairs_of(x, threshold):
    x = x.astype(np.float32).astype(float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(unit @ unit.T >= threshold - 1e-9, 1))
    return set(zip(a.tolist(), b.tolist(), strict=True))


def components(pairs):
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        i, j = sorted((find(a), find(b)))
        root[j] = i
    out = {}
    for i in root:
        out.setdefault(find(i), set()).add(i)
    return {min(v): v for v in out.values()}


@pytest.mark.parametrize(("probes", "exactly"), [(24, False), (10_000, True)])
def test_near_duplicate_vectors_against_brute_force(spark, probes, exactly):
    x = planted(1500, 32, 3)
    got = near_duplicate_vectors(frame(spark, x, [o for o in ODD if o[0] is None or o[0] < 905 and o[0] > 0]), probes=probes).collect()
    want = components(pairs_of(x, 0.9))
    where = {i: r["group_id"] for r in got for i in r["vec_ids"]}
    pairs = pairs_of(x, 0.9)
    found = sum(a in where and where.get(a) == where.get(b) for a, b in pairs)
    assert found / len(pairs) >= (1 if exactly else 0.9)
    true_group = {i: g for g, own in want.items() for i in own}
    for r in got:  # nothing is linked that brute force doesn't link
        assert len({true_group[i] for i in r["vec_ids"]}) == 1 and r["n_vectors"] == len(r["vec_ids"]) >= 2 and r["vec_ids"] == sorted(r["vec_ids"])
    if exactly:
        assert {r["group_id"]: set(r["vec_ids"]) for r in got} == want


def test_equal_vectors_are_grouped_and_odd_ones_are_not(spark):
    x = np.zeros((4, 16))
    x[0, 0] = x[1, 0] = x[2, 1] = 1
    got = {r["group_id"]: r["vec_ids"] for r in near_duplicate_vectors(frame(spark, x, [o for o in ODD if o[0] != 0] + [(907, [0.0] * 16, 1), (3, [0.0] * 16, 2)])).collect()}
    assert got == {0: [0, 1], 3: [3, 907], 905: [905, 906]}
