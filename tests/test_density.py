import numpy as np
import pytest

from layerlode.operators import clustering, density


def blobs(seed=1, n=240, centres=5, noise=30):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, 6))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    x = np.concatenate([c[i % centres] + rng.normal(size=6) * 0.05 for i in range(n)]).reshape(n, 6)
    return np.concatenate([x, rng.normal(size=(noise, 6))]), np.concatenate([np.arange(n) % centres, np.full(noise, -1)])


@pytest.fixture(scope="module")
def points(spark):
    x, _ = blobs()
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "object_id bigint, embedding array<double>")


def unit():
    x, _ = blobs()
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def reach(k):
    far = np.sqrt(np.maximum(2 - 2 * unit() @ unit().T, 0))
    np.fill_diagonal(far, np.inf)
    core = np.sort(far, axis=1)[:, k - 1]
    return core, np.maximum(np.maximum(far, core[:, None]), core[None, :])


@pytest.mark.parametrize("block", [4096, 50])
def test_core_distances_and_tree_equal_brute_force(points, block):
    core, far = reach(5)
    got = {r["object_id"]: r["core_distance"] for r in density.core_distances(density.unit_vectors(points), 5, block).collect()}
    assert all(abs(got[i] - core[i]) < 1e-6 for i in range(len(core)))
    n, left, total = len(core), set(range(1, len(core))), 0.0
    best = far[0].copy()
    while left:
        at = min(left, key=lambda i: best[i])
        total += best[at]
        left.discard(at)
        best = np.minimum(best, far[at])
    tree = density.spanning_tree(density.unit_vectors(points), 5, block).toPandas()
    assert len(tree) == n - 1 and abs(tree["w"].sum() - total) < 1e-5


def condensed(linkage, least):
    """Leaves from the top down: a split into two sides of the least size makes two clusters."""
    n, out = len(linkage.ids), []

    def under(node):
        return [node] if node < n else under(linkage.left[node]) + under(linkage.right[node])

    def walk(node, born):
        at = node
        while at >= n:
            a, b = linkage.left[at], linkage.right[at]
            if min(linkage.size[a], linkage.size[b]) >= least:
                walk(a, a)
                walk(b, b)
                return
            if max(linkage.size[a], linkage.size[b]) < least:
                break
            at = a if linkage.size[a] >= least else b
        if born is not None:
            out.append(frozenset(linkage.ids[under(born)].tolist()))

    walk(len(linkage.size) - 1, None)
    return set(out)


def test_leaves_equal_those_found_from_the_top(points):
    import sys

    sys.setrecursionlimit(10_000)
    linkage = density._linkage(points, 5, 4096)
    for least in (2, 3, 5, 8, 15, 30, 60):
        labels = linkage.labels(least)
        got = {frozenset(linkage.ids[labels == k].tolist()) for k in range(labels.max() + 1)}
        assert got == condensed(linkage, least)
        assert all(len(g) >= least for g in got)


def test_layers_find_the_blobs_and_nest(points):
    _, truth = blobs()
    layers = density.density_layers(points, min_clusters=3, min_samples=5, base_min_cluster_size=10).toPandas()
    first = layers[layers["layer"] == 0].sort_values("object_id")["cluster"].to_numpy()
    for k in range(5):
        own = first[truth == k]
        values, counts = np.unique(own[own >= 0], return_counts=True)
        assert counts.max() >= 0.8 * (truth == k).sum()
    assert set(layers["object_id"]) == set(range(270))
    n_layers = layers["layer"].max() + 1
    for layer in range(n_layers - 1):
        a, b = (layers[layers["layer"] == i].sort_values("object_id")["cluster"].to_numpy() for i in (layer, layer + 1))
        for c in range(a.max() + 1):  # a cluster of a finer layer lies in one of the coarser or in none
            assert len(set(b[a == c].tolist()) - {-1}) <= 1


def test_bounds_of_the_search(points):
    with pytest.raises(ValueError, match="fewer than"):
        density.density_layers(points, min_clusters=50)
    with pytest.raises(ValueError, match="give"):
        density.density_layers(points, base_min_cluster_size=None)
    with pytest.raises(ValueError, match="no layer"):
        density.persistent_layers(points, min_clusters=90)
    one = density.density_layers(points, min_clusters=2, base_min_cluster_size=5, max_layers=1)
    assert one.select("layer").distinct().count() == 1
    counted = density.density_layers(points, min_clusters=2, base_n_clusters=5, base_min_cluster_size=None)
    assert counted.where("layer = 0 and cluster >= 0").select("cluster").distinct().count() == 5
    kept = density.persistent_layers(points, min_clusters=2, max_layers=2)
    assert kept.select("layer").distinct().count() <= 2 and kept.where("persistence <= 0").count() == 0


def test_size_for_count():
    counts = {m: (max(1, 100 // m), 1000 - m) for m in range(2, 60)}
    for target in (1, 3, 10, 33, 50):
        got = density.size_for_count(counts.__getitem__, target, 100)
        assert abs(counts[got][0] - target) == min(abs(c - target) for m, (c, _) in counts.items() if m <= 50)


def test_k_means_layers_quarter(points):
    layers = clustering.k_means_layers(points, 32, 4).groupBy("layer").agg({"cluster": "max"}).collect()
    assert {r["layer"]: r["max(cluster)"] for r in layers} == {0: 31, 1: 7}
    with pytest.raises(ValueError):
        clustering.k_means_layers(points.limit(3), 32, 4)


def test_tree_holds_every_cluster_once_and_children_in_parents(spark):
    rng = np.random.default_rng(3)
    fine = rng.integers(-1, 20, 400)
    rows = [(i, layer, int(f if f < 0 else f // 4**layer)) for i, f in enumerate(fine) for layer in range(3)]
    a = spark.createDataFrame(rows, "object_id bigint, layer int, cluster int")
    edges = clustering.cluster_tree(a).collect()
    children = [(r["child_layer"], r["child_cluster"]) for r in edges]
    assert sorted(children) == sorted({(layer, c) for _, layer, c in rows if c >= 0})
    for r in edges:
        if r["parent_layer"] < 3:
            assert r["child_cluster"] // 4 ** (r["parent_layer"] - r["child_layer"]) == r["parent_cluster"]


def test_sizes_fill_gaps_and_relabel_closes_them(spark):
    a = spark.createDataFrame([(1, 0, 0), (2, 0, 3), (3, 0, -1), (1, 1, 5), (2, 1, 5), (3, 1, 5)], "object_id bigint, layer int, cluster int")
    sizes = {(r["layer"], r["cluster"]): r["size"] for r in clustering.cluster_sizes(a).collect()}
    assert sizes == {(0, 0): 1, (0, 1): 0, (0, 2): 0, (0, 3): 1, **{(1, i): 3 * (i == 5) for i in range(6)}}
    assert {tuple(r) for r in clustering.relabel(a).collect()} == {(1, 0, 0), (2, 0, 1), (3, 0, -1), (1, 1, 0), (2, 1, 0), (3, 1, 0)}
    assert {r["layer"] for r in clustering.relabel(a, min_clusters=2).collect()} == {0}
    assert clustering.relabel(a.limit(0)).count() == 0 and clustering.cluster_sizes(a.limit(0)).count() == 0


def crowded(seed=4, n=150):
    """Points with copies, ties and a far cluster: ids in no order."""
    rng = np.random.default_rng(seed)
    own = np.concatenate([rng.integers(-2, 3, size=(n // 3, 3)).astype(float), rng.normal(size=(n // 3, 3)), rng.normal(size=(n // 3, 3)) * 0.01 + 50])
    x = own[rng.integers(0, len(own), 3 * n)]
    return rng.permutation(10 * len(x))[: len(x)], x


@pytest.mark.parametrize("k", [1, 3, 9])
@pytest.mark.parametrize("near", [1, 12])
def test_rounds_over_blocks_equal_brute_force_with_copies_and_ties(spark, monkeypatch, k, near):
    monkeypatch.setattr(density, "NEAR", near)
    monkeypatch.setattr(density, "TILE", 16)
    monkeypatch.setattr(density, "WIDE", 24)
    ids, x = crowded()
    df = spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x, strict=True)], "object_id bigint, embedding array<double>")
    far = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    np.fill_diagonal(far, np.inf)
    core = np.sort(far, axis=1)[:, k - 1]
    got = {r["object_id"]: r["core_distance"] for r in density.core_distances(df, k, 40).collect()}
    assert all(abs(got[int(i)] - c) < 1e-5 for i, c in zip(ids, core, strict=True)) and len(got) == len(ids)
    reach = np.maximum(np.maximum(far, core[:, None]), core[None, :])
    left, best, want = np.ones(len(ids), dtype=bool), reach[0].copy(), []
    left[0] = False
    while left.any():
        at = int(np.argmin(np.where(left, best, np.inf)))
        want.append(best[at])
        left[at], best = False, np.minimum(best, reach[at])
    tree = density.spanning_tree(df, k, 40).toPandas()
    place = {int(i): k for k, i in enumerate(ids)}
    assert (tree["u"] < tree["v"]).all() and np.allclose(sorted(want), tree["w"], atol=1e-5)
    assert all(abs(reach[place[u], place[v]] - w) < 1e-5 for u, v, w in tree.itertuples(index=False))


def test_copies_of_a_point_are_compared_once(spark, monkeypatch):
    seen = []
    pairs = density._block_pairs
    monkeypatch.setattr(density, "_block_pairs", lambda points, *a: seen.append(points.count()) or pairs(points, *a))
    df = spark.range(400).selectExpr("id as object_id", "array(double(id % 8), 1.0D) as embedding")
    tree = density.spanning_tree(df, 3, 100).toPandas()
    assert max(seen) == 8 and len(tree) == 399 and (tree["w"] > 0).sum() == 7


def test_tree_of_more_points_than_the_driver_takes(points):
    with pytest.raises(ValueError, match="more than the driver"):
        density.spanning_tree(points, 5, 50, driver_edges=100)
