import itertools

import numpy as np
import pytest

from layerlode.operators.selection import FUNCTIONS, FacilityLocation, collapse_longest, distances_to, diversify, diversify_at_least, similarities, submodular


def test_distances_equal_the_definition():
    rng = np.random.default_rng(1)
    q, x = rng.normal(size=8), rng.normal(size=(200, 8))
    want = [1 - a @ q / (np.linalg.norm(a) * np.linalg.norm(q)) for a in x]
    assert np.allclose(distances_to(q, x), want)
    assert (distances_to(np.zeros(8), x) == 1).all() and distances_to(q, np.zeros((1, 8)))[0] == 1


@pytest.mark.parametrize("alpha", [0.0, 0.5, 1.0])
def test_kept_candidates_lie_apart(alpha):
    rng = np.random.default_rng(2)
    q, x = rng.normal(size=16), rng.normal(size=(80, 16))
    kept = diversify(q, x, alpha)
    far = distances_to(q, x)
    assert kept[0] == 0
    for a, b in itertools.combinations(kept, 2):
        assert alpha * far[b] <= distances_to(x[a], x[b : b + 1])[0] + 1e-12
    for i in set(range(80)) - set(kept):
        assert any(alpha * far[i] > distances_to(x[k], x[i : i + 1])[0] for k in kept if k < i)


@pytest.mark.parametrize("n", [1, 4, 16, 60])
def test_at_least_n_are_kept_if_alpha_may_be_zero(n):
    rng = np.random.default_rng(n)
    q, x = rng.normal(size=4), rng.normal(size=(64, 4))
    assert len(diversify_at_least(q, x, n)) >= n


@pytest.mark.parametrize("name", sorted(FUNCTIONS))
def test_lazy_greedy_equals_plain_greedy(name):
    rng = np.random.default_rng(5)
    s = similarities(rng.normal(size=(40, 6)))
    state, plain = FUNCTIONS[name](s), []
    for _ in range(8):
        gains = [(-state.gain(i), i) for i in range(40) if i not in plain]
        plain.append(min(gains)[1])
        state.add(plain[-1])
    got = submodular(s, 8, name)
    if name == "graph_cut":  # not monotone here, and lazy selection looks at bounds from before
        assert len(set(got)) == 8 and got[0] == plain[0]
    else:
        assert got == plain


def test_facility_location_gain_is_the_difference_of_its_sums():
    rng = np.random.default_rng(6)
    s = similarities(rng.normal(size=(20, 5)))
    f = FacilityLocation(s)
    value = lambda chosen: s[chosen].max(axis=0).sum() if chosen else 0.0
    chosen = []
    for i in (3, 7, 11):
        assert np.isclose(f.gain(i), value([*chosen, i]) - value(chosen))
        f.add(i)
        chosen.append(i)


def test_submodular_edges():
    assert submodular(np.zeros((0, 0)), 3) == [] and len(submodular(similarities(np.ones((2, 3))), 5)) == 2
    with pytest.raises(ValueError):
        submodular(np.ones((2, 2)), 1, "nothing")
    cheap = submodular(similarities(np.eye(4)), 1, cost=np.array([1, 1, 0.1, 1]))
    assert cheap == [2]


def test_longest_phrases_win():
    assert collapse_longest(["cat", "black cat", "dog", "black"]) == ["black cat", "dog"]
    assert collapse_longest(["cat", "the catalog"]) == ["cat", "the catalog"]
    assert collapse_longest([]) == [] and collapse_longest(["a", "a"]) == ["a"]
