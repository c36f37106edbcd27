"""Small-graph algorithms against brute force."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from sparkloom.functions import graphs as A


def test_betweenness_of_a_path_and_a_star():
    assert A.betweenness([(0, 1), (1, 2)], [0, 1, 2]) == {0: 0.0, 1: 0.5, 2: 0.0}
    both = [(0, i) for i in range(1, 5)] + [(i, 0) for i in range(1, 5)]
    assert A.betweenness(both, list(range(5)))[0] == pytest.approx(1.0)


def test_weakest_edges_of_cycles_go():
    assert A.without_cycles([(0, 1, 0.9), (1, 2, 0.2), (2, 0, 0.5), (2, 3, 0.1)]) == [(0, 1, 0.9), (2, 0, 0.5), (2, 3, 0.1)]


@pytest.mark.parametrize("shape", [(4, 4), (3, 5), (5, 3)])
def test_assignment_is_the_cheapest(shape):
    for seed in range(6):
        cost = np.random.default_rng(seed).random(shape)
        k = min(shape)
        best = min(sum(cost[a, b] for a, b in zip(rows, columns, strict=True)) for rows in itertools.combinations(range(shape[0]), k) for columns in itertools.permutations(range(shape[1]), k))
        assert sum(cost[a, b] for a, b in A.assignment(cost)) == pytest.approx(best)


def test_pc_finds_a_collider():
    r = np.random.default_rng(2)
    x, y = r.normal(size=(2, 2000))
    z = x + y + 0.3 * r.normal(size=2000)
    assert A.pc(np.stack([x, y, z], 1), 0.01, 1).astype(int).tolist() == [[0, 0, 1], [0, 0, 1], [0, 0, 0]]


def test_sem_finds_the_stronger_direction():
    r = np.random.default_rng(4)
    x = r.normal(size=1500)
    data = np.stack([x, 0.8 * x + 0.6 * r.normal(size=1500)], 1)
    a = A.linear_sem(data, np.ones_like(data), steps=200)
    assert a[0, 0] == a[1, 1] == 0 and abs(a).max() > 0.3


def test_filter_keeps_a_symmetric_graph():
    x = np.random.default_rng(0).random((6, 6))
    out = A.topology_filter((x + x.T) / 2, 1.0, 3, 0.1)
    assert np.allclose(out, out.T) and (np.diag(out) == 0).all() and A.spectral_gap(out) >= 0


def test_large_groups_are_refused():
    with pytest.raises(ValueError, match="at most"):
        A.spectral_gap(np.zeros((A.MAX_NODES + 1, 1)))
