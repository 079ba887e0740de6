"""Bars by several ways, zigzags against ranks, forests against Kruskal."""

import itertools
import math
import random

import numpy as np
import pytest

from stratalens.functions import persistence as ph
from stratalens.operators.topology import reduce_boundary


def circle(n, r=1.0):
    a = np.linspace(0, 2 * math.pi, n, endpoint=False)
    return np.c_[r * np.cos(a), r * np.sin(a)]


def test_bars_by_every_way():
    rng = np.random.default_rng(0)
    for _ in range(4):
        x = rng.random((9, 2))
        f = ph.full_rips(x, 0.7)
        bars = ph.homology(f)
        assert bars == ph.cohomology(f) == sorted(b[:3] for b in ph.homology(f, representatives=True))
        assert bars == reduce_boundary([(d, v, c) for d, v, c in zip(f.dim, f.value, f.vertices)])
        long = ph.homology(f, cutoff=0.1)
        assert long == [b for b in bars if b[2] - b[1] > 0.1]
        assert ph.relative(f, set()) == bars
        assert all(d > 0 for d, _, _ in ph.relative(f, {(i,) for i in range(9)}))


def test_cycles_and_loops():
    f = ph.full_rips(circle(8), 1.2)
    one = [b for b in ph.homology(f, representatives=True) if b[0] == 1 and b[2] - b[1] > 0.3]
    assert len(one) == 1 and len(ph.cycle_edges(one[0][3])) == 8 and len(ph.loops(one[0][3])) == 1 and sorted(ph.loops(one[0][3])[0]) == list(range(8))
    with pytest.raises(ValueError):
        ph.Filtration([(0.0, (0,)), (0.0, (0, 1))])
    assert len({ph.combinatorial_index(c) for c in itertools.combinations(range(9), 3)}) == 84


def test_vines():
    rng = random.Random(1)
    f = ph.full_rips(np.random.default_rng(2).random((5, 2)), 0.8)
    v = ph.Vineyard(f)
    for _ in range(60):
        i = rng.randrange(len(f) - 1)
        if v.order[i] in f.boundary[v.order[i + 1]]:
            continue
        v.swap(i)
        fresh = ph.Vineyard(f)
        fresh.order = list(v.order)
        fresh._all()
        assert fresh.pairs() == v.pairs()


def random_zigzag(seed, n, points=4):
    rng = random.Random(seed)
    now, steps = set(), []
    cells = [c for k in (1, 2, 3) for c in itertools.combinations(range(points), k)]
    while len(steps) < n:
        up = [c for c in cells if c not in now and all(f in now for f in ph.faces(c))]
        down = [c for c in now if not any(c in ph.faces(x) for x in now)]
        add = bool(up) and (not down or rng.random() < 0.6)
        c = rng.choice(up if add else down)
        now = now | {c} if add else now - {c}
        steps.append((add, c))
    return steps


@pytest.mark.parametrize("seed", range(12))
def test_zigzag_against_ranks(seed):
    steps = random_zigzag(seed, 14)
    assert ph.zigzag(steps) == ph.zigzag_plain(steps, 2)


def test_zigzag_by_hand():
    # two points, joined, parted again
    steps = [(True, (0,)), (True, (1,)), (True, (0, 1)), (False, (0, 1))]
    assert ph.zigzag(steps) == [(0, 1, 4), (0, 2, 2), (0, 4, 4)]
    with pytest.raises(ValueError):
        ph.zigzag([(True, (0,)), (True, (1,)), (True, (0, 1)), (False, (0,))])


def test_strong_core():
    core, went = ph.strong_core([(0, 1, 2), (1, 2, 3), (3, 4)])
    assert len(core) == 1 and len(core[0]) == 1 and set(went) == {0, 1, 2, 3, 4} and len(set(went.values())) == 1
    ring = [(0, 1), (1, 2), (2, 3), (0, 3), (3, 4)]
    core, went = ph.strong_core(ring)
    assert core == [(0, 1), (0, 3), (1, 2), (2, 3)] and went[4] == 3


def test_dynamic_forest():
    rng = random.Random(0)
    d, edges = ph.DynamicForest(), {}
    for _ in range(400):
        if edges and rng.random() < 0.35:
            e = rng.choice(sorted(edges))
            del edges[e]
            d.delete(*e)
        else:
            u, v = rng.sample(range(14), 2)
            e = (min(u, v), max(u, v))
            if e in edges:
                continue
            edges[e] = rng.randrange(20)
            d.insert(u, v, edges[e])
        root = list(range(14))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        total = 0
        for e in sorted(edges, key=lambda e: (edges[e], *e)):
            if find(e[0]) != find(e[1]):
                root[find(e[0])] = find(e[1])
                total += edges[e]
        assert d.weight == total
        u, v = rng.sample(range(14), 2)
        assert d.connected(u, v) == (find(u) == find(v))
