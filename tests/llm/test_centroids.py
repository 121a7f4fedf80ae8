"""Centroid clustering against plain rounds over all centroids, and odd rows."""

import hashlib
import math
import random

import numpy as np
import pytest

from strandline.llm import centroids

ROWS = "vec_id long, embedding array<double>, x int, cluster string, kind int"


def frame(spark, rows, parts=3):
    """Rows with columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, v, 7, "z", 1) for i, v in rows], ROWS).repartition(parts)


def plain(rows, components, k, rounds, scale, seed):
    kept = [(i, v, [math.floor(scale * c) for c in v]) for i, v in rows if v is not None and len(v) == components and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    c = [x for _, _, x in order[:k]]

    def assign():
        out = []
        for _, _, x in kept:
            out.append(min((sum((a - b) ** 2 for a, b in zip(x, y)), j) for j, y in enumerate(c)))
        return out

    for _ in range(rounds):
        own = assign()
        for j in range(len(c)):
            mine = [x for (_, _, x), (_, o) in zip(kept, own) if o == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine)]
    own = assign()
    most = (1 << 63) - 1
    inertia = {}
    for d, j in own:
        inertia[j] = inertia.get(j, 0) + min(most, d)
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    whole = min(most, sum(min(most, s) for s in inertia.values()))
    return sorted(((i, j, min(most, d), min(most, inertia[j]), whole, sha[j]) for (i, _, _), (d, j) in zip(kept, own)), key=repr)


def run(spark, rows, components, k, rounds, scale=256.0, seed="2:"):
    out = centroids.cluster(centroids.kept_vectors(frame(spark, rows), components), k, rounds, scale, seed)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


@pytest.mark.parametrize("k,spread", [(12, 0.05), (24, 0.4)])
def test_clusters_are_those_of_plain_rounds(spark, k, spread):
    rng = random.Random(k)
    middles = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(9)]
    rows = [(i, [c + rng.gauss(0, spread) for c in middles[i % 9]]) for i in range(700)]
    rows += [(1000 + i, list(rows[0][1])) for i in range(300)]  # a third are copies
    assert run(spark, rows, 6, k, 5) == plain(rows, 6, k, 5, 256.0, "2:")


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.5]), (1, [0.5, -0.5]), (1, [0.25, 0.0]), (2, [nan, 0.0]), (3, [inf, 0.0]), (4, None), (5, []), (6, [1.0]), (7, [None, 1.0]), (8, [1.0, 2.0, 3.0]), (None, [3.0, 4.0]), (9, [-0.001, 0.0]), (10, [0.0, 0.0])]
    assert run(spark, rows, 2, 3, 5) == plain(rows, 2, 3, 5, 256.0, "2:")
    assert run(spark, rows, 2, 40, 2) == plain(rows, 2, 40, 2, 256.0, "2:")  # fewer vectors than centroids
    assert run(spark, [(4, None), (5, [])], 2, 3, 2) == []
    assert run(spark, [], 2, 3, 2) == []


def test_ties_go_to_the_smaller_number_and_empty_centroids_stay(spark):
    rows = [(i, [float(i % 2), 0.0]) for i in range(40)]
    got = run(spark, rows, 2, 10, 3)
    assert got == plain(rows, 2, 10, 3, 256.0, "2:")
    assert len({r[1] for r in got}) == 2


def test_very_large_components_are_exact(spark):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) * 10.0 ** rng.choice([0, 3, 12, 30]) for _ in range(3)]) for i in range(60)]
    assert run(spark, rows, 3, 8, 3) == plain(rows, 3, 8, 3, 256.0, "2:")


def test_parts_of_sums_add_up():
    for v in (0, 1, -1, 1 << 39, -(1 << 39), 1 << 40, -(1 << 40) - 3, 10**50, -(10**50)):
        parts = centroids._parts([v, 5])
        assert sum(p[0] << (centroids.PART_BITS * j) for j, p in enumerate(parts)) == v
        assert sum(p[1] << (centroids.PART_BITS * j) for j, p in enumerate(parts)) == 5
        assert all(-(1 << 63) <= p[0] < 1 << 63 for p in parts)


def test_bounds_rule_out_most_distances():
    rng = np.random.default_rng(3)
    c = rng.integers(-300, 300, (40, 8))
    x = (c[rng.integers(0, 40, 3000)] + rng.integers(-5, 6, (3000, 8))).astype(np.int64)
    own, upper, near, low = centroids.Pass(c.tolist(), None, 10).nearest(x)
    moved = c + rng.integers(-2, 3, c.shape)
    moves = np.sqrt(((moved - c) ** 2).sum(axis=1))
    later = centroids.Pass(moved.tolist(), moves, 10)
    looked = []
    later.nearest = lambda rows, f=later.nearest: looked.append(len(rows)) or f(rows)
    got = later.assign(x, own, upper, near, low)
    d = ((x[:, None, :] - moved[None, :, :]) ** 2).sum(axis=-1)
    assert (got[0] == d.argmin(axis=1)).all()
    others = np.sqrt(d.astype(float))
    others[np.arange(len(x)), got[0]] = np.inf
    assert (got[1] >= np.sqrt(d[np.arange(len(x)), got[0]]) - 1e-6).all()
    assert (got[3][:, 0] <= others.min(axis=1) + 1e-6).all()
    assert sum(looked) < 0.1 * len(x)
