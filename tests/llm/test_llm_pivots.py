"""Centroid clustering against plain rounds with every distance computed."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
from tidemark.llm import pivots

SCHEMA = "vec_id bigint, embedding array<double>, label int, v string, cluster string, distance string, to_pivot string"


def plain(rows, count=8, rounds=10):
    kept = [(i, tuple(math.floor(1024 * x) for x in e)) for i, e in rows
            if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:count]
    centroids = [v for _, v in first]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((apart(v, c), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        of = {}
        for _, v in kept:
            of.setdefault(near(v)[1], []).append(v)
        centroids = [tuple(sum(x) // len(of[k]) for x in zip(*of[k])) if k in of else c for k, c in enumerate(centroids)]
    out = [(i, *near(v)) for i, v in kept]
    of = {k: sum(d for _, d, c in out if c == k) for _, _, k in out}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, k, d, of[k], sum(of.values()), sha[k]) for i, d, k in out), key=str)


def table(spark, rows):
    return spark.createDataFrame([(i, e, None, "x", None, "y", None) for i, e in rows], SCHEMA)


def vectors(n, seed=1):
    draw = random.Random(seed)
    middles = [[draw.uniform(-0.4, 0.4) for _ in range(64)] for _ in range(11)]
    return [(i, [draw.gauss(m, 0.1) for m in draw.choice(middles)]) for i in range(n)]


def test_equal_to_plain_rounds(spark):
    rows = vectors(300)
    rows += [(1000 + i, rows[7][1]) for i in range(90)]  # a hot vector
    rows += [(2000, None), (2001, [0.1] * 63), (2002, [0.1] * 63 + [None]), (2003, [0.1] * 63 + [float("nan")]), (2004, [float("inf")] * 64),
             (2005, []), (None, rows[3][1]), (None, [0.0] * 64), (5, rows[5][1]), (5, rows[5][1]), (2006, [1000.0] * 64)]
    got = sorted((tuple(r) for r in pivots.clustered(table(spark, rows)).collect()), key=str)
    assert got == plain(rows)


def test_few_and_equal_vectors_and_none(spark):
    for rows in ([(4, [0.25] * 64), (2, [0.5] * 64)], [(i, [0.125] * 64) for i in range(12)]):
        assert sorted((tuple(r) for r in pivots.clustered(table(spark, rows)).collect()), key=str) == plain(rows)
    assert pivots.clustered(table(spark, [])).count() == pivots.clustered(table(spark, [(1, None)])).count() == 0


def test_bounds_hold_and_leave_out_distances():
    v = np.array([[math.floor(1024 * x) for x in e] for _, e in vectors(2000, 3)], np.int64)
    of, centroids = [v[i] for i in (1, 50, 90, 400, 777)], [v[i] for i in (3, 9, 60, 61, 500, 900, 1200, 1999)]
    far = np.sqrt(np.stack([pivots.squared(v, p) for p in of], axis=1).astype(float))
    for c in centroids:
        assert (pivots.bounds(far, c, of) <= pivots.squared(v, c)).all()
    cluster, distance, computed = pivots.nearest(v, far, centroids, of)
    every = np.stack([pivots.squared(v, c) for c in centroids], axis=1)
    assert (cluster == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert computed < every.size * 0.9
