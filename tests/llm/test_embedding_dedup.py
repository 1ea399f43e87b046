from __future__ import annotations

import numpy as np
import pytest

from chronoform.llm import embedding_dedup as E


def brute(rows, cosine=0.9):
    ids = [i for i, _ in rows]
    good = [k for k, (_, v) in enumerate(rows) if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {k: set() for k in range(len(rows))}
    for a in good:
        for b in good:
            if a < b and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                    links[a].add(b)
                    links[b].add(a)
    out = []
    for k in range(len(rows)):
        seen, todo = {k}, [k]
        while todo:
            for n in links[todo.pop()] - seen:
                seen.add(n)
                todo.append(n)
        out.append((ids[k], len(links[k]), min(ids[n] for n in seen)))
    return sorted(out)


def vectors(seed=1, dim=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(15, dim))
    rows = [(i, (centres[i % 15] + rng.normal(size=dim) * rng.choice([0.05, 0.2, 0.35])).astype(np.float32).astype(float).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[i][1]) for i in range(20)] + [(2000 + i, [x * 3 for x in rows[i][1]]) for i in range(5)]
    return rows + [(3000, None), (3001, [0.0] * dim), (3002, [float("nan")] * dim), (3003, [None] * dim), (3004, [float("inf")] + [1.0] * (dim - 1)), (3005, []), (3006, [1.0, 2.0]), (3007, [1.0, 2.01]), (5, rows[5][1])]


@pytest.mark.parametrize(("blocks", "chunk"), [(4, 8192), (3, 20), (12, 40), (1, 7)])
def test_matches_brute_force(spark, blocks, chunk):
    rows = vectors()
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, component_id string")
    got = E.near_duplicates(df, blocks=blocks, chunk=chunk).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_boxes_part_space_and_visits_miss_nobody():
    rng = np.random.default_rng(3)
    for sample in (rng.normal(size=(500, 4)), np.round(rng.normal(size=(500, 4))), np.zeros((50, 4)), np.empty((0, 4))):
        boxes = E.Boxes(sample, 16)
        y = np.concatenate([sample[:100], rng.normal(size=(100, 4))])
        home = boxes.homes(y)
        assert ((boxes.lo[home] <= y) & (y <= boxes.hi[home])).all()
        visits = boxes.shrunk(*boxes.bounds(y)).visits(y, home, 0.5)
        for a, b in np.argwhere(((y[:, None] - y[None]) ** 2).sum(2) <= 0.5):
            first, last = (a, b) if home[a] <= home[b] else (b, a)
            assert home[first] == home[last] or visits[first, home[last]]


def met(x, n_boxes):
    """The share of all pairs that meet in some unit, summed over four blocks."""
    y, parts, out = E.rotated(x), E.blocks_of(64, 4), 0.0
    for p, most in zip(parts, E.budgets(64, parts, 0.9), strict=True):
        boxes = E.Boxes(y[:, p], n_boxes)
        home, full = boxes.homes(y[:, p]), np.bincount(boxes.homes(y[:, p]), minlength=n_boxes)
        visits = boxes.shrunk(*boxes.bounds(y[:, p])).visits(y[:, p], home, most)
        out += (visits @ full + full[home] / 2).sum() / (len(y) ** 2 / 2)
    return out


def test_clustered_vectors_meet_few_others():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(100, 64))
    clustered = E.unit(centres[rng.integers(0, 100, 6000)] + 0.2 * rng.normal(size=(6000, 64)))
    assert met(clustered, 512) < 0.2  # of all pairs; a hundredth of them link


def test_rotation_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(50, 12))
    y = E.rotated(x)
    assert y.shape == (50, 16) and np.allclose(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1))
    assert (E.rotated(x[7:9]) == y[7:9]).all()


def test_empty_table(spark):
    assert E.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
