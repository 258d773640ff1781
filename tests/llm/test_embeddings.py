"""Near-duplicate embeddings against all pairs in double precision."""

import math

import numpy as np
import pytest

from rankloom.llm import int8_pairs


def plain(rows):
    units = {}
    for k, (_, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            units[k] = np.array(v, float) / np.linalg.norm(np.array(v, float))
    links, up = {k: 0 for k in range(len(rows))}, list(range(len(rows)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in units:
        for b in units:
            if a < b and rows[a][2] == rows[b][2] and len(units[a]) == len(units[b]) and units[a] @ units[b] >= 0.98:
                links[a] += 1
                links[b] += 1
                up[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for k in range(len(rows)):
        if rows[k][0] is not None:
            least[root(k)] = min(least.get(root(k), rows[k][0]), rows[k][0])
    return sorted(((i is None, i or 0, links[k], None if i is None else least[root(k)]) for k, (i, _, _) in
                   enumerate(rows)), key=str)


def run(spark, rows, **more):
    got = int8_pairs.near_vectors(
        spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"), **more).collect()
    assert all(r.kept == (r.component_id is None or r.component_id == r.vec_id) for r in got)
    return sorted(((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id) for r in got), key=str)


@pytest.mark.parametrize("block", [8, 2048])
def test_equals_all_pairs(spark, block):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(12, 16))
    rows = [(i, (base[i % 12] + rng.normal(size=16) * rng.choice([0, 0.05, 0.15, 0.25])).tolist(), int(i % 12) % 3)
            for i in range(150)]
    rows += [(200 + i, base[0].tolist(), 0) for i in range(30)]
    assert run(spark, rows, block=block) == plain(rows)


def test_awkward_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (1, v, 1), (None, v, 1), (2, None, 1), (3, [], 1), (4, [0.0, 0.0, 0.0], 1), (5, [1.0, None, 3.0], 1),
            (6, [1.0, float("nan"), 3.0], 1), (7, [1.0, float("inf"), 3.0], 1), (8, v, None), (9, v, 2), (10, [2.0, 4.0, 6.0], 1),
            (11, [1e-200, 2e-200, 3e-200], 1), (12, [1e200, 2e200, 3e200], 1), (13, [1.0, 2.0], 1), (14, [-1.0, -2.0, -3.0], 1)]
    want = plain([(i, [x * 1e-100 if x and abs(x) > 1e100 and math.isfinite(x) else x for x in v] if v else v, n)
                  if i != 11 else (11, [1.0, 2.0, 3.0], 1) for i, v, n in rows])
    assert run(spark, rows) == want
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int, class int, cid int")
    assert int8_pairs.near_vectors(empty).count() == 0


def test_bound_never_rules_out_a_link():
    rng = np.random.default_rng(3)
    for spread in (0.01, 0.1, 0.2):
        rows = rng.normal(size=64) + rng.normal(size=(300, 64)) * spread
        unit = rows / np.linalg.norm(rows, axis=1)[:, None]
        exact = np.triu(unit @ unit.T >= 0.98, 1)
        assert (int8_pairs._links_of_tile(unit, unit, True, 0.98) == exact).all()
