"""Lattice hashing against all cosines."""

import math

import numpy as np

from surgekit.llm import embedding_dedup as ed

SCHEMA = "vec_id long, embedding array<float>, label int, node long"


def brute(ids, vectors, threshold=0.95):
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for v in vectors]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if o else None for v, o in zip(vectors, ok, strict=True)]
    n = len(ids)
    link = [[j for j in range(n) if j != i and ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold]
            for i in range(n)]
    return link


def component_of(ids, link):
    out = [None] * len(ids)
    for i in range(len(ids)):
        if out[i] is None:
            seen, todo = {i}, [i]
            while todo:
                for j in link[todo.pop()]:
                    if j not in seen:
                        seen.add(j)
                        todo.append(j)
            for j in seen:
                out[j] = min(ids[k] for k in seen)
    return out


def corpus():
    r = np.random.default_rng(11)
    near = lambda x, c: c * x + math.sqrt(1 - c * c) * _orthogonal(r, x)
    base = r.standard_normal((60, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    vectors = [b for b in base]
    for b in base[:40]:
        vectors += [near(b, c) for c in (0.96, 0.975, 0.99)]
    vectors += [base[1] * 7, base[1], base[1], base[2]]
    vectors = [v.astype(np.float32).tolist() for v in vectors]
    vectors += [None, [], [0.0] * 64, [None, *[1.0] * 63], [float("nan"), *[1.0] * 63], [float("inf")] * 64, [1.0] * 8, [1.0] * 8, [1e-30] * 64]
    return list(range(5, 5 + 2 * len(vectors), 2)), vectors


def _orthogonal(r, x):
    z = r.standard_normal(len(x))
    z -= (z @ x) * x
    return z / np.linalg.norm(z)


def test_matches_all_pairs(spark):
    ids, vectors = corpus()
    link = brute(ids, vectors)
    rows = [(i, v, 0, None) for i, v in zip(ids, vectors, strict=True)]
    got = {r["vec_id"]: r for r in ed.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    for i, c, near in zip(ids, component_of(ids, link), link, strict=True):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (len(near), c, i == c), i


def test_hot_cells_spread_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(ed, "CHUNK", 8)  # pickled with the driver's value where blocks are cut, read anew in tasks
    r = np.random.default_rng(2)
    x = r.standard_normal(16)
    vectors = [(x + 0.02 * r.standard_normal(16)).astype(np.float32).tolist() for _ in range(90)]
    ids = list(range(90))
    got = ed.near_duplicates(spark.createDataFrame([(i, v, 0, 0) for i, v in zip(ids, vectors, strict=True)], SCHEMA)).collect()
    assert {r["n_links"] for r in got} == {89} and {r["component_id"] for r in got} == {0}


def test_recall_at_the_threshold():
    r = np.random.default_rng(3)
    x = r.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.stack([0.9501 * a + math.sqrt(1 - 0.9501**2) * _orthogonal(r, a) for a in x])
    lattice = ed.Lattice(64)
    found = ed._met_earlier(ed.TABLES, lattice.cells(x), lattice.cells(y))
    assert found.mean() >= 0.99


def test_decoded_points_are_nearest():
    r = np.random.default_rng(5)
    x = r.standard_normal((200, 8)) * 2
    p = ed.nearest_points(x)
    others = p[:, None, :] + ed.SHORTEST[None]
    assert (((x - p) ** 2).sum(1)[:, None] <= ((x[:, None] - others) ** 2).sum(2) + 1e-9).all()
    assert ((p.sum(1) % 2) == 0).all()


def test_empty_and_null_ids(spark):
    assert ed.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    got = ed.near_duplicates(spark.createDataFrame([(None, [1.0, 2.0], 0, 0), (4, [1.0, 2.0], 0, 0)], SCHEMA)).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in got) == [(0, 1, 4, False), (4, 1, 4, True)]
