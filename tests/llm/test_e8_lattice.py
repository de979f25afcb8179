import numpy as np
import pytest

from shiftloom.llm import e8_lattice as e8
from shiftloom.llm.e8_lattice import near_vectors


def test_decodes_to_the_nearest_point():
    x = np.random.default_rng(0).normal(size=(300, 8)) * 2
    point, rest = e8.decode(x)
    assert len(e8.roots()) == 240 and np.allclose(point / 2 + rest, x)
    for p, y in zip(point, x, strict=True):
        assert ((y - p / 2) ** 2).sum() <= ((y - (p + e8.roots()) / 2) ** 2).sum(1).min() + 1e-9
        assert p.sum() % 4 == 0 and len(set(p % 2)) == 1


def test_recall_at_the_least_cosine():
    rng = np.random.default_rng(2)
    u = rng.normal(size=(3000, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    v = rng.normal(size=u.shape)
    v -= (v * u).sum(1, keepdims=True) * u
    v = 0.9 * u + np.sqrt(1 - 0.81) * v / np.linalg.norm(v, axis=1, keepdims=True)
    (h, p), (g, q) = e8.cell_keys(u), e8.cell_keys(v)
    met = np.array([e8.meet(h[:, t], p[:, t], g[:, t], q[:, t])[0] for t in range(e8.TABLES)]).any(0)
    apart = np.bitwise_count((e8.signs(u) ^ e8.signs(v)).view(np.uint64)).sum(1)
    assert met.mean() > 0.99 and (apart <= e8.SIGNS_APART).mean() > 0.999


@pytest.mark.parametrize("hot_cell", [4096, 6])
def test_counts_and_components_are_exact(spark, hot_cell):
    """With small cells, and with cells dealt out to pairs of blocks."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=(12, 24))
    rows = []
    for k, b in enumerate(base):
        for j in range(1 + 2 * k):
            rows.append((100 * k + j, (b + rng.normal(size=24) * 0.09).tolist()))
    rows += [(rows[5][0] + 5000, rows[5][1]), (rows[5][0] + 5001, rows[5][1]), (rows[6][0] + 6000, [2 * x for x in rows[6][1]]), (9000, rows[7][1][:12])]
    rows += [(9001, None), (9002, [0.0] * 24), (9003, [1.0, float("nan")] * 12), (9004, [1.0, float("inf")] * 12), (9005, [None, 1.0]), (9006, [])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, node int")
    got = {r.vec_id: r for r in near_vectors(df, hot_cell=hot_cell).collect()}
    ids = [i for i, _ in rows]
    good = {i: np.array(v) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = {i: [j for j in ids if j != i and i in good and j in good and len(good[i]) == len(good[j]) and good[i] @ good[j] >= 0.9 * np.linalg.norm(good[i]) * np.linalg.norm(good[j])] for i in ids}
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            new = set(links[todo.pop()]) - seen
            seen |= new
            todo += new
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(links[i]), min(seen), min(seen) == i)
    assert len(got) == len(rows) and near_vectors(df.where("false")).count() == 0
