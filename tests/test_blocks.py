import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftloom.operators import blocks, similarity


@pytest.fixture(scope="module")
def sides(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(5, 6))
    rows = []
    for k in range(160):
        v = centres[k % 5] + 0.1 * rng.normal(size=6) if k % 4 else rng.normal(size=6)
        rows.append(("p" if k < 120 else "q", f"w{k}", (v / np.linalg.norm(v)).tolist(), k % 2))
    df = spark.createDataFrame(rows, "key string, item string, vec array<double>, side int").cache()
    return rows, df.where("side = 0").select("key", "item", "vec"), df.where("side = 1").select("key", "item", "vec")


@pytest.mark.parametrize("least,block", [(0.9, 1024), (0.9, 3), (0.0, 8), (-2.0, 1024), (1.5, 1024)])
def test_pairs_are_those_of_all_products(sides, least, block):
    rows, left, right = sides
    want = {(k, a, b): float(np.dot(u, v)) for k, a, u, s in rows if s == 0 for h, b, v, t in rows if t == 1 and h == k and np.dot(u, v) >= least}
    got = {(r.key, r.source, r.target): r.sim for r in blocks.similar_pairs(left, right, ["key"], least, block).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-12 for x in want)
    assert (least < 1.5) == bool(want)


def test_far_blocks_never_meet(sides, monkeypatch):
    _, left, right = sides
    calls = lambda least: blocks.similar_pairs(left, right, ["key"], least).count()
    every, met = [], []
    over = blocks.over_blocks
    monkeypatch.setattr(blocks, "over_blocks", lambda pairs, *rest: (met if every else every).append(pairs.select("key", "bi", "bj").distinct().count()) or over(pairs, *rest))
    calls(-2.0), calls(0.95)
    assert 0 < met[0] < every[0]
    monkeypatch.undo()
    near = left.where("key = 'none'")
    assert blocks.similar_pairs(near, right, ["key"], 0.1).count() == 0 == blocks.similar_pairs(left, near, ["key"], 0.1).count()


def test_words_that_move(spark):
    moves = spark.createDataFrame([("p", "x", w, s) for w, s in (("a", "source"), ("b", "target"), ("c", "target"), ("d", "source"))], "prompt string, axis string, word string, side string")
    vectors = spark.createDataFrame([("p", w, h, v) for h in (8, 16) for w, v in (("a", [1.0, 0.0]), ("b", [0.6, 0.8]), ("c", [-1.0, 0.0]))], "prompt string, word string, net_layer int, vec array<float>")
    plain = similarity.similarity_join(moves, vectors).where(F.col("sim") >= 0.5)
    assert sorted(tuple(r) for r in similarity.similar_words(moves, vectors, 0.5).select(plain.columns).withColumn("sim", F.round("sim", 6)).collect()) == sorted(tuple(r) for r in plain.withColumn("sim", F.round("sim", 6)).collect())
