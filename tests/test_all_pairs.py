"""Work on all pairs of a group moves its rows a few times, not once for every block of others."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftloom.operators import blocks, generations, permutations, similarity
from shiftloom.operators.encoder import Encoder
from shiftloom.plans import catalog, catalog_learnt


def moved(spark, job):
    """What ``job`` gives, and the rows that its shuffles wrote."""
    sc, gateway = spark.sparkContext, spark.sparkContext._gateway

    def written():
        none = sc._jvm.java.util.ArrayList()
        stages = sc._jsc.sc().statusStore().stageList(none, False, False, gateway.new_array(sc._jvm.double, 0), none)
        return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteRecords() for k in range(stages.size())}

    before = written()
    out = job()
    return out, sum(n for k, n in written().items() if k not in before)


MANY, DIMS = 10000, 8


@pytest.fixture(scope="module")
def passages(spark):
    """One label's passages of two models, with vectors of their own."""
    x = np.random.default_rng(3).normal(size=(MANY, DIMS))
    rows = [(0, ("base", "sft")[k % 2], k, 1 + k % 3, x[k].tolist()) for k in range(MANY)]
    return x, spark.createDataFrame(rows, "label long, model string, vec_row long, n long, vec array<double>").repartition(4).cache()


def plain_silhouette(x):
    n, model = 1 + np.arange(len(x)) % 3, np.arange(len(x)) % 2
    share = np.stack([n * (model == m) for m in (0, 1)], 1)
    sums = np.concatenate([np.sqrt(((x[at : at + 100, None] - x[None]) ** 2).sum(2)) @ share for at in range(0, len(x), 100)])
    sizes, at = share.sum(0), np.arange(len(x))
    a, b = sums[at, model] / (sizes[model] - 1), sums[at, 1 - model] / sizes[1 - model]
    return float((n * (b - a) / np.maximum(a, b)).sum() / n.sum())


def test_silhouette_moves_each_vector_a_few_times(spark, passages):
    x, counted = passages
    counted.count()
    got, size = moved(spark, lambda: generations.silhouette(counted, ["label"]).collect())
    assert math.isclose(got[0].silhouette, plain_silhouette(x), abs_tol=1e-9)
    assert size < 12 * MANY, size


@pytest.mark.parametrize("block,held", [(7, 1 << 10), (64, 1 << 12), (1024, 1 << 26)])
def test_sums_are_the_same_for_blocks_and_parts_of_any_size(spark, block, held):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 3))
    rows = [(g, m, v, 1 + v % 4, 9, x[v].tolist()) for g in ("a", "b") for m in ("p", "q") for v in range(40) if rng.random() < 0.7]
    df = spark.createDataFrame(rows, "g string, model string, vec_row long, n long, size long, vec array<double>")
    got = {(r.g, r.m, r.i, r.o): (r.ni, r.so, r.t) for r in blocks.distance_sums(df, ["g"], block, held).collect()}
    want = {(g, m, v, o): (n, 9, sum(n2 * np.linalg.norm(x[v] - x[w]) for g2, o2, w, n2, _, _ in rows if (g2, o2) == (g, o))) for g, m, v, n, _, _ in rows for o in ("p", "q")}
    assert got.keys() == want.keys() and all(got[k][:2] == want[k][:2] and math.isclose(got[k][2], want[k][2], abs_tol=1e-6) for k in want)


def test_profile_moves_each_vector_a_few_times(spark, passages):
    _, counted = passages
    gens = counted.select("label", "model", "vec_row", F.concat(F.lit("w"), F.col("vec_row") % 50, F.lit(" said")).alias("psg"))
    got, size = moved(spark, lambda: catalog.profile(gens, counted).collect())
    assert got[0].entropy_base > 3 and math.isclose(got[0].silhouette, round(plain_silhouette(passages[0]), 6), abs_tol=1e-6)
    assert size < 16 * MANY, size


@pytest.fixture(scope="module")
def two_groups(spark):
    """Items whose true groups follow their vectors."""
    rng = np.random.default_rng(6)
    grp = rng.integers(0, 2, 3000)
    x = rng.normal(size=(3000, DIMS)) + 3 * grp[:, None]
    items = spark.createDataFrame([(k * 3, int(g), v.tolist()) for k, (g, v) in enumerate(zip(grp, x, strict=True))], "id long, grp int, vec array<double>").repartition(4).cache()
    items.count()
    return (x[grp == 0] @ x[grp == 1].T).max(1).mean(), items


def test_keyed_best_matches_move_each_item_a_few_times(spark, two_groups):
    observed, items = two_groups
    got, size = moved(spark, lambda: permutations.best_test(items, 40, 0, 1).first())
    assert math.isclose(got.observed, observed, abs_tol=1e-8)
    assert size < 8 * 3000, size


def test_md5_best_matches_move_each_item_a_few_times(spark, two_groups):
    observed, items = two_groups
    got, size = moved(spark, lambda: similarity.permutation_best(items, 40).first())
    assert math.isclose(got.observed, observed, abs_tol=1e-8)
    assert size < 8 * 3000, size


@pytest.mark.parametrize("width", [0.001, 8.0])
def test_last_draws_are_those_of_a_sort(spark, monkeypatch, width):
    monkeypatch.setattr(similarity, "WIDTH", width)
    tails = [f":{k}" for k in range(500)] + [""]
    df = spark.createDataFrame([(t,) for t in tails], "tail string").repartition(3)
    for n0 in (1, 100, 501):
        got = similarity.last_draws(df, 30, n0, len(tails))
        want = [sorted(hashlib.md5(f"{p}{t}".encode()).hexdigest() for t in tails)[n0 - 1] for p in range(1, 31)]
        assert [f"{a:016x}{b:016x}" for a, b in got.tolist()] == want


def test_query_of_a_thousand_moves_each_item_a_few_times(spark, two_groups, tmp_path):
    two_groups[1].selectExpr("id AS vec_id", "grp AS label", "vec AS embedding").where("id < 3000").write.parquet(str(tmp_path / "embeddings.parquet"))
    got, size = moved(spark, lambda: catalog.QUERIES["perm_test_best_1000"](spark, str(tmp_path)).first())
    assert 0 <= got.p_value <= 1
    assert size < 500 * 1000, size


def test_profile_of_encoded_passages_moves_each_vector_a_few_times(spark):
    rng = np.random.default_rng(8)
    encoder = Encoder(np.ones(64), rng.normal(size=(64, DIMS)), np.ones(DIMS))
    gens = spark.createDataFrame([(0, ("base", "sft")[k % 2], f"word{k} of text{k * 7 % 501}") for k in range(MANY)], "label long, model string, psg string").repartition(4)
    gens, vectors = catalog_learnt.encoded(gens, encoder)
    counted = generations.counted_vectors(gens, vectors, ["label", "model"]).cache()
    many = counted.count()
    got, size = moved(spark, lambda: catalog.profile(gens, counted).collect())
    assert many > 0.9 * MANY and got[0].silhouette is not None
    assert size < 16 * MANY, size
