import math
import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftloom.operators.encoder import Encoder, feature_ids

SF = "/root/testdata/sf0.001"
SIZE = 512


@pytest.fixture(scope="module")
def passages(spark):
    if os.path.isdir(SF):
        texts = spark.read.parquet(f"{SF}/conversations.parquet").select((F.col("conv_id") * 64 + F.col("turn")).alias("gen_id"), F.col("text").alias("psg"))
    else:
        texts = spark.createDataFrame([(k, " ".join(f"w{(k * j) % 17}" for j in range(1, 9 + k % 5))) for k in range(80)], "gen_id long, psg string")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, " .,! "), (-4, "alone"), (-5, "alone")], "gen_id long, psg string")
    return texts.unionByName(odd).repartition(3).cache()


@pytest.fixture(scope="module")
def matrix(passages):
    """The weighed matrix, row by row, by a plain loop."""
    rows = {r.gen_id: Counter(r.ids) for r in passages.select("gen_id", feature_ids(F.col("psg"), SIZE).alias("ids")).collect()}
    full = [c for c in rows.values() if c]
    df = Counter(x for c in full for x in c)
    a = {}
    for i, c in rows.items():
        v = np.zeros(SIZE)
        for x, n in c.items():
            v[x] = (1 + math.log(n)) * (math.log((1 + len(full)) / (1 + df[x])) + 1)
        a[i] = v / (np.linalg.norm(v) or 1)
    return a


def test_features_are_words_and_their_pieces(spark):
    df = spark.createDataFrame([("Ab, ab!", "ab  AB"), ("é", "É"), ("abc", "abd")], "a string, b string")
    rows = df.select(feature_ids(F.col("a"), 1 << 20).alias("a"), feature_ids(F.col("b"), 1 << 20).alias("b")).collect()
    assert rows[0].a == rows[0].b and len(rows[0].a) == 2 + 2 * 2 and rows[1].a == rows[1].b and len(rows[1].a) == 2
    assert len(set(rows[2].a) & set(rows[2].b)) == 1


def test_vectors_are_those_of_a_full_decomposition_up_to_sign(passages, matrix):
    encoder = Encoder.fit(passages, dims=8, size=SIZE, passes=12, extra=24)
    a = np.array(list(matrix.values()))
    u, s, _ = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(encoder.singular, s[:8], rtol=1e-6)
    got = {r.gen_id: r.vec for r in encoder.embed(passages, unit=False).collect()}
    mine, want = np.array([got[i] for i in matrix]), (u * s)[:, :8]
    for k in range(8):
        if min(s[k - 1] - s[k] if k else 1, s[k] - s[k + 1]) > 1e-3:
            assert min(np.abs(mine[:, k] - want[:, k]).max(), np.abs(mine[:, k] + want[:, k]).max()) < 1e-4
    inner = np.abs(np.linalg.svd(mine @ mine.T - want @ want.T, compute_uv=False)[0])
    assert inner < 1e-3


def test_unit_vectors_zero_rows_and_equal_rows(passages):
    encoder = Encoder.fit(passages, dims=6, size=SIZE)
    got = {r.gen_id: np.array(r.vec) for r in encoder.embed(passages).collect()}
    assert not got[-1].any() and not got[-2].any() and not got[-3].any() and (got[-4] == got[-5]).all()
    assert all(abs(np.linalg.norm(v) - 1) < 1e-9 for v in got.values() if v.any())


def test_kept_encoder_gives_the_same_vectors_and_columns_stay(spark, passages):
    encoder = Encoder.fit(passages, dims=4, size=64)
    again = Encoder.of_table(encoder.table(spark))
    some = passages.withColumn("_ids2", F.lit(1)).withColumnRenamed("psg", "text x")
    got = [(r.gen_id, r.vec) for r in again.embed(some, "text x", "vec").collect()]
    assert sorted(got) == sorted((r.gen_id, r.vec) for r in encoder.embed(passages).collect())


def test_fewer_rows_than_dims_and_no_rows(passages):
    few = Encoder.fit(passages.where("gen_id IN (-4, -5)"), dims=5, size=SIZE)
    assert (few.singular > 1e-6).sum() == 1 and abs(few.singular[0] - math.sqrt(2)) < 1e-9
    none = Encoder.fit(passages.where("gen_id = -1"), dims=5, size=SIZE)
    assert not none.directions.any() and all(not any(r.vec) for r in none.embed(passages).collect())
