import random

import numpy as np
from pyspark.sql import functions as F

from shiftloom.llm import quality_qda as q
from shiftloom.llm.bloom_lm import fold

from .conftest import words


def test_statistics_of_a_text():
    texts = ["", "One two, TWO two two!\nOne\nOne", "é", "  \n", "a | b"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])
    x = {f: q.statistics(data, offsets)[:, k] for k, f in enumerate(q.FEATURES)}
    share = lambda a, b: np.log((a + 0.05) / (b + 0.1) / (1 - (a + 0.05) / (b + 0.1)))
    assert np.allclose(np.expm1(x["chars"]), [len(t) for t in texts]) and np.allclose(np.expm1(x["words"]), [0, 7, 1, 0, 3])
    # Words in lower case: one, two, (two,) and two!; the second "two" follows "two".
    assert np.isclose(x["distinct_words"][1], share(4, 7)) and np.isclose(x["repeats"][1], share(2, 7)) and np.isclose(x["distinct_lines"][1], share(2, 3))
    assert np.isclose(x["upper_words"][1], share(1, 7)) and np.isclose(x["symbol_ends"][4], share(1, 3)) and np.isclose(x["wide"][2], share(2, 2)) and np.isfinite(list(x.values())).all()


def labelled(spark):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        good = rng.random() < 0.8
        text = words(rng, rng.randint(30, 120))
        rows.append((i, text if good else " | ".join(text.split()).upper() + "!!", int(good)))
    docs = spark.createDataFrame([(i, t, "c") for i, t, _ in rows] + [(600, None, "c"), (601, "", "c"), (602, "x" * 200_000, "c"), (5, rows[5][1], "c")], "doc_id long, text string, x string").repartition(3)
    return rows, docs, spark.createDataFrame([(i, y, 0) for i, _, y in rows if i % 2], "doc_id long, quality int, toxic int")


def test_learns_from_training_rows_alone(spark):
    rows, docs, labels = labelled(spark)
    got = q.scored(docs, labels, fold(0)).collect()
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(got) == 604 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    # Labels of held-out rows change nothing.
    turned = labels.withColumn("quality", F.when(fold(0), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {(r.doc_id, round(r.score, 9)) for r in q.scored(docs, turned, fold(0)).collect()} == {(r.doc_id, round(r.score, 9)) for r in got}
    kept = q.accepted(docs, labels, fold(0))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.predicted)


def test_without_one_class_or_rows(spark):
    _, docs, labels = labelled(spark)
    assert {r.score for r in q.scored(docs, labels.where("quality = 1"), fold(0)).collect()} == {1.0}
    assert {r.score for r in q.scored(docs, labels.where("false"), fold(0)).collect()} == {0.5}
    assert q.scored(docs.where("false"), labels, fold(0)).count() == 0


def test_discriminant_is_the_difference_of_log_densities():
    rng = np.random.default_rng(0)
    p = 4
    x = [rng.normal(size=(5000, p)) @ np.diag([1, 2, 3, 4]), rng.normal(size=(5000, p)) + 1]
    model = q.fit_density(np.array([5000.0, 5000.0]), np.array([y.sum(0) for y in x]), np.array([y.T @ y for y in x]))
    at = rng.normal(size=(10, p))
    log = lambda y, m, v: -0.5 * ((y - m) ** 2 / v).sum(1) - 0.5 * np.log(v).sum()
    want = log(at, np.ones(p), np.ones(p)) - log(at, np.zeros(p), np.array([1.0, 4, 9, 16]))
    assert np.abs(model.discriminant(at) - want).max() < 1.5 and np.corrcoef(model.discriminant(at), want)[0, 1] > 0.99
