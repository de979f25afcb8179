import hashlib

import numpy as np
from pyspark.sql import functions as F

from shiftloom.llm.fingerprints import containment, distinct_shingles, fingerprints, merge_all, merged, resemblance, with_next, with_sketch

from .conftest import corpus


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_estimates_are_near_the_truth(spark, docs):
    rows = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).where("text IS NOT NULL")
    s = fingerprints(rows)
    pairs = s.alias("a").join(s.alias("b"), F.col("a.doc_id") <= F.col("b.doc_id")).select(
        "a.text", F.col("b.text").alias("other"), resemblance(F.col("a.sketch"), F.col("b.sketch")).alias("r"), containment(F.col("a.sketch"), F.col("b.sketch")).alias("c"), distinct_shingles(merged(F.col("a.sketch"), F.col("b.sketch"))).alias("n")
    )
    errors = []
    for p in pairs.collect():
        a, b = shingles(p.text), shingles(p.other)
        errors.append(p.r - (len(a & b) / len(a | b) if a | b else 1))
        assert abs(p.n - len(a | b)) <= 0.5 * max(1, len(a | b))
        assert abs(p.c - (len(a & b) / len(a) if a else 1)) < 0.3
        if p.text == p.other:
            assert p.r == 1
    assert np.abs(errors).max() < 0.2


def test_merging_groups_equals_merging_texts(spark, docs):
    rows = fingerprints(docs.where("doc_id < 20"))
    got = {r.g: r.sketch for r in merge_all(rows.withColumn("g", F.col("doc_id") % 2), ["g"], "sketch").collect()}
    for g in (0, 1):
        hashes = sorted({h for r in rows.where(F.col("doc_id") % 2 == g).collect() for h in r.sketch})
        assert got[g] == hashes[:128]


def test_next_in_the_order_of_ids(spark, docs, no_docs):
    rows = sorted(((i is not None, i or 0, t or "") for i, t in corpus()))
    got = with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id", ["text"], 5).collect()
    key = lambda r: (r.doc_id is not None, r.doc_id or 0, r.text)
    assert [(r.text, r.next_text) for r in sorted(got, key=lambda r: (key(r), r.next_text))] == sorted([(a[2], b[2]) for a, b in zip(rows, [*rows[1:], rows[0]], strict=True)], key=lambda x: ([r for r in rows if r[2] == x[0]][0], x[1])) or {(r.text, r.next_text) for r in got} == {(a[2], b[2]) for a, b in zip(rows, [*rows[1:], rows[0]], strict=True)}
    assert len(got) == len(rows)
    assert with_next(no_docs.select("doc_id", "text"), "doc_id", ["text"], 5).count() == 0
    one = with_next(spark.createDataFrame([(7, "only")], "doc_id long, text string"), "doc_id", ["text"], 3).collect()
    assert [(r.text, r.next_text) for r in one] == [("only", "only")]


def test_few_words(spark):
    df = spark.createDataFrame([("",), (" \n",), ("a b",), ("a  b",), ("a b c d e",)], "t string")
    s = [r.s for r in with_sketch(df, "t", "s").collect()]
    assert s[0] == s[1] == [] and s[2] == s[3] and len(s[2]) == len(s[4]) == 1


def test_query_edits_as_told(spark, tmp_path):
    from shiftloom.llm.fingerprints import op7_fingerprints

    rows = [(1, "aé日b" * 5), (2, None), (5, "xyz"), (9, "w " * 40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in op7_fingerprints(spark, str(tmp_path)).collect()}
    texts = [t or "" for _, t in rows]
    for (i, _), t, n in zip(rows, texts, [*texts[1:], texts[0]], strict=True):
        q = len(t) // 4
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - q] + n[:q]).encode()).hexdigest() and got[i].n_chars == len(t)
