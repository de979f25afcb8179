import random

import corpus_pipeline

from .conftest import words


def test_stages_run_one_after_the_other(spark, tmp_path):
    rng = random.Random(8)
    passage = words(rng, 60)
    rows, labels = [], []
    for i in range(120):
        text = words(rng, rng.randint(60, 150))
        bad = i % 6 == 0
        rows.append((i, text if not bad else " | ".join(text.split()).upper() + "!!"))
        labels.append((i, int(not bad), 0))
    rows += [(200, rows[1][1]), (201, rows[2][1] + " odd"), (202, rows[3][1] + " " + passage), (203, passage + " " + words(rng, 90)), (204, None)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, ids = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        ids.append({r.doc_id for r in docs.collect()})
        if name == "suffix-array dedup":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert {202, 203} <= ids[-1], ids[0] & {202, 203}
            assert not any(passage in (r.text or "") for r in docs.collect()) and all(r.n_chars == len(r.text) for r in docs.collect() if r.text is not None)
    bad = {i for i in range(120) if i % 6 == 0}
    assert not ids[0] & bad and len(ids[0]) >= 103 and {200, 201} & ids[0] and not {200, 201} & ids[1]
    # What starts with most of its words shared with another text stays if that isn't four fifths of its shingles.
    assert ids[1] == ids[2] == ids[3] and ids[1] >= ids[0] - {200, 201, 202, 203, 3}
    whole = {(r.doc_id, r.piece, r.length) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == {(r.doc_id, r.piece, r.length) for r in docs.collect()}


def run_over(spark, folder, docs, labels, ddl="doc_id long, text string, lang string, source string, n_chars long"):
    spark.createDataFrame(docs, ddl).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return corpus_pipeline.run(spark, folder)


def test_empty_tables(spark, tmp_path):
    assert run_over(spark, str(tmp_path / "a"), [], [(1, 1, 0)]).count() == 0
    # Without labels nothing is known against a text: all stay, copies but one aside.
    text = words(random.Random(1), 40)
    got = run_over(spark, str(tmp_path / "b"), [(1, text, "en", "s", 9), (2, text, "en", "s", 9), (3, None, None, None, None), (None, "alone", "en", "s", 5)], [])
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == [(False, 1), (False, 3), (True, 0)]


def test_clashing_names_and_odd_rows(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, words(rng, 30) if i % 5 else ["", None, "x" * 3000][i % 3], "en", "s", i, "n", "l", "k", 1, "p", 2, "q") for i in range(40)]
    rows += [rows[1], rows[1], (50, rows[2][1], "en", "s", 1, "n", "l", "k", 1, "p", 2, "q")]
    ddl = "doc_id long, text string, lang string, source string, n_chars long, node string, label string, `key` string, piece int, spans string, quality int, _spans string"
    got = run_over(spark, str(tmp_path), rows, [(i, i % 2, 0) for i in range(0, 40, 3)], ddl)
    assert {"doc_id", "piece", "sequence_id"} <= set(got.columns) and 0 < got.select("doc_id").distinct().count() <= 40
