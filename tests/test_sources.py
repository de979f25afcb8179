import pytest
from pyspark.sql import functions as F

from shiftloom.sources import registry, tables
from shiftloom.streaming import events as stream


def test_csv_keeps_odd_words(spark, tmp_path):
    rows = [("a,b", 0.5), ('say "hi"', None), ("", 0.25), ("NA", 1.0)]
    df = spark.createDataFrame(rows, "word string, p double")
    tables.write_csv(df, str(tmp_path / "c"), one_file=True)
    got = tables.read_csv(spark, str(tmp_path / "c"), "word string, p double").collect()
    assert sorted((r.word or "", r.p or 0) for r in got) == sorted((w, p or 0) for w, p in rows)


def test_cache_works_out_what_it_lacks(spark, tmp_path):
    asked = []

    def compute(keys):
        asked.extend(sorted(r.prompt for r in keys.collect()))
        return keys.withColumn("v", F.length("prompt"))

    cache = tables.KeyedTable(spark, str(tmp_path / "k"), "prompt string, v int", ("prompt",))
    want = spark.createDataFrame([("a",), ("bb",), ("a",)], "prompt string")
    assert {(r.prompt, r.v) for r in cache.read_through(want, compute).collect()} == {("a", 1), ("bb", 2)}
    more = spark.createDataFrame([("bb",), ("ccc",)], "prompt string")
    assert {(r.prompt, r.v) for r in cache.read_through(more, compute, 1).collect()} == {("bb", 2), ("ccc", 3)} and asked == ["a", "bb", "ccc"]
    cache.append(spark.createDataFrame([("a", 9)], "prompt string, v int"), 2)
    assert {r.v for r in cache.rows().where("prompt = 'a'").collect()} == {9}


def test_log_gives_first_rows_and_deficit(spark):
    log = spark.createDataFrame([("x", i, f"t{i}") for i in range(4)], "k string, seq long, psg string")
    want = spark.createDataFrame([("x",), ("y",)], "k string")
    assert sorted(r.psg for r in tables.first_of_log(log, ["k"], 2).collect()) == ["t0", "t1"]
    assert {(r.k, r.deficit) for r in tables.deficit(log, want, ["k"], 6).collect()} == {("x", 2), ("y", 6)}


def test_json_rows(spark):
    df = spark.createDataFrame([("w", None, float("nan"), None)], "word string, n int, p double, trajectory string")
    assert tables.json_rows(df).first().json == '{"word":"w","n":0,"p":0.0,"trajectory":"flat"}'


def test_inferred_and_span_mean(spark):
    def load():
        return lambda batch: batch.assign(n=batch.prompt.str.len())

    assert tables.inferred(spark.createDataFrame([("abc",)], "prompt string"), "prompt string, n long", load).first().n == 3
    hidden = spark.createDataFrame([("w", p, 1, [float(p), 1.0]) for p in range(3)], "word string, pos int, start int, vec array<float>")
    got = tables.span_mean(hidden, ["word"], "start").first().vec
    assert [round(x, 4) for x in got] == [0.8321, 0.5547]


def test_registry_checks_stages(spark):
    df = registry.model_registry(spark, {"two": {"base": "b", "dpo": "d"}, "four": {"base": "b", "sft": "s", "dpo": "d", "rlvr": "r"}})
    assert {r.family: r.n_layers for r in registry.layer_counts(df).collect()} == {"two": 2, "four": 4}
    with pytest.raises(ValueError):
        registry.model_registry(spark, {"half": {"base": "b", "sft": "s"}})
    prompts = registry.prompt_table(spark, {"calm_1": "x", "calm_12": "y", "loud": "z"}, {"loud"})
    assert {r.category for r in prompts.collect()} == {"calm", "loud"} and registry.with_prefix(prompts, "calm").count() == 2


def test_streamed_windows_equal_batch_counts(spark, tmp_path):
    import datetime

    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(hours=i), i % 12, "click", 1.0, '{"k": %d}' % (i % 3)) for i in range(200)]
    spark.createDataFrame(rows, stream.EVENTS).repartition(3).write.parquet(str(tmp_path / "e"))
    counts = stream.token_windows(stream.event_stream(spark, str(tmp_path / "e"), 3))
    query = counts.writeStream.format("memory").queryName("windows").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    got = spark.table("windows")
    assert got.agg(F.sum("n")).first()[0] == 200 and got.select("start").distinct().count() == 3


def test_log_numbers_rows_of_each_key_from_batch_to_batch(spark, tmp_path):
    log = tables.AppendLog(spark, str(tmp_path / "log"), "k string, v int", ("k",))
    assert log.rows().count() == 0
    log.append(spark.createDataFrame([("a", 2), ("a", 1), ("b", 7)], "k string, v int"), ["v"])
    log.append(spark.createDataFrame([("a", 0), ("c", 5)], "k string, v int"), ["v"])
    assert sorted((r.k, r.seq, r.v) for r in log.rows().collect()) == [("a", 1, 1), ("a", 2, 2), ("a", 3, 0), ("b", 1, 7), ("c", 1, 5)]
    assert {(r.k, r.v) for r in tables.first_of_log(log.rows(), ["k"], 2).collect()} == {("a", 1), ("a", 2), ("b", 7), ("c", 5)}


def test_lists_and_labels(spark):
    assert registry.numbers(" 1,20, ,3") == [1, 20, 3]
    first = {r.token: r.category for r in registry.tracked_words(spark, {"x": ["a", "b"], "y": ["c"]}).collect()}
    assert first == {"a": "x", "b": "x", "c": "y"}
    prompts = spark.createDataFrame([(0, "l0", "p"), (1, "l1", "p"), (2, "l2", "q")], "ord int, label string, prompt string")
    asked = spark.createDataFrame([("p",), ("q",), ("r",)], "prompt string")
    got = registry.label_of(asked, prompts, spark.createDataFrame([("l1",), ("l2",)], "label string"))
    assert {(r.prompt, r.label) for r in got.collect()} == {("p", "l1"), ("q", "l2")}


def test_jobs_write_a_commands_tables(spark, tmp_path, capsys, monkeypatch):
    from shiftloom.plans import jobs

    monkeypatch.setitem(jobs.COMMANDS, "battery", ("one", "two"))
    monkeypatch.setitem(jobs.QUERIES, "one", lambda s, d: s.createDataFrame([("en_1", 1), ("de_1", 2)], "label string, v int"))
    monkeypatch.setitem(jobs.QUERIES, "two", lambda s, d: s.createDataFrame([(1,)], "v int"))
    assert jobs.main(["battery", "--data", "x", "--output", str(tmp_path), "--category", "en"]) == 0
    assert [r.v for r in spark.read.parquet(str(tmp_path / "one")).collect()] == [1] and spark.read.parquet(str(tmp_path / "two")).count() == 1
    assert jobs.main(["info", "--family", "amber"]) == 0 and len(capsys.readouterr().out.splitlines()) == 4
