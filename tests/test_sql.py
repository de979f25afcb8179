import glob
import os

import duckdb
import pytest

from shiftloom.plans import catalog, catalog_sql, sql
from shiftloom.plans.api import Engine
from shiftloom.sources import tokenizer

from .test_queries import rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(catalog_sql.TEXTS))
def test_sql_over_functions_equals_its_twin(spark, duck, name):
    got = rows(catalog.QUERIES[name](spark, SF).toPandas())
    assert got and got == rows(duck.execute(catalog.ORACLE_SQL[name]).df())


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_tokens_by_lateral_join(spark, duck):
    got = {(r.item_id, r.place): r.id for r in catalog.QUERIES["sql_item_tokens"](spark, SF).collect()}
    lib = tokenizer.loaded(tokenizer.default_path())
    assert got == {(i, k): x for i, t in duck.execute("SELECT item_id, text FROM benchmark").fetchall() for k, x in enumerate(lib.encode(t, add_special_tokens=False).ids)}


@pytest.fixture(scope="module")
def engine(spark):
    dist = [("base", "p", "a", 0.75), ("base", "p", "b", 0.25), ("sft", "p", "a", 0.5), ("sft", "p", "c", 0.5), ("dpo", "p", "c", 1.0), ("base", "q", "a", 1.0)]
    logits = [("p", s, k, f"t{k}", float(x)) for s, v in (("base", (0, 1, 2)), ("sft", (2, 1, 0)), ("dpo", (1, 1, 1))) for k, x in enumerate(v)]
    return Engine(spark.createDataFrame(dist, "layer string, prompt string, word string, prob double"), spark.createDataFrame(logits, "prompt string, layer string, token_id int, token string, logit double"))


def test_an_engines_functions(spark, engine):
    names = sql.register(engine, "my_")
    assert {"my_shifts", "my_tokens(text STRING)", "my_shift(a STRING, b STRING, threshold DOUBLE)"} <= set(names) and not any("displacement" in n for n in names)
    q = lambda text: [tuple(r) for r in spark.sql(text).collect()]
    assert q("SELECT * FROM my_prompts() ORDER BY prompt") == [("p", 3, 3), ("q", 1, 1)]
    assert q("SELECT word, delta, down, up FROM my_shift('sft', 'dpo', 0.25D) WHERE prompt = 'p' ORDER BY word") == [("a", 0.5, True, False), ("b", 0.0, False, False), ("c", -0.5, False, True)]
    assert q("SELECT word, place FROM my_top_words('base', 1) ORDER BY prompt") == [("a", 1), ("a", 1)]
    assert q("SELECT word, trajectory FROM my_analyze('q')") == [("a", "eliminated")]
    assert [r[0] for r in q("SELECT token_id FROM my_logits('p', 'base') ORDER BY prob DESC")] == [2, 1, 0]
    assert q("SELECT direction, token_id FROM my_movers('base', 'sft', 1) ORDER BY 1") == [("down", 2), ("up", 0)]
    assert len(q("SELECT * FROM my_score_vocabulary(1)")) == 6 and q("SELECT count(*) FROM my_metrics('no_pair')") == [(0,)]
    assert q("SELECT piece FROM my_tokens('The dog')") == [("the ",), ("dog ",)] and q("SELECT * FROM my_tokens(NULL)") == []


def test_filters_reach_the_views(spark, engine):
    sql.register(engine, "my_")
    plan = spark.sql("SELECT * FROM my_shift('sft', 'dpo', 0.1D) WHERE prompt = 'p'")._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("Aggregate") == 1
