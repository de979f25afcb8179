"""Named queries that are SQL text over the views and table functions of ``sql``; their twins in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources import bindings as b
from . import catalog as c
from . import sql
from .catalog import QUERIES, query
from .oracle import _FORMATION, _TOKEN_PAIRS, _W, ORACLE_SQL

#: Queries of this module without a twin: a tokenizer is no SQL.
NAMES = ["sql_item_tokens"]

TEXTS = {
    "sql_prompts": "SELECT prompt, n_stages, n_words FROM prompts()",
    "sql_top_words": "SELECT prompt, word, round(prob, 6) AS prob, place FROM top_words('sft', 15)",
    "sql_analyze": "SELECT prompt, word, base, sft, dpo, rlvr, trajectory FROM analyze('en') WHERE trajectory <> 'flat'",
    "sql_shift": "SELECT prompt, 'sft_dpo' AS axis, word, round(base, 6) AS base, round(p_from, 6) AS p_from, round(p_to, 6) AS p_to, round(delta, 6) AS delta, round(ratio, 3) AS ratio, down, up FROM shift('sft', 'dpo', 0.0005D)",
    "sql_shift_sums": "SELECT s.prompt, s.down, count(*) AS n, round(sum(s.delta), 6) AS mass FROM shift('base', 'rlvr', 0.0005D) AS s JOIN prompts() AS p ON s.prompt = p.prompt WHERE s.down OR s.up GROUP BY s.prompt, s.down",
    "sql_id_scores": "SELECT prompt, word, round(id_score, 6) AS id_score, place FROM id_scores(10)",
    "sql_score_vocabulary": "SELECT prompt, layer, token_id, round(prob, 6) AS prob FROM score_vocabulary(20)",
    "sql_metrics": "SELECT prompt, round(kl, 6) AS kl, round(js, 6) AS js FROM metrics('sft_dpo')",
    "sql_movers": "SELECT prompt, direction, token_id, round(prob_a, 6) AS prob_a, round(prob_b, 6) AS prob_b, round(delta, 6) AS delta FROM movers('sft', 'dpo', 5)",
    "sql_displacement_map": "SELECT prompt, axis, source, target, round(similarity, 6) AS similarity FROM displacement_map(16, 0.15D)",
}


def registered(spark, sf_dir: str) -> list[str]:
    return sql.register(sql.engine_of(spark, sf_dir, c.TOP, c.SHIFT, c.NET_LAYERS))


def _query(name: str) -> None:
    def run(spark, sf_dir) -> DataFrame:
        registered(spark, sf_dir)
        return spark.sql(TEXTS[name])

    run.__name__ = name
    query(run)


for _name in TEXTS:
    _query(_name)


@query
def sql_item_tokens(spark, sf_dir):
    """Tokens of the benchmark's texts, by a lateral join with a Python table function."""
    registered(spark, sf_dir)
    b.table(spark, sf_dir, "benchmark").createOrReplaceTempView("asked_items")
    return spark.sql("SELECT i.item_id, t.place, t.id, t.piece FROM asked_items AS i, LATERAL tokens(i.text) AS t")


def _twin(name: str, sql_text: str) -> None:
    assert name in QUERIES
    ORACLE_SQL[name] = sql_text


_twin("sql_prompts", f"WITH {_W} SELECT prompt, count(DISTINCT layer) AS n_stages, count(DISTINCT word) AS n_words FROM dist GROUP BY prompt")
_twin("sql_top_words", f"WITH {_W} SELECT prompt, word, round(prob, 6) AS prob, place::INTEGER AS place FROM (SELECT prompt, word, prob, row_number() OVER (PARTITION BY prompt ORDER BY prob DESC, word) AS place FROM dist WHERE layer = 'sft') WHERE place <= 15")
_twin("sql_analyze", f"WITH {_FORMATION} SELECT prompt, word, base, sft, dpo, rlvr, trajectory FROM formation WHERE prompt = 'en' AND trajectory <> 'flat'")
_twin("sql_shift", ORACLE_SQL["shift_sft_dpo"])
_twin("sql_shift_sums", f"WITH {_W} SELECT prompt, base - rlvr > 0.0005 AS down, count(*) AS n, round(sum(base - rlvr), 6) AS mass FROM wide WHERE base - rlvr > 0.0005 OR base - rlvr < -0.0005 GROUP BY ALL")
_SCORES = ORACLE_SQL["id_scores"].replace("round(repression * drive_weight, 6)", "repression * drive_weight")
_twin("sql_id_scores", f"SELECT prompt, word, round(id_score, 6) AS id_score, place::INTEGER AS place FROM (SELECT prompt, word, id_score, row_number() OVER (PARTITION BY prompt ORDER BY id_score DESC, word) AS place FROM ({_SCORES})) WHERE place <= 10")
_twin("sql_score_vocabulary", ORACLE_SQL["score_vocabulary"])
_twin("sql_metrics", f"SELECT prompt, kl, js FROM ({ORACLE_SQL['kl_pairs']}) JOIN ({ORACLE_SQL['js_pairs']}) USING (prompt, pair) WHERE pair = 'sft_dpo'")
_twin("sql_movers", f"""WITH {_TOKEN_PAIRS}, moved AS (SELECT prompt, token_id, pa, pb, pa - pb AS delta FROM pt WHERE pair = 'sft_dpo'),
    placed AS (SELECT *, row_number() OVER (PARTITION BY prompt, direction ORDER BY size DESC, token_id) AS place FROM (SELECT *, 'down' AS direction, delta AS size FROM moved UNION ALL SELECT *, 'up', -delta FROM moved))
    SELECT prompt, direction, token_id, round(pa, 6) AS prob_a, round(pb, 6) AS prob_b, round(delta, 6) AS delta FROM placed WHERE place <= 5""")
_twin("sql_displacement_map", f"SELECT prompt, axis, source, target, similarity FROM ({ORACLE_SQL['sim_pairs']}) WHERE net_layer = 16")
