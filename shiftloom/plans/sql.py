"""SQL surface: an engine's tables as temporary views, its analyses as table functions.

    register(engine)
    spark.sql("SELECT * FROM shift('sft', 'dpo', 0.01) WHERE down")

Views: ``word_dist`` (layer, prompt, word, prob), ``stages`` (prompt, word, one column a stage), ``formations``, ``shifts`` (every
pair of stages, with column ``axis``), ``drive_scores``; with logits ``token_logits``, ``token_probs``, ``token_metrics``; with
vectors ``word_vec`` and ``word_links``. Table functions, which take the place of a server's endpoints:

    prompts()                                prompts that can be analysed, with their number of stages and words
    top_words(stage, k)                      each prompt's likeliest words at a stage
    analyze(prompt)                          formation of a prompt's words with trajectories
    shift(a, b, threshold)                   change from stage a to stage b, with flags
    movers(a, b, k)                          tokens that lose and gain most
    logits(prompt, stage)                    a prompt's tokens with logit and probability
    score_vocabulary(k)                      all stages scored on the union of their first k tokens
    metrics(pair)                            divergences of a pair of stages
    displacement_map(layer, least)           linked words at a network layer
    id_scores(k)                             each prompt's k words of most drive

All are SQL functions over the views, so Catalyst plans a query as one: a filter on the prompt reaches the scan. What needs
a tokenizer is a Python table function, ``tokens(text)`` (position, id, piece), to be joined laterally. ``prefix`` sets
names apart where a session has several engines. Names of other functions and views of the session are left alone,
those of the same name are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import distributions, shift, similarity
from ..schemas import LAYERS
from ..sources import bindings as b
from ..sources import tokenizer
from .api import Engine

STAGE_PAIRS = tuple((x, y) for k, x in enumerate(LAYERS) for y in LAYERS[k + 1 :])


def all_shifts(stages: DataFrame) -> DataFrame:
    """(prompt, axis, word, base, p_from, p_to, delta, ratio) of every pair of stages; words of a pair as in ``shift_table``."""
    out = None
    for x, y in STAGE_PAIRS:
        part = shift.shift_table(stages, x, y).select("prompt", F.lit(f"{x}_{y}").alias("axis"), "word", "base", "p_from", "p_to", "delta", "ratio")
        out = part if out is None else out.unionByName(part)
    return out


def views(engine: Engine, links: bool) -> dict[str, DataFrame]:
    out = {"word_dist": engine.word_dist, "stages": engine.stages, "formations": shift.formation(engine.stages, threshold=engine.threshold), "shifts": all_shifts(engine.stages), "drive_scores": engine.id_scores()}
    if engine.token_logits is not None:
        probs = distributions.softmax(engine.token_logits, ["prompt", "layer"])
        pairs = distributions.pair_table(probs, ["prompt"], "token_id")
        out |= {"token_logits": engine.token_logits, "token_probs": probs, "token_pairs": pairs, "token_metrics": distributions.metrics(pairs, ["prompt", "pair"], "token_id", 50)}
    if links:
        moves = similarity.movement(engine.stages, engine.threshold, engine.threshold)
        out |= {"word_vec": engine.word_vec, "word_links": similarity.similarity_join(moves, engine.word_vec)}
    return out


def functions(p: str, kind: str, logits: bool, links: bool) -> dict[str, str]:
    """Name: parameters, result and body of each table function; ``kind``: SQL type of a prompt of the logits."""
    out = {
        "prompts()": ("prompt STRING, n_stages BIGINT, n_words BIGINT", f"SELECT prompt, count(DISTINCT layer), count(DISTINCT word) FROM {p}word_dist GROUP BY prompt"),
        "top_words(stage STRING, k INT)": ("prompt STRING, word STRING, prob DOUBLE, place INT", f"SELECT * FROM (SELECT prompt, word, prob, row_number() OVER (PARTITION BY prompt ORDER BY prob DESC, word) AS place FROM {p}word_dist WHERE layer = stage) WHERE place <= k"),
        "analyze(asked STRING)": ("prompt STRING, word STRING, base DOUBLE, sft DOUBLE, dpo DOUBLE, rlvr DOUBLE, trajectory STRING", f"SELECT prompt, word, base, sft, dpo, rlvr, trajectory FROM {p}formations WHERE prompt = asked"),
        "shift(a STRING, b STRING, threshold DOUBLE)": ("prompt STRING, word STRING, base DOUBLE, p_from DOUBLE, p_to DOUBLE, delta DOUBLE, ratio DOUBLE, down BOOLEAN, up BOOLEAN", f"SELECT prompt, word, base, p_from, p_to, delta, ratio, delta > threshold, delta < -threshold FROM {p}shifts WHERE axis = a || '_' || b"),
        "id_scores(k INT)": ("prompt STRING, word STRING, id_score DOUBLE, place INT", f"SELECT * FROM (SELECT prompt, word, id_score, row_number() OVER (PARTITION BY prompt ORDER BY id_score DESC, word) AS place FROM {p}drive_scores) WHERE place <= k"),
    }
    if logits:
        sides = " UNION ALL ".join(f"SELECT *, '{d}' AS direction, {sign}delta AS size FROM moved" for d, sign in (("down", ""), ("up", "-")))
        out |= {
            f"logits(asked {kind}, stage STRING)": ("token_id INT, logit DOUBLE, prob DOUBLE", f"SELECT token_id, logit, prob FROM {p}token_probs WHERE prompt = asked AND layer = stage"),
            "score_vocabulary(k INT)": (f"prompt {kind}, layer STRING, token_id INT, prob DOUBLE", f"""WITH best AS (SELECT DISTINCT prompt, token_id FROM (SELECT prompt, token_id, row_number() OVER (PARTITION BY prompt, layer ORDER BY logit DESC, token_id) AS place FROM {p}token_logits) WHERE place <= k),
                some AS (SELECT l.prompt, l.layer, l.token_id, exp(l.logit - max(l.logit) OVER (PARTITION BY l.prompt, l.layer)) AS e FROM {p}token_logits l LEFT SEMI JOIN best ON l.prompt = best.prompt AND l.token_id = best.token_id)
                SELECT prompt, layer, token_id, e / sum(e) OVER (PARTITION BY prompt, layer) FROM some"""),
            "metrics(asked STRING)": (f"prompt {kind}, kl DOUBLE, js DOUBLE, overlap DOUBLE, rank_corr DOUBLE, entropy_a DOUBLE, entropy_b DOUBLE", f"SELECT prompt, kl, js, overlap, rank_corr, entropy_a, entropy_b FROM {p}token_metrics WHERE pair = asked"),
            "movers(a STRING, b STRING, k INT)": (f"prompt {kind}, direction STRING, token_id INT, prob_a DOUBLE, prob_b DOUBLE, delta DOUBLE", f"""WITH moved AS (SELECT prompt, token_id, pa, pb, pa - pb AS delta FROM {p}token_pairs WHERE pair = a || '_' || b),
                placed AS (SELECT *, row_number() OVER (PARTITION BY prompt, direction ORDER BY size DESC, token_id) AS place FROM ({sides}))
                SELECT prompt, direction, token_id, pa, pb, delta FROM placed WHERE place <= k"""),
        }
    if links:
        out["displacement_map(layer INT, least DOUBLE)"] = ("prompt STRING, axis STRING, source STRING, target STRING, similarity DOUBLE", f"SELECT prompt, axis, source, target, sim FROM {p}word_links WHERE net_layer = layer AND sim >= least")
    return {f"{p}{head}": f"RETURNS TABLE ({columns}) RETURN {body}" for head, (columns, body) in out.items()}


class Tokens:
    """tokens(text): the text's tokens under the default vocabulary, in order."""

    def eval(self, text: str) -> Iterator[tuple[int, int, str]]:
        path = tokenizer.default_path()
        for place, i in enumerate(tokenizer.loaded(path).encode(text or "", add_special_tokens=False).ids):
            yield place, i, tokenizer.decoded_ids(path, [i])


def register(engine: Engine, prefix: str = "") -> list[str]:
    """Makes the views and functions in the engine's session; their names (functions with their parameters)."""
    spark = engine.word_dist.sparkSession
    logits, links = engine.token_logits is not None, engine.word_vec is not None
    tables = views(engine, links)
    for name, df in tables.items():
        df.createOrReplaceTempView(f"{prefix}{name}")
    kind = engine.token_logits.schema["prompt"].dataType.simpleString() if logits else "string"
    made = functions(prefix, kind, logits, links)
    for head, body in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} {body}")
    spark.udtf.register(f"{prefix}tokens", F.udtf(Tokens, returnType="place int, id int, piece string"))
    return [*(f"{prefix}{t}" for t in tables), *made, f"{prefix}tokens(text STRING)"]


def engine_of(spark: SparkSession, sf_dir: str, top: int, threshold: float, net_layers: tuple[int, ...]) -> Engine:
    """The engine over the driver's tables."""
    counts = b.stage_counts(b.tokens(spark, sf_dir), "prompt")
    dist = distributions.word_distribution(b.long_counts(counts, "prompt"), ["prompt"], top)
    engine = Engine(dist, b.token_logits(spark, sf_dir), None, threshold, net_layers)
    engine.word_vec = b.word_vectors(engine.stages, spark, sf_dir, net_layers)
    return engine
