"""Further named queries: tables behind plots, reports as lines, registries, and what goes through sources and sinks. Their
SQL twins are in ``oracle_tables``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import log_perplexity, number_or_zero, ordering
from ..functions.text import coarse_category, full_category, slug, stage_label
from ..operators import discovery, distributions, generations, redistribution, reports, sampling, shift, similarity, transfer
from ..schemas import LAYERS
from ..sources import bindings as b
from ..sources import registry, tables, versions
from ..sources.shared import shared_path, write_shared
from . import catalog as c
from .catalog import profile, query, rounded
from .oracle import ORACLE_SQL
from .oracle_tables import TABLE_SQL

ORACLE_SQL |= TABLE_SQL

#: Labels that the category queries map: every category, with and without a number, and others.
LABELS = ("sexual_liminal_1", "sexual_explicit_12", "violence_liminal_2", "violence_explicit", "death_3", "power_1", "profanity_9", "substance_2", "neutral_1", "neutral", "unknown_thing_4", "other")


# Scores and shapes of words.


@query
def first_piece_scores(spark, sf_dir):
    words, first, _ = c._pieces(spark, sf_dir)
    candidates = distributions.top_k(words, ["prompt"], [F.desc("n"), "word"], 20).select("prompt", "word", F.substring("word", 1, 3).alias("piece"))
    return rounded(discovery.first_piece_scores(candidates, first))


@query
def stage_orderings(spark, sf_dir):
    rows = c.formation_table(spark, sf_dir).withColumn("ordering", ordering(F.col("base"), F.col("sft"), F.col("dpo")))
    return rows.groupBy("prompt", "ordering").agg(F.count(F.lit(1)).alias("n"))


def _scored_pairs(spark, sf_dir, a: str, d: str) -> DataFrame:
    """A shift over the union vocabulary of all stages' first tokens."""
    scored = c.score_vocabulary(spark, sf_dir).withColumn("word", F.col("token_id").cast("string"))
    return shift.shift_table(distributions.merged_stages(scored, ["prompt"]), a, d, 0.005)


@query
def focused_shift(spark, sf_dir):
    return rounded(_scored_pairs(spark, sf_dir, "base", "sft"), ratio=3)


@query
def trajectories_by_mass(spark, sf_dir):
    return reports.trajectory_rows(c.formation_table(spark, sf_dir), list(LAYERS), 0.002, None, "mass")


@query
def trajectories_by_change(spark, sf_dir):
    return reports.trajectory_rows(c.formation_table(spark, sf_dir), list(LAYERS), 0.004, 0.0004, "delta")


@query
def link_plot(spark, sf_dir):
    w = c.kept_wide(spark, sf_dir)
    links = c._best_links(spark, sf_dir, w).where("link = 'source' AND axis = 'sublimation'").select("prompt", F.col("other").alias("source"), F.col("word").alias("target"), "similarity")
    known = shift.formation(w, threshold=c.SHIFT).where("base > 0.0005 OR sft > 0.0005")
    return reports.link_rows(links, known, "base", "sft")


@query
def drive_ranking(spark, sf_dir):
    """The analysis table from the greatest effective mass on, words without any last."""
    rows = c.analysis_table(spark, sf_dir).select("prompt", "word", "effective_mass", "role")
    return reports.ranked_nulls_last(rows, ["prompt"], "effective_mass", "word", 150)


@query
def absorption_ranking(spark, sf_dir):
    return reports.absorption_ranks(transfer.absorption(c._transfer(spark, sf_dir)[3]))


@query
def curve_legend(spark, sf_dir):
    return rounded(reports.legend_order(c._step_words(spark, sf_dir), ["label"], "token", "base_probability"))


@query
def lens_words(spark, sf_dir):
    """Words to plot of each model and prompt: the tracked ones, then the frequent ones, each once."""
    rows = write_shared(c._lens(spark, sf_dir), "lens")
    per = ["model", "prompt"]
    tracked = rows.where("source = 'tracked'").groupBy(*per).agg(F.array_sort(F.collect_set("word")).alias("tracked"))
    often = rows.where("source = 'top_k'").groupBy(*per, "word").agg(F.countDistinct("net_layer").alias("n")).where("n >= 2").groupBy(*per).agg(F.array_sort(F.collect_set("word")).alias("often"))
    both = tracked.join(often, per, "full")
    none = F.array().cast("array<string>")
    return both.select(*per, F.array_join(F.array_distinct(F.concat(F.coalesce("tracked", none), F.coalesce("often", none))), ",").alias("words"))


@query
def log_perplexities(spark, sf_dir):
    p = c.perplexity(spark, sf_dir).where("NOT isnan(perplexity)")
    return p.select("item_id", F.round(log_perplexity(F.col("perplexity")), 6).alias("log_perplexity"))


@query
def chosen_steps(spark, sf_dir):
    return c.step_metrics(spark, sf_dir).where(F.col("step").isin(registry.numbers("1,3, 5,")))


@query
def generation_metrics(spark, sf_dir):
    return profile(b.generations(spark, sf_dir), write_shared(c._counted(spark, sf_dir, "label", "model"), "counted-vectors"))


# Reports.


@query
def formation_report(spark, sf_dir):
    """Lines for what each stage brings in and takes away."""
    w = c.kept_wide(spark, sf_dir)
    out = None
    for a, d, down, up in (("base", "sft", "sublimated", "introduced"), ("sft", "dpo", "repressed", "amplified"), ("dpo", "rlvr", "further suppressed", "further amplified")):
        part = reports.shift_sections(shift.shift_table(w, a, d, c.SHIFT), down, up, c.LEAST, 15)
        out = part if out is None else out.unionByName(part)
    return out


@query
def shift_report(spark, sf_dir):
    return reports.ratio_sections(shift.shift_table(c.wide(spark, sf_dir), "sft", "dpo", c.SHIFT), 15)


@query
def metrics_report(spark, sf_dir):
    return reports.metric_lines(c.pair_metrics(spark, sf_dir))


@query
def pairs_report(spark, sf_dir):
    return reports.pair_lines(c.moves_and_sims(spark, sf_dir)[1].where(F.col("sim") >= c.SIMILAR), 25)


@query
def large_sim_pairs(spark, sf_dir):
    """The similarity join over ten times the words and with a tenth of the threshold of change, by pairs of blocks."""
    dist = distributions.word_distribution(b.long_counts(c.word_counts(spark, sf_dir), "prompt"), ["prompt"], 10 * c.TOP)
    w = write_shared(distributions.merged_stages(dist, ["prompt"]), "wide")
    moves = similarity.movement(w, c.SHIFT / 10, c.LEAST / 10)
    return rounded(similarity.similar_words(moves, b.word_vectors(w, spark, sf_dir, c.NET_LAYERS), 0.4).withColumnRenamed("sim", "similarity"))


# Labels and registries.


@query
def label_categories(spark, sf_dir):
    """Categories of the documents' labels: a document's number picks its label."""
    label = F.element_at(F.array(*[F.lit(x) for x in LABELS]), (F.pmod("doc_id", F.lit(len(LABELS))) + 1).cast("int"))
    rows = b.table(spark, sf_dir, "documents").select(label.alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("label", coarse_category(F.col("label")).alias("coarse"), full_category(F.col("label")).alias("category"), "n")


@query
def prefixed_labels(spark, sf_dir):
    return registry.with_prefix(c.battery_summary(spark, sf_dir), "en").select("label", "n_down", "n_up")


@query
def stage_captions(spark, sf_dir):
    """Rows by stage, captioned, in the stages' order; other names stay and come last."""
    rows = b.token_logits(spark, sf_dir).groupBy("layer").agg(F.count(F.lit(1)).alias("n")).unionByName(spark.createDataFrame([("other", 0)], "layer string, n long"))
    place = F.array_position(F.array(*[F.lit(x) for x in LAYERS]), F.col("layer"))
    return rows.select(stage_label(F.col("layer")).alias("caption"), F.when(place > 0, place).otherwise(len(LAYERS) + 1).cast("int").alias("ord"), "n")


@query
def prompt_labels(spark, sf_dir):
    """The label of each benchmark text that is asked for: the first of those with that text that has words."""
    items = b.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ord"), F.concat(F.lit("item_"), (F.col("item_id") % 50).cast("string")).alias("label"), F.col("text").alias("prompt"))
    found = registry.label_of(items.where("ord % 3 = 0"), items, items.where("ord % 50 < 40"))
    return found.select(F.md5("prompt").alias("prompt_md5"), "label")


@query
def prompt_prefixes(spark, sf_dir):
    items = b.table(spark, sf_dir, "benchmark")
    return items.select("item_id", *[F.substring("text", 1, n).alias(f"first_{n}") for n in (50, 60, 80, 100)])


@query
def prompt_slugs(spark, sf_dir):
    words = F.array_join(F.slice(F.split(F.trim("text"), r"\s+"), 1, 5), "_")
    return b.table(spark, sf_dir, "benchmark").select("item_id", slug(F.col("text")).alias("slug"), words.alias("first_words"))


@query
def model_families(spark, sf_dir):
    """Families (languages) and the stages that have documents to learn from, with the number of stages of each."""
    rows = b.model_registry(spark, sf_dir)
    return rows.join(registry.layer_counts(rows), "family").withColumn("is_default", F.col("family") == "en")


@query
def tracked_words(spark, sf_dir):
    """Lists of words to follow, from the benchmark's items dealt to five lists; a word on several counts for the first."""
    lists = b.table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.filter(F.split(F.lower("text"), b.WORD_SPLIT), lambda w: w != "")).alias("pos", "token"))
    first = lists.groupBy("token").agg(F.min("item_id").alias("ord"))
    return first.withColumn("category", F.concat(F.lit("list_"), (F.col("ord") % 5).cast("string"))).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))


@query
def coerced_numbers(spark, sf_dir):
    docs = b.table(spark, sf_dir, "documents")
    return docs.select("doc_id", number_or_zero(F.col("source")).alias("source_number"), number_or_zero(F.regexp_extract("source", r"(\d+)", 1)).alias("digits"), number_or_zero(F.col("doc_id").cast("string")).alias("id_number"))


# Vectors.


@query
def passage_vectors(spark, sf_dir):
    """Passages beside their vectors, by gen_id."""
    gens = b.generations(spark, sf_dir)
    vectors = gens.select("gen_id", "vec_row").join(b.vector_rows(spark, sf_dir), "vec_row").select("gen_id", "vec")
    total = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return rounded(gens.select("gen_id", "label", "model").join(vectors, "gen_id").select("gen_id", "label", "model", F.size("vec").alias("dims"), total.alias("total")))


LETTERS = "etaoinsr"


def letter_encoder():
    """A stand-in for a sentence encoder: counts of a few letters."""

    def encode(batch: pd.DataFrame) -> pd.DataFrame:
        texts = batch["psg"].fillna("")
        return pd.DataFrame({"gen_id": batch["gen_id"], "vec": [[float(t.count(x)) for x in LETTERS] for t in texts]})

    return encode


@query
def embedded_passages(spark, sf_dir):
    """Passages through a plugged-in encoder, batch by batch."""
    made = tables.inferred(b.generations(spark, sf_dir).select("gen_id", "psg"), "gen_id long, vec array<double>", letter_encoder)
    return made.select("gen_id", *[F.col("vec")[k].alias(f"v_{x}") for k, x in enumerate(LETTERS)])


@query
def contextual_vectors(spark, sf_dir):
    """Mean of the hidden states from a word's first position on, at length 1."""
    hidden = b.table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("word"), (F.col("vec_id") % 8).alias("pos"), (F.floor(F.col("vec_id") / 8) % 3 + 2).alias("first"), F.col("embedding").alias("vec"))
    return tables.span_mean(hidden, ["word"], "first").select("word", F.posexplode("vec").alias("dim", "x")).select("word", "dim", F.round(F.col("x").cast("double"), 5).alias("x"))


@query
def generated_ids(spark, sf_dir):
    """Three tokens for each prompt by redistributed steps; what is next depends on the ids so far."""
    side = distributions.softmax(b.token_logits(spark, sf_dir), ["prompt", "layer"], temperature=0.05)
    side = write_shared(side.groupBy("prompt", "token_id").agg(*[F.max(F.when(F.col("layer") == s, F.col("prob"))).alias(s) for s in ("base", "sft", "dpo")]).where("base IS NOT NULL AND sft IS NOT NULL AND dpo IS NOT NULL"), "side")
    many = side.agg(F.max("prompt") + 1).first()[0]

    def next_logits(state: DataFrame) -> DataFrame:
        to = state.select("prompt", F.pmod(F.col("prompt") + F.aggregate("ids", F.lit(0), lambda s, x: s + x), F.lit(many)).alias("like"))
        return to.join(side.withColumnRenamed("prompt", "like"), "like").drop("like")

    out = sampling.generate(next_logits, side.select("prompt").distinct(), 3, b.token_vectors(spark, sf_dir), 1, lambda t: write_shared(t, "generated"))
    return out.select("prompt", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


#: Steps, and how many of them use the same links, of the generation whose vectors are refreshed.
STEPS, REFRESH = 7, 3


@query
def refreshed_ids(spark, sf_dir):
    """Seven tokens for each prompt by redistributed steps whose contextual vectors are made anew every three steps; vectors and
    stages follow from the ids so far, and token 0 ends a text."""
    side = distributions.softmax(b.token_logits(spark, sf_dir), ["prompt", "layer"], temperature=0.05)
    side = write_shared(side.groupBy("prompt", "token_id").agg(*[F.max(F.when(F.col("layer") == s, F.col("prob"))).alias(s) for s in ("base", "sft", "dpo")]).where("base IS NOT NULL AND sft IS NOT NULL AND dpo IS NOT NULL"), "side")
    many = side.agg(F.max("prompt") + 1).first()[0]
    rows = b.vector_rows(spark, sf_dir)
    vectors = rows.count()
    said = F.aggregate("ids", F.lit(0), lambda s, x: s + x)

    def next_probs(state: DataFrame) -> DataFrame:
        to = state.select("prompt", F.pmod(F.col("prompt") + said, F.lit(many)).alias("like"))
        return to.join(side.withColumnRenamed("prompt", "like"), "like").drop("like")

    def vectors_of(state: DataFrame) -> DataFrame:
        each = state.select("prompt", F.explode(F.sequence(F.lit(0), F.lit(b.TOKENS - 1))).alias("token_id"), said.alias("said"))
        return each.withColumn("vec_row", F.pmod(F.col("prompt") * 31 + F.col("said") * 7 + F.col("token_id"), F.lit(vectors)).cast("long")).join(rows, "vec_row").select("prompt", "token_id", "vec")

    settings = redistribution.Settings(falls=0.0005, refresh=REFRESH, end=0)
    out = redistribution.generate(next_probs, vectors_of, side.select("prompt").distinct(), STEPS, write_shared, settings)
    logged = F.transform("log", lambda x: F.concat(x["position"].cast("string"), F.lit(":"), x["token_id"].cast("string")))
    return out.select("prompt", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"), F.array_join(logged, ",").alias("log"))


# Sources and sinks: written to the shared folder and read again.


@query
def csv_round_trip(spark, sf_dir):
    rows, path = c.formation_table(spark, sf_dir), shared_path(spark, "formation-csv")
    tables.write_csv(rows, path, one_file=True)
    return tables.read_csv(spark, path, ", ".join(f"{n} {t}" for n, t in rows.dtypes))


@query
def parquet_round_trip(spark, sf_dir):
    rows, path = c.formation_table(spark, sf_dir), shared_path(spark, "formation-parquet")
    tables.write_parquet(rows, path, ("trajectory",))
    return spark.read.parquet(path).where("trajectory <> 'flat'")


@query
def json_round_trip(spark, sf_dir):
    """Records as JSON, missing numbers as 0, and back."""
    rows = c.analysis_table(spark, sf_dir).select("prompt", "word", "drive_weight", "n_condensation_sources", "role")
    return tables.from_json_rows(tables.json_rows(rows), "prompt string, word string, drive_weight double, n_condensation_sources long, role string")


@query
def cached_scores(spark, sf_dir):
    """Scores read through a cache that has some prompts, one of them out of date."""
    w = c.kept_wide(spark, sf_dir)
    of = lambda keys: rounded(shift.drive_scores(w.join(keys, "prompt", "left_semi")))
    schema = ", ".join(f"{n} {t}" for n, t in of(w.select("prompt")).dtypes)
    cache = tables.KeyedTable(spark, shared_path(spark, "scores"), schema, ("prompt",))
    some = w.select("prompt").distinct().where("prompt < 'f'")
    cache.append(of(some).withColumn("id_score", F.lit(0.0)), 0)
    cache.append(of(some), 1)
    return cache.read_through(w.select("prompt"), of, 2)


@query
def versioned_scores(spark, sf_dir):
    """Scores read through a table of versions that has some prompts, one version of which was out of date."""
    w = c.kept_wide(spark, sf_dir)
    of = lambda keys: rounded(shift.drive_scores(w.join(keys, "prompt", "left_semi")))
    schema = ", ".join(f"{n} {t}" for n, t in of(w.select("prompt")).dtypes)
    table = versions.VersionedTable(spark, shared_path(spark, "versions"), schema, ("prompt",), 4)
    some = w.select("prompt").distinct().where("prompt < 'f'")
    table.put(of(some).withColumn("id_score", F.lit(0.0)))
    table.put(of(some))
    return table.read_through(w.select("prompt"), of)


@query
def uncached_keys(spark, sf_dir):
    """Sources whose documents are not all in a cache of the labelled ones' sources."""
    docs = b.table(spark, sf_dir, "documents").select("doc_id", "source")
    held = docs.join(b.table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", "left_semi")
    return docs.select("source").distinct().join(held.select("source").distinct(), "source", "left_anti")


@query
def logged_passages(spark, sf_dir):
    """The first three passages of each key in a log that grew twice."""
    gens = b.generations(spark, sf_dir).select("family", "label", "model", "gen_id")
    log = tables.AppendLog(spark, shared_path(spark, "passages"), "family long, label long, model string, gen_id long", ("family", "label", "model"))
    for half in (1, 0):
        log.append(gens.where(F.col("gen_id") % 2 == half), ["gen_id"])
    return tables.first_of_log(log.rows(), ["family", "label", "model"], 3)


@query
def missing_passages(spark, sf_dir):
    """How many passages of forty each wanted key's log lacks."""
    gens = b.generations(spark, sf_dir).select("family", "label", "model")
    return tables.deficit(gens, gens.distinct(), ["family", "label", "model"], 40)


@query
def loaded_checkpoints(spark, sf_dir):
    """Checkpoints that a family's analysis needs, by how many are loaded together."""
    rows = b.model_registry(spark, sf_dir)
    wanted = {1: ["base"], 3: ["base", "sft", "dpo"], 4: list(LAYERS)}
    each = F.explode(F.create_map(*[x for n, s in wanted.items() for x in (F.lit(n), F.array(*[F.lit(y) for y in s]))]))
    plan = spark.range(1).select(each.alias("together", "stages")).select("together", F.explode("stages").alias("layer"))
    return rows.join(plan, "layer").groupBy("family", "together").agg(F.count(F.lit(1)).alias("n"), F.max_by("model_id", "ord").alias("last_model"))


@query
def rank_by_layer(spark, sf_dir):
    """Places of each word at every stage (melted), ties by word."""
    rows = c.formation_table(spark, sf_dir).unpivot(["prompt", "word"], list(LAYERS), "layer", "prob")
    return rows.select("prompt", "layer", "word", F.row_number().over(Window.partitionBy("prompt", "layer").orderBy(F.desc("prob"), "word")).alias("place"))
