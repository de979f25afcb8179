"""Named queries over the driver's tables. Each binds the tables to an operator's inputs and rounds what it gives, so
that values can be compared between engines; their SQL twins are in ``oracle``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import category_of, part_of_speech
from ..operators import discovery, distributions, generations, lens, sampling, shift, similarity, stats, steps, taxonomy, transfer
from ..schemas import LAYERS
from ..sources import bindings as b
from ..sources.shared import write_shared
from .oracle import ORACLE_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Thresholds for word distributions of the corpus (the usual ones are for a model's).
SHIFT, LEAST, SIMILAR, TOP = 0.0005, 0.0005, 0.15, 200
NET_LAYERS, MIDDLE = (8, 16, 24), 16
TRACKED = (3, 17)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, **places: int) -> DataFrame:
    """``df`` with doubles rounded to six places, or as many as given."""
    return df.select(*[F.round(c, places.get(c, 6)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.stage_counts(b.tokens(spark, sf_dir), "prompt")


def wide_of(counts: DataFrame) -> DataFrame:
    return distributions.merged_stages(distributions.word_distribution(b.long_counts(counts, "prompt"), ["prompt"], TOP), ["prompt"])


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide_of(word_counts(spark, sf_dir))


def kept_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``wide`` as a table, for queries that read it more than once: the documents are scanned once."""
    return write_shared(wide(spark, sf_dir), "wide")


def token_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distributions.softmax(b.token_logits(spark, sf_dir), ["prompt", "layer"])


def token_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distributions.pair_table(token_probs(spark, sf_dir), ["prompt"], "token_id")


def _shift(a: str, c: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(shift.shift_table(wide(spark, sf_dir), a, c, SHIFT), ratio=3)

    run.__name__ = f"shift_{a}_{c}"
    return query(run)


for _a, _b in (("base", "sft"), ("sft", "dpo"), ("dpo", "rlvr"), ("base", "dpo")):
    _shift(_a, _b)


@query
def formation_table(spark, sf_dir):
    return shift.formation(wide(spark, sf_dir), threshold=SHIFT)


@query
def formation_two_stages(spark, sf_dir):
    from ..functions.numeric import trajectory

    rows = wide(spark, sf_dir).where("base > 0 OR dpo > 0")
    r = rows.select("prompt", "word", F.round("base", 6).alias("base"), F.round("dpo", 6).alias("dpo"), F.round(F.col("dpo") - F.col("base"), 6).alias("dpo_minus_base"))
    return r.withColumn("trajectory", trajectory(F.col("base"), None, F.col("dpo"), SHIFT))


@query
def trajectory_counts(spark, sf_dir):
    return formation_table(spark, sf_dir).groupBy("prompt", "trajectory").agg(F.count(F.lit(1)).alias("n"))


@query
def significant_words(spark, sf_dir):
    return shift.moving(shift.significant(formation_table(spark, sf_dir), ["base", "sft", "dpo", "rlvr"], 0.002), ["base", "sft", "dpo", "rlvr"], 0.0003).select("prompt", "word", "base", "sft", "dpo", "rlvr")


@query
def formation_gradient(spark, sf_dir):
    """Words by the sum of their probabilities over the stages: each prompt's first 25."""
    rows = formation_table(spark, sf_dir).withColumn("total", F.round(F.col("base") + F.col("sft") + F.col("dpo") + F.col("rlvr"), 6))
    return distributions.top_k(rows, ["prompt"], [F.desc("total"), "word"], 25, "rank").select("prompt", "rank", "word", "base", "sft", "dpo", "rlvr", "total")


@query
def caption_words(spark, sf_dir):
    """The words of each stage that a caption names, with the trajectory where they are known from."""
    rows = formation_table(spark, sf_dir).unpivot(["prompt", "word"], list(LAYERS), "layer", "prob")
    best = distributions.top_k(rows, ["prompt", "layer"], [F.desc("prob"), "word"], 15, "rank")
    words = F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"])
    return best.groupBy("prompt", "layer").agg(F.concat_ws(", ", words).alias("caption"))


@query
def top_words_by_stage(spark, sf_dir):
    """Union of each stage's first 20 words, with all their probabilities (melted)."""
    rows = formation_table(spark, sf_dir).unpivot(["prompt", "word"], list(LAYERS), "layer", "prob")
    best = distributions.top_k(rows, ["prompt", "layer"], [F.desc("prob"), "word"], 20).select("prompt", "word").distinct()
    return rows.join(best, ["prompt", "word"], "left_semi")


@query
def id_scores(spark, sf_dir):
    return rounded(shift.drive_scores(wide(spark, sf_dir)))


@query
def battery_summary(spark, sf_dir):
    """A battery of prompts (language and source): shift from sft to dpo of each."""
    words = b.tokens(spark, sf_dir).withColumn("prompt", F.concat_ws("_", "prompt", F.regexp_extract("source", r"(\d+)", 1)))
    dist = distributions.word_distribution(b.long_counts(b.stage_counts(words, "prompt"), "prompt"), ["prompt"], TOP)
    shifts = shift.shift_table(distributions.merged_stages(dist, ["prompt"]), "sft", "dpo", SHIFT)
    out = shift.battery_summary(shifts.withColumn("delta", F.round("delta", 9)), ["prompt"]).withColumnRenamed("prompt", "label")
    return rounded(out.withColumn("category", category_of(F.col("label"))))


@query
def softmax_entropy(spark, sf_dir):
    return rounded(distributions.entropy(token_probs(spark, sf_dir), ["prompt", "layer"]))


@query
def kl_pairs(spark, sf_dir):
    return rounded(distributions.kl(token_pairs(spark, sf_dir), ["prompt", "pair"]))


@query
def js_pairs(spark, sf_dir):
    return rounded(distributions.js(token_pairs(spark, sf_dir), ["prompt", "pair"]))


def pair_metrics(spark, sf_dir):
    return distributions.metrics(token_pairs(spark, sf_dir), ["prompt", "pair"], "token_id", 10)


@query
def topk_overlap(spark, sf_dir):
    return pair_metrics(spark, sf_dir).select("prompt", "pair", "overlap")


@query
def spearman_pairs(spark, sf_dir):
    return rounded(pair_metrics(spark, sf_dir).select("prompt", "pair", "rank_corr"))


@query
def metrics_wide(spark, sf_dir):
    m = pair_metrics(spark, sf_dir)
    of = lambda pair, c: F.max(F.when(F.col("pair") == pair, F.col(c)))
    columns = []
    for x, y in (("base", "sft"), ("sft", "dpo"), ("base", "dpo"), ("dpo", "rlvr")):
        p = f"{x}_{y}"
        columns += [of(p, "kl").alias(f"kl_{p}"), of(p, "js").alias(f"js_{p}"), of(p, "overlap").alias(f"overlap_{p}"), of(p, "rank_corr").alias(f"rank_corr_{p}"), (of(p, "entropy_a") - of(p, "entropy_b")).alias(f"entropy_drop_{p}")]
    return rounded(m.groupBy("prompt").agg(*columns))


@query
def top_movers(spark, sf_dir):
    probs = token_pairs(spark, sf_dir).where("pair = 'sft_dpo'")
    named = probs.withColumn("token", F.when(F.col("token_id") % 13 == 0, "").otherwise(F.concat(F.lit("t"), F.col("token_id").cast("string"))))
    return rounded(shift.movers(named, 5, ["prompt"]).select("prompt", "direction", "token", F.col("pa").alias("prob_a"), F.col("pb").alias("prob_b"), "delta"))


@query
def score_vocabulary(spark, sf_dir):
    """All stages scored on the union of their first 20 tokens."""
    logits = b.token_logits(spark, sf_dir)
    vocabulary = distributions.top_k(logits, ["prompt", "layer"], [F.desc("logit"), "token_id"], 20)
    return rounded(distributions.restricted(logits, vocabulary, ["prompt"], "token_id").select("prompt", "layer", "token_id", "prob"))


def moves_and_sims(spark, sf_dir, w: DataFrame | None = None):
    w = kept_wide(spark, sf_dir) if w is None else w
    moves = similarity.movement(w, SHIFT, LEAST)
    return moves, similarity.similarity_join(moves, b.word_vectors(w, spark, sf_dir, NET_LAYERS))


@query
def sim_pairs(spark, sf_dir):
    return rounded(moves_and_sims(spark, sf_dir)[1].where(F.col("sim") >= SIMILAR).withColumnRenamed("sim", "similarity"))


def _best_links(spark, sf_dir, w: DataFrame | None = None):
    return similarity.best_links(moves_and_sims(spark, sf_dir, w)[1], MIDDLE, SIMILAR)


@query
def best_links(spark, sf_dir):
    return _best_links(spark, sf_dir)


@query
def peak_layer(spark, sf_dir):
    return rounded(similarity.peak_layer(moves_and_sims(spark, sf_dir)[1], 0.25))


@query
def sim_matrix(spark, sf_dir):
    return rounded(similarity.similarity_matrix(moves_and_sims(spark, sf_dir)[1], NET_LAYERS))


@query
def orphans(spark, sf_dir):
    moves, sims = moves_and_sims(spark, sf_dir)
    return similarity.orphans(moves, sims.where(F.col("sim") >= 0.4))


@query
def source_ranking(spark, sf_dir):
    """Each axis' eight sources with the strongest link."""
    best = moves_and_sims(spark, sf_dir)[1].groupBy("prompt", "axis", "source").agg(F.round(F.max("sim"), 6).alias("similarity"))
    return distributions.top_k(best, ["prompt", "axis"], [F.desc("similarity"), "source"], 8, "rank")


@query
def formation_links(spark, sf_dir):
    """The formation of every word that has a best source, beside it (left join)."""
    w = kept_wide(spark, sf_dir)
    links = _best_links(spark, sf_dir, w).where("link = 'source' AND axis = 'sublimation'").select("prompt", "word", F.col("other").alias("sublimated_from"), "similarity")
    f = shift.formation(w, threshold=SHIFT).select("prompt", F.col("word").alias("sublimated_from"), F.col("base").alias("source_base"), F.col("sft").alias("source_sft"))
    return links.join(f, ["prompt", "sublimated_from"], "left")


@query
def overdetermination(spark, sf_dir):
    probs = token_probs(spark, sf_dir).where("layer = 'base'").select("prompt", "token_id", "prob")
    return rounded(similarity.overdetermination(b.token_vectors(spark, sf_dir), probs, 20))


def _two_groups(spark, sf_dir):
    e = b.table(spark, sf_dir, "embeddings").where("label IN (0, 1)")
    return e.select(F.col("vec_id").alias("id"), F.col("label").alias("grp"), F.col("embedding").alias("vec"))


@query
def perm_test_mean(spark, sf_dir):
    return rounded(similarity.permutation_mean(_two_groups(spark, sf_dir), 1000))


@query
def perm_test_best(spark, sf_dir):
    return rounded(similarity.permutation_best(_two_groups(spark, sf_dir), 1000))


@query
def perm_test_mean_1000(spark, sf_dir):
    return rounded(similarity.permutation_mean(_two_groups(spark, sf_dir), 1000))


@query
def perm_test_best_1000(spark, sf_dir):
    return rounded(similarity.permutation_best(_two_groups(spark, sf_dir), 1000))


def _transfer(spark, sf_dir, version: int = 4):
    w = kept_wide(spark, sf_dir)
    gone = transfer.suppressed(w, 0.0002)
    allowed = transfer.permitted(w, gone, 0.0005)
    vectors = b.word_vectors(w, spark, sf_dir, (MIDDLE,))
    mass = F.col("effective_mass") if version == 4 else F.col("raw_mass")
    weight = F.col("similarity") * (F.lit(1.0) + F.col("target_base") * F.lit(10.0)) if version == 2 else None
    return w, gone, allowed, transfer.edges(gone, allowed, vectors, mass, weight, SIMILAR, 0.00001, stems=version == 4)


def _transferred(version: int) -> Query:
    def run(spark, sf_dir):
        return rounded(transfer.redistributed(*_transfer(spark, sf_dir, version)))

    run.__name__ = f"transfer_v{version}"
    return query(run)


for _v in (4, 3, 2):
    _transferred(_v)


@query
def transfer_edges(spark, sf_dir):
    return rounded(_transfer(spark, sf_dir)[3], mass=9)


@query
def suppressed_words(spark, sf_dir):
    return rounded(transfer.suppressed(wide(spark, sf_dir), 0.0002))


@query
def absorption(spark, sf_dir):
    return rounded(transfer.absorption(_transfer(spark, sf_dir)[3]), total_absorbed=9)


@query
def transfer_distance(spark, sf_dir):
    w, _, _, links = _transfer(spark, sf_dir)
    return rounded(transfer.mean_distance(w, links))


@query
def analysis_table(spark, sf_dir):
    w, gone, allowed, links = _transfer(spark, sf_dir)
    return rounded(transfer.analysis(w, transfer.redistributed(w, gone, allowed, links), gone, links, SHIFT, 0.00015))


@query
def role_table(spark, sf_dir):
    """Counts, sums and means of the analysis table by role."""
    rows = analysis_table(spark, sf_dir)
    return rounded(rows.groupBy("prompt", "role").agg(F.count(F.lit(1)).alias("n"), F.sum("raw_repression").alias("raw"), F.sum("displaced_mass").alias("displaced"), F.avg("base_drive").alias("mean_base")), raw=5, displaced=5)


@query
def first_words(spark, sf_dir):
    return generations.first_words(b.generations(spark, sf_dir), ["label", "model"])


@query
def prompt_words(spark, sf_dir):
    return generations.prompt_words(b.generations(spark, sf_dir), ["label"], 15).select("label", "rank", "word", "n")


@query
def first_word_entropy(spark, sf_dir):
    return rounded(generations.first_word_entropy(b.generations(spark, sf_dir), ["label", "model"]))


def _counted(spark, sf_dir, *keys):
    return generations.counted_vectors(b.generations(spark, sf_dir), b.vector_rows(spark, sf_dir), list(keys))


@query
def centroid_dist(spark, sf_dir):
    return rounded(generations.centroid_distance(_counted(spark, sf_dir, "label", "model"), ["label"]))


@query
def intra_variance(spark, sf_dir):
    return rounded(generations.spread(_counted(spark, sf_dir, "label", "model"), ["label", "model"]))


@query
def variance_ratio(spark, sf_dir):
    """Rounded variance of the last stage over that of base, where base has any."""
    v = generations.to_last(intra_variance(spark, sf_dir), ["label"], "variance").where("base > 0 AND last IS NOT NULL")
    return v.select("label", F.round(F.col("last") / F.col("base"), 6).alias("variance_ratio"))


@query
def mean_cosine(spark, sf_dir):
    return rounded(generations.mean_cosine(_counted(spark, sf_dir, "label", "model"), ["label", "model"]))


@query
def silhouette(spark, sf_dir):
    return rounded(generations.silhouette(_counted(spark, sf_dir, "label", "model"), ["label"]))


def _concepts(spark, sf_dir):
    """Concept axes from vectors with labels, and the passages' mean scores along them."""
    e = b.table(spark, sf_dir, "embeddings").where("label IN (0, 1, 2, 3)")
    seeds = e.select(F.when(F.col("label") < 2, "first").otherwise("second").alias("axis"), F.when(F.col("label") % 2 == 0, "positive").otherwise("negative").alias("polarity"), F.col("embedding").alias("vec"))
    return generations.concept_scores(_counted(spark, sf_dir, "label", "model"), generations.concept_axis(seeds), ["label", "model"])


@query
def concept_scores(spark, sf_dir):
    return rounded(_concepts(spark, sf_dir))


@query
def concept_shift(spark, sf_dir):
    v = generations.to_last(_concepts(spark, sf_dir), ["label", "axis"], "mean_score").where("base IS NOT NULL AND last IS NOT NULL")
    return v.select("label", "axis", F.round(F.col("last") - F.col("base"), 6).alias("shift"))


def _battery(spark, sf_dir):
    m = distributions.js(token_pairs(spark, sf_dir).where("pair = 'base_dpo'"), ["prompt"])
    return m.select((F.col("prompt") % 4).alias("family"), (F.col("prompt") % 6).alias("label"), "prompt", "js")


@query
def gen_vs_logit_join(spark, sf_dir):
    logit = _battery(spark, sf_dir).groupBy("family", "label").agg(F.avg("js").alias("js_logit"))
    gen = generations.centroid_distance(_counted(spark, sf_dir, "family", "label", "model"), ["family", "label"]).where("model = 'sft'").select("family", "label", F.col("distance").alias("distance_gen"))
    return rounded(logit.join(gen, ["family", "label"]))


@query
def gen_vs_logit_corr(spark, sf_dir):
    return rounded(stats.pearson(gen_vs_logit_join(spark, sf_dir).withColumn("kind", F.lit("js_distance")), ["kind"], "js_logit", "distance_gen"))


@query
def category_family_pivot(spark, sf_dir):
    rows = _battery(spark, sf_dir).withColumn("category", F.when(F.col("label") < 3, "low").otherwise("high"))
    return rounded(rows.groupBy("category").agg(*[F.avg(F.when(F.col("family") == f, F.col("js"))).alias(f"family_{f}") for f in range(4)]))


@query
def category_means(spark, sf_dir):
    """Mean metrics by category, in the categories' own order; one without rows is there with nulls."""
    order = spark.createDataFrame([(0, "low"), (1, "high"), (2, "none")], "ord int, category string")
    m = pair_metrics(spark, sf_dir).where("pair = 'sft_dpo'").withColumn("category", F.when(F.col("prompt") % 6 < 3, "low").otherwise("high"))
    means = m.groupBy("category").agg(*[F.avg(c).alias(c) for c in ("entropy_a", "entropy_b", "kl", "js", "overlap", "rank_corr")])
    return rounded(order.join(means, "category", "left"))


@query
def step_metrics(spark, sf_dir):
    return rounded(steps.step_metrics(steps.smoothed(b.step_counts(spark, sf_dir)), 10))


def _step_words(spark, sf_dir):
    counts = b.step_counts(spark, sf_dir)
    often = distributions.top_k(counts.groupBy("token").agg(F.sum("n").alias("n")).withColumn("g", F.lit(0)), ["g"], [F.desc("n"), "token"], 8, "ord")
    category = F.when(F.length("token") < 2, "short").when(F.col("token").endswith("7"), "seven")
    return steps.step_words(steps.smoothed(counts), often.select("token", category.alias("category"), "ord"))


@query
def step_words(spark, sf_dir):
    return rounded(_step_words(spark, sf_dir))


@query
def onset_curve(spark, sf_dir):
    return rounded(steps.onset_curve(_step_words(spark, sf_dir)))


@query
def lag_pair(spark, sf_dir):
    return rounded(steps.lag_pair(steps.smoothed(b.step_counts(spark, sf_dir))))


@query
def step_category(spark, sf_dir):
    m = steps.step_metrics(steps.smoothed(b.step_counts(spark, sf_dir)), 10).withColumn("category", F.col("label") % 3)
    return rounded(m.groupBy("step", "category").agg(F.avg("js_base_step").alias("js"), F.avg("kl_base_step").alias("kl")))


@query
def perplexity(spark, sf_dir):
    """Benchmark passages under the corpus' add-one bigram model. One pass over the documents counts how often each word is
    followed, and apart by which of the followers that are asked for: a table with a row per word."""

    def followed(name: str, key: str) -> DataFrame:
        words = b.table(spark, sf_dir, name).select(key, F.filter(F.split(F.lower("text"), b.WORD_SPLIT), lambda w: w != "").alias("w"))
        pairs = F.when(F.size("w") > 0, F.transform(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.struct(F.col("w")[i].alias("a"), F.get("w", i + 1).alias("c"))))
        return words.select(key, F.explode_outer(pairs).alias("x")).select(key, "x.a", "x.c")

    # A passage of one word, or none, is asked for nothing, but has a row.
    asked = followed("benchmark", "item_id").withColumn("a", F.when(F.col("c").isNotNull(), F.col("a")))
    pairs = asked.where("a IS NOT NULL").select("a", "c").distinct().withColumn("asked", F.lit(True))
    each = followed("documents", "doc_id").where("a IS NOT NULL").join(pairs, ["a", "c"], "left")
    counts = each.withColumn("follower", F.when(F.col("asked"), F.col("c"))).groupBy("a", "follower").agg(F.count("c").alias("n")).withColumnRenamed("follower", "c")
    by_follower = F.map_from_entries(F.collect_list(F.when(F.col("c").isNotNull(), F.struct("c", "n"))))
    words = write_shared(counts.groupBy("a").agg(F.sum("n").alias("na"), by_follower.alias("of")), "followed-words")
    found = asked.join(words, "a", "left")
    logp = F.when(F.col("a").isNotNull(), F.ln((F.coalesce(F.col("of")[F.col("c")], F.lit(0)) + F.lit(1.0)) / (F.coalesce("na", F.lit(0)) + F.lit(words.count()))))
    return rounded(distributions.perplexity(found.withColumn("logp", logp), ["item_id"]), perplexity=4)


def _lens(spark, sf_dir):
    return lens.lens_rows(b.lens_logits(spark, sf_dir), list(TRACKED), 5)


@query
def lens_rows(spark, sf_dir):
    return rounded(_lens(spark, sf_dir), probability=8)


@query
def lens_frequent(spark, sf_dir):
    return lens.frequent_words(_lens(spark, sf_dir), 2)


@query
def lens_peak(spark, sf_dir):
    return rounded(lens.peaks(_lens(spark, sf_dir)), probability=8)


def taxonomy_rows(spark, sf_dir, lexicon: DataFrame | None = None):
    """``lexicon`` (word, pos, zipf): a tagger's and a frequency table; without one, parts of speech by suffix and the
    corpus' own frequencies."""
    counts = write_shared(word_counts(spark, sf_dir), "word-counts")
    if lexicon is None:
        lexicon = taxonomy.zipf(counts.groupBy("word").agg(F.sum("n_base").alias("n"))).withColumn("pos", part_of_speech(F.col("word")))
    moves, sims = moves_and_sims(spark, sf_dir, write_shared(wide_of(counts), "wide"))
    pairs = sims.where(F.col("sim") >= 0.3).select("prompt", "axis", "source", "target", F.col("sim").alias("similarity"), "net_layer")
    return taxonomy.classified(pairs, similarity.orphans(moves, pairs), lexicon)


@query
def taxonomy_pairs(spark, sf_dir):
    return rounded(taxonomy_rows(spark, sf_dir).withColumn("net_layer", F.col("net_layer").cast("double")))


@query
def taxonomy_pct(spark, sf_dir):
    return rounded(taxonomy.shares(taxonomy_rows(spark, sf_dir), ["axis"], "displacement_type"))


@query
def taxonomy_crosstab(spark, sf_dir):
    kinds = ("genre_change", "archaic", "register_shift", "category_shift")
    return taxonomy_rows(spark, sf_dir).groupBy("prompt").agg(*[F.count(F.when(F.col("displacement_type") == k, 1)).alias(k) for k in kinds])


def _token_mass(spark, sf_dir):
    vocabulary = b.table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), b.WORD_SPLIT)).alias("word")).where("word <> ''").distinct()
    hit = wide(spark, sf_dir).join(vocabulary, "word", "left_semi")
    return hit.groupBy("prompt").agg(F.sum("base").alias("base_mass"), F.sum("dpo").alias("dpo_mass")).withColumn("mass_displaced", F.col("base_mass") - F.col("dpo_mass"))


@query
def token_mass(spark, sf_dir):
    return rounded(_token_mass(spark, sf_dir))


@query
def mann_whitney(spark, sf_dir):
    """U of the divergences of every seventh prompt against the others', by family."""
    rows = _battery(spark, sf_dir).withColumn("js", F.round("js", 9))
    return stats.mann_whitney_u(rows, ["family"], "js", F.col("prompt") % 7 == 0)


def _pieces(spark, sf_dir):
    words = b.tokens(spark, sf_dir).groupBy("prompt", "word").agg(F.count(F.lit(1)).alias("n"))
    at = F.sequence(F.lit(0), F.floor((F.length("word") - 1) / 3).cast("int"))
    cut = words.withColumn("p", F.concat(F.transform(at, lambda i: F.substring(F.col("word"), i * 3 + 1, F.lit(3))), F.array(F.lit(discovery.BOUNDARY))))
    first = cut.groupBy("prompt", F.col("p")[0].alias("piece")).agg(F.sum("n").alias("n"))
    # The outer form: every word has a pair, and no filter is drawn from it that would set this scan apart from the other's.
    pairs = cut.select("prompt", "n", F.explode_outer(F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.struct(F.col("p")[i - 1].alias("cur"), F.col("p")[i].alias("nxt")))).alias("x"))
    moves = pairs.groupBy("prompt", "x.cur", "x.nxt").agg(F.sum("n").alias("n"))
    return words, first, discovery.transitions(moves)


@query
def discover_words(spark, sf_dir):
    _, first, moves = _pieces(spark, sf_dir)
    return rounded(discovery.discover(first, moves))


@query
def word_logprobs(spark, sf_dir):
    words, first, moves = _pieces(spark, sf_dir)
    candidates = distributions.top_k(words, ["prompt"], [F.desc("n"), "word"], 20).select("prompt", "word")
    return rounded(discovery.word_logprobs(candidates, first, moves, 3).select("prompt", "word", "prob"))


@query
def sample_tokens(spark, sf_dir):
    logits = b.token_logits(spark, sf_dir).where("layer = 'dpo'").select("prompt", "token_id", "logit")
    return sampling.sample(logits, ["prompt"], 5, k=50, temperature=0.8)


@query
def redistributed_step(spark, sf_dir):
    probs = distributions.softmax(b.token_logits(spark, sf_dir), ["prompt", "layer"], temperature=0.05)
    side = probs.groupBy("prompt", "token_id").agg(*[F.max(F.when(F.col("layer") == s, F.col("prob"))).alias(s) for s in ("base", "sft", "dpo")]).where("base IS NOT NULL AND sft IS NOT NULL AND dpo IS NOT NULL")
    return rounded(sampling.redistributed_step(side, b.token_vectors(spark, sf_dir)).select("prompt", "token_id", "prob"))


@query
def known_prompts(spark, sf_dir):
    """Prompts that have been analysed (distinct cache keys), with their stages."""
    counts = b.long_counts(b.stage_counts(b.tokens(spark, sf_dir), "prompt"), "prompt")
    return counts.groupBy("prompt").agg(F.countDistinct("layer").alias("n_layers"), F.countDistinct("word").alias("n_words"))


@query
def generation_deficit(spark, sf_dir):
    """How many passages each (family, label, model) lacks of thirty; the first thirty of the log count."""
    gens = b.generations(spark, sf_dir)
    kept = distributions.top_k(gens, ["family", "label", "model"], ["gen_id"], 30)
    have = kept.groupBy("family", "label", "model").agg(F.count(F.lit(1)).alias("n"))
    grid = gens.select("family").distinct().crossJoin(F.broadcast(gens.select("label").distinct())).crossJoin(F.broadcast(gens.select("model").distinct()))
    return grid.join(have, ["family", "label", "model"], "left").select("family", "label", "model", F.greatest(F.lit(0), F.lit(30) - F.coalesce("n", F.lit(0))).cast("long").alias("deficit"))


def profile(gens: DataFrame, counted: DataFrame) -> DataFrame:
    """The profile of each label's passages in one row, from the passages and their vectors with counts."""
    keys = ["label"]
    parts = [
        rounded(generations.first_word_entropy(gens, ["label", "model"])).groupBy(*keys).agg(*[F.max(F.when(F.col("model") == m, F.col(x))).alias(f"{y}_{m}") for m in ("base", "sft") for x, y in (("entropy", "entropy"), ("unique_first_words", "words"))]),
        rounded(generations.centroid_distance(counted, keys)).groupBy(*keys).agg(F.max(F.when(F.col("model") == "sft", F.col("distance"))).alias("distance_sft")),
        rounded(generations.spread(counted, ["label", "model"])).groupBy(*keys).agg(*[F.max(F.when(F.col("model") == m, F.col("variance"))).alias(f"variance_{m}") for m in ("base", "sft")]),
        rounded(generations.mean_cosine(counted, ["label", "model"])).groupBy(*keys).agg(*[F.max(F.when(F.col("model") == m, F.col("mean_cosine"))).alias(f"cosine_{m}") for m in ("base", "sft")]),
        rounded(generations.silhouette(counted, keys)),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, keys, "left")
    return out


from . import catalog_learnt, catalog_sql, catalog_stats, catalog_tables  # noqa: E402, F401  (they register their queries)
