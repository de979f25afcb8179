"""Distributions: normalising, ranking, merging stages, and measures between them. Long tables throughout: a row
per (keys, word or token); a measure is one window or one aggregation over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import floored
from ..schemas import LAYERS, PAIRS


def top_k(df: DataFrame, keys: list[str], order: list, k: int, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of each group in a total order; Spark limits groups before the shuffle."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= k)
    return ranked.withColumnRenamed("_rank", rank) if rank else ranked.drop("_rank")


def normalised(df: DataFrame, keys: list[str], mass: str, out: str) -> DataFrame:
    """``out`` = mass as a share of its group's; groups without mass stay as they are."""
    total = F.sum(mass).over(Window.partitionBy(*keys))
    return df.withColumn(out, F.when(total > 0, F.col(mass) / total).otherwise(F.col(mass)))


def word_distribution(counts: DataFrame, keys: list[str], k: int = 200) -> DataFrame:
    """(keys, layer, word, prob) from occurrences (keys, layer, word, n): the ``k`` most frequent, normalised."""
    by = [*keys, "layer"]
    best = top_k(counts, by, [F.desc("n"), "word"], k)
    return normalised(best.withColumn("n", F.col("n").cast("double")), by, "n", "prob").drop("n")


def merged_stages(dist: DataFrame, keys: list[str], item: str = "word", value: str = "prob", layers: tuple[str, ...] = LAYERS) -> DataFrame:
    """Full outer merge of the stages, missing as 0: one aggregation for any number of stages."""
    return dist.groupBy(*keys, item).agg(*[F.coalesce(F.max(F.when(F.col("layer") == s, F.col(value))), F.lit(0.0)).alias(s) for s in layers])


def softmax(df: DataFrame, keys: list[str], logit: str = "logit", out: str = "prob", temperature: float = 1.0) -> DataFrame:
    w = Window.partitionBy(*keys)
    scaled = F.col(logit) / F.lit(float(temperature)) if temperature != 1.0 else F.col(logit)
    df = df.withColumn("_e", F.exp(scaled - F.max(scaled).over(w)))
    return df.withColumn(out, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def entropy(df: DataFrame, keys: list[str], prob: str = "prob") -> DataFrame:
    p = floored(F.col(prob))
    return df.groupBy(*keys).agg((-F.sum(p * F.ln(p))).alias("entropy"))


def pair_table(probs: DataFrame, keys: list[str], item: str, pairs=PAIRS) -> DataFrame:
    """(keys, pair, item, pa, pb): the stages side by side, then a row per pair; pairs with a missing stage drop out."""
    wide = probs.groupBy(*keys, item).agg(*[F.max(F.when(F.col("layer") == s, F.col("prob"))).alias(s) for s in LAYERS])
    each = F.explode(F.array(*[F.struct(F.lit(f"{a}_{b}").alias("pair"), F.col(a).alias("pa"), F.col(b).alias("pb")) for a, b in pairs]))
    return wide.select(*keys, item, each.alias("x")).select(*keys, item, "x.*").where("pa IS NOT NULL AND pb IS NOT NULL")


def _kl(p: Column, q: Column) -> Column:
    return F.sum(p * (F.ln(p) - F.ln(q)))


def kl(pairs: DataFrame, keys: list[str]) -> DataFrame:
    return pairs.groupBy(*keys).agg(_kl(floored(F.col("pa")), floored(F.col("pb"))).alias("kl"))


def js_terms() -> Column:
    p, q = floored(F.col("pa")), floored(F.col("pb"))
    m = (p + q) * F.lit(0.5)
    return F.sum(F.lit(0.5) * (p * (F.ln(p) - F.ln(m)) + q * (F.ln(q) - F.ln(m))))


def js(pairs: DataFrame, keys: list[str]) -> DataFrame:
    return pairs.groupBy(*keys).agg(js_terms().alias("js"))


def ranks(pairs: DataFrame, keys: list[str], item: str) -> DataFrame:
    """``pairs`` with the rank of either side: ``ra``, ``rb`` for the top (ties by item), ``aa``, ``ab`` averaged over ties."""
    for p, r, a in (("pa", "ra", "aa"), ("pb", "rb", "ab")):
        pairs = pairs.withColumn(r, F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(p), item)))
        same = F.count(F.lit(1)).over(Window.partitionBy(*keys, p))
        pairs = pairs.withColumn(a, F.rank().over(Window.partitionBy(*keys).orderBy(p)) + (same - 1) / F.lit(2.0))
    return pairs


def metrics(pairs: DataFrame, keys: list[str], item: str, k: int) -> DataFrame:
    """kl, js, overlap of the top ``k``, rank correlation, and entropies of both sides, in one aggregation."""
    p, q = floored(F.col("pa")), floored(F.col("pb"))
    return ranks(pairs, keys, item).groupBy(*keys).agg(
        (-F.sum(p * F.ln(p))).alias("entropy_a"),
        (-F.sum(q * F.ln(q))).alias("entropy_b"),
        _kl(p, q).alias("kl"),
        js_terms().alias("js"),
        (F.count(F.when((F.col("ra") <= k) & (F.col("rb") <= k), 1)) / F.lit(float(k))).alias("overlap"),
        F.corr("aa", "ab").alias("rank_corr"),
    )


def restricted(logits: DataFrame, vocabulary: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Every stage's logits on a common vocabulary (keys, item), as probabilities within it."""
    on = [*keys, item]
    return softmax(logits.join(vocabulary.select(*on).distinct(), on, "left_semi"), [*keys, "layer"])


def perplexity(logp: DataFrame, keys: list[str]) -> DataFrame:
    """exp of the mean negative log probability; NaN for sequences of fewer than two tokens (one log probability each
    but the first, which is null)."""
    n = F.count("logp")
    return logp.groupBy(*keys).agg(F.when(n < 1, F.lit(float("nan"))).otherwise(F.exp(-F.avg("logp"))).alias("perplexity"))


def candidate_probabilities(scores: DataFrame, keys: list[str], logp: str = "logp") -> DataFrame:
    """Softmax of summed log probabilities over each group's candidates."""
    return softmax(scores, keys, logp, "prob")
