"""Training steps against a fixed base."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .distributions import metrics


def smoothed(counts: DataFrame) -> DataFrame:
    """(step, label, token, p): add-one probabilities on the grid of all steps, labels and tokens (a registry each)."""
    grid = counts.select("step", "label").distinct().crossJoin(counts.select("token").distinct())
    full = grid.join(counts, ["step", "label", "token"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy("step", "label")
    return full.withColumn("p", (F.col("n") + F.lit(1.0)) / (F.sum("n").over(w) + F.count(F.lit(1)).over(w))).drop("n")


def against_base(probs: DataFrame) -> DataFrame:
    """(step, label, token, pa, pb): the base's probability beside each later step's."""
    base = probs.where("step = 0").select("label", "token", F.col("p").alias("pa"))
    return probs.where("step > 0").withColumnRenamed("p", "pb").join(base, ["label", "token"])


def step_metrics(probs: DataFrame, k: int) -> DataFrame:
    m = metrics(against_base(probs), ["step", "label"], "token", k)
    return m.select("step", "label", F.col("entropy_a").alias("entropy_base"), F.col("entropy_b").alias("entropy_step"), (F.col("entropy_a") - F.col("entropy_b")).alias("entropy_drop"), F.col("js").alias("js_base_step"), F.col("kl").alias("kl_base_step"), F.col("overlap").alias("top_overlap"))


def step_words(probs: DataFrame, tracked: DataFrame) -> DataFrame:
    """Tracked tokens per step; a token's category is that of the first list that has it, else ``empirical``."""
    first = tracked.withColumn("_n", F.row_number().over(Window.partitionBy("token").orderBy("ord"))).where("_n = 1").select("token", "category")
    rows = against_base(probs).join(first, "token")
    return rows.select("step", "label", "token", F.coalesce("category", F.lit("empirical")).alias("word_category"), F.col("pb").alias("probability"), F.col("pa").alias("base_probability"), (F.col("pb") - F.col("pa")).alias("delta"))


def onset_curve(words: DataFrame) -> DataFrame:
    """(label, token, step, probability), each series led by the base as step 0."""
    start = words.groupBy("label", "token").agg(F.max("base_probability").alias("probability")).select("label", "token", F.lit(0).alias("step"), "probability")
    return words.select("label", "token", "step", "probability").unionByName(start)


def lag_pair(probs: DataFrame) -> DataFrame:
    """Per label, the series of the token that falls most by the last step and of the one that rises most."""
    rows = against_base(probs)
    last = F.max("step").over(Window.partitionBy("label"))
    change = rows.withColumn("last", last).where("step = last").withColumn("d", F.round(F.col("pb") - F.col("pa"), 12))
    pick = lambda order, name: change.withColumn("_n", F.row_number().over(Window.partitionBy("label").orderBy(order, "token"))).where("_n = 1").select("label", "token", F.lit(name).alias("series"))
    chosen = pick(F.asc("d"), "falling").unionByName(pick(F.desc("d"), "rising"))
    return probs.join(chosen, ["label", "token"]).select("label", "series", "token", "step", F.col("p").alias("probability"))
