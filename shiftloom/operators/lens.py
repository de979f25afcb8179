"""Words through the layers of a network."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .distributions import softmax

KEYS = ["model", "prompt", "net_layer"]


def lens_rows(logits: DataFrame, tracked: list[int], k: int) -> DataFrame:
    """The ``k`` likeliest tokens of each layer (texts of one character drop out after that), and the tracked tokens
    whose text isn't among them. Rows are known by token id: several ids can have one text."""
    probs = softmax(logits, KEYS, out="probability")
    best = probs.withColumn("_n", F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("probability"), "token_id"))).where(F.col("_n") <= k).where(F.length("token") >= 2)
    best = best.select(*KEYS, "token_id", F.col("token").alias("word"), "probability", "logit", F.lit("top_k").alias("source"))
    always = probs.where(F.col("token_id").isin(tracked)).select(*KEYS, "token_id", F.col("token").alias("word"), "probability", "logit", F.lit("tracked").alias("source"))
    return best.unionByName(always.join(best.select(*KEYS, "word"), [*KEYS, "word"], "left_anti"))


def frequent_words(rows: DataFrame, layers: int) -> DataFrame:
    top = rows.where("source = 'top_k'").groupBy("model", "prompt", "word").agg(F.countDistinct("net_layer").alias("n_layers"))
    return top.where(F.col("n_layers") >= layers)


def peaks(rows: DataFrame) -> DataFrame:
    first = F.row_number().over(Window.partitionBy("model", "prompt", "word").orderBy(F.desc("probability"), "net_layer", "token_id"))
    return rows.withColumn("_n", first).where("_n = 1").drop("_n")
