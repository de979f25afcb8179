"""Reallocation of suppressed mass to permitted words by similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import dot, drive_weight, role
from ..functions.text import shares_stem


def suppressed(wide: DataFrame, least: float) -> DataFrame:
    """Words whose mass falls by more than ``least`` from sft to dpo, with drive weight (over the mean of positive base
    probabilities) and effective mass."""
    mean = F.coalesce(F.avg(F.when(F.col("base") > 0, F.col("base"))).over(Window.partitionBy("prompt")), F.lit(1e-10))
    rows = wide.where("base > 0 OR sft > 0 OR dpo > 0").withColumn("mean_base", mean).withColumn("raw_mass", F.col("sft") - F.col("dpo")).where(F.col("raw_mass") > least)
    rows = rows.withColumn("drive_weight", drive_weight(F.col("base"), F.col("mean_base")))
    return rows.select("prompt", "word", "raw_mass", F.col("base").alias("base_drive"), "drive_weight", (F.col("raw_mass") * F.col("drive_weight")).alias("effective_mass"), "sft", "dpo")


def permitted(wide: DataFrame, gone: DataFrame, least: float) -> DataFrame:
    return wide.where(F.col("dpo") > least).join(gone.select("prompt", "word"), ["prompt", "word"], "left_anti").select("prompt", "word", "dpo", "base")


def edges(gone: DataFrame, allowed: DataFrame, vectors: DataFrame, mass: Column, weight: Column | None, similar: float, least_share: float, stems: bool) -> DataFrame:
    """(prompt, source, target, mass, raw_repression, drive_weight, base_drive, similarity): each source's mass dealt out
    to similar targets by ``weight`` (similarity, unless given); small shares are dropped, not dealt again."""
    s = gone.join(vectors, ["prompt", "word"]).select("prompt", F.col("word").alias("source"), "raw_mass", "drive_weight", "base_drive", "effective_mass", F.col("vec").alias("sv"))
    t = allowed.join(vectors, ["prompt", "word"]).select("prompt", F.col("word").alias("target"), F.col("base").alias("target_base"), F.col("vec").alias("tv"))
    pairs = s.join(t, "prompt")
    if stems:
        pairs = pairs.where(~shares_stem(F.col("source"), F.col("target")))
    pairs = pairs.withColumn("similarity", dot(F.col("sv"), F.col("tv"))).where(F.col("similarity") >= similar).withColumn("weight", F.col("similarity") if weight is None else weight)
    share = mass * (F.col("weight") / F.sum("weight").over(Window.partitionBy("prompt", "source")))
    return pairs.withColumn("mass", share).where(F.col("mass") >= least_share).select("prompt", "source", "target", "mass", F.col("raw_mass").alias("raw_repression"), "drive_weight", "base_drive", "similarity")


def redistributed(wide: DataFrame, gone: DataFrame, allowed: DataFrame, links: DataFrame) -> DataFrame:
    """(prompt, word, prob): dpo mass plus what came in, normalised. A prompt with nothing suppressed or nothing
    permitted keeps its dpo mass as it is."""
    gain = links.groupBy("prompt", F.col("target").alias("word")).agg(F.sum("mass").alias("gain"))
    mass = wide.where("dpo > 0").select("prompt", "word", "dpo").join(gain, ["prompt", "word"], "left").withColumn("m", F.col("dpo") + F.coalesce("gain", F.lit(0.0)))
    both = gone.select("prompt").distinct().join(allowed.select("prompt").distinct(), "prompt").withColumn("works", F.lit(True))
    total = F.sum("m").over(Window.partitionBy("prompt"))
    return mass.join(both, "prompt", "left").select("prompt", "word", F.when(F.col("works") & (total > 0), F.col("m") / total).otherwise(F.col("dpo")).alias("prob"))


def absorption(links: DataFrame) -> DataFrame:
    return links.groupBy("prompt", "target").agg(
        F.count(F.lit(1)).alias("n_sources"), F.sum("mass").alias("total_absorbed"), F.concat_ws(",", F.sort_array(F.collect_list("source"))).alias("sources")
    )


def mean_distance(wide: DataFrame, links: DataFrame) -> DataFrame:
    """Mean of 1 - similarity over a prompt's transfers, 0 where there are none."""
    d = links.groupBy("prompt").agg(F.avg(F.lit(1.0) - F.col("similarity")).alias("d"))
    return wide.select("prompt").distinct().join(d, "prompt", "left").select("prompt", F.coalesce("d", F.lit(0.0)).alias("mean_distance"))


def analysis(wide: DataFrame, moved: DataFrame, gone: DataFrame, links: DataFrame, shift: float = 0.01, gain: float = 0.003) -> DataFrame:
    """One row per word with all of the above and its role (judged on unrounded values)."""
    taken = absorption(links).withColumnRenamed("target", "word")
    rows = wide.where("base > 0 OR sft > 0 OR dpo > 0").join(moved, ["prompt", "word"], "left").join(gone.select("prompt", "word", "drive_weight", "effective_mass"), ["prompt", "word"], "left").join(taken, ["prompt", "word"], "left")
    neurotic = F.coalesce("prob", F.lit(0.0))
    raw, displaced = F.col("sft") - F.col("dpo"), neurotic - F.col("dpo")
    return rows.select(
        "prompt",
        "word",
        F.col("base").alias("base_drive"),
        F.col("sft").alias("ego"),
        F.col("dpo").alias("superego"),
        neurotic.alias("neurotic"),
        raw.alias("raw_repression"),
        F.when(F.col("drive_weight") != 0, F.col("drive_weight")).alias("drive_weight"),
        F.when(F.col("effective_mass") != 0, F.col("effective_mass")).alias("effective_mass"),
        displaced.alias("displaced_mass"),
        F.coalesce("n_sources", F.lit(0)).cast("long").alias("n_condensation_sources"),
        F.coalesce("total_absorbed", F.lit(0.0)).alias("total_absorbed"),
        F.col("sources").alias("condensation_sources"),
        role(raw, displaced, shift, gain).alias("role"),
    )
