"""Profiles of generated passages: first words, geometry of their vectors, concept axes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import dot
from ..functions.text import first_token, first_word, is_real_word
from .blocks import distance_sums


def first_words(gens: DataFrame, keys: list[str]) -> DataFrame:
    return gens.withColumn("word", first_word(F.col("psg"))).groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"))


def prompt_words(gens: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Each group's ``k`` most frequent real first words."""
    counts = first_words(gens, keys).where(is_real_word(F.col("word")))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "word"))).where(F.col("rank") <= k)


def first_word_entropy(gens: DataFrame, keys: list[str]) -> DataFrame:
    counts = gens.withColumn("word", first_token(F.col("psg"))).groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(*keys))
    return counts.withColumn("p", p).groupBy(*keys).agg((-F.sum(F.col("p") * F.ln(F.col("p") + F.lit(1e-10)))).alias("entropy"), F.count(F.lit(1)).alias("unique_first_words"))


def counted_vectors(gens: DataFrame, vectors: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, vec_row, n, vec): passages with the same vector are one row with a count."""
    return gens.groupBy(*keys, "vec_row").agg(F.count(F.lit(1)).alias("n")).join(vectors, "vec_row")


def centroids(counted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, dim, c)."""
    each = counted.select(*keys, "n", F.posexplode("vec").alias("dim", "x"))
    return each.groupBy(*keys, "dim").agg((F.sum(F.col("n") * F.col("x").cast("double")) / F.sum("n")).alias("c"))


def centroid_distance(counted: DataFrame, keys: list[str]) -> DataFrame:
    """Distance of the centroid of base to that of every other model."""
    c = centroids(counted, [*keys, "model"])
    base = c.where("model = 'base'").select(*keys, "dim", F.col("c").alias("b"))
    return c.where("model <> 'base'").join(base, [*keys, "dim"]).groupBy(*keys, "model").agg(F.sqrt(F.sum((F.col("c") - F.col("b")) * (F.col("c") - F.col("b")))).alias("distance"))


def spread(counted: DataFrame, keys: list[str]) -> DataFrame:
    """Variance (of the population) of the distances to the group's centroid, for groups with more than one passage."""
    centre = centroids(counted, keys).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "c"))), lambda s: s["c"]).alias("c"))
    square = lambda x, c: F.coalesce((x.cast("double") - c) * (x.cast("double") - c), F.lit(0.0))
    far = F.sqrt(F.aggregate(F.zip_with("vec", "c", square), F.lit(0.0), lambda s, x: s + x))
    d = counted.where(F.size("vec") > 0).join(centre, keys).select(*keys, "vec_row", "n", far.alias("d"))
    n, s, q = F.sum("n"), F.sum(F.col("n") * F.col("d")), F.sum(F.col("n") * F.col("d") * F.col("d"))
    return d.groupBy(*keys).agg(n.alias("n"), (q / n - (s / n) * (s / n)).alias("variance")).where("n > 1")


def mean_cosine(counted: DataFrame, keys: list[str]) -> DataFrame:
    """Mean cosine of all pairs of a group, from the sum of its unit vectors: (|S|^2 - sum |u|^2) / (n (n - 1))."""
    norm = F.sqrt(dot(F.col("vec"), F.col("vec"))) + F.lit(1e-10)
    unit = counted.withColumn("norm", norm).select(*keys, "vec_row", "n", "norm", F.posexplode("vec").alias("dim", "x"))
    u = F.col("x").cast("double") / F.col("norm")
    dims = unit.groupBy(*keys, "dim").agg(F.sum(F.col("n") * u).alias("s"), F.sum(F.col("n") * u * u).alias("q"), F.sum("n").alias("n"))
    return dims.groupBy(*keys).agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("s2"), F.sum("q").alias("q2")).where("n > 1").select(*keys, ((F.col("s2") - F.col("q2")) / (F.col("n") * (F.col("n") - 1))).alias("mean_cosine"))


def silhouette(counted: DataFrame, keys: list[str]) -> DataFrame:
    """Mean silhouette of the models' passages (Euclidean), over models with two passages or more and groups with two
    such models. Distances are between distinct vectors, weighted by their counts, and worked out by pairs of blocks."""
    size = F.sum("n").over(Window.partitionBy(*keys, "model"))
    rows = counted.withColumn("size", size).where("size > 1")
    means = distance_sums(rows, keys)
    own = F.max(F.when(F.col("o") == F.col("m"), F.col("t") / (F.col("so") - 1)))
    other = F.min(F.when(F.col("o") != F.col("m"), F.col("t") / F.col("so")))
    s = means.groupBy(*keys, "m", "i", "ni").agg(own.alias("a"), other.alias("b")).where("b IS NOT NULL")
    value = F.when(F.greatest("a", "b") > 0, (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(F.lit(0.0))
    return s.groupBy(*keys).agg((F.sum(F.col("ni") * value) / F.sum("ni")).alias("silhouette"))


def concept_axis(seeds: DataFrame) -> DataFrame:
    """(axis, dim, w, mid): unit direction from the negative to the positive seeds' centroid, and the middle."""
    each = seeds.select("axis", "polarity", F.posexplode("vec").alias("dim", "x"))
    c = each.groupBy("axis", "dim").agg(F.avg(F.when(F.col("polarity") == "positive", F.col("x").cast("double"))).alias("p"), F.avg(F.when(F.col("polarity") == "negative", F.col("x").cast("double"))).alias("q"))
    d = F.col("p") - F.col("q")
    norm = F.sqrt(F.sum(d * d).over(Window.partitionBy("axis")))
    return c.select("axis", "dim", (d / norm).alias("w"), ((F.col("p") + F.col("q")) * F.lit(0.5)).alias("mid"))


def concept_scores(counted: DataFrame, axis: DataFrame, keys: list[str]) -> DataFrame:
    """Mean score of each group's passages along each axis (an axis has a row per dimension)."""
    each = counted.select(*keys, "n", F.posexplode("vec").alias("dim", "x")).join(axis, "dim")
    dims = each.groupBy(*keys, "axis", "dim", "w", "mid").agg((F.sum(F.col("n") * F.col("x").cast("double")) / F.sum("n")).alias("c"))
    return dims.groupBy(*keys, "axis").agg(F.sum((F.col("c") - F.col("mid")) * F.col("w")).alias("mean_score"))


def to_last(df: DataFrame, keys: list[str], value: str):
    """``base`` and ``last``: a group's value at base and at its last stage of rlvr, dpo, sft that is there."""
    at = lambda s: F.max(F.when(F.col("model") == s, F.col(value)))
    return df.groupBy(*keys).agg(at("base").alias("base"), F.coalesce(at("rlvr"), at("dpo"), at("sft")).alias("last"))
