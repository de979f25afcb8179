"""Shift tables between stages, trajectories, drive scores and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import drive_weight, signed_ratio, trajectory


def shift_table(wide: DataFrame, a: str, b: str, threshold: float = 0.01, with_base: bool = True) -> DataFrame:
    """The shift from stage ``a`` to ``b`` for every word of either (and of base, unless it is left out)."""
    present = (F.col(a) > 0) | (F.col(b) > 0)
    rows = wide.where(present | (F.col("base") > 0) if with_base else present)
    delta = F.col(a) - F.col(b)
    return rows.select(
        "prompt",
        F.lit(f"{a}_{b}").alias("axis"),
        "word",
        F.col("base"),
        F.col(a).alias("p_from"),
        F.col(b).alias("p_to"),
        delta.alias("delta"),
        signed_ratio(F.col(a), F.col(b)).alias("ratio"),
        (delta > threshold).alias("down"),
        (delta < -threshold).alias("up"),
    )


def formation(wide: DataFrame, places: int = 6, threshold: float = 0.005) -> DataFrame:
    """Rounded probabilities and differences of all stages, with each word's trajectory (over rounded values)."""
    r = lambda c: F.round(c, places)
    out = wide.select(
        "prompt", "word", r(F.col("base")).alias("base"), r(F.col("sft")).alias("sft"), r(F.col("sft") - F.col("base")).alias("sft_minus_base"), r(F.col("dpo")).alias("dpo"), r(F.col("dpo") - F.col("sft")).alias("dpo_minus_sft"),
        r(F.col("dpo") - F.col("base")).alias("dpo_minus_base"), r(F.col("rlvr")).alias("rlvr"), r(F.col("rlvr") - F.col("dpo")).alias("rlvr_minus_dpo"),
    )
    return out.withColumn("trajectory", trajectory(F.col("base"), F.col("sft"), F.col("dpo"), threshold))


def significant(df: DataFrame, columns: list[str], least: float) -> DataFrame:
    return df.where(F.greatest(*[F.col(c) for c in columns]) > least)


def moving(df: DataFrame, columns: list[str], least: float) -> DataFrame:
    """Rows whose neighbouring stages differ by more than ``least`` somewhere."""
    return df.where(F.greatest(*[F.abs(F.col(a) - F.col(b)) for a, b in zip(columns, columns[1:], strict=False)]) > least)


def drive_scores(wide: DataFrame) -> DataFrame:
    """Score of each word that loses mass from sft to dpo, weighted by its drive over the mean of the whole vocabulary."""
    every = Window.partitionBy("prompt")
    rows = wide.where("base > 0 OR sft > 0 OR dpo > 0").withColumn("mean_base", F.avg("base").over(every))
    weight = drive_weight(F.col("base"), F.col("mean_base"))
    rows = rows.withColumn("repression", F.col("sft") - F.col("dpo")).where("repression > 0").withColumn("drive_weight", weight)
    return rows.select("prompt", "word", (F.col("repression") * F.col("drive_weight")).alias("id_score"), F.col("base").alias("base_drive"), F.col("sft").alias("ego_desire"), F.col("dpo").alias("superego_allows"), "repression", "drive_weight")


def first_words_in_order(order, value: str = "word", k: int = 3):
    """The ``k`` first values of a group by an ascending key, comma-separated (an aggregate)."""
    pairs = F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col(value).alias("v"))))
    return F.concat_ws(",", F.transform(F.slice(pairs, 1, k), lambda x: x["v"]))


def battery_summary(shifts: DataFrame, keys: list[str], k: int = 3) -> DataFrame:
    """Mass and counts of either direction and the first words of each. Only the ``k`` largest of a group are gathered."""
    down = shifts.withColumn("side", F.when(F.col("down"), "down").when(F.col("up"), "up"))
    size = F.abs("delta")
    ranked = down.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "side").orderBy(F.desc(size), "word")))
    mass = lambda side: F.coalesce(F.sum(F.when(F.col("side") == side, size)), F.lit(0.0))
    count = lambda side: F.count(F.when(F.col("side") == side, 1))
    words = lambda side: F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.when((F.col("side") == side) & (F.col("rank") <= k), F.struct("rank", "word")))), lambda x: x["word"]))
    return ranked.groupBy(*keys).agg(
        mass("down").alias("mass_down"), mass("up").alias("mass_up"), count("down").alias("n_down"), count("up").alias("n_up"), words("down").alias("top_down"), words("up").alias("top_up")
    )


def movers(pairs: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """The ``k`` largest changes of either direction from (pa, pb), blank tokens dropped after ranking."""
    delta = pairs.withColumn("delta", F.col("pa") - F.col("pb"))
    out = None
    for direction, order in (("down", F.desc("delta")), ("up", F.asc("delta"))):
        best = delta.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(order, "token_id"))).where(F.col("rank") <= k).where("token <> ''").withColumn("direction", F.lit(direction))
        out = best if out is None else out.unionByName(best)
    return out
