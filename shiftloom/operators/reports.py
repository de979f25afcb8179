"""Reports as lines of text, and tables behind plots: filters, orders and cuts over the result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import change_colour
from .distributions import top_k


def places(x: str | Column, n: int = 4) -> Column:
    """A number with ``n`` decimals, as text. A little is added, so that no engine sees a tie."""
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x + F.lit(1e-9), n).cast(f"decimal(20,{n})").cast("string")


def present(a: str, b: str, least: float) -> Column:
    """Whether a word is there, on either side of a shift."""
    return (F.abs(F.col(a)) > least) | (F.abs(F.col(b)) > least)


def shift_sections(shift: DataFrame, down: str, up: str, least: float, n: int) -> DataFrame:
    """(prompt, section, rank, line): the ``n`` largest falls and rises of a shift among the words that are there."""
    rows = shift.where(present("p_from", "p_to", least)).withColumn("section", F.when(F.col("delta") > least, F.lit(down)).when(F.col("delta") < -least, F.lit(up))).where("section IS NOT NULL")
    best = top_k(rows.withColumn("size", F.round(F.abs("delta"), 9)), ["prompt", "section"], [F.desc("size"), "word"], n, "rank")
    return best.select("prompt", "section", "rank", F.concat("word", F.lit(": "), places("p_from"), F.lit(" -> "), places("p_to")).alias("line"))


def ratio_sections(shift: DataFrame, n: int) -> DataFrame:
    """The largest falls and rises beyond the threshold, with how many times less or more."""
    side = F.when(F.col("down"), F.lit("repressed")).when(F.col("up"), F.lit("amplified"))
    best = top_k(shift.withColumn("section", side).where("section IS NOT NULL").withColumn("size", F.round(F.abs("delta"), 9)), ["prompt", "section"], [F.desc("size"), "word"], n, "rank")
    return best.select("prompt", "section", "rank", F.concat("word", F.lit(": "), places("p_from"), F.lit(" -> "), places("p_to"), F.lit(" ("), places(F.abs("ratio"), 1), F.lit("x)")).alias("line"))


def metric_lines(metrics: DataFrame) -> DataFrame:
    """(prompt, pair, line) of kl, js, overlap and rank correlation."""
    named = [x for c in ("kl", "js", "overlap", "rank_corr") for x in (F.lit(f"{c}="), places(c), F.lit(" "))][:-1]
    return metrics.select("prompt", "pair", F.concat(*named).alias("line"))


def pair_lines(pairs: DataFrame, n: int) -> DataFrame:
    """(prompt, axis, rank, line): pairs from the most alike on, the first ``n`` of each axis."""
    best = top_k(pairs.withColumn("similarity", F.round("sim", 6)), ["prompt", "axis"], [F.desc("similarity"), "source", "target", "net_layer"], n, "rank")
    return best.select("prompt", "axis", "rank", F.concat("source", F.lit(" -> "), "target", F.lit(" sim="), places("similarity"), F.lit(" layer="), F.col("net_layer").cast("string")).alias("line"))


def trajectory_rows(formation: DataFrame, layers: list[str], least: float, moved: float | None, by: str, n: int = 120) -> DataFrame:
    """Words above ``least`` somewhere, or that move by more than ``moved`` between neighbours: the ``n`` first of a prompt by
    ``mass`` over the layers or by ``delta``, the largest move."""
    largest = F.greatest(*[F.abs(F.col(a) - F.col(b)) for a, b in zip(layers, layers[1:], strict=False)])
    rows = formation.withColumn("mass", F.round(sum((F.col(c) for c in layers[1:]), F.col(layers[0])), 6)).withColumn("delta", F.round(largest, 6))
    keep = F.greatest(*[F.col(c) for c in layers]) > least
    rows = rows.where(keep | (F.col("delta") > moved) if moved is not None else keep)
    return top_k(rows, ["prompt"], [F.desc(by), "word"], n, "rank").select("prompt", "rank", "word", *layers, "trajectory", "mass", "delta")


def link_rows(links: DataFrame, formation: DataFrame, a: str, b: str) -> DataFrame:
    """Links (prompt, source, target, similarity) with the source's value at ``a``, the target's at ``b`` and the colour of the
    change. A link with a word that the formation doesn't know drops out."""
    of = lambda word, stage: formation.select("prompt", F.col("word").alias(word), F.col(stage).alias(f"{word}_{stage}"))
    both = links.join(of("source", a), ["prompt", "source"]).join(of("target", b), ["prompt", "target"])
    return both.select("prompt", "source", "target", "similarity", f"source_{a}", f"target_{b}", change_colour(F.col(f"source_{a}"), F.col(f"target_{b}")).alias("colour"))


def ranked_nulls_last(rows: DataFrame, keys: list[str], value: str, item: str, n: int) -> DataFrame:
    return top_k(rows, keys, [F.desc_nulls_last(value), item], n, "rank")


def legend_order(rows: DataFrame, keys: list[str], item: str, value: str) -> DataFrame:
    """(keys, rank, item, mean): items from the greatest mean on."""
    means = rows.groupBy(*keys, item).agg(F.round(F.avg(value), 9).alias("mean"))
    return means.select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("mean"), item)).alias("rank"), item, "mean")


def absorption_ranks(absorbed: DataFrame) -> DataFrame:
    """Targets with their places by absorbed mass and by number of sources."""
    mass = F.row_number().over(Window.partitionBy("prompt").orderBy(F.desc("mass"), "target"))
    many = F.row_number().over(Window.partitionBy("prompt").orderBy(F.desc("n_sources"), F.desc("mass"), "target"))
    rows = absorbed.withColumn("mass", F.round("total_absorbed", 9))
    return rows.select("prompt", "target", "n_sources", "mass", mass.alias("by_mass"), many.alias("by_sources"))
