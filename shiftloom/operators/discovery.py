"""Finding and scoring whole words from a model of pieces: greedy extension as bounded self-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import DISCOVERED_STRIP, is_alpha, strip_chars
from .distributions import normalised, softmax, top_k

BOUNDARY = "$"


def transitions(pieces: DataFrame) -> DataFrame:
    """(prompt, cur, nxt, lp) from occurrences (prompt, cur, nxt, n)."""
    return pieces.withColumn("lp", F.ln(F.col("n") / F.sum("n").over(Window.partitionBy("prompt", "cur"))))


def discover(first: DataFrame, moves: DataFrame, k: int = 200, extensions: int = 4) -> DataFrame:
    """Each of the ``k`` likeliest first pieces is extended by the likeliest next piece until a boundary comes (whose
    log probability counts) or there are ``extensions``; words are cleaned, their mass summed and normalised.
    ``first``: prompt, piece, n; ``moves``: prompt, cur, nxt, n, lp."""
    lp = F.ln(F.col("n") / F.sum("n").over(Window.partitionBy("prompt")))
    start = top_k(first.withColumn("lp", lp), ["prompt"], [F.desc("n"), "piece"], k)
    best = top_k(moves, ["prompt", "cur"], [F.desc("n"), "nxt"], 1).select("prompt", "cur", "nxt", F.col("lp").alias("step"))
    state = start.select("prompt", F.col("piece").alias("cur"), F.col("piece").alias("text"), "lp", F.lit(False).alias("done"))
    for _ in range(extensions):
        # What is done, or leads nowhere, stays as it is.
        state = state.join(best, ["prompt", "cur"], "left").withColumn("go", ~F.col("done") & F.col("nxt").isNotNull())
        ends = F.col("go") & (F.col("nxt") == BOUNDARY)
        state = state.select(
            "prompt",
            F.when(F.col("go") & ~ends, F.col("nxt")).otherwise(F.col("cur")).alias("cur"),
            F.when(F.col("go") & ~ends, F.concat("text", "nxt")).otherwise(F.col("text")).alias("text"),
            F.when(F.col("go"), F.col("lp") + F.col("step")).otherwise(F.col("lp")).alias("lp"),
            (F.col("done") | ends | F.col("nxt").isNull()).alias("done"),
        )
    words = state.withColumn("word", strip_chars(F.trim("text"), DISCOVERED_STRIP)).where(is_alpha(F.col("word")))
    return normalised(words.groupBy("prompt", "word").agg(F.sum(F.exp("lp")).alias("mass")), ["prompt"], "mass", "prob").drop("mass")


def word_logprobs(candidates: DataFrame, first: DataFrame, moves: DataFrame, size: int) -> DataFrame:
    """(prompt, word, prob): summed log probabilities of each candidate's pieces and its boundary, softmaxed within the
    prompt. No candidates: no rows."""
    lp = F.ln(F.col("n") / F.sum("n").over(Window.partitionBy("prompt")))
    firsts = first.withColumn("lp", lp).select("prompt", F.col("piece").alias("cur"), F.col("lp").alias("flp"))
    at = F.sequence(F.lit(0), F.floor((F.length("word") - 1) / size).cast("int"))
    cut = candidates.withColumn("pieces", F.transform(at, lambda i: F.substring(F.col("word"), i * size + 1, F.lit(size))))
    cut = cut.withColumn("pairs", F.transform(F.sequence(F.lit(1), F.size("pieces")), lambda i: F.struct(F.col("pieces")[i - 1].alias("cur"), F.when(i < F.size("pieces"), F.get("pieces", i)).otherwise(BOUNDARY).alias("nxt"))))
    steps = cut.select("prompt", "word", F.explode("pairs").alias("x")).select("prompt", "word", "x.cur", "x.nxt")
    rest = steps.join(moves.select("prompt", "cur", "nxt", "lp"), ["prompt", "cur", "nxt"]).groupBy("prompt", "word").agg(F.sum("lp").alias("rlp"))
    head = cut.select("prompt", "word", F.col("pieces")[0].alias("cur")).join(firsts, ["prompt", "cur"])
    return softmax(head.join(rest, ["prompt", "word"]).withColumn("logp", F.round(F.col("flp") + F.col("rlp"), 12)), ["prompt"], "logp", "prob")


def first_piece_scores(candidates: DataFrame, first: DataFrame) -> DataFrame:
    """(prompt, word, prob): each candidate (prompt, word, piece) scored by its first piece alone, so words that begin with
    the same piece score the same. One without a piece, or with one that no word of the prompt begins with, drops out."""
    total = F.sum("n").over(Window.partitionBy("prompt"))
    known = first.select("prompt", "piece", (F.col("n") / total).alias("p"))
    scored = candidates.join(known, ["prompt", "piece"])
    return scored.select("prompt", "word", (F.col("p") / F.sum("p").over(Window.partitionBy("prompt"))).alias("prob"))
