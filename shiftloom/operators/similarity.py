"""Similarity between words that lose mass and words that gain it, per prompt and network layer."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import dot
from ..sources.shared import write_shared
from .blocks import best_across, nearest, similar_pairs


def movement(wide: DataFrame, threshold: float, least: float) -> DataFrame:
    """(prompt, axis, word, side): words that fall (source) or rise (target) from one stage to the next."""
    big = wide.where(F.greatest("base", "sft", "dpo") > least)
    each = F.explode(F.array(F.struct(F.lit("sublimation").alias("axis"), (F.col("sft") - F.col("base")).alias("d")), F.struct(F.lit("repression").alias("axis"), (F.col("dpo") - F.col("sft")).alias("d"))))
    side = F.when(F.col("d") < -threshold, "source").when(F.col("d") > threshold, "target")
    return big.select("prompt", "word", each.alias("x")).select("prompt", "x.axis", "word", F.col("x.d").alias("d")).withColumn("side", side).where("side IS NOT NULL").select("prompt", "axis", "word", "side")


def similarity_join(moves: DataFrame, vectors: DataFrame) -> DataFrame:
    """(prompt, axis, net_layer, source, target, sim): every source with every target, within prompt, axis and layer."""
    vec = moves.join(vectors, ["prompt", "word"])
    left = vec.where("side = 'source'").select("prompt", "axis", "net_layer", F.col("word").alias("source"), F.col("vec").alias("sv"))
    right = vec.where("side = 'target'").select("prompt", "axis", "net_layer", F.col("word").alias("target"), F.col("vec").alias("tv"))
    return left.join(right, ["prompt", "axis", "net_layer"]).select("prompt", "axis", "net_layer", "source", "target", dot(F.col("sv"), F.col("tv")).alias("sim"))


def similar_words(moves: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """``similarity_join`` without the pairs below ``least``: by pairs of blocks, of which those that can't reach it don't meet."""
    vec = moves.join(vectors, ["prompt", "word"])
    of = lambda side: vec.where(F.col("side") == side).select("prompt", "axis", "net_layer", F.col("word").alias("item"), "vec")
    return similar_pairs(of("source"), of("target"), ["prompt", "axis", "net_layer"], least)


def best_links(sims: DataFrame, middle: int, least: float, places: int = 6) -> DataFrame:
    """At the middle layer: each source's best target and each target's best source, on rounded similarities."""
    at = sims.where(F.col("net_layer") == middle).withColumn("similarity", F.round("sim", places))
    out = None
    for kind, word, other in (("target", "source", "target"), ("source", "target", "source")):
        first = F.row_number().over(Window.partitionBy("prompt", "axis", word).orderBy(F.desc("similarity"), other))
        best = at.withColumn("_n", first).where("_n = 1").where(F.col("similarity") >= least).select("prompt", "axis", F.col(word).alias("word"), F.lit(kind).alias("link"), F.col(other).alias("other"), "similarity")
        out = best if out is None else out.unionByName(best)
    return out


def peak_layer(sims: DataFrame, least: float) -> DataFrame:
    """The network layer where a pair is most alike; weak pairs drop out after that."""
    first = F.row_number().over(Window.partitionBy("prompt", "axis", "source", "target").orderBy(F.desc("sim"), "net_layer"))
    return sims.withColumn("_n", first).where("_n = 1").where(F.col("sim") >= least).drop("_n")


def similarity_matrix(sims: DataFrame, layers: tuple[int, ...]) -> DataFrame:
    """Layers side by side; a missing vector counts as 0."""
    return sims.groupBy("prompt", "axis", "source", "target").agg(*[F.coalesce(F.max(F.when(F.col("net_layer") == h, F.col("sim"))), F.lit(0.0)).alias(f"layer_{h}") for h in layers])


def orphans(moves: DataFrame, pairs: DataFrame) -> DataFrame:
    """Sources without a pair in any layer."""
    sources = moves.where("side = 'source'").select("prompt", "axis", F.col("word").alias("source"))
    return sources.join(pairs, ["prompt", "axis", "source"], "left_anti")


def overdetermination(vectors: DataFrame, probs: DataFrame, k: int) -> DataFrame:
    """Per prompt, entropy of the base probabilities of each token's ``k`` nearest tokens, itself among them. ``vectors``
    (token_id, vec) of one vocabulary, ``probs`` (prompt, token_id, prob)."""
    near = nearest(vectors, "token_id", k)
    near = near.withColumn("_n", F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("sim"), "token_id"))).where(F.col("_n") <= k).select("anchor", "token_id")
    each = probs.join(near, "token_id")
    p = F.col("prob") / F.sum("prob").over(Window.partitionBy("prompt", "anchor"))
    return each.withColumn("p", p).groupBy("prompt", "anchor").agg((-F.sum(F.col("p") * F.ln(F.col("p") + F.lit(1e-10)))).alias("entropy"))


def shuffled_groups(items: DataFrame, permutations: int) -> DataFrame:
    """(perm, id, grp): permutation 0 has the true groups, the others as many in group 0, drawn by a hash of
    permutation and id."""
    n0 = F.count(F.when(F.col("grp") == 0, 1)).over(Window.partitionBy("perm"))
    each = items.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(permutations))))
    order = F.row_number().over(Window.partitionBy("perm").orderBy(F.md5(F.concat_ws(":", F.col("perm").cast("string"), F.col("id").cast("string"))), "id"))
    each = each.withColumn("n0", n0).withColumn("place", order)
    return each.withColumn("grp", F.when(F.col("perm") == 0, F.col("grp")).otherwise(F.when(F.col("place") <= F.col("n0"), 0).otherwise(1))).drop("n0", "place")


def p_value(values: DataFrame, value: str) -> DataFrame:
    """(observed, p): the share of permutations with a value at least that of the true groups."""
    v = F.round(F.col(value), 9)
    observed = F.max(F.when(F.col("perm") == 0, v))
    got = values.withColumn("_v", v).withColumn("_o", F.max(F.when(F.col("perm") == 0, v)).over(Window.partitionBy(F.lit(1))))
    return got.agg(observed.alias("observed"), (F.count(F.when((F.col("perm") > 0) & (F.col("_v") >= F.col("_o")), 1)) / F.count(F.when(F.col("perm") > 0, 1))).alias("p_value"))


def permutation_mean(items: DataFrame, permutations: int) -> DataFrame:
    """Mean similarity across groups, against shuffled groups. The mean of all cross products is the product of the
    sums, so no pair is made."""
    groups = shuffled_groups(items.select("id", "grp"), permutations)
    sizes = groups.groupBy("perm").agg(F.count(F.when(F.col("grp") == 0, 1)).alias("n0"), F.count(F.when(F.col("grp") == 1, 1)).alias("n1"))
    parts = groups.join(items.select("id", F.posexplode("vec").alias("dim", "x")), "id")
    sums = parts.groupBy("perm", "dim").agg(F.sum(F.when(F.col("grp") == 0, F.col("x").cast("double"))).alias("s0"), F.sum(F.when(F.col("grp") == 1, F.col("x").cast("double"))).alias("s1"))
    means = sums.groupBy("perm").agg(F.sum(F.col("s0") * F.col("s1")).alias("s")).join(sizes, "perm").select("perm", (F.col("s") / (F.col("n0") * F.col("n1"))).alias("value"))
    return p_value(means, "value")


#: How far from its expected place the last hash of group 0 is looked for at first, in standard deviations.
WIDTH = 8.0


def md5_draws(tail: str, permutations: int) -> np.ndarray:
    """(permutation, 2): MD5 of each permutation and an item, as two big-endian words."""
    end = tail.encode()
    digests = b"".join(hashlib.md5(b"%d" % p + end).digest() for p in range(1, permutations + 1))
    return np.frombuffer(digests, ">u8").astype(np.uint64).reshape(-1, 2)


def last_draws(tails: DataFrame, permutations: int, n0: int, n: int) -> np.ndarray:
    """The greatest MD5 (two words) of group 0 in each permutation, that of place ``n0`` of ``n``. Items are not sorted: one pass
    counts the hashes below a range about the expected place and gives out those in it, which are few, and are sorted
    by permutation. Where a range misses a place, all ranges are widened."""
    width = WIDTH
    while True:
        share, half = n0 / n, width * math.sqrt(max(n0 * (n - n0), 1) / n) / n + 1 / n
        low, high = (np.uint64(min(max(x, 0.0), 1.0 - 2.0**-53) * 2.0**64) for x in (share - half, share + half))
        all_below, all_above = share - half <= 0, share + half >= 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            below = np.zeros(permutations, np.int64)
            names = ["perm", "h", "below"]
            for batch in batches:
                perms, hashes = [], []
                for tail in batch.column(0).to_pylist():
                    drawn = md5_draws(tail, permutations)
                    under = np.zeros(permutations, bool) if all_below else drawn[:, 0] < low  # noqa: B023
                    below += under
                    near = np.flatnonzero(~under & (all_above | (drawn[:, 0] <= high)))  # noqa: B023
                    perms.append(near)
                    hashes += [x.astype(">u8").tobytes() for x in drawn[near]]
                at = np.concatenate(perms) if perms else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(hashes, pa.binary()), pa.nulls(len(at), pa.int64())], names=names)
            yield pa.RecordBatch.from_arrays([pa.array(range(permutations), pa.int32()), pa.nulls(permutations, pa.binary()), pa.array(below)], names=names)

        found = write_shared(tails.mapInArrow(run, "perm int, h binary, below long"), "draws")
        below = found.where("h IS NULL").groupBy("perm").agg(F.sum("below").alias("under"))
        placed = found.where("h IS NOT NULL").withColumn("_n", F.row_number().over(Window.partitionBy("perm").orderBy("h"))).join(below, "perm")
        last = {r.perm: r.h for r in placed.where(F.col("_n") == F.lit(n0) - F.col("under")).select("perm", "h").collect()}  # one a permutation
        if len(last) == permutations:
            return np.array([np.frombuffer(last[p], ">u8").astype(np.uint64) for p in range(permutations)])
        width *= 8


def permutation_best(items: DataFrame, permutations: int) -> DataFrame:
    """Mean over group 0 of the best match in group 1, against shuffled groups (as ``shuffled_groups`` draws them). ``items``: id, grp
    (0 or 1), vec. Similarities are worked out once for all permutations, by pairs of blocks; an item's groups in all
    permutations are drawn where it is, against the last draw of each group 0."""
    n, n0 = items.agg(F.count(F.lit(1)), F.count(F.when(F.col("grp") == 0, 1))).first()
    tail = F.coalesce(F.concat(F.lit(":"), F.col("id").cast("string")), F.lit(""))
    last = last_draws(items.select(tail.alias("tail")), permutations, n0, n) if n0 else None
    given = items.sparkSession.sparkContext.broadcast(last)
    kind = items.schema["vec"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = given.value
        for batch in batches:
            second = []
            for tail, grp in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if last is None:
                    drawn = np.ones(permutations, bool)
                else:
                    x = md5_draws(tail, permutations)
                    drawn = (x[:, 0] > last[:, 0]) | ((x[:, 0] == last[:, 0]) & (x[:, 1] > last[:, 1]))
                second.append(np.packbits(np.concatenate([[grp == 1], drawn])).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(second, pa.binary())], names=["id", "vec", "second"])

    drawn = items.select(F.col("id").cast("long").alias("id"), "vec", tail.alias("tail"), "grp").mapInArrow(run, f"id long, vec {kind}, second binary")
    return p_value(best_across(drawn, permutations + 1), "value")
