"""Permutation tests without sorting: a keyed bijection gives an item's place in a permutation by arithmetic.

``places`` is a swap-or-not shuffle of 0 .. n - 1: in each round a key K (of permutation and round) pairs x with (K - x) mod n,
and a bit, drawn from the round and the larger of the two, says whether they change places. Each round is a bijection for
any n, so exactly n0 items of a permutation have places below n0: they are its group 0. Permutation 0 has the true groups.
All is done on integers below 2^63, so another engine draws the same.

Items need numbers from 0 on, once for all permutations: ``numbered`` gives them by ranges, no window over all rows.
Sums by permutation are products of a matrix of memberships with the items' vectors, block by block, added up over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import write_shared
from .blocks import best_across
from .similarity import p_value
from .sums import DDL, blocks_of, count_of, merged, placed

ROUNDS = 24
WORD, HALF, MULTIPLIER = 1 << 32, 1 << 31, 0x45D9F3B
#: Cells of (item, permutation) worked on at a time, and groups that may be compared by pairs.
CELLS, GROUPS = 1 << 18, 16


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 0 .. 2^32 - 1 that scatters."""
    for _ in range(2):
        x = (x ^ (x >> 16)) * MULTIPLIER % WORD
    return x ^ (x >> 16)


def places(index: np.ndarray, n: int, permutations: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Place of each index (rows) in each permutation (columns)."""
    x = np.repeat(index.astype(np.int64)[:, None], len(permutations), 1)
    for r in range(rounds):
        salt = mix(permutations.astype(np.int64) * 64 + r)[None, :]
        partner = (mix((salt + HALF) % WORD) % n + n - x) % n
        bit = mix((np.maximum(x, partner) + salt) % WORD) % 2 == 1
        x = np.where(bit, partner, x)
    return x


def places_sql(items: str, n: str, permutations: int, rounds: int = ROUNDS) -> str:
    """CTEs .. pl (perm, pos, place) of the same arithmetic; ``items``: a table with column pos, ``n``: a scalar query."""

    def m(x: str) -> str:
        for _ in range(2):
            x = f"(xor({x}, ({x}) >> 16) * {MULTIPLIER} % {WORD})"
        return f"xor({x}, ({x}) >> 16)"

    return f"""
    keys AS (SELECT perm, r, salt, {m(f"((salt + {HALF}) % {WORD})")} % ({n}) AS k FROM (SELECT perm, r, {m("(perm * 64 + r)")} AS salt FROM range(1, {permutations} + 1) AS t(perm), range(0, {rounds}) AS u(r))),
    walk AS (SELECT perm, pos, 0::BIGINT AS r, pos AS x FROM {items}, range(1, {permutations} + 1) AS t(perm)
        UNION ALL SELECT perm, pos, r + 1, CASE WHEN {m(f"((greatest(x, partner) + salt) % {WORD})")} % 2 = 1 THEN partner ELSE x END
        FROM (SELECT walk.perm, pos, walk.r, x, salt, (k + ({n}) - x) % ({n}) AS partner FROM walk JOIN keys ON walk.perm = keys.perm AND walk.r = keys.r)),
    pl AS (SELECT perm, pos, x AS place FROM walk WHERE r = {rounds})"""


def numbered(df: DataFrame, order: list[str], name: str = "index") -> DataFrame:
    """``df`` as a table with the number of each row in ``order``, from 0 on: rows are sorted by ranges, numbered in each, and
    the ranges' sizes (one row each) tell where they start."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed_ = ranges.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id() % F.lit(1 << 33)})
    kept = write_shared(placed_, "numbered")
    before = F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = kept.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).select("_range", F.coalesce(before, F.lit(0)).alias("_start"))
    return kept.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_at")).drop("_range", "_at", "_start")


def by_group(items: DataFrame) -> tuple[DataFrame, dict]:
    """``items`` (id, grp, vec) with each one's number within its group, and the groups' sizes."""
    rows = numbered(items.where("grp IS NOT NULL AND vec IS NOT NULL"), ["grp", "id"])
    sizes = {r.grp: r.n for r in rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).orderBy("grp").limit(GROUPS + 1).collect()}
    if len(sizes) > GROUPS:
        raise ValueError(f"more than {GROUPS} groups")
    start = dict(zip(sizes, np.cumsum([0, *sizes.values()]).tolist(), strict=False))
    offset = F.create_map(*[F.lit(x) for pair in start.items() for x in pair])[F.col("grp")] if start else F.lit(0)
    return rows.withColumn("index", F.col("index") - offset), sizes


def membership(index: np.ndarray, second: np.ndarray, n0: int, n: int, permutations: np.ndarray) -> np.ndarray:
    """Whether each item is in group 0 of each permutation; ``second``: items of the second group, numbered after the first."""
    at = index + np.where(second, n0, 0)
    return np.where(permutations[None, :] == 0, ~second[:, None], places(at, n, permutations) < n0)


def mean_tests(items: DataFrame, permutations: int, pairs: list[tuple] | None = None) -> DataFrame:
    """(a, b, observed, p_value): mean product across two groups of ``items`` (id, grp, vec) against shuffled groups, for all pairs
    of groups or those given. The mean of all cross products is the product of the sums, so no pair is made."""
    spark = items.sparkSession
    rows, sizes = by_group(items)
    pairs = [p for p in pairs or combinations(sizes, 2) if p[0] in sizes and p[1] in sizes]
    kind = items.schema["grp"].dataType.simpleString()
    schema = f"a {kind}, b {kind}, observed double, p_value double"
    if not pairs:
        return spark.createDataFrame([], schema)
    dims = len(rows.select("vec").first().vec)
    perms = np.arange(permutations + 1)
    shape = (len(pairs) * len(perms), dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, every = np.zeros((len(pairs), len(perms), dims)), np.zeros((len(pairs), dims))
        step = max(1, CELLS // len(perms))
        for batch in batches:
            for at in range(0, len(batch), step):
                piece = batch.slice(at, step)
                groups, index = np.array(piece.column(0).to_pylist(), object), piece.column(1).to_numpy(zero_copy_only=False)
                vec = piece.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
                for k, (a, b) in enumerate(pairs):
                    own = (groups == a) | (groups == b)
                    if own.any():
                        inside = membership(index[own], groups[own] == b, sizes[a], sizes[a] + sizes[b], perms)
                        first[k] += inside.T.astype(np.float64) @ vec[own]
                        every[k] += vec[own].sum(0)
        yield from blocks_of(first.reshape(shape))
        yield from blocks_of(every, count_of(shape))

    sums = merged(rows.select("grp", "index", "vec").mapInArrow(run, DDL))
    first, every = placed(sums, shape).reshape(len(pairs), len(perms), dims), placed(sums, (len(pairs), dims), count_of(shape))
    out = []
    for k, (a, b) in enumerate(pairs):
        value = np.round((first[k] * (every[k] - first[k])).sum(1) / (sizes[a] * sizes[b]), 9)
        out.append((a, b, float(value[0]), float((value[1:] >= value[0]).mean())))
    return spark.createDataFrame(out, schema)


def best_test(items: DataFrame, permutations: int, a, b) -> DataFrame:
    """(observed, p_value): mean over group ``a`` of the best product in group ``b``, against shuffled groups. Products are worked
    out once for all permutations, by pairs of blocks."""
    rows, sizes = by_group(items.where(F.col("grp").isin(a, b)))
    perms, n0 = np.arange(permutations + 1), sizes.get(a, 0)
    n = sum(sizes.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CELLS // len(perms))
        for batch in batches:
            for at in range(0, len(batch), step):
                piece = batch.slice(at, step)
                groups, index = np.array(piece.column(1).to_pylist(), object), piece.column(2).to_numpy(zero_copy_only=False)
                second = np.packbits(~membership(index, groups == b, n0, n, perms), axis=1)
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(3), pa.array([x.tobytes() for x in second], pa.binary())], names=["id", "vec", "second"])

    kind = rows.schema["vec"].dataType.simpleString()
    drawn = rows.select(F.col("id").cast("long").alias("id"), "grp", "index", "vec").mapInArrow(run, f"id long, vec {kind}, second binary")
    return p_value(best_across(drawn, len(perms)), "value")
