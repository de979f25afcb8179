"""Statistics over result tables."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def mann_whitney_u(df: DataFrame, keys: list[str], value: str, first, ranges: int = 64) -> DataFrame:
    """(keys, n1, n2, u): U of the rows where ``first`` holds, from averaged ranks."""
    return _mann_whitney(df, keys, value, first, ranges).drop("ties")


def _mann_whitney(df: DataFrame, keys: list[str], value: str, first, ranges: int = 64) -> DataFrame:
    """U and ``ties``, the sum of t^3 - t over values that t rows share. Equal values are counted first; the
    distinct ones of a group are dealt by ranges of value, and ranks start at what lies in the ranges below."""
    counts = df.groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.when(first, 1)).alias("_n1"), F.count(F.lit(1)).alias("_n"))
    cuts = counts.groupBy(*keys).agg(F.percentile_approx("_v", [i / ranges for i in range(1, ranges)]).alias("_cuts"))
    placed = counts.join(cuts, keys).withColumn("_range", F.size(F.filter("_cuts", lambda x: x < F.col("_v")))).drop("_cuts")
    below = F.coalesce(F.sum("_m").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = placed.groupBy(*keys, "_range").agg(F.sum("_n").alias("_m")).select(*keys, "_range", below.alias("_below"))
    ahead = F.sum("_n").over(Window.partitionBy(*keys, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    ranked = placed.withColumn("_ahead", ahead).join(starts, [*keys, "_range"])
    rank = F.col("_below") + F.col("_ahead") + (F.col("_n") + 1) / F.lit(2.0)
    n1 = F.sum("_n1")
    return ranked.groupBy(*keys).agg(n1.alias("n1"), (F.sum("_n") - n1).alias("n2"), (F.sum(F.col("_n1") * rank) - n1 * (n1 + 1) / F.lit(2.0)).alias("u"), F.sum(F.col("_n").cast("double") * F.col("_n") * F.col("_n") - F.col("_n")).alias("ties"))


@functools.cache
def u_shares(n1: int, n2: int) -> np.ndarray:
    """Shares of the ways to choose n1 of n1 + n2 ranks that give U = 0, 1, .. n1 n2, counted rank by rank."""
    ways = np.zeros((n1 + 1, n1 * n2 + 1))
    ways[0, 0] = 1.0
    for rank in range(n1 + n2):
        for j in range(min(n1, rank + 1), 0, -1):
            gain = rank - (j - 1)  # places above the least that the j-th chosen rank can have
            if gain <= n1 * n2:
                ways[j, gain:] += ways[j - 1, : n1 * n2 + 1 - gain]
    return ways[n1] / ways[n1].sum()


def mann_whitney_tails(u: float, n1: int, n2: int, ties: float = 0.0, most: int = 2500) -> tuple[float, float, float, bool]:
    """(P(U >= u), P(U <= u), two-sided, exact): by counting without ties for n1 n2 up to ``most``, else by the normal with
    a continuity correction and the variance that ties leave. An empty side: 1; all values equal: 1."""
    if n1 == 0 or n2 == 0:
        return 1.0, 1.0, 1.0, True
    if not ties and n1 * n2 <= most:
        shares = u_shares(n1, n2)
        above, below = float(shares[math.ceil(u - 1e-9) :].sum()), float(shares[: math.floor(u + 1e-9) + 1].sum())
        return min(1.0, above), min(1.0, below), min(1.0, 2 * min(above, below)), True
    n = n1 + n2
    sd = math.sqrt(max(0.0, n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))))
    tail = lambda d: 0.5 * math.erfc((d - 0.5) / sd / math.sqrt(2)) if sd > 0 else 1.0
    above, below = tail(u - n1 * n2 / 2), tail(n1 * n2 / 2 - u)
    return min(1.0, above), min(1.0, below), min(1.0, 2 * min(above, below)), False


def mann_whitney_p(u: float, n1: int, n2: int, most: int = 2500) -> float:
    """One-sided P(U >= u) without ties."""
    return mann_whitney_tails(u, n1, n2, 0.0, most)[0]


def mann_whitney(df: DataFrame, keys: list[str], value: str, first, most: int = 2500) -> DataFrame:
    """(keys, n1, n2, u, p_greater, p_less, p_two_sided, exact): the test of the rows where ``first`` holds against the others of
    their group. The null distribution is counted where groups are, a few at a time."""
    added = [("p_greater", T.DoubleType()), ("p_less", T.DoubleType()), ("p_two_sided", T.DoubleType()), ("exact", T.BooleanType())]
    rows = _mann_whitney(df, keys, value, first)
    schema = T.StructType([*[f for f in rows.schema.fields if f.name != "ties"], *[T.StructField(n, t) for n, t in added]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = lambda c: batch.column(batch.schema.get_field_index(c)).to_pylist()  # noqa: E731, B023
            found = [mann_whitney_tails(u, n1, n2, ties, most) for u, n1, n2, ties in zip(of("u"), of("n1"), of("n2"), of("ties"), strict=True)]
            columns = [pa.array([x[k] for x in found], pa.bool_() if k == 3 else pa.float64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k, f in enumerate(batch.schema) if f.name != "ties"], *columns], names=schema.names)

    return rows.mapInArrow(run, schema)


def incomplete_beta(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (of the nearer tail)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + term * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + term / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def pearson_p(r: float | None, n: int) -> float | None:
    """Two-sided p of a correlation of n pairs; none for fewer than three, or where a side doesn't vary."""
    if r is None or r != r or n < 3:
        return None
    return incomplete_beta(max(0.0, 1 - r * r), (n - 2) / 2, 0.5)


def pearson_test(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys, n, r, p): correlation of the pairs in which neither is null, and its p."""
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*keys)
    rows = pairs.agg(F.count(F.lit(1)).alias("n"), F.covar_pop(a, b).alias("c"), spread.alias("s")).select(*keys, "n", F.when(F.col("s") > 0, F.col("c") / F.col("s")).alias("r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, r = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("n", "r"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([pearson_p(*x) for x in zip(r, n, strict=True)], pa.float64())], names=[*batch.schema.names, "p"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("p", T.DoubleType())]))


def pearson(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr(a, b).alias("r"))
