"""An encoder of passages that is learnt from a corpus.

A passage is a row of hashed counts: its words and the three-letter pieces of these, by XXH64 into ``FEATURES`` columns;
a count n weighs (1 + ln n) times ln((1 + rows) / (1 + rows with the column)) + 1, and rows have length 1. The encoder is
the best ``dims`` right singular directions V of that matrix A, and a passage's vector is a V, at length 1.

V comes from a randomised decomposition whose passes leave the rows where they are. A pass multiplies A with a thin matrix
W (random at first), Y = A W, block of rows by block of rows; it keeps the R of a QR decomposition of Y, block upon block,
and the sum of Z = A'Y. Tasks give out R and Z in blocks of columns, which are added up by block; both are bounded by
``size`` and ``dims``, whatever the corpus. Z orthonormalised is the next pass' W; the last pass has Q = Y R^-1 in
Q'A = R'^-1 Z', whose decomposition gives V. Directions have a positive largest component.

null or empty text, or one without a letter or digit: a vector of zeros. Empty corpus: all vectors are zeros. Repeated
rows count as often as they come.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import write_shared
from .sums import DDL, block_row, blocks_of, merged, placed

FEATURES, DIMS, EXTRA, PASSES = 1 << 14, 48, 16, 4
#: Counts worked on at a time.
COUNTS = 1 << 17


def feature_ids(text, size: int = FEATURES):
    """Columns of a text's words and their three-letter pieces, with repeats."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    place = lambda kind, s: F.pmod(F.xxhash64(F.lit(kind), s), F.lit(size)).cast("int")
    framed = lambda w: F.concat(F.lit("<"), w, F.lit(">"))
    pieces = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: place("piece", F.substring(framed(w), i, F.lit(3))))
    return F.coalesce(F.concat(F.transform(words, lambda w: place("word", w)), F.flatten(F.transform(words, pieces))), F.array().cast("array<int>"))


def rows_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, count) of a list column of column numbers with repeats."""
    sizes = np.diff(column.offsets.to_numpy())
    ids = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    pair, n = np.unique(np.repeat(np.arange(len(column)), sizes) * FAR + ids, return_counts=True)
    return pair // FAR, pair % FAR, n


FAR = 1 << 32


def weighed(row: np.ndarray, n: np.ndarray, idf: np.ndarray, rows: int) -> np.ndarray:
    """The matrix' values; ``idf`` of each value's column."""
    value = (1.0 + np.log(n)) * idf
    norm = np.sqrt(np.bincount(row, value * value, rows))
    return value / norm[row]


def times(row: np.ndarray, column: np.ndarray, value: np.ndarray, by: np.ndarray, rows: int) -> np.ndarray:
    """Rows of the sparse matrix times ``by``; ``row`` rises."""
    out = np.zeros((rows, by.shape[1]))
    heads = np.flatnonzero(np.diff(row, prepend=-1))
    if len(heads):
        out[row[heads]] = np.add.reduceat(value[:, None] * by[column], heads)
    return out


def pieces(column: pa.ListArray) -> Iterator[pa.ListArray]:
    """Slices of a list column with at most ``COUNTS`` values or so (a row at least)."""
    offsets = column.offsets.to_numpy()
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + COUNTS, side="right")) - 1)
        yield column.slice(at, end - at)
        at = end


def passed(rows: DataFrame, idf: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(R, Z) of a pass over ``rows`` (ids): R of A ``by``, and A'A ``by``."""
    thin = by.shape[1]
    given = rows.sparkSession.sparkContext.broadcast((idf, by))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf_, by_ = given.value
        r, z = np.zeros((0, thin)), np.zeros((len(idf_), thin))
        for batch in batches:
            for ids in pieces(batch.column(0)):
                row, column, n = rows_of(ids)
                value = weighed(row, n, idf_[column], len(ids))
                y = times(row, column, value, by_, len(ids))
                r = np.linalg.qr(np.vstack([r, y]), "r")
                order = np.argsort(column, kind="stable")
                heads = np.flatnonzero(np.diff(column[order], prepend=-1))
                if len(heads):
                    z[column[order][heads]] += np.add.reduceat(value[order, None] * y[row[order]], heads)
        if len(r):
            yield block_row(0, r)
        yield from blocks_of(z, 1)

    def combine(k: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a + b if k else np.linalg.qr(np.vstack([a.reshape(-1, thin), b.reshape(-1, thin)]), "r").ravel()

    sums = merged(rows.select("ids").mapInArrow(run, DDL), combine)
    return sums.get(0, np.zeros(thin)).reshape(-1, thin), placed(sums, by.shape, 1)


@dataclass
class Encoder:
    """Weight of each column, singular directions (columns by dims), and their singular values."""

    idf: np.ndarray
    directions: np.ndarray
    singular: np.ndarray

    @classmethod
    def fit(cls, corpus: DataFrame, text: str = "psg", dims: int = DIMS, size: int = FEATURES, passes: int = PASSES, extra: int = EXTRA, seed: int = 7) -> Encoder:
        rows = write_shared(corpus.select(feature_ids(F.col(text), size).alias("ids")).where(F.size("ids") > 0), "feature-ids")
        many = rows.count()
        seen = rows.select(F.explode(F.array_distinct("ids")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n")).collect()  # at most ``size``
        df = np.zeros(size)
        for i, n in seen:
            df[i] = n
        idf = np.log((1 + many) / (1 + df)) + 1
        by = np.random.default_rng(seed).standard_normal((size, dims + extra))
        by[df == 0] = 0.0
        for _ in range(passes - 1):
            by = np.linalg.qr(passed(rows, idf, by)[1])[0]
        r, z = passed(rows, idf, by)
        _, s, vt = np.linalg.svd(np.linalg.pinv(r.T) @ z.T, full_matrices=False)
        rank = int((s > 1e-9 * max(1.0, s.max(initial=0.0))).sum())
        v, values = np.zeros((size, dims)), np.zeros(dims)
        k = min(dims, rank)
        v[:, :k], values[:k] = vt[:k].T, s[:k]
        return cls(idf, v * np.where(v[np.abs(v).argmax(0), np.arange(dims)] < 0, -1.0, 1.0), values)

    def embed(self, df: DataFrame, text: str = "psg", vec: str = "vec", unit: bool = True) -> DataFrame:
        """``df`` with each row's vector."""
        spark, dims = df.sparkSession, self.directions.shape[1]
        given = spark.sparkContext.broadcast((self.idf, self.directions))
        schema = T.StructType([*df.schema.fields, T.StructField(vec, T.ArrayType(T.DoubleType()))])
        names = [f.name for f in schema.fields]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            idf, by = given.value
            for batch in batches:
                at = 0
                for ids in pieces(batch.column(batch.num_columns - 1)):
                    row, column, n = rows_of(ids)
                    x = times(row, column, weighed(row, n, idf[column], len(ids)), by, len(ids))
                    if unit:
                        x /= np.maximum(np.sqrt((x * x).sum(1)), 1e-12)[:, None]
                    made = pa.ListArray.from_arrays(pa.array(np.arange(0, len(ids) + 1) * dims, pa.int32()), pa.array(x.ravel()))
                    yield pa.RecordBatch.from_arrays([*[c.slice(at, len(ids)) for c in batch.columns[:-1]], made], names=names)
                    at += len(ids)

        return df.select(*[F.col(f"`{c}`") for c in df.columns], feature_ids(F.col(text), len(self.idf)).alias("_ids")).mapInArrow(run, schema)

    def table(self, spark: SparkSession) -> DataFrame:
        """The encoder as rows (feature, idf, direction), and its singular values as feature -1."""
        rows = [(k, float(w), v.tolist()) for k, (w, v) in enumerate(zip(self.idf, self.directions, strict=True))]
        return spark.createDataFrame([(-1, 0.0, self.singular.tolist()), *rows], "feature int, idf double, direction array<double>")

    @classmethod
    def of_table(cls, table: DataFrame) -> Encoder:
        rows = sorted(table.collect())  # as many as the encoder has columns
        return cls(np.array([r[1] for r in rows[1:]]), np.array([r[2] for r in rows[1:]]), np.array(rows[0][2]))
