"""Quality classifier (op1 and the first stage of the pipeline): a regularised quadratic discriminant.

A document is its statistics over the whole text (``FEATURES``), transformed to be near normal: logarithms of
lengths, logits of shares. Counts, sums and products of the statistics are added up per class over all labelled
training rows where they are, and only these sums reach the driver. A class' covariance is shrunk towards the
diagonal of the common one. A document's discriminant is the difference of the log densities under the two classes,
from Mahalanobis distances with each class' Cholesky factor, kept per worker; a logistic curve, fitted to a histogram
of the training rows' discriminants, makes it a score.

null and empty text: scored by the statistics of an empty text. Labels other than 0 and 1 aren't learnt from; a doc_id
with several labels counts with each. Without training rows of both classes every score is the share of label 1 (0.5
without any). Repeated rows: each scored for itself. Empty table: no rows. Of the documents only doc_id and text are
read, and doc_id only to tell rows apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom_lm import fold
from .common import batch_of, in_chunks, read_table, write_shared

THRESHOLD = 0.3
FEATURES = ("chars", "words", "word_length", "upper", "digits", "stops", "bangs", "symbols", "bars", "wide", "lines", "line_length", "byte_entropy", "distinct_words", "distinct_lines", "symbol_ends", "upper_words", "repeats")
#: Least spread of a statistic, as a share of its spread over all rows, and least weight of the common diagonal.
FLOOR, SHRINK = 1e-3, 0.02
#: Bins of the discriminant (on the scale of ``squeezed``) for the logistic curve.
BINS, REACH = 400, 10.0

_BYTES = np.zeros((256, 8))
for _column, _members in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?'\"-()", b"!", b"#$%&*+/<=>@[\\]^_`{}~", b"|", bytes(range(128, 256)), b"\n")):
    _BYTES[list(_members), _column] = 1
_LETTER = np.zeros(256)
_LETTER[[*range(65, 91), *range(97, 123)]] = 1
_SYMBOL = _BYTES[:, 4] + _BYTES[:, 5] > 0


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Logit of a share, drawn in a little from either end."""
    p = (part + 0.05) / (whole + 0.1)
    return np.log(p / (1 - p))


def _pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pieces of each of ``n`` texts, and pieces equal to the one before, given disjoint pieces of ``data``
    in order and their owners."""
    if not len(starts):
        return np.zeros(n), np.zeros(n)
    # Pieces and what lies between them alternate in one array of strings; every second one is a piece.
    bounds = np.column_stack([starts, ends]).ravel()
    both = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds)), pa.py_buffer(np.ascontiguousarray(data))])
    code = both.dictionary_encode().indices.to_numpy()[::2].astype(np.int64)
    code += owner * (code.max() + 1)
    again = owner[1:][code[1:] == code[:-1]]
    kinds = np.sort(code)  # owners come first in a code and in order, so they stand where they did
    first = np.concatenate([[True], kinds[1:] != kinds[:-1]])
    return np.bincount(owner[first], minlength=n).astype(float), np.bincount(again, minlength=n).astype(float)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, FEATURES) of texts given as bytes and offsets."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    histogram = np.bincount(row * 256 + data, minlength=256 * n).reshape(n, 256).astype(float)
    upper, digits, stops, bangs, symbols, bars, wide, breaks = (histogram @ _BYTES).T
    chars = size - histogram[:, 128:192].sum(1)
    letters = histogram @ _LETTER
    space = (data == 32) | ((data >= 9) & (data <= 13))
    first = np.zeros(len(data), bool)
    first[offsets[:-1][size > 0]] = True
    begins = ~space & (first | np.concatenate([[True], space[:-1]])) if len(data) else space
    last = np.zeros(len(data), bool)
    last[offsets[1:][size > 0] - 1] = True
    ends = ~space & (last | np.concatenate([space[1:], [True]])) if len(data) else space
    starts, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    owner = row[starts]
    words = np.bincount(owner, minlength=n).astype(float)
    word_bytes = np.bincount(owner, weights=stop - starts, minlength=n)
    symbol_ends = np.bincount(owner, weights=_SYMBOL[data[stop - 1]], minlength=n)
    second = data[np.minimum(starts + 1, stop - 1)]
    capital = ((data[starts] >= 65) & (data[starts] <= 90) & (second >= 65) & (second <= 90) & (stop - starts > 1)).astype(float)
    upper_words = np.bincount(owner, weights=capital, minlength=n)
    newline = data == 10
    heads = np.flatnonzero(first | np.concatenate([[False], newline[:-1]])) if len(data) else np.zeros(0, np.int64)
    tails = np.append(heads[1:], len(data)) if len(heads) else heads
    tails = tails - newline[tails - 1] if len(heads) else tails  # without the line break
    lines = breaks + 1
    p = histogram / np.maximum(size, 1)[:, None]
    entropy = -(p * np.log(np.where(p > 0, p, 1))).sum(1)
    lower = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    distinct_words, repeats = _pieces(lower, starts, stop, owner, n)
    distinct_lines, _ = _pieces(data, heads, tails, row[heads] if len(heads) else heads, n)
    return np.column_stack(
        [
            np.log1p(chars), np.log1p(words), np.log1p(word_bytes / np.maximum(words, 1)), _share(upper, letters), _share(digits, size), _share(stops, size), _share(bangs, size), _share(symbols, size), _share(bars, size),
            _share(wide, size), np.log1p(lines), np.log1p(size / lines), entropy, _share(distinct_words, words), _share(np.minimum(distinct_lines, lines), lines), _share(symbol_ends, words), _share(upper_words, words), _share(repeats, words),
        ]
    )


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and ``x``, the transformed statistics."""
    schema = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in in_chunks(batches, "text"):
            x = statistics(data, offsets)
            yield batch_of(schema, batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel())))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, x array<double>")


@dataclass
class Model:
    """Per class (0, 1): mean, inverse Cholesky factor, log determinant; then slope and offset of the logistic curve."""

    mean: np.ndarray
    factor: np.ndarray
    log_det: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def discriminant(self, x: np.ndarray) -> np.ndarray:
        density = [-0.5 * (((x - self.mean[c]) @ self.factor[c].T) ** 2).sum(1) - 0.5 * self.log_det[c] for c in (0, 1)]
        return density[1] - density[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * squeezed(self.discriminant(x)) + self.offset, -40, 40)))


def squeezed(d: np.ndarray) -> np.ndarray:
    return np.sign(d) * np.log1p(np.abs(d))


def fit_density(n: np.ndarray, sums: np.ndarray, products: np.ndarray) -> Model:
    """From the classes' counts (2), sums (2, p) and sums of products (2, p, p)."""
    p = sums.shape[1]
    mean = sums / n[:, None]
    centred = products - n[:, None, None] * mean[:, :, None] * mean[:, None, :]
    total = products.sum(0) / n.sum() - np.outer(sums.sum(0), sums.sum(0)) / n.sum() ** 2
    common = np.maximum(np.diag(centred.sum(0)) / n.sum(), 0) + FLOOR * np.maximum(np.diag(total), 1e-6)
    factor, log_det = [], []
    for c in (0, 1):
        weight = max(SHRINK, (p + 2) / (n[c] + p + 2))
        covariance = (1 - weight) * centred[c] / n[c] + weight * np.diag(common)
        lower = np.linalg.cholesky(covariance)
        factor.append(np.linalg.inv(lower))
        log_det.append(2 * np.log(np.diag(lower)).sum())
    return Model(mean, np.array(factor), np.array(log_det))


def fit_curve(counts: np.ndarray) -> tuple[float, float]:
    """Logistic slope and offset from (bins, 2) counts of the classes, by Newton steps with a little ridge."""
    x = (np.arange(BINS) + 0.5) / BINS * 2 * REACH - REACH
    z = np.column_stack([x, np.ones(BINS)])
    n, w = counts.sum(1), np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (n * p * (1 - p))[:, None]).T @ z + np.eye(2) * 1e-2, z.T @ (counts[:, 1] - n * p) - 1e-2 * (w - [1.0, 0.0]))
        w = w + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(w[0]), 1e-3), float(w[1])


def fit(learning: DataFrame) -> Model | float:
    """The model for ``learning`` (x, quality), kept in a table; a share of label 1 where a class is missing."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = len(FEATURES)
        total = np.zeros((2, 1 + p + p * p))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(len(batch), p)
            for c in (0, 1):
                own = x[batch.column(1).to_numpy() == c]
                total[c] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        k = np.arange(total.size)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total.ravel())], names=["k", "v"])

    got = learning.select("x", "quality").mapInArrow(sums, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()  # of fixed size
    p = len(FEATURES)
    flat = np.zeros(2 * (1 + p + p * p))
    for k, v in got:
        flat[k] = v
    flat = flat.reshape(2, -1)
    n = flat[:, 0]
    if n.min() < 2:
        return float(n[1] / n.sum()) if n.sum() else 0.5
    model = fit_density(n, flat[:, 1 : 1 + p], flat[:, 1 + p :].reshape(2, p, p))
    shared = learning.sparkSession.sparkContext.broadcast(model)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2 * BINS, np.int64)
        for batch in batches:
            d = squeezed(shared.value.discriminant(batch.column(0).flatten().to_numpy().reshape(len(batch), p)))
            at = np.clip(((d + REACH) / (2 * REACH) * BINS).astype(int), 0, BINS - 1)
            counts += np.bincount(at * 2 + batch.column(1).to_numpy(), minlength=2 * BINS)
        k = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(counts[k])], names=["k", "v"])

    counts = np.zeros(2 * BINS)
    for k, v in learning.select("x", "quality").mapInArrow(bins, "k long, v long").groupBy("k").agg(F.sum("v").alias("v")).collect():  # of fixed size
        counts[k] = v
    model.slope, model.offset = fit_curve(counts.reshape(BINS, 2))
    return model


def labelled(stats: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    quality = labels.where("quality IN (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("long").alias("quality"))
    return stats.where(~held_out).join(quality.where(~held_out), "doc_id").select("x", "quality")


def scored(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; learnt from those whose ``held_out`` is false."""
    stats = write_shared(with_statistics(docs), "statistics")
    model = fit(write_shared(labelled(stats, labels, held_out), "labelled"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(len(batch), len(FEATURES))
            score = shared.value.score(x) if isinstance(shared.value, Model) else np.full(len(batch), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    out = stats.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that aren't rejected, with all their columns; each is scored where it stands."""
    model = fit(write_shared(labelled(with_statistics(docs), labels, held_out), "labelled"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in in_chunks(batches, "text"):
            score = shared.value.score(statistics(data, offsets)) if isinstance(shared.value, Model) else np.full(len(batch), shared.value)
            yield batch.filter(pa.array(score >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op1_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), fold(0))
