"""Best-fit packing planned on the histogram of lengths (op4 and the last stage of the pipeline).

1. Every document becomes token ids and an end id; only one longer than ``capacity`` is cut, into pieces.
2. Pieces are counted by length: at most ``capacity`` counts, however many documents.
3. The planner does best-fit decreasing over the counts: sequences with equal contents so far are one
   group, and a length with n pieces takes a place in n sequences of the fullest groups that have room.
4. A piece's rank within its length (a count by length and slice before it, plus its place in its slice)
   finds the plan's run of slots, which gives sequence and offset.

null text: as empty (one piece, the end id). Repeated rows and equal doc_ids: each row is packed for itself.
Empty table: no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe_codec import default_path
from .chunk_encoder import encoder
from .common import batch_of, ids_of, in_chunks, read_table, write_shared

CAPACITY, END_ID = 2048, 0

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"


def with_ends(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts' ids, each text followed by ``end_id``."""
    n = len(bounds) - 1
    out = np.full(len(ids) + n, end_id, np.uint32)
    keep = np.ones(len(out), bool)
    keep[bounds[1:] + np.arange(n)] = False
    out[keep] = ids
    return out, bounds + np.arange(n + 1)


def cut_pieces(bounds: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, number within the row, length) of every piece."""
    sizes = np.diff(bounds)
    n = -(-sizes // capacity)
    row = np.repeat(np.arange(len(sizes)), n)
    number = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row, number, np.minimum(capacity, sizes[row] - number * capacity)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, folded: bool = False) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32. ``folded``: the tokenizer takes lower case."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, folded=folded)
        for batch, data, offsets in in_chunks(batches, "text"):
            ids, bounds = with_ends(*coder.encode(data, offsets), end_id)
            row, number, length = cut_pieces(bounds, capacity)
            begin = bounds[row] + number * capacity
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(begin.tolist(), length.tolist(), strict=True)]
            yield batch_of(PIECES, ids_of(batch, "doc_id").take(pa.array(row)), number.astype(np.int32), number * capacity, length, crc)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES_DDL)


def plan_slots(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best-fit decreasing over {length: count}.

    Rows (length, first rank, slots, first sequence, offset): pieces of that length with these ranks take the
    same offset in consecutive sequences. There are at most a few rows for each pair of a length and a group
    that it splits, so the plan is bounded by the lengths, not by the documents.
    """
    rows: list[tuple[int, int, int, int, int]] = []
    by_gap: dict[int, list[tuple[int, int]]] = {}  # room left: groups (first sequence, sequences)
    sequences = 0
    present = np.zeros(capacity + 1, bool)
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            fits = np.flatnonzero(present[length:])
            if len(fits):
                gap = length + int(fits[0])
                first, many = by_gap[gap].pop()
                if not by_gap[gap]:
                    present[gap] = False
            else:
                gap, first, many = capacity, sequences, -(-left // (capacity // length))
                sequences += many
            used = min(many, left)
            rows.append((length, rank, used, first, capacity - gap))
            rank, left = rank + used, left - used
            for room, begin, size in ((gap - length, first, used), (gap, first + used, many - used)):
                if size and room:
                    by_gap.setdefault(room, []).append((begin, size))
                    present[room] = True
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


PACKED_DDL = PIECES_DDL + ", sequence_id long, offset long"
PACKED = pa.schema([*PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Sequence and offset for pieces kept in a table (it is read twice and must not change between)."""
    # The slice spreads a length that many pieces share; a slice's rows of one length are ranked together.
    spark = cut.sparkSession
    slices = max(64, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    sliced = cut.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(slices)).cast("int"))
    by_slice = sliced.groupBy("length", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counted = write_shared(by_slice.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "length-slices")
    counts = {r[0]: r[1] for r in counted.groupBy("length").agg(F.sum("n")).collect()}  # at most ``capacity`` rows
    plan = spark.sparkContext.broadcast(plan_slots(counts, capacity))  # bounded by the lengths
    within = Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        sliced.withColumn("place", F.row_number().over(within))
        .join(counted.select("length", "slice", "before"), ["length", "slice"])
        .withColumn("rank", F.col("before") + F.col("place") - 1)
        .select(*PIECES.names, "rank")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = plan.value
        keys = (slots[:, 0] << 44) + slots[:, 1] if len(slots) else slots
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            yield batch_of(PACKED, *[batch.column(batch.schema.get_field_index(c)) for c in PIECES.names], slots[at, 3] + rank - slots[at, 1], slots[at, 4])

    return ranked.mapInArrow(run, PACKED_DDL)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    return pack(write_shared(pieces(docs, default_path("word_bpe_49k.json"), capacity, end_id, folded=True), "pieces"), capacity)


def op4_histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))
