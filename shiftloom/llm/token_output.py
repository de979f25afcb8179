"""Token-id output (op6): best-fit-decreasing packing with a segment tree, written as binary id matrices.

A task reads its split of the documents once and packs as it reads: pieces gather in a window of bounded size
(``window_tokens``), a window's pieces are placed longest first, each in the fullest sequence with room, found
in a segment tree over the sequences' room, and the sequences are given out. Nothing is shuffled; a lost task
is done again from its split. Documents longer than ``capacity`` are cut into pieces without loss: piece p
holds the document's ids from p x capacity on.

Rows are sequences: ``input_ids`` (capacity ids, little-endian uint16 or uint32, ``pad_id`` after the last
segment), ``position_ids`` (uint16, starting again at 0 with each segment), ``cu_seqlens`` (0, then the end of
each segment) and, in the segments' order, ``doc_ids`` and ``pieces``.

null text: as empty (the end id alone). Repeated rows: each is written for itself. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bpe_codec import default_path
from .chunk_encoder import encoder, library
from .common import ids_of, in_chunks, read_table, shared_path
from .histogram_packing import cut_pieces, with_ends

CAPACITY, END_ID, WINDOW_TOKENS = 2048, 50256, 8 << 20

SEQUENCES = pa.schema(
    [("sequence_id", pa.int64()), ("n_tokens", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())), ("cu_seqlens", pa.list_(pa.int32())), ("input_ids", pa.binary()), ("position_ids", pa.binary())]
)
SEQUENCES_DDL = "sequence_id long, n_tokens int, doc_ids array<long>, pieces array<int>, cu_seqlens array<int>, input_ids binary, position_ids binary"


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Number of each piece's sequence. The segment tree has a leaf for each amount of room and holds whether a
    sequence with that room is open, so the least room that suffices is found going up and down once."""
    size = 1 << (capacity + 1).bit_length()
    tree = [False] * (2 * size)
    open_by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    placed = np.empty(len(lengths), np.int64)
    sequences = 0

    def least(room: int) -> int:
        """The least open room from ``room`` on, or -1."""
        node = room + size
        if tree[node]:
            return room
        while node > 1 and (node & 1 or not tree[node + 1]):
            node >>= 1
        if node <= 1:
            return -1
        node += 1
        while node < size:
            node = 2 * node if tree[2 * node] else 2 * node + 1
        return node - size

    def note(room: int, is_open: bool) -> None:
        node = room + size
        while node and tree[node] != is_open:
            tree[node] = is_open
            if node > 1 and not is_open and tree[node ^ 1]:
                return
            node >>= 1

    for k in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[k])
        room = least(need)
        if room < 0:
            room, number = capacity, sequences
            sequences += 1
        else:
            number = open_by_room[room].pop()
            if not open_by_room[room]:
                note(room, False)
        placed[k] = number
        if left := room - need:
            if not open_by_room[left]:
                note(left, True)
            open_by_room[left].append(number)
    return placed


class Window:
    """Pieces that wait to be packed."""

    def __init__(self, capacity: int, dtype: str, pad_id: int) -> None:
        self.capacity, self.dtype, self.pad_id = capacity, dtype, pad_id
        self.parts: list[tuple] = []
        self.tokens = 0

    def add(self, ids: np.ndarray, bounds: np.ndarray, doc_ids: np.ndarray) -> None:
        row, number, length = cut_pieces(bounds, self.capacity)
        self.parts.append((ids.astype(self.dtype), doc_ids[row], number, length))
        self.tokens += len(ids)

    def flush(self, first: int) -> pa.RecordBatch | None:
        if not self.parts:
            return None
        ids, doc_ids, number, length = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.tokens = [], 0
        begin = np.cumsum(length) - length
        sequence = best_fit_decreasing(length, self.capacity)
        order = np.argsort(sequence, kind="stable")
        heads = np.flatnonzero(np.diff(sequence[order], prepend=-1))
        ends = np.append(heads[1:], len(order))
        matrix = np.full((len(heads), self.capacity), self.pad_id, self.dtype)
        places = np.zeros((len(heads), self.capacity), "<u2")
        cu, totals = [], []
        for i, (a, b) in enumerate(zip(heads.tolist(), ends.tolist(), strict=True)):
            at, bounds = 0, [0]
            for k in order[a:b].tolist():
                n = int(length[k])
                matrix[i, at : at + n] = ids[begin[k] : begin[k] + n]
                places[i, at : at + n] = np.arange(n)
                at += n
                bounds.append(at)
            cu.append(bounds)
            totals.append(at)
        lists = pa.array(np.append(heads, len(order)), pa.int32())
        return pa.RecordBatch.from_arrays(
            [
                pa.array(first + np.arange(len(heads)), pa.int64()),
                pa.array(totals, pa.int32()),
                pa.ListArray.from_arrays(lists, pa.array(doc_ids[order], pa.int64(), mask=doc_ids[order] == NO_ID)),
                pa.ListArray.from_arrays(lists, pa.array(number[order], pa.int32())),
                pa.array(cu, pa.list_(pa.int32())),
                pa.array([x.tobytes() for x in matrix], pa.binary()),
                pa.array([x.tobytes() for x in places], pa.binary()),
            ],
            schema=SEQUENCES,
        )


#: Stands for a null doc_id inside a window.
NO_ID = np.iinfo(np.int64).min


def packed_sequences(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, pad_id: int = 0, window_tokens: int = WINDOW_TOKENS, dtype: str = "<u2") -> DataFrame:
    """Sequences as described above; a sequence_id is the task's number x 2^40 plus a running number."""
    ids, most = library(path).get_vocab_size(with_added_tokens=True), np.iinfo(dtype).max
    if max(ids - 1, end_id, pad_id) > most:
        raise ValueError(f"ids up to {max(ids - 1, end_id, pad_id)} don't fit {dtype}: take '<u4'")
    if capacity > np.iinfo("<u2").max:
        raise ValueError("positions are kept as uint16")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 40
        coder, window = encoder(path), Window(capacity, dtype, pad_id)

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal first
            if (made := window.flush(first)) is not None:
                first += len(made)
                for at in range(0, len(made), 2048):
                    yield made.slice(at, 2048)

        for batch, data, offsets in in_chunks(batches, "text"):
            ids, bounds = with_ends(*coder.encode(data, offsets), end_id)
            window.add(ids, bounds, ids_of(batch, "doc_id").fill_null(int(NO_ID)).to_numpy())
            if window.tokens >= window_tokens:
                yield from out()
        yield from out()

    return docs.select("doc_id", "text").mapInArrow(run, SEQUENCES_DDL)


def write_matrices(packed: DataFrame, path: str) -> None:
    """The rows as Parquet without dictionaries: each column chunk of ``input_ids`` is an id matrix, row after row."""
    packed.write.option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(path)


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sequence, read back from the written matrices."""
    path = shared_path(spark, "id-matrices")
    write_matrices(packed_sequences(read_table(spark, sf_dir, "documents"), default_path("byte_bpe_50k.json")), path)
    return spark.read.schema(SEQUENCES_DDL).parquet(path)
