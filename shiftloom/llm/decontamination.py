"""Benchmark decontamination (op12).

The windows of ``WINDOW`` consecutive words of the benchmark items (an item of fewer words is one window) make a hash set
that goes to all workers by broadcast, beside the items' normalised texts. A task hashes the words of a chunk of whole
texts and, from these, every window of each length that occurs in the set; a bitmap sifts them, a search in the sorted
hashes finds the rest, and each hit is verified by comparing its words with the item's, so no hash decides. Words inside
a hit are marked; maximal runs of them are the spans, which ``decontaminated`` cuts out of the texts, or it drops the
documents that have any.

The set is as large as the benchmark, which is measured first: items come in blocks of ``BLOCK_BYTES`` of text, one pass
over the documents each; spans and items found so far stay beside the texts (one block is the usual case; with more the
texts are written between passes). Nothing is shuffled.

null or empty text, of a document or an item: no words, no windows. A null item_id stands as an empty string in the list
of items. Repeated items count once, rows of one item_id with different texts are one item with the windows of all.
Repeated documents are judged one by one. Empty tables: no rows, or nothing contaminated. Other columns of the documents
are kept; the new ones' names give way to them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bloom_lm import mixed
from .common import drop_shared, free_names, in_chunks, read_table, text_col, write_shared
from .words import LOWER, item_blocks, words_of, words_of_texts

WINDOW, BLOCK_BYTES = 10, 16 << 20
STEP = np.uint64(0xA24BAED4963EE407)
#: Bits of the bitmap for each window of the set.
SIEVE = 16
SPAN = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
SPANS_DDL = "array<struct<first:long,last:long,start:long,end:long>>"


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words."""
    out = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size if len(out) else 0):
        out = out * STEP + words[k : k + len(out)]
    return mixed(out + np.uint64(size))


class Windows:
    """The windows of some items, by hash, and their normalised words."""

    def __init__(self, items: list[tuple], window: int) -> None:
        low, starts, ends, hashes, bounds = words_of_texts([t for _, t in items])
        raw = low.tobytes()
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.names, self.words = [], []
        for (name, _), a, b in zip(items, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b == a:
                continue
            size = min(window, b - a)
            keys = window_hashes(hashes[a:b], size)
            found.append((keys, np.full(len(keys), len(self.names)), np.arange(len(keys)), np.full(len(keys), size)))
            self.names.append("" if name is None else str(name))
            self.words.append([raw[s:e] for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)])
        keys, self.item, self.at, self.size = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64), *np.zeros((3, 0), np.int64))
        order = np.argsort(keys, kind="stable")
        keys, self.item, self.at, self.size = keys[order], self.item[order], self.at[order], self.size[order]
        self.keys, heads = np.unique(keys, return_index=True)
        self.bounds = np.append(heads, len(keys))
        self.sizes = np.unique(self.size).tolist()
        self.bits = np.uint64(max(10, int(len(keys) * SIEVE).bit_length()))
        self.sieve = np.zeros(1 << int(self.bits), bool)
        self.sieve[keys >> (np.uint64(64) - self.bits)] = True
        self.known: dict[tuple[int, bytes], frozenset[str]] = {}

    def hits(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(word, window number) of the runs of ``size`` words whose hashes are in the set."""
        keys = window_hashes(hashes, size)
        at = np.flatnonzero(self.sieve[keys >> (np.uint64(64) - self.bits)])
        number = np.searchsorted(self.keys, keys[at])
        same = self.keys[np.minimum(number, len(self.keys) - 1)] == keys[at]
        return at[same], number[same]

    def items_with(self, number: int, words: list[bytes]) -> frozenset[str]:
        """Items that have these very words as a window of this hash."""
        key = (number, b" ".join(words))
        if key not in self.known:
            rows = range(self.bounds[number], self.bounds[number + 1])
            self.known[key] = frozenset(self.names[self.item[r]] for r in rows if self.size[r] == len(words) and self.words[self.item[r]][self.at[r] : self.at[r] + self.size[r]] == words)
        return self.known[key]


def spans_of(data: np.ndarray, offsets: np.ndarray, windows: Windows, before: list[list[dict] | None]) -> tuple[np.ndarray, list[list[dict]], list[set[str]]]:
    """Words of each text, its spans (those found ``before`` among them), and the items found."""
    starts, ends, hashes, bounds = words_of(data, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    cover, items = np.zeros(len(starts) + 1, np.int64), [set() for _ in before]
    low = None
    for size in windows.sizes:
        at, number = windows.hits(hashes, size)
        inside = at + size <= bounds[doc[at] + 1]
        for i, k in zip(at[inside].tolist(), number[inside].tolist(), strict=True):
            low = LOWER[data].tobytes() if low is None else low
            words = [low[a:b] for a, b in zip(starts[i : i + size].tolist(), ends[i : i + size].tolist(), strict=True)]
            if names := windows.items_with(k, words):
                cover[i] += 1
                cover[i + size] -= 1
                items[doc[i]] |= names
    for d, spans in enumerate(before):
        for x in spans or ():
            cover[bounds[d] + x["first"]] += 1
            cover[bounds[d] + x["last"]] -= 1
    hit = np.cumsum(cover[:-1]) > 0
    out: list[list[dict]] = [[] for _ in before]
    some = np.flatnonzero(hit)
    cut = np.diff(some, prepend=-2) != 1
    cut[1:] |= doc[some[1:]] != doc[some[:-1]]
    firsts = some[cut]
    lasts = some[np.append(np.flatnonzero(cut)[1:], len(some)) - 1] if len(some) else some
    for a, b in zip(firsts.tolist(), lasts.tolist(), strict=True):
        d = int(doc[a])
        out[d].append({"first": a - int(bounds[d]), "last": b + 1 - int(bounds[d]), "start": int(starts[a] - offsets[d]), "end": int(ends[b] - offsets[d])})
    return np.diff(bounds), out, items


def scanned(docs: DataFrame, set_: Broadcast, names: list[str], keep: list[str]) -> DataFrame:
    """``docs`` (text and, under ``names``, n_words, spans and items so far) after a pass with one block of windows."""
    n_words, spans, found = names
    out = T.StructType([docs.schema[c] for c in keep] + [docs.schema[c] for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = set_.value
        for batch, data, offsets in in_chunks(batches, "text"):
            of = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731, B023
            n, runs, items = spans_of(data, offsets, windows, of(spans).to_pylist())
            names_ = [sorted({*a, *b}) for a, b in zip(of(found).to_pylist(), items, strict=True)]
            yield pa.RecordBatch.from_arrays([*map(of, keep), pa.array(n, pa.int64()), pa.array(runs, pa.list_(SPAN)), pa.array(names_, pa.list_(pa.string()))], names=[*keep, *names])

    return docs.mapInArrow(run, out)


def matched(docs: DataFrame, items: DataFrame, window: int = WINDOW, keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, list[str]]:
    """``docs`` (all columns, or those in ``keep``) with their number of words, the spans of words in windows of ``items``
    (item_id, text), and the items found; and the names of these three columns."""
    spark, keep = docs.sparkSession, docs.columns if keep is None else keep
    names = free_names(docs, "n_words", "spans", "items")
    n_words, spans, found = names
    out = docs.withColumns({"text": text_col(), n_words: F.lit(0).cast("long"), spans: F.array().cast(SPANS_DDL), found: F.array().cast("array<string>")})
    blocks, former = item_blocks(items, "item_id", block_bytes), None
    for k, block in enumerate(blocks):
        set_ = spark.sparkContext.broadcast(Windows(block(), window))
        last = k + 1 == len(blocks)
        out = scanned(out, set_, names, keep if last else docs.columns)
        if not last:
            out = write_shared(out, "scanned")
            if former is not None:
                drop_shared(former)
            former = out
    return out, names


def cut_out(docs: DataFrame, spans: str) -> DataFrame:
    """``docs`` with the spans' bytes taken out of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in in_chunks(batches, "text"):
            keep = np.ones(len(data), bool)
            for at, runs in zip(offsets[:-1].tolist(), batch.column(batch.schema.get_field_index(spans)).to_pylist(), strict=True):
                for x in runs:
                    keep[at + x["start"] : at + x["end"]] = False
            kept = np.concatenate([[0], np.cumsum(keep)])
            raw, ends = data[keep].tobytes(), kept[offsets].tolist()
            texts = pa.array([raw[a:b].decode() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string())
            i = batch.schema.get_field_index("text")
            yield pa.RecordBatch.from_arrays([texts if k == i else c for k, c in enumerate(batch.columns)], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, drop_documents: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` less the spans that occur in ``items``, or less the documents that have any; columns as they were."""
    out, (_, spans, _) = matched(docs, items, window, block_bytes=block_bytes)
    if drop_documents:
        return out.where(F.size(spans) == 0).select(docs.columns)
    return cut_out(out, spans).select(docs.columns)


def op12_window_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out, (n_words, spans, found) = matched(docs, read_table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    n_hit = F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"])
    digest = F.sha2(F.concat_ws(",", F.array_sort(found)).cast("binary"), 256)
    return out.select("doc_id", F.col(n_words).alias("n_words"), n_hit.alias("n_hit"), F.size(found).cast("long").alias("n_items"), digest.alias("items_sha256"), (F.size(spans) > 0).alias("contaminated"), F.size(spans).cast("long").alias("n_spans"))
