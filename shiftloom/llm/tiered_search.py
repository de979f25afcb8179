"""Ranked lexical search over a tiered index (op11).

Index: one row a document, with its postings (term, c) in a pair of columns for each tier, so that a pass over the high
tiers reads no others. c is the part of a posting's score that depends on the document, (10^9 tf) div (1000 tf + 8 m);
a term's weight w times c is what it adds. Each term's postings are counted by value of c, and its highest go to the
first tier as long as they are no more than ``TIERS[0]``, then to the second, and so on; the last tier holds the rest.
What a term can still add below a tier is known: w times the largest c there (its residual bound).

Search, for all items at once: a pass over the first tier gives each item the tenth-best partial score; it is proven if
that is more than the residual bounds of its terms together, so that no document without a posting in the tier can be
among the ten. Items that aren't proven fall through to a pass over one tier more, at last to all. In one further pass
each document is scored for an item on the tiers that its proof took; where that and the residual bounds of the terms not
met reach the item's tenth-best, the lower tiers are added, and the ten best of these exact scores are the result. So
lower tiers are left out where a bound shows that they don't matter, and nowhere else.

The index holds the terms that the items ask for, with N, L and df over all documents. Items come in blocks of
``BLOCK_BYTES`` of text, measured first, so that their dictionary, weights and bounds may be broadcast; each block has its
own index and passes. No join and no shuffle moves postings: tasks give out ten rows an item.

Terms are told by 64-bit hashes. null or empty text: no terms; such an item has no rows. Ties: by ascending doc_id, a
null doc_id last. Repeated documents each have their rank. Repeated items (same item_id and text) are answered once, rows
of one item_id with different texts each. Fewer than ten documents with a score above 0: all of these. Empty tables: no
rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_shared, ids_of, in_chunks, ragged, read_table, text_col, write_shared
from .words import item_blocks, words_of, words_of_texts

BEST, BLOCK_BYTES = 10, 1 << 20
#: Most postings of a term in the first tier, and in the first two; the third has the rest.
TIERS = (1 << 12, 1 << 16)
#: Values of c, from 0 to a million, are counted in so many steps.
STEPS, SCALE = 64, 10**6
#: Cells of (document, item) and postings held at a time.
CELLS, POSTINGS = 1 << 21, 1 << 18
NO_ID = (1 << 63) - 1
MATCHES_DDL = "item int, doc_id long, score long"


def impact(tf: np.ndarray, n: np.ndarray, many: int, total: int) -> np.ndarray:
    m = 25 + (75 * n * many) // total
    return (10**9 * tf) // (1000 * tf + 8 * m)


@dataclass
class Items:
    """The items of a block: their distinct terms, and which items ask for a term how often."""

    ids: list
    terms: np.ndarray  # sorted hashes
    heads: np.ndarray  # items of term t: heads[t] .. heads[t + 1]
    item: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple]) -> Items:
        _, _, _, hashes, bounds = words_of_texts([t for _, t in rows])
        terms, term = np.unique(hashes, return_inverse=True)
        item = np.repeat(np.arange(len(rows)), np.diff(bounds))
        pair, times = np.unique(term * len(rows) + item, return_counts=True) if len(rows) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return cls([k for k, _ in rows], terms, np.searchsorted(pair // max(1, len(rows)), np.arange(len(terms) + 1)), pair % max(1, len(rows)), times)


def counted(docs: DataFrame, terms: Broadcast) -> DataFrame:
    """doc_id, number of terms, and the asked terms with their counts, of documents that have any term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = terms.value
        for batch, data, offsets in in_chunks(batches, "text"):
            _, _, hashes, bounds = words_of(data, offsets)
            at = np.searchsorted(asked, hashes)
            here = np.flatnonzero(asked[np.minimum(at, len(asked) - 1)] == hashes) if len(asked) else np.zeros(0, np.int64)
            doc = np.repeat(np.arange(len(batch)), np.diff(bounds))
            pair, tf = np.unique(doc[here] * max(1, len(asked)) + at[here], return_counts=True)
            lists = pa.array(np.searchsorted(pair // max(1, len(asked)), np.arange(len(batch) + 1)), pa.int32())
            of = lambda x: pa.ListArray.from_arrays(lists, pa.array(x, pa.int32()))  # noqa: E731, B023
            out = pa.RecordBatch.from_arrays([ids_of(batch, "doc_id"), pa.array(np.diff(bounds), pa.int64()), of(pair % max(1, len(asked))), of(tf)], names=["doc_id", "n", "terms", "counts"])
            yield out.filter(pa.array(np.diff(bounds) > 0))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_col().alias("text")).mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<int>")


def lists_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, sizes) of a list column."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(column.offsets.to_numpy()).astype(np.int64)


def histogram(table: DataFrame, many: int, total: int) -> DataFrame:
    """term, step, number of postings, largest c."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, (term, sizes), (tf, _) = batch.column(0).to_numpy(zero_copy_only=False), lists_of(batch.column(1)), lists_of(batch.column(2))
            c = impact(tf, np.repeat(n, sizes), many, total)
            order = np.argsort(term * (SCALE + 1) + c)
            key = term[order] * STEPS + np.minimum(c[order] * STEPS // SCALE, STEPS - 1)
            heads = np.flatnonzero(np.diff(key, prepend=-1))
            ends = np.append(heads[1:], len(key))[: len(heads)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in ((key[heads] // STEPS, pa.int32()), (key[heads] % STEPS, pa.int32()), (ends - heads, pa.int64()), (c[order][ends - 1], pa.int64()))], names=["term", "step", "n", "top"])

    each = table.select("n", "terms", "counts").mapInArrow(run, "term int, step int, n long, top long")
    return each.groupBy("term", "step").agg(F.sum("n").alias("n"), F.max("top").alias("top"))


@dataclass
class Bounds:
    """Per term: its weight, the least step of c in each tier but the last, and the largest c below it."""

    weight: np.ndarray
    cuts: np.ndarray  # (tier, term)
    rest: np.ndarray  # (tier + 1, term); nothing is below the last tier

    @classmethod
    def of(cls, table: DataFrame, many: int, total: int, terms: int, tiers: tuple[int, ...]) -> Bounds:
        down = Window.partitionBy("term").orderBy(F.desc("step"))
        steps = histogram(table, many, total).withColumn("so_far", F.sum("n").over(down))
        cut = [F.coalesce(F.min(F.when(F.col("so_far") <= size, F.col("step"))), F.lit(STEPS)).alias(f"cut{k}") for k, size in enumerate(tiers)]
        rest = [F.coalesce(F.max(F.when(F.col("so_far") > size, F.col("top"))), F.lit(0)).alias(f"rest{k}") for k, size in enumerate(tiers)]
        rows = steps.groupBy("term").agg(F.sum("n").alias("df"), *cut, *rest).collect()  # as many as a block's terms
        out = cls(np.zeros(terms, np.int64), np.full((len(tiers), terms), STEPS, np.int64), np.zeros((len(tiers) + 1, terms), np.int64))
        for r in rows:
            out.weight[r.term] = math.floor(1000 * math.log((2 * many + 2) / (2 * r.df + 1)))
            for k in range(len(tiers)):
                out.cuts[k, r.term], out.rest[k, r.term] = r[f"cut{k}"], r[f"rest{k}"]
        return out


def indexed(table: DataFrame, bounds: Broadcast, many: int, total: int) -> DataFrame:
    """doc_id and, for each tier, the terms with a posting there and their c."""
    tiers = len(bounds.value.rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = bounds.value.cuts
        for batch in batches:
            n, (term, sizes), (tf, _) = batch.column(1).to_numpy(zero_copy_only=False), lists_of(batch.column(2)), lists_of(batch.column(3))
            c = impact(tf, np.repeat(n, sizes), many, total)
            step = np.minimum(c * STEPS // SCALE, STEPS - 1)
            tier, doc = (step[None, :] < cuts[:, term]).sum(0), np.repeat(np.arange(len(batch)), sizes)
            columns = [batch.column(0)]
            for k in range(tiers):
                here = tier == k
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc[here], minlength=len(batch)))]), pa.int32())
                columns += [pa.ListArray.from_arrays(ends, pa.array(x[here], pa.int32())) for x in (term, c)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *[f"{x}{k}" for k in range(tiers) for x in ("terms", "c")]])

    ddl = ", ".join(["doc_id long", *[f"{x}{k} array<int>" for k in range(tiers) for x in ("terms", "c")]])
    return table.where(F.size("terms") > 0).mapInArrow(run, ddl)


class Best:
    """The best (score, doc_id) of each item so far."""

    def __init__(self, items: int) -> None:
        self.least = np.ones(items, np.int64)
        self.item, self.doc, self.score = np.zeros((3, 0), np.int64)

    def add(self, item: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        item, doc, score = (np.concatenate(x) for x in ((self.item, item), (self.doc, doc), (self.score, score)))
        order = np.lexsort((doc, -score, item))
        item, doc, score = item[order], doc[order], score[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        last = np.flatnonzero(rank == BEST - 1)
        self.least[item[last]] = score[last]
        self.item, self.doc, self.score = (x[rank < BEST] for x in (item, doc, score))

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.item, pa.int32()), pa.array(self.doc, pa.int64()), pa.array(self.score, pa.int64())], names=["item", "doc_id", "score"])


def add_postings(cells: np.ndarray, doc: np.ndarray, term: np.ndarray, value: np.ndarray, items: Items, some: np.ndarray) -> None:
    """Add each posting's ``value`` times how often an item asks for it, to the cells (document, item) of ``some`` items."""
    flat = cells.reshape(-1)
    many = items.heads[term + 1] - items.heads[term]
    total, at = np.concatenate([[0], np.cumsum(many)]), 0
    while at < len(term):
        end = max(at + 1, int(np.searchsorted(total, total[at] + CELLS, side="right")) - 1)
        which = ragged(items.heads[term[at:end]], many[at:end])
        item = items.item[which]
        add = np.repeat(value[at:end], many[at:end]) * items.times[which]
        ok = some[item]
        np.add.at(flat, (np.repeat(doc[at:end], many[at:end]) * cells.shape[1] + item)[ok], add[ok])
        at = end


def postings(batch: pa.RecordBatch, tier: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, c) of a tier."""
    at = batch.schema.get_field_index
    (term, sizes), (c, _) = lists_of(batch.column(at(f"terms{tier}"))), lists_of(batch.column(at(f"c{tier}")))
    return np.repeat(np.arange(len(batch)), sizes), term, c


def in_pieces(batches: Iterator[pa.RecordBatch], items: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    rows = max(1, min(CELLS // max(1, items), 4096))
    for batch in batches:
        for at in range(0, len(batch), rows):
            piece = batch.slice(at, rows)
            yield piece, piece.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def passed(index: DataFrame, items: Broadcast, bounds: Broadcast, tiers: int, open_: np.ndarray) -> DataFrame:
    """The best partial scores on the first ``tiers`` tiers, of each task, for the items that are open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weight = items.value, bounds.value.weight
        best = Best(len(own.ids))
        for piece, ids in in_pieces(batches, len(own.ids)):
            cells = np.zeros((len(piece), len(own.ids)), np.int64)
            for k in range(tiers):
                doc, term, c = postings(piece, k)
                add_postings(cells, doc, term, weight[term] * c, own, open_)
            d, i = np.nonzero(cells >= best.least)
            best.add(i, ids[d], cells[d, i])
        yield best.batch()

    columns = [f"{x}{k}" for k in range(tiers) for x in ("terms", "c")]
    return index.select("doc_id", *columns).mapInArrow(run, MATCHES_DDL)


def finished(index: DataFrame, items: Broadcast, bounds: Broadcast, level: np.ndarray, least: np.ndarray) -> DataFrame:
    """The best exact scores of each task. ``level``: tiers that an item's proof took; ``least``: its tenth-best there."""
    tiers = len(bounds.value.rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, b = items.value, bounds.value
        best = Best(len(own.ids))
        most = np.array([residuals(own, b, k + 1) for k in range(tiers)])[level - 1, np.arange(len(own.ids))]
        for piece, ids in in_pieces(batches, len(own.ids)):
            score, gone = np.zeros((2, len(piece), len(own.ids)), np.int64)
            met = np.zeros_like(score, bool)
            for k in range(tiers):  # what each item's proof took
                some = level > k
                if some.any():
                    doc, term, c = postings(piece, k)
                    add_postings(score, doc, term, b.weight[term] * c, own, some)
                    for t in range(k + 1, tiers + 1):
                        if (of := level == t).any():
                            add_postings(gone, doc, term, b.weight[term] * b.rest[t - 1][term], own, of)
            met = score + most - gone >= np.maximum(least, 1)
            rows = np.flatnonzero(met.any(1))
            place = np.full(len(piece), -1)
            place[rows] = np.arange(len(rows))
            exact = score[rows]
            for k in range(1, tiers):  # and the tiers below, where they may matter
                some = level <= k
                if some.any() and len(rows):
                    doc, term, c = postings(piece, k)
                    of = place[doc] >= 0
                    add_postings(exact, place[doc[of]], term[of], b.weight[term[of]] * c[of], own, some)
            d, i = np.nonzero(met[rows] & (exact >= best.least))
            best.add(i, ids[rows[d]], exact[d, i])
        yield best.batch()

    return index.mapInArrow(run, MATCHES_DDL)


def residuals(items: Items, bounds: Bounds, tiers: int) -> np.ndarray:
    """What an item's terms can add below the first ``tiers`` tiers, together."""
    term = np.repeat(np.arange(len(items.terms)), np.diff(items.heads))
    out = np.zeros(len(items.ids), np.int64)
    np.add.at(out, items.item, items.times * (bounds.weight * bounds.rest[tiers - 1])[term])
    return out


def ranked(matches: DataFrame) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return matches.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= BEST)


def proven(index: DataFrame, items: Broadcast, bounds: Broadcast) -> tuple[np.ndarray, np.ndarray]:
    """How many tiers each item's proof takes, and its tenth-best partial score there."""
    own, tiers = items.value, len(bounds.value.rest)
    level, least = np.full(len(own.ids), tiers), np.zeros(len(own.ids), np.int64)
    open_ = np.ones(len(own.ids), bool)
    for k in range(1, tiers):
        for r in ranked(passed(index, items, bounds, k, open_)).where(F.col("rank") == BEST).collect():  # one row an item
            least[r.item] = max(least[r.item], r.score)
        rest = residuals(own, bounds.value, k)
        done = open_ & ((rest < least) | (rest == 0))
        level[done] = k
        open_ &= ~done
        if not open_.any():
            break
    return level, least


def search(docs: DataFrame, items: DataFrame, tiers: tuple[int, ...] = TIERS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ten best documents (doc_id, text) for each of ``items`` (item_id, text): item_id, rank, doc_id, score."""
    spark, out = docs.sparkSession, None
    for block in item_blocks(items, "item_id", block_bytes):
        own = Items.of(block())
        terms = spark.sparkContext.broadcast(own.terms)
        table = write_shared(counted(docs, terms), "term-counts")
        many, total = table.agg(F.count("n"), F.sum("n")).first()
        ids = spark.createDataFrame([(k, x) for k, x in enumerate(own.ids)], f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        if not many:
            table = ids.where("false").select("item_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
        else:
            bounds = spark.sparkContext.broadcast(Bounds.of(table, many, total, len(own.terms), tiers))
            held = spark.sparkContext.broadcast(own)
            index = write_shared(indexed(table, bounds, many, total), "tiered-index")
            drop_shared(table)
            level, least = proven(index, held, bounds)
            best = ranked(finished(index, held, bounds, level, least)).join(F.broadcast(ids), "item")
            doc_id = F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))
            table = best.select("item_id", F.col("rank").cast("int").alias("rank"), doc_id.alias("doc_id"), "score")
        out = table if out is None else out.unionByName(table)
    return out


def op11_tiered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark").select("item_id", "text"))
