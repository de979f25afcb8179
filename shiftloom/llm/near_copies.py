"""One document of each group of near copies (the second stage of the pipeline), by the SimHash trie.

Two documents are near copies if the sets of their ``WIDTH``-word shingles (lower case A-Z; a text with fewer words is
one shingle) have a Jaccard likeness of ``LIKENESS`` or more. Groups are what such links connect.

Equal texts are one node. A node's fingerprint has 128 bits over its distinct words: texts that share four in five
shingles share nearly all of these, while unrelated ones share only common words. The trie self-join over sampled
tables links fingerprints within ``BUDGET`` bits; what these links connect is a cluster. Within a cluster every pair is
verified on the whole shingle sets, a large cluster by pairs of blocks, and only verified links make groups.

The trie can miss pairs, so a prefix-filter join finds all others: with every set in one order of all shingles, sets of
n shingles that are near copies share one of their first n - ceil(LIKENESS n) + 1. Pairs of different clusters that do
are counted by the shingles they share there, and verified unless sizes, count and places rule the likeness out. The
order has shingles that are common in a sample of the texts last; any order gives the same pairs.

Of each group the row with the least doc_id stays; of rows with that doc_id and equal texts, one. null text: as empty;
empty texts are copies of each other. A null doc_id stays only where a group has no other. Empty table: no rows. Further
columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, in_chunks, text_col, write_shared
from .components import components, unite
from .e8_lattice import by_cell
from .simhash_trie import Tables, expand, linked, majority_bits, shingles, split_by, word_set_digests

WIDTH, LIKENESS = 5, 0.8
BITS, BUDGET, TABLES, SAMPLE = 128, 18, 24, 20
#: Members of a cluster that are compared in one task; columns of the membership matrix at once.
BLOCK, COLUMNS = 1024, 2048
#: One text in so many is looked at for common shingles; how often these occur there at least, and the most of them.
SAMPLED, COMMON, MOST = 16, 4, 1 << 20
#: What rounding may take from a product with the likeness.
SLACK = 1e-6


def common_shingles(docs: DataFrame, width: int) -> np.ndarray:
    """Hashes of the shingles that are common in a sample of the texts, the most common last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in in_chunks(batches, "text"):
            raw = data.tobytes()
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(raw[a:b], width).view(np.int64))], names=["shingle"])

    some = docs.select(text_col().alias("text")).where(F.pmod(F.xxhash64(F.lit(2), "text"), F.lit(SAMPLED)) == 0)
    counted = some.mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON)
    most = counted.orderBy(F.desc("n"), "shingle").limit(MOST).select("shingle").toArrow()
    return most.column(0).combine_chunks().to_numpy()[::-1].view(np.uint64)


def first_shingles(hashes: np.ndarray, row: np.ndarray, rows: int, common: tuple[np.ndarray, np.ndarray], likeness: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash) of the shingles that a near copy of the row must share one of, in the order of all shingles, and the
    size of each row's set. ``common``: sorted hashes and their ranks from 1."""
    rank = np.zeros(len(hashes), np.int64)
    if len(common[0]):
        at = np.minimum(np.searchsorted(common[0], hashes), len(common[0]) - 1)
        rank = np.where(common[0][at] == hashes, common[1][at], 0)
    order = np.lexsort((hashes, rank, row))
    hashes, row = hashes[order], row[order]
    new = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])])[: len(row)])
    hashes, row = hashes[new], row[new]
    size = np.bincount(row, minlength=rows)
    place = np.arange(len(row)) - (np.cumsum(size) - size)[row]
    keep = place < (size - np.ceil(likeness * size - SLACK) + 1)[row]
    return row[keep], hashes[keep], size


def text_nodes(docs: DataFrame, width: int = WIDTH, likeness: float = LIKENESS) -> DataFrame:
    """node, check (hashes of the text), w0, w1, the size of the shingle set, its first shingles and the least doc_id of
    each distinct text."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_col().alias("text"))
    keyed = keyed.select("doc_id", F.xxhash64("text").alias("node"), F.xxhash64(F.lit(1), "text").alias("check"), "text")
    found = common_shingles(docs, width)
    order = np.argsort(found)
    shared = docs.sparkSession.sparkContext.broadcast((found[order], order + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_digest
        for batch, data, offsets in in_chunks(batches, "text"):
            raw = data.tobytes()
            texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            got = [word_set_digests(x) for x in texts]
            print_ = majority_bits(b"".join(x for x, _ in got), np.array([n for _, n in got], np.int64), BITS // 8).view(">u8").astype(np.uint64).view(np.int64)
            parts = [[digest(x, 42) for x in shingles(t, width)] for t in texts]
            row = np.repeat(np.arange(len(texts)), [len(x) for x in parts])
            hashes = np.frombuffer(b"".join(x for part in parts for x in part), ">u8").astype(np.uint64)
            row, hashes, size = first_shingles(hashes, row, len(texts), shared.value, likeness)
            ends = 8 * np.searchsorted(row, np.arange(len(texts) + 1))
            first = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(hashes.tobytes())])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(print_[:, 0]), pa.array(print_[:, 1]), pa.array(size.astype(np.int32)), first], names=["doc_id", "node", "check", "w0", "w1", "size", "shingles"])

    prints = keyed.mapInArrow(run, "doc_id long, node long, check long, w0 long, w1 long, size int, shingles binary")
    return prints.groupBy("node", "check").agg(F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("w0", "w1", "size", "shingles")])


def shingle_set(raw: bytes, width: int) -> np.ndarray:
    digest = xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join([digest(x, 42) for x in shingles(raw, width)]), ">u8").astype(np.uint64))


def like_pairs(sets: list[np.ndarray], block: np.ndarray, likeness: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (of different blocks, if there are two) whose Jaccard likeness is enough; two empty sets are alike."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(n), size)
    all_ = np.concatenate(sets) if n else np.zeros(0)
    kinds, code, count = np.unique(all_, return_inverse=True, return_counts=True)
    shared = count[code] > 1
    row, code = row[shared], (np.cumsum(count > 1) - 1)[code[shared]]
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    common = np.zeros((n, n), np.float32)
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, COLUMNS):
        a, b = np.searchsorted(code, [at, at + COLUMNS])
        member = np.zeros((n, COLUMNS), np.float32)
        member[row[a:b], code[a:b] - at] = 1
        common += member @ member.T
    union = size[:, None] + size[None, :] - common
    alike = np.triu((common >= likeness * union) if n else common > 0, 1)
    if n and block.min() != block.max():
        alike &= block[:, None] != block[None, :]
    yield np.nonzero(alike)


def other_pairs(nodes: DataFrame, clusters: DataFrame, likeness: float) -> DataFrame:
    """Pairs (a, b) of texts of different clusters whose first shingles leave a likeness of ``likeness`` possible."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 1024) for whole in batches for at in range(0, len(whole), 1024)):
            first = batch.column(3).to_pylist()
            n = np.array([len(x) // 8 for x in first])
            take = pa.array(np.repeat(np.arange(len(batch)), n))
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(first), np.int64)), *[c.take(take) for c in batch.columns[:3]], pa.array(place.astype(np.int32))], names=["key", "node", "root", "size", "place"])

    def meet(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key, _, root, node, size, place = (rows.column(i).to_numpy() for i in range(6))
        order = np.lexsort((root, key))
        key, root, node, size, place = (x[order] for x in (key, root, node, size, place))
        last = key[1:] != key[:-1]
        ends = lambda new: np.repeat(at := np.append(np.flatnonzero(new) + 1, len(key)), np.diff(at, prepend=0))
        start, stop = ends(last | (root[1:] != root[:-1])), ends(last)
        # Each row with those of the clusters after its own.
        for some in split_by(np.flatnonzero(start < stop), stop - start, 1 << 20):
            a, b = expand(some, some + 1, start[some], stop[some])
            fit = np.minimum(size[a], size[b]) >= likeness * np.maximum(size[a], size[b]) - SLACK
            a, b = a[fit], b[fit]
            a, b = np.where(node[a] < node[b], a, b), np.where(node[a] < node[b], b, a)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node[a], node[b], size[a], size[b], place[a], place[b])], names=["a", "b", "size_a", "size_b", "place_a", "place_b"])

    rows = nodes.where("size > 0").select("node", "size", "shingles").join(clusters, "node", "left")
    dealt = rows.select("node", "root", "size", "shingles").mapInArrow(deal, "key long, node long, root long, size int, place int")
    ordered = dealt.repartition(parts, "key").sortWithinPartitions("key").select("key", F.lit(0).alias("part"), F.coalesce("root", "node").alias("root"), "node", "size", "place")
    met = ordered.mapInArrow(lambda batches: by_cell(batches, meet), "a long, b long, size_a int, size_b int, place_a int, place_b int")
    pairs = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), *[F.max(c).alias(c) for c in ("size_a", "size_b", "place_a", "place_b")])
    # What is shared besides lies beyond the first shingles of one set, and in both beyond the last that is shared there.
    beyond = F.greatest(*[F.ceil(likeness * F.col(c) - SLACK) - 1 for c in ("size_a", "size_b")])
    after = F.least(F.expr("size_a - place_a - 1"), F.expr("size_b - place_b - 1"))
    enough = F.ceil(likeness / (1 + likeness) * F.expr("size_a + size_b") - SLACK)
    return pairs.where(F.col("n") + F.least(beyond, after) >= enough).select("a", "b")


def verified(docs: DataFrame, nodes: DataFrame, clusters: DataFrame, width: int, likeness: float) -> DataFrame:
    """Links (a, b) that connect what the cluster's pairs of near copies connect."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = clusters.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    member = clusters.join(sizes, "root").join(nodes.select("node", "least"), "node").withColumn("block", F.pmod(F.xxhash64("node", "root"), F.col("blocks")).cast("int"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_col().alias("text")).withColumn("node", F.xxhash64("text"))
    rows = texts.join(member.hint("shuffle_hash"), "node").where(F.col("doc_id").eqNullSafe(F.col("least")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("pair", F.least("block", "other") * F.col("blocks") + F.greatest("block", "other")).select("root", "pair", "block", "node", "text")

    def compare(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key = np.column_stack([rows.column(i).to_numpy() for i in (0, 1)])
        ends = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1), [True]]))
        block, node, texts = rows.column(2).to_numpy(), rows.column(3).to_numpy(), rows.column(4)
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            own, first = np.unique(node[a:b], return_index=True)
            if len(own) < 2:
                continue
            sets = [shingle_set(texts[a + int(i)].as_py().encode(), width) for i in first]
            parent = np.arange(len(own))
            for i, j in like_pairs(sets, block[a:b][first], likeness):
                parent = unite(parent, i, j)
            at = np.flatnonzero(parent != np.arange(len(own)))
            yield pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(own[parent[at]])], names=["a", "b"])

    ordered = rows.repartition(parts, "root", "pair").sortWithinPartitions("root", "pair")
    return ordered.mapInArrow(lambda batches: by_cell(batches, compare, 512), "a long, b long")


def without_near_copies(docs: DataFrame, width: int = WIDTH, likeness: float = LIKENESS) -> DataFrame:
    """``docs`` with one row of each group of near copies."""
    nodes = write_shared(text_nodes(docs, width, likeness), "text-nodes")
    near = linked(nodes.select("node", "w0", "w1"), Tables.sampled(BITS, BUDGET, TABLES, SAMPLE))
    clusters = write_shared(components(near), "clusters")
    # A pair is verified as a cluster of its own.
    pairs = write_shared(other_pairs(nodes, clusters, likeness), "other-pairs")
    both = clusters.select("node", "root").unionByName(pairs.select(F.explode(F.array("a", "b")).alias("node"), F.xxhash64("a", "b").alias("root")))
    groups = components(verified(docs, nodes, both, width, likeness))
    rooted = nodes.join(groups, "node", "left").select("node", "check", "least", F.coalesce("root", "node").alias("root"))
    # The least row of each group, by doc_id, then by node where doc_ids are equal or null.
    rank = F.struct(F.col("least").isNull().alias("no_id"), "least", "node", "check")
    stay = write_shared(rooted.groupBy("root").agg(F.min(rank).alias("r")).select("r.node", "r.check", "r.least"), "staying")
    node, check = free_names(docs, "node", "check")
    keyed = docs.withColumn(node, F.xxhash64(text_col())).withColumn(check, F.xxhash64(F.lit(1), text_col())).alias("d")
    same = F.expr(f"d.{node} = s.node AND d.{check} = s.check AND d.doc_id <=> s.least")
    kept = keyed.join(stay.alias("s").hint("shuffle_hash"), same, "left_semi").alias("d")
    # Rows that repeat both doc_id and text: one stays. As a rule there are none.
    ids = docs.select(F.col("doc_id").alias("id"), F.xxhash64(text_col()).alias("hash"))
    repeated = write_shared(ids.groupBy("id", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", "hash"), "repeated-rows")
    if repeated.isEmpty():
        return kept.select(*[F.col(f"d.`{c}`") for c in docs.columns])
    match = F.expr(f"d.doc_id <=> r.id AND d.{node} = r.hash")
    single = kept.join(repeated.alias("r"), match, "left_anti")
    one = kept.join(repeated.alias("r"), match, "left_semi").dropDuplicates([node, check])
    return single.unionByName(one).select(*[F.col(f"`{c}`") for c in docs.columns])
