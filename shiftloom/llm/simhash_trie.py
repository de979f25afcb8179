"""SimHash near-duplicates (op9 and the second stage of the pipeline): a binary trie joined with itself.

Fingerprints are dealt by keys, so that any two within the Hamming budget share one (see ``Tables``), and each
task joins its fingerprints' trie with itself: pairs of trie nodes (intervals of the sorted fingerprints) go down
bit by bit together, add up differing bits and are dropped once these exceed the budget. A task gives out, not
its pairs, but each fingerprint with the least one it is connected to there; components of these are taken over
all tasks. Keys that very many fingerprints share are dealt further by pairs of trie nodes below them.

null text: as empty. Texts without words have fingerprint zero and link like any other. Repeated rows: equal
texts have equal fingerprints. A null doc_id can't be a component's name unless no other is there. Empty
table: no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, ids_of, in_chunks, read_table, write_shared
from .components import components, unite

SEED = 42
LANES = np.array([int.from_bytes(bytes((v >> (7 - i)) & 1 for i in range(8)), "little") for v in range(256)], np.uint64)
POPCOUNT = np.array([bin(v).count("1") for v in range(256)], np.uint8)


def words_joined(raw: bytes) -> bytes:
    """Words in lower case (A-Z) with one space between."""
    raw = raw.lower()
    return b" ".join(raw.split()) if len(raw) < 4 << 20 else re.sub(rb"[\x20\x09-\x0D]+", b" ", raw).strip()


def shingles(raw: bytes, width: int) -> list[bytes]:
    """The text's shingles of ``width`` words, repeats included; with fewer words the whole sequence."""
    text = words_joined(raw)
    if not text:
        return []
    gaps = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    if len(gaps) < width:
        return [text]
    starts, ends = np.concatenate([[0], gaps[: len(gaps) - width + 1] + 1]).tolist(), np.append(gaps[width - 1 :], len(text)).tolist()
    return [text[a:b] for a, b in zip(starts, ends, strict=True)]


def majority_bits(digests: bytes, counts: np.ndarray, width: int) -> np.ndarray:
    """(rows, width) bytes: a bit is 1 where it is set in over half of the row's digests (of ``width`` bytes each)."""
    out = np.zeros((len(counts), width), np.uint8)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    counts = counts[some]
    lanes = LANES[np.frombuffer(digests, np.uint8).reshape(-1, width)]
    # Eight counters of 8 bits in a word hold sums of up to 255 rows.
    runs = -(-counts // 255)
    heads = np.cumsum(runs) - runs
    starts = np.repeat(np.cumsum(counts) - counts, runs) + 255 * (np.arange(runs.sum()) - np.repeat(heads, runs))
    sums = np.add.reduceat(lanes, starts, axis=0).view(np.uint8).reshape(len(starts), width * 8)
    totals = np.add.reduceat(sums, heads, axis=0, dtype=np.int64)
    out[some] = np.packbits(2 * totals > counts[:, None], axis=1)
    return out


def three_word_digests(raw: bytes) -> tuple[bytes, int]:
    got = shingles(raw, 3)
    digest = xxhash.xxh64_digest
    return b"".join([digest(x, SEED) for x in got]), len(got)


def word_set_digests(raw: bytes) -> tuple[bytes, int]:
    got = sorted(set(words_joined(raw).split(b" ")) - {b""})
    digest = xxhash.xxh3_128_digest
    return b"".join([digest(x, SEED) for x in got]), len(got)


def fingerprint_table(docs: DataFrame, features: Callable[[bytes], tuple[bytes, int]], words: int, id_col: str = "doc_id") -> DataFrame:
    """id and w0.. (64-bit words of the fingerprint, as signed longs) of every row."""
    schema = pa.schema([(id_col, pa.int64()), *[(f"w{i}", pa.int64()) for i in range(words)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in in_chunks(batches, "text"):
            raw = data.tobytes()
            got = [features(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            bits = majority_bits(b"".join(x for x, _ in got), np.array([n for _, n in got], np.int64), 8 * words)
            print_ = bits.view(">u8").astype(np.uint64).view(np.int64)
            yield batch_of(schema, ids_of(batch, id_col), *[print_[:, i] for i in range(words)])

    return docs.select(id_col, "text").mapInArrow(run, f"{id_col} long, " + ", ".join(f"w{i} long" for i in range(words)))


@dataclass(frozen=True)
class Tables:
    """How fingerprints are dealt: a key for each of ``masks`` (one integer over all the bits each).

    ``blocks``: budget + 1 disjoint blocks of bits; two fingerprints within the budget agree in one: exact.
    ``sampled``: ``many`` samples of ``size`` bits, for budgets too large for that.
    """

    bits: int
    budget: int
    masks: tuple[int, ...]

    @staticmethod
    def blocks(bits: int, budget: int) -> Tables:
        ends = [bits * k // (budget + 1) for k in range(budget + 2)]
        return Tables(bits, budget, tuple(((1 << (b - a)) - 1) << a for a, b in zip(ends[:-1], ends[1:], strict=True)))

    @staticmethod
    def sampled(bits: int, budget: int, many: int, size: int) -> Tables:
        draw = np.random.default_rng(SEED)
        return Tables(bits, budget, tuple(sum(1 << int(b) for b in draw.choice(bits, size, replace=False)) for _ in range(many)))

    def keys(self, prints: np.ndarray) -> np.ndarray:
        """(rows, tables) of 64-bit keys; an accidental equality only adds pairs that the trie drops."""
        out = np.empty((len(prints), len(self.masks)), np.uint64)
        for t, mask in enumerate(self.masks):
            key = np.full(len(prints), t + 1, np.uint64)
            for w in range(prints.shape[1]):
                key = mix(key ^ (prints[:, w] & np.uint64(mask >> 64 * w & (1 << 64) - 1)))
            out[:, t] = key
        return out


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return POPCOUNT[(a ^ b).view(np.uint8)].reshape(len(a), -1).sum(1, dtype=np.int64)


def trie_join(prints: np.ndarray, pairs: np.ndarray, budget: int, found: Callable[[np.ndarray, np.ndarray], None], leaf: int = 64, most: int = 1 << 17) -> None:
    """Joins tries: ``prints`` (rows, words) sorted within each interval, ``pairs`` (n, 4) of intervals lo, hi, lo, hi
    (the same twice for a self-join). Calls ``found`` with the rows of all pairs within ``budget``, in parts."""
    if not len(pairs):
        return
    bits = 64 * prints.shape[1]
    ones: dict[int, np.ndarray] = {}

    def before(level: int) -> np.ndarray:
        if level not in ones:
            word, bit = divmod(level, 64)
            ones[level] = np.concatenate([[0], np.cumsum((prints[:, word] >> np.uint64(63 - bit)) & np.uint64(1), dtype=np.int64)])
        return ones[level]

    stack = [(0, np.column_stack([pairs, np.zeros(len(pairs), np.int64)]))]
    while stack:
        level, nodes = stack.pop()
        if len(nodes) > most:
            half = len(nodes) // 2
            stack += [(level, nodes[:half]), (level, nodes[half:])]
            continue
        lo, hi, lo2, hi2, diff = nodes.T
        area = (hi - lo) * (hi2 - lo2)
        small = (area <= leaf) | (level == bits)
        for part in split_by(np.flatnonzero(small), area, 1 << 20):
            a, b = expand(lo[part], hi[part], lo2[part], hi2[part])
            keep = a < b
            a, b = a[keep], b[keep]
            near = distance(prints[a], prints[b]) <= budget
            found(a[near], b[near])
        nodes = nodes[~small]
        if not len(nodes):
            continue
        lo, hi, lo2, hi2, diff = nodes.T
        cum = before(level)
        mid, mid2 = hi - (cum[hi] - cum[lo]), hi2 - (cum[hi2] - cum[lo2])
        own = lo == lo2
        crossed = ~own
        parts = [np.column_stack([lo, mid, lo2, mid2, diff]), np.column_stack([mid, hi, mid2, hi2, diff]), np.column_stack([lo, mid, mid2, hi2, diff + 1]), np.column_stack([mid, hi, lo2, mid2, diff + 1])[crossed]]
        nodes = np.concatenate(parts)
        nodes = nodes[(nodes[:, 0] < nodes[:, 1]) & (nodes[:, 2] < nodes[:, 3]) & (nodes[:, 4] <= budget)]
        nodes = nodes[(nodes[:, 0] != nodes[:, 2]) | (nodes[:, 1] - nodes[:, 0] > 1)]
        if len(nodes):
            stack.append((level + 1, nodes))


def split_by(index: np.ndarray, weight: np.ndarray, most: int) -> Iterator[np.ndarray]:
    total = np.cumsum(weight[index])
    at = 0
    while at < len(index):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
        yield index[at:end]
        at = end


def expand(lo: np.ndarray, hi: np.ndarray, lo2: np.ndarray, hi2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows of the intervals."""
    wide = hi2 - lo2
    area = (hi - lo) * wide
    k = np.arange(area.sum()) - np.repeat(np.cumsum(area) - area, area)
    w = np.repeat(wide, area)
    return np.repeat(lo, area) + k // w, np.repeat(lo2, area) + k % w


#: Rows of one key beyond which it is dealt further, and bits of the nodes that it is dealt by.
HOT_ROWS, HOT_BITS = 20_000, 6
#: Rows that a task joins at once, about.
TASK_ROWS = 1 << 20


def linked(nodes: DataFrame, tables: Tables, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Links (a, b) that connect the same nodes as all pairs within the budget do. ``nodes``: node, w0, w1..,
    one row per fingerprint, kept in a table."""
    words = [f"w{i}" for i in range(tables.bits // 64)]
    spark = nodes.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), nodes.count() * len(tables.masks) // TASK_ROWS)
    dealt = pa.schema([("key", pa.int64()), ("side", pa.int8()), ("node", pa.int64()), *[(w, pa.int64()) for w in words]])
    ddl = "key long, side byte, node long, " + ", ".join(f"{w} long" for w in words)

    def prints_of(batch: pa.RecordBatch) -> np.ndarray:
        return np.column_stack([batch.column(batch.schema.get_field_index(w)).to_numpy() for w in words]).view(np.uint64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = tables.keys(prints_of(batch)).view(np.int64)
            for t in range(keys.shape[1]):
                yield batch_of(dealt, keys[:, t], np.zeros(len(batch), np.int8), *[batch.column(batch.schema.get_field_index(c)) for c in ("node", *words)])

    def deal_further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """To every pair of nodes ``bits`` deep below the key that the budget allows. The deeper bits are spread
        over the fingerprint by a fixed draw, so those that the key holds don't matter."""
        for batch in batches:
            prints = prints_of(batch)
            key = batch.column(0).to_numpy().view(np.uint64)
            size = int(batch.column(batch.schema.get_field_index("bits"))[0].as_py()) if len(batch) else 0
            place = np.random.default_rng(7).choice(tables.bits, size, replace=False)
            own = sum(((prints[:, b // 64] >> np.uint64(63 - b % 64)) & np.uint64(1)) << np.uint64(k) for k, b in enumerate(place.tolist()))
            flips = [sum(1 << i for i in c) for n in range(min(size, tables.budget) + 1) for c in combinations(range(size), n)]
            for flip in flips:
                other = own ^ np.uint64(flip)
                side = np.where(own == other, 0, np.where(own < other, 1, 2)).astype(np.int8)
                to = mix(mix(key ^ mix(np.minimum(own, other) + np.uint64(1))) + np.maximum(own, other))
                yield batch_of(dealt, to.view(np.int64), side, *[batch.column(batch.schema.get_field_index(c)) for c in ("node", *words)])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if len(b)]  # a partition: its share of the rows, hot keys dealt out
        if not batches:
            return
        rows = pa.Table.from_batches(batches)
        prints = np.column_stack([rows.column(w).to_numpy() for w in words]).view(np.uint64)
        key, side, node = (rows.column(c).to_numpy() for c in ("key", "side", "node"))
        order = np.lexsort((*[prints[:, w] for w in reversed(range(prints.shape[1]))], side, key))
        prints, key, side, node = prints[order], key[order], side[order], node[order]
        new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (side[1:] != side[:-1])]))
        end = np.append(new[1:], len(key))
        whole = (side[new] == 0) & (end - new > 1)
        pairs = [np.column_stack([new, end, new, end])[whole]]
        crossing = np.flatnonzero((side[new][:-1] == 1) & (side[new][1:] == 2) & (key[new][:-1] == key[new][1:]))
        pairs.append(np.column_stack([new[crossing], end[crossing], new[crossing + 1], end[crossing + 1]]))
        parent = np.arange(len(node))

        def found(a: np.ndarray, b: np.ndarray) -> None:
            nonlocal parent
            parent = unite(parent, a, b)

        trie_join(prints, np.concatenate(pairs), tables.budget, found)
        at = np.flatnonzero(parent != np.arange(len(node)))
        yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(node[parent[at]])], names=["a", "b"])

    rows = nodes.select("node", *words).mapInArrow(deal, ddl)
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows)
    hot = write_shared(sizes.select("key", F.least(F.lit(10), F.ceil(F.log2(F.col("n") / hot_rows)) + HOT_BITS).cast("int").alias("bits")), "hot-keys")
    if hot.isEmpty():
        return rows.repartition(parts, "key").mapInArrow(join, "a long, b long")
    plain = rows.join(hot, "key", "left_anti")
    further = rows.join(hot, "key")
    for size in [r[0] for r in hot.select("bits").distinct().collect()]:  # at most ten values
        plain = plain.unionByName(further.where(F.col("bits") == size).mapInArrow(deal_further, ddl))
    return plain.repartition(parts, "key").mapInArrow(join, "a long, b long")


def op9_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = write_shared(fingerprint_table(read_table(spark, sf_dir, "documents"), three_word_digests, 1), "fingerprints")
    prints = write_shared(docs.groupBy("w0").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    groups = components(linked(prints.select(F.col("w0").alias("node"), "w0"), Tables.blocks(64, 2)))
    rooted = prints.join(groups, F.col("w0") == F.col("node"), "left").select("w0", "least", F.coalesce("root", "w0").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(names, "root").select("w0", "component_id")
    return docs.join(named, "w0").select("doc_id", F.lower(F.lpad(F.hex("w0"), 16, "0")).alias("fingerprint"), "component_id")
