"""Language-model scores from a log-frequency Bloom filter (op3).

Counting: tasks sum words and word pairs of the training texts over about ``PRESUM_TOKENS`` tokens at a time and send
them to the slice of their hash, of which there are as many as the corpus is large. A slice adds the counts up,
quantises them on a logarithmic scale (``LEVELS``: exact at first, then steps of a quarter), and puts an n-gram of
level q into its Bloom filter q times, as (n-gram, 1) .. (n-gram, q). The filter is blocked: a probe is one 64-bit
word in which ``PROBE_BITS`` bits must be set. With a vocabulary of V words a slice takes so many probes that fewer
than ``FALSE_MASS`` times ``MU`` of V pairs that aren't there are hit; that is 10 bits a probe for each entry.

Scoring: texts are gathered to chunks, and each chunk's distinct n-grams are dealt by segments of the filter (neighbouring
slices, about ``PART_BYTES``). A segment meets what it is asked for in one task, which holds no other segment by then, so
that neither the driver nor a worker ever has the filter. The levels come back to their chunks in
one join. So a text is read three times and an n-gram once, however many segments there are. A level is found by
membership probes of (n-gram, 1), (n-gram, 2), (n-gram, 4) .. until one is missing, and then of those between. Then

    p(w | h) = (c(h w) + MU p(w)) / (t(h) + f + MU),   p(w) = (c(w) + 0.5) / (t + 0.5 (V + 1))

with c(h w) the middle of a level's counts, t(h) the sum of these over all words after h, t that of c(w), and f the
false hits in V probes, from the filter's bits: so both sum to 1 over the vocabulary and one unknown word.
t(h) is the count of h and what quantising added, which slices give out only for pairs that it changed. The score is the sum of log10 p over all words and the end.

``base_score`` and ``n_known`` are exact. Words in a broadcast dictionary (all from a count on, the least that leaves
no more than ``DICTIONARY`` words) are looked up there, with their t; the others meet theirs in a join.

Words are compared by 64-bit hashes. null text: as empty (the end alone). A null doc_id is a training row.
Repeated rows: each is scored, and counted, for itself. Empty table: no rows. No training rows: N = 0, and p(w) is
0.5 / (0.5 (V + 1)) = 1. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, buffers, drop_shared, give_back, in_chunks, in_small_steps, read_table, text_col, texts_of, write_shared
from .words import NOT_SPACE, mixed, words_of

PRESUM_TOKENS, SLICE_BYTES = 1_000_000, 8 << 20
PROBE_BITS, WORD_BITS, DICTIONARY, MU = 5, 10, 1 << 20, 500.0
#: Share of the filter's words that hold all bits of a probe by chance, about; what false hits may come to, in ``MU``.
FALSE, FALSE_MASS = 0.015, 0.025
#: Bytes of a segment of the filter, which a task holds at once.
PART_BYTES = 4 << 20


def level_starts() -> np.ndarray:
    """Least count of each level: 1, 2, 3, 4, 5, 7, 9, 12, .."""
    starts = [1]
    while starts[-1] < 1 << 50:
        starts.append(max(starts[-1] + 1, -(-starts[-1] * 5 // 4)))
    return np.array(starts, np.int64)


LEVELS = level_starts()
#: Count that a level stands for; none: 0.
MIDDLES = np.concatenate([[0.0], (LEVELS[:-1] + LEVELS[1:] - 1) / 2, [float(LEVELS[-1])]])
START, END = np.uint64(0x51A7_0000_0000_0001), np.uint64(xxhash.xxh64_intdigest(b"", 42))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all tokens, each text's end among them; offsets by text)."""
    _, _, hashes, bounds = words_of(data, offsets, NOT_SPACE)
    texts = np.arange(len(offsets) - 1)
    out = np.full(len(hashes) + len(texts), END)
    out[np.arange(len(hashes)) + np.repeat(texts, np.diff(bounds))] = hashes
    return out, bounds + np.arange(len(offsets))


def histories(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    out = np.empty_like(words)
    out[1:] = words[:-1]
    out[bounds[:-1]] = START
    return out


def pair_keys(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mixed(mixed(before) * np.uint64(3) + words)


def slice_of(keys: np.ndarray, slices: int) -> np.ndarray:
    """Number of each key's slice, of ``slices`` (a power of two)."""
    return (mixed(keys) >> np.uint64(44)).astype(np.int64) & (slices - 1)


def slices_for(texts: DataFrame) -> int:
    """Slices of the filter: one for each ``SLICE_BYTES`` of text or so."""
    size = texts.agg(F.sum(F.octet_length(text_col()))).first()[0] or 0
    return 1 << min(20, max(4, int(size // SLICE_BYTES).bit_length()))


COUNTS = pa.schema([("slice", pa.int32()), ("pair", pa.bool_()), ("keys", pa.binary()), ("before", pa.binary()), ("counts", pa.binary())])
COUNTS_DDL = "slice int, pair boolean, keys binary, before binary, counts binary"
BLOCKS = pa.schema([("slice", pa.int32()), ("probes", pa.int32()), ("false", pa.float64()), ("filter", pa.binary()), ("keys", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("histories", pa.list_(pa.int64())), ("surplus", pa.list_(pa.float64()))])
BLOCKS_DDL = "slice int, probes int, false double, filter binary, keys array<long>, counts array<long>, histories array<long>, surplus array<double>"


def probe_places(keys: np.ndarray, level: np.ndarray, probe: int, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word within the slice, bits that must be set there) of a probe."""
    h = mixed(keys + level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(probe * 0x5851F42D4C957F2D % (1 << 64)))
    bits = np.zeros(len(h), np.uint64)
    for k in range(PROBE_BITS):
        bits |= np.uint64(1) << ((h >> np.uint64(6 * k)) & np.uint64(63))
    return ((h >> np.uint64(32)) * words >> np.uint64(32)).astype(np.int64), bits


def probes_for(vocabulary: float, mu: float) -> int:
    """Probes after which false hits among ``vocabulary`` words are fewer than ``FALSE_MASS`` times ``mu``."""
    return max(1, int(np.ceil(np.log(max(1.0, vocabulary) / (FALSE_MASS * mu)) / -np.log(FALSE))))


def false_rate(filter_: bytes, probes: int) -> float:
    """Share of n-grams that the filter holds by chance."""
    full = np.bitwise_count(np.frombuffer(filter_, np.uint64)) / 64.0
    return float((full**PROBE_BITS).mean() ** probes)


def built(keys: np.ndarray, counts: np.ndarray, probes: int) -> bytes:
    """The Bloom filter of a slice's n-grams."""
    level = np.searchsorted(LEVELS, counts, side="right")
    words = max(8, -(-int(level.sum()) * WORD_BITS * probes // 64))
    out = np.zeros(words, np.uint64)
    q = 1
    while len(keys):
        for i in range(probes):
            at, bits = probe_places(keys, np.full(len(keys), q), i, np.uint64(words))
            np.bitwise_or.at(out, at, bits)
        more = level > q
        keys, level, q = keys[more], level[more], q + 1
    return out.tobytes()


def count_ngrams(training: DataFrame, parts: int, slices: int, mu: float = MU) -> DataFrame:
    """Per slice its filter, the exact counts of its words, and what quantising its pairs added to their histories."""

    def packed_rows(pair: bool, keys: list[np.ndarray], before: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, at, n = np.unique(np.concatenate(keys), return_index=True, return_counts=True)
        first = np.concatenate(before)[at] if pair else np.zeros(0, np.uint64)
        to = slice_of(key, slices)
        order = np.argsort(to, kind="stable")
        key, n, to, first = key[order], n[order], to[order], first[order] if pair else first
        heads = np.flatnonzero(np.diff(to, prepend=-1))
        ends = np.append(heads[1:], len(key))
        for k in range(0, len(heads), 64):
            cut = list(zip(heads[k : k + 64].tolist(), ends[k : k + 64].tolist(), strict=True))
            of = lambda x: [x[a:b].tobytes() for a, b in cut]  # noqa: E731, B023
            yield batch_of(COUNTS, to[heads[k : k + 64]], [pair] * len(cut), of(key), of(first), of(n.astype(np.int64)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[np.ndarray] = []
        pairs: list[np.ndarray] = []
        before: list[np.ndarray] = []
        size = 0
        for _, data, offsets in in_chunks(batches, "text", CHUNK):
            got, bounds = tokens(data, offsets)
            words.append(got)
            before.append(histories(got, bounds))
            pairs.append(pair_keys(before[-1], got))
            size += len(got)
            if size >= PRESUM_TOKENS:
                yield from packed_rows(False, words, [])
                yield from packed_rows(True, pairs, before)
                words, pairs, before, size = [], [], [], 0
                give_back()
        if words:
            yield from packed_rows(False, words, [])
            yield from packed_rows(True, pairs, before)
        del words, pairs, before
        give_back()

    def summed(rows: list[tuple[pa.Scalar, pa.Scalar, pa.Scalar]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        of = lambda x, kind: np.concatenate([np.zeros(0, kind), *[np.frombuffer(y.as_buffer(), kind) for y in x]])
        key, before, n = (of([row[k] for row in rows], kind) for k, kind in enumerate((np.uint64, np.uint64, np.int64)))
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
        return key[head], before[order][head] if len(before) else before, np.add.reduceat(n, head) if len(head) else n

    def block(number: int, rows: dict[bool, list]) -> pa.RecordBatch:
        word, _, n = summed(rows[False])
        pair, before, m = summed(rows[True])
        # Slices are alike, so this one's words tell the vocabulary.
        probes = probes_for(len(word) * slices, mu)
        keys, counts = np.concatenate([word, pair]), np.concatenate([n, m])
        more = MIDDLES[np.searchsorted(LEVELS, m, side="right")] - m
        some = more != 0
        history, which = np.unique(before[some], return_inverse=True)
        surplus = np.bincount(which, more[some], len(history))
        made = built(keys, counts, probes)
        return batch_of(BLOCKS, [number], [probes], [false_rate(made, probes)], [made], *[[x] for x in (word.view(np.int64), n, history.view(np.int64), surplus)])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, {False: [], True: []}  # one slice at a time
        for batch in batches:
            for i, (number, pair) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if number != now:
                    if now is not None:
                        yield block(now, rows)
                        rows.clear()
                        give_back()
                    now, rows = number, {False: [], True: []}
                rows[pair].append(tuple(batch.column(k)[i] for k in (2, 3, 4)))
        if now is not None:
            yield block(now, rows)

    counted = training.select("text").mapInArrow(count, COUNTS_DDL)
    return counted.repartition(min(parts, slices), "slice").sortWithinPartitions("slice").mapInArrow(build, BLOCKS_DDL)


class Filter:
    """Neighbouring slices of the filter: ``words`` 64-bit words each, from ``start`` on."""

    def __init__(self, slices: int, sizes: list[tuple[int, int, int]]) -> None:
        """Room for slices (number, probes, bytes), to be filled by ``put``."""
        self.slices, self.first = slices, sizes[0][0]
        self.raw = np.zeros(sum(n for _, _, n in sizes) // 8, np.uint64)
        self.words, self.start, self.probes = np.zeros((3, sizes[-1][0] - self.first + 1), np.int64)
        at = 0
        for number, probes, n in sizes:
            self.words[number - self.first], self.start[number - self.first], self.probes[number - self.first] = n // 8, at, probes
            at += n // 8

    def put(self, number: int, data: bytes) -> None:
        at = self.start[number - self.first]
        self.raw[at : at + len(data) // 8] = np.frombuffer(data, np.uint64)

    def has(self, keys: np.ndarray, level: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Membership of (n-gram, level): every probe of its slice finds its bits."""
        here = np.arange(len(keys))
        for i in range(int(self.probes.max(initial=0))):
            at = where[here]
            place, bits = probe_places(keys[here], level[here], i, self.words[at].astype(np.uint64))
            here = here[(self.raw[self.start[at] + place] & bits == bits) | (self.probes[at] <= i)]
        out = np.zeros(len(keys), bool)
        out[here] = True
        return out

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Level of each n-gram by repeated probes; 0 outside these slices."""
        where = slice_of(keys, self.slices) - self.first
        low, high = np.zeros(len(keys), np.int64), np.ones(len(keys), np.int64)
        at = np.flatnonzero((where >= 0) & (where < len(self.words)))
        at, q = at[self.words[where[at]] > 0], 1
        while len(at):
            found = self.has(keys[at], np.full(len(at), q), where[at])
            high[at[~found]] = q
            at = at[found]
            low[at], high[at] = q, 2 * q
            q *= 2
        while len(at := np.flatnonzero(high - low > 1)):
            mid = (low[at] + high[at]) // 2
            found = self.has(keys[at], mid, where[at])
            low[at[found]], high[at[~found]] = mid[found], mid[~found]
        return low.astype(np.uint8)


def levels_in(parts: list[Filter], keys: np.ndarray) -> np.ndarray:
    """Level of each n-gram in a filter that comes in parts."""
    out = np.zeros(len(keys), np.uint8)
    if parts:
        part = np.searchsorted([p.first for p in parts], slice_of(keys, parts[0].slices), side="right") - 1
        order = np.argsort(part, kind="stable")
        bounds = np.searchsorted(part[order], np.arange(len(parts) + 1))
        for p, a, b in zip(parts, bounds[:-1], bounds[1:], strict=True):
            out[order[a:b]] = p.levels(keys[order[a:b]])
    return out


def packed(counts: DataFrame, many: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, counts, sums t) of a table (key, c, t) of ``many`` rows, sorted by key; it comes as a few binary rows, one
    at a time."""
    schema = pa.schema([(c, pa.binary()) for c in ("keys", "counts", "sums")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch_of(schema, *[[c.to_numpy().tobytes()] for c in batch.columns])

    out = np.zeros(many, np.int64), np.zeros(many, np.int64), np.zeros(many)
    at = 0
    for row in counts.select("key", "c", "t").orderBy("key").mapInArrow(run, "keys binary, counts binary, sums binary").toLocalIterator():
        n = len(row[0]) // 8
        for whole, part in zip(out, row, strict=True):
            whole[at : at + n] = np.frombuffer(part, whole.dtype)
        at += n
    return out


def segments(slices: list[tuple[int, int, int]], most: int) -> list[list[tuple[int, int, int]]]:
    """The slices (number, probes, bytes) in parts of at most ``most`` bytes."""
    out: list[list[tuple[int, int, int]]] = []
    size = most + 1
    for each in sorted(slices):
        if size + each[2] > most or not out:
            out.append([])
            size = 0
        out[-1].append(each)
        size += each[2]
    return out


@dataclass
class Model:
    """What training leaves: tables of blocks (filter by slice) and of words (key, count c, sum t of what follows), the
    dictionary (arrays by key), the count from which words are in it, N, V, the sums t of all words and of the start, and f."""

    blocks: DataFrame
    words: DataFrame
    slices: int
    common: tuple[np.ndarray, np.ndarray, np.ndarray] | None
    top: int | None
    n_train: int
    vocabulary: int
    total: float
    start: float
    false: float


def train(training: DataFrame, mu: float = MU, dictionary: int = DICTIONARY) -> Model:
    parts = int(training.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = slices_for(training)
    with in_small_steps(training.sparkSession):
        blocks = write_shared(count_ngrams(training, parts, slices, mu), "ngrams")
    counts = blocks.select(F.explode(F.arrays_zip("keys", "counts")).alias("w")).select(F.col("w.keys").alias("key"), F.col("w.counts").alias("c"))
    surplus = blocks.select(F.explode(F.arrays_zip("histories", "surplus")).alias("w")).select(F.col("w.histories").alias("key"), F.col("w.surplus").alias("s")).groupBy("key").agg(F.sum("s").alias("s"))
    with in_small_steps(training.sparkSession):
        words = write_shared(counts.join(surplus, "key", "full").select("key", F.coalesce("c", F.lit(0)).alias("c"), (F.coalesce("c", F.lit(0)) + F.coalesce("s", F.lit(0.0))).alias("t")), "words")
    ends = {r["key"]: r for r in words.where(F.col("key").isin(int(START.view(np.int64)), int(END.view(np.int64)))).collect()}
    texts = ends.get(int(END.view(np.int64)))
    start = (texts["c"] if texts else 0) + (ends[int(START.view(np.int64))]["t"] if int(START.view(np.int64)) in ends else 0.0)
    words = words.where("c > 0")  # the start alone is no word
    by_count = words.groupBy("c").agg(F.count(F.lit(1)).alias("v"))
    sums = by_count.agg(F.coalesce(F.sum(F.col("c") * F.col("v")), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    # Distinct counts at the top: the dictionary starts at the count that keeps it within its bound.
    top, room = None, dictionary
    for c, v in ((r[0], r[1]) for r in by_count.orderBy(F.desc("c")).limit(dictionary).toLocalIterator()):
        if v > room:
            break
        top, room = c, room - v

    def middles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, v = (x.to_numpy() for x in batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array([float((MIDDLES[np.searchsorted(LEVELS, c, side="right")] * v).sum())])], names=["t"])

    rare = by_count.where(F.col("c") < top) if top is not None else by_count
    common = by_count.where(F.col("c") >= top).agg(F.sum(F.col("c") * F.col("v"))).first()[0] if top is not None else 0
    total = float(common or 0) + (rare.select("c", "v").mapInArrow(middles, "t double").agg(F.sum("t")).first()[0] or 0.0)
    none = np.zeros(0, np.int64)
    held = packed(words.where(F.col("c") >= top), dictionary - room) if top is not None else (none, none, none.astype(np.float64))
    false = blocks.agg(F.avg("false")).first()[0] or 0.0
    return Model(blocks, words, slices, held, top, int(sums[0]), int(sums[1]), total, float(start), int(sums[1]) * false)


def known(words: np.ndarray, common: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether each word is in the dictionary, its count, its sum t)."""
    keys, counts, sums = common
    if not len(keys):
        return np.zeros(len(words), bool), np.zeros(len(words), np.int64), np.zeros(len(words))
    at = np.minimum(np.searchsorted(keys, words.view(np.int64)), len(keys) - 1)
    hit = keys[at] == words.view(np.int64)
    return hit, np.where(hit, counts[at], 0), np.where(hit, sums[at], 0.0)


SCORED_DDL = "doc_id long, held_out boolean, row long, n_tokens long, n_known long, base_score double, score double, rare array<long>, rare_n array<long>"
SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("row", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(pa.int64())), ("rare_n", pa.list_(pa.int64()))])
CHUNKS = pa.schema([("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("texts", pa.list_(pa.string()))])
CHUNKS_DDL = "chunk long, doc_ids array<long>, held array<boolean>, texts array<string>"
ASKED, ASKED_DDL = pa.schema([("chunk", pa.int64()), ("segment", pa.int32()), ("keys", pa.binary())]), "chunk long, segment int, keys binary"
ANSWERED, ANSWERED_DDL = pa.schema([("chunk", pa.int64()), ("segment", pa.int32()), ("levels", pa.binary())]), "chunk long, segment int, levels binary"
#: Bytes of text that are scored at once.
CHUNK = 2 << 20


class Chunk:
    """Tokens of some texts, and what of them the filter is asked for."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, common: tuple[np.ndarray, np.ndarray, np.ndarray], slices: int) -> None:
        self.word, self.bounds = tokens(data, offsets)
        self.distinct, self.which = np.unique(self.word, return_inverse=True)
        self.hit, self.exact, self.sums = known(self.distinct, common)
        pairs, self.pair = np.unique(pair_keys(histories(self.word, self.bounds), self.word), return_inverse=True)
        keys = np.concatenate([self.distinct[~self.hit], pairs])
        where = slice_of(keys, slices)
        self.order = np.lexsort((keys, where))
        self.keys, self.where = keys[self.order], where[self.order]

    def scored(self, ids: pa.Array, held_out: pa.Array, first: int, found: np.ndarray, start: float, more: float, mu: float, divisor: float, of_model: float) -> pa.RecordBatch:
        """A row for each text, from the levels of ``keys``. ``more``: what is added to each t."""
        level = np.empty(len(found), np.uint8)
        level[self.order] = found
        words = int((~self.hit).sum())
        own = self.exact.astype(np.float64)
        own[~self.hit] = MIDDLES[level[:words]]
        hit, bounds = self.hit[self.which], self.bounds
        # Divisors of words outside the dictionary come with the join, as many as the word is there.
        after = np.where(self.hit, np.log10(self.sums + more), 0.0)[self.which]
        ahead = np.concatenate([[0.0], after[:-1]])
        ahead[bounds[:-1]] = np.log10(start + more)
        logs = np.log10(MIDDLES[level[words:]][self.pair] + (mu * (own + 0.5) / of_model)[self.which]) - ahead
        base = np.where(self.hit, np.log10((self.exact + 0.5) / divisor), 0.0)[self.which]
        many = len(bounds) - 1
        text = np.repeat(np.arange(many), np.diff(bounds))
        rare = np.flatnonzero(~hit)
        pair, n = np.unique(np.column_stack([text[rare], self.which[rare]]), axis=0, return_counts=True) if len(rare) else (np.zeros((0, 2), np.int64), np.zeros(0, np.int64))
        lists = pa.array(np.searchsorted(pair[:, 0], np.arange(many + 1)), pa.int32())
        return batch_of(
            SCORED,
            ids,
            held_out,
            first + np.arange(many),
            np.diff(bounds),
            np.add.reduceat(hit.astype(np.int64), bounds[:-1]),
            np.add.reduceat(base, bounds[:-1]),
            np.add.reduceat(logs, bounds[:-1]),
            pa.ListArray.from_arrays(lists, pa.array(self.distinct[pair[:, 1]].view(np.int64))),
            pa.ListArray.from_arrays(lists, pa.array(n, pa.int64())),
        )


def score_texts(docs: DataFrame, held_out, mu: float = MU, broadcast_bytes: int = PART_BYTES, dictionary: int = DICTIONARY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``; ``held_out`` is a
    boolean column, true for the rows that aren't learnt from."""
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    model = train(rows.where(~F.col("held_out")), mu, dictionary)
    blocks, words, slices, top, n_train, more = model.blocks, model.words, model.slices, model.top, model.n_train, model.false + mu
    held, model.common = sc.broadcast(model.common), None  # the driver needs it no more
    sizes = [(r[0], r[1], r[2]) for r in blocks.select("slice", "probes", F.octet_length("filter")).collect()]  # a row per slice
    divisor = n_train + 0.5 * (model.vocabulary + 1)
    numbers = (model.start, more, mu, divisor, model.total + 0.5 * (model.vocabulary + 1))

    def first_number() -> int:
        from pyspark import TaskContext

        return TaskContext.get().partitionId() << 40

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = first_number()
        for batch, _, _ in in_chunks(batches, "text", CHUNK):
            lists = [pa.ListArray.from_arrays(pa.array([0, len(batch)], pa.int32()), batch.column(i)) for i in range(3)]
            yield batch_of(CHUNKS, [number], *[x.cast(f.type) for x, f in zip(lists, list(CHUNKS)[1:], strict=True)])
            number += len(batch)

    def chunks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for i in range(len(batch)):
                number, ids, out, texts, *found = (batch.column(k)[i] for k in range(batch.num_columns))
                yield Chunk(*buffers(texts_of(texts.values)), held.value, slices), number.as_py(), ids.values, out.values, *found

    todo = segments(sizes, broadcast_bytes)
    firsts = [part[0][0] for part in todo[1:]]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, number, *_ in chunks_of(batches):
            segment = np.searchsorted(firsts, chunk.where, side="right")
            heads = np.flatnonzero(np.diff(segment, prepend=-1))
            ends = np.append(heads[1:], len(segment))[: len(heads)]
            yield batch_of(ASKED, [number] * len(heads), segment[heads], [chunk.keys[a:b].tobytes() for a, b in zip(heads, ends, strict=True)])
            del chunk, segment
        give_back()

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks_, held = None, [], None  # a segment's slices come before what it is asked for
        for batch in batches:
            chunk, segment, number, probes = (batch.column(k).to_pylist() for k in range(4))
            begin, answers = 0, []
            while begin < len(batch):
                if segment[begin] != now:
                    now, blocks_, held = segment[begin], [], None
                if chunk[begin] is None:
                    blocks_.append((number[begin], probes[begin], batch.column(4)[begin].as_buffer().to_pybytes()))
                    begin += 1
                    continue
                end = begin
                while end < len(batch) and segment[end] == now:
                    end += 1
                if held is None:
                    held = Filter(slices, sorted((k, p, len(x)) for k, p, x in blocks_))
                    for k, _, x in blocks_:
                        held.put(k, x)
                    blocks_ = []
                keys = [np.frombuffer(batch.column(4)[k].as_buffer(), np.uint64) for k in range(begin, end)]
                levels, ends = levels_in([held], np.concatenate(keys)), np.cumsum([len(x) for x in keys])
                answers += [levels[b - len(x) : b].tobytes() for x, b in zip(keys, ends.tolist(), strict=True)]
                begin = end
            asked = [k for k, x in enumerate(chunk) if x is not None]
            if asked:
                yield batch_of(ANSWERED, [chunk[k] for k in asked], [segment[k] for k in asked], answers)
        give_back()

    def score_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, number, ids, out, found in chunks_of(batches):
            levels = np.frombuffer(b"".join(found.as_py() or []), np.uint8) if todo else np.zeros(len(chunk.keys), np.uint8)
            yield chunk.scored(ids, out, number, levels, *numbers)
            del chunk, levels
        give_back()

    with in_small_steps(docs.sparkSession):
        chunks = write_shared(rows.mapInArrow(gather, CHUNKS_DDL), "chunks")
        answers = docs.sparkSession.createDataFrame([], ANSWERED_DDL)
        if todo:
            of = docs.sparkSession.createDataFrame([(each[0], k) for k, part in enumerate(todo) for each in part], "slice int, segment int")
            filters = blocks.join(F.broadcast(of), "slice").select(F.lit(None).cast("long").alias("chunk"), "segment", "slice", "probes", F.col("filter").alias("data"))
            asked = chunks.mapInArrow(ask, ASKED_DDL).select("chunk", "segment", F.lit(0).alias("slice"), F.lit(0).alias("probes"), F.col("keys").alias("data"))
            met = filters.unionByName(asked).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "segment")
            answers = write_shared(met.sortWithinPartitions("segment", F.asc_nulls_first("chunk")).mapInArrow(look_up, ANSWERED_DDL), "answers")
        found = answers.groupBy("chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("segment", "levels"))), lambda x: x["levels"]).alias("found"))
        rows = write_shared(chunks.join(found, "chunk", "left").select("chunk", "doc_ids", "held", "texts", "found").mapInArrow(score_chunks, SCORED_DDL), "scored")
        drop_shared(chunks)
    # Words outside the dictionary: exact counts, and the divisors of what follows them, by a join.
    others = rows.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("w")).select("row", F.col("w.rare").alias("key"), F.col("w.rare_n").alias("n"))
    met = others.join(words.where(F.col("c") < top) if top is not None else words, "key", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    term = F.col("n") * F.log10((F.col("c") + F.lit(0.5)) / F.lit(divisor))
    after = F.when(F.col("key") == F.lit(int(END.view(np.int64))), F.lit(0.0)).otherwise(F.col("n") * F.log10(F.coalesce("t", F.lit(0.0)) + F.lit(more)))
    rest = met.groupBy("row").agg(F.sum(term).alias("b"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("k"), F.sum(after).alias("d"))
    return rows.join(rest, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("b", F.lit(0.0))).alias("base_score"),
        (F.col("score") - F.coalesce("d", F.lit(0.0))).alias("score"),
    )


def fold(remainder: int):
    """crc32 of doc_id as text, mod 5, is ``remainder``; a null doc_id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5)) == remainder


def op3_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read_table(spark, sf_dir, "documents"), fold(1))
