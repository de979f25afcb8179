"""Exact removal of repeated substrings (op10 and the third stage of the pipeline) with a run-length index.

A string of ``length`` bytes that starts twice, anywhere, is a repeat; every byte that a repeat covers goes.

1. Anchors. In each window of ``length`` bytes the ``GRAM``-byte string of least hash (the leftmost such) is the
   window's anchor. It depends on the window's bytes alone, so equal windows have equal anchors in equal places.
2. Only anchors whose hash occurs twice can have repeated windows. Around each occurrence of such an anchor the
   bytes of its windows are cut out and sent to where all occurrences of that hash are.
3. There the strings, aligned at their anchor, are indexed by a run-compressed Burrows-Wheeler transform over
   columns (a positional BWT) with samples at the ends of its runs: see ``RunIndex``. Matching statistics are
   streamed off the samples, row by row, and matches of ``length`` bytes are marked. Equal strings are one row.
   Texts without an anchor in common never meet.
4. The occurrences of an anchor with more than ``hot_rows`` aren't gathered as one group: they are dealt by the bytes
   beside the anchor, until groups of different strings are small enough for the index. See ``match_dealt``.

null text: as empty. Texts shorter than ``length`` bytes: kept. Rows with equal doc_id and text are rows still,
each a repeat of the other. A null doc_id is a key like any other. Empty table: no rows. Columns other than
doc_id and text are not read, and pass through ``without_repeats`` unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, free_names, ids_of, in_chunks, in_small_steps, ragged, read_table, shared_path, text_col, write_shared

LENGTH, GRAM, HOT_ROWS, CHUNK = 400, 32, 4_000, 32
_WEIGHTS = np.random.default_rng(400).integers(0, 1 << 63, (2, 256), np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_PLACE = np.uint64((1 << 24) - 1)
#: Bytes whose anchors are sought at once, and the longest stretch of one text.
BUFFER, STRETCH = 1 << 20, 1 << 23


def rolling(data: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """Hash of the ``size`` bytes from each place on: of halves, quarters and so on, put together."""
    hashes, width, base = _WEIGHTS[which][data], 1, _BASES[which]
    out, covered = None, 0
    while True:
        if size & width:
            if out is None:
                out = hashes
            else:
                n = min(len(out), len(hashes) - covered)
                out = out[:n] * np.uint64(pow(base, width, 1 << 64)) + hashes[covered : covered + n]
            covered += width
        if covered == size:
            return out
        hashes = hashes[:-width] * np.uint64(pow(base, width, 1 << 64)) + hashes[width:]
        width *= 2


def spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def least_of(x: np.ndarray, width: int) -> np.ndarray:
    """The least of x[i..i+width-1] for each i."""
    step = 1
    while 2 * step <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (width - step)], x[width - step :]) if width > step else x


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, hash, place of the anchor, its first window, its last) within each text, in their order."""
    n = len(data)
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    if n < length:
        return none
    gram = spread(rolling(data, GRAM))
    best = least_of((gram & ~_PLACE) | np.arange(len(gram), dtype=np.uint64), length - GRAM + 1)
    place = (best & _PLACE).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(place)]
    good = np.arange(len(place)) + length <= offsets[1:][row]
    at = np.flatnonzero(good)
    if not len(at):
        return none
    place, row = place[at], row[at]
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (row[1:] != row[:-1])]))
    last = np.append(first[1:], len(at)) - 1
    begin = offsets[:-1][row[first]]
    return row[first], gram[place[first]].view(np.int64), place[first] - begin, at[first] - begin, at[last] - begin


ANCHORS_DDL = "doc_id long, text_hash long, hash array<long>, place array<int>, lo array<int>, hi array<int>"
ANCHORS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("hash", pa.list_(pa.int64())), ("place", pa.list_(pa.int32())), ("lo", pa.list_(pa.int32())), ("hi", pa.list_(pa.int32()))])


def find_anchors(keyed: DataFrame, length: int, stretch: int = STRETCH) -> DataFrame:
    """Anchors of each text; a text longer than ``stretch`` gets a row for each stretch of its windows."""

    def rows(batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, shift: int) -> pa.RecordBatch:
        row, *found = anchors(data, offsets, length)
        bounds = pa.array(np.searchsorted(row, np.arange(len(batch) + 1)), pa.int32())
        found[1:] = [x + shift for x in found[1:]]
        lists = [pa.ListArray.from_arrays(bounds, pa.array(x, t)) for x, t in zip(found, (pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)]
        out = pa.RecordBatch.from_arrays([ids_of(batch, "doc_id"), ids_of(batch, "text_hash"), *lists], schema=ANCHORS)
        return out.filter(pa.array(np.diff(bounds.to_numpy()) > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in in_chunks(batches, "text", min(BUFFER, stretch)):
            if len(data) <= stretch:
                yield rows(batch, data, offsets, 0)
            else:
                for at in range(0, len(data) - length + 1, stretch):
                    part = data[at : at + stretch + length - 1]
                    yield rows(batch, part, np.array([0, len(part)]), at)

    return keyed.mapInArrow(run, ANCHORS_DDL)


class RunIndex:
    """Run-compressed positional BWT of rows (matrix of bytes, 0 outside a row's own columns ``begin``..``end``), by group.

    The transform of a column lists its bytes with the rows of each group in the order of their reversed beginnings.
    A row inside a run of one byte keeps its neighbours, and since when it agrees with them, into the next column;
    only at the ends of runs do these change. So what is kept is, for each end of a run, the row, the column and
    the columns from which it agrees with the rows before and after it in the order. Columns in which a group has
    one run are passed over.
    """

    def __init__(self, matrix: np.ndarray, group: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int) -> None:
        self.begin, self.end, self.length, self.width = begin, end, length, matrix.shape[1]
        self.row, self.column, self.before, self.after = (np.concatenate(x) for x in zip(*self._samples(matrix, group), strict=True))

    def _samples(self, matrix: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        length, width = self.length, self.width
        never, most = width + 1, width - length
        # No byte of a row is 0, so the fixed-width strings compare as a whole.
        reverse = np.ascontiguousarray(matrix[:, length - 1 :: -1])
        by_text = np.argsort(reverse.view(f"S{length}").ravel(), kind="stable")
        order = by_text[np.argsort(group[by_text], kind="stable")]
        sorted_, own = reverse[order], group[order]
        differ = sorted_[1:] != sorted_[:-1]
        agree = np.where(differ.any(1), differ.argmax(1), length)
        since = np.concatenate([[never], np.where(own[1:] == own[:-1], length - agree, never)])
        yield order, np.full(len(order), length - 1), since, np.append(since[1:], never)
        columns = np.ascontiguousarray(matrix.T)
        of = np.cumsum(np.concatenate([[False], own[1:] != own[:-1]]))
        several = columns[length:, order[1:]] != columns[length:, order[:-1]]
        several &= of[1:] == of[:-1]
        heads = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        mixed = np.logical_or.reduceat(np.concatenate([np.zeros((width - length, 1), bool), several], axis=1), heads, axis=1) if width > length else None
        for j in range(length, width):
            at = np.flatnonzero(mixed[j - length][of])
            if not len(at):
                continue
            # What has agreed with neither neighbour since the last start of a match never matters again.
            lost = since[at] > most
            lost &= np.append(since, never)[at + 1] > most
            if 4 * lost.sum() > len(at):
                stay = np.ones(len(order), bool)
                stay[at[lost]] = False
                order, since, of = order[stay], since[stay], of[stay]
                at = np.flatnonzero(mixed[j - length][of])
                if not len(at):
                    continue
            key = (of[at] << 8) | columns[j][order[at]]
            starts = np.concatenate([[True], key[1:] != key[:-1]])
            if not (starts[1:] & (of[at][1:] == of[at][:-1])).any():
                continue
            ends = starts | np.append(starts[1:], True)
            to = np.argsort(key, kind="stable")
            key, old = key[to], since[at]
            same = np.flatnonzero(key[1:] == key[:-1]) + 1
            new = np.full(len(at), j + 1)
            new[same] = old[to[same]]
            moved = same[to[same] != to[same - 1] + 1]
            if len(moved):
                new[moved] = np.maximum.reduceat(np.append(old, 0), np.column_stack([to[moved - 1] + 1, to[moved] + 1]).ravel())[::2]
            new[np.concatenate([[True], (key[1:] >> 8) != (key[:-1] >> 8)])] = never
            order, since = order.copy(), since.copy()
            order[at], since[at] = order[at][to], new
            kept = np.flatnonzero(ends[to])
            yield order[at[kept]], np.full(len(kept), j), new[kept], np.append(since, never)[at[kept] + 1]

    def matches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, first, end) of the runs of columns at which a string starts that another row of the group has there. The
        longest match that ends in a column is with a neighbour, and is read off the samples of a row as they come."""
        at = np.lexsort((self.column, self.row))
        row, column, nearest = self.row[at], self.column[at], np.minimum(self.before, self.after)[at]
        until = np.append(np.where(row[1:] == row[:-1], column[1:], self.width), self.width)[: len(row)]
        first = np.maximum(column, np.maximum(nearest, self.begin[row]) + self.length - 1)
        stop = np.minimum(until, self.end[row])
        some = np.flatnonzero(first < stop)
        row, first, stop = row[some], first[some], stop[some]
        joins = np.concatenate([[False], (row[1:] == row[:-1]) & (first[1:] == stop[:-1])]) if len(row) else np.zeros(0, bool)
        last = np.append(~joins[1:], True)[: len(row)]
        return row[~joins], first[~joins] + 1 - self.length, stop[last] + 1 - self.length


def repeated_windows(group: np.ndarray, left: np.ndarray, data: np.ndarray, offsets: np.ndarray, length: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first byte, end) of the runs of bytes covered by repeats, within each row's string. ``group`` is sorted;
    the strings of a group are aligned at the place ``left`` (at most ``reach``) bytes after their starts."""
    width = reach + length
    sizes = np.diff(offsets)
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode().indices.to_numpy()
    _, first, back, many = np.unique(np.column_stack([group, left, coded]), axis=0, return_index=True, return_inverse=True, return_counts=True)
    back = back.ravel()
    begin, size = reach - left[first], sizes[first]
    # Strings that are there twice are repeats as a whole.
    whole = np.flatnonzero(many > 1)
    found = [(whole, np.zeros(len(whole), np.int64), size[whole])]
    several = np.flatnonzero(np.bincount(group[first] - group.min())[group[first] - group.min()] > 1)  # rows of groups with more than one
    if len(several):
        matrix = np.zeros((len(several), width), np.uint8)
        n = size[several]
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        matrix[np.repeat(np.arange(len(several)), n), np.repeat(begin[several], n) + k] = data[np.repeat(offsets[first[several]], n) + k] + np.uint8(1)
        row, start, stop = RunIndex(matrix, group[first[several]], begin[several], (begin + size)[several], length).matches()
        row = several[row]
        part = many[row] == 1
        row, start, stop = row[part], start[part], stop[part]
        found.append((row, start - begin[row], stop - 1 + length - begin[row]))
    row, start, stop = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(row, kind="stable")
    row, start, stop = row[order], start[order], stop[order]
    # Spans of the distinct rows, for every row that has the string.
    count = np.bincount(row, minlength=len(first))
    each = count[back]
    pick = ragged((np.cumsum(count) - count)[back], each)
    return np.repeat(np.arange(len(back)), each), start[pick], stop[pick]


SPANS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])
SPANS_DDL = "doc_id long, text_hash long, start int, end int"
CUTS = pa.schema([("hash", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("lo", pa.int32()), ("left", pa.int32()), ("bytes", pa.binary())])
CUTS_DDL = "hash long, doc_id long, text_hash long, lo int, left int, bytes binary"


def once(lists: pa.Array, field: str) -> tuple[pa.Array, np.ndarray]:
    """The structs of a column of lists, and their rows; of those with the same ``field`` in a list, one. (Rows with the
    same doc_id and text bring the same structs.)"""
    flat = pc.list_flatten(lists)
    row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
    first = np.unique((row << 32) | pc.struct_field(flat, field).to_numpy().astype(np.int64), return_index=True)[1]
    return flat.take(pa.array(first)), row[first]


def cut_out(with_hits: DataFrame, length: int) -> DataFrame:
    """The bytes of each repeated anchor's windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in in_chunks(batches, "text", BUFFER):
            hits = batch.column(batch.schema.get_field_index("hits"))
            # An anchor beside the end of a stretch has two structs, with other windows each.
            flat, row = once(hits, "lo")
            lo, hi, place = (pc.struct_field(flat, c).to_numpy() for c in ("lo", "hi", "place"))
            raw = data.tobytes()
            base = offsets[row]
            for at in range(0, len(row), 8192):
                part = slice(at, at + 8192)
                strings = [raw[a:b] for a, b in zip((base[part] + lo[part]).tolist(), (base[part] + hi[part] + length).tolist(), strict=True)]
                take = pa.array(row[part])
                yield batch_of(CUTS, pc.struct_field(flat, "hash").slice(at, 8192), ids_of(batch, "doc_id").take(take), ids_of(batch, "text_hash").take(take), lo[part], place[part] - lo[part], strings)

    return with_hits.mapInArrow(run, CUTS_DDL)


def match_gathered(cuts: DataFrame, length: int, reach: int) -> DataFrame:
    """Spans of the cut strings; all of one hash meet in one task. Their alignment lies at most ``reach`` bytes in."""
    parts = int(cuts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def spans(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        strings = rows.column("bytes").combine_chunks().cast(pa.large_binary())
        offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
        data = np.frombuffer(strings.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        hash_ = rows.column("hash").to_numpy()
        group = np.cumsum(np.concatenate([[False], hash_[1:] != hash_[:-1]]))
        of, start, end = repeated_windows(group, rows.column("left").to_numpy().astype(np.int64), data, offsets - offsets[0], length, reach)
        lo = rows.column("lo").to_numpy()[of]
        take = pa.array(of)
        return batch_of(SPANS, rows.column("doc_id").combine_chunks().take(take), rows.column("text_hash").combine_chunks().take(take), (lo + start).astype(np.int32), (lo + end).astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                hash_ = part.column(0).to_numpy()
                if size >= 4 << 20:
                    # A group ends where the hash changes: what came before goes, the rest waits for its end.
                    last = waiting[-1].column(0)[len(waiting[-1]) - 1].as_py()
                    new = np.flatnonzero(hash_ != last)
                    if len(new):
                        stop = int(new[0])
                        yield spans(pa.Table.from_batches([*waiting, part.slice(0, stop)]))
                        part, waiting, size = part.slice(stop), [], 0
                waiting.append(part)
                size += part.nbytes
        if waiting:
            yield spans(pa.Table.from_batches(waiting))

    return cuts.repartition(parts, "hash").sortWithinPartitions("hash").mapInArrow(run, SPANS_DDL)


PIECES = pa.schema([("core", pa.int64()), ("whole0", pa.int64()), ("whole1", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("first", pa.int32()), ("start", pa.int32()), ("n", pa.int32()), ("known", pa.bool_()), ("stands", pa.bool_())])
PIECES_DDL = "core long, whole0 long, whole1 long, doc_id long, text_hash long, first int, start int, n int, known boolean, stands boolean"


def joint(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, size) of the stretches that overlapping or adjacent ones of a text make together."""
    order = np.lexsort((start, text))
    text, start, end = text[order], start[order], end[order]
    # Texts lie one after the other, so that the furthest end so far is one of the same text.
    far = int(end.max(initial=0)) + 1
    reach = np.maximum.accumulate(text * far + end)
    heads = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (text[1:] * far + start[1:] > reach[:-1])])[: len(text)])
    return text[heads], start[heads], reach[np.append(heads[1:], len(text))[: len(heads)] - 1] - text[heads] * far - start[heads]


def pieces(with_runs: DataFrame, length: int, size: int, stretch: int = STRETCH) -> DataFrame:
    """Runs of windows (``parent``, ``first``: where the first possible one starts, ``start``, ``n``) cut into pieces of
    ``size`` neighbours at most. ``core`` names the bytes that all possible windows of a piece hold, its place and the
    parent; ``whole0`` and ``whole1`` all its bytes and its place. A piece is ``known`` to be a repeat if another of the same
    chunk of rows equals it; one of these ``stands`` for the others, as does one that equals none. Rows are the pieces that
    stand and, without a core, the stretches of each text that its known pieces cover, put together."""

    def rows(batch: pa.RecordBatch, data: np.ndarray, base: np.ndarray, owner: np.ndarray, parent: np.ndarray, first: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        low, high = (start - first) // size, (start + n - 1 - first) // size
        many = high - low + 1
        of = np.repeat(np.arange(len(start)), many)
        number = ragged(low, many)
        head = first[of] + number * size
        begin = np.maximum(head, start[of])
        count = np.minimum(head + size, (start + n)[of]) - begin
        core = rolling(data, length - size + 1)[base[of] + head + size - 1]
        own = spread(parent[of].view(np.uint64) + number.astype(np.uint64))
        place = ((begin - head) * size + count).astype(np.uint64)
        wholes = []
        for w in (0, 1):
            windows = rolling(data, length, w)
            wholes.append(spread(spread(windows[base[of] + begin] + own) * np.uint64(3) + spread(windows[base[of] + begin + count - 1] + place)).view(np.int64))
        core = spread(core + own).view(np.int64)
        order = np.lexsort((*wholes, core))
        new = np.concatenate([[True], np.any([x[order[1:]] != x[order[:-1]] for x in (core, *wholes)], axis=0)])
        known, stands = np.zeros((2, len(core)), bool)
        known[order], stands[order] = ~(new & np.append(new[1:], True)), new
        text, covered, many = joint(owner[of][known], begin[known], begin[known] + count[known] - 1 + length)
        none, stand = np.zeros(len(text), np.int64), np.flatnonzero(stands)
        both = lambda x, y: np.concatenate([x[stand], y])
        take = pa.array(both(owner[of], text))
        return batch_of(PIECES, *[both(x, none) for x in (core, *wholes)], ids_of(batch, "doc_id").take(take), ids_of(batch, "text_hash").take(take), *[both(x, y).astype(np.int32) for x, y in ((head, covered), (begin, covered), (count, many + 1 - length))], both(known, none == 0), both(stands, none > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in in_chunks(batches, "text", min(BUFFER, stretch)):
            flat, owner = once(batch.column(batch.schema.get_field_index("runs")), "start")
            parent, first, start, n = (pc.struct_field(flat, c).to_numpy().astype(np.int64) for c in ("parent", "first", "start", "n"))
            if len(data) <= stretch:
                yield rows(batch, data, offsets[owner], owner, parent, first, start, n)
                continue
            for at in range(0, len(data), stretch):  # one long text
                some = np.flatnonzero((start >= at) & (start < at + stretch))
                if len(some):
                    # The windows of a run start within ``length`` bytes, and so do the cores.
                    part = data[at : at + stretch + 2 * length]
                    yield rows(batch, part, np.full(len(some), -at), owner[some], parent[some], first[some], start[some], n[some])

    return with_runs.mapInArrow(run, PIECES_DDL)


def match_dealt(texts: DataFrame, runs: DataFrame, length: int, hot_rows: int, stretch: int = STRETCH) -> DataFrame:
    """Spans for ``runs`` (doc_id, text_hash, parent, first, start, n) of windows of anchors with very many occurrences.

    A run is dealt by the bytes beside its anchor, in pieces of a few neighbours. A piece that is there twice as a whole
    is a span at once, and stands for its copies from then on. Pieces that share the bytes common to their windows and
    differ beyond meet in an index, if at most ``hot_rows`` differ; if more, they are cut in halves and dealt anew.
    """
    size, spans = CHUNK, None
    whole_of = ["core", "whole0", "whole1"]
    while True:
        of_doc = runs.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("parent", "first", "start", "n")).alias("runs"))
        found = write_shared(pieces(joined(texts, of_doc, "inner").select("t.*", "r.runs"), length, size, stretch), "pieces")
        wholes = write_shared(found.where("stands").groupBy(*whole_of).agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("doc_id", "text_hash", "first", "start", "n")).alias("p")), "whole-pieces")
        again = found.where("stands AND NOT known").join(wholes.where("m > 1").select(*whole_of), whole_of, "left_semi").unionByName(found.where("NOT stands"))
        spans_here = again.select("doc_id", "text_hash", "start", (F.col("start") + F.col("n") - 1 + length).cast("int").alias("end"))
        kinds = write_shared(wholes.groupBy("core").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "cores")
        unlike = wholes.join(kinds, "core").select("core", "kinds", "p.*")
        hits = F.struct(F.col("core").alias("hash"), (F.col("first") + (size - 1)).cast("int").alias("place"), F.col("start").alias("lo"), (F.col("start") + F.col("n") - 1).cast("int").alias("hi"))
        few = unlike.where(F.col("kinds") <= hot_rows).groupBy("doc_id", "text_hash").agg(F.collect_list(hits).alias("hits"))
        spans_here = spans_here.unionByName(match_gathered(cut_out(joined(texts, few, "inner").select("t.*", "r.hits"), length), length, size - 1))
        spans = spans_here if spans is None else spans.unionByName(spans_here)
        if size == 1 or kinds.where(F.col("kinds") > hot_rows).isEmpty():
            return spans
        runs = unlike.where(F.col("kinds") > hot_rows).select("doc_id", "text_hash", F.col("core").alias("parent"), "first", "start", "n")
        size //= 2


def dealt_by_key(docs: DataFrame) -> DataFrame:
    """``docs`` as a table in the shared folder, in buckets by key (doc_id, text_hash); its own columns are c0, c1 and so on.
    The texts move once: joins by key bring the other side to the buckets. A null doc_id has 0 and another hash."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text, doc_id = text_col(), F.col("doc_id").cast("long")
    key = [F.coalesce(doc_id, F.lit(0)).alias("doc_id"), F.when(doc_id.isNull(), F.xxhash64(text, F.lit(0))).otherwise(F.xxhash64(text)).alias("text_hash")]
    rows = docs.select(*key, *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)])
    path = shared_path(spark, "dealt-texts")
    name = f"spark_catalog.default.{path.rpartition('/')[2].replace('-', '_')}"
    with in_small_steps(spark):
        rows.repartition(parts, "doc_id", "text_hash").write.bucketBy(parts, "doc_id", "text_hash").option("compression", "zstd").option("path", path).saveAsTable(name)
    return spark.table(name)


def texts_in(table: DataFrame, column: int) -> DataFrame:
    """doc_id and text_hash (the key), and the text, in the buckets of ``table``."""
    return table.select("doc_id", "text_hash", text_col(f"c{column}").alias("text"))


def joined(texts: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """``texts`` (as t) with rows of their key (as r); the other side is the smaller."""
    return texts.alias("t").join(right.alias("r").hint("shuffle_hash"), F.expr("t.doc_id = r.doc_id AND t.text_hash = r.text_hash"), how)


def span_table(texts: DataFrame, length: int, hot_rows: int, stretch: int = STRETCH) -> DataFrame:
    """doc_id, text_hash and ``spans``: (start, end) of stretches of bytes covered by repeats, as found."""
    with in_small_steps(texts.sparkSession):
        found = write_shared(find_anchors(texts, length, stretch), "anchors")
        repeated = write_shared(found.select(F.explode("hash").alias("hash")).groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated-anchors")
        each = found.select("doc_id", "text_hash", F.explode(F.arrays_zip("hash", "place", "lo", "hi")).alias("a")).select("doc_id", "text_hash", "a.*")
        hits = each.join(repeated, "hash")
        few = hits.where(F.col("n") <= hot_rows).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("hash", "place", "lo", "hi")).alias("hits"))
        spans = match_gathered(cut_out(joined(texts, few, "inner").select("t.*", "r.hits"), length), length, length - GRAM)
        if not repeated.where(F.col("n") > hot_rows).isEmpty():
            hot = hits.where(F.col("n") > hot_rows)
            runs = hot.select("doc_id", "text_hash", F.col("hash").alias("parent"), (F.col("place") - (length - GRAM)).alias("first"), F.col("lo").alias("start"), (F.col("hi") - F.col("lo") + 1).alias("n"))
            spans = spans.unionByName(match_dealt(texts, runs, length, hot_rows, stretch))
    return spans.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def with_spans(docs: DataFrame, length: int = LENGTH, hot_rows: int = HOT_ROWS, stretch: int = STRETCH) -> DataFrame:
    """doc_id, text and ``spans`` (null without any) of every row."""
    table = dealt_by_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_col().alias("text")))
    found = span_table(texts_in(table, 1), length, hot_rows, stretch)
    return joined(table, found, "left").select(F.col("t.c0").alias("doc_id"), F.col("t.c1").alias("text"), "r.spans")


def union_of(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans or []):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def kept(raw: bytes, removed: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for start, end in removed:
        parts.append(raw[at:start])
        at = end
    return b"".join([*parts, raw[at:]])


def inside_characters(raw: bytes, removed: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The stretches less the parts of characters that they cover only in part."""
    out = []
    for start, end in removed:
        while start < end and raw[start] & 0xC0 == 0x80:
            start += 1
        while end > start and end < len(raw) and raw[end] & 0xC0 == 0x80:
            end -= 1
        out.append((start, end))
    return out


def digests(found: DataFrame) -> DataFrame:
    """The counts and the digest of the remaining bytes, and these as text (less the rest of characters cut in two)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in in_chunks(batches, "text"):
            raw, rows = data.tobytes(), []
            for a, b, s in zip(offsets[:-1].tolist(), offsets[1:].tolist(), batch.column(batch.schema.get_field_index("spans")).to_pylist(), strict=True):
                removed = union_of(s)
                left = kept(raw[a:b], removed)
                rows.append((b - a, sum(y - x for x, y in removed), len(removed), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore")))
            yield batch_of(schema, ids_of(batch, "doc_id"), *zip(*rows, strict=True))

    return found.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")


def without_repeats(docs: DataFrame, length: int = LENGTH, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``docs`` with its texts less their repeats (whole characters only), and n_chars, where it is there, set anew."""
    spans, table = free_names(docs, "spans")[0], dealt_by_key(docs)
    rows = joined(table, span_table(texts_in(table, docs.columns.index("text")), length, hot_rows), "left")
    schema, count = docs.schema, docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = schema.fieldNames().index("text")
        for batch, data, offsets in in_chunks(batches, "text"):
            columns, raw = list(batch.columns[: len(schema)]), data.tobytes()
            found = batch.column(len(schema)).to_pylist()
            texts, counts = columns[at].to_pylist(), columns[count].to_pylist() if count is not None else []
            for k, s in enumerate(found):
                if s:
                    text = raw[offsets[k] : offsets[k + 1]]
                    texts[k] = kept(text, inside_characters(text, union_of(s))).decode("utf-8", "replace")
                    if counts:
                        counts[k] = len(texts[k])
            columns[at] = pa.array(texts, columns[at].type)
            if counts:
                columns[count] = pa.array(counts, columns[count].type)
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return rows.select(*[F.col(f"t.c{k}").alias(c) for k, c in enumerate(docs.columns)], F.col("r.spans").alias(spans)).mapInArrow(run, schema)


def op10_repeat_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(with_spans(read_table(spark, sf_dir, "documents")))
