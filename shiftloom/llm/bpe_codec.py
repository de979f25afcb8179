"""BPE encoding and decoding of whole texts (op5) by tree concatenation.

A text of more than ``LEAF`` bytes is cut in halves, quarters and so on, at a character but otherwise wherever the middle
falls. The leaves are encoded in parallel. Then neighbours are joined level by level: a window of ``WINDOW`` tokens
on either side of a join is encoded anew and grows until both sides agree with it, that is, until window and half have,
on each side, a token end in common at a place across which no token or rule of the tokenizer looks (``chunk_encoder``
names these places). Between the two places the window's tokens hold, outside them those of the halves. Where there
is no such place for very long, the window is one long run; that is encoded by a tree over its merges, see ``encode_long``.

null text: as empty (no ids). Repeated rows and ties: each row is coded for itself. Empty table: no rows.
Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .chunk_encoder import cuts, encoder, library
from .common import batch_of, ids_of, in_chunks, ragged, read_table


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """(all tokens' bytes, offsets by id) of a byte-level vocabulary."""
    lib = library(path)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in printable)}
    back = {c: b for b, c in shown.items()}
    words = [b""] * lib.get_vocab_size(with_added_tokens=True)
    for token, i in lib.get_vocab(with_added_tokens=True).items():
        words[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
    return np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in words])])


#: Bytes of a leaf at most, and tokens on either side in the first window around a join.
LEAF, WINDOW = 512, 8


def leaves(data: np.ndarray, offsets: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, list[np.ndarray]]:
    """(where the leaves of all texts start and, at last, the data end; for each level of the trees, the lowest first, the
    number of the leaf right of each join, of that where the left half begins and of that after the right half)."""
    size = np.diff(offsets)
    depth = np.zeros(len(size), np.int64)
    while (more := size > leaf << depth).any():
        depth[more] += 1
    many = np.where(size > 0, 1 << depth, 0)
    first = np.cumsum(many) - many
    text = np.repeat(np.arange(len(size)), many)
    number = np.arange(len(text)) - first[text]
    start = offsets[:-1][text] + (size[text] * number >> depth[text])
    while (inside := (data[start] & 0xC0 == 0x80) & (number > 0)).any():  # to the next character
        start[inside] += 1
    levels = []
    for level in range(int(depth.max(initial=0))):
        half = 1 << level
        joins = np.flatnonzero((depth[text] > level) & (number & (2 * half - 1) == half))
        levels.append(np.column_stack([joins, joins - half, joins + half]))
    return np.append(start, len(data)), levels


class TreeEncoder:
    """ids of texts by tree concatenation; ``joins`` and ``grown`` count joins and windows that were not enough at first."""

    def __init__(self, path: str, leaf: int = LEAF) -> None:
        self.coder, self.leaf, self.joins, self.grown = encoder(path, tree=True), leaf, 0, 0
        raw, at = token_bytes(path)
        self.sizes = at[1:] - at[:-1]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids uint32 of all texts, offsets of each text's ids)."""
        start, levels = leaves(data, offsets, self.leaf)
        ids, _ = self.coder.encode(data, start)
        safe = cuts(data, offsets)
        for level in levels:
            ids = self._join(data, ids, safe, start[level])
        at = np.concatenate([[0], np.cumsum(self.sizes[ids])])
        return ids, np.searchsorted(at, offsets)

    def _join(self, data: np.ndarray, ids: np.ndarray, safe: np.ndarray, joins: np.ndarray) -> np.ndarray:
        """All joins (place, start of the left half, end of the right one) of a level."""
        ends = np.cumsum(self.sizes[ids])
        begins = ends - self.sizes[ids]
        self.joins += len(joins)
        window = np.full(len(joins), WINDOW)
        drop = np.zeros(len(ids), bool)
        added = []
        while len(joins):
            place, low, high = joins.T
            token = np.searchsorted(begins, place)
            left, right = np.searchsorted(begins, low), np.searchsorted(begins, high)
            x = begins[np.maximum(token - window, left)]
            y = ends[np.minimum(token + window, right) - 1]
            # A token can hold part of a character; windows hold whole ones.
            while (inside := data[x] & 0xC0 == 0x80).any():
                x = x - inside
            while (inside := np.append(data, 0)[y] & 0xC0 == 0x80).any():
                y = y + inside
            # The nearest places on either side across which nothing looks; a half's outer end is one.
            before = np.maximum(np.append(safe, 0)[np.searchsorted(safe, place, side="right") - 1], low)
            after = np.minimum(np.append(safe, len(data))[np.searchsorted(safe, place)], high)
            text = self._windows(data, x, y)
            got, bounds = self.coder.encode(*text)
            stop = np.cumsum(self.sizes[got])
            at = np.repeat(x - text[1][:-1], np.diff(bounds)) + stop - self.sizes[got]
            of = np.repeat(np.arange(len(joins)), np.diff(bounds))
            # Both sides agree where the window reaches these places and has token ends there, as the halves have.
            agree = (x <= before) & (after <= y) & self._has(begins, ends, before) & self._has(begins, ends, after)
            agree &= self._among(at, of, before, x, len(joins)) & ((after == y) | self._among(at, of, after, x, len(joins)))
            inside = agree[of] & (at >= before[of]) & (at < after[of])
            added.append((at[inside], got[inside]))
            for a, b in zip(np.searchsorted(begins, before[agree]).tolist(), np.searchsorted(begins, after[agree]).tolist(), strict=True):
                drop[a:b] = True
            self.grown += int((~agree).sum())
            joins, window = joins[~agree], 2 * window[~agree]
        at, new = (np.concatenate(c) for c in zip(*added, strict=True)) if added else (begins[:0], ids[:0])
        order = np.argsort(np.concatenate([begins[~drop], at]), kind="stable")
        return np.concatenate([ids[~drop], new])[order]

    def _windows(self, data: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return data[ragged(x, y - x)], np.concatenate([[0], np.cumsum(y - x)])

    def _has(self, begins: np.ndarray, ends: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether a token begins (or all end) at each place."""
        at = np.searchsorted(begins, place)
        return np.append(begins, ends[-1] if len(ends) else 0)[at] == place

    def _among(self, at: np.ndarray, of: np.ndarray, place: np.ndarray, x: np.ndarray, many: int) -> np.ndarray:
        """Whether a window has a token that begins at its place."""
        out = np.zeros(many, bool)
        out[of[at == place[of]]] = True
        return out


@functools.lru_cache(2)
def tree_encoder(path: str) -> TreeEncoder:
    """A worker's encoder: it keeps its chunks from task to task."""
    return TreeEncoder(path)


def decode_ids(ids: np.ndarray, bounds: np.ndarray, path: str) -> list[bytes]:
    """UTF-8 of the texts whose ids lie between ``bounds``; what isn't UTF-8 becomes U+FFFD."""
    raw, at = token_bytes(path)
    sizes = (at[1:] - at[:-1])[ids]
    flat = raw[ragged(at[ids], sizes)].tobytes()
    ends = np.concatenate([[0], np.cumsum(sizes)])[bounds]
    return [flat[a:b].decode("utf-8", "replace").encode() for a, b in zip(ends[:-1], ends[1:], strict=True)]


CODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])
DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode_documents(docs: DataFrame, path: str, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian uint32) and the decoded text; with ``digest`` their SHA-256 instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tree_encoder(path)
        for batch, data, offsets in in_chunks(batches, "text"):
            ids, bounds = coder.encode(data, offsets)
            raw = ids.astype("<u4").tobytes()
            texts = decode_ids(ids, bounds, path)
            coded = [raw[4 * a : 4 * b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            if digest:
                yield batch_of(DIGEST, ids_of(batch, "doc_id"), np.diff(bounds), [hashlib.sha256(x).hexdigest() for x in coded], [hashlib.sha256(x).hexdigest() for x in texts])
            else:
                yield batch_of(CODED, ids_of(batch, "doc_id"), np.diff(bounds), coded, [x.decode() for x in texts])

    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digest else "ids binary, decoded string")
    return docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text").mapInArrow(run, schema)


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read_table(spark, sf_dir, "documents"), default_path("byte_bpe_50k.json"), digest=True)
