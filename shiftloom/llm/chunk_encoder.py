"""Whole texts to token ids through the tokenizers library, each distinct chunk of a batch encoded once.

A text is cut where a character that isn't white space is followed by ASCII white space, and where a letter is
followed by one of ``STOPS``. No token of a byte-level or word-end BPE spans such a place and no rule of their
pre-tokenizers or normalizers looks across it, so the ids of the text are those of its chunks one after the other.
"""

from __future__ import annotations

import functools
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer, pre_tokenizers

from .common import ragged

#: Chunks kept per worker (twice that for a while), and the longest that is kept, in bytes.
CACHE_ENTRIES, CACHED_BYTES = 300_000, 64
#: A run without white space beyond so many bytes is encoded as a tree.
LONG_CHUNK = 4096
#: ASCII white space; chunks that are encoded as one text, where tokens tell their bytes.
SPACES, JOINED = frozenset(b" \t\n\v\f\r"), 64
#: Characters of a leaf of that tree, and tokens on either side in the first window around a join.
LEAF, WINDOW = 1024, 8


@functools.cache
def library(path: str) -> Tokenizer:
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def token_sizes(lib: Tokenizer) -> np.ndarray | None:
    """Bytes of each token where tokens are of a text's own bytes: byte-level, and nothing normalized or put before."""
    if lib.normalizer is not None or not isinstance(lib.pre_tokenizer, pre_tokenizers.ByteLevel) or lib.pre_tokenizer.add_prefix_space:
        return None
    vocab, added = lib.get_vocab(with_added_tokens=True), lib.get_added_tokens_decoder()
    out = np.zeros(max(vocab.values(), default=0) + 1, np.int64)
    out[list(vocab.values())] = [len(t) for t in vocab]  # a character for each byte
    for k, t in added.items():
        out[k] = len(t.content.encode())
    return out


#: Punctuation that parts from a letter before it. The apostrophe isn't among them, nor what special tokens hold.
STOPS = np.zeros(256, bool)
STOPS[list(b".,;:!?")] = True
LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123)]] = True


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sorted places in ``data`` where a chunk begins, the starts of texts among them."""
    if len(data) == 0:
        return np.zeros(0, np.int64)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    cut = np.zeros(len(data), bool)
    before = data[:-1]
    cut[1:] = space[1:] & ~space[:-1] & (before > 32)
    # White space beyond ASCII ends in one of these bytes; after such a lead the place is left whole.
    wide = np.flatnonzero(cut[1:] & (before >= 128)) + 1
    if len(wide):
        two, three = data[np.maximum(wide - 2, 0)], data[np.maximum(wide - 3, 0)]
        doubt = (two == 0xC2) | ((three == 0xE1) & (two == 0x9A)) | ((three == 0xE2) & ((two == 0x80) | (two == 0x81))) | ((three == 0xE3) & (two == 0x80))
        cut[wide[doubt]] = False
    # After ASCII letters, and those of two bytes with the lead C3 (but for two signs).
    stop = np.flatnonzero(STOPS[data[1:]]) + 1
    last, lead = data[stop - 1], data[np.maximum(stop - 2, 0)]
    cut[stop[LETTERS[last] | ((lead == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7))]] = True
    starts = offsets[:-1]
    cut[starts[starts < offsets[1:]]] = True
    return np.flatnonzero(cut)


class ChunkEncoder:
    """ids of texts given as (bytes, offsets); ``tree`` encodes long unsplit runs by tree concatenation; ``folded``
    is for tokenizers that take lower case and drop white space, so that such chunks count as one."""

    def __init__(self, path: str, tree: bool = False, folded: bool = False) -> None:
        self.lib, self.tree, self.folded = library(path), tree, folded
        self.sizes = token_sizes(self.lib)
        self.cache: dict[bytes, bytes] = {}
        self.former: dict[bytes, bytes] = {}

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids uint32 of all texts, offsets of each text's ids)."""
        begins = cuts(data, offsets)
        if not len(begins):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        bounds = np.append(begins, len(data))
        if self.folded and b"<|" not in data.tobytes():  # a special token's letters aren't folded
            data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), np.where((data >= 9) & (data <= 13), np.uint8(32), data))
        chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
        coded = chunks.dictionary_encode()
        which = coded.indices.to_numpy()
        flat, lengths = self._distinct(coded.dictionary.to_pylist())
        starts = np.cumsum(lengths) - lengths
        sizes = lengths[which]
        ids = flat[ragged(starts[which], sizes)]
        before = np.concatenate([[0], np.cumsum(sizes)])
        return ids, before[np.searchsorted(begins, offsets)]

    def _distinct(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.cache) > CACHE_ENTRIES:
            self.cache, self.former = {}, self.cache
        cache, former = self.cache, self.former
        new = []
        for c in chunks:
            if c not in cache:
                if c in former:
                    cache[c] = former[c]
                else:
                    new.append(c)
        fresh: dict[bytes, bytes] = {}
        long = [c for c in new if self.tree and len(c) > LONG_CHUNK]
        for c in long:
            fresh[c] = np.asarray(encode_long(self.lib, c.decode("utf-8", "replace")), np.uint32).tobytes()
        plain = [c for c in new if c not in fresh] if long else new
        if self.sizes is not None:
            some = [len(c) <= CACHED_BYTES and c[0] in SPACES and not c.decode("utf-8", "replace")[-1].isspace() and c[-1] > 32 for c in plain]
            plain = [c for c, x in zip(plain, some, strict=True) if not x] + self._joined([c for c, x in zip(plain, some, strict=True) if x])
        for i in range(0, len(plain), 4096):
            part = plain[i : i + 4096]
            for c, e in zip(part, self.lib.encode_batch_fast([c.decode("utf-8", "replace") for c in part], add_special_tokens=False), strict=True):
                (cache if len(c) <= CACHED_BYTES else fresh)[c] = np.asarray(e.ids, np.uint32).tobytes()
        found = [cache[c] if c in cache else fresh[c] for c in chunks]
        return np.frombuffer(b"".join(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found)) // 4


    def _joined(self, chunks: list[bytes]) -> list[bytes]:
        """Encode chunks that begin with ASCII white space and end with none, many in a row as one text, into the cache; those
        that are left are given back, as none are unless a token spans two."""
        groups = [chunks[i : i + JOINED] for i in range(0, len(chunks), JOINED)]
        left = []
        for i in range(0, len(groups), 64):
            part = groups[i : i + 64]
            for group, e in zip(part, self.lib.encode_batch_fast([b"".join(g).decode("utf-8", "replace") for g in part], add_special_tokens=False), strict=True):
                ids = np.asarray(e.ids, np.uint32)
                ends = np.cumsum(self.sizes[ids])
                want = np.cumsum(np.fromiter(map(len, group), np.int64, len(group)))
                at = np.searchsorted(ends, want)
                if not len(ids) or ends[-1] != want[-1] or (ends[at] != want).any():
                    left += group
                    continue
                raw, to = ids.tobytes(), (4 * (at + 1)).tolist()
                for c, x, y in zip(group, [0, *to[:-1]], to, strict=True):
                    self.cache[c] = raw[x:y]
        return left


@functools.lru_cache(4)
def encoder(path: str, tree: bool = False, folded: bool = False) -> ChunkEncoder:
    """A worker's encoder: it keeps its chunks from task to task."""
    return ChunkEncoder(path, tree, folded)


def encode_long(lib: Tokenizer, text: str, leaf: int = LEAF) -> list[int]:
    """Ids of a long text: pre-tokens longer than ``leaf`` characters by tree concatenation, others by the library."""
    out: list[int] = []
    special = {t.content: i for i, t in lib.get_added_tokens_decoder().items()}
    rest = [text]
    for s in special:
        rest = [y for x in rest for k, part in enumerate(x.split(s) if x not in special else [x]) for y in (([s] if k else []) + [part])]
    for part in rest:
        if part in special:
            out.append(special[part])
        elif part:
            for piece, _ in lib.pre_tokenizer.pre_tokenize_str(part):
                out += tree_encode(lib.model, piece, leaf)
    return out


def tree_encode(model, piece: str, leaf: int = LEAF) -> list[int]:
    """BPE ids of one pre-token (characters stand for bytes): encode leaves in parallel, then join neighbours
    level by level. A window of tokens around each join is encoded anew and grows until its first and last
    tokens are the ones either side had there: then every neighbouring pair in the whole is one the merges
    leave as it is, so the whole is what the merges give."""
    if len(piece) <= leaf:
        return [t.id for t in model.tokenize(piece)]
    n = -(-len(piece) // leaf)
    bounds = [len(piece) * k // n for k in range(n + 1)]
    with ThreadPoolExecutor(4) as pool:
        level = list(pool.map(lambda k: [(t.id, t.value) for t in model.tokenize(piece[bounds[k] : bounds[k + 1]])], range(n)))
    while len(level) > 1:
        level = [join_tokens(model, *level[k : k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return [i for i, _ in level[0]]


def join_tokens(model, left: list, right: list) -> list:
    size = WINDOW
    while True:
        a, b = min(size, len(left)), min(size, len(right))
        window = [(t.id, t.value) for t in model.tokenize("".join(v for _, v in left[len(left) - a :] + right[:b]))]
        if (a == len(left) or window[0] == left[-a]) and (b == len(right) or window[-1] == right[b - 1]):
            return left[: len(left) - a] + window + right[b:]
        size *= 2
