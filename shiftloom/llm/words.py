"""Words of text bytes, with A-Z lower-cased; in NumPy, for many texts at once. Words are runs of the bytes of a table: ASCII
letters, digits and whatever isn't ASCII, or all that isn't white space. A word has a 64-bit hash; whoever must not take two
words for one compares bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, ragged, text_col


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


IN_WORD = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    IN_WORD[_a:_b] = True
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, *range(9, 14)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CODES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE = np.uint64(0xD6E8FEB86659FD93)
#: Bytes of words that are hashed at a time.
STRETCH = 1 << 20


def powers(n: int) -> np.ndarray:
    out = np.full(n, BASE, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def words_of(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = IN_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of all words, and each text's first word (with one more at the end)."""
    mask = inside[data]
    before, after = np.zeros((2, len(mask) + 1), bool)
    before[1:], after[:-1] = mask, mask
    before[offsets] = False  # words don't go on from text to text
    after[offsets] = False
    starts, ends = np.flatnonzero(mask & ~before[:-1]), np.flatnonzero(mask & ~after[1:]) + 1
    sizes = ends - starts
    hashes, power, at = np.zeros(len(starts), np.uint64), powers(int(sizes.max(initial=0))), 0
    total = np.concatenate([[0], np.cumsum(sizes)])
    while at < len(starts):
        end = max(at + 1, int(np.searchsorted(total, total[at] + STRETCH, side="right")) - 1)
        n = sizes[at:end]
        codes = CODES[LOWER[data[ragged(starts[at:end], n)]]] * power[ragged(np.zeros_like(n), n)]
        hashes[at:end] = mixed(np.add.reduceat(codes, total[at:end] - total[at]) + n.astype(np.uint64))
        at = end
    return starts, ends, hashes, np.searchsorted(starts, offsets)


def item_blocks(items: DataFrame, key: str, size: int) -> list[list[tuple]]:
    """Thunks of the distinct (key, text) rows in blocks of about ``size`` bytes, by hash: each block may be broadcast. A single
    row isn't cut."""
    rows = items.select(F.col(key).alias("k"), text_col().alias("t")).distinct()
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    many = max(1, -(-total // size))
    return [lambda b=b: [tuple(r) for r in rows.where(F.pmod(F.xxhash64("k", "t"), F.lit(many)) == b).orderBy("k", "t").collect()] for b in range(many)]


def words_of_texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts, ends, hashes and bounds of a few texts' words."""
    data, offsets = buffers(pa.array(texts, pa.large_string()))
    return LOWER[data], *words_of(data, offsets)
