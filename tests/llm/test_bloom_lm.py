import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from shiftloom.llm import bloom_lm as lm

from .conftest import corpus


def filled(slices, made):
    """A filter of blocks (number: probes, bytes)."""
    got = lm.Filter(slices, [(k, p, len(x)) for k, (p, x) in sorted(made.items())])
    for k, (_, x) in made.items():
        got.put(k, x)
    return got


def test_filter_gives_levels_back():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 1 << 63, 5000, np.uint64)
    counts = rng.integers(1, 3000, 5000)
    slices = lm.slice_of(keys, 8)
    for probes in ([1, 2], [3]):  # slices may differ
        many = [probes[s % len(probes)] for s in range(8)]
        got = filled(8, {s: (many[s], lm.built(keys[slices == s], counts[slices == s], many[s])) for s in range(8)})
        level = np.searchsorted(lm.LEVELS, counts, side="right")
        assert (got.levels(keys) >= level).all() and (got.levels(keys) == level).mean() > (0.999 if probes == [3] else 0.9)
        other = rng.integers(0, 1 << 63, 200_000, np.uint64)
        false, at = got.levels(other) > 0, lm.slice_of(other, 8)
        for s in range(8):
            assert false[at == s].mean() < 1.4 * lm.FALSE ** many[s] + 0.0005
    assert (np.abs(lm.MIDDLES[level] - counts) <= 0.13 * counts).all() and lm.MIDDLES[:5].tolist() == [0, 1, 2, 3, 4]


def test_probabilities_sum_to_one_over_the_vocabulary(spark):
    """For common and rare histories, in a vocabulary large enough for false hits to count if there were many."""
    rng = np.random.default_rng(3)
    vocabulary = [f"w{k}" for k in range(12_000)]
    draw = np.minimum(rng.zipf(1.25, 150_000) - 1, len(vocabulary) - 1)
    draw[: len(vocabulary)] = np.arange(len(vocabulary))
    texts = [" ".join(vocabulary[k] for k in draw[at : at + 500]) for at in range(0, len(draw), 500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = lm.train(df)
    assert (model.vocabulary, model.n_train) == (len(vocabulary) + 1, len(draw) + len(texts))
    rows = model.blocks.select("slice", "probes", "filter").collect()
    halves = [sorted(r for r in rows if (r[0] < 5) == first) for first in (True, False)]
    parts = [filled(model.slices, {r[0]: (r[1], bytes(r[2])) for r in half}) for half in halves]
    assert 0 < model.false < lm.FALSE_MASS * lm.MU
    hashed = lambda x: lm.tokens(np.frombuffer(" ".join(x).encode(), np.uint8), np.array([0, len(" ".join(x))]))[0]
    words = hashed(vocabulary)  # and the end
    hit, counts, _ = lm.known(words, model.common)
    assert hit.all()
    p = (counts + 0.5) / (model.total + 0.5 * (model.vocabulary + 1))
    unknown = 0.5 / (model.total + 0.5 * (model.vocabulary + 1))
    asked = np.concatenate([[lm.START], hashed(vocabulary[:20] + vocabulary[-20:] + ["w300", "w777", "never"])[:-1]])
    for h in asked:
        t = model.start if h == lm.START else float(lm.known(np.array([h]), model.common)[2][0])
        c = lm.MIDDLES[lm.levels_in(parts, lm.pair_keys(np.full(len(words), h), words))]
        total = ((c + lm.MU * p) / (t + model.false + lm.MU)).sum() + lm.MU * unknown / (t + model.false + lm.MU)
        assert abs(total - 1) < 0.02, (h, total)


def expected():
    rows = [(i, [*((t or "").encode().lower().split()), None]) for i, t in corpus()]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    c, pairs = Counter(), Counter()
    for (_, w), h in zip(rows, held, strict=True):
        if not h:
            c.update(w)
            pairs.update(zip(["<"] + w[:-1], w, strict=True))
    n, d = sum(c.values()), sum(c.values()) + 0.5 * (len(c) + 1)
    c["<"] = c[None]
    out = []
    for (i, w), h in zip(rows, held, strict=True):
        base = sum(math.log10((c[x] + 0.5) / d) for x in w)
        score = sum(math.log10((pairs[a, b] + lm.MU * (c[b] + 0.5) / d) / (c[a] + lm.MU)) for a, b in zip(["<"] + w[:-1], w, strict=True))
        out.append((i, h, len(w), sum(c[x] > 0 for x in w), n, base, score))
    return out


def check(got):
    want = sorted(expected(), key=lambda r: (r[0] is None, r[0] or 0, r[2], r[5]))
    rows = sorted(got.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens, r.base_score))
    for r, w in zip(rows, want, strict=True):
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:5]
        assert abs(r.base_score - w[5]) < 1e-6
        # Quantised counts and false hits of the filter move the score by little.
        assert abs(r.score - w[6]) < 0.05 * max(1, abs(w[6]))


def test_scores_with_one_segment_and_with_many(docs, monkeypatch):
    """However many segments the filter is broadcast in, the scores are the same."""
    order = lambda rows: sorted(repr(tuple(r)) for r in rows)
    one = lm.score_texts(docs, lm.fold(1))
    check(one)
    want = order(one.collect())
    many, cut = [], lm.segments
    monkeypatch.setattr(lm, "segments", lambda sizes, most: (many.append(x) if (x := cut(sizes, most)) and most < lm.PART_BYTES else None) or x)
    for size in (40_000, 0):
        assert order(lm.score_texts(docs, lm.fold(1), broadcast_bytes=size).collect()) == want
    assert len(many[-1]) >= 4 and len(many[-1]) > len(many[0])


def test_words_outside_the_dictionary_meet_their_counts(docs):
    check(lm.score_texts(docs, lm.fold(1), dictionary=10))
    check(lm.score_texts(docs, lm.fold(1), dictionary=10, broadcast_bytes=0))


def test_without_training_rows_and_without_rows(docs, no_docs):
    got = lm.score_texts(docs, F.lit(True)).collect()
    assert {r.train_tokens for r in got} == {0} and all(r.n_known == 0 and abs(r.score) < 1e-9 for r in got)
    assert lm.score_texts(no_docs, lm.fold(1)).count() == 0


def test_segments_hold_every_slice():
    numbers = lambda sizes: [[x[0] for x in part] for part in lm.segments([(k, 3, n) for k, n in sizes], 10)]
    assert numbers([(2, 5), (0, 5), (1, 9), (3, 20)]) == [[0], [1], [2], [3]]
    assert numbers([(0, 5), (1, 5), (2, 1)]) == [[0, 1], [2]] and lm.segments([], 10) == []


def test_the_filter_stays_off_the_driver(docs, monkeypatch):
    """What is broadcast is the dictionary alone; segments of the filter meet their n-grams in tasks."""
    sc, sent = docs.sparkSession.sparkContext, []
    real = sc.broadcast
    monkeypatch.setattr(sc, "broadcast", lambda value: sent.append(value) or real(value))
    assert lm.score_texts(docs, lm.fold(1), broadcast_bytes=0).count() == docs.count()
    assert [type(x) for x in sent] == [tuple]
