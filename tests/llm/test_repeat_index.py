from collections import Counter

import numpy as np
import pytest

from shiftloom.llm import repeat_index as ri
from shiftloom.llm.repeat_index import digests, with_spans, without_repeats

from .conftest import corpus

LENGTH = 100


def covered(texts, length):
    """Masks of the bytes that strings of ``length`` bytes starting twice cover."""
    raw = [t.encode() for t in texts]
    seen = Counter(r[k : k + length] for r in raw for k in range(len(r) - length + 1))
    out = []
    for r in raw:
        mask = np.zeros(len(r), bool)
        for k in range(len(r) - length + 1):
            if seen[r[k : k + length]] > 1:
                mask[k : k + length] = True
        out.append(mask)
    return out


def expected(length):
    texts = [t or "" for _, t in corpus()]
    masks = covered(texts, length)
    return [(t, m, bytes(np.frombuffer(t.encode(), np.uint8)[~m])) for t, m in zip(texts, masks, strict=True)]


@pytest.mark.parametrize("hot_rows", [20_000, 2])
def test_removes_what_starts_twice(docs, hot_rows):
    """Gathered, and with nearly every anchor dealt further."""
    import hashlib

    want = Counter((len(t.encode()), int(m.sum()), int((np.diff(m.astype(int), prepend=0) == 1).sum()), hashlib.sha256(k).hexdigest()) for t, m, k in expected(LENGTH))
    got = digests(with_spans(docs, LENGTH, hot_rows)).collect()
    assert Counter(r.text for r in got) == Counter(k.decode("utf-8", "ignore") for _, _, k in expected(LENGTH))
    assert Counter((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def test_index_keeps_the_ends_of_runs_and_finds_all_matches():
    """Against brute force, on groups of copies with few differences; samples are far fewer than cells."""
    draw = np.random.default_rng(4)
    n, length, width = 120, 50, 130
    group = np.sort(draw.integers(0, 4, n))
    matrix = draw.integers(1, 5, (4, width)).astype(np.uint8)[group]
    for _ in range(60):
        matrix[draw.integers(n), draw.integers(width)] = 9
    begin, end = draw.integers(0, 30, n), draw.integers(100, width + 1, n)
    own = np.arange(width)
    matrix[(own < begin[:, None]) | (own >= end[:, None])] = 0
    index = ri.RunIndex(matrix, group, begin, end, length)
    got = np.zeros((n, width), bool)
    for row, first, stop in zip(*index.matches(), strict=True):
        got[row, first:stop] = True
    want = np.zeros((n, width), bool)
    for k in range(width - length + 1):
        inside = np.flatnonzero((begin <= k) & (end >= k + length))
        seen = Counter((group[i], matrix[i, k : k + length].tobytes()) for i in inside)
        want[inside, k] = [seen[group[i], matrix[i, k : k + length].tobytes()] > 1 for i in inside]
    assert (got == want).all() and want.any() and not want[:, 0].all()
    assert len(index.row) < n * width / 8


@pytest.mark.parametrize("hot_rows", [3, 40])
def test_a_passage_in_very_many_places(spark, hot_rows):
    """One passage with different neighbours, and groups of its variants, all of one anchor group."""
    draw = np.random.default_rng(8)
    some = lambda n: draw.integers(97, 123, n).astype(np.uint8).tobytes().decode()
    passage = some(160)
    texts = [some(int(draw.integers(0, 60))) + passage + some(int(draw.integers(0, 60))) for _ in range(60)]
    texts += [some(30) + passage[:70] + "#" + passage[71:] + some(9), passage[20:], some(5) + passage[:130]] * 2 + texts[:5]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: int(m.sum()) for i, m in enumerate(covered(texts, LENGTH))}
    assert {r.doc_id: r.n_removed for r in digests(with_spans(df, LENGTH, hot_rows)).collect()} == want


def test_passages_of_over_fifty_words_go_from_400_bytes_on(spark):
    """The query's limit is in bytes: 57 words that take 399 of them stay in every text, with one byte more they go."""
    draw = np.random.default_rng(11)
    some = lambda: " ".join(draw.integers(97, 123, 6).astype(np.uint8).tobytes().decode() for _ in range(57))
    stays, goes = some() + "x", some() + "xy"
    texts = [f"{k} before {k}{x}{k} after" for k, x in enumerate([stays[:399], stays[:399], goes[:400], goes[:400]])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.text) for r in digests(with_spans(df)).collect())
    assert got == [(k, len(t), 0, t) if k < 2 else (k, len(t), 400, f"{k} before {k}{k} after") for k, t in enumerate(texts)]


def test_texts_keep_whole_characters_and_other_columns(docs):
    want = Counter()
    for t, m, _ in expected(LENGTH):
        at = np.cumsum([0] + [len(c.encode()) for c in t])
        want["".join(c for c, a, b in zip(t, at, at[1:], strict=False) if not m[a:b].all())] += 1
    got = without_repeats(docs, LENGTH)
    assert got.columns == docs.columns
    rows = got.collect()
    assert Counter(r.text or "" for r in rows) == want
    assert all(r.n_chars == len(r.text) for r in rows if r.text is not None) and {r.node for r in rows} == {"a"}


def test_no_rows_and_short_texts(spark, no_docs):
    assert digests(with_spans(no_docs)).count() == 0 and without_repeats(no_docs).count() == 0
    short = spark.createDataFrame([(1, "same"), (2, "same"), (3, None)], "doc_id long, text string")
    assert {r.n_removed for r in digests(with_spans(short)).collect()} == {0}


def test_periodic_and_nul_bytes(spark):
    texts = ["ab" * 300, "\0" * 150, "\0" * 99 + "x", "ba" * 60, "y" + "\0" * 100, "é" * 80]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: int(m.sum()) for i, m in enumerate(covered(texts, LENGTH))}
    assert {r.doc_id: r.n_removed for r in digests(with_spans(df, LENGTH)).collect()} == want


def test_stretches_of_a_long_text_have_the_same_anchors():
    data = np.random.default_rng(3).integers(97, 100, 5000).astype(np.uint8)
    whole = {tuple(x) for x in np.column_stack(ri.anchors(data, np.array([0, 5000]), 400)[1:]).tolist()}
    windows = {p: (h, a) for h, a, lo, hi in whole for p in range(lo, hi + 1)}
    for at in range(0, 4601, 1000):
        part = data[at : at + 1399]
        for h, a, lo, hi in np.column_stack(ri.anchors(part, np.array([0, len(part)]), 400)[1:]).tolist():
            assert all(windows[at + p] == (h, at + a) for p in range(lo, hi + 1))


@pytest.mark.parametrize("hot_rows", [20_000, 1])
def test_repeats_across_the_ends_of_stretches(spark, hot_rows):
    draw = np.random.default_rng(6)
    some = lambda n: draw.integers(97, 123, n).astype(np.uint8).tobytes().decode()
    texts = [some(3600), some(700)]
    for k, at in enumerate(range(1000, 3600, 500)):
        texts += [some(40) + texts[0][at - 20 - 10 * k : at + 110] + some(30)]
    texts += [texts[0][:1500] + some(20) + texts[0][1400:2600], ""]
    df = spark.createDataFrame([*enumerate(texts), (1, texts[1])], "doc_id long, text string")
    masks = covered([*texts, texts[1]], LENGTH)
    want = Counter((i, int(m.sum())) for i, m in zip([*range(len(texts)), 1], masks, strict=True))
    assert Counter((r.doc_id, r.n_removed) for r in digests(with_spans(df, LENGTH, hot_rows, 500)).collect()) == want


@pytest.mark.parametrize("hot_rows", [20_000, 2])
def test_joins_leave_the_texts_where_they_are(docs, hot_rows):
    """Every exchange in the plans of the results moves keys, spans or cut strings; the texts are read in their buckets."""
    for result in (without_repeats(docs, LENGTH, hot_rows), with_spans(docs, LENGTH, hot_rows)):
        plan = result._jdf.queryExecution().executedPlan().toString()
        scans = [x for x in plan.split("\n") if "FileScan" in x and "dealt_texts" in x]
        assert len(scans) > 1 and all("Bucketed: true" in x for x in scans)
        assert not [x for x in plan.split("\n") if "Exchange" in x and "doc_id" in x and "text" in x.replace("text_hash", "")]


def test_stretches_of_known_pieces_are_put_together():
    """Rows for the pieces that stand and one for what a text's known ones cover, not one for every piece."""
    text, start, size = ri.joint(np.array([1, 0, 0, 0, 1]), np.array([5, 40, 0, 10, 7]), np.array([9, 50, 12, 20, 8]))
    assert np.column_stack([text, start, size]).tolist() == [[0, 0, 20], [0, 40, 10], [1, 5, 4]]
    assert [len(x) for x in ri.joint(*np.zeros((3, 0), np.int64))] == [0, 0, 0]


def test_copies_of_a_piece_make_few_rows(spark):
    passage = "".join(chr(97 + k * k % 23) for k in range(700))
    runs = "array(struct(7L AS parent, 0 AS first, 0 AS start, 600 AS n))"
    rows = spark.createDataFrame([(k, k, passage) for k in range(50)], "doc_id long, text_hash long, text string").coalesce(1)
    got = ri.pieces(rows.selectExpr("*", f"{runs} AS runs"), LENGTH, 32).collect()
    assert len(got) == 50 + 19 and sum(r.stands for r in got) == 19
    assert {(r.start, r.n) for r in got if not r.stands} == {(0, 600)}
