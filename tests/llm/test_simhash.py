import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from shiftloom.llm.components import components, unite
from shiftloom.llm import near_copies
from shiftloom.llm.near_copies import without_near_copies
from shiftloom.llm.simhash_trie import Tables, fingerprint_table, linked, majority_bits, three_word_digests, trie_join

from .conftest import corpus, words


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def test_fingerprints_bit_by_bit(docs):
    got = Counter((r.doc_id, r.w0) for r in fingerprint_table(docs.select("doc_id", "text"), three_word_digests, 1).collect())
    want = Counter()
    for i, t in corpus():
        w = (t or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        bits = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        want[(i, bits - (1 << 64) if bits >> 63 else bits)] += 1
    assert got == want


def test_majority_over_many_rows():
    digests = np.random.default_rng(1).integers(0, 256, (700, 2), np.uint8)
    counts = np.array([0, 699, 1])
    got = majority_bits(digests.tobytes(), counts, 2)
    bits = np.unpackbits(digests, axis=1)
    assert got.tolist() == [[0, 0], np.packbits(2 * bits[:699].sum(0) > 699).tolist(), digests[699].tolist()]


def near_prints(rng, n, words_):
    """Clusters of fingerprints a few bits apart."""
    out = []
    while len(out) < n:
        base = [rng.getrandbits(64) for _ in range(words_)]
        for _ in range(rng.randint(1, 12)):
            p = list(base)
            for _ in range(rng.randint(0, 4)):
                p[rng.randrange(words_)] ^= 1 << rng.randrange(64)
            out.append(tuple(p))
    return sorted(set(out))[:n]


@pytest.mark.parametrize("words_,budget,leaf", [(1, 2, 64), (1, 2, 1), (2, 6, 4), (1, 0, 1)])
def test_trie_finds_every_pair(words_, budget, leaf):
    rng = random.Random(words_ + budget)
    prints = np.array(near_prints(rng, 300, words_), np.uint64)
    found, n = set(), len(prints)
    trie_join(prints, np.array([[0, n, 0, n]]), budget, lambda a, b: found.update(zip(a.tolist(), b.tolist(), strict=True)), leaf, most=50)
    values = [sum(int(x) << 64 * k for k, x in enumerate(p)) for p in prints]
    assert found == {(i, j) for i in range(n) for j in range(i + 1, n) if (values[i] ^ values[j]).bit_count() <= budget}


@pytest.mark.parametrize("hot_rows", [20_000, 8])
def test_links_connect_what_all_pairs_connect(spark, hot_rows):
    """With few rows a key, and with nearly every key dealt out further."""
    rng = random.Random(9)
    prints = np.array(near_prints(rng, 250, 1), np.uint64)[:, 0]
    # A block that all share makes one key hold everything.
    prints = np.unique((prints & np.uint64((1 << 43) - 1)) | np.uint64(0x2A << 43))
    signed = prints.view(np.int64).tolist()
    nodes = spark.createDataFrame([(x, x) for x in signed], "node long, w0 long")
    got = {r.node: r.root for r in components(linked(nodes, Tables.blocks(64, 2), hot_rows)).collect()}
    order = sorted(range(len(signed)), key=lambda i: signed[i])
    values = [int(prints[i]) for i in order]
    want = roots(len(values), [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 2])
    assert [got.get(signed[i], signed[i]) for i in order] == [signed[order[r]] for r in want]


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(200, 200)] + [(300, 301), (301, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 160)) and got[301] == got[300] == 300 and 200 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    parent = unite(np.arange(6), np.array([5, 3, 4]), np.array([3, 1, 2]))
    assert parent.tolist() == [0, 1, 2, 1, 2, 1]


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def alike(a, b):
    return not a and not b or bool(a | b) and len(a & b) >= 0.8 * len(a | b)


@pytest.mark.parametrize("block", [1024, 3])
def test_one_row_of_each_group_of_near_copies_stays(spark, docs, no_docs, monkeypatch, block):
    """With clusters of one block, and dealt to pairs of blocks."""
    monkeypatch.setattr(near_copies, "BLOCK", block)
    rng = random.Random(3)
    rows = []
    for g in range(6):
        base = words(rng, 150).split()
        for k in range(7):
            copy = list(base)
            for _ in range(k):
                copy[rng.randrange(150)] = words(rng, 1)
            rows.append((1000 + 10 * g + k, " ".join(copy)))
    extra = spark.createDataFrame([(i, t, "en", "s", len(t), "a", "b", "c", 1, "d") for i, t in rows], docs.schema)
    all_ = [*corpus(), *rows]
    sets = [shingle_set(t) for _, t in all_]
    group = roots(len(all_), [(i, j) for i in range(len(all_)) for j in range(i) if alike(sets[i], sets[j])])
    members = defaultdict(list)
    for (i, _), g in zip(all_, group, strict=True):
        members[g].append(i)
    want = Counter(min((i for i in m if i is not None), default=None) for m in members.values())
    got = without_near_copies(docs.unionByName(extra))
    assert got.columns == docs.columns and Counter(r.doc_id for r in got.collect()) == want
    assert without_near_copies(no_docs).count() == 0


def test_appended_truncated_and_replaced_copies_are_found(spark, docs):
    """Contiguous edits that leave a likeness of just over and just under 0.8, and a passage that many texts share."""
    rng = random.Random(21)
    rows, passage = [], words(rng, 60)
    for g in range(60):
        base = words(rng, rng.randint(40, 220)).split()
        n = len(base)
        cut = lambda lo, hi, n=n: max(1, round(n * rng.uniform(lo, hi)))
        at = rng.randrange(n // 2)
        k = cut(0.06, 0.11)
        copies = [[*base, *words(rng, cut(0.15, 0.28)).split()], base[: n - cut(0.12, 0.22)], [*base[:at], *words(rng, k).split(), *base[at + k :]]]
        rows += [(10 * g + i, " ".join(x)) for i, x in enumerate([base, *copies])] + [(10 * g + 5, f"{words(rng, 20)} {passage}")]
    sets = [shingle_set(t) for _, t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if alike(sets[i], sets[j])]
    want = Counter(min(rows[i][0] for i, g in enumerate(group) if g == root) for group in [roots(len(rows), near)] for root in set(group))
    df = spark.createDataFrame([(i, t, "en", "s", len(t), "a", "b", "c", 1, "d") for i, t in rows], docs.schema)
    assert len(near) > 60 and Counter(r.doc_id for r in without_near_copies(df).collect()) == want


def test_empty_fingerprints_link(spark):
    df = spark.createDataFrame([(4, None), (2, " "), (9, "a b c d")], "doc_id long, text string")
    assert {r.w0 for r in fingerprint_table(df, three_word_digests, 1).where(F.col("doc_id") < 5).collect()} == {0}
