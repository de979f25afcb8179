"""The registered queries over the driver's smallest tables, each against a brute-force version."""

import hashlib
import math
import os
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from shiftloom.llm.bpe_codec import default_path
from shiftloom.llm.quality_qda import FLOOR, SHRINK, statistics
from shiftloom.llm.registry import QUERIES

from . import plain

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


def table(name, columns):
    return duckdb.sql(f"SELECT {columns} FROM '{SF}/{name}.parquet' ORDER BY 1").fetchall()


@pytest.fixture(scope="module")
def texts():
    return {i: t or "" for i, t in table("documents", "doc_id, text")}


def rest(i, n=5):
    return zlib.crc32(str(i).encode()) % n


def roots(names, links):
    parent = {x: x for x in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in names}


def run(spark, name):
    return QUERIES[name](spark, SF).collect()


def test_op1_ranks_as_a_plain_discriminant_does(spark, texts):
    raw = [t.encode() for t in texts.values()]
    x = dict(zip(texts, statistics(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])), strict=True))
    labels = [(i, y) for i, y in table("labels", "doc_id, quality") if rest(i) and i in x and y in (0, 1)]
    part = [np.array([x[i] for i, y in labels if y == c]) for c in (0, 1)]
    every = np.concatenate(part)
    p = every.shape[1]
    within = sum(np.cov(a.T, bias=True) * len(a) for a in part) / len(every)
    common = np.diag(within) + FLOOR * np.maximum(every.var(0), 1e-6)

    def density(at, a):
        weight = max(SHRINK, (p + 2) / (len(a) + p + 2))
        cov = (1 - weight) * np.cov(a.T, bias=True) + weight * np.diag(common)
        d = at - a.mean(0)
        return -0.5 * (d @ np.linalg.solve(cov, d)) - 0.5 * np.linalg.slogdet(cov)[1]

    got = {r.doc_id: r for r in run(spark, "op1_quality_qda")}
    want = {i: density(v, part[1]) - density(v, part[0]) for i, v in x.items()}
    order = sorted(want, key=want.get)
    scores = np.array([got[i].score for i in order])
    assert set(got) == set(texts) and (np.diff(scores) >= -1e-9).all() and all(r.held_out == (rest(i) == 0) and r.predicted == (r.score >= 0.3) for i, r in got.items())


def test_op2_links_what_all_pairs_link(spark):
    vectors = {i: np.array(v, float) for i, v in table("embeddings", "vec_id, embedding") if v is not None and None not in v}
    ids = [i for i, v in vectors.items() if np.isfinite(v).all() and v.any()]
    unit = np.array([vectors[i] / np.linalg.norm(vectors[i]) for i in ids])
    links = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(unit @ unit.T >= 0.9, 1)), strict=True)]
    many = Counter(x for pair in links for x in pair)
    root = roots([i for i, _ in table("embeddings", "vec_id, 1")], links)
    got = run(spark, "op2_e8_lattice")
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {i: (many[i], c, c == i) for i, c in root.items()}


def test_op3_counts_exactly_and_beats_the_base(spark, texts):
    words = {i: [*t.encode().lower().split(), None] for i, t in texts.items()}
    c = Counter(w for i, x in words.items() if rest(i) != 1 for w in x)
    n, divisor = sum(c.values()), sum(c.values()) + 0.5 * (len(c) + 1)
    got = {r.doc_id: r for r in run(spark, "op3_bloom_lm")}
    for i, x in words.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (rest(i) == 1, len(x), sum(w in c for w in x), n)
        assert abs(r.base_score - sum(math.log10((c[w] + 0.5) / divisor) for w in x)) < 1e-6 * len(x)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_op4_packs_the_librarys_ids(spark, texts):
    lib = Tokenizer.from_file(default_path("word_bpe_49k.json"))
    want, total = {}, 0
    for i, t in texts.items():
        ids = [*lib.encode(t, add_special_tokens=False).ids, 0]
        total += len(ids)
        for p, at in enumerate(range(0, len(ids), 2048)):
            want[i, p] = (at, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes()))
    got = run(spark, "op4_histogram_packing")
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for v in held.values():
        ends = np.cumsum([n for _, n in sorted(v)]).tolist()
        assert [a for a, _ in sorted(v)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(held) <= -(-total // 2048) + 1


def test_op5_codes_as_the_library(spark, texts):
    lib = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = {}
    for i, t in texts.items():
        ids = lib.encode(t, add_special_tokens=False).ids
        want[i] = (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(lib.decode(ids, skip_special_tokens=False).encode()))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in run(spark, "op5_bpe_codec")} == want


def test_op6_matrices_hold_every_id(spark, texts):
    lib = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    pieces = defaultdict(dict)
    for r in run(spark, "op6_token_output"):
        ids, places = np.frombuffer(r.input_ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(places) == 2048 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and not ids[r.n_tokens :].any()
        for doc, piece, a, b in zip(r.doc_ids, r.pieces, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
            assert places[a:b].tolist() == list(range(b - a))
            pieces[doc][piece] = ids[a:b].tolist()
    for i, t in texts.items():
        assert sum((pieces[i][k] for k in sorted(pieces[i])), []) == [*lib.encode(t, add_special_tokens=False).ids, 50256]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def sketch(text):
    """The 128 least hashes of five-word shingles, words hashed first, each hash the seed of the next."""
    words = [w for w in text.replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    hashed = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    out = set()
    for part in [hashed[k : k + 5] for k in range(max(1, len(hashed) - 4))] if hashed else []:
        seed = 42
        for h in part:
            seed = xxhash.xxh64_intdigest(h.to_bytes(8, "little"), seed)
        out.add(signed(seed))
    return sorted(out)[:128]


def likeness(a, b):
    both = sorted({*a, *b})[:128]
    return 1.0 if not a and not b else len(set(both) & set(a) & set(b)) / max(1, len(both))


def test_op7_equals_plain_bottom_k(spark, texts):
    ids = sorted(texts)
    got = {r.doc_id: r for r in run(spark, "op7_fingerprints")}
    printed = lambda s: "".join(f"{x % (1 << 64):016x}" for x in s)
    for k, i in enumerate(ids):
        text, after = texts[i], texts[ids[(k + 1) % len(ids)]]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        a, e, n = sketch(text), sketch(edited), sketch(after)
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(text), hashlib.sha256(edited.encode()).hexdigest(), printed(a), printed(e))
        assert abs(r.near_edited - likeness(a, e)) < 1e-9 and abs(r.near_next - likeness(a, n)) < 1e-9


def test_op8_turns_read_back(spark):
    turns = defaultdict(list)
    for conv, turn, role, text in table("conversations", "conv_id, turn, role, text"):
        turns[conv].append((turn, role or "", text or ""))
    said = "</s>[INST] ok [/INST]"
    turns[-1] = [(0, "user", said), (1, "assistant", said)]
    got = {r.conv_id: r for r in run(spark, "op8_chat_events")}
    assert set(got) == set(turns)
    for conv, rows in turns.items():
        rows.sort()
        learnt = "".join(t for _, r, t in rows if r == "assistant")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert (got[conv].n_turns, got[conv].turns_sha256, got[conv].loss_chars, got[conv].loss_sha256) == (len(rows), sha("".join(f"{r}\n{t}\n" for _, r, t in rows)), len(learnt), sha(learnt))


def test_op9_links_what_all_pairs_link(spark, texts):
    def print_of(text):
        words = text.encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 3]), 42) for k in range(max(1, len(words) - 2))] if words else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    prints = {i: print_of(t) for i, t in texts.items()}
    ids = sorted(prints)
    root = roots(ids, [(a, b) for k, a in enumerate(ids) for b in ids[:k] if (prints[a] ^ prints[b]).bit_count() <= 2])
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in run(spark, "op9_simhash_trie")} == {i: (f"{prints[i]:016x}", root[i]) for i in ids}


def test_op10_removes_what_starts_twice(spark, texts):
    raw = {i: t.encode() for i, t in texts.items()}
    seen = Counter(hash(r[k : k + 400]) for r in raw.values() for k in range(len(r) - 399))
    got = {r.doc_id: r for r in run(spark, "op10_repeat_index")}
    for i, r in raw.items():
        gone = np.zeros(len(r) + 1, bool)
        for k in range(len(r) - 399):
            if seen[hash(r[k : k + 400])] > 1:
                gone[k : k + 400] = True
        kept = bytes(np.frombuffer(r, np.uint8)[~gone[:-1]])
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans) == (len(r), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()))
        assert got[i].kept_sha256 == hashlib.sha256(kept).hexdigest() and got[i].text == kept.decode("utf-8", "ignore")


def test_op11_ranks_as_all_scores_do(spark):
    got = sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in run(spark, "op11_tiered_search")), key=repr)
    assert got == plain.search(table("documents", "doc_id, text"), table("benchmark", "item_id, text"))


def test_op12_hits_what_windows_hit(spark):
    items = table("benchmark", "item_id, text")
    got = {r.doc_id: r for r in run(spark, "op12_window_leaks")}
    for i, text in table("documents", "doc_id, text"):
        words, hit, names = plain.leaks(text, items)
        r = got.pop(i)
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(words), sum(hit), len(names), plain.sha(",".join(names)), any(hit))
    assert not got


def test_op13_repairs_as_all_edits_do(spark):
    kept = plain.damaged(table("conversations", "conv_id, turn, role, text"))
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in run(spark, "op13_lattice_repair")}
    assert got == {c: plain.repaired(sorted(rows, key=lambda r: r[0])) for c, rows in kept.items()}
