import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

from shiftloom.llm.bpe_codec import default_path
from shiftloom.llm.histogram_packing import pack_documents, plan_slots
from shiftloom.llm.token_output import best_fit_decreasing, packed_sequences, write_matrices


def plain_bfd(lengths, capacity):
    bins = []
    for x in sorted(lengths, reverse=True):
        fits = [b for b in bins if b >= x]
        if fits:
            bins.remove(min(fits))
            bins.append(min(fits) - x)
        else:
            bins.append(capacity - x)
    return len(bins)


def test_both_planners_do_best_fit_decreasing():
    rng = random.Random(2)
    for _ in range(80):
        capacity = rng.choice([10, 64, 2048])
        lengths = np.array([rng.randint(1, capacity) for _ in range(rng.randint(1, 200))])
        bins = plain_bfd(lengths.tolist(), capacity)
        placed = best_fit_decreasing(lengths, capacity)
        assert np.bincount(placed, weights=lengths).max() <= capacity and placed.max() + 1 == bins
        counts, held = Counter(lengths.tolist()), defaultdict(list)
        for length, _, n, first, offset in plan_slots(counts, capacity).tolist():
            for i in range(n):
                held[first + i].append((offset, length))
        assert sum((Counter(x for _, x in v) for v in held.values()), Counter()) == counts and len(held) <= bins + 1
        for v in held.values():
            at = 0
            for offset, length in sorted(v):
                assert offset == at
                at += length
            assert at <= capacity
    assert len(plan_slots({})) == 0


def test_packs_every_document(spark, docs, no_docs):
    lib = Tokenizer.from_file(default_path("word_bpe_49k.json"))
    want = Counter()
    for r in docs.collect():
        ids = [*lib.encode(r.text or "", add_special_tokens=False).ids, 0]
        for p, start in enumerate(range(0, len(ids), 2048)):
            piece = ids[start : start + 2048]
            want[(r.doc_id, p, start, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()))] += 1
    rows = pack_documents(docs).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for v in held.values():
        ends = [a + n for a, n in sorted(v)]
        assert [a for a, _ in sorted(v)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert pack_documents(no_docs).count() == 0


def test_matrices_hold_the_documents(spark, docs, no_docs, tmp_path):
    lib = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    packed = packed_sequences(docs, default_path("byte_bpe_50k.json"), capacity=512, window_tokens=3000)
    write_matrices(packed, str(tmp_path / "m"))
    pieces = defaultdict(list)
    for r in spark.read.parquet(str(tmp_path / "m")).collect():
        ids, places = np.frombuffer(r.input_ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == 512 and r.cu_seqlens[-1] == r.n_tokens and not ids[r.n_tokens :].any()
        for doc, piece, a, b in zip(r.doc_ids, r.pieces, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
            assert places[a:b].tolist() == list(range(b - a))
            pieces[doc].append((piece, ids[a:b].tolist()))
    for r in docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).collect():
        ids = [*lib.encode(r.text or "", add_special_tokens=False).ids, 50256]
        own = sorted(pieces[r.doc_id])
        copies = len(own) // -(-len(ids) // 512)
        assert sum((p for _, p in own[::copies]), []) == ids
    assert packed_sequences(no_docs, default_path("byte_bpe_50k.json")).count() == 0
