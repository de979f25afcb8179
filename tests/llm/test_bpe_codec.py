import hashlib
import random
import struct

import numpy as np
import pytest
from tokenizers import Tokenizer

from shiftloom.llm.bpe_codec import TreeEncoder, default_path, encode_documents
from shiftloom.llm.chunk_encoder import ChunkEncoder, encode_long, library

ALPHABETS = ["ab", "abcdefghijklmnopqrstuvwxyz", "aé日", "!.-_=", "\n\t ", "a1 ", "the'sre  　 x", "aZ.,é!?'s×", "<|endoftext|> .A", "<|ENDOFTEXT|> .A"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_and_trees_give_the_librarys_ids(name):
    lib = Tokenizer.from_file(default_path(name))
    coder = ChunkEncoder(default_path(name), folded=name.startswith("word"))
    rng = random.Random(1)
    for k in range(150):
        text = "".join(rng.choice(rng.choice(ALPHABETS)) for _ in range(rng.randint(0, 400)))
        if k % 3 == 0:
            text = text[:100] + "<|endoftext|>" + text[100:]
        want = lib.encode(text, add_special_tokens=False).ids
        data = np.frombuffer(text.encode(), np.uint8)
        got, bounds = coder.encode(data, np.array([0, len(data)]))
        assert got.tolist() == want and bounds.tolist() == [0, len(want)]
        if name.startswith("byte"):
            assert encode_long(lib, text, leaf=rng.choice([1, 7, 32])) == want


def test_trees_join_leaves_to_the_librarys_ids():
    """Many small leaves, cut anywhere; words, long runs without a space, special tokens across leaves."""
    path = default_path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    rng = random.Random(2)
    for leaf in (16, 40, 200):
        coder = TreeEncoder(path, leaf)
        texts = []
        for k in range(60):
            text = "".join(rng.choice(rng.choice(ALPHABETS)) if k % 2 else rng.choice(["the ", "dog.", "Ünïted", "s ", "  ", "it's ", "\n\n", "日本", "aaaa"]) for _ in range(rng.randint(0, 500)))
            texts.append(text[:100] + "<|endoftext|>" + text[100:] if k % 3 == 0 else text)
        raw = [t.encode() for t in [*texts, "", "x" * 7000, "日" * 900]]
        got, bounds = coder.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(x) for x in raw]))
        for x, a, b in zip(raw, bounds[:-1], bounds[1:], strict=True):
            assert got[a:b].tolist() == lib.encode(x.decode(), add_special_tokens=False).ids
        assert coder.joins >= sum(len(x) for x in raw) // (2 * leaf) and coder.grown > 0


def test_documents_are_joined_from_leaves(spark, docs):
    """Every text of more than one leaf goes through the tree."""
    texts = [(r.text or "").encode() for r in docs.collect()]
    coder = TreeEncoder(default_path("byte_bpe_50k.json"))
    coder.encode(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(x) for x in texts]))
    assert coder.joins >= sum(-(-len(x) // 512) - 1 for x in texts) > 50


def test_codes_every_row(spark, docs, no_docs):
    lib = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    got = encode_documents(docs, default_path("byte_bpe_50k.json")).collect()
    want = []
    for r in docs.collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id is None, r.doc_id, len(ids), struct.pack(f"<{len(ids)}I", *ids), lib.decode(ids, skip_special_tokens=False)))
    order = lambda x: (x[0], x[1] or 0, x[4])
    assert sorted([(r.doc_id is None, r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in got], key=order) == sorted(want, key=order)
    digest = {r.doc_id: r for r in encode_documents(docs, default_path("byte_bpe_50k.json"), digest=True).collect()}
    assert digest[0].decoded_sha256 == hashlib.sha256(docs.where("doc_id = 0").first().text.encode()).hexdigest()
    assert encode_documents(no_docs, default_path("byte_bpe_50k.json")).count() == 0


def test_new_words_go_through_the_library_many_at_a_time():
    """Ids are the library's, and so are those of words that are met again, alone."""
    path = default_path("byte_bpe_50k.json")
    coder, given = ChunkEncoder(path), []

    class Recorded:
        def encode_batch_fast(self, texts, **options):
            given.extend(texts)
            return library(path).encode_batch_fast(texts, **options)

    coder.lib = Recorded()
    texts = [" ".join(f"ré{k}x<|endoftext|>don't  \n{k * k}　y" for k in range(1000)), "", "".join(f" w{k}" for k in range(3000, 0, -1))]
    for part in (texts, texts[::-1], [f" w{k}" for k in range(50)]):
        raw = [t.encode() for t in part]
        ids, bounds = coder.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [e.ids for e in library(path).encode_batch_fast(part, add_special_tokens=False)]
    assert sum(" w7 " in f"{t} " for t in given) == 1 and len([t for t in given if " w" in t]) < 100
