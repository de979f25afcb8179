import re

import pytest

from shiftloom.llm.decontamination import decontaminated, matched, window_hashes
from shiftloom.llm.words import words_of_texts

from . import plain

ITEMS = "item_id long, text string, spans string"


@pytest.fixture(scope="module")
def items(spark, docs):
    said = [r.text for r in docs.select("text").collect() if r.text and len(r.text.split()) > 30]
    rows = [(k, "~~".join(t.split()[k : k + 12 + k]).upper(), "a") for k, t in enumerate(said[:8])]
    rows += [(90, "one", ""), (91, "x" * 9000, ""), (92, None, ""), (93, "", ""), (94, " ,.", ""), (0, " ".join(said[9].split()[3:16]), ""), (None, " ".join(said[10].split()[:11]), ""), (1, rows[1][1], ""), (95, "nothing of this is there", ""), (96, "日本", "")]
    return spark.createDataFrame(rows, ITEMS).cache()


def key(row):
    return repr((row.doc_id, row.text))


@pytest.mark.parametrize("window,block", [(10, 1 << 20), (4, 1 << 20), (10, 3000)])
def test_equals_plain_windows(docs, items, window, block):
    out, (n_words, spans, found) = matched(docs, items, window, block_bytes=block)
    asked, got = [(r.item_id, r.text) for r in items.collect()], sorted(out.collect(), key=key)
    assert out.columns == [*docs.columns, n_words, spans, found] and spans == "_spans" and len(got) == docs.count()
    some = 0
    for r in got:
        words, hit, names = plain.leaks(r.text, asked, window)
        assert (r[n_words], r[found]) == (len(words), names)
        marked = [False] * len(words)
        for x in r[spans]:
            marked[x["first"] : x["last"]] = [True] * (x["last"] - x["first"])
            assert plain.TERM.findall(plain.low(r.text.encode()[x["start"] : x["end"]].decode())) == words[x["first"] : x["last"]]
        assert marked == hit
        some += any(hit)
    assert 5 < some < len(got)


def test_spans_or_documents_go(docs, items):
    asked = [(r.item_id, r.text) for r in items.collect()]
    want, kept = [], []
    for r in docs.collect():
        text, at = r.text or "", 0
        _, hit, _ = plain.leaks(text, asked)
        if not any(hit):
            kept.append(text)
        out, before = [], False
        for m, h in zip(plain.TERM.finditer(text), hit, strict=True):
            if not (h and before):
                out.append(text[at : m.start()])
            if not h:
                out.append(m[0])
            at, before = m.end(), h
        want.append("".join(out) + text[at:])
    got = decontaminated(docs, items)
    assert got.columns == docs.columns and sorted(r.text for r in got.collect()) == sorted(want)
    assert sorted(r.text for r in decontaminated(docs, items, drop_documents=True).collect()) == sorted(kept)


def test_empty_tables(docs, no_docs, items):
    assert decontaminated(no_docs, items).count() == 0
    same = decontaminated(docs, items.where("false"))
    assert sorted(r.text for r in same.collect()) == sorted(r.text or "" for r in docs.collect())


def test_words_and_windows_hash_alike_wherever_they_stand():
    low, starts, ends, hashes, bounds = words_of_texts(["Aé b,c", "", "c" * 3000 + " aÉ B~C", "aé", "b"])
    words = [low.tobytes()[a:b].decode() for a, b in zip(starts, ends, strict=True)]
    assert words == ["aé", "b", "c", "c" * 3000, "aÉ", "b", "c", "aé", "b"] and bounds.tolist() == [0, 3, 3, 7, 8, 9]
    assert hashes[0] == hashes[7] and hashes[1] == hashes[5] == hashes[8] and hashes[2] == hashes[6] and len(set(hashes.tolist())) == 5
    assert (window_hashes(hashes, 2)[[1, 5]] == window_hashes(hashes[1:3], 2)[0]).all() and len(window_hashes(hashes, 10)) == 0
    assert re.match(r"^\w+$", words[0])
