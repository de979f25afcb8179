import pytest

from shiftloom.llm import tiered_search

from . import plain

ITEMS = "item_id long, text string, doc_id string, score string"


@pytest.fixture(scope="module")
def items(spark, docs):
    said = [r.text for r in docs.select("text").collect() if r.text and len(r.text.split()) > 8]
    rows = [(k, " ".join(t.split()[2:9] + t.split()[:3]), "x", "y") for k, t in enumerate(said[:12])]
    rows += [(50, "x" * 9000, "", ""), (51, None, "", ""), (52, "", "", ""), (53, "no such words here", "", ""), (54, "TI ti Ti! don't", "", ""), (0, rows[0][1], "", ""), (54, "one", "", ""), (None, "one", "", "")]
    return spark.createDataFrame(rows, ITEMS).cache()


def answers(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=repr)


@pytest.mark.parametrize("tiers", [tiered_search.TIERS, (1, 3), (0, 0), (4, 4, 12)])
def test_equals_all_scores_whatever_the_tiers(docs, items, tiers):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = plain.search(rows, sorted({(r.item_id, r.text) for r in items.collect()}, key=repr))
    assert answers(tiered_search.search(docs, items, tiers)) == want


def test_blocks_of_items_answer_as_one(docs, items):
    assert answers(tiered_search.search(docs, items, (2, 5), block_bytes=2000)) == answers(tiered_search.search(docs, items))


def test_some_items_fall_through_and_some_do_not(spark, docs, items, monkeypatch):
    levels = []
    proven = tiered_search.proven
    monkeypatch.setattr(tiered_search, "proven", lambda *a: levels.append(proven(*a)) or levels[-1])
    tiered_search.search(docs, items, (2, 9)).collect()
    assert len(set(levels[0][0].tolist())) > 1


def test_empty_tables(spark, docs, no_docs, items):
    assert tiered_search.search(no_docs, items).count() == 0 and tiered_search.search(docs, items.where("false")).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, " ,. ")], "doc_id long, text string")
    assert tiered_search.search(nothing, items).count() == 0
