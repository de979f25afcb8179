"""The queries over what is learnt, over the driver's smallest tables, against plain versions."""

import os
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from shiftloom.functions.text import GENRE_TOKENS
from shiftloom.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
MODEL = {"user": "base", "assistant": "sft"}


def table(sql):
    return duckdb.sql(sql.replace("FROM ", f"FROM '{SF}/", 1).replace("CONV", "conversations.parquet'")).fetchall()


@pytest.fixture(scope="module")
def passages():
    rows = table("SELECT conv_id, turn, role, text FROM CONV")
    return {c * 4096 + t: (c % 6, MODEL.get(r, "dpo"), x) for c, t, r, x in rows}


@pytest.fixture(scope="module")
def vectors(spark, passages):
    rows = catalog.QUERIES["passage_embeddings"](spark, SF).collect()
    assert {(r.gen_id, r.label, r.model) for r in rows} == {(i, label, model) for i, (label, model, _) in passages.items()}
    return {r.gen_id: np.array(r.vec) for r in rows}


def test_like_passages_have_like_vectors(passages, vectors):
    """Passages of one conversation are of one language, so they are nearer to each other than to others."""
    ids = sorted(vectors)
    v = np.array([vectors[i] for i in ids])
    conv = np.array([i // 4096 for i in ids])
    sim = v @ v.T
    same = (conv[:, None] == conv[None, :]) & ~np.eye(len(ids), dtype=bool)
    assert np.allclose((v * v).sum(1), 1, atol=1e-3) and sim[same].mean() > sim[conv[:, None] != conv[None, :]].mean() + 0.1


def test_metrics_are_those_of_the_vectors(spark, passages, vectors):
    got = {r.label: r for r in catalog.QUERIES["embedded_generation_metrics"](spark, SF).collect()}
    groups = defaultdict(list)
    for i, (label, model, _) in passages.items():
        groups[label, model].append(vectors[i])
    assert set(got) == {label for label, _ in groups}
    for label, r in got.items():
        base, sft = (np.array(groups[label, m]) for m in ("base", "sft"))
        assert abs(r.distance_sft - np.linalg.norm(base.mean(0) - sft.mean(0))) < 1e-3
        for m, x in (("base", base), ("sft", sft)):
            d = np.linalg.norm(x - x.mean(0), axis=1)
            cos = x @ x.T
            n = len(x)
            assert abs(r[f"variance_{m}"] - d.var()) < 1e-3 and abs(r[f"cosine_{m}"] - (cos.sum() - np.trace(cos)) / (n * (n - 1))) < 1e-3


def test_concept_scores_order_and_shift(spark, passages):
    scores = {(r.label, r.model, r.axis): r.mean_score for r in catalog.QUERIES["embedded_concept_scores"](spark, SF).collect()}
    assert Counter(a for _, _, a in scores)["quality"] == len({(x, m) for x, m, _ in passages.values()}) and {a for _, _, a in scores} == {"quality", "toxic"}
    shift = {(r.label, r.axis): r["shift"] for r in catalog.QUERIES["embedded_concept_shift"](spark, SF).collect()}
    for (label, axis), x in shift.items():
        last = scores.get((label, "dpo", axis), scores.get((label, "sft", axis)))
        assert abs(x - (last - scores[label, "base", axis])) < 2e-6


def test_taxonomy_by_word_classes(spark):
    classes = {(r.prompt, r.word): (f"C{r.cls}", r.n) for r in catalog.QUERIES["word_classes"](spark, SF).collect()}
    total = sum(n for _, n in classes.values())
    often = Counter()
    for (_, word), (_, n) in classes.items():
        often[word] += n
    pairs = catalog.QUERIES["taxonomy_class_pairs"](spark, SF).collect()
    assert len(pairs) > 20 and len({k for k, _ in classes.values()}) > 3
    kinds = Counter()
    for r in pairs:
        assert r.source_pos == classes[r.prompt, r.source][0]
        if r.target is None:
            want = "genre_change"
        else:
            pos, freq = classes[r.prompt, r.target][0], np.log10(often[r.target] / total * 1e9)
            assert r.target_pos == pos and abs(r.target_freq - freq) < 2e-6
            want = "genre_change" if r.target in GENRE_TOKENS else "archaic" if freq < 3 else "register_shift" if pos == r.source_pos else "category_shift"
        assert r.displacement_type == want
        kinds[r.axis, want] += 1
    sums = Counter()
    for (axis, _), n in kinds.items():
        sums[axis] += n
    assert {(r.axis, r.displacement_type): (r.n, r.pct) for r in catalog.QUERIES["taxonomy_class_pct"](spark, SF).collect()} == {k: (n, pytest.approx(100 * n / sums[k[0]], abs=1e-5)) for k, n in kinds.items()}


def test_token_queries_equal_a_plain_model(spark):
    from .test_token_words import Plain

    plain = Plain(duckdb.sql(f"SELECT lang, text FROM '{SF}/documents.parquet'").fetchall())
    found = defaultdict(dict)
    for r in catalog.QUERIES["token_discover_words"](spark, SF).collect():
        found[r.prompt][r.word] = r.prob
    for lang, words in found.items():
        want = plain.discover(lang, 200, 4)
        assert words.keys() == want.keys() and all(abs(p - want[w]) < 2e-6 for w, p in words.items())
    assert set(found) == set(plain.words)
    scores = {(r.prompt, r.word): r for r in catalog.QUERIES["token_word_logprobs"](spark, SF).collect()}
    first = {(r.prompt, r.word): r.prob for r in catalog.QUERIES["token_first_scores"](spark, SF).collect()}
    assert set(first) <= set(scores) and len({g for g, _ in scores}) == len(found)
    some = sorted(scores)[:: max(1, len(scores) // 60)]
    assert all(abs(scores[k].logp - plain.logp(*k)) < 1e-5 for k in some)
