import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from shiftloom.functions.text import DISCOVERED_STRIP
from shiftloom.operators import token_words
from shiftloom.sources import tokenizer

pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")
PATH = tokenizer.default_path()
TEXTS = [("en", "The dog's unbelievable houseboat! The dog sees the houseboats, 日本 and don't stop."), ("en", "the cat; THE catastrophe  unbelievably the cat"), ("fr", "Étion dans le çouelle, étion éaile le"), (None, "x x y"), ("en", None), ("en", ""), ("fr", "le " * 300 + "çouelle"), ("en", "qz" * 400)]


@pytest.fixture(scope="module")
def counts(spark):
    texts = spark.createDataFrame([(g, t, "a") for g, t in TEXTS], "lang string, text string, grp string").repartition(3)
    return token_words.counted(texts, "lang", "text", PATH).cache()


class Plain:
    """The same model, word by word."""

    def __init__(self, rows):
        self.words, self.next = defaultdict(Counter), defaultdict(Counter)
        for grp, text in rows:
            ids, word, words = tokenizer.loaded(PATH).encode(text or "", add_special_tokens=False).ids, [], []
            for i in ids:
                word.append(i)
                if tokenizer.token_strings(PATH)[i][1]:
                    words.append(tuple(word))
                    word = []
            words += [tuple(word)] if word else []
            self.words[grp or ""].update(words)
            self.next[grp or ""].update((a[-1], b[0]) for a, b in zip(words, words[1:], strict=False))
        counters = lambda: defaultdict(Counter)
        self.nodes, self.pairs, self.after = defaultdict(counters), defaultdict(counters), defaultdict(counters)
        for grp, c in self.next.items():
            for (a, b), n in c.items():
                self.after[grp][a][b] = n

    def children(self, grp, node):
        if grp not in self.nodes:
            for w, n in self.words[grp].items():
                for k in range(len(w)):
                    self.nodes[grp][w[:k]][w[k]] += n
                    if k:
                        self.pairs[grp][w[k - 1]][w[k]] += n
        return self.nodes[grp][node]

    def discover(self, grp, k, extensions):
        first, mass = self.children(grp, ()), Counter()
        for i in sorted(first, key=lambda i: (-first[i], i))[:k]:
            ids, lp = [i], math.log(first[i] / first.total())
            for _ in range(extensions):
                if " " in tokenizer.decoded_ids(PATH, ids).strip():
                    break
                ended = tokenizer.token_strings(PATH)[ids[-1]][1]
                to = self.after[grp][ids[-1]] if ended else self.children(grp, tuple(ids))
                if not to:
                    break
                best = min(to, key=lambda x: (-to[x], x))
                lp += math.log(to[best] / to.total())
                ids.append(best)
            said = tokenizer.decoded_ids(PATH, ids).split()
            word = said[0].strip(DISCOVERED_STRIP) if said else ""
            if re.fullmatch(r"[^\W\d_]+", word):
                mass[word] += math.exp(lp)
        return {w: m / mass.total() for w, m in mass.items()}

    def logp(self, grp, word):
        ids, out = tuple(tokenizer.loaded(PATH).encode(word, add_special_tokens=False).ids), 0.0
        for k, i in enumerate(ids):
            here = self.children(grp, ids[:k])
            inside = self.pairs[grp][ids[k - 1]] if k else Counter()
            out += math.log(here[i] / here.total()) if here[i] else math.log(token_words.BACK_OFF * inside[i] / inside.total()) if inside[i] else math.log(token_words.NEVER)
        return out


@pytest.fixture(scope="module")
def plain():
    return Plain(TEXTS)


def test_ids_there_and_back(spark):
    df = spark.createDataFrame([(t, 1) for _, t in TEXTS], "text string, ids2 int")
    got = {r.text: r for r in tokenizer.decode(tokenizer.encode(df, "text", PATH), "ids", PATH, "said").collect()}
    assert got[None].ids == [] == got[""].ids and got[None].said == ""
    for t, r in got.items():
        assert r.ids == tokenizer.loaded(PATH).encode(t or "", add_special_tokens=False).ids
        assert re.sub(r"\s", "", r.said) == re.sub(r"\s", "", (t or "").lower())


def test_counts_are_those_of_words_and_followers(counts, plain):
    got = {(r.grp, r.kind, tuple(r.ids)): r.n for r in counts.collect()}
    want = {(g, 0, w): n for g, c in plain.words.items() for w, n in c.items()} | {(g, 1, p): n for g, c in plain.next.items() for p, n in c.items()}
    assert got == want


@pytest.mark.parametrize("k,extensions", [(200, 4), (3, 1), (200, 12)])
def test_discovery_equals_a_plain_loop(counts, plain, k, extensions):
    got = defaultdict(dict)
    for r in token_words.discover(token_words.Trie.of(counts), PATH, k, extensions).collect():
        got[r.grp][r.word] = r.prob
    want = {g: plain.discover(g, k, extensions) for g in plain.words}
    assert {g: set(x) for g, x in got.items()} == {g: set(x) for g, x in want.items() if x}
    assert all(math.isclose(p, want[g][w], rel_tol=1e-9) for g, x in got.items() for w, p in x.items()) and "houseboat" in got["en"] or k == 3 or extensions < 4


def test_scores_of_candidates(spark, counts, plain):
    words = ["the", "cat", "catastrophe", "unbelievable", "houseboats", "zebra", "catdog", "", "étion", "日本", "the"]
    candidates = spark.createDataFrame([(g, w) for g in ("en", "fr") for w in words], "grp string, word string")
    trie = token_words.Trie.of(counts)
    got = {(r.grp, r.word): r for r in token_words.word_logprobs(candidates, trie, PATH).collect()}
    assert set(got) == {(g, w) for g in ("en", "fr") for w in words if w}
    for (g, w), r in got.items():
        assert math.isclose(r.logp, plain.logp(g, w), abs_tol=1e-8)
    for g in ("en", "fr"):
        total = sum(math.exp(r.logp) for (h, _), r in got.items() if h == g)
        assert all(math.isclose(r.prob, math.exp(r.logp) / total, rel_tol=1e-6) for (h, _), r in got.items() if h == g)
    first = {(r.grp, r.word): r.prob for r in token_words.first_token_scores(candidates, trie, PATH).collect()}
    for g in ("en", "fr"):
        of = plain.children(g, ())
        head = {w: of[tokenizer.loaded(PATH).encode(w, add_special_tokens=False).ids[0]] for w in set(words) if w}
        total = sum(head.values())
        assert {w: p for (h, w), p in first.items() if h == g} == {w: pytest.approx(n / total) for w, n in head.items() if n}


def test_empty_corpus(counts):
    trie = token_words.Trie.of(counts.where("false"))
    assert token_words.discover(trie, PATH).count() == 0 and token_words.first_token_scores(counts.select("grp", F.lit("the").alias("word")), trie, PATH).count() == 0
