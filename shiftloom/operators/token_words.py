"""Finding and scoring whole words from a model of tokens that the corpus itself makes: a trie of its words' tokens, and
which word's first token follows which word's last.

``counted`` encodes texts and counts, in a task over some texts at a time, words (as id arrays) and the pairs (last token,
next word's first token). ``Trie`` holds what the searches ask: a node is the ids from a word's beginning; its children have
counts. All keys are (grp, ..) with a group the prompts of the reference stand for; a word ends with a token that says so.

null text: as empty; a null group: as "". Ties between tokens: the lower id. Empty corpus: no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import DISCOVERED_STRIP, is_alpha, strip_chars
from ..sources import tokenizer
from .distributions import normalised, softmax, top_k

#: What a step that the trie doesn't have keeps of the pair's probability, and of one that nothing has.
BACK_OFF, NEVER = 0.4, 1e-9


def counted(texts: DataFrame, group: str, text: str, path: str) -> DataFrame:
    """(grp, kind, ids, ends, n): occurrences of words (kind 0) and of (last, next first) tokens (kind 1); ``ends``: whether
    the last id ends a word."""
    rows = texts.select(F.coalesce(F.col(group).cast("string"), F.lit("")).alias("grp"), F.col(text).alias("text"))
    names = ["grp", "kind", "ids", "ends", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends_of = np.array([e for _, e in tokenizer.token_strings(path)])
        for batch, said in tokenizer.texts_in(batches, 1):
            seen: Counter[tuple[str, int, bytes]] = Counter()
            for grp, made in zip(batch.column(0).to_pylist(), tokenizer.loaded(path).encode_batch(said, add_special_tokens=False), strict=True):
                ids = np.array(made.ids, np.int32)
                heads = np.concatenate([[0], np.flatnonzero(ends_of[ids]) + 1]).tolist() if len(ids) else [0]
                if heads[-1] < len(ids):
                    heads.append(len(ids))
                seen.update((grp, 0, ids[a:b].tobytes()) for a, b in zip(heads[:-1], heads[1:], strict=True))
                seen.update((grp, 1, ids[a - 1 : a + 1].tobytes()) for a in heads[1:-1])
            rows = [(g, k, np.frombuffer(x, np.int32), n) for (g, k, x), n in seen.items()]
            g, k, x, n = zip(*rows, strict=True) if rows else ((), (), (), ())
            columns = [pa.array(g, pa.string()), pa.array(k, pa.int32()), pa.array(x, pa.list_(pa.int32())), pa.array([bool(ends_of[y[-1]]) for y in x], pa.bool_()), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    each = rows.mapInArrow(run, "grp string, kind int, ids array<int>, ends boolean, n long")
    return each.groupBy("grp", "kind", "ids", "ends").agg(F.sum("n").alias("n"))


@dataclass
class Trie:
    """Children of every node (grp, node, nxt, ends, n, of: occurrences of the node), what follows a word's end (grp, cur, nxt, ends, n,
    of), and pairs inside words (grp, cur, nxt, n, of)."""

    children: DataFrame
    follows: DataFrame
    inside: DataFrame

    @classmethod
    def of(cls, counts: DataFrame) -> Trie:
        """From the table that ``counted`` makes (it is read three times)."""
        step = F.explode(F.transform(F.sequence(F.lit(1), F.size("ids")), lambda i: F.struct(F.slice("ids", 1, i - 1).alias("node"), F.element_at("ids", i).alias("nxt"), (F.col("ends") & (i == F.size("ids"))).alias("ends"))))
        total = lambda df, *keys: df.withColumn("of", F.sum("n").over(Window.partitionBy(*keys)))
        children = counts.where("kind = 0").select("grp", "n", step.alias("x")).groupBy("grp", "x.node", "x.nxt", "x.ends").agg(F.sum("n").alias("n"))
        follows = counts.where("kind = 1").select("grp", F.col("ids")[0].alias("cur"), F.col("ids")[1].alias("nxt"), "ends", "n")
        inside = children.where(F.size("node") > 0).groupBy("grp", F.element_at("node", -1).alias("cur"), "nxt").agg(F.sum("n").alias("n"))
        # Every occurrence of a word passes its nodes, so all children of the root together are all words.
        return cls(total(children, "grp", "node"), total(follows, "grp", "cur"), total(inside, "grp", "cur"))


def discover(trie: Trie, path: str, k: int = 200, extensions: int = 4) -> DataFrame:
    """(grp, word, prob): each of the ``k`` likeliest first tokens goes on by the likeliest next token, along the trie and,
    from a word's end, to the word that most often follows, until a second word has begun (whose first token's probability
    counts) or there are ``extensions``; first words are cleaned, their mass summed and normalised."""
    lp = F.ln(F.col("n") / F.col("of"))
    roots = trie.children.where(F.size("node") == 0)
    state = top_k(roots, ["grp"], [F.desc("n"), "nxt"], k).select("grp", F.array("nxt").alias("ids"), F.col("ends").alias("ended"), lp.alias("lp"), F.lit(False).alias("done"))
    likeliest = lambda df, *keys: top_k(df, list(keys), [F.desc("n"), "nxt"], 1).withColumn("step", lp)
    inner = likeliest(trie.children.where(F.size("node") > 0), "grp", "node").select("grp", F.col("node").alias("ids"), F.col("nxt").alias("a"), F.col("ends").alias("a_ends"), F.col("step").alias("a_lp"))
    outer = likeliest(trie.follows, "grp", "cur").select("grp", "cur", F.col("nxt").alias("b"), F.col("step").alias("b_lp"))
    for _ in range(extensions):
        both = state.withColumn("cur", F.element_at("ids", -1)).join(inner, ["grp", "ids"], "left").join(outer, ["grp", "cur"], "left")
        inward, onward = ~F.col("done") & ~F.col("ended") & F.col("a").isNotNull(), ~F.col("done") & F.col("ended") & F.col("b").isNotNull()
        state = both.select(
            "grp",
            F.when(inward, F.array_append("ids", F.col("a"))).otherwise(F.col("ids")).alias("ids"),
            F.when(inward, F.col("a_ends")).otherwise(F.col("ended")).alias("ended"),
            F.when(inward, F.col("lp") + F.col("a_lp")).when(onward, F.col("lp") + F.col("b_lp")).otherwise(F.col("lp")).alias("lp"),
            (F.col("done") | ~inward).alias("done"),
        )
    said = tokenizer.decode(state.select("grp", "lp", "ids"), "ids", path)
    first = F.regexp_extract("text", r"^\s*(\S+)", 1)
    words = said.withColumn("word", strip_chars(first, DISCOVERED_STRIP)).where(is_alpha(F.col("word")))
    return normalised(words.groupBy("grp", "word").agg(F.sum(F.exp("lp")).alias("mass")), ["grp"], "mass", "prob").drop("mass")


def word_logprobs(candidates: DataFrame, trie: Trie, path: str) -> DataFrame:
    """(grp, word, logp, prob): log probability of each candidate's (grp, word) tokens along the trie, softmaxed within the
    group. A step that the trie lacks has ``BACK_OFF`` of its pair's probability inside words, or ``NEVER``. A word without
    tokens drops out."""
    ids = tokenizer.encode(candidates.select("grp", "word").distinct(), "word", path).where(F.size("ids") > 0)
    step = F.explode(F.transform(F.sequence(F.lit(1), F.size("ids")), lambda i: F.struct(F.slice("ids", 1, i - 1).alias("node"), F.element_at("ids", i).alias("nxt"))))
    steps = ids.select("grp", "word", step.alias("x")).select("grp", "word", "x.node", "x.nxt").withColumn("cur", F.try_element_at("node", F.lit(-1)))
    on_trie = trie.children.groupBy("grp", "node", "nxt").agg(F.ln(F.sum("n") / F.first("of")).alias("t"))
    on_pairs = trie.inside.select("grp", "cur", "nxt", F.ln(F.lit(BACK_OFF) * F.col("n") / F.col("of")).alias("p"))
    found = steps.join(on_trie, ["grp", "node", "nxt"], "left").join(on_pairs, ["grp", "cur", "nxt"], "left")
    logp = found.groupBy("grp", "word").agg(F.round(F.sum(F.coalesce("t", "p", F.lit(float(np.log(NEVER))))), 9).alias("logp"))
    return softmax(logp, ["grp"], "logp", "prob")


def first_token_scores(candidates: DataFrame, trie: Trie, path: str) -> DataFrame:
    """(grp, word, prob): each candidate scored by its first token alone, so words that begin with the same token score the
    same. One whose first token no word of the group begins with drops out."""
    ids = tokenizer.encode(candidates.select("grp", "word").distinct(), "word", path).where(F.size("ids") > 0)
    roots = trie.children.where(F.size("node") == 0).groupBy("grp", F.col("nxt").alias("first")).agg((F.sum("n") / F.first("of")).alias("p"))
    scored = ids.select("grp", "word", F.col("ids")[0].alias("first")).join(roots, ["grp", "first"])
    return scored.select("grp", "word", (F.col("p") / F.sum("p").over(Window.partitionBy("grp"))).alias("prob"))
