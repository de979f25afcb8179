import math

import pytest
from pyspark.sql import functions as F

from shiftloom.operators import discovery, distributions, generations, lens, sampling, shift, similarity, stats, steps, taxonomy, transfer
from shiftloom.plans.api import Engine

DIST = "layer string, prompt string, word string, prob double"


@pytest.fixture(scope="module")
def word_dist(spark):
    rows = [
        ("base", "p", "stab", 0.5), ("base", "p", "walk", 0.5), ("sft", "p", "stab", 0.4), ("sft", "p", "walk", 0.35), ("sft", "p", "Sing", 0.25),
        ("dpo", "p", "stab", 0.1), ("dpo", "p", "walk", 0.5), ("dpo", "p", "Sing", 0.4), ("rlvr", "p", "hum", 1.0), ("base", "q", "same", 1.0), ("sft", "q", "same", 1.0), ("dpo", "q", "same", 1.0),
    ]
    return spark.createDataFrame(rows, DIST).cache()


@pytest.fixture(scope="module")
def vectors(spark):
    v = {"stab": [1.0, 0.0], "walk": [0.8, 0.6], "Sing": [0.6, 0.8], "hum": [0.0, 1.0], "same": [1.0, 0.0]}
    return spark.createDataFrame([("q" if w == "same" else "p", w, h, x) for w, x in v.items() for h in (8, 16, 24)], "prompt string, word string, net_layer int, vec array<double>").cache()


def by(rows, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in rows}


def test_merge_fills_missing_with_zero_and_keeps_case(word_dist):
    got = by(distributions.merged_stages(word_dist, ["prompt"]).collect(), "prompt", "word")
    assert got["p", "hum"].base == 0 and got["p", "hum"].rlvr == 1 and got["p", "Sing"].dpo == 0.4 and len(got) == 5


def test_distribution_sums_to_one_and_breaks_ties_by_word(spark):
    counts = spark.createDataFrame([("a", "base", w, n) for w, n in (("x", 2), ("y", 2), ("z", 2), ("w", 4))], "prompt string, layer string, word string, n long")
    got = distributions.word_distribution(counts, ["prompt"], 3).collect()
    assert {r.word for r in got} == {"w", "x", "y"} and math.isclose(sum(r.prob for r in got), 1)
    zero = distributions.normalised(spark.createDataFrame([("a", 0.0), ("a", 0.0)], "g string, m double"), ["g"], "m", "p").collect()
    assert [r.p for r in zero] == [0, 0]


def test_shift_with_and_without_base(word_dist):
    wide = distributions.merged_stages(word_dist, ["prompt"])
    both = by(shift.shift_table(wide, "dpo", "rlvr").collect(), "prompt", "word")
    without = by(shift.shift_table(wide.withColumn("base", F.lit(0.0)), "sft", "rlvr", with_base=False).collect(), "prompt", "word")
    assert both["p", "stab"].down and both["p", "hum"].up and math.isclose(both["p", "hum"].delta, -1) and ("q", "same") in both and ("p", "hum") in without
    exact = shift.shift_table(wide.where("word = 'same'"), "sft", "dpo").first()
    assert not exact.down and not exact.up and exact.ratio < 0


def test_two_means_of_base(word_dist):
    wide = distributions.merged_stages(word_dist, ["prompt"])
    score = by(shift.drive_scores(wide).collect(), "word")["stab"]
    gone = by(transfer.suppressed(wide, 0.005).collect(), "word")["stab"]
    assert math.isclose(score.drive_weight, 1 + math.log(1 + 0.5 / (1 / 3)), rel_tol=1e-9) and math.isclose(gone.drive_weight, 1 + math.log(1 + 0.5 / 0.5), rel_tol=1e-9)


def test_transfer_moves_mass_to_similar_words(word_dist, vectors):
    got = Engine(word_dist, word_vec=vectors).displacement()
    edges = by(got["edges"].collect(), "source", "target")
    assert set(edges) == {("stab", "walk"), ("stab", "Sing")}
    share = edges["stab", "walk"].mass / (edges["stab", "walk"].mass + edges["stab", "Sing"].mass)
    assert math.isclose(share, 0.8 / 1.4, rel_tol=1e-6)
    moved = by(got["transferred"].collect(), "prompt", "word")
    assert math.isclose(sum(r.prob for k, r in moved.items() if k[0] == "p"), 1) and moved["q", "same"].prob == 1
    roles = by(got["analysis"].collect(), "prompt", "word")
    assert roles["p", "stab"].role == "repressed" and roles["p", "Sing"].role == "amplified" and roles["q", "same"].role == "neutral"
    assert roles["p", "walk"].drive_weight is None and roles["p", "Sing"].condensation_sources == "stab"


def test_nothing_suppressed_leaves_mass_as_it_is(spark, vectors):
    rows = [("sft", "p", "walk", 0.4), ("dpo", "p", "walk", 0.7), ("base", "p", "walk", 1.0)]
    got = Engine(spark.createDataFrame(rows, DIST), word_vec=vectors).displacement()["transferred"].collect()
    assert [r.prob for r in got] == [0.7]


def test_small_shares_are_dropped_not_dealt_again(word_dist, vectors):
    wide = distributions.merged_stages(word_dist, ["prompt"])
    gone = transfer.suppressed(wide, 0.005)
    allowed = transfer.permitted(wide, gone, 0.001)
    v = vectors.where("net_layer = 16").drop("net_layer")
    all_ = by(transfer.edges(gone, allowed, v, F.col("raw_mass"), None, 0.3, 0.0, True).collect(), "target")
    few = by(transfer.edges(gone, allowed, v, F.col("raw_mass"), None, 0.3, 0.15, True).collect(), "target")
    assert set(few) == {"walk"} and few["walk"].mass == all_["walk"].mass and math.isclose(sum(r.mass for r in all_.values()), 0.3)


def test_displacement_map(word_dist, vectors):
    got = Engine(word_dist, word_vec=vectors).displacement_map()
    pairs = {(r.axis, r.source, r.target) for r in got["pairs"].collect()}
    assert ("repression", "stab", "Sing") in pairs and ("sublimation", "stab", "Sing") in pairs
    links = by(got["links"].where("axis = 'repression'").collect(), "word", "link")
    assert links["stab", "target"].other == "walk" and links["walk", "source"].other == "stab"
    assert got["orphans"].count() == 0 and set(got["matrix"].columns) >= {"layer_8", "layer_16", "layer_24"}


LOGITS = "prompt long, layer string, token_id int, logit double"


@pytest.fixture(scope="module")
def logits(spark):
    rows = [(0, s, t, float((t * k) % 7) + 500) for k, s in enumerate(("base", "sft", "dpo"), 1) for t in range(12)]
    return spark.createDataFrame(rows, LOGITS).cache()


def test_metrics_have_their_properties(logits):
    probs = distributions.softmax(logits, ["prompt", "layer"])
    sums = probs.groupBy("layer").agg(F.sum("prob").alias("s")).collect()
    assert all(math.isclose(r.s, 1) for r in sums)
    both = distributions.pair_table(probs, ["prompt"], "token_id", (("base", "sft"), ("sft", "base"), ("base", "base"), ("base", "rlvr")))
    m = by(distributions.metrics(both, ["prompt", "pair"], "token_id", 5).collect(), "pair")
    assert math.isclose(m["base_sft"].js, m["sft_base"].js) and 0 < m["base_sft"].js < math.log(2) and abs(m["base_base"].kl) < 1e-12 and m["base_base"].overlap == 1 and math.isclose(m["base_base"].rank_corr, 1)
    assert "base_rlvr" not in m and 0 <= m["base_sft"].overlap <= 1


def test_ranks_average_over_ties(spark):
    rows = [(0, "x", t, a, b) for t, (a, b) in enumerate([(1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (3.0, 2.0)])]
    got = distributions.ranks(spark.createDataFrame(rows, "prompt long, pair string, token_id int, pa double, pb double"), ["prompt", "pair"], "token_id").orderBy("token_id").collect()
    assert [r.aa for r in got] == [1.5, 1.5, 3, 4] and [r.ab for r in got] == [1, 3, 3, 3] and [r.ra for r in got] == [3, 4, 2, 1]


def test_movers_drop_blanks_after_ranking(spark):
    rows = [(0, t, tok, a, b) for t, (tok, a, b) in enumerate([("", 0.9, 0.1), ("x", 0.05, 0.1), ("y", 0.05, 0.8)])]
    got = shift.movers(spark.createDataFrame(rows, "prompt long, token_id int, token string, pa double, pb double"), 2, ["prompt"]).collect()
    assert sorted((r.direction, r.token) for r in got) == [("down", "x"), ("up", "x"), ("up", "y")]


def test_perplexity(spark):
    df = spark.createDataFrame([("a", 0, None), ("b", 0, None), ("b", 1, math.log(0.5)), ("b", 2, math.log(0.125))], "s string, pos int, logp double")
    got = {r.s: r.perplexity for r in distributions.perplexity(df, ["s"]).collect()}
    assert math.isnan(got["a"]) and math.isclose(got["b"], 4)


def test_geometry_by_its_definitions(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    rows = [(int(i % 2), ("base", "sft", "dpo")[i % 3], int(rng.integers(0, 6))) for i in range(40)] + [(5, "base", 1)]
    x = rng.normal(size=(6, 4))
    gens = spark.createDataFrame(rows, "label long, model string, vec_row long")
    vec = spark.createDataFrame([(i, x[i].tolist()) for i in range(6)], "vec_row long, vec array<double>")
    counted = generations.counted_vectors(gens, vec, ["label", "model"])
    spread = by(generations.spread(counted, ["label", "model"]).collect(), "label", "model")
    cosine = by(generations.mean_cosine(counted, ["label", "model"]).collect(), "label", "model")
    distance = by(generations.centroid_distance(counted, ["label"]).collect(), "label", "model")
    silhouettes = by(generations.silhouette(counted, ["label"]).collect(), "label")
    assert (5, "base") not in spread and 5 not in silhouettes
    for label in (0, 1):
        groups = {m: np.array([x[v] for g, k, v in rows if g == label and k == m]) for m in ("base", "sft", "dpo")}
        for m, g in groups.items():
            assert math.isclose(spread[label, m].variance, np.linalg.norm(g - g.mean(0), axis=1).var(), abs_tol=1e-9)
            u = g / np.linalg.norm(g, axis=1, keepdims=True)
            assert math.isclose(cosine[label, m].mean_cosine, (u @ u.T)[np.triu_indices(len(g), 1)].mean(), abs_tol=1e-8)
        assert math.isclose(distance[label, "sft"].distance, np.linalg.norm(groups["sft"].mean(0) - groups["base"].mean(0)), rel_tol=1e-9)
        s = []
        for m, g in groups.items():
            for i in range(len(g)):
                d = {k: np.linalg.norm(h - g[i], axis=1).sum() / (len(h) - (k == m)) for k, h in groups.items()}
                a, b = d.pop(m), min(d.values())
                s.append((b - a) / max(a, b) if max(a, b) > 0 else 0)
        assert math.isclose(silhouettes[label].silhouette, np.mean(s), abs_tol=1e-9)


def test_last_stage_is_the_latest_there(spark):
    df = spark.createDataFrame([(1, "base", 1.0), (1, "sft", 2.0), (1, "rlvr", 3.0), (2, "base", 1.0), (2, "sft", 5.0)], "label long, model string, v double")
    got = by(generations.to_last(df, ["label"], "v").collect(), "label")
    assert got[1].last == 3 and got[2].last == 5


def test_first_words_filter_before_the_cut(spark):
    gens = spark.createDataFrame([(1, "____"), (1, "____"), (1, "go on"), (1, "Go!"), (1, "(go)"), (1, None)], "label long, psg string")
    assert [(r.word, r.n) for r in generations.prompt_words(gens, ["label"], 1).collect()] == [("go", 2)]
    e = generations.first_word_entropy(gens, ["label"]).first()
    assert e.unique_first_words == 5


def test_steps(spark):
    rows = [(s, 0, t, n) for s, t, n in ((0, "a", 3), (0, "b", 1), (1, "a", 1), (1, "c", 3), (2, "b", 4))]
    counts = spark.createDataFrame(rows, "step int, label long, token string, n long")
    probs = steps.smoothed(counts)
    assert math.isclose(by(probs.collect(), "step", "token")[0, "c"].p, 1 / 7)
    m = by(steps.step_metrics(probs, 2).collect(), "step")
    assert set(m) == {1, 2} and all(math.isclose(r.entropy_drop, r.entropy_base - r.entropy_step) for r in m.values())
    tracked = spark.createDataFrame([("a", "first", 1), ("a", "second", 2), ("b", None, 3)], "token string, category string, ord int")
    words = by(steps.step_words(probs, tracked).collect(), "step", "token")
    assert words[1, "a"].word_category == "first" and words[1, "b"].word_category == "empirical"
    curve = by(steps.onset_curve(steps.step_words(probs, tracked)).collect(), "token", "step")
    assert math.isclose(curve["a", 0].probability, 4 / 7) and len(curve) == 6


def test_lens_keeps_ids_apart(spark):
    rows = [(0, 0, 0, t, w, x) for t, (w, x) in enumerate([("go", 5.0), ("go", 4.0), ("t", 6.0), ("up", 0.0), ("go", 1.0)])]
    got = lens.lens_rows(spark.createDataFrame(rows, "model long, prompt long, net_layer int, token_id int, token string, logit double"), [3, 4], 3).collect()
    assert sorted((r.token_id, r.source) for r in got) == [(0, "top_k"), (1, "top_k"), (3, "tracked")]


def test_taxonomy_counts_orphans_as_changes_of_genre(spark):
    pairs = spark.createDataFrame([("p", "repression", "cut", "walks", 0.4, 8), ("p", "repression", "cut", "the", 0.4, 8)], "prompt string, axis string, source string, target string, similarity double, net_layer int")
    alone = spark.createDataFrame([("p", "repression", "hit")], "prompt string, axis string, source string")
    lexicon = spark.createDataFrame([("cut", "X", 4.0), ("walks", "NOUN", 4.0), ("the", "X", 7.0), ("hit", "X", 4.0)], "word string, pos string, zipf double")
    rows = taxonomy.classified(pairs, alone, lexicon)
    assert sorted((r.source, r.target or "", r.displacement_type) for r in rows.collect()) == [("cut", "the", "genre_change"), ("cut", "walks", "category_shift"), ("hit", "", "genre_change")]
    assert {r.displacement_type: round(r.pct, 3) for r in taxonomy.shares(rows, ["axis"], "displacement_type").collect()} == {"genre_change": 66.667, "category_shift": 33.333}


def test_discovery_stops_at_boundaries_and_counts_them(spark):
    first = spark.createDataFrame([("p", "sto", 3), ("p", "a1", 1)], "prompt string, piece string, n long")
    moves = discovery.transitions(spark.createDataFrame([("p", "sto", "ne", 3), ("p", "sto", "$", 1), ("p", "ne", "$", 4), ("p", "a1", "$", 1)], "prompt string, cur string, nxt string, n long"))
    got = discovery.discover(first, moves).collect()
    assert [(r.word, r.prob) for r in got] == [("stone", 1.0)]
    scored = discovery.word_logprobs(spark.createDataFrame([("p", "stone"), ("p", "sto")], "prompt string, word string"), first, moves, 3)
    assert {r.word: round(r.prob, 6) for r in scored.collect()} == {"stone": 0.75, "sto": 0.25}


def test_permutation_mean_equals_all_cross_products(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(9, 3))
    items = spark.createDataFrame([(i, int(i >= 4), x[i].tolist()) for i in range(9)], "id long, grp int, vec array<double>")
    got = similarity.permutation_mean(items, 30).first()
    assert math.isclose(got.observed, (x[:4] @ x[4:].T).mean(), abs_tol=1e-8) and 0 <= got.p_value <= 1
    best = similarity.permutation_best(items, 10).first()
    assert math.isclose(best.observed, (x[:4] @ x[4:].T).max(1).mean(), abs_tol=1e-8)


def test_permutation_queries_of_a_thousand_equal_brute_force(spark, tmp_path):
    import hashlib

    import numpy as np

    from shiftloom.plans import catalog

    x = np.random.default_rng(1).normal(size=(9, 3))
    rows = [(i, int(i >= 4), x[i].tolist()) for i in range(9)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    for name, value in [("perm_test_mean_1000", lambda s: s.mean()), ("perm_test_best_1000", lambda s: s.max(1).mean())]:
        values = []
        for perm in range(1001):
            order = sorted(range(9), key=lambda i: (hashlib.md5(f"{perm}:{i}".encode()).hexdigest(), i)) if perm else list(range(9))
            values.append(round(value(x[order[:4]] @ x[order[4:]].T), 9))
        got = catalog.QUERIES[name](spark, str(tmp_path)).first()
        assert math.isclose(got.observed, values[0], abs_tol=1e-6) and math.isclose(got.p_value, sum(v >= values[0] for v in values[1:]) / 1000, abs_tol=1e-9)


def test_mann_whitney(spark):
    df = spark.createDataFrame([("f", v, v in (3.0, 5.0)) for v in (1.0, 2.0, 3.0, 4.0, 5.0)], "g string, v double, a boolean")
    got = stats.mann_whitney_u(df, ["g"], "v", F.col("a")).first()
    assert (got.n1, got.n2, got.u) == (2, 3, 5)
    # Of the ten choices of two ranks of five, two have U of five or more.
    assert math.isclose(stats.mann_whitney_p(5, 2, 3), 0.2) and stats.mann_whitney_p(0, 2, 3) == 1
    for u, p in ((192, 0.0629), (220, 0.00753), (254, 0.0000957)):
        assert math.isclose(stats.mann_whitney_p(u, 40, 7), p, rel_tol=0.01)
    assert abs(stats.mann_whitney_p(220, 40, 7, most=0) - 0.00753) < 0.002


def test_sampling_is_seeded_and_follows_the_distribution(spark):
    logits = spark.createDataFrame([(p, t, float(-t)) for p in range(300) for t in range(4)], "prompt long, token_id int, logit double")
    a, b = (sampling.sample(logits, ["prompt"], 4, k=3).orderBy("prompt", "draw").collect() for _ in (0, 1))
    assert a == b and len(a) == 1200 and max(r.token_id for r in a) == 2
    share = sum(r.token_id == 0 for r in a) / 1200
    assert abs(share - 1 / (1 + math.exp(-1) + math.exp(-2))) < 0.05


def test_redistributed_generation(spark):
    wide = spark.createDataFrame([(p, t, b, s, d) for p in (1, 2) for t, (b, s, d) in enumerate([(0.5, 0.6, 0.2), (0.3, 0.2, 0.5), (0.2, 0.2, 0.3)])], "prompt long, token_id int, base double, sft double, dpo double")
    vec = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.6, 0.8]), (2, [-1.0, 0.0])], "token_id int, vec array<double>")
    step = by(sampling.redistributed_step(wide, vec).where("prompt = 1").collect(), "token_id")
    gain = 0.4 * (1 + math.log(1 + 0.5 / (1 / 3))) * 0.3
    assert step[0].prob == 0 and math.isclose(step[1].prob, (0.5 + gain) / (0.8 + gain), rel_tol=1e-6)
    kept = []
    out = sampling.generate(lambda state: state.join(wide, "prompt").drop("ids"), wide.select("prompt").distinct(), 3, vec, 2, write=lambda df: kept.append(1) or df)
    assert all(len(r.ids) == 3 and 0 not in r.ids for r in out.collect()) and kept == [1]
