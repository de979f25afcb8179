import glob
import hashlib
import itertools
import math
import os
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftloom.operators import permutations, sampling, stats
from shiftloom.plans import catalog

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


def plain_place(i, n, perm):
    """Swap-or-not, one number at a time."""

    def mix(x):
        for _ in range(2):
            x = (x ^ (x >> 16)) * permutations.MULTIPLIER % 2**32
        return x ^ (x >> 16)

    for r in range(permutations.ROUNDS):
        salt = mix(perm * 64 + r)
        other = (mix((salt + 2**31) % 2**32) % n + n - i) % n
        i = other if mix((max(i, other) + salt) % 2**32) % 2 else i
    return i


def test_places_are_bijections_and_spread_evenly():
    for n in (1, 2, 7, 64, 101):
        got = permutations.places(np.arange(n), n, np.arange(1, 60))
        assert (np.sort(got, 0) == np.arange(n)[:, None]).all()
    assert [plain_place(i, 7, 5) for i in range(7)] == permutations.places(np.arange(7), 7, np.array([5])).ravel().tolist()
    got = permutations.places(np.arange(5), 5, np.arange(1, 12001))
    orders = Counter(map(tuple, got.T.tolist()))
    assert len(orders) == 120 and max(abs(n - 100) for n in orders.values()) < 50  # five standard deviations


def test_numbers_follow_the_order(spark):
    df = spark.createDataFrame([(k * 37 % 101, str(k % 3)) for k in range(101)], "v int, g string").repartition(5)
    got = permutations.numbered(df, ["g", "v"]).orderBy("index").collect()
    assert [(r.g, r.v) for r in got] == sorted((r.g, r.v) for r in got) and [r["index"] for r in got] == list(range(101))


@pytest.fixture(scope="module")
def items(spark):
    x = np.random.default_rng(1).normal(size=(21, 3))
    rows = [(40 - i, "abc"[i % 3 if i < 15 else 0], x[i].tolist()) for i in range(21)]
    return rows, spark.createDataFrame([*rows, (99, None, [1.0, 2.0, 3.0]), (98, "a", None)], "id long, grp string, vec array<double>").repartition(4)


def plain_test(rows, a, b, many, value):
    rows = sorted((g, i, v) for i, g, v in rows if g in (a, b))
    x, n0 = np.array([v for _, _, v in rows]), sum(g == a for g, _, _ in rows)
    found = []
    for perm in range(many + 1):
        first = np.array([(k if not perm else plain_place(k, len(rows), perm)) < n0 for k in range(len(rows))])
        found.append(round(value(x[first] @ x[~first].T), 9))
    return found[0], sum(v >= found[0] for v in found[1:]) / many


@pytest.mark.parametrize("cells", [permutations.CELLS, 200])
def test_mean_of_all_pairs_of_groups(items, monkeypatch, cells):
    monkeypatch.setattr(permutations, "CELLS", cells)
    rows, df = items
    got = {(r.a, r.b): (r.observed, r.p_value) for r in permutations.mean_tests(df, 60).collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")}
    for (a, b), (observed, p) in got.items():
        want = plain_test(rows, a, b, 60, lambda s: s.mean())
        assert math.isclose(observed, want[0], abs_tol=1e-8) and math.isclose(p, want[1])
    assert permutations.mean_tests(df.where("grp = 'a'"), 9).count() == 0 == permutations.mean_tests(df.where("false"), 9).count()


def test_best_match_of_two_groups(items):
    rows, df = items
    got = permutations.best_test(df, 40, "a", "c").first()
    want = plain_test(rows, "a", "c", 40, lambda s: s.max(1).mean())
    assert math.isclose(got.observed, want[0], abs_tol=1e-8) and math.isclose(got.p_value, want[1])


def test_exact_tails_are_those_of_all_choices():
    for n1, n2 in ((1, 1), (2, 3), (4, 4), (3, 6)):
        all_u = [sum(c) - n1 * (n1 - 1) // 2 for c in itertools.combinations(range(n1 + n2), n1)]
        for u in range(n1 * n2 + 1):
            above, below = (sum(v >= u for v in all_u) / len(all_u), sum(v <= u for v in all_u) / len(all_u))
            got = stats.mann_whitney_tails(u, n1, n2)
            assert got[3] and np.allclose(got[:3], (above, below, min(1, 2 * min(above, below))))
    assert math.isclose(stats.u_shares(50, 50).sum(), 1) and math.isclose(stats.mann_whitney_tails(1250, 50, 50)[0], 0.5, abs_tol=0.01)
    exact, near = stats.mann_whitney_tails(1500, 50, 50), stats.mann_whitney_tails(1500, 50, 50, most=0)
    assert exact[3] and not near[3] and abs(exact[0] - near[0]) < 1e-3
    assert stats.mann_whitney_tails(0, 0, 4)[:3] == (1, 1, 1) == stats.mann_whitney_tails(2, 2, 2, 60)[:3]


def test_mann_whitney_by_group(spark):
    rows = [("few", v, v in (3.0, 5.0)) for v in (1.0, 2.0, 3.0, 4.0, 5.0)] + [("ties", float(k % 3), k % 2 == 0) for k in range(30)] + [("one", 1.0, True)]
    df = spark.createDataFrame(rows, "g string, v double, a boolean")
    got = {r.g: r for r in stats.mann_whitney(df, ["g"], "v", F.col("a")).collect()}
    assert (got["few"].n1, got["few"].n2, got["few"].u, got["few"].exact) == (2, 3, 5, True) and math.isclose(got["few"].p_greater, 0.2) and got["one"].p_two_sided == 1
    x, y = ([v for g, v, a in rows if g == "ties" and a == side] for side in (True, False))
    u = sum((p > q) + 0.5 * (p == q) for p in x for q in y)
    sd = math.sqrt(15 * 15 / 12 * (31 - 3 * (10**3 - 10) / (30 * 29)))
    assert got["ties"].u == u and not got["ties"].exact and math.isclose(got["ties"].p_greater, 0.5 * math.erfc((u - 112.5 - 0.5) / sd / math.sqrt(2)))


def test_correlation_p(spark):
    # Two-sided p by Simpson's rule over the density of t.
    def simpson(r, n):
        df, t = n - 2, abs(r) * math.sqrt((n - 2) / (1 - r * r))
        density = lambda x: math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) * (1 + x * x / df) ** (-(df + 1) / 2)
        k, h = 4000, t / 4000
        inside = h / 3 * sum(density(i * h) * (1 if i in (0, k) else 4 if i % 2 else 2) for i in range(k + 1))
        return 1 - 2 * inside

    for r, n in ((0.43, 72), (0.1, 10), (-0.6, 5), (0.9, 4), (0.02, 1000), (0.5, 3)):
        assert math.isclose(stats.pearson_p(r, n), simpson(r, n), rel_tol=1e-6, abs_tol=1e-9)
    assert stats.pearson_p(1.0, 9) == 0 and stats.pearson_p(0.0, 9) == 1 and stats.pearson_p(0.3, 2) is None and stats.pearson_p(None, 9) is None
    df = spark.createDataFrame([("g", 1.0, 2.0), ("g", 2.0, 4.5), ("g", 3.0, 5.0), ("g", 4.0, 9.0), ("g", None, 1.0), ("h", 1.0, 1.0), ("c", 1.0, 1.0), ("c", 1.0, 2.0), ("c", 1.0, 3.0)], "k string, a double, b double")
    got = {r.k: r for r in stats.pearson_test(df, ["k"], "a", "b").collect()}
    r = np.corrcoef([1, 2, 3, 4], [2, 4.5, 5, 9])[0, 1]
    assert got["g"].n == 4 and math.isclose(got["g"].r, r) and math.isclose(got["g"].p, simpson(r, 4), rel_tol=1e-6) and got["h"].p is None and got["c"].p is None


def plain_draws(weights, key, draws):
    rows = sorted(((w, -n) for w, n in weights.items() if n and n > 0), key=lambda x: (x[1], x[0]))
    cum = np.cumsum([-n for _, n in rows])
    out = []
    for k in range(draws):
        u = int(hashlib.md5(f"{key}:{k}".encode()).hexdigest()[:8], 16) / 4294967296 * cum[-1]
        out.append(rows[min(len(rows) - 1, int(np.searchsorted(cum, u, side="left")))][0])
    return out


def test_draws_from_a_large_vocabulary(spark):
    size = 200_000
    weights = {f"w{k:06d}": (k * 7919 % 1000) ** 2 // 100 + (10**6 if k == 77 else 0) for k in range(size)}
    df = spark.range(size).select(F.lit("big").alias("key"), F.format_string("w%06d", "id").alias("word"))
    n = F.floor(F.pow(F.substring("word", 2, 6).cast("long") * 7919 % 1000, 2) / 100) + F.when(F.col("word") == "w000077", 10**6).otherwise(0)
    small = spark.createDataFrame([("one", "x", 2.0), ("two", "a", 1.0), ("two", "b", 1.0), ("two", "c", 0.0), ("two", "d", None), ("none", "z", 0.0)], "key string, word string, weight double")
    got = {}
    drawn = sampling.draw_by_ranges(df.withColumn("weight", n.cast("double")).unionByName(small), ["key"], 1000)
    for r in drawn.collect():
        got.setdefault(r.key, {})[r.draw] = r.word
    assert set(got) == {"big", "one", "two"} and "Join" not in drawn._jdf.queryExecution().executedPlan().toString()
    assert [got["big"][k] for k in range(1000)] == plain_draws(weights, "big", 1000)
    assert [got["two"][k] for k in range(1000)] == plain_draws({"a": 1, "b": 1}, "two", 1000) and set(got["one"].values()) == {"x"}
    assert sampling.draw_by_ranges(small.where("false"), ["key"], 3).count() == 0


@needs_tables
def test_queries(spark):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    for name in ("perm_keyed_mean", "perm_keyed_best"):
        got, want = catalog.QUERIES[name](spark, SF).first(), con.execute(catalog.ORACLE_SQL[name]).df().iloc[0]
        assert math.isclose(got.observed, want.observed, abs_tol=1e-6) and math.isclose(got.p_value, want.p_value, abs_tol=1e-9)
    drawn = sorted(tuple(r) for r in catalog.QUERIES["sample_words"](spark, SF).collect())
    assert len(drawn) > 10_000 and drawn == sorted(con.execute(catalog.ORACLE_SQL["sample_words"]).fetchall())
    pairs = {(r.a, r.b): r for r in catalog.QUERIES["perm_pairs_mean"](spark, SF).collect()}
    labels = con.execute("SELECT count(DISTINCT label) FROM embeddings").fetchone()[0]
    assert len(pairs) == labels * (labels - 1) // 2 and pairs[0, 1].p_value == catalog.QUERIES["perm_keyed_mean"](spark, SF).first().p_value
    whole = {r.family: r for r in catalog.QUERIES["mann_whitney"](spark, SF).collect()}
    for r in catalog.QUERIES["mann_whitney_p_values"](spark, SF).collect():
        assert (r.n1, r.n2, r.u) == (whole[r.family].n1, whole[r.family].n2, whole[r.family].u) and abs(r.p_greater - stats.mann_whitney_tails(r.u, r.n1, r.n2)[0]) < 1e-8
    p = catalog.QUERIES["gen_vs_logit_p_value"](spark, SF).first()
    assert abs(p.p - stats.pearson_p(p.r, p.n)) < 1e-5
