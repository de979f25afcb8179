import math

from pyspark.sql import functions as F

from shiftloom.functions import numeric, text


def values(spark, rows, ddl, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, ddl).select(*columns).collect()]


def test_ratio_is_negative_unless_larger(spark):
    got = values(spark, [(0.2, 0.1), (0.1, 0.2), (0.3, 0.3), (0.0, 0.0)], "a double, b double", numeric.signed_ratio(F.col("a"), F.col("b")))
    assert math.isclose(got[0][0], 2, rel_tol=1e-6) and math.isclose(got[1][0], -2, rel_tol=1e-6) and math.isclose(got[2][0], -1, rel_tol=1e-6) and got[3][0] == 0


def test_trajectories(spark):
    rows = [(0.1, 0.05, 0.01), (0.01, 0.05, 0.1), (0.1, 0.01, 0.1), (0.01, 0.1, 0.01), (0.01, 0.004, 0.004), (0.0, 0.0, 0.01), (0.1, 0.1, 0.01), (0.1, 0.02, 0.02), (0.005, 0.0, 0.0)]
    got = values(spark, rows, "b double, s double, d double", numeric.trajectory(F.col("b"), F.col("s"), F.col("d")), numeric.trajectory(F.col("b"), None, F.col("d")))
    assert [g[0] for g in got] == ["decline", "rise", "V", "peak", "eliminated", "superego_only", "flat", "flat", "flat"]
    assert [g[1] for g in got[:2]] == ["decline", "rise"] and got[8][1] == "flat"


def test_roles_in_order(spark):
    rows = [(0.02, 0.5), (-0.02, 0.5), (0.0, 0.004), (0.01, 0.003)]
    assert [g[0] for g in values(spark, rows, "r double, d double", numeric.role(F.col("r"), F.col("d")))] == ["repressed", "amplified", "symptomatic", "neutral"]


def stem(a, b):
    a, b = a.lower(), b.lower()
    if a in b or b in a:
        return True
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n >= 4 and n >= 0.6 * min(len(a), len(b))


def test_stems_by_their_definition(spark):
    words = ["a", "an", "kill", "killing", "Killer", "screaming", "scream", "scream's", "running", "runner", "restless", "resting", "rest", "abcde", "abcdx", "abcdefgh", "abcdxyzw", ""]
    rows = [(x, y) for x in words for y in words]
    got = values(spark, rows, "a string, b string", text.shares_stem(F.col("a"), F.col("b")))
    assert [g[0] for g in got] == [stem(x, y) for x, y in rows]


def test_words(spark):
    rows = [("  \"Hello,\" she",), ("...",), (None,), ("____ x",), ("é!",), ("I am",), ("ok?",)]
    got = values(spark, rows, "t string", text.first_token(F.col("t")), text.first_word(F.col("t")), text.is_real_word(text.first_word(F.col("t"))), text.is_alpha(text.first_word(F.col("t"))))
    assert [g[1] for g in got] == ["Hello", "", "", "____", "é", "I", "ok"]
    assert [g[2] for g in got] == [True, False, False, False, False, False, True]
    assert [g[3] for g in got] == [True, False, False, False, True, True, True]


def test_slug_cuts_before_it_strips(spark):
    rows = [("She was, so ANGRY!",), ("x" * 49 + "--tail",), ("  ",)]
    assert [g[0] for g in values(spark, rows, "p string", text.slug(F.col("p")))] == ["she_was_so_angry", "x" * 49, ""]


def test_labels(spark):
    got = values(spark, [("power_12",), ("neutral",), ("a_b_3",)], "l string", text.category_of(F.col("l")), text.stage_alias(F.lit("superego")), text.stage_alias(F.col("l")))
    assert got == [("power", "dpo", "power_12"), ("neutral", "dpo", "neutral"), ("a_b", "dpo", "a_b_3")]


def test_transfer_types_in_order(spark):
    rows = [("the", True, 1.0), ("The", True, 5.0), ("odd", True, 2.9), ("odd", True, 3.0), ("odd", False, None)]
    got = values(spark, rows, "t string, s boolean, z double", text.transfer_type(F.col("t"), F.col("s"), F.col("z")))
    assert [g[0] for g in got] == ["genre_change", "register_shift", "archaic", "register_shift", "category_shift"]


def test_vectors(spark):
    got = values(spark, [([3.0, 4.0], [1.0, 2.0])], "a array<float>, b array<float>", numeric.dot(F.col("a"), F.col("b")), numeric.unit(F.col("a")))
    assert got == [(11.0, [0.6, 0.8])]
