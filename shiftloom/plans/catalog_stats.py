"""Named queries of tests and draws: p-values, permutation tests by keyed bijections. Those with a twin draw the same numbers in
DuckDB's SQL; the others are held against plain versions in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import permutations as perm
from ..operators import sampling, stats
from ..sources import bindings as b
from . import catalog as c
from .catalog import query, rounded
from .oracle import _P_VALUE, _U, _W, ORACLE_SQL

#: Queries of this module without a twin.
NAMES = ["mann_whitney_p_values", "gen_vs_logit_p_value", "perm_pairs_mean"]
PERMUTATIONS = 1000


@query
def mann_whitney_p_values(spark, sf_dir):
    """The divergences of every seventh prompt against the others', by family, with p-values of either tail."""
    rows = c._battery(spark, sf_dir).withColumn("js", F.round("js", 9))
    return rounded(stats.mann_whitney(rows, ["family"], "js", F.col("prompt") % 7 == 0), p_greater=9, p_less=9, p_two_sided=9)


@query
def gen_vs_logit_p_value(spark, sf_dir):
    """Correlation of both distances over all families and labels, with its p-value."""
    rows = c.gen_vs_logit_join(spark, sf_dir).withColumn("kind", F.lit("js_distance"))
    return rounded(stats.pearson_test(rows, ["kind"], "js_logit", "distance_gen"))


def labelled_vectors(spark, sf_dir):
    return b.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("grp"), F.col("embedding").alias("vec"))


@query
def perm_keyed_mean(spark, sf_dir):
    return rounded(perm.mean_tests(labelled_vectors(spark, sf_dir).where("grp IN (0, 1)"), PERMUTATIONS).select("observed", "p_value"))


@query
def perm_keyed_best(spark, sf_dir):
    return rounded(perm.best_test(labelled_vectors(spark, sf_dir), PERMUTATIONS, 0, 1))


@query
def perm_pairs_mean(spark, sf_dir):
    """Mean similarity across every two labels, against shuffled labels."""
    return rounded(perm.mean_tests(labelled_vectors(spark, sf_dir), PERMUTATIONS))


@query
def sample_words(spark, sf_dir):
    """A thousand words of each language and stage, drawn by how often they occur there, from all its words."""
    counts = b.long_counts(c.word_counts(spark, sf_dir), "prompt")
    return sampling.draw_by_ranges(counts.withColumnRenamed("n", "weight"), ["prompt", "layer"], 1000)


_N = "SELECT count(*) FROM it"
_KEYED = f"""WITH RECURSIVE it AS (SELECT vec_id AS id, label AS grp, embedding::DOUBLE[] AS vec, row_number() OVER (ORDER BY label, vec_id) - 1 AS pos FROM embeddings WHERE label IN (0, 1)), {perm.places_sql("it", _N, PERMUTATIONS)},
    pm AS (SELECT perm, id, CASE WHEN place < (SELECT count(*) FROM it WHERE grp = 0) THEN 0 ELSE 1 END AS grp FROM pl JOIN it USING (pos) UNION ALL SELECT 0, id, grp FROM it)"""
_AFTER = {name: ORACLE_SQL[name].split("t(perm))", 1)[1] for name in ("perm_test_mean", "perm_test_best")}
ORACLE_SQL["perm_keyed_mean"] = _KEYED + _AFTER["perm_test_mean"]
ORACLE_SQL["perm_keyed_best"] = _KEYED + _AFTER["perm_test_best"]
assert all(_P_VALUE in ORACLE_SQL[n] for n in ("perm_keyed_mean", "perm_keyed_best"))
ORACLE_SQL["sample_words"] = f"""WITH {_W}, cw AS (SELECT prompt, layer, word, sum(n) OVER (PARTITION BY prompt, layer ORDER BY n DESC, word ROWS UNBOUNDED PRECEDING)::DOUBLE AS cum FROM longs),
    tt AS (SELECT prompt, layer, max(cum) AS total FROM cw GROUP BY ALL), dh AS (SELECT *, substr(md5(prompt || ':' || layer || ':' || draw), 1, 8) AS h FROM tt, range(0, 1000) AS t(draw)),
    du AS (SELECT prompt, layer, draw, {_U} * total AS x FROM dh)
    SELECT du.prompt, du.layer, draw::INTEGER AS draw, word FROM du ASOF JOIN cw ON du.prompt = cw.prompt AND du.layer = cw.layer AND du.x <= cw.cum"""
