"""Every catalogue query against its SQL twin, at the smallest scale, for a sample of operators; the rest for their plans."""

import glob
import os
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from shiftloom.plans import catalog, catalog_learnt, catalog_sql, catalog_stats

SF = "/root/testdata/sf0.001"
HELD = ("shift_sft_dpo", "formation_table", "id_scores", "battery_summary", "metrics_wide", "top_movers", "best_links", "orphans", "transfer_v4", "absorption", "prompt_words", "silhouette", "step_metrics", "perplexity", "lens_rows", "taxonomy_pairs", "mann_whitney", "discover_words", "sample_tokens", "redistributed_step",
        "overdetermination", "perm_test_best_1000", "formation_links", "link_plot", "formation_report", "pairs_report", "lens_words", "generation_metrics", "cached_scores", "large_sim_pairs", "versioned_scores", "logged_passages", "csv_round_trip", "json_round_trip", "contextual_vectors", "prompt_labels", "label_categories", "first_piece_scores", "model_families", "tracked_words", "loaded_checkpoints")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(df: pd.DataFrame) -> list[str]:
    clean = lambda v: "null" if v is None or v != v else float(v) + 0.0 if isinstance(v, float) else str(v)
    return sorted(repr([clean(v) for v in r]) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", HELD)
def test_query_equals_its_sql(spark, duck, name):
    assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(catalog.ORACLE_SQL[name]).df())


def test_every_query_has_sql_of_the_same_columns(spark, duck):
    plain = {"generated_ids", "refreshed_ids", *catalog_learnt.NAMES, *catalog_sql.NAMES, *catalog_stats.NAMES}  # held against plain versions here, in test_learnt, test_sql and test_statistics
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL) | plain
    for name in sorted(set(catalog.ORACLE_SQL) - set(HELD)):
        sql = catalog.ORACLE_SQL[name]
        assert sorted(catalog.QUERIES[name](spark, SF).columns) == sorted(r[0] for r in duck.execute(f"DESCRIBE {sql}").fetchall())


def test_generated_ids_against_a_plain_loop(spark, duck):
    """Three redistributed steps of some prompts, worked out one at a time."""
    import hashlib

    import numpy as np

    logits = {(v // 4, v % 4): np.array(e, float) for v, e in duck.execute("SELECT vec_id, embedding FROM embeddings").fetchall()}
    many = 1 + max(p for p, s in logits if all((p, t) in logits for t in range(3)))
    soft = lambda x: np.exp(x / 0.05 - (x / 0.05).max()) / np.exp(x / 0.05 - (x / 0.05).max()).sum()
    vectors = np.array([np.mean([e for v, e in ((4 * p + s, x) for (p, s), x in logits.items()) if v % 64 == t], axis=0) for t in range(64)])

    def step(like):
        base, sft, dpo = (soft(logits[like, s]) for s in range(3))
        fall = sft - dpo
        gone = fall > 0.001
        mass = np.where(gone, fall * (1 + np.log(1 + base / (base[base > 0].mean() + 1e-10))) * 0.3, 0.0)
        out = np.where(gone, 0.0, dpo)
        sources = sorted(np.flatnonzero(gone & (mass >= 1e-6)), key=lambda t: (-mass[t], t))[:20]
        targets = sorted(np.flatnonzero(~gone & (dpo > 1e-6)), key=lambda t: (-dpo[t], t))[:100]
        for s in sources:
            sim = np.maximum(vectors[targets] @ vectors[s], 0)
            if sim.sum() > 0:
                out[targets] += mass[s] * sim / sim.sum()
        return out / out.sum()

    got = {r.prompt: r.ids for r in catalog.QUERIES["generated_ids"](spark, SF).collect()}
    same = 0
    for prompt in range(0, 40):
        ids = []
        for k in range(3):
            p = step((prompt + sum(ids)) % many)
            order = sorted(range(64), key=lambda t: (-p[t], t))
            u = int(hashlib.md5(f"{prompt}:{k}:0".encode()).hexdigest()[:8], 16) / 4294967296
            ids.append(next((t for t, c in zip(order, np.cumsum(p[order]), strict=True) if c >= u), order[-1]))
        same += got[prompt] == ",".join(map(str, ids))
    assert same == 40


def test_refreshed_ids_against_a_plain_loop(spark, duck):
    import hashlib

    import numpy as np

    from shiftloom.plans.catalog_tables import REFRESH, STEPS

    rows = {v: np.array(e, float) for v, e in duck.execute("SELECT vec_id, embedding FROM embeddings").fetchall()}
    logits = {(v // 4, v % 4): e for v, e in rows.items()}
    many = 1 + max(p for p, s in logits if all((p, t) in logits for t in range(3)))
    soft = lambda x: np.exp(x / 0.05 - (x / 0.05).max()) / np.exp(x / 0.05 - (x / 0.05).max()).sum()
    got, stale, ended = {r.prompt: r for r in catalog.QUERIES["refreshed_ids"](spark, SF).collect()}, 0, 0
    assert len(got) == many
    for prompt in range(many):
        ids, log, links = [], [], None
        for step in range(STEPS):
            base, sft, dpo = (soft(logits[(prompt + sum(ids)) % many, s]) for s in range(3))
            fall = sft - dpo
            gone = fall > 0.0005
            mass = np.where(gone, fall * (1 + np.log(1 + base / (base[base > 0].mean() + 1e-10))) * 0.3, 0.0)
            sources = sorted(np.flatnonzero(gone), key=lambda t: (-mass[t], t))[:20]
            targets = sorted(np.flatnonzero(~gone & (dpo > 1e-6)), key=lambda t: (-dpo[t], t))[:100]
            if (step % REFRESH == 0 or links is None) and sources and targets:
                vec = [rows[(prompt * 31 + sum(ids) * 7 + t) % len(rows)] for t in range(64)]
                unit = [v / np.linalg.norm(v) for v in vec]
                links = {(s, t): max(0.0, float(unit[s] @ unit[t])) for s in sources for t in targets}
            out = np.where(gone, 0.0, dpo)
            for s in {s for s, _ in links or {}}:
                total = sum(x for (a, _), x in links.items() if a == s)
                if mass[s] >= 1e-6 and total > 0:
                    for (a, t), x in links.items():
                        if a == s:
                            out[t] += mass[s] * x / total
                            stale += gone[t] and x > 0
            p = out / out.sum()
            order = sorted(range(64), key=lambda t: (-p[t], t))
            u = int(hashlib.md5(f"{prompt}:{step}:0".encode()).hexdigest()[:8], 16) / 4294967296
            token = next((t for t, c in zip(order, np.cumsum(p[order]), strict=True) if c >= u), order[-1])
            ids.append(token)
            log += [f"{step}:{token}"] if p[token] - dpo[token] > 0.003 else []
            if token == 0:
                ended += 1
                break
        assert (got[prompt].ids, got[prompt].log) == (",".join(map(str, ids)), ",".join(log)), prompt
    assert stale > 0 and ended > 0 and any(r.log for r in got.values())


def test_entry_points(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_scans_read_only_what_they_need(spark):
    plan = catalog.QUERIES["silhouette"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "conv_id" in plan and "ReadSchema: struct<conv_id:bigint,turn:bigint,role:string>" in plan


@pytest.mark.parametrize("name", ("catalog", "catalog_tables", "catalog_learnt", "catalog_sql", "catalog_stats"))
def test_modules_of_the_catalogue_can_come_first(name):
    """A Python worker imports the module of the function that it runs, before any other."""
    subprocess.run([sys.executable, "-c", f"import shiftloom.plans.{name} as m; from shiftloom.plans import catalog as c; assert 'embedded_passages' in c.QUERIES"], check=True, timeout=100)


def test_embedded_passages_equal_their_sql(spark, duck):
    assert rows(catalog.QUERIES["embedded_passages"](spark, SF).toPandas()) == rows(duck.execute(catalog.ORACLE_SQL["embedded_passages"]).df())
