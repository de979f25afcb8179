"""SQL twins of the queries in ``catalog_tables``."""

from __future__ import annotations

from ..functions.text import CATEGORY_NAMES
from ..schemas import LAYERS, STAGE_LABELS
from .oracle import _ANALYSIS, _BEST_LINKS, _FORMATION, _GENS, _LENS, _LOGITS, _MOVES, _PAIR_METRICS, _PIECES, _SPLIT, _STAGES, _STEP_WORDS, _T4, _W, ORACLE_SQL

_LABELS = ("sexual_liminal_1", "sexual_explicit_12", "violence_liminal_2", "violence_explicit", "death_3", "power_1", "profanity_9", "substance_2", "neutral_1", "neutral", "unknown_thing_4", "other")
_VALUES = ", ".join(f"'{x}'" for x in _LABELS)
_STEM = r"CASE WHEN regexp_matches(label, '\d$') THEN regexp_replace(label, '_[^_]*$', '') ELSE label END"


def _dec(x: str, n: int = 4) -> str:
    return f"round({x} + 1e-9, {n})::DECIMAL(20, {n})::VARCHAR"


def _sections(a: str, b: str, down: str, up: str) -> str:
    return f"""SELECT prompt, section, rank::INTEGER AS rank, word || ': ' || {_dec(a)} || ' -> ' || {_dec(b)} AS line FROM (SELECT *, row_number() OVER (PARTITION BY prompt, section ORDER BY size DESC, word) AS rank FROM
      (SELECT *, CASE WHEN {a} - {b} > 0.0005 THEN '{down}' WHEN {a} - {b} < -0.0005 THEN '{up}' END AS section, round(abs({a} - {b}), 9) AS size FROM wide WHERE abs({a}) > 0.0005 OR abs({b}) > 0.0005) WHERE section IS NOT NULL) WHERE rank <= 15"""


def _trajectories(by: str, keep: str) -> str:
    return f"""WITH {_FORMATION}, m AS (SELECT *, round(base + sft + dpo + rlvr, 6) AS mass, round(greatest(abs(base - sft), abs(sft - dpo), abs(dpo - rlvr)), 6) AS delta FROM formation)
      SELECT prompt, rank::INTEGER AS rank, word, base, sft, dpo, rlvr, trajectory, mass, delta FROM (SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY {by} DESC, word) AS rank FROM m WHERE {keep}) WHERE rank <= 120"""


_T = "greatest(-1.0, least(1.0, log10(greatest(b, 1e-7) / greatest(a, 1e-7)) / 1.5))"
_FAMILIES = "fm AS (SELECT * FROM (" + " UNION ALL ".join(f"SELECT lang AS family, '{x}' AS layer, {k}::INTEGER AS ord, lang || '/{x}' AS model_id, count(*) FILTER ({_STAGES[x]}) AS n_documents FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang" for k, x in enumerate(LAYERS)) + ") WHERE n_documents > 0)"
_TOGETHER = {1: ["base"], 3: ["base", "sft", "dpo"], 4: list(LAYERS)}
_LETTERS = ", ".join(f"(length(coalesce(psg, '')) - length(replace(coalesce(psg, ''), '{x}', '')))::DOUBLE AS v_{x}" for x in "etaoinsr")

TABLE_SQL: dict[str, str] = {
    "first_piece_scores": f"WITH {_PIECES}, ca AS (SELECT prompt, word, substr(word, 1, 3) AS piece FROM (SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY n DESC, word) AS r FROM tw) WHERE r <= 20), fp AS (SELECT prompt, piece, n::DOUBLE / (sum(n) OVER (PARTITION BY prompt))::DOUBLE AS p FROM fi) SELECT prompt, word, round(p / sum(p) OVER (PARTITION BY prompt), 6) AS prob FROM ca JOIN fp USING (prompt, piece)",
    "stage_orderings": f"WITH {_FORMATION} SELECT prompt, CASE WHEN base > sft AND sft > dpo THEN 'falls' WHEN base < sft AND sft < dpo THEN 'rises' WHEN base > sft AND sft < dpo THEN 'falls, then rises' WHEN base < sft AND sft > dpo THEN 'rises, then falls' ELSE 'other' END AS ordering, count(*) AS n FROM formation GROUP BY ALL",
    "focused_shift": f"""WITH {_LOGITS}, v AS (SELECT DISTINCT prompt, token_id FROM (SELECT *, row_number() OVER (PARTITION BY prompt, layer ORDER BY logit DESC, token_id) AS r FROM lg) WHERE r <= 20),
      e2 AS (SELECT prompt, layer, token_id, exp(logit - max(logit) OVER (PARTITION BY prompt, layer)) AS e FROM lg JOIN v USING (prompt, token_id)), sc AS (SELECT prompt, layer, token_id, round(e / sum(e) OVER (PARTITION BY prompt, layer), 6) AS prob FROM e2),
      w AS (SELECT prompt, token_id::VARCHAR AS word, coalesce(max(prob) FILTER (layer = 'base'), 0) AS base, coalesce(max(prob) FILTER (layer = 'sft'), 0) AS sft FROM sc GROUP BY ALL)
      SELECT prompt, 'base_sft' AS axis, word, round(base, 6) AS base, round(base, 6) AS p_from, round(sft, 6) AS p_to, round(base - sft, 6) AS delta, round(CASE WHEN base > sft THEN base / (sft + 1e-10) ELSE -(sft / (base + 1e-10)) END, 3) AS ratio, base - sft > 0.005 AS down, base - sft < -0.005 AS up FROM w WHERE base > 0 OR sft > 0""",
    "trajectories_by_mass": _trajectories("mass", "greatest(base, sft, dpo, rlvr) > 0.002"),
    "trajectories_by_change": _trajectories("delta", "greatest(base, sft, dpo, rlvr) > 0.004 OR delta > 0.0004"),
    "link_plot": f"""WITH {_BEST_LINKS}, f AS (SELECT prompt, word, round(base, 6) AS base, round(sft, 6) AS sft FROM wide WHERE round(base, 6) > 0.0005 OR round(sft, 6) > 0.0005),
      l AS (SELECT k.prompt, k.other AS source, k.word AS target, similarity, s.base AS a, t.sft AS b FROM links k JOIN f s ON s.prompt = k.prompt AND s.word = k.other JOIN f t ON t.prompt = k.prompt AND t.word = k.word WHERE link = 'source' AND axis = 'sublimation'),
      c AS (SELECT *, round({_T}, 9) AS t FROM l)
      SELECT prompt, source, target, similarity, a AS source_base, b AS target_sft, 'rgba(' || floor(200.0 * greatest(-t, 0) + 120.0 * (1 - abs(t)))::BIGINT || ',' || floor(100.0 * (1 - abs(t)) + 80.0)::BIGINT || ',' || floor(200.0 * greatest(t, 0) + 120.0 * (1 - abs(t)))::BIGINT || ',0.6)' AS colour FROM c""",
    "drive_ranking": f"WITH {_ANALYSIS} SELECT prompt, rank::INTEGER AS rank, word, effective_mass, role FROM (SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY effective_mass DESC NULLS LAST, word) AS rank FROM analysis) WHERE rank <= 150",
    "absorption_ranking": f"WITH {_T4}, a AS (SELECT prompt, target, count(*) AS n_sources, round(sum(mass), 9) AS mass FROM edges GROUP BY prompt, target) SELECT *, (row_number() OVER (PARTITION BY prompt ORDER BY mass DESC, target))::INTEGER AS by_mass, (row_number() OVER (PARTITION BY prompt ORDER BY n_sources DESC, mass DESC, target))::INTEGER AS by_sources FROM a",
    "curve_legend": f"WITH {_STEP_WORDS}, m AS (SELECT label, token, round(avg(base_probability), 9) AS mean FROM sw GROUP BY ALL) SELECT label, (row_number() OVER (PARTITION BY label ORDER BY mean DESC, token))::INTEGER AS rank, token, round(mean, 6) AS mean FROM m",
    "lens_words": f"""WITH {_LENS}, t AS (SELECT DISTINCT model, prompt, word, 0 AS part FROM lens WHERE source = 'tracked'), o AS (SELECT model, prompt, word, 1 AS part FROM lens WHERE source = 'top_k' GROUP BY ALL HAVING count(DISTINCT net_layer) >= 2),
      a AS (SELECT model, prompt, word, min(part) AS part FROM (SELECT * FROM t UNION ALL SELECT * FROM o) GROUP BY ALL), k AS (SELECT DISTINCT model, prompt FROM lens WHERE source = 'tracked' UNION SELECT model, prompt FROM o) SELECT model, prompt, string_agg(word, ',' ORDER BY part, word) AS words FROM k JOIN a USING (model, prompt) GROUP BY ALL""",
    "log_perplexities": f"SELECT item_id, round(ln(perplexity), 6) AS log_perplexity FROM ({ORACLE_SQL['perplexity']}) WHERE NOT isnan(perplexity)",
    "chosen_steps": f"SELECT * FROM ({ORACLE_SQL['step_metrics']}) WHERE step IN (1, 3, 5)",
    "generation_metrics": f"""WITH e AS ({ORACLE_SQL['first_word_entropy']}), d AS ({ORACLE_SQL['centroid_dist']}), v AS ({ORACLE_SQL['intra_variance']}), m AS ({ORACLE_SQL['mean_cosine']}), s AS ({ORACLE_SQL['silhouette']})
      SELECT label, entropy_base, words_base, entropy_sft, words_sft, distance_sft, variance_base, variance_sft, cosine_base, cosine_sft, silhouette
      FROM (SELECT label, max(entropy) FILTER (model = 'base') AS entropy_base, max(unique_first_words) FILTER (model = 'base') AS words_base, max(entropy) FILTER (model = 'sft') AS entropy_sft, max(unique_first_words) FILTER (model = 'sft') AS words_sft FROM e GROUP BY label)
      LEFT JOIN (SELECT label, max(distance) FILTER (model = 'sft') AS distance_sft FROM d GROUP BY label) USING (label) LEFT JOIN (SELECT label, max(variance) FILTER (model = 'base') AS variance_base, max(variance) FILTER (model = 'sft') AS variance_sft FROM v GROUP BY label) USING (label)
      LEFT JOIN (SELECT label, max(mean_cosine) FILTER (model = 'base') AS cosine_base, max(mean_cosine) FILTER (model = 'sft') AS cosine_sft FROM m GROUP BY label) USING (label) LEFT JOIN s USING (label)""",
    "formation_report": f"WITH {_W} " + " UNION ALL ".join(_sections(*x) for x in (("base", "sft", "sublimated", "introduced"), ("sft", "dpo", "repressed", "amplified"), ("dpo", "rlvr", "further suppressed", "further amplified"))),
    "shift_report": f"""WITH {_W}, d AS (SELECT *, CASE WHEN sft - dpo > 0.0005 THEN 'repressed' WHEN sft - dpo < -0.0005 THEN 'amplified' END AS section, round(abs(sft - dpo), 9) AS size, CASE WHEN sft > dpo THEN sft / (dpo + 1e-10) ELSE dpo / (sft + 1e-10) END AS ratio FROM wide WHERE sft > 0 OR dpo > 0 OR base > 0)
      SELECT prompt, section, rank::INTEGER AS rank, word || ': ' || {_dec('sft')} || ' -> ' || {_dec('dpo')} || ' (' || {_dec('ratio', 1)} || 'x)' AS line FROM (SELECT *, row_number() OVER (PARTITION BY prompt, section ORDER BY size DESC, word) AS rank FROM d WHERE section IS NOT NULL) WHERE rank <= 15""",
    "metrics_report": f"WITH {_PAIR_METRICS} SELECT prompt, pair, 'kl=' || {_dec('kl')} || ' js=' || {_dec('js')} || ' overlap=' || {_dec('overlap')} || ' rank_corr=' || {_dec('rank_corr')} AS line FROM met",
    "pairs_report": f"WITH {_MOVES} SELECT prompt, axis, rank::INTEGER AS rank, source || ' -> ' || target || ' sim=' || {_dec('similarity')} || ' layer=' || net_layer AS line FROM (SELECT *, row_number() OVER (PARTITION BY prompt, axis ORDER BY similarity DESC, source, target, net_layer) AS rank FROM (SELECT *, round(sim, 6) AS similarity FROM sims WHERE sim >= 0.15)) WHERE rank <= 25",
    "label_categories": f"SELECT label, CASE WHEN label LIKE 'sexual\\_liminal%' ESCAPE '\\' THEN 'sexual (liminal)' WHEN label LIKE 'sexual\\_explicit%' ESCAPE '\\' THEN 'sexual (explicit)' WHEN label LIKE 'violence%' THEN 'violence' WHEN label LIKE 'neutral%' THEN 'neutral' ELSE 'other' END AS coarse, CASE {_STEM} {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in CATEGORY_NAMES.items())} ELSE {_STEM} END AS category, count(*) AS n FROM (SELECT [{_VALUES}][doc_id % {len(_LABELS)} + 1] AS label FROM documents) GROUP BY label",
    "prefixed_labels": f"SELECT label, n_down, n_up FROM ({ORACLE_SQL['battery_summary']}) WHERE starts_with(label, 'en')",
    "stage_captions": f"WITH {_LOGITS}, n AS (SELECT layer, count(*) AS n FROM lg GROUP BY layer UNION ALL SELECT 'other', 0) SELECT CASE layer {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in STAGE_LABELS.items())} ELSE layer END AS caption, CASE layer {' '.join(f'''WHEN '{k}' THEN {i + 1}''' for i, k in enumerate(LAYERS))} ELSE 5 END::INTEGER AS ord, n FROM n",
    "prompt_labels": "WITH p AS (SELECT item_id AS ord, 'item_' || (item_id % 50) AS label, text AS prompt FROM benchmark) SELECT md5(prompt) AS prompt_md5, arg_min(label, ord) AS label FROM p WHERE label IN (SELECT label FROM p WHERE ord % 50 < 40) AND prompt IN (SELECT prompt FROM p WHERE ord % 3 = 0) GROUP BY prompt",
    "prompt_prefixes": f"SELECT item_id, {', '.join(f'substr(text, 1, {n}) AS first_{n}' for n in (50, 60, 80, 100))} FROM benchmark",
    "prompt_slugs": r"SELECT item_id, trim(substr(regexp_replace(lower(trim(text)), '[^a-z0-9]+', '_', 'g'), 1, 50), '_') AS slug, array_to_string(list_slice(regexp_split_to_array(trim(text), '\s+'), 1, 5), '_') AS first_words FROM benchmark",
    "model_families": f"WITH {_FAMILIES} SELECT *, count(*) OVER (PARTITION BY family) AS n_layers, family = 'en' AS is_default FROM fm",
    "tracked_words": f"SELECT 'list_' || (ord % 5) AS category, count(*) AS n, min(ord) AS first FROM (SELECT token, min(item_id) AS ord FROM (SELECT item_id, unnest(regexp_split_to_array(lower(text), '{_SPLIT}')) AS token FROM benchmark) WHERE token <> '' GROUP BY token) GROUP BY ALL",
    "coerced_numbers": r"SELECT doc_id, coalesce(try_cast(source AS DOUBLE), 0) AS source_number, coalesce(try_cast(regexp_extract(source, '(\d+)', 1) AS DOUBLE), 0) AS digits, coalesce(try_cast(doc_id::VARCHAR AS DOUBLE), 0) AS id_number FROM documents",
    "passage_vectors": f"WITH {_GENS} SELECT gen_id, label, model, len(vec)::INTEGER AS dims, round(list_sum(vec), 6) AS total FROM gv",
    "embedded_passages": f"WITH {_GENS} SELECT gen_id, {_LETTERS} FROM gens",
    "contextual_vectors": "WITH h AS (SELECT vec_id // 8 AS word, embedding::DOUBLE[] AS vec FROM embeddings WHERE vec_id % 8 >= (vec_id // 8) % 3 + 2), m AS (SELECT word, (i - 1)::INTEGER AS dim, avg(vec[i]) AS x FROM h, range(1, 65) AS t(i) GROUP BY ALL) SELECT word, dim, round((x / greatest(sqrt(sum(x * x) OVER (PARTITION BY word)), 1e-12))::FLOAT::DOUBLE, 5) AS x FROM m",
    "csv_round_trip": ORACLE_SQL["formation_table"],
    "parquet_round_trip": f"SELECT * FROM ({ORACLE_SQL['formation_table']}) WHERE trajectory <> 'flat'",
    "json_round_trip": f"SELECT prompt, word, coalesce(drive_weight, 0) AS drive_weight, n_condensation_sources, role FROM ({ORACLE_SQL['analysis_table']})",
    "large_sim_pairs": f"WITH {_MOVES.replace('r <= 200', 'r <= 2000').replace('0.0005', '0.00005')} SELECT prompt, axis, net_layer, source, target, round(sim, 6) AS similarity FROM sims WHERE sim >= 0.4",
    "cached_scores": ORACLE_SQL["id_scores"],
    "versioned_scores": ORACLE_SQL["id_scores"],
    "uncached_keys": "SELECT source FROM documents EXCEPT SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1",
    "logged_passages": f"WITH {_GENS} SELECT family, label, model, gen_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY family, label, model ORDER BY 1 - gen_id % 2, gen_id) AS seq FROM gens) WHERE seq <= 3",
    "missing_passages": f"WITH {_GENS} SELECT family, label, model, 40 - count(*) AS deficit FROM gens GROUP BY ALL HAVING count(*) < 40",
    "loaded_checkpoints": f"WITH {_FAMILIES} SELECT family, together::INTEGER AS together, count(*) AS n, arg_max(model_id, ord) AS last_model FROM fm JOIN (VALUES {', '.join(f'({n}, {chr(39)}{s}{chr(39)})' for n, stages in _TOGETHER.items() for s in stages)}) AS u(together, layer) USING (layer) GROUP BY ALL",
    "rank_by_layer": f"WITH {_FORMATION} SELECT prompt, layer, word, (row_number() OVER (PARTITION BY prompt, layer ORDER BY prob DESC, word))::INTEGER AS place FROM melted",
}
