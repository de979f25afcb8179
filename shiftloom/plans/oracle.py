"""SQL twins of the catalogue's queries, for DuckDB over the same tables."""

from __future__ import annotations

from ..functions.text import GENRE_TOKENS
from ..schemas import LAYERS, PAIRS

_SPLIT = "[^a-zß-öø-ÿ]+"
_STAGES = {"base": "true", "sft": "quality = 1", "dpo": "quality = 1 AND toxic = 0", "rlvr": "quality = 1 AND toxic = 0 AND n_chars >= 1000"}
_STAGE_NAME = "['base', 'sft', 'dpo', 'rlvr'][vec_id % 4 + 1]"


def _dist(prompt: str = "lang") -> str:
    """CTEs tok .. wide."""
    counts = ", ".join(f"count(*) FILTER ({c}) AS n_{s}" for s, c in _STAGES.items())
    longs = " UNION ALL ".join(f"SELECT prompt, '{s}' AS layer, word, n_{s} AS n FROM counts WHERE n_{s} > 0" for s in LAYERS)
    merged = ", ".join(f"coalesce(max(prob) FILTER (layer = '{s}'), 0) AS {s}" for s in LAYERS)
    return f"""
    tok AS (SELECT * FROM (SELECT {prompt} AS prompt, n_chars, quality, toxic, unnest(regexp_split_to_array(lower(text), '{_SPLIT}')) AS word
            FROM documents LEFT JOIN labels USING (doc_id)) WHERE word <> ''),
    counts AS (SELECT prompt, word, {counts} FROM tok GROUP BY prompt, word),
    longs AS ({longs}),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prompt, layer ORDER BY n DESC, word) AS r FROM longs) WHERE r <= 200),
    dist AS (SELECT prompt, layer, word, n::DOUBLE / (sum(n) OVER (PARTITION BY prompt, layer))::DOUBLE AS prob FROM best),
    wide AS (SELECT prompt, word, {merged} FROM dist GROUP BY prompt, word)"""


_W = _dist()
_FORMATION = (
    _W
    + """,
    f0 AS (SELECT prompt, word, round(base, 6) AS base, round(sft, 6) AS sft, round(sft - base, 6) AS sft_minus_base, round(dpo, 6) AS dpo, round(dpo - sft, 6) AS dpo_minus_sft,
           round(dpo - base, 6) AS dpo_minus_base, round(rlvr, 6) AS rlvr, round(rlvr - dpo, 6) AS rlvr_minus_dpo FROM wide),
    formation AS (SELECT *, CASE WHEN base - sft > 0.0005 AND sft - dpo > 0.0005 THEN 'decline' WHEN sft - base > 0.0005 AND dpo - sft > 0.0005 THEN 'rise'
           WHEN base - sft > 0.0005 AND dpo - sft > 0.0005 THEN 'V' WHEN sft - base > 0.0005 AND sft - dpo > 0.0005 THEN 'peak'
           WHEN base > 0.0005 AND sft < 0.0005 AND dpo < 0.0005 THEN 'eliminated' WHEN base < 0.0005 AND sft < 0.0005 AND dpo > 0.0005 THEN 'superego_only' ELSE 'flat' END AS trajectory FROM f0),
    melted AS (SELECT prompt, word, unnest(['base', 'sft', 'dpo', 'rlvr']) AS layer, unnest([base, sft, dpo, rlvr]) AS prob FROM formation)"""
)
_LOGITS = f"""
    lg AS (SELECT vec_id // 4 AS prompt, {_STAGE_NAME} AS layer, (i - 1)::INTEGER AS token_id, embedding[i]::DOUBLE AS logit FROM embeddings, range(1, 65) AS t(i)),
    ex AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY prompt, layer)) AS e FROM lg),
    sm AS (SELECT prompt, layer, token_id, logit, e / sum(e) OVER (PARTITION BY prompt, layer) AS prob FROM ex)"""
_TOKEN_PAIRS = (
    _LOGITS
    + ", side AS (SELECT prompt, token_id, "
    + ", ".join(f"max(prob) FILTER (layer = '{s}') AS {s}" for s in LAYERS)
    + " FROM sm GROUP BY prompt, token_id), pt AS (SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT prompt, token_id, '{a}_{b}' AS pair, {a} AS pa, {b} AS pb FROM side" for a, b in PAIRS)
    + ") WHERE pa IS NOT NULL AND pb IS NOT NULL)"
)


def _metrics(source: str, keys: str, item: str, k: int) -> str:
    p, q = "greatest(pa, 1e-10)", "greatest(pb, 1e-10)"
    m = f"(({p} + {q}) * 0.5)"
    return f"""
    ranked AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY pa DESC, {item}) AS ra, row_number() OVER (PARTITION BY {keys} ORDER BY pb DESC, {item}) AS rb,
       rank() OVER (PARTITION BY {keys} ORDER BY pa) + (count(*) OVER (PARTITION BY {keys}, pa) - 1) / 2.0::DOUBLE AS aa,
       rank() OVER (PARTITION BY {keys} ORDER BY pb) + (count(*) OVER (PARTITION BY {keys}, pb) - 1) / 2.0::DOUBLE AS ab FROM {source}),
    met AS (SELECT {keys}, -sum({p} * ln({p})) AS entropy_a, -sum({q} * ln({q})) AS entropy_b, sum({p} * (ln({p}) - ln({q}))) AS kl,
       sum(0.5 * ({p} * (ln({p}) - ln({m})) + {q} * (ln({q}) - ln({m})))) AS js, count(*) FILTER (ra <= {k} AND rb <= {k}) / {k}::DOUBLE AS overlap, corr(aa, ab) AS rank_corr FROM ranked GROUP BY {keys})"""


_PAIR_METRICS = _TOKEN_PAIRS + "," + _metrics("pt", "prompt, pair", "token_id", 10)
_MOVES = (
    _W
    + """,
    vocab AS (SELECT prompt, word, row_number() OVER (PARTITION BY prompt ORDER BY word) - 1 AS rk FROM wide),
    placed AS (SELECT prompt, word, h AS net_layer, (rk * 7 + h) % (SELECT count(*) FROM embeddings) AS vr FROM vocab, (VALUES (8), (16), (24)) AS t(h)),
    wv AS (SELECT prompt, word, net_layer, embedding::DOUBLE[] AS vec FROM placed JOIN embeddings ON vec_id = vr),
    deltas AS (SELECT prompt, word, 'sublimation' AS axis, sft - base AS d FROM wide WHERE greatest(base, sft, dpo) > 0.0005 UNION ALL SELECT prompt, word, 'repression', dpo - sft FROM wide WHERE greatest(base, sft, dpo) > 0.0005),
    moves AS (SELECT prompt, axis, word, CASE WHEN d < -0.0005 THEN 'source' ELSE 'target' END AS side FROM deltas WHERE d < -0.0005 OR d > 0.0005),
    mv AS (SELECT * FROM moves JOIN wv USING (prompt, word)),
    sims AS (SELECT s.prompt, s.axis, s.net_layer, s.word AS source, t.word AS target, list_dot_product(s.vec, t.vec) AS sim FROM mv s JOIN mv t USING (prompt, axis, net_layer) WHERE s.side = 'source' AND t.side = 'target')"""
)
_BEST_LINKS = (
    _MOVES
    + """,
    mid AS (SELECT *, round(sim, 6) AS similarity FROM sims WHERE net_layer = 16),
    links AS (SELECT prompt, axis, source AS word, 'target' AS link, target AS other, similarity FROM (SELECT *, row_number() OVER (PARTITION BY prompt, axis, source ORDER BY similarity DESC, target) AS r FROM mid) WHERE r = 1 AND similarity >= 0.15
       UNION ALL SELECT prompt, axis, target, 'source', source, similarity FROM (SELECT *, row_number() OVER (PARTITION BY prompt, axis, target ORDER BY similarity DESC, source) AS r FROM mid) WHERE r = 1 AND similarity >= 0.15)"""
)


def _stem(a: str, b: str) -> str:
    x, y = f"lower({a})", f"lower({b})"
    k = f"greatest(4, ceil(least(length({x}), length({y})) * 3 / 5))::INTEGER"
    return f"(contains({x}, {y}) OR contains({y}, {x}) OR (length({x}) >= {k} AND length({y}) >= {k} AND substr({x}, 1, {k}) = substr({y}, 1, {k})))"


def _transfer(version: int) -> str:
    mass = "effective_mass" if version == 4 else "raw_mass"
    weight = "similarity * (1 + target_base * 10)" if version == 2 else "similarity"
    stems = f"WHERE NOT {_stem('source', 'target')}" if version == 4 else ""
    return (
        _W
        + f""",
    mb AS (SELECT *, coalesce(avg(CASE WHEN base > 0 THEN base END) OVER (PARTITION BY prompt), 1e-10) AS mean_base FROM wide WHERE base > 0 OR sft > 0 OR dpo > 0),
    gone AS (SELECT prompt, word, sft - dpo AS raw_mass, base AS base_drive, 1 + ln(1 + base / (mean_base + 1e-10)) AS drive_weight, (sft - dpo) * (1 + ln(1 + base / (mean_base + 1e-10))) AS effective_mass, sft, dpo FROM mb WHERE sft - dpo > 0.0002),
    allowed AS (SELECT prompt, word, dpo, base FROM wide WHERE dpo > 0.0005 AND (prompt, word) NOT IN (SELECT (prompt, word) FROM gone)),
    vocab AS (SELECT prompt, word, row_number() OVER (PARTITION BY prompt ORDER BY word) - 1 AS rk FROM wide),
    wv AS (SELECT prompt, word, embedding::DOUBLE[] AS vec FROM vocab JOIN embeddings ON vec_id = (rk * 7 + 16) % (SELECT count(*) FROM embeddings)),
    p0 AS (SELECT g.prompt, g.word AS source, a.word AS target, raw_mass, drive_weight, base_drive, effective_mass, a.base AS target_base, list_dot_product(v.vec, w.vec) AS similarity
           FROM gone g JOIN wv v ON g.prompt = v.prompt AND g.word = v.word JOIN allowed a ON a.prompt = g.prompt JOIN wv w ON w.prompt = a.prompt AND w.word = a.word),
    p1 AS (SELECT *, {weight} AS weight FROM (SELECT * FROM p0 {stems}) WHERE similarity >= 0.15),
    edges AS (SELECT * FROM (SELECT prompt, source, target, {mass} * (weight / sum(weight) OVER (PARTITION BY prompt, source)) AS mass, raw_mass AS raw_repression, drive_weight, base_drive, similarity FROM p1) WHERE mass >= 0.00001),
    gain AS (SELECT prompt, target AS word, sum(mass) AS gain FROM edges GROUP BY prompt, target),
    works AS (SELECT DISTINCT prompt FROM gone WHERE prompt IN (SELECT prompt FROM allowed)),
    m AS (SELECT w.prompt, w.word, dpo, dpo + coalesce(gain, 0) AS m FROM wide w LEFT JOIN gain g ON g.prompt = w.prompt AND g.word = w.word WHERE dpo > 0),
    moved AS (SELECT prompt, word, CASE WHEN prompt IN (SELECT prompt FROM works) THEN m / sum(m) OVER (PARTITION BY prompt) ELSE dpo END AS prob FROM m)"""
    )


_T4 = _transfer(4)
_ANALYSIS = (
    _T4
    + """,
    taken AS (SELECT prompt, target AS word, count(*) AS n_sources, sum(mass) AS total_absorbed, string_agg(source, ',' ORDER BY source) AS sources FROM edges GROUP BY prompt, target),
    analysis AS (SELECT w.prompt, w.word, round(base, 6) AS base_drive, round(w.sft, 6) AS ego, round(w.dpo, 6) AS superego, round(coalesce(prob, 0), 6) AS neurotic, round(w.sft - w.dpo, 6) AS raw_repression,
        round(drive_weight, 6) AS drive_weight, round(effective_mass, 6) AS effective_mass, round(coalesce(prob, 0) - w.dpo, 6) AS displaced_mass, coalesce(n_sources, 0)::BIGINT AS n_condensation_sources,
        round(coalesce(total_absorbed, 0), 6) AS total_absorbed, sources AS condensation_sources,
        CASE WHEN w.sft - w.dpo > 0.0005 THEN 'repressed' WHEN w.sft - w.dpo < -0.0005 THEN 'amplified' WHEN coalesce(prob, 0) - w.dpo > 0.00015 THEN 'symptomatic' ELSE 'neutral' END AS role
        FROM wide w LEFT JOIN moved USING (prompt, word) LEFT JOIN (SELECT prompt, word, drive_weight, effective_mass FROM gone) USING (prompt, word) LEFT JOIN taken USING (prompt, word) WHERE base > 0 OR w.sft > 0 OR w.dpo > 0)"""
)
_GENS = """
    gens AS (SELECT conv_id * 4096 + turn AS gen_id, conv_id % 4 AS family, conv_id % 6 AS label, CASE role WHEN 'user' THEN 'base' WHEN 'assistant' THEN 'sft' ELSE 'dpo' END AS model, text AS psg, (conv_id * 4096 + turn) % (SELECT count(*) FROM embeddings) AS vec_row FROM conversations),
    gv AS (SELECT g.*, embedding::DOUBLE[] AS vec FROM gens g JOIN embeddings ON vec_id = vec_row),
    gd AS (SELECT gen_id, family, label, model, i AS dim, vec[i] AS x FROM gv, range(1, 65) AS t(i)),
    cen AS (SELECT label, model, dim, avg(x) AS c FROM gd GROUP BY label, model, dim),
    dist AS (SELECT o.label, o.model, sqrt(sum((o.c - b.c) * (o.c - b.c))) AS distance FROM cen o JOIN cen b ON o.label = b.label AND o.dim = b.dim AND b.model = 'base' WHERE o.model <> 'base' GROUP BY o.label, o.model),
    away AS (SELECT gen_id, label, model, sqrt(sum((x - c) * (x - c))) AS d FROM gd JOIN cen USING (label, model, dim) GROUP BY gen_id, label, model),
    spread AS (SELECT label, model, count(*) AS n, round(avg(d * d) - avg(d) * avg(d), 6) AS variance FROM away GROUP BY label, model HAVING count(*) > 1)"""
_FIRST = r"regexp_extract(coalesce(psg, ''), '^\s*(\S+)', 1)"
_FIRST_STRIPPED = rf"""regexp_replace({_FIRST}, '^[.,;:!?"()\[\]]+|[.,;:!?"()\[\]]+$', '', 'g')"""
_CONCEPTS = (
    _GENS
    + """,
    se AS (SELECT CASE WHEN label < 2 THEN 'first' ELSE 'second' END AS axis, label % 2 AS neg, i AS dim, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) AS t(i) WHERE label IN (0, 1, 2, 3)),
    pq AS (SELECT axis, dim, avg(x) FILTER (neg = 0) AS p, avg(x) FILTER (neg = 1) AS q FROM se GROUP BY axis, dim),
    ax AS (SELECT axis, dim, (p - q) / sqrt(sum((p - q) * (p - q)) OVER (PARTITION BY axis)) AS w, (p + q) * 0.5 AS mid FROM pq),
    cs AS (SELECT label, model, axis, sum((c - mid) * w) AS mean_score FROM cen JOIN ax USING (dim) GROUP BY label, model, axis)"""
)
_STEPS = """
    ec AS (SELECT floor((epoch(ts::TIMESTAMP)::BIGINT - 1704067200) / 259200)::INTEGER AS step, user_id % 6 AS label, json_extract_string(props, '$.k') AS token, count(*) AS n FROM events GROUP BY ALL),
    grid AS (SELECT * FROM (SELECT DISTINCT step, label FROM ec WHERE token IS NOT NULL), (SELECT DISTINCT token FROM ec WHERE token IS NOT NULL)),
    full_ AS (SELECT step, label, token, coalesce(n, 0) AS n FROM grid LEFT JOIN ec USING (step, label, token)),
    probs AS (SELECT step, label, token, (n + 1.0::DOUBLE) / (sum(n) OVER (PARTITION BY step, label) + count(*) OVER (PARTITION BY step, label))::DOUBLE AS p FROM full_),
    ab AS (SELECT s.step, s.label, token, b.p AS pa, s.p AS pb FROM probs s JOIN (SELECT label, token, p FROM probs WHERE step = 0) b USING (label, token) WHERE s.step > 0)"""
_STEP_METRICS = _STEPS + "," + _metrics("ab", "step, label", "token", 10)
_STEP_WORDS = (
    _STEPS
    + """,
    often AS (SELECT token FROM ec WHERE token IS NOT NULL GROUP BY token ORDER BY sum(n) DESC, token LIMIT 8),
    sw AS (SELECT step, label, token, CASE WHEN length(token) < 2 THEN 'short' WHEN token LIKE '%7' THEN 'seven' ELSE 'empirical' END AS word_category, pb AS probability, pa AS base_probability, pb - pa AS delta FROM ab WHERE token IN (SELECT token FROM often))"""
)
_LENS = """
    ll AS (SELECT vec_id // 250 AS model, (vec_id % 250) // 10 AS prompt, (vec_id % 10)::INTEGER AS net_layer, (i - 1)::INTEGER AS token_id, CASE WHEN (i - 1) % 13 = 0 THEN 't' ELSE 't' || (i - 1) END AS word, embedding[i]::DOUBLE AS logit FROM embeddings, range(1, 65) AS t(i)),
    le AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY model, prompt, net_layer)) AS e FROM ll),
    lp AS (SELECT model, prompt, net_layer, token_id, word, e / sum(e) OVER (PARTITION BY model, prompt, net_layer) AS probability, logit FROM le),
    lt AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY model, prompt, net_layer ORDER BY probability DESC, token_id) AS r FROM lp) WHERE r <= 5 AND length(word) >= 2),
    lens AS (SELECT *, 'top_k' AS source FROM lt UNION ALL SELECT *, 'tracked' FROM lp WHERE token_id IN (3, 17) AND (model, prompt, net_layer, word) NOT IN (SELECT (model, prompt, net_layer, word) FROM lt))"""
_TAXONOMY = (
    _MOVES
    + f""",
    fr AS MATERIALIZED (SELECT word, log10(sum(n_base)::DOUBLE / (SELECT sum(n_base) FROM counts)::DOUBLE * 1e9) AS zipf, CASE WHEN regexp_matches(word, '(ing|ed)$') THEN 'VERB' WHEN regexp_matches(word, 'ly$') THEN 'ADV' WHEN regexp_matches(word, 's$') THEN 'NOUN' ELSE 'X' END AS pos FROM counts GROUP BY word),
    tp AS MATERIALIZED (SELECT prompt, axis, source, target, sim AS similarity, net_layer FROM sims WHERE sim >= 0.3),
    tx AS (SELECT prompt, axis, source, target, similarity, net_layer, s.pos AS source_pos, t.pos AS target_pos, t.zipf AS target_freq,
             CASE WHEN target IN ({', '.join(f"'{x}'" for x in GENRE_TOKENS)}) THEN 'genre_change' WHEN t.zipf < 3.0 THEN 'archaic' WHEN s.pos = t.pos THEN 'register_shift' ELSE 'category_shift' END AS displacement_type
             FROM tp LEFT JOIN fr s ON s.word = source LEFT JOIN fr t ON t.word = target
           UNION ALL SELECT prompt, axis, m.word, NULL, NULL, NULL, f.pos, NULL, NULL, 'genre_change' FROM (SELECT * FROM moves WHERE side = 'source') m ANTI JOIN tp ON tp.prompt = m.prompt AND tp.axis = m.axis AND tp.source = m.word LEFT JOIN fr f ON f.word = m.word)"""
)
_PIECES = f"""
    tw AS (SELECT prompt, word, count(*) AS n FROM (SELECT lang AS prompt, unnest(regexp_split_to_array(lower(text), '{_SPLIT}')) AS word FROM documents) WHERE word <> '' GROUP BY ALL),
    pc AS (SELECT prompt, word, n, list_append([substr(word, i::INTEGER, 3) FOR i IN range(1, length(word) + 1, 3)], '$') AS p FROM tw),
    fi AS (SELECT prompt, p[1] AS piece, sum(n)::BIGINT AS n FROM pc GROUP BY ALL),
    mo AS (SELECT prompt, p[i] AS cur, p[i + 1] AS nxt, sum(n)::BIGINT AS n FROM pc, range(1, 60) AS t(i) WHERE i < len(p) GROUP BY ALL),
    mv AS (SELECT *, ln(n::DOUBLE / (sum(n) OVER (PARTITION BY prompt, cur))::DOUBLE) AS lp FROM mo),
    fl AS (SELECT *, ln(n::DOUBLE / (sum(n) OVER (PARTITION BY prompt))::DOUBLE) AS lp FROM fi)"""


def _discover() -> str:
    sql = (
        _PIECES
        + """,
    nb AS (SELECT prompt, cur, nxt, lp AS step FROM (SELECT *, row_number() OVER (PARTITION BY prompt, cur ORDER BY n DESC, nxt) AS r FROM mv) WHERE r = 1),
    s0 AS (SELECT prompt, piece AS cur, piece AS text, lp, false AS done FROM (SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY n DESC, piece) AS r FROM fl) WHERE r <= 200)"""
    )
    for k in range(1, 5):
        sql += f""",
    j{k} AS (SELECT s.*, nxt, step, NOT done AND nxt IS NOT NULL AS go FROM s{k - 1} s LEFT JOIN nb USING (prompt, cur)),
    s{k} AS (SELECT prompt, CASE WHEN go AND nxt <> '$' THEN nxt ELSE cur END AS cur, CASE WHEN go AND nxt <> '$' THEN text || nxt ELSE text END AS text, CASE WHEN go THEN lp + step ELSE lp END AS lp, done OR (go AND nxt = '$') OR nxt IS NULL AS done FROM j{k})"""
    return sql + r""",
    wd AS (SELECT prompt, text AS word, sum(exp(lp)) AS mass FROM s4 WHERE regexp_matches(text, '^\p{L}+$') GROUP BY prompt, text)"""


_LOGPROBS = (
    _PIECES
    + """,
    ca AS (SELECT prompt, word FROM (SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY n DESC, word) AS r FROM tw) WHERE r <= 20),
    cp AS (SELECT prompt, word, p FROM pc JOIN ca USING (prompt, word)),
    rl AS (SELECT prompt, word, sum(lp) AS rlp FROM (SELECT prompt, word, p[i] AS cur, p[i + 1] AS nxt FROM cp, range(1, 60) AS t(i) WHERE i < len(p)) JOIN mv USING (prompt, cur, nxt) GROUP BY ALL),
    lw AS (SELECT prompt, word, round(fl.lp + rlp, 12) AS logp FROM cp JOIN rl USING (prompt, word) JOIN fl USING (prompt) WHERE fl.piece = p[1]),
    le AS (SELECT *, exp(logp - max(logp) OVER (PARTITION BY prompt)) AS e FROM lw)"""
)
_PERM = """
    it AS (SELECT vec_id AS id, label AS grp, embedding::DOUBLE[] AS vec FROM embeddings WHERE label IN (0, 1)),
    pm AS (SELECT perm, id, CASE WHEN perm = 0 THEN grp WHEN row_number() OVER (PARTITION BY perm ORDER BY md5(perm || ':' || id), id) <= count(*) FILTER (grp = 0) OVER (PARTITION BY perm) THEN 0 ELSE 1 END AS grp FROM it, range(0, {n} + 1) AS t(perm))"""
_P_VALUE = "SELECT round(max(v) FILTER (perm = 0), 6) AS observed, round(count(*) FILTER (perm > 0 AND v >= o) / (count(*) FILTER (perm > 0))::DOUBLE, 6) AS p_value FROM (SELECT perm, round(value, 9) AS v, max(round(value, 9)) FILTER (perm = 0) OVER () AS o FROM pv)"
_U = "(list_sum([(instr('0123456789abcdef', substr(h, i::INTEGER, 1)) - 1) * (16::BIGINT ** (8 - i)) FOR i IN range(1, 9)]))::DOUBLE / 4294967296.0"


def _shift(a: str, b: str) -> str:
    return f"""WITH {_W} SELECT prompt, '{a}_{b}' AS axis, word, round(base, 6) AS base, round({a}, 6) AS p_from, round({b}, 6) AS p_to, round({a} - {b}, 6) AS delta,
    round(CASE WHEN {a} > {b} THEN {a} / ({b} + 1e-10) ELSE -({b} / ({a} + 1e-10)) END, 3) AS ratio, {a} - {b} > 0.0005 AS down, {a} - {b} < -0.0005 AS up FROM wide WHERE {a} > 0 OR {b} > 0 OR base > 0"""


def _r(columns: str, places: int = 6) -> str:
    return ", ".join(f"round({c.strip()}, {places}) AS {c.strip()}" for c in columns.split(","))


_METRICS_WIDE = ", ".join(
    ", ".join(f"round(max({c}) FILTER (pair = '{p}'), 6) AS {c}_{p}" if c != "overlap" else f"round(max(overlap) FILTER (pair = '{p}'), 6) AS overlap_{p}" for c in ("kl", "js", "overlap", "rank_corr"))
    + f", round(max(entropy_a) FILTER (pair = '{p}') - max(entropy_b) FILTER (pair = '{p}'), 6) AS entropy_drop_{p}"
    for p in ("base_sft", "sft_dpo", "base_dpo", "dpo_rlvr")
)
_BATTERY = _PAIR_METRICS + ", battery AS (SELECT prompt % 4 AS family, prompt % 6 AS label, prompt, js FROM met WHERE pair = 'base_dpo')"
_TOKEN = "CASE WHEN token_id % 13 = 0 THEN '' ELSE 't' || token_id END"
_GEN_JOIN = (
    _BATTERY
    + ","
    + _GENS
    + """,
    gl AS (SELECT family, label, avg(js) AS js_logit FROM battery GROUP BY ALL),
    fc AS (SELECT family, label, model, dim, avg(x) AS c FROM gd GROUP BY ALL),
    fd AS (SELECT o.family, o.label, sqrt(sum((o.c - b.c) * (o.c - b.c))) AS distance_gen FROM fc o JOIN fc b ON o.family = b.family AND o.label = b.label AND o.dim = b.dim AND b.model = 'base' WHERE o.model = 'sft' GROUP BY ALL),
    gj AS (SELECT family, label, round(js_logit, 6) AS js_logit, round(distance_gen, 6) AS distance_gen FROM gl JOIN fd USING (family, label))"""
)

ORACLE_SQL: dict[str, str] = {
    "shift_base_sft": _shift("base", "sft"),
    "shift_sft_dpo": _shift("sft", "dpo"),
    "shift_dpo_rlvr": _shift("dpo", "rlvr"),
    "shift_base_dpo": _shift("base", "dpo"),
    "formation_table": f"WITH {_FORMATION} SELECT * FROM formation",
    "formation_two_stages": f"WITH {_W} SELECT *, CASE WHEN base - dpo > 0.0005 THEN 'decline' WHEN dpo - base > 0.0005 THEN 'rise' ELSE 'flat' END AS trajectory FROM (SELECT prompt, word, round(base, 6) AS base, round(dpo, 6) AS dpo, round(dpo - base, 6) AS dpo_minus_base FROM wide WHERE base > 0 OR dpo > 0)",
    "trajectory_counts": f"WITH {_FORMATION} SELECT prompt, trajectory, count(*) AS n FROM formation GROUP BY ALL",
    "significant_words": f"WITH {_FORMATION} SELECT prompt, word, base, sft, dpo, rlvr FROM formation WHERE greatest(base, sft, dpo, rlvr) > 0.002 AND greatest(abs(base - sft), abs(sft - dpo), abs(dpo - rlvr)) > 0.0003",
    "formation_gradient": f"WITH {_FORMATION} SELECT prompt, rank::INTEGER AS rank, word, base, sft, dpo, rlvr, total FROM (SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY total DESC, word) AS rank FROM (SELECT *, round(base + sft + dpo + rlvr, 6) AS total FROM formation)) WHERE rank <= 25",
    "caption_words": f"WITH {_FORMATION} SELECT prompt, layer, string_agg(word, ', ' ORDER BY r) AS caption FROM (SELECT *, row_number() OVER (PARTITION BY prompt, layer ORDER BY prob DESC, word) AS r FROM melted) WHERE r <= 15 GROUP BY ALL",
    "top_words_by_stage": f"WITH {_FORMATION}, b20 AS (SELECT DISTINCT prompt, word FROM (SELECT *, row_number() OVER (PARTITION BY prompt, layer ORDER BY prob DESC, word) AS r FROM melted) WHERE r <= 20) SELECT prompt, word, layer, prob FROM melted JOIN b20 USING (prompt, word)",
    "id_scores": f"WITH {_W}, mb AS (SELECT *, avg(base) OVER (PARTITION BY prompt) AS mean_base FROM wide WHERE base > 0 OR sft > 0 OR dpo > 0), x AS (SELECT *, sft - dpo AS repression, 1 + ln(1 + base / (mean_base + 1e-10)) AS drive_weight FROM mb WHERE sft - dpo > 0) SELECT prompt, word, round(repression * drive_weight, 6) AS id_score, round(base, 6) AS base_drive, round(sft, 6) AS ego_desire, round(dpo, 6) AS superego_allows, round(repression, 6) AS repression, round(drive_weight, 6) AS drive_weight FROM x",
    "battery_summary": "WITH "
    + _dist("lang || '_' || regexp_extract(source, '(\\d+)', 1)")
    + r""", d AS (SELECT prompt, word, round(sft - dpo, 9) AS delta, CASE WHEN sft - dpo > 0.0005 THEN 'down' WHEN sft - dpo < -0.0005 THEN 'up' END AS side FROM wide WHERE sft > 0 OR dpo > 0 OR base > 0),
      r AS (SELECT *, row_number() OVER (PARTITION BY prompt, side ORDER BY abs(delta) DESC, word) AS r FROM d)
      SELECT prompt AS label, round(coalesce(sum(abs(delta)) FILTER (side = 'down'), 0), 6) AS mass_down, round(coalesce(sum(abs(delta)) FILTER (side = 'up'), 0), 6) AS mass_up, count(*) FILTER (side = 'down') AS n_down, count(*) FILTER (side = 'up') AS n_up,
      coalesce(string_agg(word, ',' ORDER BY r) FILTER (side = 'down' AND r <= 3), '') AS top_down, coalesce(string_agg(word, ',' ORDER BY r) FILTER (side = 'up' AND r <= 3), '') AS top_up, regexp_replace(prompt, '_\d+$', '') AS category FROM r GROUP BY prompt""",
    "softmax_entropy": f"WITH {_LOGITS} SELECT prompt, layer, round(-sum(greatest(prob, 1e-10) * ln(greatest(prob, 1e-10))), 6) AS entropy FROM sm GROUP BY ALL",
    "kl_pairs": f"WITH {_PAIR_METRICS} SELECT prompt, pair, round(kl, 6) AS kl FROM met",
    "js_pairs": f"WITH {_PAIR_METRICS} SELECT prompt, pair, round(js, 6) AS js FROM met",
    "topk_overlap": f"WITH {_PAIR_METRICS} SELECT prompt, pair, overlap FROM met",
    "spearman_pairs": f"WITH {_PAIR_METRICS} SELECT prompt, pair, round(rank_corr, 6) AS rank_corr FROM met",
    "metrics_wide": f"WITH {_PAIR_METRICS} SELECT prompt, {_METRICS_WIDE} FROM met GROUP BY prompt",
    "top_movers": f"WITH {_TOKEN_PAIRS}, d AS (SELECT *, pa - pb AS delta, {_TOKEN} AS token FROM pt WHERE pair = 'sft_dpo'), r AS (SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY delta DESC, token_id) AS rd, row_number() OVER (PARTITION BY prompt ORDER BY delta, token_id) AS ru FROM d) SELECT prompt, 'down' AS direction, token, round(pa, 6) AS prob_a, round(pb, 6) AS prob_b, round(delta, 6) AS delta FROM r WHERE rd <= 5 AND token <> '' UNION ALL SELECT prompt, 'up', token, round(pa, 6), round(pb, 6), round(delta, 6) FROM r WHERE ru <= 5 AND token <> ''",
    "score_vocabulary": f"WITH {_LOGITS}, v AS (SELECT DISTINCT prompt, token_id FROM (SELECT *, row_number() OVER (PARTITION BY prompt, layer ORDER BY logit DESC, token_id) AS r FROM lg) WHERE r <= 20), e2 AS (SELECT prompt, layer, token_id, exp(logit - max(logit) OVER (PARTITION BY prompt, layer)) AS e FROM lg JOIN v USING (prompt, token_id)) SELECT prompt, layer, token_id, round(e / sum(e) OVER (PARTITION BY prompt, layer), 6) AS prob FROM e2",
    "sim_pairs": f"WITH {_MOVES} SELECT prompt, axis, net_layer, source, target, round(sim, 6) AS similarity FROM sims WHERE sim >= 0.15",
    "best_links": f"WITH {_BEST_LINKS} SELECT * FROM links",
    "peak_layer": f"WITH {_MOVES} SELECT prompt, axis, net_layer, source, target, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY prompt, axis, source, target ORDER BY sim DESC, net_layer) AS r FROM sims) WHERE r = 1 AND sim >= 0.25",
    "sim_matrix": f"WITH {_MOVES} SELECT prompt, axis, source, target, {', '.join(f'round(coalesce(max(sim) FILTER (net_layer = {h}), 0), 6) AS layer_{h}' for h in (8, 16, 24))} FROM sims GROUP BY ALL",
    "orphans": f"WITH {_MOVES} SELECT prompt, axis, word AS source FROM moves WHERE side = 'source' AND (prompt, axis, word) NOT IN (SELECT (prompt, axis, source) FROM sims WHERE sim >= 0.4)",
    "source_ranking": f"WITH {_MOVES} SELECT * REPLACE (rank::INTEGER AS rank) FROM (SELECT *, row_number() OVER (PARTITION BY prompt, axis ORDER BY similarity DESC, source) AS rank FROM (SELECT prompt, axis, source, round(max(sim), 6) AS similarity FROM sims GROUP BY ALL)) WHERE rank <= 8",
    "formation_links": f"WITH {_BEST_LINKS}, f AS (SELECT prompt, word AS sublimated_from, round(base, 6) AS source_base, round(sft, 6) AS source_sft FROM wide) SELECT prompt, sublimated_from, word, similarity, source_base, source_sft FROM (SELECT prompt, word, other AS sublimated_from, similarity FROM links WHERE link = 'source' AND axis = 'sublimation') LEFT JOIN f USING (prompt, sublimated_from)",
    "overdetermination": f"WITH {_LOGITS}, v AS (SELECT token_id, list(m ORDER BY i) AS vec FROM (SELECT (vec_id % 64)::INTEGER AS token_id, i, round(avg(embedding[i]::DOUBLE), 9) AS m FROM embeddings, range(1, 65) AS t(i) GROUP BY ALL) GROUP BY token_id), s AS (SELECT a.token_id AS anchor, b.token_id, round(list_dot_product(a.vec, b.vec) / (sqrt(list_dot_product(a.vec, a.vec)) * sqrt(list_dot_product(b.vec, b.vec))), 9) AS sim FROM v a, v b), n AS (SELECT prompt, anchor, prob / sum(prob) OVER (PARTITION BY prompt, anchor) AS p FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY sim DESC, token_id) AS r FROM s) JOIN (SELECT prompt, token_id, prob FROM sm WHERE layer = 'base') USING (token_id) WHERE r <= 20) SELECT prompt, anchor, round(-sum(p * ln(p + 1e-10)), 6) AS entropy FROM n GROUP BY prompt, anchor",
    "perm_test_mean": f"WITH {_PERM.format(n=1000)}, sz AS (SELECT perm, count(*) FILTER (grp = 0) AS n0, count(*) FILTER (grp = 1) AS n1 FROM pm GROUP BY perm), su AS (SELECT perm, i, sum(vec[i]) FILTER (pm.grp = 0) AS s0, sum(vec[i]) FILTER (pm.grp = 1) AS s1 FROM pm JOIN it USING (id), range(1, 65) AS t(i) GROUP BY perm, i), pv AS (SELECT perm, sum(s0 * s1) / (max(n0) * max(n1)) AS value FROM su JOIN sz USING (perm) GROUP BY perm) {_P_VALUE}",
    "perm_test_best": f"WITH {_PERM.format(n=1000)}, s AS (SELECT a.id AS a, b.id AS b, list_dot_product(a.vec, b.vec) AS sim FROM it a JOIN it b ON a.id <> b.id), bm AS (SELECT x.perm, s.a, max(sim) AS m FROM s JOIN pm x ON x.id = s.a AND x.grp = 0 JOIN pm y ON y.id = s.b AND y.grp = 1 AND y.perm = x.perm GROUP BY ALL), pv AS (SELECT perm, avg(m) AS value FROM bm GROUP BY perm) {_P_VALUE}",
    "perm_test_mean_1000": f"WITH {_PERM.format(n=1000)}, sz AS (SELECT perm, count(*) FILTER (grp = 0) AS n0, count(*) FILTER (grp = 1) AS n1 FROM pm GROUP BY perm), su AS (SELECT perm, i, sum(vec[i]) FILTER (pm.grp = 0) AS s0, sum(vec[i]) FILTER (pm.grp = 1) AS s1 FROM pm JOIN it USING (id), range(1, 65) AS t(i) GROUP BY perm, i), pv AS (SELECT perm, sum(s0 * s1) / (max(n0) * max(n1)) AS value FROM su JOIN sz USING (perm) GROUP BY perm) {_P_VALUE}",
    "perm_test_best_1000": f"WITH {_PERM.format(n=1000)}, s AS (SELECT a.id AS a, b.id AS b, list_dot_product(a.vec, b.vec) AS sim FROM it a JOIN it b ON a.id <> b.id), bm AS (SELECT x.perm, s.a, max(sim) AS m FROM s JOIN pm x ON x.id = s.a AND x.grp = 0 JOIN pm y ON y.id = s.b AND y.grp = 1 AND y.perm = x.perm GROUP BY ALL), pv AS (SELECT perm, avg(m) AS value FROM bm GROUP BY perm) {_P_VALUE}",
    "transfer_v4": f"WITH {_T4} SELECT prompt, word, round(prob, 6) AS prob FROM moved",
    "transfer_v3": f"WITH {_transfer(3)} SELECT prompt, word, round(prob, 6) AS prob FROM moved",
    "transfer_v2": f"WITH {_transfer(2)} SELECT prompt, word, round(prob, 6) AS prob FROM moved",
    "transfer_edges": f"WITH {_T4} SELECT prompt, source, target, round(mass, 9) AS mass, {_r('raw_repression, drive_weight, base_drive, similarity')} FROM edges",
    "suppressed_words": f"WITH {_T4} SELECT prompt, word, {_r('raw_mass, base_drive, drive_weight, effective_mass, sft, dpo')} FROM gone",
    "absorption": f"WITH {_T4} SELECT prompt, target, count(*) AS n_sources, round(sum(mass), 9) AS total_absorbed, string_agg(source, ',' ORDER BY source) AS sources FROM edges GROUP BY prompt, target",
    "transfer_distance": f"WITH {_T4} SELECT prompt, round(coalesce(d, 0), 6) AS mean_distance FROM (SELECT DISTINCT prompt FROM wide) LEFT JOIN (SELECT prompt, avg(1 - similarity) AS d FROM edges GROUP BY prompt) USING (prompt)",
    "analysis_table": f"WITH {_ANALYSIS} SELECT * FROM analysis",
    "role_table": f"WITH {_ANALYSIS} SELECT prompt, role, count(*) AS n, round(sum(raw_repression), 5) AS raw, round(sum(displaced_mass), 5) AS displaced, round(avg(base_drive), 6) AS mean_base FROM analysis GROUP BY ALL",
    "first_words": f"WITH {_GENS} SELECT label, model, {_FIRST_STRIPPED} AS word, count(*) AS n FROM gens GROUP BY ALL",
    "prompt_words": f"WITH {_GENS}, w AS (SELECT label, {_FIRST_STRIPPED} AS word, count(*) AS n FROM gens GROUP BY ALL) SELECT label, rank::INTEGER AS rank, word, n FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, word) AS rank FROM w WHERE regexp_matches(word, '^[\\x00-\\x7F]{{2,}}$') AND NOT regexp_matches(word, '^_+$')) WHERE rank <= 15",
    "first_word_entropy": f"WITH {_GENS}, w AS (SELECT label, model, {_FIRST} AS word, count(*) AS n FROM gens GROUP BY ALL), p AS (SELECT *, n::DOUBLE / (sum(n) OVER (PARTITION BY label, model))::DOUBLE AS p FROM w) SELECT label, model, round(-sum(p * ln(p + 1e-10)), 6) AS entropy, count(*) AS unique_first_words FROM p GROUP BY ALL",
    "centroid_dist": f"WITH {_GENS} SELECT label, model, round(distance, 6) AS distance FROM dist",
    "intra_variance": f"WITH {_GENS} SELECT * FROM spread",
    "variance_ratio": f"WITH {_GENS} SELECT label, round(last / base, 6) AS variance_ratio FROM (SELECT label, max(variance) FILTER (model = 'base') AS base, coalesce(max(variance) FILTER (model = 'dpo'), max(variance) FILTER (model = 'sft')) AS last FROM spread GROUP BY label) WHERE base > 0 AND last IS NOT NULL",
    "mean_cosine": f"WITH {_GENS}, u AS (SELECT gen_id, label, model, dim, x / (sqrt(sum(x * x) OVER (PARTITION BY gen_id)) + 1e-10) AS u FROM gd), s AS (SELECT label, model, dim, sum(u) AS s, sum(u * u) AS q, count(*) AS n FROM u GROUP BY ALL) SELECT label, model, round((sum(s * s) - sum(q)) / (max(n) * (max(n) - 1)), 6) AS mean_cosine FROM s GROUP BY label, model HAVING max(n) > 1",
    "silhouette": f"WITH {_GENS}, g2 AS (SELECT *, count(*) OVER (PARTITION BY label, model) AS size FROM gv), d AS (SELECT a.label, a.model AS m, a.gen_id AS i, b.model AS o, b.size AS so, CASE WHEN a.vec_row = b.vec_row THEN 0 ELSE list_distance(a.vec, b.vec) END AS d FROM g2 a JOIN g2 b USING (label) WHERE a.size > 1 AND b.size > 1), t AS (SELECT label, m, i, o, so, sum(d) AS t FROM d GROUP BY ALL), s AS (SELECT label, m, i, max(t / (so - 1)) FILTER (o = m) AS a, min(t / so) FILTER (o <> m) AS b FROM t GROUP BY ALL) SELECT label, round(avg(CASE WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END), 6) AS silhouette FROM s WHERE b IS NOT NULL GROUP BY label",
    "concept_scores": f"WITH {_CONCEPTS} SELECT label, model, axis, round(mean_score, 6) AS mean_score FROM cs",
    "concept_shift": f"WITH {_CONCEPTS}, l AS (SELECT label, axis, max(mean_score) FILTER (model = 'base') AS base, coalesce(max(mean_score) FILTER (model = 'dpo'), max(mean_score) FILTER (model = 'sft')) AS last FROM cs GROUP BY ALL) SELECT label, axis, round(last - base, 6) AS shift FROM l WHERE base IS NOT NULL AND last IS NOT NULL",
    "gen_vs_logit_join": f"WITH {_GEN_JOIN} SELECT * FROM gj",
    "gen_vs_logit_corr": f"WITH {_GEN_JOIN} SELECT 'js_distance' AS kind, count(*) AS n, round(corr(js_logit, distance_gen), 6) AS r FROM gj",
    "category_family_pivot": f"WITH {_BATTERY} SELECT CASE WHEN label < 3 THEN 'low' ELSE 'high' END AS category, {', '.join(f'round(avg(js) FILTER (family = {f}), 6) AS family_{f}' for f in range(4))} FROM battery GROUP BY 1",
    "category_means": f"WITH {_PAIR_METRICS}, c AS (SELECT CASE WHEN prompt % 6 < 3 THEN 'low' ELSE 'high' END AS category, {', '.join(f'round(avg({c}), 6) AS {c}' for c in ('entropy_a', 'entropy_b', 'kl', 'js', 'overlap', 'rank_corr'))} FROM met WHERE pair = 'sft_dpo' GROUP BY 1) SELECT category, ord, entropy_a, entropy_b, kl, js, overlap, rank_corr FROM (VALUES (0, 'low'), (1, 'high'), (2, 'none')) AS o(ord, category) LEFT JOIN c USING (category)",
    "step_metrics": f"WITH {_STEP_METRICS} SELECT step, label, round(entropy_a, 6) AS entropy_base, round(entropy_b, 6) AS entropy_step, round(entropy_a - entropy_b, 6) AS entropy_drop, round(js, 6) AS js_base_step, round(kl, 6) AS kl_base_step, round(overlap, 6) AS top_overlap FROM met",
    "step_words": f"WITH {_STEP_WORDS} SELECT step, label, token, word_category, {_r('probability, base_probability, delta')} FROM sw",
    "onset_curve": f"WITH {_STEP_WORDS} SELECT label, token, step, round(probability, 6) AS probability FROM sw UNION ALL SELECT label, token, 0, round(max(base_probability), 6) FROM sw GROUP BY label, token",
    "lag_pair": f"WITH {_STEPS}, ch AS (SELECT *, round(pb - pa, 12) AS d FROM ab a WHERE step = (SELECT max(step) FROM ab b WHERE b.label = a.label)), pk AS (SELECT label, token, 'falling' AS series FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d, token) AS r FROM ch) WHERE r = 1 UNION ALL SELECT label, token, 'rising' FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d DESC, token) AS r FROM ch) WHERE r = 1) SELECT label, series, token, step, round(p, 6) AS probability FROM probs JOIN pk USING (label, token)",
    "step_category": f"WITH {_STEP_METRICS} SELECT step, label % 3 AS category, round(avg(js), 6) AS js, round(avg(kl), 6) AS kl FROM met GROUP BY ALL",
    "perplexity": f"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '{_SPLIT}'), lambda x: x <> '') AS w FROM documents), bi AS (SELECT a, c, count(*) AS n FROM (SELECT unnest(w[1:len(w) - 1]) AS a, unnest(w[2:len(w)]) AS c FROM w WHERE len(w) > 1) GROUP BY ALL), fs AS (SELECT a, sum(n) AS na FROM bi GROUP BY a), v AS (SELECT count(DISTINCT x) AS v FROM (SELECT unnest(w) AS x FROM w)), bw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '{_SPLIT}'), lambda x: x <> '') AS w FROM benchmark), bb AS (SELECT item_id, unnest(w[1:len(w) - 1]) AS a, unnest(w[2:len(w)]) AS c FROM bw WHERE len(w) > 1) SELECT item_id, round(exp(-avg(ln((coalesce(n, 0) + 1.0::DOUBLE) / (coalesce(na, 0) + v)::DOUBLE))), 4) AS perplexity FROM bb LEFT JOIN bi USING (a, c) LEFT JOIN fs USING (a), v GROUP BY item_id UNION ALL SELECT item_id, 'NaN'::DOUBLE FROM bw WHERE len(w) < 2",
    "lens_rows": f"WITH {_LENS} SELECT model, prompt, net_layer, token_id, word, round(probability, 8) AS probability, round(logit, 6) AS logit, source FROM lens",
    "lens_frequent": f"WITH {_LENS} SELECT model, prompt, word, count(DISTINCT net_layer) AS n_layers FROM lens WHERE source = 'top_k' GROUP BY ALL HAVING count(DISTINCT net_layer) >= 2",
    "lens_peak": f"WITH {_LENS} SELECT model, prompt, net_layer, token_id, word, round(probability, 8) AS probability, round(logit, 6) AS logit, source FROM (SELECT *, row_number() OVER (PARTITION BY model, prompt, word ORDER BY probability DESC, net_layer, token_id) AS r FROM lens) WHERE r = 1",
    "taxonomy_pairs": f"WITH {_TAXONOMY} SELECT prompt, axis, source, target, round(similarity, 6) AS similarity, net_layer::DOUBLE AS net_layer, source_pos, target_pos, round(target_freq, 6) AS target_freq, displacement_type FROM tx",
    "taxonomy_pct": f"WITH {_TAXONOMY} SELECT axis, displacement_type, n, round(100.0::DOUBLE * n / (sum(n) OVER (PARTITION BY axis))::DOUBLE, 6) AS pct FROM (SELECT axis, displacement_type, count(*) AS n FROM tx GROUP BY ALL)",
    "taxonomy_crosstab": f"WITH {_TAXONOMY} SELECT prompt, {', '.join(f'''count(*) FILTER (displacement_type = '{k}') AS {k}''' for k in ('genre_change', 'archaic', 'register_shift', 'category_shift'))} FROM tx GROUP BY prompt",
    "token_mass": f"WITH {_W}, v AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_split_to_array(lower(text), '{_SPLIT}')) AS word FROM benchmark) WHERE word <> '') SELECT prompt, round(sum(base), 6) AS base_mass, round(sum(dpo), 6) AS dpo_mass, round(sum(base) - sum(dpo), 6) AS mass_displaced FROM wide JOIN v USING (word) GROUP BY prompt",
    "mann_whitney": f"WITH {_BATTERY}, r AS (SELECT family, prompt % 7 = 0 AS first, round(js, 9) AS js FROM battery), k AS (SELECT *, rank() OVER (PARTITION BY family ORDER BY js) + (count(*) OVER (PARTITION BY family, js) - 1) / 2.0::DOUBLE AS rk FROM r) SELECT family, count(*) FILTER (first) AS n1, count(*) FILTER (NOT first) AS n2, sum(rk) FILTER (first) - count(*) FILTER (first) * (count(*) FILTER (first) + 1) / 2.0::DOUBLE AS u FROM k GROUP BY family",
    "discover_words": f"WITH {_discover()} SELECT prompt, word, round(mass / sum(mass) OVER (PARTITION BY prompt), 6) AS prob FROM wd",
    "word_logprobs": f"WITH {_LOGPROBS} SELECT prompt, word, round(e / sum(e) OVER (PARTITION BY prompt), 6) AS prob FROM le",
    "sample_tokens": f"WITH {_LOGITS}, b AS (SELECT prompt, token_id, logit FROM (SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY logit DESC, token_id) AS r FROM lg WHERE layer = 'dpo') WHERE r <= 50), e2 AS (SELECT prompt, token_id, exp(logit / 0.8::DOUBLE - max(logit / 0.8::DOUBLE) OVER (PARTITION BY prompt)) AS e FROM b), p AS (SELECT prompt, token_id, e / sum(e) OVER (PARTITION BY prompt) AS prob FROM e2), c AS (SELECT *, sum(prob) OVER (PARTITION BY prompt ORDER BY prob DESC, token_id ROWS UNBOUNDED PRECEDING) AS cum, row_number() OVER (PARTITION BY prompt ORDER BY prob DESC, token_id) AS place, count(*) OVER (PARTITION BY prompt) AS last FROM p), h AS (SELECT *, substr(md5(prompt || ':' || draw), 1, 8) AS h FROM c, range(0, 5) AS t(draw)), u AS (SELECT *, {_U} AS u FROM h) SELECT prompt, draw::INTEGER AS draw, token_id FROM (SELECT *, row_number() OVER (PARTITION BY prompt, draw ORDER BY place) AS r FROM u WHERE cum >= u OR place = last) WHERE r = 1",
    "redistributed_step": f"""WITH {_LOGITS}, e2 AS (SELECT prompt, layer, token_id, exp(logit / 0.05::DOUBLE - max(logit / 0.05::DOUBLE) OVER (PARTITION BY prompt, layer)) AS e FROM lg), p2 AS (SELECT prompt, layer, token_id, e / sum(e) OVER (PARTITION BY prompt, layer) AS prob FROM e2),
      sd AS (SELECT * FROM (SELECT prompt, token_id, max(prob) FILTER (layer = 'base') AS base, max(prob) FILTER (layer = 'sft') AS sft, max(prob) FILTER (layer = 'dpo') AS dpo FROM p2 GROUP BY ALL) WHERE base IS NOT NULL AND sft IS NOT NULL AND dpo IS NOT NULL),
      mm AS (SELECT *, sft - dpo AS fall, avg(CASE WHEN base > 0 THEN base END) OVER (PARTITION BY prompt) AS mean_base FROM sd),
      rr AS (SELECT *, fall > 0.001 AS gone, CASE WHEN fall > 0.001 THEN fall * (1 + ln(1 + base / (mean_base + 1e-10))) * 0.3 ELSE 0 END AS mass FROM mm),
      vv AS (SELECT token_id, list(m ORDER BY i) AS vec FROM (SELECT (vec_id % 64)::INTEGER AS token_id, i, round(avg(embedding[i]::DOUBLE), 9) AS m FROM embeddings, range(1, 65) AS t(i) GROUP BY ALL) GROUP BY token_id),
      ss AS (SELECT prompt, token_id AS s, mass, vec AS sv FROM (SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY mass DESC, token_id) AS r FROM rr WHERE gone AND mass >= 1e-6) JOIN vv USING (token_id) WHERE r <= 20),
      tt AS (SELECT prompt, token_id AS t, vec AS tv FROM (SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY dpo DESC, token_id) AS r FROM rr WHERE NOT gone AND dpo > 1e-6) JOIN vv USING (token_id) WHERE r <= 100),
      si AS (SELECT * FROM (SELECT prompt, s, t, mass, greatest(list_dot_product(sv, tv), 0) AS sim FROM ss JOIN tt USING (prompt)) WHERE sim > 0),
      ga AS (SELECT prompt, t AS token_id, sum(g) AS gain FROM (SELECT prompt, t, mass * sim / sum(sim) OVER (PARTITION BY prompt, s) AS g FROM si) GROUP BY ALL),
      fm AS (SELECT prompt, token_id, CASE WHEN gone THEN 0 ELSE dpo END + coalesce(gain, 0) AS m FROM rr LEFT JOIN ga USING (prompt, token_id))
      SELECT prompt, token_id, round(m / sum(m) OVER (PARTITION BY prompt), 6) AS prob FROM fm""",
    "known_prompts": f"WITH {_W} SELECT prompt, count(DISTINCT layer) AS n_layers, count(DISTINCT word) AS n_words FROM longs GROUP BY prompt",
    "generation_deficit": f"WITH {_GENS}, k AS (SELECT family, label, model, least(count(*), 30) AS n FROM gens GROUP BY ALL) SELECT family, label, model, (30 - coalesce(n, 0))::BIGINT AS deficit FROM (SELECT * FROM (SELECT DISTINCT family FROM gens), (SELECT DISTINCT label FROM gens), (SELECT DISTINCT model FROM gens)) LEFT JOIN k USING (family, label, model)",
}
