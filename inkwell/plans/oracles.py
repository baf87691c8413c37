"""ANSI SQL that gives the rows of the core's queries, for an independent engine."""

from __future__ import annotations

from ..functions import lexicon as lx
from ..functions import sql as sq
from ..operators import ingest
from ..operators.ledger import KEY_FIELDS
from .queries import BUDGET, N_RUNS, PLAN_BUDGET

lit = sq.lit
_SPELT = "regexp_replace(lower(trim(set_name)), '[ _-]+', '_', 'g')"
_SET = f"CASE WHEN {_SPELT} = 'held_out' THEN 'heldout' ELSE {_SPELT} END"
_DECL = f"decl AS (SELECT * EXCLUDE (set_name, gutenberg_ids), {_SET} AS set_name, list_sort(list_distinct(list_filter(coalesce(gutenberg_ids, []), lambda g: g > 0))) AS gutenberg_ids FROM text_sources)"
_REPAIRED = f"rep AS (SELECT creation_id, chunk_index, word_start, text, n_words FROM (SELECT creation_id, chunk_index, word_start, text, {sq.n_words('text')}::BIGINT AS n_words, row_number() OVER (PARTITION BY creation_id, chunk_index, text) AS r FROM chunks) WHERE r = 1)"
_ENC = f"enc AS (SELECT rewrite_id, {sq.encoded('original')} AS a, {sq.encoded(sq.cleaned('rewrite'))} AS b FROM rewrites)"
_DELTAS = f"""deltas AS (SELECT run_index::BIGINT AS run_index, creation_id, chunk_index::BIGINT AS chunk_index, status, reason, n_words,
  CASE WHEN status <> 'ok' OR greatest(length(a), length(b)) = 0 THEN 0.0::DOUBLE ELSE levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)) END AS delta,
  status = 'ok' AND length(a) = 0 AND length(b) = 0 AS degenerate
  FROM (SELECT run_index, creation_id, chunk_index, status, reason, {sq.n_words('original')}::BIGINT AS n_words, {sq.encoded('original')} AS a, CASE WHEN status = 'ok' THEN {sq.encoded(sq.cleaned('rewrite'))} ELSE '' END AS b FROM rewrites))"""
_RUNS = f"""{_DELTAS}, runs AS (SELECT run_index, creation_id, avg(delta) FILTER (status = 'ok') AS mean_delta, count(*) AS n_total, count(*) FILTER (status = 'ok') AS n_used, count(*) FILTER (status <> 'ok') AS n_failed,
  count(*) FILTER (status = 'ok' AND degenerate) AS n_degenerate, sum(delta * n_words) FILTER (status = 'ok') / nullif(sum(n_words) FILTER (status = 'ok'), 0)::DOUBLE AS length_weighted_mean,
  count(*) FILTER (status <> 'ok') / count(*)::DOUBLE AS failed_fraction FROM deltas GROUP BY ALL)"""
_SCORES = f"""{_RUNS}, scores AS (SELECT creation_id, avg(mean_delta) AS score, stddev_samp(mean_delta) AS score_std, count(mean_delta) AS n_runs_scored, count(*) AS n_runs, max(failed_fraction) AS worst_failed,
  avg(length_weighted_mean) AS length_weighted_score, arg_min(n_total, run_index) AS n_chunks FROM runs GROUP BY creation_id)"""
_UNRELIABLE = f"(n_runs_scored = 0 OR n_runs_scored < n_runs OR worst_failed > {lx.MAX_FAILED_FRACTION})"
_REASON = f"""CASE WHEN n_runs_scored = 0 THEN 'no chunk was scored in any run' ELSE concat_ws('; ', CASE WHEN n_runs_scored < n_runs THEN n_runs_scored || ' of ' || n_runs || ' runs scored' END, CASE WHEN worst_failed > {lx.MAX_FAILED_FRACTION} THEN 'too many chunks failed' END) END"""
_OTSU = f"""{_SCORES}, s AS (SELECT creation_id, score FROM scores WHERE score IS NOT NULL), tot AS (SELECT count(*) AS n, sum(score) AS total, var_pop(score) AS total_variance, stddev_pop(score) AS spread FROM s),
  run AS (SELECT score AS lower, lead(score) OVER w AS upper, row_number() OVER w AS k, sum(score) OVER (ORDER BY score, creation_id ROWS UNBOUNDED PRECEDING) AS below FROM s WINDOW w AS (ORDER BY score, creation_id)),
  cand AS (SELECT k, lower, upper, (k / n::DOUBLE) * (1 - k / n::DOUBLE) * pow(below / k - (total - below) / (n - k), 2) AS variance FROM run, tot WHERE k < n),
  best AS (SELECT * FROM cand ORDER BY round(variance, 15) DESC, k LIMIT 1),
  otsu AS (SELECT n, total_variance, spread, k, lower, upper, variance, (lower + upper) / 2 AS tau, upper - lower AS gap, CASE WHEN total_variance > 0 THEN variance / total_variance ELSE 0 END AS separability,
    CASE WHEN spread > 0 THEN (upper - lower) / spread ELSE 0 END AS gap_ratio FROM best, tot)"""
_BINNED = f"""{_OTSU}, edge AS (SELECT min(score) AS lo, max(score) AS hi FROM s), cnt AS (SELECT least(255, floor((score - lo) / ((hi - lo) / 256)))::INT AS bin, count(*) AS n FROM s, edge WHERE hi > lo GROUP BY 1),
  grid AS (SELECT g.bin, coalesce(n, 0) AS n, lo + (g.bin + 0.5::DOUBLE) * ((hi - lo) / 256) AS centre FROM (SELECT unnest(range(256))::INT AS bin) g LEFT JOIN cnt USING (bin), edge),
  acc AS (SELECT bin, centre, sum(n) OVER u AS w1, sum(n * centre) OVER u AS m1, sum(n) OVER d AS w2, sum(n * centre) OVER d AS m2 FROM grid WINDOW u AS (ORDER BY bin ROWS UNBOUNDED PRECEDING), d AS (ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
  binned AS (SELECT centre AS tau FROM acc WHERE w1 > 0 AND w2 > 0 ORDER BY round(w1::DOUBLE * w2 * pow(m1 / w1 - m2 / w2, 2), 9) DESC, bin LIMIT 1)"""
_LABELS = f"""{_OTSU}, labels AS (SELECT creation_id, score, tau, CASE WHEN score > tau THEN 'suspicious' ELSE 'authentic' END AS label, abs(score - tau) <= {lx.BORDERLINE_BAND} AS borderline FROM s, otsu)"""
_SIZES = f"sizes AS (SELECT id AS creation_id, max(expected_words)::BIGINT AS n_words, floor(max(expected_words)::DOUBLE * {lx.TOKENS_PER_WORD}::DOUBLE)::BIGINT AS tokens FROM text_sources WHERE expected_words IS NOT NULL GROUP BY id)"
_NOISE = f"""{_DECL}, pool AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT id FROM decl WHERE set_name IN ('noise_pool', 'heldout'))),
  noise AS (SELECT r::BIGINT AS run_index, id AS creation_id FROM (SELECT unnest(range(2, {N_RUNS + 1})) AS r), pool WHERE i = ({lx.SEED} + r - 2) % n)"""
_CACHE = "sound AS (SELECT * FROM calls WHERE status = 'ok' AND response IS NOT NULL), cache AS (SELECT * FROM sound QUALIFY row_number() OVER (PARTITION BY cache_key ORDER BY logged_at DESC, call_id DESC) = 1)"


def _counts(c: str) -> str:
    return "[" + ", ".join(f"(length({c}) - length(replace({c}, chr({i}), '')))::DOUBLE" for i in range(1, len(lx.FUNCTION_WORDS) + 1)) + "]"


def _uniform(key: str, position: str) -> str:
    return f"(('0x' || substr(sha256({key} || ':' || {position}), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE)"


_FORMS = "MAP {" + ", ".join(f"{lit(a)}: {lit(b)}" for a, b in lx.SUBSTITUTIONS.items()) + "}"
_EDGES = lit(".,;:!?\"'()[]")
_BARE = f"trim(lower(w[1]), {_EDGES})"
_FAKE = f"""array_to_string(list_transform(list_zip({sq.words('text')}, range(0, len({sq.words('text')}))), lambda w: CASE WHEN map_contains({_FORMS}, {_BARE}) AND {_uniform('key', 'w[2]::VARCHAR')} < rate
  THEN replace(lower(w[1]), {_BARE}, {_FORMS}[{_BARE}]) ELSE w[1] END), ' ')"""

_TIDY = lambda c: (
    f"{sq.strip('''regexp_replace(regexp_replace(regexp_replace(coalesce(''' + c + ''', ''), ''' + lit(chr(92) + 'r' + chr(92) + 'n|[' + chr(92) + 'r' + chr(92) + 'x0b' + chr(92) + 'x0c' + chr(92) + 'x1c-' + chr(92) + 'x1e' + chr(92) + 'x{85}' + chr(92) + 'x{2028}' + chr(92) + 'x{2029}]') + ''', chr(10), 'g'), ''' + lit('(?:[' + chr(92) + 't ' + chr(92) + 'x1f' + chr(92) + 'x{a0}' + chr(92) + 'x{1680}' + chr(92) + 'x{2000}-' + chr(92) + 'x{200a}' + chr(92) + 'x{202f}' + chr(92) + 'x{205f}' + chr(92) + 'x{3000}])+(' + chr(92) + 'n|$)') + ''', ''' + lit(chr(92) + '1') + ''', 'g'), ''' + lit(chr(92) + 'n{3,}') + ''', chr(10) || chr(10), 'g')''')} || chr(10)"
)
_QUOTED = f"replace(replace(translate(text, {lit(ingest.QUOTES_FROM)}, {lit(ingest.QUOTES_TO)}), '—', ' - '), '–', ' - ')"
_NOTED = "('[Transcriber''s note: as printed]' || chr(10) || coalesce(text, '') || chr(10) || 'Editor''s note on the text' || chr(10) || chr(10) || 'end')"
_WRAPPED = "'head' || chr(10) || '*** START OF THE PROJECT GUTENBERG EBOOK X ***' || chr(10) || text || chr(10) || '*** END OF THE PROJECT GUTENBERG EBOOK X ***' || chr(10) || 'tail'"

_PKEYS = list(lx.PROFILE_LABELS)
_PBODY = sq.without_fences("response")
_PJSON = "CASE WHEN json_valid(c) THEN c END"


def _pfield(k: str) -> str:
    return f"CASE WHEN json_type(j, '$.{k}') IN ('VARCHAR', 'BIGINT', 'UBIGINT', 'DOUBLE') THEN nullif({sq.strip(f'''(j ->> '$.{k}')''')}, '') END"


ORACLES: dict[str, str] = {
    "src_declarations": f"WITH {_DECL} SELECT decl_order, id, title, set_name, array_to_string(gutenberg_ids, ',') AS numbers, expected_words::BIGINT AS expected_words FROM decl",
    "chk_disjoint": f"""WITH {_DECL} SELECT 'id' AS kind, id AS value, count(*) AS n FROM decl GROUP BY id HAVING count(*) > 1 UNION ALL
        SELECT 'number', g::VARCHAR, count(*) FROM (SELECT DISTINCT set_name, unnest(gutenberg_ids) AS g FROM decl WHERE set_name IS NOT NULL) GROUP BY g HAVING count(*) > 1""",
    "scan_documents": f"SELECT doc_id, length(text) AS n_code_points, {sq.n_words('text')} AS n_words FROM documents",
    "corpus_subset": f"""WITH {_DECL} SELECT doc_id, creation_id, source FROM documents WHERE creation_id IN (SELECT id FROM decl WHERE set_name IN ('texts', 'heldout')) AND creation_id NOT IN (SELECT id FROM decl WHERE set_name = 'noise_pool')""",
    "unknown_includes": "SELECT DISTINCT creation_id FROM documents WHERE creation_id IS NOT NULL AND creation_id NOT IN (SELECT creation_id FROM chunks)",
    "union_sets": f"WITH {_DECL} SELECT list_position(['texts', 'noise_pool', 'heldout', 'mixture_sources'], set_name)::BIGINT AS set_order, decl_order, id FROM decl WHERE set_name IN ('texts', 'noise_pool', 'heldout', 'mixture_sources')",
    "corpus_totals": f"SELECT count(*) AS n_texts, sum({sq.n_words('text')})::BIGINT AS n_words, sum(length(coalesce(text, '')))::BIGINT AS n_chars FROM documents",
    "dup_text": "SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "manifest_reconcile": f"""WITH found AS (SELECT id, sum(w)::BIGINT AS n_words, bit_xor(h) AS sha FROM (SELECT DISTINCT creation_id AS id, chunk_index, ('0x' || substr(sha256(text), 1, 15))::BIGINT AS h, {sq.n_words('text')} AS w FROM chunks) GROUP BY id),
        rec AS (SELECT id, sum(w)::BIGINT AS n_words, bit_xor(h) AS sha FROM (SELECT DISTINCT creation_id AS id, chunk_index, ('0x' || substr(sha256, 1, 15))::BIGINT AS h, n_words AS w FROM chunks WHERE sha256 IS NOT NULL AND n_words IS NOT NULL) GROUP BY id),
        d AS (SELECT id, max(expected_words) AS e FROM text_sources GROUP BY id),
        j AS (SELECT coalesce(d.id, rec.id, found.id) AS id, d.id IS NOT NULL AS dd, rec.id IS NOT NULL AS mm, found.id IS NOT NULL AS ff, e, rec.n_words AS mw, found.n_words AS fw, rec.sha AS ms, found.sha AS fs FROM d FULL JOIN rec ON d.id = rec.id FULL JOIN found ON coalesce(d.id, rec.id) = found.id)
        SELECT id, 'missing' AS finding, 'failure' AS severity FROM j WHERE dd AND NOT ff UNION ALL SELECT id, 'not_in_manifest', 'failure' FROM j WHERE dd AND ff AND NOT mm UNION ALL SELECT id, 'undeclared', 'failure' FROM j WHERE mm AND NOT dd
        UNION ALL SELECT id, 'checksum_drift', 'failure' FROM j WHERE dd AND mm AND ff AND ms <> fs UNION ALL SELECT id, 'word_count_drift', 'failure' FROM j WHERE dd AND mm AND ff AND mw <> fw
        UNION ALL SELECT id, 'empty', 'failure' FROM j WHERE dd AND ff AND fw = 0 UNION ALL SELECT id, 'outside_band', 'warning' FROM j WHERE dd AND mm AND ff AND abs(fw - e) > e * 0.15::DOUBLE""",
    "join_titles": "SELECT doc_id, creation_id, coalesce(title, '') AS title FROM documents LEFT JOIN (SELECT id AS creation_id, arg_min(title, decl_order) AS title FROM text_sources GROUP BY id) USING (creation_id)",
    "strip_between_markers": f"""SELECT doc_id, sha256(nullif({sq.strip(f"regexp_extract(CASE WHEN doc_id % 7 <> 0 THEN {_WRAPPED} ELSE text END, {lit(ingest.BETWEEN)}, 1)")}, '')) AS inner_sha FROM documents""",
    "residual_filter": "SELECT doc_id FROM documents WHERE regexp_matches(coalesce(text, '') || CASE WHEN doc_id % 11 = 0 THEN ' Project Gutenberg' ELSE '' END, '(?i)PROJECT GUTENBERG')",
    "fold_quotes": f"SELECT doc_id, sha256({_QUOTED}) AS plain_sha FROM documents",
    "strip_notes": f"SELECT doc_id, len(regexp_extract_all({_NOTED}, {lit(ingest.NOTE)})) AS n_notes, sha256(regexp_replace({_NOTED}, {lit(ingest.NOTE)}, '', 'g')) AS without_sha FROM documents",
    "collapse_ws": f"SELECT doc_id, sha256({_TIDY('text')}) AS tidy_sha FROM documents",
    "word_count": f"SELECT creation_id, chunk_index::BIGINT AS chunk_index, {sq.n_words('text')} AS n_words FROM chunks",
    "text_sha": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "chunk_documents": f"""WITH w AS (SELECT doc_id, {sq.words('text')} AS w FROM documents), c AS (SELECT doc_id, w, unnest(range(0, len(w), 400)) AS s FROM w)
        SELECT doc_id AS creation_id, s // 400 AS chunk_index, len(w[s + 1 : s + 400]) AS n_words, s AS word_start, s + len(w[s + 1 : s + 400]) AS word_end, sha256(array_to_string(w[s + 1 : s + 400], ' ')) AS sha256 FROM c""",
    "chunk_counts": f"SELECT doc_id AS creation_id, {sq.n_words('text')} AS n_words, ceil({sq.n_words('text')} / 400.0)::BIGINT AS n_chunks FROM documents",
    "chunk_tiling_check": f"""WITH r AS (SELECT DISTINCT creation_id, chunk_index::BIGINT AS chunk_index, word_start, word_end, {sq.n_words('text')} AS words FROM chunks),
        b AS (SELECT *, lag(word_start + words) OVER (PARTITION BY creation_id ORDER BY chunk_index, word_start) AS be FROM r)
        SELECT creation_id, chunk_index, coalesce(be <> word_start, false) AS gap, coalesce(word_end - word_start <> words, true) AS bad_range FROM b WHERE coalesce(be <> word_start, false) OR coalesce(word_end - word_start <> words, true)""",
    "chunk_sha": f"WITH {_REPAIRED} SELECT creation_id, chunk_index::BIGINT AS chunk_index, n_words, word_start::BIGINT AS word_start, word_start + n_words AS word_end, sha256(text) AS sha256 FROM rep",
    "dim_function_words": f"SELECT i AS code, w[i] AS word FROM (SELECT {sq._FW} AS w), (SELECT unnest(range(1, {len(lx.FUNCTION_WORDS) + 1})) AS i)",
    "tokenize_docs": f"WITH k AS (SELECT doc_id, {sq.tokens('text')} AS k FROM documents) SELECT doc_id, len(k) AS n_tokens, sha256(coalesce(array_to_string(k, ' '), '')) AS tokens_sha FROM k",
    "fw_sequence": f"SELECT creation_id, chunk_index::BIGINT AS chunk_index, coalesce(array_to_string({sq.function_words('text')}, ' '), '') AS sequence FROM chunks",
    "fw_encode": f"SELECT creation_id, chunk_index::BIGINT AS chunk_index, hex({sq.encoded('text')}) AS codes FROM chunks",
    "fw_levenshtein": f"WITH {_ENC} SELECT rewrite_id, levenshtein(a, b) AS edits FROM enc",
    "fwed_pairs": f"WITH {_ENC} SELECT rewrite_id, length(a) AS n_a, length(b) AS n_b, round(CASE WHEN greatest(length(a), length(b)) = 0 THEN 0.0::DOUBLE ELSE levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)) END, 6) AS delta, length(a) = 0 AND length(b) = 0 AS degenerate FROM enc",
    "fw_freq_cosine": f"""WITH {_ENC}, v AS (SELECT rewrite_id, a, b, {_counts('a')} AS x, {_counts('b')} AS y FROM enc) SELECT rewrite_id, round(CASE WHEN a = '' AND b = '' THEN 0.0::DOUBLE WHEN a = '' OR b = '' THEN 1.0 ELSE greatest(0.0, 1 - list_dot_product(x, y) / sqrt(list_dot_product(x, x) * list_dot_product(y, y))) END, 6) AS delta FROM v""",
    "fw_freq_manhattan": f"""WITH {_ENC}, v AS (SELECT rewrite_id, a, b, {_counts('a')} AS x, {_counts('b')} AS y FROM enc) SELECT rewrite_id, round(CASE WHEN a = '' AND b = '' THEN 0.0::DOUBLE WHEN a = '' OR b = '' THEN 1.0 ELSE list_sum(list_transform(list_zip(x, y), lambda p: abs(p[1] / length(a) - p[2] / length(b)))) / 2 END, 6) AS delta FROM v""",
    "token_estimates": f"WITH {_SIZES} SELECT * FROM sizes",
    "noise_assignment": f"WITH {_NOISE} SELECT run_index, creation_id FROM noise",
    "run_corpora": f"WITH {_NOISE} SELECT r::BIGINT AS run_index, creation_id, false AS is_noise FROM (SELECT unnest(range(1, {N_RUNS + 1})) AS r), (SELECT DISTINCT creation_id FROM chunks) UNION ALL SELECT run_index, creation_id, true FROM noise",
    "roundrobin_sample": """WITH o AS (SELECT DISTINCT creation_id, chunk_index FROM chunks), k AS (SELECT *, row_number() OVER (PARTITION BY creation_id ORDER BY chunk_index) - 1 AS k, count(*) OVER (PARTITION BY creation_id) AS n FROM o),
        v AS (SELECT *, ((k - 7) % n + n) % n AS round FROM k) SELECT creation_id, chunk_index::BIGINT AS chunk_index, round FROM v WHERE round < 100 ORDER BY round, creation_id LIMIT 100""",
    "strat_sample": """WITH h AS (SELECT doc_id, source, ('0x' || substr(sha256('5:' || doc_id), 1, 8))::BIGINT AS h FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM h)
        SELECT doc_id, source FROM r WHERE r <= greatest(1, round(n * 0.1::DOUBLE))""",
    "strip_fences": f"SELECT call_id, sha256({sq.without_fences('response')}) AS sha FROM calls",
    "strip_preamble": f"SELECT call_id, sha256({sq.without_lead_in('response')}) AS sha FROM calls WHERE response IS NOT NULL",
    "clean_responses": f"SELECT call_id, sha256({sq.cleaned('response')}) AS sha FROM calls",
    "refusal_flag": f"SELECT call_id, {sq.refuses('c')} AS refuses FROM (SELECT call_id, {sq.cleaned('response')} AS c FROM calls)",
    "length_ratio": f"SELECT rewrite_id, round(CASE WHEN {sq.n_words('original')} > 0 THEN {sq.n_words('c')}::DOUBLE / {sq.n_words('original')} ELSE 0 END, 6) AS length_ratio FROM (SELECT rewrite_id, original, {sq.cleaned('rewrite')} AS c FROM rewrites)",
}

_RETENTION = "CASE WHEN len(x) = 0 AND len(y) = 0 THEN 1.0::DOUBLE WHEN least(len(x), len(y)) = 0 THEN 0.0 ELSE len(list_intersect(x, y))::DOUBLE / least(len(x), len(y)) END"
_SETS = f"sets AS (SELECT rewrite_id, original, c, {sq.content_words('original')} AS x, {sq.content_words('c')} AS y, {sq.n_words('original')} AS n, {sq.n_words('c')} AS m FROM (SELECT rewrite_id, original, {sq.cleaned('rewrite')} AS c FROM rewrites))"

ORACLES |= {
    "content_retention": f"WITH {_SETS} SELECT rewrite_id, round({_RETENTION}, 6) AS content_retention FROM sets",
    "validate_rewrites": f"""WITH {_SETS}, v AS (SELECT rewrite_id, c, CASE WHEN n > 0 THEN m::DOUBLE / n ELSE 0 END AS ratio, {_RETENTION} AS ret FROM sets),
        w AS (SELECT *, CASE WHEN c = '' THEN 'empty' WHEN {sq.refuses('c')} THEN 'refusal' WHEN ratio < {lx.MIN_LENGTH_RATIO} THEN 'too_short' WHEN ratio > {lx.MAX_LENGTH_RATIO} THEN 'too_long' WHEN ret < {lx.MIN_CONTENT_RETENTION} THEN 'content_lost' END AS reason FROM v)
        SELECT rewrite_id, reason IS NULL AS ok, reason, round(ratio, 6) AS length_ratio, round(ret, 6) AS content_retention FROM w""",
    "failure_report": f"""WITH g AS (SELECT creation_id, run_index::BIGINT AS run_index, count(*) AS n_chunks, count(*) FILTER (status = 'ok') AS n_ok, count(*) FILTER (status <> 'ok') AS n_failed, count(*) FILTER (attempts > 1) AS n_retried FROM rewrites GROUP BY ALL),
        f AS (SELECT creation_id, run_index::BIGINT AS run_index, string_agg(r || '=' || n, ',' ORDER BY r) AS reasons FROM (SELECT creation_id, run_index, coalesce(reason, 'unknown') AS r, count(*) AS n FROM rewrites WHERE status <> 'ok' GROUP BY ALL) GROUP BY ALL)
        SELECT g.*, coalesce(reasons, '') AS reasons, n_failed / n_chunks::DOUBLE > {lx.MAX_FAILED_FRACTION} AS unreliable FROM g LEFT JOIN f USING (creation_id, run_index)""",
    "parse_profiles": f"""WITH b AS (SELECT call_id, {_PBODY} AS b FROM calls WHERE tag = 'profile'), c AS (SELECT call_id, b, CASE WHEN starts_with(b, '{{') THEN b ELSE regexp_extract(b, '(?s)\\{{.*\\}}', 0) END AS c FROM b),
        j AS (SELECT call_id, b, {_PJSON} AS j FROM c), f AS (SELECT call_id, b, {', '.join(f'{_pfield(k)} AS {k}' for k in _PKEYS)} FROM j), p AS (SELECT *, {' OR '.join(f'{k} IS NOT NULL' for k in _PKEYS)} AS structured FROM f)
        SELECT call_id, structured, CASE WHEN structured THEN concat_ws(chr(10), {', '.join(f"CASE WHEN {k} IS NOT NULL THEN '{label}: ' || {k} END" for k, label in lx.PROFILE_LABELS.items())}) ELSE '' END AS profile, CASE WHEN NOT structured THEN sha256(b) END AS free_sha FROM p""",
    "fake_rewrite_sql": f"""WITH k AS (SELECT creation_id, chunk_index, text, creation_id || ':' || chunk_index AS key FROM chunks), r AS (SELECT *, {lx.MIN_RATE}::DOUBLE + {_uniform('key', "'-1'")} * ({lx.MAX_RATE}::DOUBLE - {lx.MIN_RATE}::DOUBLE) AS rate FROM k)
        SELECT creation_id, chunk_index::BIGINT AS chunk_index, sha256(coalesce({_FAKE}, '')) AS rewrite_sha FROM r""",
    "chunk_deltas": f"WITH {_DELTAS} SELECT * REPLACE (round(delta, 6) AS delta) FROM deltas",
    "deltas_table": f"WITH {_DELTAS} SELECT run_index, creation_id, chunk_index, CASE WHEN status = 'ok' THEN printf('%.6f', delta) ELSE '' END AS delta, n_words, CASE WHEN status = 'ok' THEN 'ok' ELSE 'failed:' || coalesce(reason, 'unknown') END AS status, degenerate FROM deltas",
    "run_scores": f"WITH {_RUNS} SELECT * REPLACE (round(mean_delta, 6) AS mean_delta, round(length_weighted_mean, 6) AS length_weighted_mean, round(failed_fraction, 6) AS failed_fraction) FROM runs",
    "creation_scores": f"WITH {_SCORES} SELECT creation_id, round(score, 6) AS score, round(score_std, 6) AS score_std, n_runs_scored, n_runs, round(worst_failed, 6) AS worst_failed, round(length_weighted_score, 6) AS length_weighted_score, n_chunks, {_UNRELIABLE} AS unreliable, {_REASON} AS unreliable_reason FROM scores",
    "unscorable_report": f"""WITH {_SCORES} SELECT c.creation_id, round(score, 6) AS score, CASE WHEN score IS NULL THEN coalesce({_REASON.replace('CASE WHEN n_runs_scored = 0', 'CASE WHEN n_runs IS NULL THEN NULL WHEN n_runs_scored = 0')}, 'no rewrite of it was made') ELSE {_REASON} END AS unreliable_reason, score IS NOT NULL AS scorable
        FROM (SELECT DISTINCT creation_id FROM chunks) c LEFT JOIN scores USING (creation_id)""",
    "scores_pivot": f"WITH {_RUNS} SELECT creation_id, {', '.join(f'round(max(mean_delta) FILTER (run_index = {i}), 6) AS s_{i}' for i in range(1, N_RUNS + 1))} FROM runs GROUP BY creation_id",
    "scores_table": f"""WITH {_LABELS}, piv AS (SELECT creation_id, {', '.join(f'round(max(mean_delta) FILTER (run_index = {i}), 6) AS s_{i}' for i in range(1, N_RUNS + 1))} FROM runs GROUP BY creation_id), ti AS (SELECT id AS creation_id, arg_min(title, decl_order) AS title FROM text_sources GROUP BY id)
        SELECT c.creation_id, n_chunks, round(c.score, 6) AS score, round(score_std, 6) AS score_std, {_UNRELIABLE} AS unreliable, {_REASON} AS unreliable_reason, round(length_weighted_score, 6) AS length_weighted_score, {', '.join(f's_{i}' for i in range(1, N_RUNS + 1))}, coalesce(label, '') AS label, coalesce(borderline, false) AS borderline, coalesce(title, '') AS title
        FROM scores c LEFT JOIN piv USING (creation_id) LEFT JOIN labels USING (creation_id) LEFT JOIN ti USING (creation_id)""",
    "run_counts": f"WITH {_SCORES} SELECT a.*, b.* FROM (SELECT count(score) AS n_scored, count(*) FILTER ({_UNRELIABLE}) AS n_unreliable FROM scores) a, (SELECT count(*) AS n_rewrites, count(*) FILTER (status <> 'ok') AS n_failed, count(*) FILTER (attempts > 1) AS n_retried FROM rewrites) b",
    "run_variance_data": f"WITH {_RUNS} SELECT creation_id, round(min(mean_delta), 6) AS low, round(max(mean_delta), 6) AS high, round(max(mean_delta) - min(mean_delta), 6) AS spread FROM runs WHERE mean_delta IS NOT NULL GROUP BY creation_id",
    "otsu_candidates": f"WITH {_OTSU} SELECT k, round(lower, 6) AS lower, round(upper, 6) AS upper, round(variance, 6) AS variance FROM cand",
    "otsu_threshold": f"WITH {_OTSU} SELECT n, round(total_variance, 6) AS total_variance, round(spread, 6) AS spread, k, round(lower, 6) AS lower, round(upper, 6) AS upper, round(variance, 6) AS variance, round(tau, 6) AS tau, round(gap, 6) AS gap, round(separability, 6) AS separability, round(gap_ratio, 6) AS gap_ratio FROM otsu",
    "otsu_binned": f"WITH {_BINNED} SELECT round(tau, 6) AS tau FROM binned",
    "otsu_diagnostics": f"""WITH {_OTSU} SELECT n, k, round(tau, 6) AS tau, round(separability, 6) AS separability, round(gap_ratio, 6) AS gap_ratio, separability >= 0.5 AND gap_ratio >= 0.5 AS bimodal,
        concat_ws('; ', CASE WHEN separability < 0.5 THEN 'low separability' END, CASE WHEN gap_ratio < 0.5 THEN 'narrow gap' END) AS flags FROM otsu""",
    "otsu_crosscheck": f"""WITH {_BINNED}, b AS (SELECT otsu.tau AS tau, binned.tau AS binned_tau, greatest(lower - binned.tau, binned.tau - upper, 0) AS outside FROM otsu, binned)
        SELECT round(tau, 6) AS tau, round(binned_tau, 6) AS binned_tau, round(outside, 6) AS outside_gap, count(*) FILTER ((score > tau) <> (score > binned_tau)) AS n_differ, outside <= {lx.AGREEMENT_TOLERANCE} AS same_gap, count(*) FILTER ((score > tau) <> (score > binned_tau)) = 0 AS same_partition FROM s, b GROUP BY tau, binned_tau, outside""",
    "classify_creations": f"WITH {_LABELS} SELECT creation_id, round(score, 6) AS score, round(tau, 6) AS tau, label, borderline FROM labels",
    "partition_equality": f"WITH {_BINNED} SELECT count(*) FILTER (score > otsu.tau AND NOT score > binned.tau) AS only_first, count(*) FILTER (score > binned.tau AND NOT score > otsu.tau) AS only_second, count(*) FILTER ((score > otsu.tau) <> (score > binned.tau)) = 0 AS equal FROM s, otsu, binned",
    "suspicious_topk": f"WITH {_LABELS} SELECT creation_id, round(score, 6) AS score FROM labels WHERE label = 'suspicious' ORDER BY labels.score DESC, creation_id LIMIT 10",
    "markdown_rows": f"WITH {_LABELS} SELECT '| ' || creation_id || ' | ' || printf('%.4f', round(score, 6)) || ' | ' || label || ' |' AS line FROM labels",
    "noise_diagnostics": f"WITH {_NOISE.replace('WITH ', '')}, {_OTSU} SELECT noise.run_index, noise.creation_id, round(mean_delta, 6) AS score, CASE WHEN mean_delta IS NOT NULL THEN (mean_delta > tau)::BIGINT END AS above_tau FROM noise LEFT JOIN runs USING (run_index, creation_id), otsu",
    "histogram_bins": f"""WITH {_SCORES}, s AS (SELECT score FROM scores WHERE score IS NOT NULL), e AS (SELECT min(score) AS lo, max(score) AS hi FROM s), c AS (SELECT CASE WHEN hi > lo THEN least(19, floor((score - lo) / ((hi - lo) / 20))) ELSE 0 END::BIGINT AS bin, count(*) AS n FROM s, e GROUP BY 1)
        SELECT g.bin, round(lo + g.bin * ((hi - lo) / 20), 6) AS low, round(lo + (g.bin + 1) * ((hi - lo) / 20), 6) AS high, coalesce(n, 0) AS n FROM (SELECT unnest(range(20)) AS bin) g LEFT JOIN c USING (bin), e""",
    "sorted_scatter_data": f"WITH {_SCORES} SELECT creation_id, round(score, 6) AS score, row_number() OVER (ORDER BY scores.score, creation_id) AS rank FROM scores WHERE scores.score IS NOT NULL",
    "join_requests_results": f"WITH {_REPAIRED} SELECT rewrite_id, creation_id, rewrites.chunk_index::BIGINT AS chunk_index, run_index::BIGINT AS run_index, status, rep.n_words AS chunk_words FROM rewrites JOIN rep USING (creation_id, chunk_index)",
    "ordered_jobs": "SELECT creation_id, coalesce(chunk_index, -1)::BIGINT AS chunk_index, coalesce(run_index, -1)::BIGINT AS run_index, call_id FROM calls ORDER BY ALL",
    "band_join": f"WITH {_OTSU} SELECT a.creation_id, b.creation_id AS other_id FROM s a JOIN s b ON abs(round(a.score, 6) - round(b.score, 6)) <= 0.0005::DOUBLE AND a.creation_id < b.creation_id",
    "set_delta": f"WITH {_DECL}, b AS (SELECT DISTINCT id FROM decl WHERE set_name = 'texts'), a AS (SELECT DISTINCT id FROM decl WHERE set_name IN ('heldout', 'mixture_sources')) SELECT id AS creation_id, 'left' AS change FROM b WHERE id NOT IN (SELECT id FROM a) UNION ALL SELECT id, 'joined' FROM a WHERE id NOT IN (SELECT id FROM b)",
    "control_test": f"""WITH {_DELTAS}, d AS (SELECT a.delta - b.delta AS d FROM deltas a JOIN deltas b USING (creation_id, chunk_index) WHERE a.run_index = 1 AND b.run_index = 2 AND a.status = 'ok' AND b.status = 'ok')
        SELECT count(d) AS n, round(avg(d), 6) AS mean_difference, round(stddev_samp(d), 6) AS sd, round(avg(d) / nullif(stddev_samp(d) / sqrt(count(d)), 0), 6) AS t, round(avg(d) / nullif(stddev_samp(d), 0), 6) AS effect_size FROM d""",
    "chunk_stability": f"WITH {_DELTAS} SELECT creation_id, chunk_index, count(delta) AS n_runs, round(avg(delta), 6) AS mean_delta, round(stddev_samp(delta) / nullif(avg(delta), 0), 6) AS variation FROM deltas WHERE status = 'ok' GROUP BY ALL",
    "size_sensitivity": f"WITH n AS (SELECT {sq.n_words('text')} AS n FROM documents) SELECT z AS size, sum(ceil(n / z::DOUBLE))::BIGINT AS n_chunks, count(*) FILTER (n % z > 0) AS n_short FROM n, (SELECT unnest([100, 200, 400, 600])::BIGINT AS z) GROUP BY z",
    "request_key": "SELECT call_id, sha256(concat_ws(chr(31), coalesce(max_output_tokens::VARCHAR, chr(0)), coalesce(model_id, chr(0)), coalesce(prompt, chr(0)), coalesce(prompt_schema_version::VARCHAR, chr(0)), coalesce(provider, chr(0)), coalesce(response_format, chr(0)), coalesce(system, chr(0)))) AS plain_key FROM calls",
    "cache_anti_join": f"WITH {_CACHE} SELECT DISTINCT cache_key FROM calls WHERE status = 'failed' AND cache_key NOT IN (SELECT cache_key FROM cache)",
    "cache_hit_miss": "WITH k AS (SELECT DISTINCT cache_key FROM calls WHERE status = 'ok' AND response IS NOT NULL AND NOT cached) SELECT call_id, cache_key, cache_key IN (SELECT cache_key FROM k) AS hit FROM calls",
    "cache_verify": f"WITH {_CACHE} SELECT count(*) AS n_entries, coalesce(sum(strlen(response)), 0)::BIGINT AS n_bytes, count(*) FILTER (response IS NULL) AS n_empty, count(*) FILTER (coalesce(sha256(response) <> response_sha256, true)) AS n_bad_hash FROM cache",
    "replay_lookup": f"WITH {_CACHE} SELECT c.call_id, sha256(cache.response) AS response_sha FROM calls c LEFT JOIN cache USING (cache_key) WHERE c.cached",
    "ledger_validate": """WITH p AS (SELECT call_id, concat_ws('; ', CASE WHEN schema_version IS NULL THEN 'missing schema_version' END, CASE WHEN ts_utc IS NULL THEN 'missing ts_utc' END, CASE WHEN run_id IS NULL THEN 'missing run_id' END, CASE WHEN cache_key IS NULL THEN 'missing cache_key' END,
        CASE WHEN tag IS NULL THEN 'missing tag' END, CASE WHEN provider IS NULL THEN 'missing provider' END, CASE WHEN model_id IS NULL THEN 'missing model_id' END, CASE WHEN cached IS NULL THEN 'missing cached' END, CASE WHEN status IS NULL THEN 'missing status' END, CASE WHEN attempt IS NULL THEN 'missing attempt' END,
        CASE WHEN prompt IS NULL THEN 'missing prompt' END, CASE WHEN prompt_sha256 IS NULL THEN 'missing prompt_sha256' END, CASE WHEN schema_version <> 1 THEN 'schema_version' END, CASE WHEN status NOT IN ('ok', 'failed') THEN 'status' END,
        CASE WHEN status = 'ok' AND coalesce(response_sha256, '') = '' THEN 'no response hash' END, CASE WHEN coalesce(prompt, '') <> '' AND coalesce(prompt_sha256, '') <> sha256(prompt) THEN 'prompt hash' END) AS problems FROM calls) SELECT * FROM p WHERE problems <> ''""",
    "ledger_summary": "SELECT CASE WHEN grouping(t) = 1 THEN '*' ELSE t END AS tag, count(*) AS total, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (cached) AS cached, count(*) FILTER (NOT cached) AS live, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens FROM (SELECT *, coalesce(tag, '') AS t FROM calls) GROUP BY ROLLUP (t)",
    "rollup_tag": "SELECT provider, tag, count(*) AS n, sum(output_tokens)::BIGINT AS output_tokens FROM calls GROUP BY ROLLUP (provider, tag)",
    "latest_lines": "SELECT call_id FROM calls QUALIFY row_number() OVER (PARTITION BY run_id, cache_key, tag, attempt, cached, ts_utc ORDER BY logged_at DESC, call_id DESC) = 1",
    "longest_prefix_match": """WITH m AS (SELECT DISTINCT model_version AS v FROM calls WHERE model_version IS NOT NULL), b AS (SELECT v, arg_max(model_id, length(model_id)) AS prefix, arg_max(context_window, length(model_id))::BIGINT AS context_window FROM m JOIN model_catalogue ON starts_with(v, model_id) GROUP BY v)
        SELECT call_id, prefix, context_window FROM calls LEFT JOIN b ON model_version = v""",
    "model_comparison": """SELECT provider, model_id, count(*) AS n_chunks, count(*) FILTER (status = 'ok') AS n_ok, median(latency_ms)::INT::BIGINT AS median_latency_ms, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, round(avg(output_tokens) FILTER (status = 'ok'), 6) AS mean_output_tokens
        FROM (SELECT * FROM calls WHERE tag <> 'profile') GROUP BY provider, model_id""".replace("median(latency_ms)::INT::BIGINT", "floor(median(latency_ms))::BIGINT"),
    "delta_by_run": f"WITH {_DELTAS} SELECT run_index, count(*) AS n_chunks, count(*) FILTER (status = 'ok') AS n_ok, round(coalesce(avg(delta) FILTER (status = 'ok'), 0), 6) AS mean_delta, round(coalesce(stddev_samp(delta) FILTER (status = 'ok'), 0), 6) AS sd_delta FROM deltas GROUP BY run_index",
    "side_by_side": "SELECT creation_id, chunk_index::BIGINT AS chunk_index, count(*) AS n, string_agg(run_index || ':' || status, ' ' ORDER BY run_index, rewrite_id) AS attempts FROM rewrites GROUP BY ALL",
    "ledger_throughput": "SELECT strftime(date_trunc('hour', strptime(substr(ts_utc, 1, 19), '%Y-%m-%dT%H:%M:%S')), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n_calls, count(*) FILTER (status = 'failed') AS n_failed, sum(output_tokens)::BIGINT AS output_tokens FROM calls GROUP BY 1",
    "event_throughput": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2",
    "render_prompts": "SELECT DISTINCT creation_id, chunk_index::BIGINT AS chunk_index, sha256('Style profile of the target:' || chr(10) || "
    + lit("\n".join(f"{label}: {k} as it stands" for k, label in lx.PROFILE_LABELS.items()))
    + " || chr(10) || chr(10) || 'Restate the passage below in exactly this style. Keep its meaning and its content words; change only its style.' || chr(10) || chr(10) || 'Passage to rewrite:' || chr(10) || text || CASE WHEN chunk_index % 2 = 1 THEN chr(10) || 'Important: return only the rewritten passage, whole.' ELSE '' END) AS prompt_sha FROM chunks",
}


def _first_fit(items: str, budgets: str) -> str:
    """Common tables that pack items (id, tokens), largest first, within each budget of a table (budget), item by
    item into the first bin with room: ff (budget, i, bin, room), the last row of a budget holding its bins."""
    return f"""it AS (SELECT id, tokens, row_number() OVER (ORDER BY tokens DESC, id) AS i FROM {items}), bu AS (SELECT DISTINCT budget FROM {budgets}),
      ff AS (SELECT budget, 0::BIGINT AS i, NULL::VARCHAR AS id, NULL::BIGINT AS tokens, NULL::BIGINT AS bin, []::BIGINT[] AS room FROM bu UNION ALL
        SELECT budget, ni, nid, nt, CASE WHEN p > 0 THEN p - 1 ELSE len(room) END, CASE WHEN p > 0 THEN list_transform(room, lambda r, k: CASE WHEN k = p THEN r - nt ELSE r END) ELSE list_append(room, budget - nt) END
        FROM (SELECT ff.budget, ff.room, it.i AS ni, it.id AS nid, it.tokens AS nt, coalesce(list_position(list_transform(ff.room, lambda r: r >= it.tokens), true), 0)::BIGINT AS p FROM ff JOIN it ON it.i = ff.i + 1)),
      needed AS (SELECT budget, CASE WHEN coalesce((SELECT max(tokens) FROM it), 0) <= budget THEN max(len(room)) END AS n_bins FROM ff GROUP BY budget)"""


_BUDGETS = f"m AS (SELECT provider, model_id, floor(context_window * {lx.CONTEXT_FRACTION}::DOUBLE)::BIGINT AS budget FROM model_catalogue)"
_SIZED = f"{_SIZES}, items AS (SELECT creation_id AS id, tokens FROM sizes)"
_OWN_BUDGET = f"one AS (SELECT {BUDGET}::BIGINT AS budget)"

ORACLES |= {
    "profile_plan": f"WITH RECURSIVE {_SIZED}, {_BUDGETS}, {_first_fit('items', 'm')} SELECT provider, model_id, budget, n_bins, n_bins + (n_bins > 1)::INT AS n_calls, n_bins IS NOT NULL AS fits FROM m JOIN needed USING (budget)",
    "comparison_plan": f"""WITH RECURSIVE {_SIZED}, {_BUDGETS}, {_first_fit('items', 'm')}, c AS (SELECT count(*) AS n FROM (SELECT DISTINCT creation_id, chunk_index FROM chunks))
        SELECT provider, model_id, n_bins + (n_bins > 1)::INT AS profile_calls, n + n_bins + (n_bins > 1)::INT AS n_calls FROM m JOIN needed USING (budget), c""",
    "ffd_bins": f"WITH RECURSIVE {_SIZED}, {_OWN_BUDGET}, {_first_fit('items', 'one')} SELECT id AS creation_id, tokens, bin AS bin_index FROM ff WHERE i > 0",
    "bin_summary": f"WITH RECURSIVE {_SIZED}, {_OWN_BUDGET}, {_first_fit('items', 'one')} SELECT bin AS bin_index, count(*) AS n_creations, sum(tokens)::BIGINT AS tokens FROM ff WHERE i > 0 GROUP BY bin",
    "dry_run_plan": f"""WITH RECURSIVE {_NOISE}, {_SIZES}, {_REPAIRED}, c AS (SELECT creation_id, sum(n_words) AS n FROM rep GROUP BY creation_id), items AS (SELECT creation_id AS id, floor(n * {lx.TOKENS_PER_WORD}::DOUBLE)::BIGINT AS tokens FROM c),
        one AS (SELECT greatest({PLAN_BUDGET}, (SELECT max(tokens) FROM items))::BIGINT AS budget), {_first_fit('items', 'one')},
        a AS (SELECT count(*) AS n_creations, sum(ceil(n / 400.0::DOUBLE))::BIGINT AS n_chunks, sum(floor(n * 1.35::DOUBLE))::BIGINT AS tokens FROM c),
        b AS (SELECT coalesce(sum(ceil(coalesce(n_words, 0) / 400.0::DOUBLE)), 0)::BIGINT AS nc, coalesce(sum(floor(coalesce(n_words, 0) * 1.35::DOUBLE)), 0)::BIGINT AS nt FROM noise LEFT JOIN sizes USING (creation_id))
        SELECT n_creations, n_chunks, {N_RUNS}::BIGINT AS n_runs, ({N_RUNS} * (n_bins + (n_bins > 1)::INT))::BIGINT AS profile_calls, n_chunks * {N_RUNS} + nc AS rewrite_calls, tokens * 2 * {N_RUNS} + nt * 2 AS input_tokens FROM a, b, needed""",
    "request_key_json": "SELECT call_id, sha256(to_json({" + ", ".join(f"'{f}': {f}" for f in KEY_FIELDS) + "})) AS key FROM calls",
    "resume_calls": f"""WITH {_CACHE}, k AS (SELECT DISTINCT run_id, cache_key FROM calls)
        SELECT run_id, count(*) AS asked, count(*) FILTER (cache_key IN (SELECT cache_key FROM cache)) AS answered, count(*) FILTER (cache_key NOT IN (SELECT cache_key FROM cache)) AS "left" FROM k GROUP BY run_id""",
    "ledger_scan": "SELECT run_id, cache_key, tag, attempt::BIGINT AS attempt, cached, ts_utc, round(temperature, 6) AS temperature, sha256(response) AS response_sha FROM calls",
    "retry_rounds": f"""WITH k AS (SELECT DISTINCT creation_id, chunk_index::BIGINT AS chunk_index, text, creation_id || ':' || chunk_index AS key FROM chunks), u AS (SELECT *, {lx.MIN_RATE}::DOUBLE + {_uniform('key', "'-1'")} * ({lx.MAX_RATE}::DOUBLE - {lx.MIN_RATE}::DOUBLE) AS rate FROM k),
        w AS (SELECT creation_id, chunk_index, text AS original, coalesce({_FAKE}, '') AS rewrite FROM u), sets AS (SELECT *, {sq.content_words('original')} AS x, {sq.content_words('c')} AS y, {sq.n_words('original')} AS n, {sq.n_words('c')} AS m FROM (SELECT *, {sq.cleaned('rewrite')} AS c FROM w)),
        v AS (SELECT creation_id, chunk_index, c, CASE WHEN n > 0 THEN m::DOUBLE / n ELSE 0 END AS ratio, {_RETENTION} AS ret FROM sets),
        r AS (SELECT creation_id, chunk_index, CASE WHEN c = '' THEN 'empty' WHEN {sq.refuses('c')} THEN 'refusal' WHEN ratio < {lx.MIN_LENGTH_RATIO} THEN 'too_short' WHEN ratio > {lx.MAX_LENGTH_RATIO} THEN 'too_long' WHEN ret < {lx.MIN_CONTENT_RETENTION} THEN 'content_lost' END AS reason FROM v)
        SELECT creation_id, chunk_index, CASE WHEN reason IS NOT NULL THEN 3 WHEN chunk_index % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS attempts, reason IS NULL AS ok, reason FROM r""",
    "collection_findings": f"""WITH t AS (SELECT count(*) AS n, sum({sq.n_words('text')}) AS w FROM documents), e AS (SELECT sum(expected_words) AS x FROM text_sources)
        SELECT doc_id::VARCHAR AS id, 'boilerplate' AS finding, 'failure' AS severity FROM documents WHERE contains(lower(text), 'project gutenberg') UNION ALL SELECT '*', 'text_count', 'failure' FROM t WHERE n <> 49
        UNION ALL SELECT '*', 'total_outside_band', 'warning' FROM t, e WHERE abs(w - x) > x * 0.15::DOUBLE""",
    "band_counts": f"WITH {_OTSU}, v AS (SELECT creation_id, round(score * 1000000)::BIGINT AS v FROM s) SELECT a.creation_id, count(*) - 1 AS n_near FROM v a JOIN v b ON abs(a.v - b.v) <= 500 GROUP BY a.creation_id",
    "composite_texts": f"""WITH {_DECL}, k AS (SELECT DISTINCT id FROM decl WHERE len(gutenberg_ids) > 1)
        SELECT creation_id, sha256(string_agg({sq.strip("coalesce(text, '')")}, chr(10) || chr(10) ORDER BY doc_id)) AS text_sha, count(*) AS n_parts FROM documents WHERE creation_id IN (SELECT id FROM k) GROUP BY creation_id""",
    "edit_script_sizes": f"WITH {_ENC} SELECT rewrite_id, levenshtein(a, b) AS edits, length(b) - length(a) AS grown FROM enc WHERE levenshtein(a, b) > 0",
}
