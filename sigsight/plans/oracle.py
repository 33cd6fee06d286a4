"""DuckDB SQL twins of the test views and of every registered query.

The strings are independent re-statements of the same rules in plain SQL
(DuckDB dialect: RE2 regexes, 1-based lists, ``list_*`` functions); the
correctness gate runs them next to the Spark jobs.
"""

from __future__ import annotations

from sigsight import config as C
from sigsight.sources.tables import EXPLICIT_WINDOW_PHRASES, QUESTION_PHRASES


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join(_sql_str(v) for v in values) + "]"


SERVICES = _sql_list(C.STATIC_SERVICES)


def iso_utc(ts: str) -> str:
    return (f"(strftime({ts}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime({ts}, '%f') <> '000000' "
            f"THEN '.' || strftime({ts}, '%f') ELSE '' END || '+00:00')")


SIGNALS_CTE = f"""
_nd AS (SELECT count(*) AS n FROM documents),
_nv AS (SELECT count(*) AS n FROM embeddings),
_ev AS (
  SELECT e.event_id AS eid, e.ts, e.user_id, e.props, d.text, v.embedding,
    CASE e.event_type WHEN 'signup' THEN 'deployment' WHEN 'purchase' THEN 'alert'
         WHEN 'view' THEN 'metadata' ELSE 'log' END AS etype,
    CASE WHEN e.event_type = 'error' AND e.value >= 100 THEN 'critical'
         WHEN e.event_type = 'error' THEN 'error'
         WHEN e.event_type = 'signup' AND e.value >= 100 THEN 'error'
         WHEN e.event_type = 'purchase' THEN 'warn'
         WHEN e.event_type = 'view' THEN NULL ELSE 'info' END AS sev,
    {SERVICES}[(e.user_id % 7) + 1] AS svc
  FROM events e
  JOIN documents d ON d.doc_id = e.event_id % (SELECT n FROM _nd)
  JOIN embeddings v ON v.vec_id = e.event_id % (SELECT n FROM _nv)
),
_ev2 AS (
  SELECT *, '[' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z] ' || upper(coalesce(sev, 'debug'))
            || ' pid=' || CAST(user_id AS VARCHAR) || ' ' || text AS content
  FROM _ev
),
signals AS (
  SELECT eid AS id,
    sha256(svc || '|' || {iso_utc('ts')} || '|' || substring(content, 1, 200)) AS event_id,
    etype AS event_type, svc AS service, sev AS severity, ts AS occurred_at, content, embedding,
    'inc-' || strftime(ts, '%Y%m%d') || '-' || CAST(user_id AS VARCHAR) AS correlation_id,
    props AS metadata, CAST(ts AS DATE) AS event_date
  FROM _ev2
)"""

_PHRASES = _sql_list([p for p, _ in QUESTION_PHRASES])
_CATS = _sql_list([c for _, c in QUESTION_PHRASES])
_EXPLICIT = "(" + ", ".join(str(i) for i in EXPLICIT_WINDOW_PHRASES) + ")"

QUESTIONS_CTE = f"""
_nev AS (SELECT count(*) AS n FROM events),
_q0 AS (
  SELECT conv_id * 1000 + turn AS qid, conv_id, turn, text,
    (conv_id * 3 + turn) % {len(QUESTION_PHRASES)} AS phrase_idx,
    {SERVICES}[(conv_id % 7) + 1] AS svc,
    (conv_id * 7919 + turn * 104729) % (SELECT n FROM _nev) AS ask_event,
    (conv_id * 31 + turn) % (SELECT n FROM _nv) AS qvec_id
  FROM conversations WHERE role = 'user'
),
questions AS (
  SELECT q.qid,
    replace(replace(replace({_PHRASES}[q.phrase_idx + 1], '{{svc_sp}}', replace(q.svc, '-', ' ')),
                    '{{svc}}', q.svc), '{{text}}', q.text) AS question,
    {_CATS}[q.phrase_idx + 1] AS category,
    e.ts AS asked_at,
    CASE WHEN q.phrase_idx IN {_EXPLICIT} THEN e.ts - INTERVAL 90 MINUTE END AS start_time,
    CASE WHEN q.phrase_idx IN {_EXPLICIT} THEN e.ts END AS end_time,
    q.qvec_id, v.embedding AS qvec,
    coalesce(a.text, '') AS llm_answer,
    e.value * 37.3 AS latency_ms
  FROM _q0 q JOIN events e ON e.event_id = q.ask_event
  JOIN embeddings v ON v.vec_id = q.qvec_id
  LEFT JOIN conversations a ON a.role = 'assistant' AND a.conv_id = q.conv_id AND a.turn = q.turn + 1
)"""


def with_views(body: str, *ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + body


def normalize_query(col: str) -> str:
    return (f"trim(regexp_replace(regexp_replace(replace(lower({col}), '-', ' '), "
            f"'[?!.,;:()\\[\\]{{}}''\"\\\\]', '', 'g'), '\\s+', ' ', 'g'))")


def _any(col: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, {_sql_str(p)})" for p in phrases) + ")"


_NARROW_RULES = [
    (["last month", "past month"], 30 * 86400),
    (["last year", "past year"], 365 * 86400),
    (["last week", "past week"], 7 * 86400),
    (["last 24 hours", "past 24 hours", "yesterday"], 24 * 3600),
    (["last 6 hours", "past 6 hours"], 6 * 3600),
    (["last 2 hours", "past 2 hours", "last two hours"], 2 * 3600),
]
_WIDE_LITERALS = [
    (["last hour", "past hour"], 3600),
    (["last week", "past week"], 7 * 86400),
    (["last month", "past month"], 30 * 86400),
    (["last year", "past year"], 365 * 86400),
]
NARROW_RE = r"(?:last|past)\s+(\d+)\s+(months?|years?)"
WIDE_RE = r"(?:last|past)\s+(\d+)\s+(minutes?|hours?|days?|months?|years?)"


def narrow_start(ql: str, asked: str) -> str:
    m = f"regexp_extract({ql}, '{NARROW_RE}', 0)"
    n = f"CAST(regexp_extract({ql}, '{NARROW_RE}', 1) AS BIGINT)"
    unit = f"regexp_extract({ql}, '{NARROW_RE}', 2)"
    parts = [f"WHEN {m} <> '' THEN {asked} - to_seconds({n} * CASE WHEN starts_with({unit}, 'year') "
             f"THEN 365 ELSE 30 END * 86400)"]
    for phrases, secs in _NARROW_RULES:
        parts.append(f"WHEN {_any(ql, phrases)} THEN {asked} - to_seconds({secs})")
    return "CASE " + " ".join(parts) + f" ELSE {asked} - to_seconds(3600) END"


def narrow_defaulted(ql: str) -> str:
    m = f"regexp_extract({ql}, '{NARROW_RE}', 0)"
    return "NOT (" + f"{m} <> ''" + "".join(f" OR {_any(ql, p)}" for p, _ in _NARROW_RULES) + ")"


def wide_start(ql: str, asked: str) -> str:
    m = f"regexp_extract({ql}, '{WIDE_RE}', 0)"
    n = f"CAST(regexp_extract({ql}, '{WIDE_RE}', 1) AS BIGINT)"
    unit = f"regexp_extract({ql}, '{WIDE_RE}', 2)"
    unit_s = (f"CASE WHEN starts_with({unit}, 'minute') THEN 60 WHEN starts_with({unit}, 'hour') THEN 3600 "
              f"WHEN starts_with({unit}, 'day') THEN 86400 WHEN starts_with({unit}, 'month') THEN 2592000 "
              f"ELSE 31536000 END")
    parts = [f"WHEN {m} <> '' THEN {asked} - to_seconds({n} * {unit_s})",
             f"WHEN contains({ql}, 'yesterday') THEN {asked} - to_seconds(86400)",
             f"WHEN contains({ql}, 'today') THEN date_trunc('day', {asked})"]
    for phrases, secs in _WIDE_LITERALS:
        parts.append(f"WHEN {_any(ql, phrases)} THEN {asked} - to_seconds({secs})")
    return "CASE " + " ".join(parts) + f" ELSE {asked} - to_seconds(3600) END"


def wide_defaulted(ql: str) -> str:
    m = f"regexp_extract({ql}, '{WIDE_RE}', 0)"
    lits = ["yesterday", "today"] + [p for ps, _ in _WIDE_LITERALS for p in ps]
    return f"NOT ({m} <> '' OR {_any(ql, lits)})"


REGISTRY_CTE = """
_reg AS (SELECT DISTINCT service FROM signals WHERE service IS NOT NULL)"""

RESOLVED_CTE = f"""
_qsvc AS (
  SELECT q.qid,
    min(r.service) FILTER (WHERE contains(lower(q.question), lower(r.service))
                              OR contains(lower(q.question), replace(lower(r.service), '-', ' '))) AS s_raw,
    min(r.service) FILTER (WHERE contains({normalize_query('q.question')},
                                          replace(lower(r.service), '-', ' '))) AS s_norm
  FROM questions q, _reg r GROUP BY q.qid
),
resolved AS (
  SELECT q.*,
    coalesce(q.start_time, {narrow_start('lower(q.question)', 'q.asked_at')}) AS window_start,
    coalesce(q.end_time, q.asked_at) AS window_end,
    {narrow_defaulted('lower(q.question)')} AS window_defaulted,
    coalesce(s.s_raw, s.s_norm) AS service_filter
  FROM questions q JOIN _qsvc s USING (qid)
)"""

HITS_CTE = f"""
_pairs AS (
  SELECT r.qid, s.*,
    CASE WHEN sqrt(list_dot_product(CAST(r.qvec AS DOUBLE[]), CAST(r.qvec AS DOUBLE[])))
              * sqrt(list_dot_product(CAST(s.embedding AS DOUBLE[]), CAST(s.embedding AS DOUBLE[]))) > 0
         THEN greatest(-1.0, least(1.0, list_dot_product(CAST(r.qvec AS DOUBLE[]), CAST(s.embedding AS DOUBLE[]))
              / (sqrt(list_dot_product(CAST(r.qvec AS DOUBLE[]), CAST(r.qvec AS DOUBLE[])))
                 * sqrt(list_dot_product(CAST(s.embedding AS DOUBLE[]), CAST(s.embedding AS DOUBLE[])))))) END AS cos
  FROM resolved r JOIN signals s
    ON s.occurred_at BETWEEN r.window_start AND r.window_end
   AND (r.service_filter IS NULL OR s.service = r.service_filter)
  WHERE r.window_start < r.window_end
),
hits AS (
  SELECT * FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY cos DESC NULLS LAST, event_id) AS INTEGER) AS sim_rank,
           round(1.0 - (1.0 - cos), 4) AS similarity_score
    FROM _pairs) WHERE sim_rank <= {C.RERANK_TOP_K}
)"""

BASE = [SIGNALS_CTE, QUESTIONS_CTE, REGISTRY_CTE, RESOLVED_CTE]


def q(body: str, *extra: str) -> str:
    return with_views(body, *BASE, *extra)


ORACLE = {
    "signals_view": q("SELECT id, event_id, event_type, service, severity, occurred_at, content, "
                      "correlation_id, metadata, event_date FROM signals"),
    "hybrid_search": q("SELECT qid, sim_rank, event_id, similarity_score FROM hits", HITS_CTE),
}


# ── SQL twins of the remaining jobs ──────────────────────────────────────────

def normalise_log_sql(col: str) -> str:
    steps = [
        (r"\[\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}[^\]]*\]\s*", "", "g"),
        (r"\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?)?\s*", "", ""),
        (r"^\[?(TRACE|DEBUG|INFO|WARN(?:ING)?|ERROR|CRITICAL|FATAL)\]?\s*", "", "i"),
        (r"\[?pid[=:\s]\d+\]?", "", "gi"),
        (r"\[[\p{L}\p{N}_.\-]+-\d+\]|\bthread[=:\s]\S+", "", "gi"),
        (r"\b0x[0-9a-fA-F]{4,}\b", "", "g"),
        (r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "", "gi"),
        (r"\s+", " ", "g"),
    ]
    e = col
    for pat, rep, opt in steps:
        e = f"regexp_replace({e}, {_sql_str(pat)}, {_sql_str(rep)}, {_sql_str(opt)})" if opt else \
            f"regexp_replace({e}, {_sql_str(pat)}, {_sql_str(rep)})"
    return f"CASE WHEN trim({e}) = '' THEN {col} ELSE trim({e}) END"


def classify_sql(col: str) -> str:
    n = normalize_query(col)
    return (f"CASE WHEN {_any(n, C.ANALYTICAL_TERMS)} THEN 'analytical' "
            f"WHEN {_any(n, C.INCIDENT_TERMS)} THEN 'incident' ELSE 'unknown' END")


def rewrite_sql(col: str) -> str:
    s = f"regexp_replace({col}, '^\\s+|\\s+$', '', 'g')"
    words = f"len(list_filter(regexp_split_to_array({s}, '\\s+'), lambda x: x <> ''))"
    low = f"lower({s})"
    marker = f"(contains({s}, '?') OR " + " OR ".join(f"starts_with({low}, {_sql_str(p)})"
                                                      for p in C.REWRITE_PREFIXES) + ")"
    return (f"CASE WHEN {words} <= 4 AND NOT {marker} THEN 'Explain ' || {s} || "
            f"' in detail, including its key concepts and use cases.' ELSE {s} END")


def py_float4_sql(x: str) -> str:
    return (f"regexp_replace(regexp_replace(printf('%.4f', {x}), '(\\.\\d*?[1-9])0+$', '\\1'), "
            f"'\\.0+$', '.0')")


def utc_second_sql(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%SZ')"


def truncate_sql(text: str, n: str) -> str:
    return (f"CASE WHEN length({text}) <= {n} THEN {text} "
            f"ELSE regexp_replace(substring({text}, 1, {n}), ' [^ ]*$', '') || '...' END")


def _tokens_sql(x: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> ''))"


def _high(sev: str) -> str:
    return f"coalesce(upper(nullif({sev}, '')) IN ('CRITICAL', 'ERROR'), false)"


def _sev_rank(sev: str) -> str:
    return ("CASE " + " ".join(f"WHEN upper({sev}) = '{k}' THEN {v}" for k, v in C.SEVERITY_RANK.items())
            + " ELSE 99 END")


_LEXICAL = (f"round(len(list_intersect({_tokens_sql('a.rewritten_query')}, {_tokens_sql('a.pair_text')})) * 1.0 "
            f"/ greatest(len({_tokens_sql('a.rewritten_query')}), 1) * 6.0 + coalesce(a.cos, 0.0) * 4.0 - 3.0, 4)")

ASK_CTE = f"""
_typed AS (SELECT q.*, {classify_sql('q.question')} AS query_type FROM questions q),
_open AS (SELECT t.*, {rewrite_sql('t.question')} AS rewritten_query FROM _typed t WHERE query_type <> 'analytical'),
_ares AS (
  SELECT o.*, coalesce(o.start_time, {narrow_start('lower(o.question)', 'o.asked_at')}) AS window_start,
         coalesce(o.end_time, o.asked_at) AS window_end, coalesce(s.s_raw, s.s_norm) AS service_filter
  FROM _open o JOIN _qsvc s USING (qid)
),
_apairs AS (
  SELECT r.qid, r.rewritten_query, s.*,
    CASE WHEN sqrt(list_dot_product(CAST(r.qvec AS DOUBLE[]), CAST(r.qvec AS DOUBLE[])))
              * sqrt(list_dot_product(CAST(s.embedding AS DOUBLE[]), CAST(s.embedding AS DOUBLE[]))) > 0
         THEN greatest(-1.0, least(1.0, list_dot_product(CAST(r.qvec AS DOUBLE[]), CAST(s.embedding AS DOUBLE[]))
              / (sqrt(list_dot_product(CAST(r.qvec AS DOUBLE[]), CAST(r.qvec AS DOUBLE[])))
                 * sqrt(list_dot_product(CAST(s.embedding AS DOUBLE[]), CAST(s.embedding AS DOUBLE[])))))) END AS cos
  FROM _ares r JOIN signals s
    ON s.occurred_at BETWEEN r.window_start AND r.window_end
   AND (r.service_filter IS NULL OR s.service = r.service_filter)
  WHERE r.window_start < r.window_end
),
_acand AS (
  SELECT * FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY cos DESC NULLS LAST, event_id) AS INTEGER) AS sim_rank,
           round(1.0 - (1.0 - cos), 4) AS similarity_score,
           '[' || upper(coalesce(nullif(severity, ''), event_type)) || '] ' || content AS pair_text
    FROM _apairs) WHERE sim_rank <= {C.RERANK_TOP_K}
),
_ascored AS (SELECT a.*, {_LEXICAL} AS rerank_score FROM _acand a),
_afinal AS (
  SELECT * FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC NULLS LAST, sim_rank) AS INTEGER) AS rank
    FROM _ascored) WHERE rank <= {C.FINAL_TOP_K}
),
_afallback AS (SELECT *, CAST(NULL AS DOUBLE) AS rerank_score0, sim_rank AS rank0 FROM _acand WHERE sim_rank <= {C.FINAL_TOP_K}),
_astats AS (
  SELECT qid, count(*) AS n_final, count(rerank_score) AS n_scored,
    CASE WHEN count(rerank_score) > 0 THEN (CASE WHEN sum(CAST(round(rerank_score * 10000) AS BIGINT)) >= 0 THEN (2 * sum(CAST(round(rerank_score * 10000) AS BIGINT)) + count(rerank_score)) // (2 * count(rerank_score)) ELSE -((-2 * sum(CAST(round(rerank_score * 10000) AS BIGINT)) + count(rerank_score)) // (2 * count(rerank_score))) END / 10000.0) ELSE 'NaN'::DOUBLE END AS avg_rerank,
    CASE WHEN count(rerank_score) > 0 THEN round(min(rerank_score), 4) ELSE 'NaN'::DOUBLE END AS min_rerank,
    CASE WHEN count(rerank_score) > 0 THEN round(max(rerank_score), 4) ELSE 'NaN'::DOUBLE END AS max_rerank,
    coalesce(bool_and(coalesce(rerank_score <= {C.RERANK_THRESHOLD}, false)), false)
      AND count(rerank_score) = count(*) AS all_below_threshold
  FROM _afinal GROUP BY qid
),
_acstats AS (
  SELECT r.qid, coalesce(c.n, 0) AS n_candidates, coalesce(c.a, 0.0) AS avg_similarity
  FROM _ares r LEFT JOIN (SELECT qid, count(*) AS n, (CASE WHEN sum(CAST(round(similarity_score * 10000) AS BIGINT)) >= 0 THEN (2 * sum(CAST(round(similarity_score * 10000) AS BIGINT)) + count(similarity_score)) // (2 * count(similarity_score)) ELSE -((-2 * sum(CAST(round(similarity_score * 10000) AS BIGINT)) + count(similarity_score)) // (2 * count(similarity_score))) END / 10000.0) AS a FROM _acand GROUP BY qid) c
  USING (qid)
),
_atier AS (
  SELECT r.*, st.n_final, st.n_scored, st.avg_rerank,
    NOT coalesce(r.window_start < r.window_end, false) AS search_failed,
    CASE WHEN NOT coalesce(r.window_start < r.window_end, false) THEN 'unknown'
         WHEN coalesce(st.n_final, 0) = 0 THEN 'none'
         WHEN coalesce(st.n_scored, 0) = 0 THEN 'unknown'
         WHEN st.avg_rerank > -1.0 THEN 'high'
         WHEN st.avg_rerank > -2.0 AND st.n_final >= 3 THEN 'medium'
         ELSE 'low' END AS confidence
  FROM _ares r LEFT JOIN _astats st USING (qid)
),
_akeys0 AS (
  SELECT f.*, {_high('f.severity')} AS hi,
    max(CASE WHEN {_high('f.severity')} THEN 1 ELSE 0 END) OVER (PARTITION BY qid) = 1 AS any_hi,
    row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN {_high('f.severity')} THEN 0 ELSE 1 END,
                       {_sev_rank('f.severity')}, rank) AS sev_pos,
    row_number() OVER (PARTITION BY qid ORDER BY similarity_score DESC NULLS LAST, rank) AS sem_pos
  FROM _afinal f
),
_akeys AS (
  SELECT qid, rank,
    CAST(CASE WHEN hi AND sev_pos <= 2 THEN sev_pos WHEN sem_pos = 1 THEN 3 END AS INTEGER) AS key_order,
    CASE WHEN hi AND sev_pos <= 2 THEN '- [' || upper(severity) || '] '
         WHEN sem_pos = 1 THEN '- [TOP MATCH] ' END
      || service || ' @ ' || {utc_second_sql('occurred_at')} || ': ' || substring(content, 1, 120) AS key_line
  FROM _akeys0 WHERE any_hi AND ((hi AND sev_pos <= 2) OR sem_pos = 1)
),
_asec0 AS (
  SELECT f.*, s.section, s.section = list_min(secs) AS first_sec
  FROM (SELECT f.*,
          greatest({C.MIN_CHARS_PER_EVENT}, {C.MAX_CONTEXT_CHARS} // count(*) OVER (PARTITION BY f.qid)) AS budget,
          list_filter([CASE WHEN {_high('f.severity')} THEN 0 END,
                                 CASE WHEN coalesce(f.event_type = 'deployment', false) THEN 1 END,
                                 CASE WHEN NOT {_high('f.severity')} AND NOT coalesce(f.event_type = 'deployment', false)
                                      THEN 2 END], lambda x: x IS NOT NULL) AS secs
        FROM _afinal f) f, unnest(f.secs) AS s(section)
),
_asec AS (
  SELECT qid, rank, section, first_sec,
    CAST(row_number() OVER (PARTITION BY qid, section ORDER BY occurred_at, rank) AS INTEGER) AS section_pos,
    occurred_at, service, event_type, severity, content, budget,
    coalesce(rerank_score, similarity_score) AS score
  FROM _asec0
),
_ablocks AS (
  SELECT qid, rank, section, section_pos, first_sec,
    '[' || {_sql_list([lbl for _, lbl in C.SECTIONS])}[section + 1] || ' ' || CAST(section_pos AS VARCHAR) || ' | '
      || {utc_second_sql('occurred_at')} || ' | ' || service || ' | ' || event_type
      || CASE WHEN coalesce(severity <> '', false) THEN ' | ' || upper(severity) ELSE '' END
      || ' | score: ' || {py_float4_sql('score')} || ']' || chr(10) || {truncate_sql('content', 'budget')} AS block
  FROM _asec
),
_asections AS (
  SELECT qid, section,
    {_sql_list([h for h, _ in C.SECTIONS])}[section + 1] || chr(10) || chr(10)
      || string_agg(block, chr(10) || chr(10) ORDER BY section_pos) AS stext
  FROM _ablocks GROUP BY qid, section
),
_actx AS (
  SELECT t.qid, t.confidence, t.rewritten_query,
    CASE WHEN n.n IS NULL THEN {_sql_str(C.EMPTY_CONTEXT)} ELSE
      concat_ws(chr(10) || chr(10),
        '[Signal context: ' || CAST(n.n AS VARCHAR) || ' event(s) | confidence: ' || t.confidence || ']',
        k.kb, s.ctx) END AS context
  FROM _atier t
  LEFT JOIN (SELECT qid, count(*) AS n FROM _afinal GROUP BY qid) n USING (qid)
  LEFT JOIN (SELECT qid, '### Key Signals' || chr(10) || string_agg(key_line, chr(10) ORDER BY key_order) AS kb
             FROM _akeys GROUP BY qid) k USING (qid)
  LEFT JOIN (SELECT qid, string_agg(stext, chr(10) || chr(10) ORDER BY section) AS ctx
             FROM _asections GROUP BY qid) s USING (qid)
),
_aresults AS (
  SELECT t.qid, t.query_type, t.rewritten_query, t.window_start, t.window_end, t.service_filter,
    cs.n_candidates, cs.avg_similarity, coalesce(t.n_final, 0) AS n_final,
    coalesce(t.avg_rerank, 'NaN'::DOUBLE) AS avg_rerank, t.confidence,
    CASE WHEN t.search_failed THEN {_sql_str(C.SEARCH_FAILED_ANSWER)}
         WHEN coalesce(t.n_final, 0) = 0 THEN {_sql_str(C.NO_DATA_ANSWER)}
         WHEN t.confidence = 'low' THEN {_sql_str(C.LOW_CONFIDENCE_PREFIX)} || t.llm_answer
         ELSE t.llm_answer END AS answer,
    CASE WHEN t.search_failed THEN '' ELSE {_sql_str(C.PROMPT_HEAD)} || c.context || {_sql_str(C.PROMPT_TAIL)}
         || t.rewritten_query || {_sql_str(C.PROMPT_END)} END AS prompt
  FROM _atier t JOIN _acstats cs USING (qid) JOIN _actx c USING (qid)
  UNION ALL
  SELECT qid, query_type, {normalize_query('question')} AS rewritten_query, CAST(NULL AS TIMESTAMP),
    CAST(NULL AS TIMESTAMP), CAST(NULL AS VARCHAR), 0, 0.0, 0, 'NaN'::DOUBLE, 'unknown',
    {_sql_str(C.ANALYTICAL_ANSWER)}, ''
  FROM _typed WHERE query_type = 'analytical'
)"""


def _no_data_sql(col: str) -> str:
    return "(" + " OR ".join(f"starts_with({col}, {_sql_str(p)})" for p in C.NO_DATA_PREFIXES) + ")"


RAW_CTE = f"""
_rb0 AS (
  SELECT e.event_id AS pos, CASE WHEN e.event_id % 97 <> 13 THEN {SERVICES}[(e.user_id % 7) + 1] END AS service,
    CASE WHEN e.event_id % 83 = 5 THEN NULL WHEN e.event_id % 79 = 3 THEN strftime(e.ts, '%Y-%m-%d')
         WHEN e.event_id % 73 = 2 THEN strftime(e.ts, '%H:%M') WHEN e.event_id % 71 = 1 THEN 'soon'
         WHEN e.event_id % 67 = 4 THEN strftime(e.ts, '%Y-%m-%d %H:%M:%S.%f')
         ELSE strftime(e.ts, '%Y-%m-%dT%H:%M:%S.%fZ') END AS at_text,
    CASE WHEN e.event_id % 89 <> 7 THEN '[' || strftime(e.ts, '%Y-%m-%dT%H:%M:%S') || 'Z] pid=' || CAST(e.user_id AS VARCHAR) || ' ' || d.text END AS content,
    CASE WHEN e.event_type = 'purchase' THEN 'alert' END AS event_type,
    CASE WHEN e.event_type IN ('click', 'error') THEN 'logs' WHEN e.event_type IN ('signup', 'purchase')
         THEN 'events' ELSE 'metadata' END AS source,
    e.event_type = 'error' AND e.value >= 100 AS resend
  FROM events e JOIN documents d ON d.doc_id = e.event_id % (SELECT n FROM _nd)
),
_rb1 AS (
  SELECT pos, service, at_text, content, CASE WHEN source = 'logs' THEN NULL ELSE event_type END AS event_type,
         source FROM _rb0
  UNION ALL
  SELECT pos, service, at_text, content, 'alert', 'events' FROM _rb0 WHERE resend
),
_rb2 AS (
  SELECT *, CASE WHEN regexp_full_match(at_text, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ][0-9]{{2}}:[0-9]{{2}}.*')
                 THEN TRY_CAST(rtrim(at_text, 'Z') AS TIMESTAMP) END AS occurred_at FROM _rb1
),
_raw AS (
  SELECT *, CASE WHEN service IS NULL THEN 'missing service' WHEN content IS NULL THEN 'missing content'
                 WHEN at_text IS NULL THEN 'missing occurred_at' WHEN occurred_at IS NULL THEN 'bad occurred_at' END AS reason
  FROM _rb2
),
_rb AS (SELECT * EXCLUDE (reason, at_text) FROM _raw WHERE reason IS NULL),
_prep AS (
  SELECT *, coalesce(event_type, CASE source WHEN 'logs' THEN 'log' WHEN 'events' THEN 'deployment'
                                             ELSE 'metadata' END) AS etype,
    sha256(service || '|' || {iso_utc('occurred_at')} || '|' || substring(content, 1, 200)) AS event_id,
    CASE source WHEN 'logs' THEN 0 WHEN 'events' THEN 1 ELSE 2 END AS source_rank,
    CAST(occurred_at AS DATE) AS event_date
  FROM _rb
),
_first AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY source_rank, pos) AS rn FROM _prep)
  WHERE rn = 1
),
_cut AS (
  SELECT make_timestamp(CAST(floor(epoch_us(min(ts)) / 2 + epoch_us(max(ts)) / 2) AS BIGINT)) AS c FROM events
),
_new AS (SELECT * FROM _first WHERE occurred_at >= (SELECT c FROM _cut))"""

_JUDGE_GT = "coalesce(groundedness_score, 0.45)"

QLOG_CTE = f"""
_pairs_ql AS (
  SELECT u.conv_id, u.turn, u.text AS query, a.text AS answer, u.conv_id * 1000 + u.turn AS id,
         (u.conv_id * 101 + u.turn) % (SELECT n FROM _nev) AS lat_event
  FROM conversations u JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user'
),
query_logs AS (
  SELECT p.id, p.query, p.answer,
    CASE WHEN l.quality = 1 THEN 0.9 - l.toxic * 0.6 WHEN l.quality = 0 THEN 0.3 END AS groundedness_score,
    CASE WHEN l.quality IS NOT NULL THEN 1.0 - l.toxic * 0.5 END AS relevance_score,
    round(e.value / 100.0, 3) AS latency, e.ts AS created_at
  FROM _pairs_ql p LEFT JOIN labels l ON l.doc_id = p.id JOIN events e ON e.event_id = p.lat_event
),
feedback AS (
  SELECT l.doc_id AS id, d.source AS query, d.text AS answer,
    CASE WHEN l.toxic = 1 THEN 'bad' WHEN l.quality = 1 THEN 'good' ELSE 'meh' END AS rating
  FROM labels l JOIN documents d USING (doc_id) JOIN events e ON e.event_id = (l.doc_id * 13) % (SELECT n FROM _nev)
),
judge_replies AS (
  SELECT id,
    CASE id % 11
      WHEN 0 THEN '{{"groundedness": {{"score": ' || printf('%.2f', {_JUDGE_GT}) || ', "explanation": "answer of '
                  || CAST(length(answer) AS VARCHAR) || ' chars"}}, "relevance": {{"score": '
                  || printf('%.2f', coalesce(relevance_score, 0.55)) || ', "explanation": "on topic"}}}}'
      WHEN 1 THEN '{{"groundedness": {{"score": "' || printf('%.2f', {_JUDGE_GT}) || '"}}, "relevance": {{"score": "'
                  || printf('%.2f', coalesce(relevance_score, 0.55)) || '", "explanation": "string scores"}}}}'
      WHEN 2 THEN '{{"groundedness": {{"score": 1.7, "explanation": "high"}}, "relevance": {{"score": -0.25}}}}'
      WHEN 3 THEN '{{"groundedness": {{"score": ' || printf('%.2f', {_JUDGE_GT}) || '}}}}'
      WHEN 4 THEN '{{"groundedness": {{"score": ' || printf('%.2f', {_JUDGE_GT}) || ', "explan'
      WHEN 5 THEN '  {{"groundedness": {{"score": ' || printf('%.2f', {_JUDGE_GT}) || ', "explanation": "ok"}}, '
                  || '"relevance": {{"score": ' || printf('%.2f', coalesce(relevance_score, 0.55))
                  || ', "explanation": "ok"}}, "correctness": {{"score": 0.123456, "explanation": "close"}}}}  '
      WHEN 6 THEN '{{"groundedness": {{"score": null}}, "relevance": {{"score": 0.5}}}}'
      WHEN 7 THEN '{{"groundedness": {{"score": NaN, "explanation": "no number"}}, "relevance": {{"score": '
                  || printf('%.2f', coalesce(relevance_score, 0.55)) || ', "explanation": null}}}}'
      WHEN 8 THEN '{{"groundedness": {{"score": 0.10}}, "relevance": {{"score": ' || printf('%.2f', coalesce(relevance_score, 0.55))
                  || '}}, "groundedness": {{"score": ' || printf('%.2f', {_JUDGE_GT}) || ', "explanation": "said again"}}}}'
      WHEN 9 THEN '{{"groundedness": {{"score": ' || printf('%.2f', {_JUDGE_GT}) || ', "explanation": null}}, "relevance": {{"score": 2}}}}'
      ELSE '{{"groundedness": {{"score": "high"}}, "relevance": {{"score": 0.5}}}}' END AS raw,
    CASE WHEN id % 3 = 0 THEN 'expected ' || CAST(length(answer) AS VARCHAR) END AS expected_answer,
    query, answer
  FROM query_logs
)"""


def _judge_metric(key: str) -> tuple[str, str, str, str]:
    node = f"json_extract(v, '$.{key}')"
    sc = f"json_extract(v, '$.{key}.score')"
    present = f"({node} IS NOT NULL)"
    node_ok = f"(NOT {present} OR json_type({node}) = 'OBJECT')"
    sd = f"TRY_CAST(json_extract_string(v, '$.{key}.score') AS DOUBLE)"
    sc_ok = (f"({sc} IS NULL OR (json_type({sc}) IN ('DOUBLE', 'BIGINT', 'UBIGINT', 'BOOLEAN') "
             f"OR (json_type({sc}) = 'VARCHAR' AND {sd} IS NOT NULL)))")
    score = (f"CASE WHEN {sc} IS NULL THEN 0.0 WHEN isnan({sd}) THEN 0.0 "
             f"ELSE round(least(1.0, greatest(0.0, {sd})), 4) END")
    expl = (f"CASE WHEN json_type(json_extract(v, '$.{key}.explanation')) = 'NULL' THEN 'None' "
            f"ELSE coalesce(json_extract_string(v, '$.{key}.explanation'), {_sql_str(C.JUDGE_DEFAULT_EXPLANATION)}) END")
    return present, f"({node_ok} AND {sc_ok})", score, expl


def parse_judge_sql() -> str:
    g_p, g_ok, g_s, g_e = _judge_metric("groundedness")
    r_p, r_ok, r_s, r_e = _judge_metric("relevance")
    c_p, c_ok, c_s, c_e = _judge_metric("correctness")
    fail = _sql_str(C.JUDGE_PARSE_FAILURE)
    return f"""
_jp AS (
  SELECT id, expected_answer IS NOT NULL AS want, CASE WHEN json_valid(trim(raw)) THEN
    -- of repeated keys the last one counts: the first is renamed
    CASE WHEN len(regexp_extract_all(raw, '"groundedness":')) > 1
         THEN regexp_replace(trim(raw), '"groundedness":', '"earlier":') ELSE trim(raw) END::JSON END AS v
  FROM judge_replies
),
_jp2 AS (
  SELECT id, v, v IS NOT NULL AS parsed, want AND {c_p} AS want_c,
    v IS NOT NULL AND json_type(v) = 'OBJECT' AND {g_ok} AND {r_ok} AND (NOT (want AND {c_p}) OR {c_ok}) AS ok,
    {g_s} AS gs, {g_e} AS ge, {r_s} AS rs, {r_e} AS re, {c_s} AS cs, {c_e} AS ce
  FROM _jp
),
parsed_judge AS (
  SELECT id,
    CASE WHEN NOT parsed THEN 'parse_failed' WHEN ok THEN 'ok' ELSE 'error' END AS judge_status,
    CASE WHEN ok THEN gs WHEN NOT parsed THEN 0.0 END AS groundedness_score,
    CASE WHEN ok THEN ge WHEN NOT parsed THEN {fail} END AS groundedness_explanation,
    CASE WHEN ok THEN rs WHEN NOT parsed THEN 0.0 END AS relevance_score,
    CASE WHEN ok THEN re WHEN NOT parsed THEN {fail} END AS relevance_explanation,
    CASE WHEN ok AND want_c THEN cs END AS correctness_score,
    CASE WHEN ok AND want_c THEN ce END AS correctness_explanation
  FROM _jp2
)"""


def judge_prompt_expr(context: str, query: str, answer: str, expected: str) -> str:
    """Judge prompt over a list of context texts."""
    nl = "chr(10)"
    ctx = f"coalesce(array_to_string(list_transform({context}, lambda d, i: '[' || CAST(i AS VARCHAR) || '] ' || d), {nl}), '')"
    has = f"coalesce({expected} <> '', false)"
    return (f"'## Context (retrieved documents):' || {nl} || {ctx} || {nl} || {nl} "
            f"|| '## Question:' || {nl} || {query} || {nl} || {nl} || '## Generated Answer:' || {nl} || {answer} || {nl} "
            f"|| CASE WHEN {has} THEN {nl} || '## Expected Answer:' || {nl} || {expected} || {nl} ELSE '' END "
            f"|| {nl} || {_sql_str(C.JUDGE_CRITERIA)} || CASE WHEN {has} THEN {_sql_str(C.JUDGE_CORRECTNESS_CRITERION)} ELSE '' END "
            f"|| {nl} || {_sql_str(C.JUDGE_SCHEMA_HEAD)} || CASE WHEN {has} THEN {_sql_str(C.JUDGE_CORRECTNESS_SCHEMA)} ELSE '' END "
            f"|| {nl} || '}}'")


def judge_prompt_sql() -> str:
    prompt = judge_prompt_expr("string_split(answer, chr(10))", "query", "answer", "expected_answer")
    return f"SELECT id, {prompt} AS judge_prompt FROM judge_replies"


def _eval_cte() -> str:
    return f"""
_bounds AS (SELECT min(ts) AS lo, max(ts) AS hi FROM events),
_eq AS (
  SELECT q.qid, q.category, q.question, q.asked_at, q.qvec_id, q.qvec, q.llm_answer, q.latency_ms,
    CASE WHEN q.category IN ('lookup', 'multi-hop', 'no-answer')
          AND NOT (q.category = 'no-answer' AND (q.start_time IS NOT NULL OR q.end_time IS NOT NULL))
         THEN 'score' ELSE 'defer' END AS route,
    CASE WHEN q.category IN ('lookup', 'multi-hop') AND q.start_time IS NULL THEN (SELECT lo FROM _bounds)
         ELSE q.start_time END AS start_time,
    CASE WHEN q.category IN ('lookup', 'multi-hop') AND q.start_time IS NULL THEN (SELECT hi FROM _bounds)
         ELSE q.end_time END AS end_time
  FROM questions q
),
_gtq AS (
  SELECT q.qid, {narrow_start('lower(q.question)', 'q.asked_at')} AS ws, q.asked_at AS we,
    coalesce(s.s_raw, s.s_norm) AS svc, v.label AS qlabel
  FROM questions q JOIN _qsvc s USING (qid) JOIN embeddings v ON v.vec_id = q.qvec_id
),
_gt AS (
  SELECT g.qid, 'evt_' || substring(s.event_id, 1, 12) AS gt_id
  FROM _gtq g JOIN signals s ON s.occurred_at BETWEEN g.ws AND g.we AND (g.svc IS NULL OR s.service = g.svc)
  JOIN embeddings v ON v.vec_id = s.id % (SELECT n FROM _nv) AND v.label = g.qlabel
  WHERE g.ws < g.we
)"""


def eval_results_sql() -> str:
    """Eval rows over the ask chain applied to the routed questions (``_ask_over_eq``)."""
    return f"""
_er0 AS (
  SELECT e.qid, e.category, e.question, e.route, CAST(printf('%.1f', e.latency_ms) AS DOUBLE) AS latency_ms, a.confidence, a.answer,
    (SELECT list(substring(f.event_id, 1, 12) ORDER BY f.rank) FROM _afinal f WHERE f.qid = e.qid) AS ids,
    (SELECT count(DISTINCT substring(lower(regexp_replace(gt_id, '^evt_', '')), 1, 12)) FROM _gt g WHERE g.qid = e.qid) AS n_gt,
    (SELECT count(DISTINCT substring(f.event_id, 1, 12)) FROM _afinal f WHERE f.qid = e.qid AND f.rank <= {C.RECALL_K}
       AND substring(f.event_id, 1, 12) IN (SELECT substring(lower(regexp_replace(gt_id, '^evt_', '')), 1, 12)
                                            FROM _gt g WHERE g.qid = e.qid)) AS n_hit_k,
    (SELECT min(f.rank) FROM _afinal f WHERE f.qid = e.qid
       AND substring(f.event_id, 1, 12) IN (SELECT substring(lower(regexp_replace(gt_id, '^evt_', '')), 1, 12)
                                            FROM _gt g WHERE g.qid = e.qid)) AS first_rank,
    (SELECT count(*) FROM _afinal f WHERE f.qid = e.qid) AS n_retrieved
  FROM _eq e LEFT JOIN _aresults a ON a.qid = e.qid AND e.route = 'score'
),
eval_res AS (
  SELECT qid, category, question, n_gt AS n_ground_truth,
    CASE WHEN route <> 'score' THEN NULL WHEN category IN ('lookup', 'multi-hop') AND n_gt = 0 THEN CAST([] AS VARCHAR[])
         ELSE coalesce(ids, CAST([] AS VARCHAR[])) END AS retrieved,
    CASE WHEN route = 'score' THEN answer END AS answer,
    CASE WHEN route = 'score' AND category IN ('lookup', 'multi-hop') AND n_gt = 0 THEN 'no ground truth ids' END AS error,
    CASE WHEN route <> 'score' THEN 'deferred' WHEN category IN ('lookup', 'multi-hop') AND n_gt = 0 THEN 'errored'
         ELSE 'scored' END AS status,
    CASE WHEN route = 'score' AND category IN ('lookup', 'multi-hop') AND n_gt > 0 THEN n_hit_k * 1.0 / n_gt END AS recall_at_5,
    CASE WHEN route = 'score' AND category IN ('lookup', 'multi-hop') AND n_gt > 0
         THEN coalesce(1.0 / first_rank, 0.0) END AS mrr,
    CASE WHEN route = 'score' AND category = 'no-answer'
         THEN n_retrieved = 0 AND NOT coalesce(confidence = 'unknown', false) END AS refusal_correct,
    CASE WHEN route = 'score' THEN latency_ms END AS latency_ms,
    CASE WHEN route = 'score' THEN confidence END AS confidence
  FROM _er0
)"""


_MEASURES = """count(*) AS total, count(*) FILTER (WHERE status = 'scored') AS scored,
    count(*) FILTER (WHERE status = 'deferred') AS deferred, count(*) FILTER (WHERE status = 'errored') AS errored,
    round(avg(recall_at_5), 4) AS mean_recall_at_5, round(avg(mrr), 4) AS mean_mrr,
    round(avg(CAST(refusal_correct AS DOUBLE)), 4) AS refusal_accuracy"""


def _pct_sql(src: str, value: str, group: str | None, pcts=(50, 95)) -> str:
    g = f"{group}, " if group else ""
    part = f"PARTITION BY {group}" if group else ""
    cols = []
    for p in pcts:
        j = f"greatest(1, least(n - 1, ({p} * (n + 1)) // 100))"
        d = f"({p} * (n + 1) - 100 * {j})"
        cols.append(f"round(CASE WHEN max(n) = 1 THEN max({value}) ELSE "
                    f"(max(CASE WHEN rk = {j} THEN {value} END) * (100 - max({d})) + "
                    f"max(CASE WHEN rk = {j} + 1 THEN {value} END) * max({d})) / 100 END, 1) AS latency_ms_p{p}")
    return (f"SELECT {g}{', '.join(cols)} FROM (SELECT {g}{value}, row_number() OVER ({part} ORDER BY {value}) AS rk, "
            f"count(*) OVER ({part}) AS n FROM {src} WHERE {value} IS NOT NULL) t"
            + (f" GROUP BY {group}" if group else ""))


EVAL_BASE = [SIGNALS_CTE, QUESTIONS_CTE, REGISTRY_CTE, RESOLVED_CTE, _eval_cte()]


def _ask_over_eq() -> str:
    chain = ASK_CTE.replace(
        "_typed AS (SELECT q.*, " + classify_sql('q.question') + " AS query_type FROM questions q)",
        "_typed AS (SELECT q.*, " + classify_sql('q.question') + " AS query_type FROM _eq q WHERE q.route = 'score')")
    return chain


def ask_q(body: str, *extra: str) -> str:
    return with_views(body, *BASE, ASK_CTE, *extra)


ORACLE.update({
    "normalise_log": q(f"SELECT id, {normalise_log_sql('content')} AS normalised FROM signals"),
    "ingest_validate": with_views(
        "SELECT source, count(*) AS n, coalesce(reason, 'accepted') AS reject_reason FROM _raw GROUP BY source, reason",
        "_nd AS (SELECT count(*) AS n FROM documents)", RAW_CTE),
    "ingest_dedup": with_views(
        "SELECT event_id, source, pos, etype AS event_type, service, occurred_at FROM _first",
        "_nd AS (SELECT count(*) AS n FROM documents)", RAW_CTE),
    "ingest_new_rows": with_views(
        "SELECT event_id, source, etype AS event_type, event_date FROM _new",
        "_nd AS (SELECT count(*) AS n FROM documents)", RAW_CTE),
    "ingest_counts": with_views(
        """SELECT s.source, coalesce(n.c, 0) AS ingested, coalesce(t.c, 0) - coalesce(n.c, 0) AS skipped,
                  coalesce(t.c, 0) AS total
           FROM (SELECT unnest(['logs', 'events', 'metadata']) AS source) s
           LEFT JOIN (SELECT source, count(*) AS c FROM _prep GROUP BY source) t USING (source)
           LEFT JOIN (SELECT source, count(*) AS c FROM _new GROUP BY source) n USING (source)
           UNION ALL
           SELECT 'total', (SELECT count(*) FROM _new), (SELECT count(*) FROM _prep) - (SELECT count(*) FROM _new),
                  (SELECT count(*) FROM _prep)""",
        "_nd AS (SELECT count(*) AS n FROM documents)", RAW_CTE),
    "parse_questions": q(f"""SELECT q.qid, {normalize_query('q.question')} AS normalized_query,
        {classify_sql('q.question')} AS query_type, {wide_start('lower(q.question)', 'q.asked_at')} AS wide_start,
        q.asked_at AS wide_end, {wide_defaulted('lower(q.question)')} AS wide_defaulted, s.s_norm AS parsed_service
        FROM questions q JOIN _qsvc s USING (qid)"""),
    "resolve_request": q("SELECT qid, window_start, window_end, window_defaulted, service_filter FROM resolved"),
    "rewrite_query": q(f"SELECT qid, {rewrite_sql('question')} AS rewritten_query FROM questions"),
    "service_registry": q("SELECT service, CAST(rank() OVER (ORDER BY service) AS INTEGER) AS ord FROM _reg"),
    "analytical_gate": q(f"""SELECT qid, {normalize_query('question')} AS rewritten_query,
        {_sql_str(C.ANALYTICAL_ANSWER)} AS answer, 'unknown' AS confidence FROM questions
        WHERE {classify_sql('question')} = 'analytical'"""),
    "incident_signal": q(f"""SELECT qid, regexp_matches(question, {_sql_str(C.INCIDENT_WORD_PATTERN)}, 'i')
        OR regexp_matches(question, {_sql_str(C.TIME_WORD_PATTERN)}, 'i') AS incident_signal FROM questions"""),
    "candidate_stats": q("""SELECT r.qid, coalesce(c.n, 0) AS n_candidates, coalesce(c.a, 0.0) AS avg_similarity
        FROM resolved r LEFT JOIN (SELECT qid, count(*) AS n, (CASE WHEN sum(CAST(round(similarity_score * 10000) AS BIGINT)) >= 0 THEN (2 * sum(CAST(round(similarity_score * 10000) AS BIGINT)) + count(similarity_score)) // (2 * count(similarity_score)) ELSE -((-2 * sum(CAST(round(similarity_score * 10000) AS BIGINT)) + count(similarity_score)) // (2 * count(similarity_score))) END / 10000.0) AS a FROM hits
        GROUP BY qid) c USING (qid)""", HITS_CTE),
    "no_data_questions": q("SELECT qid FROM resolved WHERE qid NOT IN (SELECT qid FROM hits)", HITS_CTE),
    "vector_topk": q("""SELECT sim_rank, event_id, similarity_score FROM (
        SELECT s.event_id, CAST(row_number() OVER (ORDER BY c DESC NULLS LAST, s.event_id) AS INTEGER) AS sim_rank,
               round(1.0 - (1.0 - c), 4) AS similarity_score FROM (
          SELECT s.*, CASE WHEN sqrt(list_dot_product(m.v, m.v))
                  * sqrt(list_dot_product(CAST(s.embedding AS DOUBLE[]), CAST(s.embedding AS DOUBLE[]))) > 0
             THEN greatest(-1.0, least(1.0, list_dot_product(m.v, CAST(s.embedding AS DOUBLE[]))
               / (sqrt(list_dot_product(m.v, m.v))
                  * sqrt(list_dot_product(CAST(s.embedding AS DOUBLE[]), CAST(s.embedding AS DOUBLE[])))))) END AS c
          FROM signals s, (SELECT list(x ORDER BY i) AS v FROM (
              SELECT i, avg(CAST(q.qvec[i] AS DOUBLE)) AS x FROM questions q, range(1, len(q.qvec) + 1) t(i)
              GROUP BY i)) m) s) WHERE sim_rank <= 20"""),
    "rerank_scores": ask_q("SELECT qid, event_id, rerank_score FROM _ascored"),
    "rerank_topk": ask_q("SELECT qid, rank, event_id, rerank_score, similarity_score FROM _afinal"),
    "rerank_fallback": ask_q("SELECT qid, rank0 AS rank, event_id, rerank_score0 AS rerank_score FROM _afallback"),
    "rerank_stats": ask_q("""SELECT qid, n_final, n_scored, avg_rerank, min_rerank, max_rerank, all_below_threshold,
        CASE WHEN n_final = 0 THEN 'none' WHEN n_scored = 0 THEN 'unknown' WHEN avg_rerank > -1.0 THEN 'high'
             WHEN avg_rerank > -2.0 AND n_final >= 3 THEN 'medium' ELSE 'low' END AS confidence FROM _astats"""),
    "strong_weak": ask_q(f"""SELECT qid, event_id, rerank_score IS NULL OR rerank_score > {C.RERANK_THRESHOLD}
        AS strong FROM _afinal"""),
    "investigation_counts": ask_q(f"""SELECT qid, count(*) AS timeline_events,
        count(*) FILTER (WHERE {_high('severity')}) AS error_events,
        count(*) FILTER (WHERE event_type = 'deployment') AS deployment_events FROM _afinal GROUP BY qid"""),
    "key_signals": ask_q("SELECT qid, key_order, key_line FROM _akeys"),
    "section_timeline": ask_q("SELECT qid, section, section_pos, block FROM _ablocks"),
    "assemble_context": ask_q("SELECT qid, prompt FROM _aresults"),
    "ask_answers": ask_q(f"""SELECT qid, query_type, confidence, n_candidates, avg_similarity, n_final, answer,
        {_no_data_sql('answer')} AS no_data_answer FROM _aresults"""),
    "sources_array": ask_q("""SELECT qid, list(event_id ORDER BY rank) AS source_ids,
        list(concat_ws('|', CAST(id AS VARCHAR), event_id, md5(content), strftime(occurred_at, '%Y-%m-%dT%H:%M:%S'), service,
             event_type, printf('%.4f', similarity_score), coalesce(severity, '-'), printf('%.4f', rerank_score), metadata)
             ORDER BY rank) AS source_lines FROM _afinal GROUP BY qid"""),
    "judge_prompt": with_views(judge_prompt_sql(), "_nev AS (SELECT count(*) AS n FROM events)", QLOG_CTE),
    "parse_judge": with_views(
        "SELECT *, coalesce(groundedness_score < 0.5, false) AS low_groundedness FROM parsed_judge",
        "_nev AS (SELECT count(*) AS n FROM events)", QLOG_CTE, parse_judge_sql()),
    "quality_summary": with_views(
        """SELECT (SELECT count(*) FROM query_logs) AS total_queries,
                  coalesce((SELECT CAST((2 * sum(CAST(round(latency * 1000000) AS BIGINT)) + 1000 * count(latency))
                                        // (2000 * count(latency)) AS DOUBLE) / 1000.0
                            FROM query_logs HAVING count(latency) > 0), 0.0) AS avg_latency,
                  (SELECT count(*) FROM query_logs WHERE groundedness_score IS NOT NULL AND groundedness_score < 0.5)
                    AS low_groundedness_count,
                  (SELECT count(*) FROM feedback WHERE rating = 'bad') AS bad_feedback_count""",
        "_nev AS (SELECT count(*) AS n FROM events)", QLOG_CTE),
    "latency_percentiles": q(_pct_sql("questions", "latency_ms", "category")),
    "events_before": q("""SELECT q.qid, s.event_id, s.occurred_at,
        CAST(row_number() OVER (PARTITION BY q.qid ORDER BY s.occurred_at DESC, s.event_id) AS INTEGER) AS position
        FROM questions q JOIN signals s ON s.occurred_at BETWEEN q.asked_at - INTERVAL 30 MINUTE AND q.asked_at"""),
    "events_before_runs": q("""SELECT q.qid, count(*) AS n, min(s.pos) AS first_position, max(s.pos) AS last_position
        FROM questions q JOIN (SELECT occurred_at, row_number() OVER (ORDER BY occurred_at, event_id DESC) AS pos FROM signals) s
          ON s.occurred_at BETWEEN q.asked_at - INTERVAL 30 MINUTE AND q.asked_at GROUP BY q.qid"""),
    "service_timeline": q("""SELECT service, CAST(occurred_at AS DATE) AS event_date, occurred_at, event_id,
        row_number() OVER (PARTITION BY service ORDER BY occurred_at DESC, event_id) AS position FROM signals"""),
    "deployments_in_window": q("""SELECT r.qid, count(*) AS n, max(s.occurred_at) AS last_at FROM resolved r JOIN signals s
        ON s.event_type = 'deployment' AND s.occurred_at BETWEEN r.window_start AND r.window_end
        WHERE r.window_start < r.window_end GROUP BY r.qid"""),
    "stored_search": q(
        "SELECT qid, sim_rank, id, event_id, similarity_score FROM hits", RAW_CTE, f"""
stored AS (
  -- ids go on where the date's earlier append ended; appends are numbered in the order of event ids
  SELECT f.event_id, f.etype AS event_type, f.service, f.occurred_at, v.embedding,
    CAST(date_diff('day', DATE '1970-01-01', f.event_date) AS BIGINT) * {1 << 40}
      + row_number() OVER (PARTITION BY f.event_date ORDER BY f.occurred_at >= (SELECT c FROM _cut), f.event_id) AS id
  FROM _first f JOIN embeddings v ON v.vec_id = f.pos % (SELECT n FROM _nv))""",
        HITS_CTE.replace("JOIN signals s", "JOIN stored s")),
    "hybrid_search_types": q("SELECT qid, sim_rank, event_id, similarity_score FROM hits", HITS_CTE.replace(
        "WHERE r.window_start < r.window_end",
        "WHERE r.window_start < r.window_end AND (r.qid % 3 <> 0 OR s.event_type IN ('alert', 'deployment'))")),
    "resolve_explicit_service": q("""SELECT qid, CASE WHEN qid % 3 = 0 THEN 'order-service' ELSE coalesce(s_raw, s_norm) END
        AS service_filter FROM _qsvc"""),
    "question_set": q("""SELECT CAST(qid AS VARCHAR) AS id, category, question, 'evt_' || CAST(qvec_id AS VARCHAR) AS ground_truth,
          strftime(start_time, '%Y-%m-%dT%H:%M:%S.%fZ') AS start_time, strftime(end_time, '%Y-%m-%dT%H:%M:%S.%fZ') AS end_time
        FROM questions
        UNION ALL SELECT 'rejected', NULL, left('{"id":"' || CAST(qid AS VARCHAR) || '","category":"', 12), NULL, NULL, NULL
        FROM questions WHERE qid % 3 = 1"""),
    "query_log_replay": with_views(
        """SELECT * REPLACE (CAST(groundedness_score AS DOUBLE) AS groundedness_score, CAST(relevance_score AS DOUBLE) AS relevance_score),
          CASE WHEN id % 2 = 0 THEN 'even' ELSE 'odd' END AS run_id FROM query_logs""",
        "_nev AS (SELECT count(*) AS n FROM events)", QLOG_CTE),
    "report_by_category": with_views(f"SELECT category, {_MEASURES} FROM eval_res GROUP BY category",
                                     *EVAL_BASE, _ask_over_eq(), eval_results_sql()),
    "feedback_split": with_views("SELECT id, rating, rating IN ('good', 'bad') AS accepted FROM feedback",
                                 "_nev AS (SELECT count(*) AS n FROM events)", QLOG_CTE),
    "bundle_items": f"""
        WITH e AS (SELECT *, {SERVICES}[(user_id % 7) + 1] AS svc,
            CASE WHEN event_type IN ('click', 'error') THEN 'logs' WHEN event_type IN ('signup', 'purchase') THEN 'events'
                 ELSE 'metadata' END AS src FROM events)
        SELECT src AS source, CAST(0 AS INTEGER) AS pos, svc AS service, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS occurred_at,
            'say "' || event_type || '" ü ' || CAST(event_id AS VARCHAR) AS content,
            CASE WHEN event_type = 'error' THEN 'error' END AS severity, replace(props, ' ', '') AS metadata
        FROM e WHERE event_id % 101 <> 0
        UNION ALL
        SELECT 'rejected', 0, NULL, NULL, left(CASE src WHEN 'logs' THEN '{{"logs": [{{"service":"' WHEN 'events'
            THEN '{{"logs": null, "events": [' ELSE '{{"metadata": [{{"service":"' END, 20), NULL, NULL
        FROM e WHERE event_id % 101 = 0""",
    "correlation_groups": q("""SELECT correlation_id, count(*) AS n_events, min(occurred_at) AS first_at,
        max(occurred_at) AS last_at, count(DISTINCT service) AS n_services FROM signals
        WHERE correlation_id IS NOT NULL GROUP BY correlation_id"""),
    "eval_results": with_views("SELECT * FROM eval_res", *EVAL_BASE, _ask_over_eq(), eval_results_sql()),
    "eval_by_category": with_views(f"SELECT category, {_MEASURES} FROM eval_res GROUP BY category",
                                   *EVAL_BASE, _ask_over_eq(), eval_results_sql()),
    "eval_overall": with_views(
        f"SELECT * FROM (SELECT {_MEASURES} FROM eval_res) a, "
        f"({_pct_sql('(SELECT * FROM eval_res WHERE status = ' + chr(39) + 'scored' + chr(39) + ')', 'latency_ms', None)}) b",
        *EVAL_BASE, _ask_over_eq(), eval_results_sql()),
    "eval_summary": with_views(
        f"""SELECT CAST(row_number() OVER (ORDER BY category) AS INTEGER) AS position, category, total AS n,
                   mean_recall_at_5, mean_mrr, refusal_accuracy FROM
            (SELECT category, {_MEASURES} FROM eval_res GROUP BY category)
            UNION ALL SELECT CAST(_categories + 1 AS INTEGER), 'overall', scored, mean_recall_at_5, mean_mrr, refusal_accuracy FROM
            (SELECT {_MEASURES}, count(DISTINCT category) AS _categories FROM eval_res)""",
        *EVAL_BASE, _ask_over_eq(), eval_results_sql()),
})

# Hashed token counts, L2-normalised: bucket use and the fullest bucket follow from the text.
ORACLE["embed_unit_norm"] = with_views(
    f"""SELECT event_id, CAST({C.EMBEDDING_DIMENSION} AS INTEGER) AS dim,
           CAST(count(b) > 0 AS DOUBLE) AS norm, CAST(count(b) AS INTEGER) AS n_buckets,
           CAST(coalesce(arg_min(b, (-n, b)), 0) AS INTEGER) AS top_bucket
        FROM (SELECT event_id, b, count(*) AS n FROM (
                SELECT event_id, unnest(CASE WHEN len(tokens) = 0 THEN [NULL] ELSE list_transform(tokens,
                  lambda t: CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % {C.EMBEDDING_DIMENSION}) END) AS b
                FROM (SELECT event_id, regexp_extract_all(lower({normalise_log_sql('content')}), '[a-z0-9]+') AS tokens FROM _new))
              GROUP BY event_id, b) GROUP BY event_id""",
    "_nd AS (SELECT count(*) AS n FROM documents)", RAW_CTE)
ORACLE["ask_query_log"] = ask_q(
    f"""SELECT r.qid AS id, q.question AS query, r.answer, p.groundedness_score, p.relevance_score, q.latency_ms AS latency,
           q.asked_at AS created_at, md5({judge_prompt_expr('c.context', 'q.question', 'r.answer', 'j.expected_answer')}) AS judge_prompt_md5
        FROM _aresults r JOIN questions q USING (qid)
        LEFT JOIN (SELECT qid, list(content ORDER BY rank) AS context FROM _afinal GROUP BY qid) c USING (qid)
        LEFT JOIN judge_replies j ON j.id = r.qid LEFT JOIN parsed_judge p ON p.id = r.qid
        WHERE r.query_type <> 'analytical' AND r.window_start < r.window_end""",
    QLOG_CTE, parse_judge_sql())

# Pruning leaves the result as it is.
ORACLE["vector_topk_pruned"] = ORACLE["vector_topk"]
