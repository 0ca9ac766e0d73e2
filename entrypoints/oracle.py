"""DuckDB SQL giving the same results as the registered queries."""

from __future__ import annotations

from chatledger.rules import RULES, WHITE_SPACE, Rule
from entrypoints import inputs as I

ORACLE: dict[str, str] = {}


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# White space and letters as SQL expressions, free of control characters.
SPACES = "(" + " || ".join(f"chr({ord(c)})" for c in WHITE_SPACE) + ")"
SPACE_CLASS = "".join(f"\\x{{{ord(c):04X}}}" for c in WHITE_SPACE)
NL = "chr(10)"


def re2(rule: Rule) -> str:
    """The rule's regex for RE2, whose ``\\b`` is already ASCII."""
    spaces = "".join(f"\\x{{{ord(c):04X}}}" for c in WHITE_SPACE)
    out, in_class, escaped = "", False, False
    for ch in rule.regex:
        if escaped:
            escaped = False
            if ch == "s":
                out += spaces if in_class else f"[{spaces}]"
            elif ch == "S":
                out += "\\x{0000}-\\x{10FFFF}"
            else:
                out += "\\" + ch
        elif ch == "\\":
            escaped = True
        else:
            in_class = ch == "[" or (in_class and ch != "]")
            out += ch
    return ("(?i)" if rule.ignore_case else "") + out


def utf16(s: str) -> str:
    return f"(length({s}) + length(regexp_replace({s}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


def entropy(s: str) -> str:
    p = f"((length({s}) - length(replace({s}, ch, ''))) / {utf16(s)}::DOUBLE)"
    terms = f"list_transform(list_distinct(string_split({s}, '')), lambda ch: -{p} * log2({p}))"
    return f"round(CASE WHEN {s} = '' THEN 0.0 ELSE list_sum({terms}) END, 6)"


def sample_case(id_col: str) -> str:
    cases = " ".join(
        f"WHEN {k} THEN {lit(s).replace(chr(10), chr(39) + ' || chr(10) || ' + chr(39))}"
        for k, s in enumerate(I.SAMPLES)
    )
    return f"(CASE {id_col} % {I.PLANT_EVERY} {cases} END)"


def planted(table: str, id_col: str, text_col: str) -> str:
    return f"SELECT {id_col} AS id, concat_ws(' ', {text_col}, {sample_case(id_col)}) AS text FROM {table}"


def rule_matches(source: str, rules=RULES) -> str:
    """``id, rule_no, rule_id, rule_name, match_no, matched, redacted, entropy, pos``."""
    parts = []
    for number, rule in enumerate(rules, 1):
        pattern = lit(re2(rule))
        keep = "TRUE" if rule.min_entropy is None else f"bits >= {rule.min_entropy}"
        parts.append(
            f"""
SELECT id, {number} AS rule_no, {lit(rule.id)} AS rule_id, {lit(rule.name)} AS rule_name,
       row_number() OVER (PARTITION BY id ORDER BY i) AS match_no, matched,
       '[REDACTED:' || upper({lit(rule.id)}) || ']' AS redacted, bits AS entropy, pos
FROM (
  SELECT id, i, matched, {entropy('matched')} AS bits,
         (list_sum(list_transform(pieces[1:i], lambda s: {utf16('s')}))
          + coalesce(list_sum(list_transform(whole[1:i - 1], lambda s: {utf16('s')})), 0))::INTEGER AS pos
  FROM (
    SELECT id, whole, regexp_split_to_array(text, {pattern}) AS pieces,
           unnest(regexp_extract_all(text, {pattern}, {rule.group})) AS matched,
           generate_subscripts(regexp_extract_all(text, {pattern}, {rule.group}), 1) AS i
    FROM (SELECT id, text, regexp_extract_all(text, {pattern}, 0) AS whole FROM {source})
  )
) WHERE {keep}"""
        )
    return "\nUNION ALL\n".join(parts)


def redacted(source: str, matches: str = "matches") -> str:
    """``id, text, n_findings, sanitized`` for ``source(id, text)``."""
    step = "lambda a, b: {'m': replace(a.m, b.m, b.r), 'r': ''}"
    return f"""
SELECT s.id, s.text, coalesce(f.n, 0) AS n_findings,
       CASE WHEN f.n IS NULL THEN s.text
            ELSE list_reduce(list_prepend({{'m': s.text, 'r': ''}}, f.fs), {step}).m END AS sanitized
FROM {source} s LEFT JOIN (
  SELECT id, count(*) AS n, list({{'m': matched, 'r': redacted}} ORDER BY rule_no, match_no) AS fs
  FROM {matches} GROUP BY id
) f ON s.id = f.id"""


# --- scanning ----------------------------------------------------------------

DOCS = f"docs AS ({planted('documents', 'doc_id', 'text')}), matches AS ({rule_matches('docs')})"

ORACLE["scan_findings"] = f"""WITH {DOCS}
SELECT id AS doc_id, rule_id, rule_name, match_no, matched, redacted, entropy, pos FROM matches"""

ORACLE["scan_positions"] = f"WITH {DOCS} SELECT id AS doc_id, rule_id, match_no, pos FROM matches"

ORACLE["redact_text"] = f"""WITH {DOCS}, red AS ({redacted('docs')})
SELECT id AS doc_id, n_findings > 0 AS has_secrets, n_findings, sanitized FROM red"""
ORACLE["redact_stream"] = ORACLE["redact_text"]

ORACLE["findings_by_rule"] = f"""WITH {DOCS}
SELECT rule_id, count(*) AS n_findings, count(DISTINCT id) AS n_texts, round(avg(entropy), 6) AS mean_entropy
FROM matches GROUP BY rule_id"""

ORACLE["entropy_profile"] = f"""WITH docs AS ({planted('documents', 'doc_id', 'text')}),
tokens AS (SELECT token, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS token FROM docs) GROUP BY token)
SELECT token, n, {entropy('token')} AS entropy FROM tokens"""

ORACLE["high_entropy_candidates"] = f"""WITH docs AS ({planted('documents', 'doc_id', 'text')}),
tokens AS (SELECT id, unnest(regexp_split_to_array(text, '[{SPACE_CLASS}]+')) AS token FROM docs),
long AS (SELECT id, token FROM tokens WHERE {utf16('token')} >= 20 AND NOT regexp_full_match(token, '[a-zA-Z]+')),
measured AS (SELECT id, token, {entropy('token')} AS bits FROM long)
SELECT id AS doc_id, token, bits AS entropy FROM measured WHERE bits >= 4.2"""

ORACLE["rules_cross_scan"] = f"""WITH docs AS (SELECT doc_id AS id, text FROM documents),
matches AS ({rule_matches('docs', (I.USER_RULE,))})
SELECT id AS doc_id, rule_id, rule_name, match_no, matched, redacted, entropy, pos FROM matches"""

# A written text file ends with a newline, which no rule can match.
ORACLE["scan_files"] = f"""WITH docs AS ({planted('pages', 'page_id', 'html')}), matches AS ({rule_matches('docs')})
SELECT id AS page_id, rule_id, match_no, matched, entropy FROM matches"""

# --- requests ----------------------------------------------------------------

TURNS = f"""turns AS (
  SELECT conv_id, turn, role, conv_id * 1000 + turn AS id, conv_id % 10 = 5 AND turn = 0 AS is_parts,
    CASE WHEN turn = 1 THEN concat_ws(' ', text, {sample_case('conv_id')})
         WHEN turn = 0 AND conv_id % 10 = 7 THEN concat_ws(' ', '[note]', {sample_case('conv_id')}, text)
         WHEN turn = 0 THEN chr(9) || ' ' || text || chr(10) ELSE text END AS text
  FROM conversations)"""

SCANNED = f"""{TURNS},
turn_matches AS ({rule_matches('turns')}),
red AS ({redacted('turns', 'turn_matches')}),
scanned AS (
  SELECT t.*, r.n_findings, r.sanitized,
    CASE WHEN t.is_parts THEN '[{{"type":"text","text":' || to_json(r.sanitized)::VARCHAR
           || '}},{{"type":"image_url","image_url":{{"url":"u"}}}},' || {lit(I.NOTE_PART)} || ']' ELSE r.sanitized END AS content
  FROM turns t JOIN red r ON t.id = r.id)"""


def pick(n: int, *options: str, column: str = "conv_id") -> str:
    cases = " ".join(f"WHEN {k} THEN {o}" for k, o in enumerate(options))
    return f"(CASE {column} % {n} {cases} END)"


TOOLS = '[{"type":"function","b":1,"a":2}]'

PROFILE = f"""{SCANNED},
canon AS (
  SELECT conv_id, conv_id % 25 = 24 AS invalid_json, 'model-' || conv_id % 3 AS model,
    sum(n_findings)::BIGINT AS n_findings,
    greatest(1, ceil(sum({utf16('sanitized')} + CASE WHEN is_parts THEN 11 ELSE 0 END) / 4.0))::BIGINT AS est_tokens,
    '{{"model":"model-' || conv_id % 3 || '","messages":['
      || string_agg('{{"role":' || to_json(role)::VARCHAR || ',"content":'
           || to_json(CASE WHEN is_parts THEN content ELSE trim(content, {SPACES}) END)::VARCHAR
           || ',"name":null,"tool_call_id":null}}', ',' ORDER BY turn)
      || '],"temperature":' || CASE WHEN conv_id % 35 = 3 THEN 'null' ELSE {pick(5, "'0.7'", "'0.7'", "'1'", "'0.7'", "'0'")} END
      || ',"max_tokens":' || {pick(3, "'null'", "'256'", "'null'")}
      || ',"top_p":' || {pick(4, "'null'", "'0.9'", "'1'", "'null'")}
      || ',"tools":' || CASE WHEN conv_id % 6 = 0 THEN to_json({lit(TOOLS)})::VARCHAR ELSE 'null' END
      || ',"tool_choice":' || CASE WHEN conv_id % 6 = 0 THEN to_json('"auto"')::VARCHAR ELSE 'null' END
      || '}}' AS canonical
  FROM scanned GROUP BY conv_id)"""

ORACLE["redact_messages"] = f"""WITH {SCANNED}
SELECT conv_id, sum(n_findings) OVER (PARTITION BY conv_id)::INTEGER AS n_findings, turn::INTEGER AS pos, role, content
FROM scanned WHERE conv_id % 25 <> 24"""

ORACLE["policy_decision"] = f"""WITH {PROFILE}
SELECT conv_id, mode,
  CASE WHEN mode <> 'off' AND n_findings > 0 THEN mode ELSE 'pass' END AS action,
  CASE WHEN mode = 'block' AND n_findings > 0 THEN 403 ELSE 200 END AS status
FROM canon, (VALUES ('redact'), ('block'), ('off')) m(mode) WHERE NOT invalid_json"""

ORACLE["block_report"] = f"""WITH {SCANNED}
SELECT t.conv_id, row_number() OVER (PARTITION BY t.conv_id ORDER BY t.turn, m.rule_no, m.match_no)::INTEGER AS finding_no,
  m.rule_id AS type, m.rule_name AS description, substr(m.matched, 1, 4) || '****' AS matched
FROM turns t JOIN turn_matches m ON t.id = m.id WHERE t.conv_id % 25 <> 24"""

ORACLE["parse_requests"] = f"""WITH {TURNS}, c AS (
  SELECT conv_id, conv_id % 25 = 24 AS bad, count(*)::INTEGER AS n, count(*) FILTER (is_parts)::INTEGER AS parts
  FROM turns GROUP BY conv_id)
SELECT conv_id, bad AS invalid_json,
  CASE WHEN NOT bad THEN 'model-' || conv_id % 3 END AS model,
  CASE WHEN NOT bad THEN n END AS n_messages, CASE WHEN NOT bad THEN parts END AS n_multipart,
  NOT bad AND conv_id % 2 = 1 AS stream,
  CASE WHEN bad THEN NULL WHEN conv_id % 35 = 3 THEN 'hot' ELSE {pick(5, "NULL", "'0.7'", "'1'", "'0.704'", "NULL")} END AS temperature,
  NOT bad AND conv_id % 5 <> 0 AS temperature_present,
  CASE WHEN NOT bad THEN {pick(3, "NULL", "256.0", "0.0")} END::DOUBLE AS max_tokens,
  CASE WHEN NOT bad THEN {pick(4, "NULL", "0.9", "1.0", "NULL")} END::DOUBLE AS top_p,
  CASE WHEN NOT bad AND conv_id % 6 = 0 THEN {lit(TOOLS)} END AS tools,
  CASE WHEN NOT bad AND conv_id % 6 = 0 THEN 'auto' END AS tool_choice
FROM c"""

ORACLE["estimate_tokens"] = f"WITH {PROFILE} SELECT conv_id, est_tokens FROM canon WHERE NOT invalid_json"
ORACLE["canonical_request"] = f"WITH {PROFILE} SELECT conv_id, canonical FROM canon WHERE NOT invalid_json"
ORACLE["request_fingerprint"] = (
    f"WITH {PROFILE} SELECT conv_id, sha256(canonical) AS hash FROM canon WHERE NOT invalid_json"
)

# The request log, as in entrypoints.inputs.
LOG = """est AS (SELECT conv_id, ceil(sum(length(text)) / 4.0)::BIGINT AS est_tokens FROM conversations GROUP BY conv_id),
log AS (
  SELECT e.*, est.est_tokens, sha256(e.conv_id || '|' || e.model) AS hash,
    CASE WHEN upstream_error THEN 0 ELSE est.est_tokens + 25 END AS actual_tokens
  FROM (
    SELECT event_id AS request_id, ts, epoch_us(ts) // 1000 AS ms, 'client-' || user_id % 16 AS client_id,
      user_id AS session_id, user_id % (SELECT count(DISTINCT conv_id) FROM conversations) AS conv_id,
      event_type AS model, 25 AS completion_tokens, floor(value)::BIGINT AS latency_ms,
      event_type = 'error' AS upstream_error
    FROM events) e JOIN est ON e.conv_id = est.conv_id)"""

ORACLE["fingerprint_duplicates"] = f"""WITH {LOG}
SELECT hash, count(*) AS n_requests, min(ms) AS first_ms, max(ms) AS last_ms,
  (sum(est_tokens) - min(est_tokens))::BIGINT AS wasted_tokens
FROM log GROUP BY hash HAVING count(*) > 1"""

ORACLE["cost_estimate"] = f"""WITH {LOG}
SELECT model, round(sum(est_tokens / 1000.0::DOUBLE * 0.005::DOUBLE + 25 / 1000.0::DOUBLE * 0.015::DOUBLE), 6) AS cost_usd
FROM log GROUP BY model"""

ORACLE["client_key"] = """WITH r AS (
  SELECT CASE user_id % 3 WHEN 0 THEN '10.0.0.' || user_id % 16 WHEN 1 THEN '' END AS forwarded,
         CASE WHEN event_id % 2 = 0 THEN '10.1.0.' || user_id % 8 ELSE '' END AS peer FROM events)
SELECT coalesce(nullif(forwarded, ''), nullif(peer, ''), '127.0.0.1') AS client, count(*) AS n_requests
FROM r GROUP BY 1"""

# --- cache table -------------------------------------------------------------

CACHE = f"""{LOG},
cache AS (
  SELECT hash, model AS request_fingerprint, model, 'r-' || substr(hash, 1, 8) AS response_body,
    conv_id % 2 = 1 AS is_stream, est_tokens AS prompt_tokens, completion_tokens::BIGINT AS completion_tokens,
    ms AS created_at, ms AS last_accessed_at, conv_id % 4 AS hit_count,
    CASE WHEN conv_id % 5 = 0 THEN 0 ELSE {I.TTL_MS} END::BIGINT AS ttl_ms
  FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY request_id) AS rn FROM log) WHERE rn = 1),
req AS (SELECT request_id, hash, ms AS now_ms FROM log)"""


def live(now: str, c: str = "c") -> str:
    return f"({c}.ttl_ms <= 0 OR {now} - {c}.created_at <= {c}.ttl_ms)"


ORACLE["response_cache"] = f"WITH {CACHE} SELECT * FROM cache"

ORACLE["cache_lookup"] = f"""WITH {CACHE}
SELECT r.request_id, r.hash, r.now_ms, c.hash IS NOT NULL AS hit, c.response_body AS cached_response_body,
  c.prompt_tokens AS cached_prompt_tokens, c.completion_tokens AS cached_completion_tokens
FROM req r LEFT JOIN cache c ON r.hash = c.hash AND {live('r.now_ms')}"""

ORACLE["cache_lookup_tiered"] = f"""WITH {CACHE}, hot AS (SELECT * FROM cache WHERE prompt_tokens % 3 = 0)
SELECT r.request_id, r.hash, r.now_ms,
  CASE WHEN h.hash IS NOT NULL THEN 'L1' WHEN c.hash IS NOT NULL THEN 'L2' END AS tier,
  coalesce(h.prompt_tokens, c.prompt_tokens) AS cached_prompt_tokens,
  coalesce(h.completion_tokens, c.completion_tokens) AS cached_completion_tokens
FROM req r LEFT JOIN hot h ON r.hash = h.hash AND {live('r.now_ms', 'h')}
LEFT JOIN cache c ON r.hash = c.hash AND {live('r.now_ms')}"""

ORACLE["cache_misses"] = f"""WITH {CACHE}
SELECT * FROM req r WHERE NOT EXISTS (SELECT 1 FROM cache c WHERE c.hash = r.hash AND {live('r.now_ms')})"""

ORACLE["cache_hits_semi"] = f"""WITH {CACHE}
SELECT hash, created_at, ttl_ms FROM cache c
WHERE EXISTS (SELECT 1 FROM req r WHERE c.hash = r.hash AND {live(f'(r.now_ms + {I.TTL_MS})')})"""

ORACLE["cache_upsert"] = f"""WITH {CACHE},
every AS (
  SELECT 0 AS fresh, * FROM cache
  UNION ALL BY NAME
  SELECT 1 AS fresh, * REPLACE (created_at + 1000 AS created_at, created_at + 1000 AS last_accessed_at,
    'newer' AS response_body, 0 AS hit_count) FROM cache WHERE prompt_tokens % 2 = 0
  UNION ALL BY NAME
  SELECT 1 AS fresh, * REPLACE (sha256(hash) AS hash, 'other' AS response_body, created_at AS last_accessed_at,
    0 AS hit_count) FROM cache)
SELECT * EXCLUDE (fresh, rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY hash ORDER BY created_at DESC, fresh DESC) AS rn FROM every) WHERE rn = 1"""

ORACLE["response_cache_versions"] = f"""WITH {CACHE},
every AS (
  SELECT 0 AS fresh, * FROM cache
  UNION ALL BY NAME
  SELECT 1 AS fresh, * REPLACE (created_at + 1000 AS created_at, created_at + 1000 AS last_accessed_at,
    'newer' AS response_body, 0 AS hit_count) FROM cache WHERE prompt_tokens % 2 = 0
  UNION ALL BY NAME
  SELECT 1 AS fresh, * REPLACE (sha256(hash) AS hash, 'other' AS response_body, created_at AS last_accessed_at,
    0 AS hit_count) FROM cache),
newest AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY created_at DESC, fresh DESC) AS rn FROM every),
batch AS (SELECT hash, count(*) AS n, max(now_ms) AS last FROM req WHERE request_id % 3 > 0 GROUP BY hash)
SELECT c.* EXCLUDE (fresh, rn) REPLACE (
  c.hit_count + coalesce(b.n, 0) AS hit_count, coalesce(b.last, c.last_accessed_at) AS last_accessed_at)
FROM newest c LEFT JOIN batch b ON c.hash = b.hash
WHERE rn = 1 AND {live('(SELECT max(ms) FROM log)')}
  AND c.hash NOT IN (SELECT hash FROM log WHERE upstream_error AND request_id % 5 = 0)"""

ORACLE["cache_touch"] = f"""WITH {CACHE}, batch AS (
  SELECT hash, count(*) AS n, max(now_ms) AS last FROM req WHERE request_id % 3 > 0 GROUP BY hash)
SELECT c.hash, c.hit_count + coalesce(b.n, 0) AS hit_count, coalesce(b.last, c.last_accessed_at) AS last_accessed_at
FROM cache c LEFT JOIN batch b ON c.hash = b.hash"""

ORACLE["cache_evict"] = f"""WITH {CACHE}
SELECT hash, model, created_at FROM cache WHERE hash NOT IN (SELECT hash FROM log WHERE upstream_error)"""

ORACLE["cache_prune_expired"] = f"""WITH {CACHE}
SELECT hash, created_at, ttl_ms FROM cache c WHERE {live('(SELECT max(ms) FROM log)')}"""

ORACLE["hot_set_topk"] = f"""WITH {CACHE}
SELECT hash, now_ms AS last_used_ms FROM (
  SELECT *, row_number() OVER (PARTITION BY hash ORDER BY now_ms DESC, request_id DESC) AS rn FROM req) WHERE rn = 1
ORDER BY now_ms DESC, request_id DESC LIMIT 50"""

STATS = """SELECT count(*) AS total_entries, coalesce(sum(hit_count), 0)::BIGINT AS total_hits,
  coalesce(sum(hit_count * (prompt_tokens + completion_tokens)), 0)::BIGINT AS tokens_saved FROM cache"""
ORACLE["cache_stats"] = f"WITH {CACHE} {STATS}"
ORACLE["cache_savings"] = f"""WITH {CACHE}, s AS ({STATS})
SELECT *, round(tokens_saved / 1000.0::DOUBLE * 0.005::DOUBLE, 6) AS usd_saved FROM s"""

# --- folds -------------------------------------------------------------------

CAPACITY = float(max(1, int(I.LIMIT["rpm"] * I.LIMIT["burst"] + 0.5)))
RATE = f"({I.LIMIT['rpm']}::DOUBLE / 60000)"


def bucket(source: str) -> str:
    """CTEs ending in ``rated(request_id, allowed, remaining, reset_ms, retry_after_s)``."""
    refilled = f"least({CAPACITY}::DOUBLE, b.left_over + (q.ms - b.ms) * {RATE})"
    return f"""
queue AS (SELECT request_id, client_id, ms, row_number() OVER (PARTITION BY client_id ORDER BY ms, request_id) AS n FROM {source}),
bucket(client_id, n, request_id, ms, tokens, left_over) AS (
  SELECT client_id, n, request_id, ms, {CAPACITY}::DOUBLE, {CAPACITY}::DOUBLE - 1 FROM queue WHERE n = 1
  UNION ALL
  SELECT q.client_id, q.n, q.request_id, q.ms, {refilled},
    CASE WHEN {refilled} >= 1 THEN {refilled} - 1 ELSE {refilled} END
  FROM bucket b JOIN queue q ON q.client_id = b.client_id AND q.n = b.n + 1),
answered AS (
  SELECT request_id, tokens >= 1 AS allowed,
    CASE WHEN tokens >= 1 THEN floor(left_over) ELSE 0 END::BIGINT AS remaining,
    CASE WHEN tokens >= 1 THEN 0 ELSE ceil((1 - tokens) / {RATE}) END::BIGINT AS reset_ms
  FROM bucket),
rated AS (SELECT *, ceil(reset_ms / 1000.0)::BIGINT AS retry_after_s FROM answered)"""


ORACLE["rate_limit_audit"] = f"WITH RECURSIVE {LOG}, {bucket('log')} SELECT * FROM rated"
ORACLE["rate_limit_stream"] = ORACLE["rate_limit_audit"]

ORACLE["idle_buckets"] = f"""WITH {LOG}, l AS (SELECT session_id, max(ms) AS last_ms FROM log GROUP BY session_id)
SELECT session_id, last_ms, (SELECT max(ms) FROM log) - last_ms AS idle_ms FROM l
WHERE (SELECT max(ms) FROM log) - last_ms > 300000"""


def cached(source: str, ttl_ms: int = I.TTL_MS) -> str:
    """CTEs ending in ``hits(request_id, is_hit, stored_ms, stored_by)``."""
    is_live = f"(h.stored IS NOT NULL AND ({ttl_ms} <= 0 OR q.ms - h.stored <= {ttl_ms}))"

    def after(old: str, new: str) -> str:
        return f"CASE WHEN {is_live} THEN {old} WHEN NOT q.upstream_error THEN {new} END"

    return f"""
asked AS (SELECT request_id, hash, ms, upstream_error, row_number() OVER (PARTITION BY hash ORDER BY ms, request_id) AS n FROM {source}),
entry(hash, n, request_id, is_hit, used, used_by, stored, stored_id) AS (
  SELECT hash, n, request_id, FALSE, NULL::BIGINT, NULL::BIGINT,
    CASE WHEN NOT upstream_error THEN ms END, CASE WHEN NOT upstream_error THEN request_id END
  FROM asked WHERE n = 1
  UNION ALL
  SELECT q.hash, q.n, q.request_id, {is_live}, CASE WHEN {is_live} THEN h.stored END,
    CASE WHEN {is_live} THEN h.stored_id END, {after('h.stored', 'q.ms')}, {after('h.stored_id', 'q.request_id')}
  FROM entry h JOIN asked q ON q.hash = h.hash AND q.n = h.n + 1),
hits AS (SELECT request_id, is_hit, used AS stored_ms, used_by AS stored_by FROM entry)"""


ORACLE["cache_attribution"] = f"""WITH RECURSIVE {LOG}, {cached('log')}
SELECT request_id, is_hit, stored_ms FROM hits"""
ORACLE["cache_attribution_stream"] = ORACLE["cache_attribution"]

S, D = I.SESSION_BUDGET, I.DAILY_BUDGET


def over(s: str, d: str) -> str:
    return f"CASE WHEN {s} + q.est_tokens > {S} THEN 'session' WHEN {d} + q.est_tokens > {D} THEN 'daily' END"


DAY_USED = "(CASE WHEN q.day = g.day THEN g.d_after ELSE 0 END)"
ORACLE["budget_guard"] = f"""WITH RECURSIVE {LOG},
q AS (SELECT request_id, session_id, ms // 86400000 AS day, est_tokens, actual_tokens,
  row_number() OVER (PARTITION BY session_id ORDER BY ms, request_id) AS n FROM log),
guard(session_id, n, request_id, day, blocked_by, s_before, d_before, s_after, d_after) AS (
  SELECT session_id, n, request_id, day, {over('0', '0')}, 0::BIGINT, 0::BIGINT,
    CASE WHEN {over('0', '0')} IS NULL THEN actual_tokens ELSE 0 END::BIGINT,
    CASE WHEN {over('0', '0')} IS NULL THEN actual_tokens ELSE 0 END::BIGINT
  FROM q WHERE n = 1
  UNION ALL
  SELECT q.session_id, q.n, q.request_id, q.day, {over('g.s_after', DAY_USED)}, g.s_after, {DAY_USED},
    g.s_after + CASE WHEN {over('g.s_after', DAY_USED)} IS NULL THEN q.actual_tokens ELSE 0 END,
    {DAY_USED} + CASE WHEN {over('g.s_after', DAY_USED)} IS NULL THEN q.actual_tokens ELSE 0 END
  FROM guard g JOIN q ON q.session_id = g.session_id AND q.n = g.n + 1)
SELECT request_id, blocked_by IS NULL AS allowed, blocked_by, s_before AS session_used_before,
  d_before AS daily_used_before FROM guard"""
ORACLE["budget_guard_stream"] = ORACLE["budget_guard"]

ORACLE["budget_usage"] = f"""WITH {LOG}
SELECT 'session' AS scope, session_id::VARCHAR AS key, sum(actual_tokens)::BIGINT AS used,
  greatest(0, {S} - sum(actual_tokens))::BIGINT AS remaining FROM log GROUP BY session_id
UNION ALL
SELECT 'day', strftime(ts, '%Y-%m-%d'), sum(actual_tokens)::BIGINT, NULL::BIGINT FROM log GROUP BY 2"""

# --- metrics -----------------------------------------------------------------

OUTCOMES = f"""{LOG},
outcomes AS (
  SELECT request_id, ms, client_id, model,
    CASE WHEN model IN ('click', 'view') THEN 'hit' WHEN model = 'purchase' THEN 'miss'
         WHEN model = 'error' THEN 'upstream_error'
         ELSE {pick(4, "'rate_limited'", "'invalid_json'", "'secret_blocked'", "'budget_blocked'", column='request_id')}
    END AS outcome,
    CASE model WHEN 'click' THEN 'L1' WHEN 'view' THEN 'L2' END AS cache_tier,
    request_id % 3 AS n_findings, est_tokens AS prompt_tokens, completion_tokens, latency_ms FROM log)"""

COUNTERS = {
    "total_requests": "1",
    "cache_hits_l1": "CASE WHEN outcome = 'hit' AND cache_tier = 'L1' THEN 1 ELSE 0 END",
    "cache_hits_l2": "CASE WHEN outcome = 'hit' AND cache_tier = 'L2' THEN 1 ELSE 0 END",
    "cache_misses": "CASE WHEN outcome = 'miss' THEN 1 ELSE 0 END",
    "upstream_errors": "CASE WHEN outcome = 'upstream_error' THEN 1 ELSE 0 END",
    "blocked_requests": "CASE WHEN outcome IN ('secret_blocked', 'budget_blocked') THEN 1 ELSE 0 END",
    "redacted_secrets": "n_findings",
    "total_prompt_tokens": "CASE WHEN outcome = 'miss' THEN prompt_tokens ELSE 0 END",
    "total_completion_tokens": "CASE WHEN outcome = 'miss' THEN completion_tokens ELSE 0 END",
    "tokens_saved": "CASE WHEN outcome = 'hit' THEN prompt_tokens + completion_tokens ELSE 0 END",
}
USD = "CASE WHEN outcome = 'hit' THEN prompt_tokens / 1000.0::DOUBLE * 0.005::DOUBLE + completion_tokens / 1000.0::DOUBLE * 0.015::DOUBLE ELSE 0 END"


def totals(window: str = "", places: int = 6) -> str:
    sums = [f"(sum({c}){window})::BIGINT AS {n}" for n, c in COUNTERS.items()]
    return ", ".join([*sums, f"round(sum({USD}){window}, {places}) AS usd_saved"])


ORACLE["usage_metrics"] = f"WITH {OUTCOMES} SELECT client_id, {totals()} FROM outcomes GROUP BY client_id"
ORACLE["usage_metrics_stream"] = ORACLE["usage_metrics"]

ORACLE["kpi_rollup"] = f"""WITH {OUTCOMES}, t AS (SELECT {totals()} FROM outcomes)
SELECT 3600::BIGINT AS uptime_s, total_requests,
  CASE WHEN total_requests > 0 THEN round((cache_hits_l1 + cache_hits_l2) / total_requests * 100, 1) ELSE 0 END AS hit_rate_pct,
  cache_hits_l1, cache_hits_l2, cache_misses, tokens_saved, round(round(usd_saved, 8), 4) AS usd_saved, redacted_secrets FROM t"""

ORACLE["metric_samples"] = f"""WITH {OUTCOMES}, t AS (SELECT {totals()} FROM outcomes)
SELECT 'prompts_requests_total' AS name, 'counter' AS type, '' AS labels, total_requests::DOUBLE AS value FROM t
UNION ALL SELECT 'prompts_cache_hits_total', 'counter', 'tier="L1"', cache_hits_l1 FROM t
UNION ALL SELECT 'prompts_cache_hits_total', 'counter', 'tier="L2"', cache_hits_l2 FROM t
UNION ALL SELECT 'prompts_cache_misses_total', 'counter', '', cache_misses FROM t
UNION ALL SELECT 'prompts_tokens_saved_total', 'counter', '', tokens_saved FROM t
UNION ALL SELECT 'prompts_cost_saved_usd', 'gauge', '', round(round(usd_saved, 8), 4) FROM t
UNION ALL SELECT 'prompts_secrets_redacted_total', 'counter', '', redacted_secrets FROM t"""

ORACLE["rolling_latency"] = f"""WITH {OUTCOMES}
SELECT client_id, ms, request_id, outcome = 'hit' AS is_hit,
  floor(avg(latency_ms) OVER (PARTITION BY client_id, outcome ORDER BY ms, request_id
    ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) + 0.5)::BIGINT AS avg_latency_ms
FROM outcomes WHERE outcome IN ('hit', 'miss')"""

ORACLE["running_usage"] = f"""WITH {LOG}, r AS (
  SELECT request_id, actual_tokens, sum(actual_tokens) OVER (PARTITION BY session_id ORDER BY ms, request_id
    ROWS UNBOUNDED PRECEDING)::BIGINT AS used_after FROM log)
SELECT request_id, used_after - actual_tokens AS used_before, used_after FROM r"""

RUNNING = " OVER (PARTITION BY client_id ORDER BY ms, request_id ROWS UNBOUNDED PRECEDING)"
ORACLE["running_counters"] = f"""WITH {OUTCOMES}
SELECT client_id, ms, request_id, {totals(RUNNING)} FROM outcomes"""

# --- event streams -----------------------------------------------------------

SAID = "said AS (SELECT conv_id * 100 + turn AS sid, text FROM conversations WHERE role = 'assistant')"

SSE_HEAD = """'data: {"id":"chatcmpl-' || sid || '","object":"chat.completion.chunk","created":1700000000,"model":"model-'
    || sid % 3 || '","choices":[{"index":0,"delta":'"""
SSE_TEXT = f"""{SAID}, raw AS (
  SELECT sid, ': comment' || {NL} || {NL}
    || array_to_string(list_transform(string_split(text, ' '), lambda w: {SSE_HEAD} || '{{"content":'
         || to_json(w || ' ')::VARCHAR || '}},"finish_reason":null}}]}}' || {NL} || {NL}), '')
    || CASE WHEN sid % 7 = 0 THEN 'data: {{"id":"broken","mod' || {NL} || {NL} ELSE '' END
    || {SSE_HEAD} || '{{}},"finish_reason":"length"}}]'
    || CASE WHEN sid % 3 = 0 THEN ',"usage":{{"prompt_tokens":11,"completion_tokens":7}}}}' ELSE '}}' END || {NL} || {NL}
    || CASE WHEN sid % 11 = 0 THEN '' ELSE 'data: [DONE]' || {NL} || {NL} END AS text
  FROM said)"""

ORACLE["sse_lines"] = f"""WITH {SSE_TEXT}, lines AS (
  SELECT sid, unnest(string_split(text, {NL})) AS line, generate_subscripts(string_split(text, {NL}), 1) - 1 AS seq FROM raw)
SELECT sid AS stream_id, seq, trim(line, {SPACES}) AS line FROM lines WHERE starts_with(trim(line, {SPACES}), 'data:')"""

ORACLE["sse_reassemble"] = f"""WITH {SAID}
SELECT sid AS stream_id, 'chatcmpl-' || sid AS response_id, 'model-' || sid % 3 AS model, text || ' ' AS content,
  'length' AS finish_reason, CASE WHEN sid % 3 = 0 THEN 11 ELSE 0 END AS prompt_tokens,
  CASE WHEN sid % 3 = 0 THEN 7 ELSE greatest(1, ceil({utf16("(text || ' ')")} / 4.0)) END::BIGINT AS completion_tokens
FROM said WHERE sid % 11 <> 0"""
ORACLE["sse_reassemble_stream"] = ORACLE["sse_reassemble"]

RESPONSES = f"""{SAID}, responses AS (
  SELECT sid, text, '{{"id":"chatcmpl-' || sid || '","object":"chat.completion","created":1700000000,"model":"model-'
    || sid % 3 || '","choices":[{{"index":0,"message":{{"role":"assistant","content":' || to_json(text)::VARCHAR
    || '}},"finish_reason":"stop"}}]'
    || CASE sid % 3 WHEN 0 THEN ',"usage":{{"prompt_tokens":11,"completion_tokens":7,"total_tokens":18}}}}'
         WHEN 1 THEN ',"usage":{{"prompt_tokens":0,"completion_tokens":0,"total_tokens":0}}}}' ELSE '}}' END AS response
  FROM said)"""

ORACLE["usage_resolve"] = f"""WITH {RESPONSES}
SELECT sid AS stream_id, CASE WHEN sid % 3 = 0 THEN 11 ELSE sid % 50 + 1 END AS prompt_tokens,
  CASE WHEN sid % 3 = 0 THEN 7 WHEN sid % 2 = 1 THEN greatest(1, ceil({utf16('text')} / 4.0))
       ELSE ceil({utf16('response')} / 4.0) END::BIGINT AS completion_tokens
FROM responses"""

ORACLE["sse_replay"] = f"""WITH {SAID}, lines AS (
  SELECT sid, unnest([
    {SSE_HEAD} || '{{"role":"assistant"}},"finish_reason":null}}]}}',
    {SSE_HEAD} || '{{"content":' || to_json(text)::VARCHAR || '}},"finish_reason":null}}]}}',
    {SSE_HEAD} || '{{}},"finish_reason":"stop"}}]}}', 'data: [DONE]']) AS line, unnest([0, 1, 2, 3]) AS seq FROM said)
SELECT sid AS stream_id, seq, line FROM lines"""

# --- whole log ---------------------------------------------------------------


def guarded(source: str) -> str:
    """CTEs ending in ``hits(request_id, ok, is_hit, stored_by)``: budgets and a cache for each
    session, a request at a time; the state holds the session's entries."""
    today = "CASE WHEN g.day = q.day THEN g.d_used ELSE 0 END"
    ok = f"NOT (g.s_used + q.est_tokens > {I.SESSION_BUDGET} OR {today} + q.est_tokens > {I.DAILY_BUDGET})"
    live = f"list_filter(g.entries, lambda e: e.h = q.hash AND q.ms - e.t <= {I.TTL_MS})[1]"
    charged = f"({ok} AND NOT q.upstream_error AND {live} IS NULL)"
    pay = f"CASE WHEN {charged} THEN q.est_tokens + q.completion_tokens ELSE 0 END"
    return f"""
asked AS (
  SELECT *, ms // 86400000 AS day, row_number() OVER (PARTITION BY session_id ORDER BY ms, request_id) AS n FROM {source}),
guard(session_id, n, request_id, ok, is_hit, stored_by, day, s_used, d_used, entries) AS (
  SELECT DISTINCT session_id, 0::BIGINT, NULL::BIGINT, TRUE, FALSE, NULL::BIGINT, -1::BIGINT, 0::HUGEINT, 0::HUGEINT,
    []::STRUCT(h VARCHAR, t BIGINT, r BIGINT)[] FROM asked
  UNION ALL
  SELECT q.session_id, q.n, q.request_id, {ok}, {ok} AND {live} IS NOT NULL, CASE WHEN {ok} THEN {live}.r END,
    q.day, g.s_used + {pay}, {today} + {pay},
    CASE WHEN {charged} THEN list_append(list_filter(g.entries, lambda e: e.h <> q.hash),
      struct_pack(h := q.hash, t := q.ms, r := q.request_id)) ELSE g.entries END
  FROM guard g JOIN asked q ON q.session_id = g.session_id AND q.n = g.n + 1),
hits AS (SELECT request_id, ok, is_hit, stored_by FROM guard WHERE n > 0)"""


def outcome_ctes(mode: str, budgets: bool = False) -> str:
    """CTEs ending in ``done``: the outcome rows."""
    over = "WHEN NOT h.ok THEN 'budget_blocked'" if budgets else ""
    blocked = "n_findings > 0" if mode == "block" else "FALSE"
    return f"""{LOG}, {PROFILE},
profile AS (
  SELECT l.request_id, l.ms, l.client_id, l.session_id, l.completion_tokens, l.latency_ms, l.upstream_error,
    c.invalid_json, CASE WHEN NOT c.invalid_json THEN c.model END AS model, c.n_findings, c.est_tokens,
    sha256(c.canonical) AS hash
  FROM log l JOIN canon c ON l.conv_id = c.conv_id),
{bucket('log')},
early AS (
  SELECT p.*, CASE WHEN NOT r.allowed THEN 'rate_limited' WHEN invalid_json THEN 'invalid_json'
    WHEN {blocked} THEN 'secret_blocked' END AS stop
  FROM profile p JOIN rated r ON p.request_id = r.request_id),
open AS (SELECT * FROM early WHERE stop IS NULL),
{guarded('open') if budgets else cached('open')},
told AS (
  SELECT e.*, h.is_hit, coalesce(e.stop, CASE {over} WHEN h.is_hit THEN 'hit' WHEN e.upstream_error THEN 'upstream_error' ELSE 'miss' END) AS outcome,
    o.est_tokens AS o_prompt, o.completion_tokens AS o_completion
  FROM early e LEFT JOIN hits h ON e.request_id = h.request_id LEFT JOIN open o ON h.stored_by = o.request_id),
done AS (
  SELECT request_id, ms, client_id, session_id, model, outcome,
    CASE outcome WHEN 'rate_limited' THEN 429 WHEN 'budget_blocked' THEN 429 WHEN 'invalid_json' THEN 400 WHEN 'secret_blocked' THEN 403
      WHEN 'upstream_error' THEN 502 ELSE 200 END AS status,
    outcome = 'hit' AS is_cache_hit, CASE WHEN outcome = 'hit' THEN 'L1' END AS cache_tier,
    CASE WHEN outcome IN ('rate_limited', 'invalid_json') THEN 0 ELSE n_findings END AS n_findings,
    CASE outcome WHEN 'hit' THEN o_prompt WHEN 'miss' THEN est_tokens ELSE 0 END AS prompt_tokens,
    CASE outcome WHEN 'hit' THEN o_completion WHEN 'miss' THEN completion_tokens ELSE 0 END::BIGINT AS completion_tokens,
    CASE WHEN outcome = 'miss' THEN round(est_tokens / 1000.0::DOUBLE * 0.005::DOUBLE + completion_tokens / 1000.0::DOUBLE * 0.015::DOUBLE, 6) ELSE 0 END AS cost_usd,
    latency_ms
  FROM told)"""


ORACLE["request_outcomes"] = f"WITH RECURSIVE {outcome_ctes('redact')} SELECT * FROM done"
ORACLE["request_outcomes_budgets"] = f"WITH RECURSIVE {outcome_ctes('redact', budgets=True)} SELECT * FROM done"
ORACLE["request_outcomes_block"] = f"WITH RECURSIVE {outcome_ctes('block')} SELECT * FROM done"

ORACLE["audit_log"] = f"""WITH RECURSIVE {outcome_ctes('redact')}
SELECT ms AS timestamp, client_id AS client_ip, model, is_cache_hit, cache_tier, n_findings AS secrets_redacted,
  prompt_tokens, completion_tokens, latency_ms, status AS status_code FROM done"""
ORACLE["audit_append"] = ORACLE["audit_log"]

ORACLE["audit_append_stream"] = f"""WITH {OUTCOMES}
SELECT ms AS timestamp, client_id AS client_ip, model, outcome = 'hit' AS is_cache_hit, cache_tier,
  n_findings AS secrets_redacted, prompt_tokens, completion_tokens, latency_ms,
  CASE WHEN outcome IN ('rate_limited', 'budget_blocked') THEN 429 WHEN outcome = 'invalid_json' THEN 400
    WHEN outcome = 'secret_blocked' THEN 403 WHEN outcome = 'upstream_error' THEN 502 ELSE 200 END AS status_code
FROM outcomes"""

ORACLE["usage_report"] = f"""WITH RECURSIVE {outcome_ctes('redact')},
t AS (SELECT client_id, {totals()} FROM done GROUP BY client_id)
SELECT *, round((cache_hits_l1 + cache_hits_l2) / total_requests * 100, 1) AS hit_rate_pct FROM t"""
