"""The SQL that checks each query: the same views and results written for another engine."""

from __future__ import annotations

from postaudit import schema as S
from postaudit.fixtures import BLOCKED, PREFIXES
from postaudit.functions import prompts as P


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _any(phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(text), {_text(p)})" for p in phrases) + ")"


_PREFIX = "CASE doc_id % 20 " + " ".join(f"WHEN {n} THEN {_text(p)}" for n, p in PREFIXES.items()) + " ELSE '' END"
_JOB = "CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id // 20 END"
_AT = "TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id)"
_BLOCKED_RANK = "CASE " + " ".join(
    f"WHEN contains(lower(text), lower({_text(p)})) THEN {n}" for n, p in enumerate(BLOCKED) if p) + " END"
_BLOCKED_NAME = f"list_extract([{', '.join(_text(p) for p in BLOCKED)}], ({_BLOCKED_RANK}) + 1)"

# White space by Unicode property, spelled for RE2.
_REPOST = r"regexp_matches(text, '^[\t-\r\x{85}\p{Z}]*RT @')"

_VIEWS = f"""
docs AS (
  SELECT *, {_JOB} AS k, 'job-' || ({_JOB}) AS job_id, CAST(doc_id AS VARCHAR) AS tweet_id,
         {_AT} AS created_at, doc_id AS pos, doc_id // 20 AS part, text AS body FROM documents),
posts AS (
  SELECT job_id, tweet_id, {_PREFIX} || text AS text, created_at, pos, part, k, lang, source, doc_id FROM docs),
originals AS (SELECT * FROM posts WHERE NOT {_REPOST}),
jobs_text AS (
  SELECT DISTINCT job_id, k, CASE k % 5
    WHEN 0 THEN '{{"criteria": {{"forbidden_words": ["crypto", "w' || k || '"], "professional_check": true, "tone": "calm", "exclude_politics": true, "exclude_threats": true}}}}'
    WHEN 1 THEN '{{"forbidden_words": [], "tone": "", "exclude_profanity": true}}'
    WHEN 3 THEN '{{"forbidden_words": ['
    WHEN 4 THEN '{{"professional_check": "yes"}}' END AS t FROM docs),
jobs_json AS (
  SELECT job_id, k, CASE WHEN json_valid(t) THEN coalesce(json_extract(t, '$.criteria'), CAST(t AS JSON)) END AS c
  FROM jobs_text),
jobs AS (
  SELECT job_id, k,
    c IS NOT NULL AND coalesce(json_type(c, '$.professional_check'), 'BOOLEAN') = 'BOOLEAN' AS own,
    coalesce(list_aggregate(json_extract_string(c, '$.forbidden_words[*]'), 'string_agg', '|'), '') AS forbidden_words,
    coalesce(json_extract_string(c, '$.tone'), '') AS tone,
    coalesce(json_extract_string(c, '$.professional_check') = 'true', false) AS professional_check,
    coalesce(json_extract_string(c, '$.exclude_politics') = 'true', false) AS exclude_politics,
    coalesce(json_extract_string(c, '$.exclude_profanity') = 'true', false) AS exclude_profanity,
    coalesce(json_extract_string(c, '$.exclude_threats') = 'true', false) AS exclude_threats,
    coalesce(json_extract_string(c, '$.exclude_hate_speech') = 'true', false) AS exclude_hate_speech,
    coalesce(json_extract_string(c, '$.exclude_harassment') = 'true', false) AS exclude_harassment
  FROM jobs_json),
criteria AS (
  SELECT job_id, own,
    CASE WHEN own THEN forbidden_words ELSE '' END AS forbidden_words,
    CASE WHEN own THEN tone ELSE 'respectful and thoughtful' END AS tone,
    own AND professional_check AS professional_check,
    own AND exclude_politics AS exclude_politics,
    NOT own OR exclude_profanity AS exclude_profanity,
    NOT own OR exclude_threats AS exclude_threats,
    NOT own OR exclude_hate_speech AS exclude_hate_speech,
    NOT own OR exclude_harassment AS exclude_harassment
  FROM jobs),
hits AS (
  SELECT *, {_any(S.RULE_ABUSIVE)} AS abusive, {_any(S.RULE_HATE)} AS hate, {_any(S.RULE_THREAT)} AS threat
  FROM originals),
rules AS (
  SELECT *, abusive OR hate OR threat AS should_flag,
    CASE WHEN threat THEN 0.95 WHEN hate THEN 0.9 WHEN abusive THEN 0.85 ELSE 0.0 END::DOUBLE AS score,
    CASE WHEN threat THEN {_text(S.REASON_RULE_THREAT)} WHEN hate THEN {_text(S.REASON_RULE_HATE)}
         WHEN abusive THEN {_text(S.REASON_RULE_ABUSIVE)} ELSE {_text(S.REASON_CLEAN)} END AS reason,
    concat_ws('|', CASE WHEN abusive THEN 'abusive' END, CASE WHEN hate THEN 'hate_speech' END,
              CASE WHEN threat THEN 'threatening' END) AS labels
  FROM hits),
cascade AS (
  SELECT job_id, tweet_id, filter_reason,
    CASE WHEN filter_reason = 'hate_speech' THEN 0.95 ELSE 1.0 END::DOUBLE AS score,
    CASE filter_reason WHEN 'blocked_phrase' THEN {_text(S.REASON_BLOCKED)} || phrase
      WHEN 'threat' THEN {_text(S.REASON_CASCADE_THREAT)} ELSE {_text(S.REASON_CASCADE_HATE)} END AS reason
  FROM (SELECT job_id, tweet_id, {_BLOCKED_NAME} AS phrase,
          CASE WHEN ({_BLOCKED_RANK}) IS NOT NULL THEN 'blocked_phrase'
               WHEN {_any(S.CASCADE_THREAT)} THEN 'threat'
               WHEN {_any(S.CASCADE_HATE)} THEN 'hate_speech' END AS filter_reason FROM originals)
  WHERE filter_reason IS NOT NULL),
gated AS (SELECT cascade.* FROM cascade JOIN jobs USING (job_id) WHERE own),
flags AS (
  SELECT job_id, tweet_id, filter_reason, score, reason FROM gated
  UNION ALL
  SELECT job_id, tweet_id, 'llm_scorer', score, reason FROM rules
  WHERE should_flag AND tweet_id NOT IN (SELECT tweet_id FROM gated)),
flagged AS (
  SELECT md5(f.job_id || '_' || f.tweet_id || '_' || filter_reason) AS id, f.tweet_id, f.job_id,
    created_at + INTERVAL 1 DAY AS flagged_at, score, reason, filter_reason,
    CASE WHEN doc_id % 17 = 0 THEN '' ELSE '{S.POST_URL_BASE}' || f.tweet_id END AS url
  FROM flags f JOIN originals USING (tweet_id)),
scored AS (
  SELECT job_id, tweet_id, TIMESTAMP '2024-01-01' + doc_id * INTERVAL 7 MINUTE AS scored_at
  FROM docs JOIN labels USING (doc_id)),
state AS (
  SELECT o.job_id, o.tweet_id, o.created_at, o.pos, g.tweet_id IS NULL AS needs_scoring,
    g.tweet_id IS NOT NULL OR s.tweet_id IS NOT NULL AS processed,
    g.tweet_id IS NOT NULL OR r.should_flag AS should_flag
  FROM originals o LEFT JOIN gated g USING (tweet_id) LEFT JOIN scored s USING (tweet_id)
  JOIN rules r USING (tweet_id)),
waiting AS (SELECT * FROM state WHERE needs_scoring AND NOT processed),
admission AS (
  SELECT job_id, tweet_id, row_number() OVER (ORDER BY created_at, pos, job_id, tweet_id) <= greatest(
    600 - (SELECT count(*) FROM scored WHERE CAST(scored_at AS DATE) = DATE '2024-01-01'), 0) AS admitted
  FROM waiting),
progress AS (
  SELECT job_id, count(*) AS total, count(*) FILTER (processed) AS processed,
    count(*) FILTER (needs_scoring AND processed) AS calls,
    count(*) FILTER (processed AND should_flag) AS flagged FROM state GROUP BY job_id),
raws AS (
  SELECT job_id, part, row_number() OVER (PARTITION BY job_id, part ORDER BY pos) - 1 AS pos, tweet_id, text,
    CASE WHEN doc_id % 13 = 5 THEN TIMESTAMP '2025-01-01 00:00:00' ELSE created_at END AS created_at,
    doc_id % 13 <> 5 AS created_at_ok,
    CASE WHEN doc_id % 6 = 0 THEN '' ELSE 'https://example.com/' || doc_id || '|https://t.co/b' || doc_id END AS links,
    CASE WHEN doc_id % 6 = 0 OR lang = '' THEN '' ELSE '#' || lang END AS hashtags,
    CASE WHEN doc_id % 6 = 0 OR source = '' THEN '' ELSE '@' || source END AS mentions,
    CASE WHEN doc_id % 6 <> 0 AND doc_id % 2 = 0 THEN 'https://example.com/' || doc_id || '.jpg' ELSE '' END
      AS attachments
  FROM posts),
files AS (SELECT DISTINCT job_id || '/' || part AS path, part, job_id FROM posts),
updates AS (
  SELECT 'job-' || user_id % 10 AS id, 'file-' || event_id AS file_id, event_type AS status,
    TIMESTAMP '2024-01-01' + (event_id // 2) * INTERVAL 1 SECOND AS ts, event_id AS n FROM events),
calls AS (
  SELECT event_id AS call_id, list_extract([200, 400, 401, 403, 404, 429, 429, 500, 503], event_id % 9 + 1) AS status,
    CASE event_id % 4 WHEN 0 THEN 'RESOURCE_EXHAUSTED' WHEN 1 THEN 'quota exceeded' ELSE 'slow down' END AS body,
    (event_id // 9) % 4 AS attempt FROM events),
outcomes AS (
  SELECT call_id, attempt, CASE WHEN status = 200 THEN 'ok' WHEN status IN (401, 403, 404) THEN 'critical'
    WHEN status = 429 AND attempt < 3 AND body IN ('RESOURCE_EXHAUSTED', 'quota exceeded') THEN 'daily_quota'
    WHEN status = 429 THEN 'rate_limited' WHEN status BETWEEN 400 AND 499 THEN 'permanent'
    ELSE 'retryable' END AS class FROM calls),
verdicts AS (
  SELECT doc_id, kind, CASE WHEN kind = 'good' THEN doc_id % 2 = 0 END AS should_flag,
    CASE WHEN kind = 'good' THEN greatest(0, least(1, (doc_id % 30 - 10) / 10.0))::DOUBLE END AS score,
    CASE WHEN kind = 'good' THEN source END AS reason,
    CASE WHEN kind = 'good' THEN 'abusive|' || lang END AS labels,
    CASE kind WHEN 'null' THEN 'invalid response format: '
      WHEN 'none' THEN 'invalid response format: no verdict for ' || source
      WHEN 'bad' THEN 'failed to parse JSON response' END AS error
  FROM (SELECT *, CASE WHEN doc_id % 17 = 0 THEN 'null' WHEN doc_id % 11 = 0 THEN 'none' WHEN doc_id % 13 = 0 OR doc_id % 7 = 0 THEN 'bad'
          ELSE 'good' END AS kind FROM docs))
"""


def _line(condition: str, text: str) -> str:
    return f"CASE WHEN {condition} THEN {_text(text)} END"


_SEP = "chr(10) || '   '"
_FLAG_SECTION = (
    f"coalesce(nullif(concat_ws({_SEP}, "
    + ", ".join(_line(name, line) for name, line in P.FLAG_LINES.items())
    + f", CASE WHEN forbidden_words <> '' THEN {_text(P.FLAG_WORDS)} || replace(forbidden_words, '|', ', ') END), ''), "
    + f"{_text(P.FLAG_NONE)})")
_EXCLUDE_SECTION = (
    f"concat_ws({_SEP}, " + ", ".join(_text(line) for line in P.EXCLUDE_ALWAYS) + ", "
    + ", ".join(_line(f"NOT {name}", line) for name, line in P.EXCLUDE_UNLESS.items()) + ")")
_PROMPT = (
    f"{_text(P.INTRO)} || strftime(created_at, '%B %-d, %Y') || {_text(P.TEXT_OPEN)} || "
    "replace(replace(replace(text, '\"', '\\\"'), chr(10), ' '), chr(13), ' ') || "
    f"{_text(P.FLAG_OPEN)} || {_FLAG_SECTION} || {_text(P.EXCLUDE_OPEN)} || {_EXCLUDE_SECTION} || chr(10) || "
    f"CASE WHEN tone <> '' THEN {_text(P.TONE_OPEN)} || tone || {_text(P.TONE_CLOSE)} ELSE '' END || {_text(P.OUTRO)}")

_NEWEST = "ORDER BY flagged_at DESC, id"
_SHOWN = "id, tweet_id, job_id, flagged_at, score, url"

_QUERIES = {
    "archive_format": "SELECT path, true AS is_zip FROM files UNION ALL SELECT path, false FROM files",
    "archive_zip_member": f"""
        SELECT path, CASE part % 3 WHEN 0 THEN 'data/tweets.js' WHEN 1 THEN 'data/deleted-tweets.js' END AS member,
          CASE WHEN part % 3 = 2 THEN NULL ELSE n END AS posts,
          CASE WHEN part % 3 = 2 THEN {_text(S.ERROR_PREFIX + S.ERROR_NO_MEMBER)} END AS error
        FROM files JOIN (SELECT job_id, part, count(*) AS n FROM posts GROUP BY ALL) USING (job_id, part)""",
    "archive_js": "SELECT job_id || '/' || part AS path, count(*) AS posts FROM posts GROUP BY job_id, part",
    "archive_errors": f"""
        SELECT path, {_text(S.ERROR_PREFIX)} || CASE part % 4 WHEN 2 THEN {_text(S.ERROR_UNWRAP)}
          ELSE {_text(S.ERROR_JSON)} END AS error FROM files WHERE part % 4 <> 0""",
    "archive_parse": """
        SELECT job_id, part, pos, tweet_id, text, created_at, links, hashtags, mentions, attachments
        FROM raws WHERE NOT """ + _REPOST,
    "js_unwrap": f"""
        SELECT tweet_id, CASE
            WHEN doc_id % 4 IN (0, 1, 2) THEN '[' || body || ']'
            WHEN strpos(body, '[') > 0 AND strpos(reverse(body), ']') > 0
             AND length(body) - strpos(reverse(body), ']') + 1 > strpos(body, '[')
            THEN substr(body, strpos(body, '['), length(body) - strpos(reverse(body), ']') + 2 - strpos(body, '['))
            ELSE '' END AS value FROM docs""",
    "post_text": "SELECT tweet_id, text AS value FROM raws",
    "post_created_at": "SELECT tweet_id, created_at AS value, created_at_ok FROM raws",
    "post_links": "SELECT tweet_id, links AS value FROM raws",
    "post_hashtags": "SELECT tweet_id, hashtags AS value FROM raws",
    "post_mentions": "SELECT tweet_id, mentions AS value FROM raws",
    "post_attachments": "SELECT tweet_id, attachments AS value FROM raws",
    "post_url": f"SELECT tweet_id, '{S.POST_URL_BASE}' || tweet_id AS value FROM posts",
    "post_key": "SELECT tweet_id, job_id || '_' || tweet_id AS value FROM posts",
    "flag_id": "SELECT tweet_id, md5(job_id || '_' || tweet_id || '_llm_scorer') AS value FROM posts",
    "phrase_contains": "SELECT tweet_id, contains(lower(text), lower('Crypto')) AS value FROM posts",
    "array_json_roundtrip": """
        SELECT tweet_id, '[' || concat_ws(',', to_json(job_id), to_json(lang), to_json(source)) || ']' AS value,
          concat_ws('|', job_id, lang, source) AS restored FROM posts""",
    "ts_rfc3339": """
        SELECT tweet_id, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS value,
          date_trunc('second', created_at) AS restored FROM posts""",
    "retweet_filter": "SELECT job_id, tweet_id FROM originals",
    "parse_summary": f"""
        SELECT job_id, count(*) FILTER (NOT {_REPOST}) AS originals, count(*) FILTER ({_REPOST}) AS retweets
        FROM posts GROUP BY job_id""",
    "posts_dedup": "SELECT job_id, tweet_id, pos, text FROM posts",
    "rule_abusive": "SELECT tweet_id, abusive AS hit FROM hits",
    "rule_hate": "SELECT tweet_id, hate AS hit FROM hits",
    "rule_threat": "SELECT tweet_id, threat AS hit FROM hits",
    "rule_score": "SELECT job_id, tweet_id, should_flag, score, reason, labels FROM rules",
    "rule_flags": f"""
        SELECT job_id, tweet_id, score, reason, '{S.POST_URL_BASE}' || tweet_id AS url FROM rules WHERE should_flag""",
    "filter_blocked_phrase": f"""
        SELECT tweet_id, {_BLOCKED_NAME} AS phrase, {_text(S.REASON_BLOCKED)} || {_BLOCKED_NAME} AS reason
        FROM originals WHERE ({_BLOCKED_RANK}) IS NOT NULL""",
    "policy_join": f"""
        SELECT tweet_id, min_by(phrase, rank) AS phrase, {_text(S.REASON_BLOCKED)} || min_by(phrase, rank) AS reason
        FROM originals JOIN (VALUES {", ".join(f"({n}, {_text(p)})" for n, p in enumerate(BLOCKED))}) policy(rank, phrase)
          ON phrase <> '' AND contains(lower(text), lower(phrase)) GROUP BY tweet_id""",
    "policy_table": f"""
        SELECT tweet_id, min_by(phrase, rank) AS phrase, {_text(S.REASON_BLOCKED)} || min_by(phrase, rank) AS reason
        FROM originals JOIN (
            SELECT item_id * 100000 + unnest(range(len(parts))) AS rank, trim(unnest(parts), ' ') AS phrase
            FROM (SELECT item_id, regexp_split_to_array(text, '[.,;:!?\\n]') AS parts FROM benchmark))
          ON phrase <> '' AND contains(lower(text), lower(phrase)) GROUP BY tweet_id""",
    "second_run_flags": "SELECT job_id, tweet_id, filter_reason, score, reason FROM flags",
    "second_run_progress": """
        SELECT job_id, count(*) AS total, count(*) AS processed, count(*) FILTER (g.tweet_id IS NULL) AS calls,
          count(*) FILTER (f.tweet_id IS NOT NULL) AS flagged
        FROM originals LEFT JOIN gated g USING (job_id, tweet_id) LEFT JOIN flags f USING (job_id, tweet_id)
        GROUP BY job_id""",
    "filter_threat": f"""
        SELECT tweet_id, 1.0::DOUBLE AS score, {_text(S.REASON_CASCADE_THREAT)} AS reason
        FROM originals WHERE {_any(S.CASCADE_THREAT)}""",
    "filter_hate": f"""
        SELECT tweet_id, 0.95::DOUBLE AS score, {_text(S.REASON_CASCADE_HATE)} AS reason
        FROM originals WHERE {_any(S.CASCADE_HATE)}""",
    "filter_cascade": "SELECT job_id, tweet_id, filter_reason, score, reason FROM cascade",
    "filter_gate": "SELECT job_id, tweet_id, filter_reason, score, reason FROM gated",
    "route": "SELECT job_id, tweet_id, CASE WHEN needs_scoring THEN 'needs_scoring' ELSE 'flagged_now' END AS route FROM state",
    "route_summary": """
        SELECT job_id, count(*) FILTER (needs_scoring) AS needs_scoring,
          count(*) FILTER (NOT needs_scoring) AS flagged_now FROM state GROUP BY job_id""",
    "flagged_union": f"""
        SELECT job_id, tweet_id, filter_reason, score, reason, '{S.POST_URL_BASE}' || tweet_id AS url FROM flags""",
    "mark_processed": "SELECT job_id, tweet_id, needs_scoring, processed FROM state",
    "pending": "SELECT job_id, tweet_id FROM waiting",
    "pending_topn": "SELECT job_id, tweet_id FROM waiting ORDER BY created_at, pos, job_id, tweet_id LIMIT 50",
    "resume_pending": "SELECT job_id, tweet_id FROM originals WHERE tweet_id NOT IN (SELECT tweet_id FROM scored)",
    "pending_with_criteria": """
        SELECT job_id, tweet_id, tone, exclude_politics, forbidden_words FROM waiting JOIN criteria USING (job_id)""",
    "criteria_parse": """
        SELECT job_id, CASE WHEN own THEN tone END AS tone, CASE WHEN own THEN exclude_politics END AS exclude_politics,
          CASE WHEN own THEN forbidden_words END AS forbidden_words FROM jobs""",
    "criteria_default": "SELECT job_id, tone, exclude_politics, forbidden_words, exclude_threats FROM criteria",
    "job_progress": "SELECT job_id, total, processed, calls, flagged FROM progress",
    "job_status": f"""
        SELECT job_id, CASE WHEN k % 7 = 3 THEN 'failed' WHEN blocked THEN 'paused_quota' WHEN processed = total THEN 'done'
          WHEN total > 0 THEN 'running' ELSE 'queued' END AS status,
          CASE WHEN k % 7 = 3 THEN {_text(S.ERROR_PREFIX + S.ERROR_JSON)} END AS error
        FROM jobs LEFT JOIN progress USING (job_id)
        LEFT JOIN (SELECT job_id, bool_or(NOT admitted) AS blocked FROM admission GROUP BY job_id) USING (job_id)""",
    "job_upsert": """
        SELECT id, min_by(file_id, (ts, n)) AS file_id, max_by(status, (ts, n)) AS status, min(ts) AS created_at,
          max(ts) AS updated_at FROM updates GROUP BY id""",
    "job_updates_coalesced": """
        SELECT id, time_bucket(INTERVAL 5 SECONDS, ts, TIMESTAMP '1970-01-01') AS window_start,
          max_by(status, (ts, n)) AS status, min(ts) AS created_at, max(ts) AS updated_at FROM updates GROUP BY ALL""",
    "quota_usage": "SELECT CAST(scored_at AS DATE) AS day, count(*) AS calls FROM scored GROUP BY ALL",
    "quota_admission": "SELECT job_id, tweet_id, admitted FROM admission",
    "quota_reset_at": """
        SELECT DISTINCT CAST(scored_at AS DATE) AS day,
          date_trunc('day', scored_at)::TIMESTAMP + INTERVAL 1 DAY + INTERVAL 1 MINUTE AS reset_at FROM scored""",
    "flagged_list": f"SELECT {_SHOWN} FROM flagged WHERE job_id = 'job-0' {_NEWEST}",
    "flagged_page": f"SELECT {_SHOWN} FROM flagged {_NEWEST} LIMIT 20 OFFSET 40",
    "flagged_by_id": f"SELECT {_SHOWN} FROM flagged WHERE id = md5('job-0_3_llm_scorer')",
    "flagged_count": "SELECT job_id, count(*) AS n FROM flagged GROUP BY job_id",
    "flagged_count_rollup": "SELECT job_id, count(*) AS n FROM flagged GROUP BY ROLLUP (job_id)",
    "page_meta": """
        SELECT 3 AS page, 20 AS page_size, count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS total_pages
        FROM flagged""",
    "export_urls": "SELECT url FROM flagged WHERE url <> ''",
    "export_json": """
        SELECT job_id, 0 AS part, count(*) FILTER (url <> '') AS count, '{"urls":[' || coalesce(string_agg(
            CASE WHEN url <> '' THEN '"' || url || '"' END, ',' ORDER BY flagged_at DESC, id), '') || '],"count":'
            || count(*) FILTER (url <> '') || ',"job_id":"' || job_id || '"}' AS payload
        FROM flagged GROUP BY job_id""",
    "llm_prompt": f"SELECT tweet_id, {_PROMPT} AS prompt FROM originals JOIN criteria USING (job_id)",
    "llm_envelope": """
        SELECT doc_id, CASE WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 THEN NULL ELSE text END AS response,
          CASE WHEN doc_id % 5 = 0 THEN 'failed to decode response' WHEN doc_id % 7 = 0
            THEN 'the answer holds no text part' END AS error FROM docs""",
    "llm_response": "SELECT doc_id, should_flag, score, reason, labels, error FROM verdicts",
    "llm_batch_errors": """
        SELECT doc_id, coalesce(should_flag, false) AS should_flag, coalesce(score, 0)::DOUBLE AS score,
          coalesce(reason, 'Error: ' || error) AS reason, labels FROM verdicts""",
    "call_triage": "SELECT call_id, class FROM outcomes",
    "retry_delay": """
        SELECT call_id, CASE WHEN attempt < 3 THEN CASE class WHEN 'rate_limited' THEN least(60 * pow(2, attempt), 300)
          WHEN 'retryable' THEN pow(2, attempt) END END::DOUBLE AS delay_s FROM outcomes""",
}


def oracle_sql() -> dict[str, str]:
    return {name: f"WITH {_VIEWS} {query}" for name, query in _QUERIES.items()}
