"""DuckDB oracle SQL, one statement per key of ``feedweave.plans.queries.QUERIES``.

Written as plain SQL against the pre-registered tables, with the fixture views
inlined as CTEs.  Column names and types are aliased to match the Spark side.
"""

from __future__ import annotations

from feedweave.plans.oracle_views import (DIGEST_RUNS, FEED_ITEMS, MARKDOWN_DOCS, RESPONSES,
                                          SEEN_LEDGER, SETTINGS, SIGHTINGS, WS, clean_html,
                                          py_strip, ts_text, with_views)

ORACLE: dict[str, str] = {}

_HAY = ("lower(coalesce(author, '') || ' ' || substr(coalesce(summary, ''), 1, 500) || ' ' || "
        "substr(coalesce(description, ''), 1, 500) || ' ' || substr(coalesce(title, ''), 1, 500))")
_KEY = ("md5(lower(" + py_strip("coalesce(nullif(link, ''), nullif(entry_id, ''), "
                                "nullif(title, ''), '')") + "))")
_FILTER = (f"(len(source_filter) = 0 OR EXISTS (SELECT 1 FROM unnest(source_filter) AS u(t) "
           f"WHERE contains({_HAY}, lower(u.t))))")
_CUTOFF = ("(pub_ts IS NULL OR pub_ts >= TIMESTAMP '2024-01-05 00:00:00' - to_days(CAST(days_back AS BIGINT)))")
_LABEL = "coalesce(strftime(pub_ts, '%Y-%m-%d'), 'Date unknown')"

_STAGED = r"""
staged AS (
  SELECT f.*, s.days_back, s.max_items_per_source, s.min_items_to_send
  FROM feed_items f JOIN settings s ON f.digest_type = s.digest_type
)"""


def _fresh_ctes(min_items: int | None = None) -> str:
    gate = "min_items_to_send" if min_items is None else str(min_items)
    return with_views(FEED_ITEMS, SETTINGS, SEEN_LEDGER, _STAGED, f"""
passed AS (
  SELECT * FROM staged
  WHERE pos < max_items_per_source AND {_CUTOFF} AND {_FILTER}
),
deduped AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY digest_type, {_KEY} ORDER BY source_idx, pos) AS rn
    FROM passed) WHERE rn = 1
),
articles AS (
  SELECT digest_type, source_idx, pos, org, category, source_name,
         {py_strip("coalesce(title, '')")} AS title,
         {clean_html("coalesce(nullif(summary, ''), nullif(description, ''), '')")} AS summary,
         {py_strip("coalesce(link, '')")} AS link,
         {_LABEL} AS published, pub_ts, min_items_to_send
  FROM deduped
),
fresh AS (
  SELECT a.* FROM articles a
  WHERE a.link = '' OR NOT EXISTS (
    SELECT 1 FROM seen_ledger l
    WHERE l.digest_type = a.digest_type AND l.link = a.link
      AND l.first_seen >= DATE '2024-01-05' - 7)
),
gated AS (
  SELECT * FROM (
    SELECT *, count(*) OVER (PARTITION BY digest_type) AS n_type FROM fresh)
  WHERE n_type >= {gate}
)""")


ORACLE["fresh_items"] = _fresh_ctes() + f"""
SELECT digest_type,
       CAST(row_number() OVER (PARTITION BY digest_type
                               ORDER BY pub_ts DESC NULLS LAST, source_idx, pos) AS BIGINT) AS item_no,
       source_idx, pos, org, category, source_name, title, summary, link, published,
       {ts_text('pub_ts')} AS pub_ts
FROM gated"""

ORACLE["per_source_cap"] = with_views(FEED_ITEMS, SETTINGS, _STAGED) + """
SELECT digest_type, source_idx, pos, entry_id FROM staged WHERE pos < 20"""

ORACLE["recency_cutoff"] = with_views(FEED_ITEMS, SETTINGS, _STAGED) + f"""
SELECT digest_type, source_idx, pos, entry_id, {_LABEL} AS published
FROM staged WHERE pos < max_items_per_source AND {_CUTOFF}"""

ORACLE["source_filter"] = with_views(FEED_ITEMS, SETTINGS, _STAGED) + f"""
SELECT digest_type, source_idx, pos, entry_id
FROM staged WHERE pos < max_items_per_source AND {_CUTOFF} AND {_FILTER}"""

ORACLE["in_run_dedup"] = with_views(FEED_ITEMS, SETTINGS, _STAGED) + f"""
SELECT digest_type, entry_key, source_idx, pos, entry_id FROM (
  SELECT *, {_KEY} AS entry_key,
         row_number() OVER (PARTITION BY digest_type, {_KEY} ORDER BY source_idx, pos) AS rn
  FROM staged) WHERE rn = 1"""

ORACLE["newest_first"] = _fresh_ctes() + f"""
SELECT digest_type,
       CAST(row_number() OVER (PARTITION BY digest_type
                               ORDER BY pub_ts DESC NULLS LAST, source_idx, pos) AS BIGINT) AS rank,
       source_idx, pos, {_LABEL} AS published
FROM deduped"""

ORACLE["min_items_gate"] = _fresh_ctes(min_items=100) + """
SELECT digest_type, count(*) AS item_count FROM gated GROUP BY digest_type"""

ORACLE["entry_key"] = with_views(FEED_ITEMS) + "SELECT doc_id, " + (
    "md5(lower(" + py_strip(
        "coalesce(nullif(CASE WHEN doc_id % 29 = 0 THEN ' ' || chr(160) || chr(9) ELSE link END, ''), "
        "nullif(entry_id, ''), nullif(title, ''), '')") + ")) AS entry_key FROM feed_items")

_BASE_TS = ("(TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST((doc_id * 37) % 96 AS BIGINT)) "
            "+ to_minutes(CAST(doc_id % 60 AS BIGINT)))")
ORACLE["entry_date"] = f"""
WITH strs AS (
  SELECT doc_id,
    CASE doc_id % 5
      WHEN 0 THEN strftime({_BASE_TS}, '%a, %d %b %Y %H:%M:%S') || ' +0000'
      WHEN 1 THEN strftime({_BASE_TS}, '%Y-%m-%dT%H:%M:%S') || '+02:00'
      WHEN 2 THEN 'not a date'
      WHEN 3 THEN NULL
      ELSE '' END AS published,
    CASE WHEN doc_id % 3 = 0 THEN strftime({_BASE_TS} + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') END AS updated,
    strftime({_BASE_TS} + INTERVAL 2 HOUR, '%d %b %Y %H:%M:%S') || ' GMT' AS created
  FROM documents
),
parsed AS (
  SELECT doc_id,
    coalesce(
      timezone('UTC', try_strptime(published, '%a, %d %b %Y %H:%M:%S %z')),
      timezone('UTC', try_strptime(published, '%Y-%m-%dT%H:%M:%S%z')),
      try_strptime(updated, '%Y-%m-%d %H:%M:%S'),
      try_strptime(replace(created, ' GMT', ''), '%d %b %Y %H:%M:%S')) AS ts
  FROM strs
)
SELECT doc_id, {ts_text('ts')} AS entry_ts FROM parsed"""

ORACLE["feed_entries"] = f"""
SELECT CAST(doc_id AS INTEGER) AS source_idx, 0 AS pos,
       CASE WHEN lang = 'en' THEN 'A & B' WHEN lang IN ('fr', 'de') THEN 'T' ELSE 'One' || chr(160) || 'title' END AS title,
       'https://f/' || doc_id AS link, {clean_html('text')} AS summary,
       CASE WHEN lang IN ('en', 'fr', 'de') THEN '2024-01-04 10:00:00' END AS pub_ts
FROM documents"""

ORACLE["feed_status"] = """
SELECT CAST(doc_id AS INTEGER) AS source_idx, CASE WHEN lang IN ('en', 'fr', 'de') THEN 1 ELSE 2 END AS n_entries,
       CASE WHEN lang IN ('en', 'fr', 'de') THEN 0 ELSE 1 END AS n_bad, 'ok' AS status
FROM documents"""

ORACLE["clean_html"] = f"""
SELECT page_id, {clean_html('html')} AS text,
       coalesce(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title
FROM pages"""

ORACLE["article_projection"] = with_views(FEED_ITEMS, SETTINGS, _STAGED) + f"""
SELECT digest_type, source_idx, pos,
       {py_strip("coalesce(title, '')")} AS title,
       {clean_html("coalesce(nullif(summary, ''), nullif(description, ''), '')")} AS summary,
       {py_strip("coalesce(link, '')")} AS link,
       {_LABEL} AS published
FROM staged"""

# ---------------------------------------------------------------- ledger

ORACLE["ledger_replay"] = "WITH RECURSIVE " + SIGHTINGS.strip() + r""",
acc(digest_type, link, run_date) AS (
  SELECT digest_type, link, min(run_date) FROM sightings GROUP BY digest_type, link
  UNION ALL
  SELECT s.digest_type, s.link, min(s.run_date)
  FROM acc a JOIN sightings s
    ON s.digest_type = a.digest_type AND s.link = a.link AND s.run_date >= a.run_date + 8
  GROUP BY s.digest_type, s.link
)
SELECT digest_type, link, CAST(run_date AS VARCHAR) AS run_date FROM acc"""

# the keyed-state stream and the late days end where the whole replay ends
ORACLE["ledger_stream"] = ORACLE["ledger_replay"]
ORACLE["ledger_late_days"] = ORACLE["ledger_replay"]

ORACLE["ledger_insert"] = _fresh_ctes() + """
SELECT DISTINCT g.link, g.digest_type, '2024-01-05' AS first_seen
FROM gated g
WHERE g.link <> '' AND NOT EXISTS (
  SELECT 1 FROM seen_ledger l WHERE l.digest_type = g.digest_type AND l.link = g.link
    AND l.first_seen >= DATE '2024-01-05' - 7)"""

ORACLE["ledger_prune"] = with_views(FEED_ITEMS, SEEN_LEDGER) + """
SELECT link, digest_type, CAST(first_seen AS VARCHAR) AS first_seen
FROM seen_ledger WHERE NOT (first_seen < DATE '2024-01-08' - 7)"""

# ---------------------------------------------------------------- history


def _index_sql(term: str, source: str = "digest_runs") -> str:
    t = term.strip().replace("'", "''")
    return f"""
SELECT CAST(run_date AS VARCHAR) AS run_date,
       CAST(count(*) FILTER (WHERE digest_type = 'press') AS INTEGER) AS press_runs,
       CAST(count(*) FILTER (WHERE digest_type = 'org') AS INTEGER) AS org_runs,
       CAST(coalesce(sum(item_count) FILTER (WHERE digest_type = 'press'), 0) AS INTEGER) AS press_items,
       CAST(coalesce(sum(item_count) FILTER (WHERE digest_type = 'org'), 0) AS INTEGER) AS org_items
FROM {source}
WHERE '{t}' = '' OR markdown ILIKE '%{t}%' OR CAST(run_date AS VARCHAR) ILIKE '%{t}%'
GROUP BY run_date
ORDER BY run_date DESC
LIMIT 400"""


_RUN_TIME = "strftime(timezone('America/Chicago', created_at AT TIME ZONE 'UTC'), '%I:%M %p')"

ORACLE["date_index"] = with_views(DIGEST_RUNS) + _index_sql("")
ORACLE["date_index_search"] = with_views(DIGEST_RUNS) + _index_sql("  que ")
ORACLE["date_index_search_escape"] = with_views(DIGEST_RUNS) + _index_sql("que")
ORACLE["date_index_search_date"] = with_views(DIGEST_RUNS) + _index_sql("2024-01-1")
ORACLE["date_index_wide"] = """
WITH wide_runs AS (
  SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS run_date,
         CASE WHEN o_orderstatus = 'F' THEN 'press' ELSE 'org' END AS digest_type,
         CAST(o_orderkey % 50 AS INTEGER) AS item_count, '' AS markdown
  FROM orders)""" + _index_sql("", "wide_runs")

ORACLE["runs_for_date"] = with_views(DIGEST_RUNS) + f"""
SELECT id, CAST(run_date AS VARCHAR) AS run_date, digest_type, source_count, item_count,
       {_RUN_TIME} AS run_time,
       count(*) OVER (PARTITION BY run_date, digest_type) > 1 AS show_time,
       CAST(row_number() OVER (PARTITION BY run_date
            ORDER BY CASE WHEN digest_type = 'press' THEN 0 ELSE 1 END, created_at DESC, id DESC)
            AS BIGINT) AS display_rank
FROM digest_runs"""

ORACLE["day_documents"] = with_views(DIGEST_RUNS) + """
SELECT id, CAST(run_date AS VARCHAR) AS run_date, count(*) OVER (PARTITION BY run_date, digest_type) > 1 AS show_time,
       row_number() OVER (PARTITION BY run_date ORDER BY digest_type = 'press' DESC, created_at DESC, id DESC) AS display_rank,
       md5(markdown) AS markdown_md5, md5(feature_pitch_raw) AS pitch_md5
FROM digest_runs"""

# the pattern that each term of the indexed search stands for
_TERM_PATTERNS = [("  que ", "que"), ("q\\ue", "que"), ("2024-01-1", "2024-01-1"), ("er%ung", "er%ung"), ("e", "e"), ("zzzzzz", "zzzzzz")]
ORACLE["indexed_search"] = with_views(DIGEST_RUNS) + "\nUNION ALL\n".join(
    f"SELECT '{term}' AS term, * FROM ({_index_sql(pattern)})" for term, pattern in _TERM_PATTERNS)

ORACLE["comparison_context"] = with_views(DIGEST_RUNS) + """
SELECT id, CASE WHEN digest_type = 'org' THEN 'Synthesis at the end of an org news digest for a freelance journalist covering aging, senior care, and elder health, read by a freelance journalist and content creator who pitches consumer and trade outlets. Items are grouped by organisation, each with consumer and trade story angles already noted.'
  ELSE 'Synthesis at the end of a press-release highlights digest, read by a freelance writer curating morning press-release highlights across health, wellness, food, lifestyle, and consumer categories.' END AS system
FROM digest_runs"""

ORACLE["landed_sources"] = """
SELECT 't' || CAST(floor(c_custkey / 100) AS BIGINT) AS digest_type, CAST(row_number() OVER (PARTITION BY floor(c_custkey / 100) ORDER BY c_custkey) - 1 AS INTEGER) AS source_idx,
  c_custkey AS k, c_name FROM customer"""
ORACLE["landed_sources"] = f"""
SELECT digest_type, source_idx, CASE WHEN k % 7 <> 0 THEN c_name ELSE 'Unknown source' END AS source_name,
  CASE WHEN k % 5 <> 0 THEN 'org ' || c_name WHEN k % 7 <> 0 THEN c_name ELSE 'Unknown source' END AS org,
  CASE WHEN k % 3 <> 0 THEN 'cat' ELSE '' END AS category, 'https://' || k AS feed_url, CASE WHEN k % 4 = 0 THEN 'a,b' ELSE '' END AS source_filter
FROM ({ORACLE["landed_sources"]}) WHERE k % 11 <> 0 AND k % 13 <> 0 AND k % 6 <> 0 AND k % 17 <> 0"""

ORACLE["runs_of_two_schemas"] = with_views(DIGEST_RUNS) + f"""
SELECT id, CAST(run_date AS VARCHAR) AS run_date, digest_type, item_count, md5(markdown) AS markdown_md5,
  CASE WHEN run_date >= DATE '2024-01-15' THEN md5(trends_raw) END AS trends_md5, CASE WHEN run_date >= DATE '2024-01-15' THEN {ts_text('created_at')} END AS created_at
FROM digest_runs"""

ORACLE["run_by_id"] = with_views(DIGEST_RUNS) + f""",
requests AS (
  SELECT CASE CAST(floor(id / 100) AS BIGINT) % 7
           WHEN 0 THEN CAST(id AS VARCHAR) || 'x'
           WHEN 1 THEN '-' || CAST(id AS VARCHAR)
           WHEN 2 THEN '0' || CAST(id AS VARCHAR)
           WHEN 3 THEN ' ' || CAST(id AS VARCHAR)
           WHEN 4 THEN CAST(id AS VARCHAR) || '000000000000000'
           WHEN 5 THEN CAST(id AS VARCHAR) || chr(10)
           ELSE CAST(id AS VARCHAR) END AS raw_id
  FROM digest_runs
),
checked AS (
  SELECT raw_id,
         coalesce(regexp_full_match(raw_id, '[0-9]+')
                  AND try_cast(raw_id AS HUGEINT) BETWEEN 1 AND 9007199254740991, false) AS valid
  FROM requests
)
SELECT c.raw_id, c.valid, r.id, r.digest_type, CAST(r.run_date AS VARCHAR) AS run_date, r.item_count,
       {_RUN_TIME.replace('created_at', 'r.created_at')} AS run_time
FROM checked c LEFT JOIN digest_runs r ON c.valid AND r.id = try_cast(c.raw_id AS BIGINT)"""

ORACLE["previous_digest"] = with_views(DIGEST_RUNS) + """
SELECT id, digest_type,
       CAST(row_number() OVER w AS BIGINT) AS seq,
       lag(id) OVER w AS prev_id,
       CAST(lag(run_date) OVER w AS VARCHAR) AS prev_run_date
FROM digest_runs
WINDOW w AS (PARTITION BY digest_type ORDER BY run_date, created_at, id)"""

ORACLE["latest_digest"] = with_views(DIGEST_RUNS) + """
SELECT digest_type, id, CAST(run_date AS VARCHAR) AS run_date FROM (
  SELECT *, row_number() OVER (PARTITION BY digest_type
                               ORDER BY run_date DESC, created_at DESC, id DESC) AS rn
  FROM digest_runs) WHERE rn = 1"""

ORACLE["active_date"] = with_views(DIGEST_RUNS) + """,
idx AS (""" + _index_sql("") + """),
requests AS (
  SELECT DISTINCT CAST(run_date + CASE WHEN id % 9 = 0 THEN 500 ELSE 0 END AS VARCHAR) AS requested
  FROM digest_runs
),
resolved AS (
  SELECT r.requested,
         CASE WHEN EXISTS (SELECT 1 FROM idx WHERE idx.run_date = r.requested) THEN r.requested
              ELSE (SELECT max(run_date) FROM idx) END AS active_date
  FROM requests r
)
SELECT r.requested, r.active_date, i.press_runs, i.org_runs, i.press_items, i.org_items
FROM resolved r LEFT JOIN idx i ON i.run_date = r.active_date"""

ORACLE["run_time_label"] = with_views(DIGEST_RUNS) + f"""
SELECT id, {ts_text('created_at')} AS created_at, {_RUN_TIME} AS run_time FROM digest_runs"""

ORACLE["run_labels"] = with_views(DIGEST_RUNS) + """
SELECT id, digest_type,
       CASE digest_type WHEN 'press' THEN 'Press Highlights' WHEN 'org' THEN 'Org Watch' END AS label,
       CAST(run_date AS VARCHAR) || '-' || digest_type || '-digest.docx' AS file_name,
       CAST(item_count AS VARCHAR) || ' items fetched · ' || CAST(source_count AS VARCHAR) || ' sources' AS meta
FROM digest_runs"""

ORACLE["day_summary_labels"] = with_views(DIGEST_RUNS) + """,
idx AS (""" + _index_sql("") + """)
SELECT run_date,
  CASE WHEN press_runs > 0 THEN press_items || ' items across ' || press_runs || ' run'
       || CASE WHEN press_runs > 1 THEN 's' ELSE '' END ELSE '—' END AS press_label,
  CASE WHEN org_runs > 0 THEN org_items || ' items across ' || org_runs || ' run'
       || CASE WHEN org_runs > 1 THEN 's' ELSE '' END ELSE '—' END AS org_label,
  CASE WHEN press_runs > 0 THEN 'Press · ' || press_items
       || CASE WHEN press_runs > 1 THEN ' (' || press_runs || ' runs)' ELSE '' END END AS press_badge,
  CASE WHEN org_runs > 0 THEN 'Org · ' || org_items
       || CASE WHEN org_runs > 1 THEN ' (' || org_runs || ' runs)' ELSE '' END END AS org_badge
FROM idx"""

_RULES = ["run_date", "digest_type", "source_count", "item_count", "markdown", "created_at"]
ORACLE["run_constraints"] = with_views(DIGEST_RUNS) + ",\nchecks AS (\n" + " UNION ALL\n".join(
    [f"  SELECT 'not_null_{c}' AS rule, CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS violations "
     f"FROM digest_runs" for c in _RULES]
    + ["  SELECT 'type_check', CAST(count(*) FILTER (WHERE digest_type NOT IN ('press', 'org')) AS BIGINT) "
       "FROM digest_runs",
       "  SELECT 'unique_id', CAST(count(*) - count(DISTINCT id) AS BIGINT) FROM digest_runs"]
) + "\n)\nSELECT rule, violations FROM checks"

# ---------------------------------------------------------------- responses

_BODY = ("array_to_string(list_transform(list_filter(blocks, lambda b: b.type = 'text'), "
         "lambda b: coalesce(b.text, '')), '')")
_MEM_RE = "```digest_memory" + WS + "*(.*?)```"
_RESP = with_views(RESPONSES) + f""",
bodies AS (SELECT *, {_BODY} AS body FROM responses),
scored AS (
  SELECT *,
    regexp_matches(body, '{_MEM_RE}', 's') AS has_memory,
    CASE WHEN connection_error THEN 'transient'
         WHEN status_code IS NOT NULL AND (status_code < 200 OR status_code >= 300)
              AND (status_code = 429 OR status_code >= 500) THEN 'transient'
         WHEN status_code IS NOT NULL AND (status_code < 200 OR status_code >= 300) THEN 'fatal'
         WHEN stop_reason = 'refusal' THEN 'refused'
         WHEN {py_strip('body')} = '' THEN 'empty'
         WHEN stop_reason = 'max_tokens' THEN 'truncated'
         ELSE 'ok' END AS outcome
  FROM bodies
)"""

ORACLE["response_text"] = _RESP + f"""
SELECT request_id, body AS text, {py_strip('body')} = '' AS is_blank FROM scored"""

ORACLE["response_triage"] = _RESP + """
SELECT request_id, stop_reason, status_code, outcome FROM scored"""

ORACLE["memory_block"] = _RESP + f"""
SELECT request_id, has_memory,
       CASE WHEN has_memory THEN {py_strip(f"regexp_extract(body, '{_MEM_RE}', 1, 's')")} END AS memory
FROM scored"""


def _section_sql(body: str, heading: str, name: str) -> str:
    h = "## " + heading
    nl = "chr(10)"
    return f"""
  sec_{name}_1 AS (
    SELECT request_id, {body} AS b,
      CASE WHEN starts_with({body}, '{h}') THEN 1
           WHEN strpos({body}, {nl} || '{h}') > 0 THEN strpos({body}, {nl} || '{h}') + 1
           ELSE 0 END AS p
    FROM vis),
  sec_{name}_2 AS (
    SELECT request_id, p, substr(b, p + {len(h)}) AS rest FROM sec_{name}_1),
  sec_{name}_3 AS (
    SELECT request_id, p, rest, regexp_extract(rest, '^{WS}*', 0) AS lead FROM sec_{name}_2),
  sec_{name}_4 AS (
    SELECT request_id,
      CASE WHEN p = 0 OR strpos(lead, {nl}) = 0 THEN NULL
           ELSE substr(rest, length(lead) - strpos(reverse(lead), {nl}) + 2) END AS tail
    FROM sec_{name}_3),
  sec_{name} AS (
    SELECT request_id,
      CASE WHEN tail IS NULL THEN ''
           WHEN strpos(tail, {nl} || '## ') = 0 THEN {py_strip('tail')}
           ELSE {py_strip(f"substr(tail, 1, strpos(tail, {nl} || '## ') - 1)")} END AS {name}
    FROM sec_{name}_4)"""


ORACLE["response_sections"] = _RESP + f""",
vis AS (
  SELECT request_id,
    CASE WHEN has_memory
         THEN regexp_replace(substr(body, 1, strpos(body, '```digest_memory') - 1), '{WS}+$', '')
         ELSE body END AS visible
  FROM scored),
{_section_sql('visible', 'Trends & Continuity', 'trends_raw').strip()},
{_section_sql('visible', 'Bigger Picture: Feature Pitch', 'feature_pitch_raw').strip()}
SELECT t.request_id, t.trends_raw, p.feature_pitch_raw
FROM sec_trends_raw t JOIN sec_feature_pitch_raw p ON t.request_id = p.request_id"""

_MEM_LOG = f""",
memory_log AS (
  SELECT digest_type, request_id,
         {py_strip(f"regexp_extract(body, '{_MEM_RE}', 1, 's')")} AS memory,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(request_id AS BIGINT)) AS updated_at
  FROM scored WHERE outcome IN ('ok', 'truncated') AND has_memory),
memory_latest AS (
  SELECT digest_type, memory, updated_at FROM (
    SELECT *, row_number() OVER (PARTITION BY digest_type ORDER BY updated_at DESC, request_id DESC) AS rn
    FROM memory_log) WHERE rn = 1)"""

ORACLE["memory_latest"] = _RESP + _MEM_LOG + f"""
SELECT digest_type, memory, {ts_text('updated_at')} AS updated_at FROM memory_latest"""


def _rules_of(table: str, source: str, required: list[str], key: list[str]) -> list[str]:
    counts = [(f"not_null_{c}", f"count(*) FILTER (WHERE {c} IS NULL)") for c in required]
    counts += [("type_check", "count(*) FILTER (WHERE digest_type NOT IN ('press', 'org'))"),
               ("unique_" + "_".join(key), f"count(*) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(key)} FROM {source}))")]
    return [f"SELECT '{table}' AS \"table\", '{rule}' AS rule, CAST({n} AS BIGINT) AS violations FROM {source}" for rule, n in counts]


ORACLE["write_rules"] = _RESP + _MEM_LOG + ",\n" + DIGEST_RUNS.strip() + ",\n" + SIGHTINGS.strip() + """,
faulty_runs AS (SELECT CASE WHEN id % 5 = 0 THEN 100 ELSE id END AS id, run_date, CASE WHEN id % 7 = 0 THEN 'other' ELSE digest_type END AS digest_type,
                       source_count, item_count, CASE WHEN id % 11 <> 0 THEN markdown END AS markdown, created_at FROM digest_runs),
faulty_book AS (SELECT link, digest_type, CASE WHEN day(run_date) > 2 THEN run_date END AS first_seen FROM sightings)
""" + "\nUNION ALL ".join(_rules_of("runs", "faulty_runs", ["run_date", "digest_type", "source_count", "item_count", "markdown", "created_at"], ["id"])
                         + _rules_of("ledger", "faulty_book", ["link", "digest_type", "first_seen"], ["link", "digest_type"])
                         + _rules_of("memory", "memory_log", ["digest_type", "memory", "updated_at"], ["digest_type"]))

# the index that is kept up to date ends where the full aggregate ends
ORACLE["day_index_updates"] = ORACLE["date_index"]

_RULE60 = "'" + "=" * 60 + "'"
ORACLE["comparison_request"] = _RESP + _MEM_LOG + ",\n" + DIGEST_RUNS.strip() + f""",
seqd AS (
  SELECT id, digest_type, markdown,
         lag(id) OVER (PARTITION BY digest_type ORDER BY run_date, created_at, id) AS prev_id
  FROM digest_runs)
SELECT 'cmp-' || CAST(s.id AS VARCHAR) AS request_id, s.id, s.digest_type, s.prev_id,
  '' AS system, 3072 AS max_tokens,
  {_RULE60} || chr(10) || 'NEW DIGEST (just written):' || chr(10) || chr(10) || coalesce(s.markdown, '')
  || chr(10) || chr(10) || {_RULE60} || chr(10) || 'PREVIOUS DIGEST:' || chr(10) || chr(10)
  || coalesce(nullif(p.markdown, ''), '(none — this is the first digest of this type)')
  || chr(10) || chr(10) || {_RULE60} || chr(10) || 'DIGEST MEMORY:' || chr(10) || chr(10)
  || coalesce(nullif(m.memory, ''), '(none yet — this is the first run)')
  || chr(10) || {_RULE60} AS user_text
FROM seqd s
LEFT JOIN digest_runs p ON p.id = s.prev_id
LEFT JOIN memory_latest m ON m.digest_type = s.digest_type"""

# ---------------------------------------------------------------- markdown

_JS_WS = (r"[\t\n\x0b\x0c\r \xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
          r"\x{202f}\x{205f}\x{3000}\x{feff}]")
_JS_DOT = r"[^\n\r\x{2028}\x{2029}]"
_HEAD = r"^(#{1,4})" + _JS_WS + r"+(" + _JS_DOT + r"*)\z"
_BUL = r"^[-*]" + _JS_WS + r"+(" + _JS_DOT + r"*)\z"
_SPLIT = r"(\*\*[^*]+?\*\*|\*[^*]+?\*|\[[^\]]*?\]\([^)]*?\))"
_BOLD = r"^\*\*([^*]+)\*\*\z"
_LINK = r"^\[([^\]]*)\]\(([^)]*)\)\z"
_ITAL = r"^\*([^*]+)\*\z"

_BLOCKS = with_views(FEED_ITEMS, MARKDOWN_DOCS) + f""",
lines AS (
  SELECT doc_id, unnest(range(len(string_split(markdown, chr(10))))) AS line_no,
         unnest(string_split(markdown, chr(10))) AS raw
  FROM markdown_docs),
trimmed AS (
  SELECT doc_id, CAST(line_no AS INTEGER) AS line_no,
         regexp_replace(raw, '^{_JS_WS}+|{_JS_WS}+$', '', 'g') AS line
  FROM lines),
blocks AS (
  SELECT doc_id, line_no,
    CASE WHEN regexp_matches(line, '{_HEAD}') THEN 'heading'
         WHEN regexp_matches(line, '{_BUL}') THEN 'bullet' ELSE 'paragraph' END AS kind,
    CASE WHEN regexp_matches(line, '{_HEAD}') THEN CAST(length(regexp_extract(line, '{_HEAD}', 1)) AS INTEGER) END AS level,
    CASE WHEN regexp_matches(line, '{_HEAD}') THEN regexp_extract(line, '{_HEAD}', 2)
         WHEN regexp_matches(line, '{_BUL}') THEN regexp_extract(line, '{_BUL}', 1)
         ELSE line END AS text
  FROM trimmed WHERE line <> '' AND line <> '---')"""

_SPANS = _BLOCKS + f""",
parts AS (
  -- text between matches interleaved with the matches themselves, empties dropped
  SELECT doc_id, line_no,
    list_filter([p[1]] || flatten(list_transform(generate_series(1, len(m)),
                                                 lambda i: [m[i], p[i + 1]])),
                lambda x: x <> '') AS ps
  FROM (SELECT doc_id, line_no, regexp_extract_all(text, '{_SPLIT}', 0) AS m,
               regexp_split_to_array(text, '{_SPLIT}') AS p
        FROM blocks)),
parts2 AS (
  SELECT doc_id, line_no, CASE WHEN len(ps) = 0 THEN [''] ELSE ps END AS ps FROM parts),
exploded AS (
  SELECT doc_id, line_no, unnest(range(len(ps))) AS span_no, unnest(ps) AS part FROM parts2),
spans AS (
  SELECT doc_id, line_no, CAST(span_no AS INTEGER) AS span_no,
    CASE WHEN regexp_matches(part, '{_BOLD}') THEN 'bold'
         WHEN regexp_matches(part, '{_LINK}') THEN 'link'
         WHEN regexp_matches(part, '{_ITAL}') THEN 'italic' ELSE 'plain' END AS kind,
    CASE WHEN regexp_matches(part, '{_BOLD}') THEN regexp_extract(part, '{_BOLD}', 1)
         WHEN regexp_matches(part, '{_LINK}') THEN regexp_extract(part, '{_LINK}', 1)
         WHEN regexp_matches(part, '{_ITAL}') THEN regexp_extract(part, '{_ITAL}', 1)
         ELSE part END AS text,
    CASE WHEN NOT regexp_matches(part, '{_BOLD}') AND regexp_matches(part, '{_LINK}')
         THEN regexp_extract(part, '{_LINK}', 2) END AS href
  FROM exploded)"""

ORACLE["markdown_blocks"] = _BLOCKS + "\nSELECT * FROM blocks"
ORACLE["markdown_spans"] = _SPANS + "\nSELECT * FROM spans"
ORACLE["markdown_links"] = _SPANS + "\nSELECT doc_id, line_no, span_no, text, href FROM spans WHERE kind = 'link'"

ORACLE["full_document"] = with_views(DIGEST_RUNS) + """
SELECT id, coalesce(markdown, '')
  || CASE WHEN coalesce(length(trends_raw), 0) > 0
          THEN chr(10) || '## Trends & Continuity' || chr(10) || trends_raw ELSE '' END
  || CASE WHEN coalesce(length(feature_pitch_raw), 0) > 0
          THEN chr(10) || '## Bigger Picture: Feature Pitch' || chr(10) || feature_pitch_raw ELSE '' END
  AS document
FROM digest_runs"""

# ---------------------------------------------------------------- assembly

ORACLE["digest_header"] = with_views(DIGEST_RUNS) + """
SELECT id,
  CASE WHEN digest_type = 'org' THEN
    '# Org News Digest — ' || strftime(run_date, '%B %Y') || chr(10) || '**Run date:** '
    || strftime(run_date, '%Y-%m-%d') || ' | **Sources monitored:** ' || source_count
    || ' | **Items fetched:** ' || item_count || chr(10) || chr(10) || '---' || chr(10) || chr(10)
    || CASE WHEN item_count = 0 THEN '_No new items found across monitored sources for this period._' ELSE '' END
  ELSE
    '# Press Highlights — ' || strftime(run_date, '%B %d, %Y') || chr(10) || '**Sources monitored:** '
    || source_count || ' | **Items fetched:** ' || item_count || chr(10) || chr(10) || '---' || chr(10) || chr(10)
    || CASE WHEN item_count = 0 THEN '_No new releases were found in the last 24 hours._' ELSE '' END
  END AS header
FROM digest_runs"""

_ORDERED = """,
ordered AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY digest_type
                 ORDER BY pub_ts DESC NULLS LAST, source_idx, pos) AS BIGINT) AS item_no
  FROM gated)"""

_ORG_LINE = ("'[Item ' || item_no || ']' || chr(10) || 'Org: ' || org || chr(10) || 'Category: ' || category "
             "|| chr(10) || 'Source: ' || source_name || chr(10) || 'Title: ' || title || chr(10) "
             "|| 'Published: ' || published || chr(10) || 'Link: ' || link || chr(10) || 'Summary: ' "
             "|| CASE WHEN coalesce(summary, '') = '' THEN '(no summary provided)' ELSE summary END "
             "|| chr(10) || chr(10)")
_PRESS_LINE = "'[' || source_name || '] ' || title || chr(10) || summary || chr(10) || link"


def _chunks_sql(line: str, sep: str, where: str) -> str:
    return f"""
SELECT digest_type, CAST(floor((item_no - 1) / 50) AS INTEGER) AS chunk_no,
       min(item_no) AS first_no, max(item_no) AS last_no, count(*) AS n_lines,
       string_agg({line}, {sep} ORDER BY item_no) AS text
FROM ordered WHERE {where}
GROUP BY digest_type, CAST(floor((item_no - 1) / 50) AS INTEGER)"""


ORACLE["org_items_block"] = _fresh_ctes() + _ORDERED + _chunks_sql(_ORG_LINE, "''", "digest_type = 'org'")
ORACLE["press_items_block"] = _fresh_ctes() + _ORDERED + _chunks_sql(
    _PRESS_LINE, "chr(10) || chr(10)", "digest_type = 'press'")

ORACLE["all_items_index"] = _fresh_ctes() + _ORDERED + """
SELECT digest_type, org, CAST(floor((item_no - 1) / 50) AS INTEGER) AS chunk_no,
       min(item_no) AS first_no, max(item_no) AS last_no, count(*) AS n_lines,
       string_agg('- [' || title || '](' || link || ') — ' || org || ' | ' || published, chr(10)
                  ORDER BY item_no) AS text
FROM ordered
GROUP BY digest_type, org, CAST(floor((item_no - 1) / 50) AS INTEGER)"""



def _sized_sql(lines: str, order: str, budget: int, extra: str) -> str:
    """Chunks cut out of the whole text, which is put together first: ``lines`` has digest_type, line, sep and the order."""
    before = f"OVER (PARTITION BY digest_type ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f""",
lines AS ({lines}),
starts AS (SELECT *, coalesce(sum(strlen(line) + strlen(sep)) {before}, 0) AS b, coalesce(sum(length(line) + length(sep)) {before}, 0) AS c FROM lines),
units AS (SELECT *, min(b) OVER (PARTITION BY digest_type, unit) AS u, sum(strlen(line) + strlen(sep)) OVER (PARTITION BY digest_type, unit) AS size FROM starts),
cut AS (SELECT *, CAST(floor(CASE WHEN size <= {budget} THEN u ELSE b END / {budget}) AS INTEGER) AS chunk_no FROM units),
whole AS (SELECT digest_type, string_agg(line || sep, '' ORDER BY {order}) AS text FROM lines GROUP BY digest_type),
parts AS (SELECT digest_type, chunk_no, {extra} count(*) AS n_lines, any_value(sep) AS sep, min(c) AS c, sum(length(line) + length(sep)) - length(any_value(sep)) AS n
          FROM cut GROUP BY digest_type, chunk_no)
SELECT p.* EXCLUDE (sep, c, n), CAST(strlen(substr(w.text, CAST(c + 1 AS BIGINT), CAST(n AS BIGINT))) AS INTEGER) AS n_bytes,
       CASE WHEN chunk_no > 0 THEN sep ELSE '' END AS lead, substr(w.text, CAST(c + 1 AS BIGINT), CAST(n AS BIGINT)) AS text
FROM parts p JOIN whole w ON w.digest_type = p.digest_type"""


ORACLE["items_text"] = _fresh_ctes() + _ORDERED + _sized_sql(
    f"SELECT digest_type, item_no, item_no AS unit, CASE WHEN digest_type = 'org' THEN {_ORG_LINE} ELSE {_PRESS_LINE} END AS line, "
    "CASE WHEN digest_type = 'org' THEN '' ELSE chr(10) || chr(10) END AS sep FROM ordered",
    "item_no", 5000, "min(item_no) AS first_no, max(item_no) AS last_no,")
ORACLE["index_text"] = _fresh_ctes() + _ORDERED + _sized_sql(
    "SELECT digest_type, org, item_no, org AS unit, '- [' || title || '](' || link || ') — ' || org || ' | ' || published AS line, chr(10) AS sep FROM ordered",
    "org, item_no", 5000, "")

ORACLE["curation_request"] = _fresh_ctes() + _ORDERED + """,
blocks AS (""" + _chunks_sql(_ORG_LINE, "''", "digest_type = 'org'") + " UNION ALL " + _chunks_sql(
    _PRESS_LINE, "chr(10) || chr(10)", "digest_type = 'press'") + f"""
)
SELECT '2024-01-05-' || digest_type || '-' || CAST(chunk_no AS VARCHAR) AS request_id,
  digest_type, chunk_no, first_no, last_no, '' AS system,
  CASE WHEN digest_type = 'org' THEN 16000 ELSE 8000 END AS max_tokens,
  CASE WHEN digest_type = 'org' THEN
    'Please write the internal org news digest for 2024-01-05.' || chr(10) || chr(10)
    || 'Total items to process: ' || (SELECT count(*) FROM ordered o WHERE o.digest_type = 'org') || chr(10) || chr(10) || {_RULE60} || chr(10) || text || {_RULE60}
  ELSE
    'Today is January 05, 2024.' || chr(10) || chr(10) || chr(10)
    || 'PERSONAL PREFERENCES (prioritize these above all else):' || chr(10)
    || '- Prefer items that mention que' || chr(10) || chr(10) || text
  END AS user_text
FROM blocks"""

_SOURCES = """,
fixture_sources AS (SELECT DISTINCT digest_type, source_idx, source_name FROM feed_items)"""

ORACLE["source_status"] = _fresh_ctes() + _SOURCES + """,
counts AS (SELECT digest_type, source_idx, count(*) AS n FROM deduped GROUP BY digest_type, source_idx)
SELECT s.digest_type, s.source_idx, s.source_name, coalesce(c.n, 0) AS n_items,
       CASE WHEN coalesce(c.n, 0) > 0 THEN coalesce(c.n, 0) || ' item(s)' ELSE 'nothing new' END AS status
FROM fixture_sources s LEFT JOIN counts c ON c.digest_type = s.digest_type AND c.source_idx = s.source_idx"""

ORACLE["ledger_after_success"] = _fresh_ctes() + _ORDERED + """
SELECT DISTINCT link, digest_type, '2024-01-05' AS first_seen FROM ordered WHERE link <> '' AND digest_type = 'org'"""

ORACLE["digest_rows"] = _fresh_ctes() + _ORDERED + _SOURCES + """,
texts AS (""" + _chunks_sql(_ORG_LINE, "''", "digest_type = 'org'") + """),
n AS (SELECT CAST(count(*) AS INTEGER) AS items FROM ordered WHERE digest_type = 'org'),
s AS (SELECT CAST(count(*) AS INTEGER) AS sources FROM fixture_sources WHERE digest_type = 'org'),
told AS (SELECT 'org' AS digest_type, '2024-01-05' AS run_date, chunk_no, CAST(count(*) OVER () AS INTEGER) AS n_chunks, s.sources AS source_count, n.items AS item_count,
       md5(rtrim(regexp_replace(CASE WHEN chunk_no = 0 THEN '# Org News Digest — January 2024 **Run date:** 2024-01-05 | **Sources monitored:** ' || s.sources
           || ' | **Items fetched:** ' || n.items || ' --- ' ELSE ' ' END || text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))) AS markdown_md5
FROM texts, n, s)
SELECT *, (SELECT md5(string_agg(markdown_md5, '' ORDER BY chunk_no)) FROM told) AS digest_md5 FROM told"""

_PASSES = """,
turns AS (SELECT conv_id * 100 + turn AS rid, text, CAST(conv_id % 40 AS INTEGER) AS day, CASE WHEN turn % 4 = 1 THEN 'press' ELSE 'org' END AS digest_type
          FROM conversations WHERE role = 'assistant'),
chunks AS (SELECT *, CAST(row_number() OVER (PARTITION BY digest_type, day ORDER BY rid) - 1 AS INTEGER) AS chunk_no,
                  CAST(count(*) OVER (PARTITION BY digest_type, day) AS INTEGER) AS n_chunks FROM turns),
told AS (SELECT *, NOT (chunk_no = 0 AND day % 5 IN (1, 2, 3)) AND length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) > 0 AS usable FROM chunks),
settled AS (SELECT digest_type, day, CAST(DATE '2024-01-01' + day AS DATE) AS run_date, max(n_chunks) AS n_chunks, CAST(count(*) FILTER (WHERE usable) AS INTEGER) AS n_usable,
                   bool_and(usable) AS done FROM told GROUP BY digest_type, day),
pass_items AS (SELECT digest_type, CAST(DATE '2024-01-01' + CAST(doc_id % 40 AS INTEGER) AS DATE) AS run_date, link FROM feed_items),
pass_totals AS (SELECT digest_type, run_date, CAST(count(*) % 18 + 1 AS INTEGER) AS source_count, CAST(count(*) AS INTEGER) AS item_count FROM pass_items GROUP BY 1, 2)"""

ORACLE["stream_passes"] = with_views(FEED_ITEMS) + _PASSES + """
SELECT s.digest_type, CAST(s.run_date AS VARCHAR) AS run_date, CASE WHEN done THEN 'done' ELSE 'given_up' END AS status, n_chunks, n_usable,
       CASE WHEN done AND t.item_count IS NOT NULL THEN CAST(n_chunks AS BIGINT) ELSE 0 END AS n_rows, CASE WHEN done THEN coalesce(l.n, 0) ELSE 0 END AS n_links
FROM settled s LEFT JOIN pass_totals t ON t.digest_type = s.digest_type AND t.run_date = s.run_date
LEFT JOIN (SELECT digest_type, run_date, count(DISTINCT link) AS n FROM pass_items WHERE link <> '' GROUP BY 1, 2) l
  ON l.digest_type = s.digest_type AND l.run_date = s.run_date"""

ORACLE["stream_pass_runs"] = with_views(FEED_ITEMS) + _PASSES + f"""
SELECT s.digest_type, CAST(s.run_date AS VARCHAR) AS run_date, c.chunk_no, c.n_chunks, t.source_count, t.item_count,
  md5(CASE WHEN c.chunk_no > 0 THEN chr(10) || chr(10)
           WHEN s.digest_type = 'org' THEN '# Org News Digest — ' || strftime(s.run_date, '%B %Y') || chr(10) || '**Run date:** ' || strftime(s.run_date, '%Y-%m-%d')
             || ' | **Sources monitored:** ' || t.source_count || ' | **Items fetched:** ' || t.item_count || chr(10) || chr(10) || '---' || chr(10) || chr(10)
           ELSE '# Press Highlights — ' || strftime(s.run_date, '%B %d, %Y') || chr(10) || '**Sources monitored:** ' || t.source_count
             || ' | **Items fetched:** ' || t.item_count || chr(10) || chr(10) || '---' || chr(10) || chr(10) END
      || CASE WHEN s.digest_type = 'org' THEN {py_strip('c.text')} ELSE c.text END) AS markdown_md5
FROM settled s JOIN told c ON c.digest_type = s.digest_type AND c.day = s.day
JOIN pass_totals t ON t.digest_type = s.digest_type AND t.run_date = s.run_date WHERE s.done"""

ORACLE["pass_totals"] = _fresh_ctes() + _SOURCES + """
SELECT s.digest_type, s.source_count, g.item_count FROM
  (SELECT digest_type, CAST(count(*) AS INTEGER) AS source_count FROM fixture_sources GROUP BY 1) s
  JOIN (SELECT digest_type, CAST(count(*) AS INTEGER) AS item_count FROM gated GROUP BY 1) g
  ON s.digest_type = g.digest_type"""

# ---------------------------------------------------------------- curation

_RULES_SQL = """,
rules AS (
  SELECT * FROM (VALUES
    ('prefer', 'que', NULL, 2, 0), ('seek', 'the', NULL, 1, 0), ('seek', 'ung', NULL, 1, 0),
    ('less', 'aux', NULL, -1, 0), ('skip', 'zz', NULL, 0, 0), ('skip', 'mit', NULL, 0, 0),
    ('category', 'ción', 'Spanish', 0, 1), ('category', 'der', 'German', 0, 2),
    ('category', 'les', 'French', 0, 3), ('category', 'and', 'English', 0, 4))
    AS t(kind, term, label, weight, priority)),
hits AS (
  SELECT o.digest_type, o.item_no, r.kind, r.term, r.label, r.weight, r.priority
  FROM ordered o JOIN rules r
    ON contains(lower(coalesce(o.title, '') || ' ' || coalesce(o.summary, '')), r.term)),
scored AS (
  SELECT o.digest_type, o.item_no, o.org,
    CAST(coalesce(sum(h.weight) FILTER (WHERE h.kind IN ('prefer', 'seek', 'less')), 0) AS INTEGER) AS score,
    coalesce(bool_or(h.kind = 'skip'), false) AND NOT coalesce(bool_or(h.kind = 'prefer'), false) AS dropped
  FROM ordered o LEFT JOIN hits h ON h.digest_type = o.digest_type AND h.item_no = o.item_no
  GROUP BY o.digest_type, o.item_no, o.org),
tgt AS (
  SELECT digest_type, greatest(10, least(count(*) FILTER (WHERE NOT dropped), 20,
    greatest(15, count(*) FILTER (WHERE NOT dropped AND score > 0)))) AS n_target
  FROM scored GROUP BY digest_type),
picks AS (
  SELECT * FROM (
    SELECT l.*, CAST(row_number() OVER (PARTITION BY l.digest_type ORDER BY l.dropped, l.score DESC, l.item_no)
                     AS BIGINT) AS pick_rank
    FROM scored l) r
  WHERE pick_rank <= (SELECT n_target FROM tgt WHERE tgt.digest_type = r.digest_type))"""

_CUR = _fresh_ctes() + _ORDERED + _RULES_SQL

ORACLE["rule_score"] = _CUR + "\nSELECT digest_type, item_no, score, dropped FROM scored"
ORACLE["top_with_floor"] = _CUR + "\nSELECT digest_type, pick_rank, item_no, score FROM picks"
ORACLE["categorise"] = _CUR + """,
cats AS (
  SELECT p.digest_type, p.pick_rank,
         coalesce((SELECT arg_min(h.label, h.priority) FROM hits h
                   WHERE h.kind = 'category' AND h.digest_type = p.digest_type AND h.item_no = p.item_no),
                  'General') AS category
  FROM picks p)
SELECT digest_type, category, count(*) AS n_picks, min(pick_rank) AS first_rank
FROM cats GROUP BY digest_type, category"""
ORACLE["org_groups"] = _CUR + """
SELECT digest_type, org, count(*) AS n_picks, min(pick_rank) AS best_rank FROM picks GROUP BY digest_type, org"""

_TERMS = r"[^\p{L}]+"


def _terms_sql(src: str, text: str, keys: str, min_len: int) -> str:
    return (f"SELECT DISTINCT {keys}, term FROM (SELECT {keys}, "
            f"unnest(list_distinct(regexp_split_to_array(lower(coalesce({text}, '')), '{_TERMS}'))) AS term "
            f"FROM {src}) WHERE length(term) >= {min_len}")


_WHOLE_SUMMARY = f"trim(regexp_replace(regexp_replace(coalesce(nullif(f.summary, ''), nullif(f.description, ''), ''), '<[^>]+>', ' ', 'g'), '{WS}+', ' ', 'g'), ' ')"
_CANDS = f""",
whole_items AS (SELECT o.digest_type, o.item_no, o.org, coalesce(f.title, '') || ' ' || {_WHOLE_SUMMARY} AS whole_text
                FROM ordered o JOIN feed_items f ON f.digest_type = o.digest_type AND f.source_idx = o.source_idx AND f.pos = o.pos),
item_terms AS ({_terms_sql('whole_items', "whole_text", 'digest_type, item_no, org', 4)}),
cands AS (
  SELECT digest_type, term, count(*) AS n_items, count(DISTINCT org) AS n_orgs
  FROM item_terms GROUP BY digest_type, term
  HAVING count(*) >= 2 AND count(DISTINCT org) >= 2)"""

# crc32 by a table of 256 remainders of the reflected polynomial 0xEDB88320
_CRC32 = """xor(4294967295, list_reduce(list_transform(range(1, strlen(term) + 1), lambda i: CAST(('0x' || substr(hex(encode(term)), 2 * i - 1, 2)) AS BIGINT)),
    lambda c, b: xor(c // 256, t[1 + CAST(xor(c % 256, b) AS INTEGER)]), CAST(4294967295 AS BIGINT)))"""
ORACLE["rules_table_score"] = _fresh_ctes() + _ORDERED + f""",
crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, i)) AS t),
words AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}]+')) AS term FROM conversations),
hashed AS (SELECT term, CASE WHEN term = '' THEN 0 ELSE {_CRC32} END AS h FROM words, crc),
many AS (SELECT ['prefer', 'seek', 'less', 'skip', 'category'][CAST(h % 5 AS INTEGER) + 1] AS kind, term, 'about ' || term AS label,
                CAST(h % 4 - 1 AS INTEGER) AS weight, CAST(h % 1000003 AS INTEGER) AS priority FROM hashed),
hit AS (SELECT o.digest_type, o.item_no, r.* FROM ordered o JOIN many r ON contains(lower(coalesce(title, '') || ' ' || coalesce(summary, '')), r.term))
SELECT o.digest_type, o.item_no, CAST(coalesce(sum(h.weight) FILTER (WHERE h.kind IN ('prefer', 'seek', 'less')), 0) AS INTEGER) AS score,
       coalesce(bool_or(h.kind = 'skip'), false) AND NOT coalesce(bool_or(h.kind = 'prefer'), false) AS dropped,
       coalesce(arg_min(h.label, struct_pack(p := h.priority, l := h.label)) FILTER (WHERE h.kind = 'category'), 'General') AS category
FROM ordered o LEFT JOIN hit h ON h.digest_type = o.digest_type AND h.item_no = o.item_no GROUP BY o.digest_type, o.item_no"""

ORACLE["cross_item_themes"] = _fresh_ctes() + _ORDERED + _CANDS + """
SELECT digest_type, theme_rank, term, n_items, n_orgs FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY digest_type ORDER BY n_items DESC, term) AS INTEGER) AS theme_rank
  FROM cands) WHERE theme_rank <= 5"""

ORACLE["unpitched_themes"] = _fresh_ctes() + _ORDERED + _CANDS + ",\n" + DIGEST_RUNS.strip() + f""",
pitched AS ({_terms_sql('digest_runs', 'feature_pitch_raw', 'digest_type', 4)})
SELECT c.digest_type, c.term, c.n_items, c.n_orgs FROM cands c
WHERE NOT EXISTS (SELECT 1 FROM pitched p WHERE p.digest_type = c.digest_type AND p.term = c.term)"""

ORACLE["run_continuity"] = with_views(DIGEST_RUNS) + f""",
seqd AS (
  SELECT id, digest_type, markdown,
         row_number() OVER (PARTITION BY digest_type ORDER BY run_date, created_at, id) AS seq
  FROM digest_runs),
rt AS ({_terms_sql('seqd', 'markdown', 'digest_type, seq', 4)}),
j AS (
  SELECT coalesce(c.digest_type, p.digest_type) AS digest_type,
         coalesce(c.seq, p.seq + 1) AS seq, coalesce(c.term, p.term) AS term,
         CASE WHEN c.term IS NOT NULL AND p.term IS NOT NULL THEN 'continuing'
              WHEN c.term IS NOT NULL THEN 'new' ELSE 'dropped' END AS status
  FROM rt c FULL OUTER JOIN rt p
    ON c.digest_type = p.digest_type AND c.seq = p.seq + 1 AND c.term = p.term)
SELECT digest_type, CAST(seq AS BIGINT) AS seq, term, status FROM j
WHERE seq > 1 AND EXISTS (SELECT 1 FROM seqd s WHERE s.digest_type = j.digest_type AND s.seq = j.seq)"""

ORACLE["thread_memory"] = with_views(DIGEST_RUNS) + f""",
rt AS ({_terms_sql('digest_runs', 'markdown', 'digest_type, id, run_date', 4)}),
agg AS (
  SELECT digest_type, term, count(DISTINCT id) AS n_runs, max(run_date) AS last_seen
  FROM rt GROUP BY digest_type, term
  HAVING max(run_date) >= DATE '2024-02-10' - 14),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY digest_type
                 ORDER BY n_runs DESC, last_seen DESC, term) AS INTEGER) AS rank
  FROM agg)
SELECT digest_type, rank, term,
       CASE WHEN n_runs >= 2 THEN 'established' ELSE 'emerging' END AS status,
       n_runs, CAST(last_seen AS VARCHAR) AS last_seen
FROM ranked WHERE rank <= 12"""

_AUDIT = with_views(FEED_ITEMS, MARKDOWN_DOCS) + r""",
items AS (
  SELECT source_name AS run_id, doc_id, entry_id,
         CASE WHEN author = 'fr' AND link <> '' THEN link || '?ref=feed' ELSE link END AS link
  FROM feed_items),
docs AS (
  SELECT i.run_id, m.markdown FROM markdown_docs m JOIN items i ON i.doc_id = m.doc_id),
urls AS (
  SELECT DISTINCT run_id, unnest(regexp_extract_all(markdown, '\]\(([^)\s]+)\)', 1)) AS url FROM docs)"""

ORACLE["index_audit"] = _AUDIT + """
SELECT i.run_id, i.entry_id, i.link FROM items i
WHERE i.link <> '' AND NOT EXISTS (SELECT 1 FROM urls u WHERE u.run_id = i.run_id AND u.url = i.link)"""

ORACLE["kept_ratio"] = _AUDIT + """
SELECT run_id, count(*) AS fetched,
       count(*) FILTER (WHERE link <> '' AND EXISTS (
         SELECT 1 FROM urls u WHERE u.run_id = items.run_id AND u.url = items.link)) AS kept
FROM items GROUP BY run_id"""

# ---------------------------------------------------------------- run sections

ORACLE["run_sections"] = _RESP + f""",
vis AS (
  SELECT request_id,
    CASE WHEN has_memory
         THEN regexp_replace(substr(body, 1, strpos(body, '```digest_memory') - 1), '{WS}+$', '')
         ELSE body END AS visible
  FROM scored),
{_section_sql('visible', 'Trends & Continuity', 'trends_raw').strip()},
{_section_sql('visible', 'Bigger Picture: Feature Pitch', 'feature_pitch_raw').strip()},
""" + DIGEST_RUNS.strip() + """
SELECT d.id, d.digest_type, s.outcome,
       CASE WHEN s.outcome IN ('ok', 'truncated') THEN t.trends_raw END AS trends_raw,
       CASE WHEN s.outcome IN ('ok', 'truncated') THEN p.feature_pitch_raw END AS feature_pitch_raw
FROM digest_runs d
LEFT JOIN scored s ON s.request_id = d.id
LEFT JOIN sec_trends_raw t ON t.request_id = d.id
LEFT JOIN sec_feature_pitch_raw p ON p.request_id = d.id"""
