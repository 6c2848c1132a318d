"""DuckDB formulations of the fixture views (FIXTURES.md §2), as SQL CTE text.

The oracle queries in ``feedweave.plans.oracle`` prepend these to read the same
pre-registered tables.  They are written independently of the Spark builders in
``feedweave.sources.fixtures``; only the mapping rules are shared.
"""

from __future__ import annotations

# Python's Unicode whitespace class, spelled for RE2.
WS = (r"[\t\n\x0b\x0c\r\x1c-\x1f \x85\xa0\x{1680}\x{2000}-\x{200a}"
      r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")


def py_strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^{WS}+|{WS}+$', '', 'g')"


def clean_html(expr: str) -> str:
    inner = f"regexp_replace(regexp_replace(coalesce({expr}, ''), '<[^>]+>', ' ', 'g'), '{WS}+', ' ', 'g')"
    return f"substr(trim({inner}, ' '), 1, 600)"


def ts_text(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


FEED_ITEMS = r"""
feed_items_raw AS (
  SELECT
    CASE WHEN CAST(substr(source, 4) AS INTEGER) < 6 THEN 'press' ELSE 'org' END AS digest_type,
    CAST(floor(doc_id / 1000) AS INTEGER) * 20 + CAST(substr(source, 4) AS INTEGER) AS source_idx,
    doc_id,
    source || '-' || CAST(CAST(floor(doc_id / 1000) AS INTEGER) AS VARCHAR) AS source_name,
    source AS org,
    CASE WHEN CAST(substr(source, 4) AS INTEGER) < 6 THEN 'Press Releases'
         ELSE 'Industry & Advocacy' END AS category,
    CASE WHEN CAST(substr(source, 4) AS INTEGER) >= 6
          AND (CAST(floor(doc_id / 1000) AS INTEGER) * 20 + CAST(substr(source, 4) AS INTEGER)) % 2 = 1
         THEN ['que'] ELSE CAST([] AS VARCHAR[]) END AS source_filter,
    CASE WHEN doc_id % 23 = 0 THEN ''
         ELSE (CASE WHEN doc_id % 2 = 0 THEN 'https://Feeds.example/' ELSE 'https://feeds.example/' END)
              || md5(text) END AS link,
    'id-' || CAST(doc_id AS VARCHAR) AS entry_id,
    substr(text, 1, 80) AS title,
    text AS summary,
    CAST(NULL AS VARCHAR) AS description,
    lang AS author,
    CASE WHEN doc_id % 17 = 0 THEN CAST(NULL AS TIMESTAMP)
         ELSE TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST((doc_id * 37) % 96 AS BIGINT)) END AS pub_ts
  FROM documents
),
feed_items AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY source_idx ORDER BY doc_id) - 1 AS INTEGER) AS pos
  FROM feed_items_raw
)"""

SETTINGS = r"""
settings AS (
  SELECT * FROM (VALUES ('org', 2, 40, 1, 7), ('press', 1, 60, 1, 7))
    AS t(digest_type, days_back, max_items_per_source, min_items_to_send, dedup_days)
)"""

SEEN_LEDGER = r"""
seen_ledger AS (
  SELECT digest_type, link, min(DATE '2024-01-05' - CAST(doc_id % 8 AS INTEGER)) AS first_seen
  FROM feed_items
  WHERE doc_id % 5 = 0 AND link <> ''
  GROUP BY digest_type, link
)"""

SIGHTINGS = r"""
sightings AS (
  SELECT DISTINCT event_type AS digest_type, props AS link, CAST(ts AS DATE) AS run_date
  FROM events
)"""

DIGEST_RUNS = r"""
digest_runs AS (
  SELECT
    conv_id * 100 + turn AS id,
    CAST(DATE '2024-01-01' + CAST(conv_id % 40 AS INTEGER) AS DATE) AS run_date,
    CASE WHEN turn % 2 = 0 THEN 'press' ELSE 'org' END AS digest_type,
    CAST(conv_id % 18 + 1 AS INTEGER) AS source_count,
    CAST(length(text) % 60 AS INTEGER) AS item_count,
    text AS markdown,
    CASE WHEN turn % 3 = 0 THEN CAST(NULL AS VARCHAR) WHEN turn % 3 = 1 THEN ''
         ELSE '- **Developing threads** ' || text END AS trends_raw,
    CASE WHEN conv_id % 5 = 0 THEN CAST(NULL AS VARCHAR)
         ELSE '**The pattern:** ' || text END AS feature_pitch_raw,
    CAST(DATE '2024-01-01' + CAST(conv_id % 40 AS INTEGER) AS TIMESTAMP)
      + to_minutes(CAST(conv_id * 100 + turn AS BIGINT)) AS created_at
  FROM conversations
)"""

MARKDOWN_DOCS = r"""
markdown_docs AS (
  SELECT doc_id,
         '## ' || org || chr(10)
         || '- **' || title || '** — ' || substr(summary, 1, 60) || ' [' || org || '](' || link || ')' || chr(10)
         || '---' || chr(10)
         || '* *' || author || '* [[Wire]](' || link || ')' || chr(10)
         || summary AS markdown
  FROM feed_items
)"""

RESPONSES = r"""
responses_base AS (
  SELECT conv_id, turn, text,
    CASE WHEN conv_id % 11 = 0 THEN ''
         WHEN conv_id % 13 = 0 THEN '## Trends & Continuity' || chr(10) || chr(10)
         ELSE '## Trends & Continuity' || chr(10) || text || chr(10) || chr(10) END
    || '## Bigger Picture: Feature Pitch' || chr(10) || '**The pattern:** ' || text AS first_part,
    CASE WHEN conv_id % 3 = 0 THEN chr(10) || chr(10) || '```digest_memory' || chr(10)
                                   || '## Established patterns' || chr(10) || '- ' || text
                                   || chr(10) || '```' || chr(10) || 'Trailing note.'
         WHEN conv_id % 7 = 0 THEN chr(10) || chr(10) || '```digest_memory' || chr(10) || '- open ' || text
         ELSE '' END AS fence_part
  FROM conversations
  WHERE role = 'assistant'
),
responses AS (
  SELECT
    conv_id * 100 + turn AS request_id,
    CASE WHEN turn % 4 = 1 THEN 'press' ELSE 'org' END AS digest_type,
    CASE WHEN conv_id % 31 = 0 THEN [{'type': 'thinking', 'text': 'only thoughts'},
                                     {'type': 'text', 'text': '  ' || chr(10) || ' '}]
         WHEN conv_id % 2 = 0 THEN [{'type': 'thinking', 'text': 'considering'},
                                    {'type': 'text', 'text': first_part},
                                    {'type': 'text', 'text': fence_part}]
         ELSE [{'type': 'text', 'text': first_part}, {'type': 'text', 'text': fence_part}] END AS blocks,
    CASE WHEN conv_id % 5 = 0 THEN 'max_tokens' WHEN conv_id % 5 = 1 THEN 'refusal'
         ELSE 'end_turn' END AS stop_reason,
    CASE WHEN conv_id % 17 = 0 THEN 429 WHEN conv_id % 19 = 0 THEN 503
         WHEN conv_id % 23 = 0 THEN 400 ELSE 200 END AS status_code,
    conv_id % 29 = 0 AS connection_error
  FROM responses_base
)"""


def with_views(*views: str) -> str:
    return "WITH " + ",\n".join(v.strip() for v in views) + "\n"
