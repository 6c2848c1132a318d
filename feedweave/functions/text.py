"""Column expressions for feed text: keys, dates, cleaning, labels.

All helpers return ``Column`` objects built from ``pyspark.sql.functions`` so
they stay inside whole-stage codegen; none of them is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace set of Python's ``str.isspace`` / ``re`` ``\s``
# (Unicode), written as one character class that both Java regex and RE2 accept.
# Java's ``\s`` is ASCII-only and ``(?U)\s`` misses U+001C..U+001F.
PY_WS_CLASS = (
    r"[\t\n\x0b\x0c\r\x1c-\x1f \x85\xa0\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
PY_WS_RUN = PY_WS_CLASS + "+"
# The same set as plain characters, derived from Python's own rule, for ``btrim``.
PY_WS_CHARS = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())

# Summary cap, source-filter prefix length, undated label.
SUMMARY_MAX_CHARS = 600
FILTER_PREFIX_CHARS = 500
DATE_UNKNOWN = "Date unknown"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_strip(col) -> Column:
    """``str.strip()`` with Python's Unicode whitespace set (Spark ``trim`` only drops U+0020).

    ``btrim`` with an explicit character set: a per-end character scan, no regex.
    """
    return F.btrim(_c(col), F.lit(PY_WS_CHARS))


def empty_to_null(col) -> Column:
    """Python truthiness for strings: ``''`` behaves like a missing value."""
    c = _c(col)
    return F.when(c == "", F.lit(None)).otherwise(c)


def first_truthy(*cols) -> Column:
    """``a or b or c`` for strings: the first non-NULL, non-empty value, else ``''``."""
    return F.coalesce(*[empty_to_null(c) for c in cols], F.lit(""))


def entry_key(link, entry_id, title) -> Column:
    """In-run identity: md5 of the stripped, lower-cased first truthy of link, id, title.

    The fallback runs *before* the strip, so a whitespace-only link wins and
    hashes like an empty entry (both become ``md5('')``).
    """
    raw = first_truthy(link, entry_id, title)
    return F.md5(F.lower(py_strip(raw)))


def clean_html(col, max_chars: int | None = SUMMARY_MAX_CHARS) -> Column:
    """Tags to a space, whitespace runs to one space, strip, keep ``max_chars`` code points (None: all).

    Only tags are removed: script/style bodies stay and entities are not decoded.
    Truncation is last, so a trailing space may remain.
    """
    no_tags = F.regexp_replace(F.coalesce(_c(col), F.lit("")), "<[^>]+>", " ")
    collapsed = F.regexp_replace(no_tags, PY_WS_RUN, " ")
    whole = F.trim(collapsed)
    return whole if max_chars is None else F.substring(whole, 1, max_chars)


def summary_fallback(summary, description) -> Column:
    """``summary or description or ''``."""
    return first_truthy(summary, description)


def published_label(ts) -> Column:
    return F.coalesce(F.date_format(_c(ts), "yyyy-MM-dd"), F.lit(DATE_UNKNOWN))


def filter_haystack(author, summary, description, title) -> Column:
    """Lower-cased text a source filter term is looked for in (raw, uncleaned).

    The author is used whole; the three longer fields contribute their first
    500 characters.
    """
    parts = [F.coalesce(_c(author), F.lit(""))] + [
        F.substring(F.coalesce(_c(x), F.lit("")), 1, FILTER_PREFIX_CHARS)
        for x in (summary, description, title)
    ]
    return F.lower(F.concat_ws(" ", *parts))


def passes_source_filter(terms, haystack) -> Column:
    """Empty or missing term list passes; otherwise any term is a case-insensitive substring."""
    t = _c(terms)
    h = _c(haystack)
    return (F.coalesce(F.size(t), F.lit(0)) <= 0) | F.exists(
        t, lambda term: F.contains(h, F.lower(term)))


# Timestamp layouts tried for a feed date string, in order.
# RFC-822 (weekday stripped, year of four digits), ISO-8601 variants (no fraction), plain date.
ENTRY_DATE_FORMATS = (
    "d MMM yyyy HH:mm[:ss] xx",
    "d MMM yyyy HH:mm[:ss] z",
    "d MMM yyyy HH:mm[:ss]",
    "yyyy-MM-dd'T'HH:mm[:ss]XXX",
    "yyyy-MM-dd'T'HH:mm[:ss]xx",
    "yyyy-MM-dd'T'HH:mm[:ss]",
    "yyyy-MM-dd",
)


def parse_feed_date(col) -> Column:
    """One date string to a UTC timestamp truncated to whole seconds, NULL if unusable.

    A weekday (short or long) may come first; without a zone the time is UTC.
    Years of two digits are 1990 to 2089.
    """
    s = py_strip(_c(col))
    s = F.regexp_replace(s, r"^[A-Za-z]+,\s*", "")
    s = F.regexp_replace(s, r"^(\d{1,2} [A-Za-z]{3}) (9\d) ", "$1 19$2 ")
    s = F.regexp_replace(s, r"^(\d{1,2} [A-Za-z]{3}) (\d{2}) ", "$1 20$2 ")
    s = F.regexp_replace(s, r"^(\d{4}-\d{2}-\d{2}) +(\d{2}:)", "$1T$2")
    s = F.regexp_replace(s, r"(\d{2}:\d{2}:\d{2})[.,]\d+", "$1")
    s = empty_to_null(s)
    tries = [F.try_to_timestamp(s, F.lit(fmt)) for fmt in ENTRY_DATE_FORMATS]
    return F.date_trunc("second", F.coalesce(*tries))


def entry_date(published, updated, created) -> Column:
    """First usable of published, updated, created; a malformed candidate falls through."""
    return F.coalesce(parse_feed_date(published), parse_feed_date(updated),
                      parse_feed_date(created))
