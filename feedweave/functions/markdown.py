"""Markdown structure as tables: line blocks, inline spans, links.

The rules are the export's: split on ``\\n``, trim (JavaScript whitespace),
skip blank lines and ``---``, then heading (1-4 ``#``), bullet (``-``/``*``) or
paragraph; inline text is cut into bold / italic / link / plain spans by one
alternation (bold before italic before link), delimiters kept.

Everything is built-in expressions plus ``posexplode``; no UDF.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# JavaScript ``String.prototype.trim`` / ``\s`` whitespace set.
JS_WS_CLASS = (r"[\t\n\x0b\x0c\r \xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
               r"\x{202f}\x{205f}\x{3000}\x{feff}]")
JS_WS_CHARS = ("\t\n\x0b\x0c\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b)))
               + "\u2028\u2029\u202f\u205f\u3000\ufeff")
# JavaScript ``.``: anything but a line terminator.
JS_DOT = r"[^\n\r\x{2028}\x{2029}]"

HEADING_RE = r"^(#{1,4})" + JS_WS_CLASS + r"+(" + JS_DOT + r"*)\z"
BULLET_RE = r"^[-*]" + JS_WS_CLASS + r"+(" + JS_DOT + r"*)\z"
# The inline span alternation and the per-kind shapes.
SPAN_SPLIT_RE = r"(\*\*[^*]+?\*\*|\*[^*]+?\*|\[[^\]]*?\]\([^)]*?\))"
BOLD_RE = r"^\*\*([^*]+)\*\*\z"
LINK_RE = r"^\[([^\]]*)\]\(([^)]*)\)\z"
ITALIC_RE = r"^\*([^*]+)\*\z"
# Wider URL pattern used by audits: any ``](url)``, so ``[[Wire]](url)`` counts too.
ANY_URL_RE = r"\]\(([^)\s]+)\)"

_MARK = "\u0001"


def js_trim(col) -> Column:
    """``String.prototype.trim``: ``btrim`` with the JavaScript whitespace characters."""
    c = F.col(col) if isinstance(col, str) else col
    return F.btrim(c, F.lit(JS_WS_CHARS))


def line_blocks(df: DataFrame, text_col: str, key_cols: list[str]) -> DataFrame:
    """One row per kept line: ``key..., line_no, kind, level, text`` (I4).

    ``kind`` is ``heading`` (with ``level`` 1-4), ``bullet`` or ``paragraph``.
    """
    lines = df.select(*key_cols, F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")),
                                                      "\n", -1)).alias("line_no", "raw"))
    t = lines.select(*key_cols, "line_no", js_trim("raw").alias("line"))
    kept = t.filter((F.col("line") != "") & (F.col("line") != "---"))
    # cheap first-character guards keep the anchored regexes off most lines
    line = F.col("line")
    is_head = line.startswith("#") & line.rlike(HEADING_RE)
    is_bullet = (line.startswith("-") | line.startswith("*")) & line.rlike(BULLET_RE)
    return kept.select(
        *key_cols, "line_no",
        F.when(is_head, F.lit("heading")).when(is_bullet, F.lit("bullet"))
        .otherwise(F.lit("paragraph")).alias("kind"),
        F.when(is_head, F.length(F.regexp_extract("line", HEADING_RE, 1))).cast("int").alias("level"),
        F.when(is_head, F.regexp_extract("line", HEADING_RE, 2))
        .when(is_bullet, F.regexp_extract("line", BULLET_RE, 1))
        .otherwise(F.col("line")).alias("text"),
    )


def split_spans(text) -> Column:
    """Array of span strings, delimiters kept, empties dropped (the export's split)."""
    c = F.col(text) if isinstance(text, str) else text
    marked = F.regexp_replace(c, SPAN_SPLIT_RE, _MARK + "$1" + _MARK)
    parts = F.filter(F.split(marked, _MARK, -1), lambda p: p != "")
    # an empty text still yields one empty plain span; text without any span
    # delimiter is one plain span, so the alternation only runs where it can match
    has_marks = F.contains(c, F.lit("*")) | F.contains(c, F.lit("["))
    return (F.when(F.coalesce(c, F.lit("")) == "", F.array(F.lit("")))
            .when(has_marks, F.when(F.size(parts) == 0, F.array(F.lit(""))).otherwise(parts))
            .otherwise(F.array(c)))


def inline_spans(blocks: DataFrame, key_cols: list[str]) -> DataFrame:
    """One row per inline span of each block: ``key..., span_no, kind, text, href``."""
    parts = blocks.select(*key_cols, F.posexplode(split_spans("text")).alias("span_no", "part"))
    p = F.col("part")
    starts_star, starts_bracket = p.startswith("*"), p.startswith("[")
    is_bold = starts_star & p.rlike(BOLD_RE)
    is_link = starts_bracket & p.rlike(LINK_RE)
    is_italic = starts_star & p.rlike(ITALIC_RE)
    return parts.select(
        *key_cols, "span_no",
        F.when(is_bold, F.lit("bold")).when(is_link, F.lit("link"))
        .when(is_italic, F.lit("italic")).otherwise(F.lit("plain")).alias("kind"),
        F.when(is_bold, F.regexp_extract(p, BOLD_RE, 1))
        .when(is_link, F.regexp_extract(p, LINK_RE, 1))
        .when(is_italic, F.regexp_extract(p, ITALIC_RE, 1))
        .otherwise(p).alias("text"),
        F.when(~is_bold & is_link, F.regexp_extract(p, LINK_RE, 2)).alias("href"),
    )


def any_urls(df: DataFrame, text_col: str, key_cols: list[str]) -> DataFrame:
    """Every ``](url)`` target in a text, including wire-style ``[[Name]](url)`` (K8 / K9)."""
    return (df.select(*key_cols, F.explode(F.regexp_extract_all(
        F.coalesce(F.col(text_col), F.lit("")), F.lit(ANY_URL_RE), 1)).alias("url"))
        .distinct())


def full_document(markdown, trends_raw, pitch_raw) -> Column:
    """The digest with its optional sections appended as level-2 headings.

    Empty and NULL sections are both skipped.
    """
    def section(heading, col):
        c = F.col(col) if isinstance(col, str) else col
        return F.when(F.coalesce(F.length(c), F.lit(0)) > 0,
                      F.concat(F.lit(f"\n## {heading}\n"), c)).otherwise(F.lit(""))
    md = F.col(markdown) if isinstance(markdown, str) else markdown
    return F.concat(F.coalesce(md, F.lit("")), section("Trends & Continuity", trends_raw),
                    section("Bigger Picture: Feature Pitch", pitch_raw))
