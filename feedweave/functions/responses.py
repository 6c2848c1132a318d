"""Column expressions over generated-response rows and their text.

A response row carries ordered content blocks ``array<struct<type,text>>``,
``stop_reason``, an HTTP ``status_code`` and a ``connection_error`` flag.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedweave.functions.text import PY_WS_CLASS, py_strip

# Section headings and the memory fence of the generated text.
TRENDS_HEADING = "Trends & Continuity"
PITCH_HEADING = "Bigger Picture: Feature Pitch"
MEMORY_FENCE = "```digest_memory"

_MEMORY_RE = "(?s)```digest_memory" + PY_WS_CLASS + "*(.*?)```"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def response_text(blocks) -> Column:
    """Concatenate the ``text`` blocks in order, skipping thinking and other blocks (I8)."""
    texts = F.filter(_c(blocks), lambda b: b["type"] == "text")
    return F.array_join(F.transform(texts, lambda b: F.coalesce(b["text"], F.lit(""))), "")


def is_blank(text) -> Column:
    return py_strip(F.coalesce(_c(text), F.lit(""))) == ""


def triage(text, stop_reason, status_code, connection_error) -> Column:
    """Outcome of one model call.

    ``transient``: connection failure, 429 or >= 500 (retry); ``fatal``: any other
    error status; ``refused``: the model declined; ``empty``: no usable text;
    ``truncated``: hit the token budget but kept; ``ok`` otherwise.
    """
    status = _c(status_code)
    failed_status = status.isNotNull() & ((status < 200) | (status >= 300))
    return (F.when(F.coalesce(_c(connection_error), F.lit(False)), F.lit("transient"))
            .when(failed_status & ((status == 429) | (status >= 500)), F.lit("transient"))
            .when(failed_status, F.lit("fatal"))
            .when(_c(stop_reason) == "refusal", F.lit("refused"))
            .when(is_blank(text), F.lit("empty"))
            .when(_c(stop_reason) == "max_tokens", F.lit("truncated"))
            .otherwise(F.lit("ok")))


def has_memory(body) -> Column:
    return _c(body).rlike(_MEMORY_RE)


def memory_block(body) -> Column:
    """Stripped content of the first *closed* ``digest_memory`` fence, NULL if none."""
    b = _c(body)
    return F.when(has_memory(b), py_strip(F.regexp_extract(b, _MEMORY_RE, 1)))


def visible_body(body) -> Column:
    """Text before the memory fence, right-stripped; unchanged if no closed fence.

    The leftmost closed fence always starts at the first fence marker, so the
    cut is "from the first marker to the end".
    """
    b = _c(body)
    cut = F.regexp_replace(b, "(?s)```digest_memory.*", "")
    return F.when(has_memory(b), F.regexp_replace(cut, PY_WS_CLASS + "+$", "")).otherwise(b)


def named_section(body, heading: str) -> Column:
    """Text under ``## heading`` up to the next ``\\n## `` or the end, stripped; ``''`` if absent.

    Same greedy ``\\s*\\n`` as the original pattern: an empty section swallows
    the next heading and its text.
    """
    pattern = ("(?msd)^## " + _quote(heading) + PY_WS_CLASS + "*\\n(.*?)(?=\\n## |\\z)")
    b = _c(body)
    return F.when(b.rlike(pattern), py_strip(F.regexp_extract(b, pattern, 1))).otherwise(F.lit(""))


def _quote(s: str) -> str:
    return "".join("\\" + ch if ch in r"\.^$|?*+()[]{}" else ch for ch in s)
