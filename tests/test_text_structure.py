"""Response parsing (Q8) and Markdown tables (Q16)."""

from pyspark.sql import functions as F

from feedweave.functions import markdown as mdf
from feedweave.functions import responses as rsp


# body, memory, trends, pitch: worked out by hand
BODIES = [
    ("## Trends & Continuity\n\n## Bigger Picture: Feature Pitch\nz", None,
     "## Bigger Picture: Feature Pitch\nz", "z"),
    ("## Bigger Picture: Feature Pitch\nonly pitch", None, "", "only pitch"),
    ("## Trends & Continuity\nt1\n\n## Bigger Picture: Feature Pitch\np\n```digest_memory\nopen", None,
     "t1", "p\n```digest_memory\nopen"),
    ("## Trends & Continuity\nt\n## Bigger Picture: Feature Pitch\np\n\n```digest_memory\n- m\n```\nafter", "- m",
     "t", "p"),
    ("intro\n## Trends & Continuity   \n\n  body \n## Other\nx", None, "body", ""),
    ("", None, "", ""),
]


def test_sections_and_memory(spark):
    df = spark.createDataFrame(BODIES, "body string, want_mem string, want_t string, want_p string")
    df = df.withColumn("vis", rsp.visible_body("body"))
    rows = df.select("*", rsp.memory_block("body").alias("mem"),
                     rsp.named_section("vis", rsp.TRENDS_HEADING).alias("t"),
                     rsp.named_section("vis", rsp.PITCH_HEADING).alias("p")).collect()
    assert [(r.mem, r.t, r.p) for r in rows] == [(r.want_mem, r.want_t, r.want_p) for r in rows]


def test_empty_section_swallows_next(spark):
    df = spark.createDataFrame([(BODIES[0][0],)], "b string")
    assert df.select(rsp.named_section("b", rsp.TRENDS_HEADING)).first()[0] == \
        "## Bigger Picture: Feature Pitch\nz"


def test_response_text_and_triage(spark):
    rows = [([("thinking", "x"), ("text", "a"), ("text", "b")], "end_turn", 200, False),
            ([("thinking", "x")], "end_turn", 200, False),
            ([("text", "a")], "max_tokens", 200, False),
            ([("text", "a")], "refusal", 200, False),
            ([], None, 429, False), ([], None, 502, False), ([], None, 400, False),
            ([], None, None, True)]
    df = spark.createDataFrame(rows, "blocks array<struct<type:string,text:string>>, "
                                     "stop_reason string, status_code int, connection_error boolean")
    df = df.withColumn("t", rsp.response_text("blocks"))
    got = [(r.t, r.o) for r in df.select(
        "t", rsp.triage("t", "stop_reason", "status_code", "connection_error").alias("o")).collect()]
    assert got == [("ab", "ok"), ("", "empty"), ("a", "truncated"), ("a", "refused"),
                   ("", "transient"), ("", "transient"), ("", "fatal"), ("", "transient")]


def test_blocks_and_spans(spark):
    md = "\n".join(["# H1", "#####x", "  * item **b**  ", "---", "   ", "para *i* [T](u)",
                    "- **Head** — why. [[Business Wire]](https://x)"])
    df = spark.createDataFrame([(1, md)], "id int, md string")
    blocks = mdf.line_blocks(df, "md", ["id"])
    got = [(r.line_no, r.kind, r.level, r.text) for r in blocks.orderBy("line_no").collect()]
    assert got == [(0, "heading", 1, "H1"), (1, "paragraph", None, "#####x"),
                   (2, "bullet", None, "item **b**"), (5, "paragraph", None, "para *i* [T](u)"),
                   (6, "bullet", None, "**Head** — why. [[Business Wire]](https://x)")]
    spans = mdf.inline_spans(blocks, ["id", "line_no"])
    rows = [(r.line_no, r.kind, r.text, r.href) for r in spans.orderBy("line_no", "span_no").collect()]
    assert (5, "link", "T", "u") in rows and (5, "italic", "i", None) in rows
    assert (2, "bold", "b", None) in rows
    wire = [r for r in rows if r[0] == 6]
    assert [k for _, k, _, _ in wire] == ["bold", "plain"]          # [[Wire]](url) is no link
    urls = [r.url for r in mdf.any_urls(df, "md", ["id"]).collect()]
    assert sorted(urls) == ["https://x", "u"]                       # the audit pattern sees it


def test_block_accounting(spark):
    md = "a\n\n---\n# h\n  \n- b"
    df = spark.createDataFrame([(1, md)], "id int, md string")
    kept = mdf.line_blocks(df, "md", ["id"]).count()
    dropped = sum(1 for ln in md.split("\n") if ln.strip() in ("", "---"))
    assert kept + dropped == len(md.split("\n"))


def test_full_document_skips_empty_sections(spark):
    df = spark.createDataFrame([("md", "", None), ("md", "t", "p")], "m string, t string, p string")
    got = [r.d for r in df.select(mdf.full_document("m", "t", "p").alias("d")).collect()]
    assert got == ["md", "md\n## Trends & Continuity\nt\n## Bigger Picture: Feature Pitch\np"]
