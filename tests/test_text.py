"""Scalar text helpers against values worked out from the original Python rules."""

import hashlib

from pyspark.sql import functions as F

from feedweave.functions import text as tx


def one(spark, expr, schema="a string, b string, c string", row=(None, None, None)):
    return spark.createDataFrame([row], schema).select(expr.alias("x")).first().x


def md5(s):
    return hashlib.md5(s.encode()).hexdigest()


def test_entry_key_or_before_strip(spark):
    # whitespace-only link is truthy, chosen, then stripped to '' (Q5)
    assert one(spark, tx.entry_key("a", "b", "c"), row=("  \t", "id-1", "T")) == md5("")
    # an entry with nothing hashes the same
    assert one(spark, tx.entry_key("a", "b", "c"), row=(None, None, None)) == md5("")
    assert one(spark, tx.entry_key("a", "b", "c"), row=("", "", "")) == md5("")
    # fallbacks: link, then id, then title; lower-cased
    assert one(spark, tx.entry_key("a", "b", "c"), row=(" HTTP://X/A ", "i", "t")) == md5("http://x/a")
    assert one(spark, tx.entry_key("a", "b", "c"), row=("", "ID-9", "t")) == md5("id-9")
    assert one(spark, tx.entry_key("a", "b", "c"), row=(None, "", "Title")) == md5("title")


def test_py_strip_unicode_whitespace(spark):
    s = " \u001c\u0085 x y　\t "
    assert one(spark, tx.py_strip("a"), row=(s, None, None)) == s.strip()
    # Spark's trim alone would keep the exotic spaces
    assert one(spark, F.trim("a"), row=(s, None, None)) != s.strip()


def test_clean_html_rules(spark):
    html = "<p>Hi&amp;<script>var a='<b>';</script>\n\n there</p>"
    import re
    expected = re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", html)).strip()[:600]
    assert one(spark, tx.clean_html("a"), row=(html, None, None)) == expected
    assert "var a=" in expected and "&amp;" in expected
    # truncation is last: a space at position 600 is kept
    long = "a" * 599 + " b" + "c" * 10
    got = one(spark, tx.clean_html("a"), row=(long, None, None))
    assert got == long[:600] and got.endswith(" ")
    # unicode whitespace collapses like Python's \s
    assert one(spark, tx.clean_html("a"), row=("a \u001c b", None, None)) == "a b"


def test_summary_fallback_and_label(spark):
    assert one(spark, tx.summary_fallback("a", "b"), row=("", "desc", None)) == "desc"
    assert one(spark, tx.summary_fallback("a", "b"), row=(None, None, None)) == ""
    lab = spark.createDataFrame([(None,)], "t timestamp").select(tx.published_label("t")).first()[0]
    assert lab == "Date unknown"


def test_source_filter_semantics(spark):
    df = spark.createDataFrame([
        (["Acme"], "", "x ACME y", None, "t"),
        (["Acme"], "", "z" * 500 + "acme", None, "t"),
        ([], "", "nothing", None, "t"),
        (None, "", "nothing", None, "t"),
        (["Bob"], "bob smith", "", None, ""),
    ], "terms array<string>, author string, summary string, description string, title string")
    hay = tx.filter_haystack("author", "summary", "description", "title")
    got = [r.ok for r in df.select(tx.passes_source_filter("terms", hay).alias("ok")).collect()]
    # the term beyond the first 500 characters of the summary is not seen
    assert got == [True, False, True, True, True]


def test_entry_date_fallthrough(spark):
    df = spark.createDataFrame([
        ("Thu, 04 Jan 2024 10:00:00 +0000", None, None),
        ("garbage", "2024-01-04T12:30:00+02:00", None),
        (None, None, "04 Jan 2024 07:00:00 GMT"),
        ("", "", ""),
        ("Thu, 4 Jan 2024 10:00:00 GMT", None, None),
        ("Thu, 04 Jan 2024 10:00:00 EST", None, None),
        ("2024-01-04T10:00:00.123Z", None, None),
        ("2024-01-04T10:00:00.123456+01:00", None, None),
    ], "p string, u string, c string")
    got = [r.x for r in df.select(F.date_format(tx.entry_date("p", "u", "c"),
                                                "yyyy-MM-dd HH:mm:ss").alias("x")).collect()]
    assert got == ["2024-01-04 10:00:00", "2024-01-04 10:30:00", "2024-01-04 07:00:00", None,
                   "2024-01-04 10:00:00", "2024-01-04 15:00:00", "2024-01-04 10:00:00",
                   "2024-01-04 09:00:00"]


def test_entry_date_forms(spark):
    ten = "2024-01-04 10:00:00"
    forms = ["Thu, 04 Jan 2024 10:00:00 GMT", "Thu, 04 Jan 2024 10:00:00", "Thursday, 04 Jan 2024 12:00:00 +0200", "4 Jan 24 10:00 GMT",
             "2024-01-04T10:00Z", "2024-01-04T12:00:00+0200", "2024-01-04T10:00:00.1234567Z", "2024-01-04 12:00:00+02:00", "2024-01-04 10:00:00"]
    df = spark.createDataFrame([(f,) for f in forms], "s string")
    assert [str(r.t) for r in df.select(tx.parse_feed_date("s").alias("t")).collect()] == [ten] * len(forms)
    old = spark.createDataFrame([("1 Feb 97 00:00 GMT",), ("nonsense",), ("",)], "s string")
    assert [str(r.t) for r in old.select(tx.parse_feed_date("s").alias("t")).collect()] == ["1997-02-01 00:00:00", "None", "None"]
