"""Many terms at once: which terms of a table occur in which texts (C4, K1, K3).

A term can only occur where each run of its characters does.  One run of
``ANCHOR`` characters is the term's anchor, the one around its rarest ``RUN``
characters; a shorter term is its own anchor.  Texts are cut into their distinct
runs, equi-joined with the anchors, and ``contains`` decides on the pairs that
meet.  The anchors are broadcast, a slice of bounded size at a time, and meet
the runs where the texts are read: no run and no pair is shuffled or written.
What is counted first are the texts' runs of ``RUN`` characters, of which there
are few.  No term passes through the driver other than as a broadcast.

The terms that meet at an anchor grow in number with the terms, and each text
pays for them.  A term that is a word, or a part of one, occurs in a text where
it occurs in one of the text's words, and many texts share a word:
``in_words`` matches each word once, with all its runs, so that only equal ones
meet.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedweave.operators.common import BROADCAST_MAX_BYTES, sized_broadcast
from feedweave.session import reliable_checkpoint

#: Characters of a run that is counted, and of an anchor.
RUN, ANCHOR = 3, 5
#: Terms of one slice, which is broadcast.
SLICE_TERMS = 1 << 20
#: Characters of words, and how many of them a term may have to be looked for in words; longer words are cut, with parts in common.
WORD_CHARS, WORD_MOST = r"\p{L}\p{M}\p{N}", 32


def runs_of(chars: Column, lengths: list[int]) -> Column:
    """Distinct runs of an array of characters that have one of ``lengths`` (from 1)."""
    heads = F.transform(chars, lambda _, i: F.array_join(F.slice(chars, i + 1, max(lengths)), ""))
    some = F.array(*(F.lit(n) for n in lengths))
    return F.array_distinct(F.flatten(F.transform(heads, lambda h: F.transform(F.filter(some, lambda n: n <= F.length(h)), lambda n: F.substring(h, 1, n)))))


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def matches(texts: DataFrame, text_col: str, keys: list[str], terms: DataFrame, term_col: str = "term", carried: tuple[str, ...] = ()) -> DataFrame:
    """``keys..., term, carried...``: the distinct terms that occur in a row's text, case apart.

    ``keys`` name a row of ``texts``.  The empty term occurs everywhere, a null
    term or text nowhere.  ``carried``: columns of ``terms`` that come with each
    hit; it then has one row a term, apart from case.
    """
    return reduce(DataFrame.unionByName, sliced_matches(texts, text_col, keys, terms, term_col, carried))


def sliced_matches(texts: DataFrame, text_col: str, keys: list[str], terms: DataFrame, term_col: str = "term", carried: tuple[str, ...] = (), words: bool = False) -> list[DataFrame]:
    """``matches``, a table for each slice of the terms; what is run of them at one time is broadcast at one time.

    ``words``: the texts are short, so they are cut into all their runs of up to
    ``WORD_MOST`` characters, and a term up to so long is its own anchor.
    """
    spark, anchor = texts.sparkSession, WORD_MOST if words else ANCHOR
    own = terms.select(F.lower(term_col).alias("term"), *carried).filter(F.col("term").isNotNull())
    own = reliable_checkpoint((own if carried else own.distinct()).withColumn("n", F.size(_chars(F.col("term")))))
    sizes = own.agg(F.collect_set(F.least("n", F.lit(anchor))).alias("of"), F.max("n").alias("most")).first()
    lengths = sorted(sizes["of"])  # 0 to anchor
    low = texts.select(*keys, F.lower(text_col).alias("_hay")).filter(F.col("_hay").isNotNull())
    if not lengths:
        return [low.limit(0).select(*keys, F.lit("").alias("term"), *(F.lit(None).cast(terms.schema[c].dataType).alias(c) for c in carried))]
    # a text is lowered and cut once, not for each of its runs, and few short texts don't share one task
    low = low.repartition(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), *keys).withColumn("_chars", _chars(F.col("_hay")))

    anchors = own.withColumn("gram", F.col("term"))
    if sizes["most"] > anchor:
        often = reliable_checkpoint(low.select(F.explode(runs_of(F.col("_chars"), [RUN])).alias("run")).groupBy("run").agg(F.count(F.lit(1)).alias("often")))
        chars = _chars(F.col("term"))
        run = F.transform(F.sequence(F.lit(1), F.col("n") - (RUN - 1)), lambda i: F.array_join(F.slice(chars, i, RUN), ""))
        longer = own.filter(F.col("n") > anchor).select("term", "n", F.posexplode(run).alias("at", "run"))
        # a run that no text has is the rarest: the term is then met nowhere
        rarest = longer.join(sized_broadcast(often), "run", "left").groupBy("term").agg(
            F.min_by("at", F.struct(F.coalesce("often", F.lit(0)), "run", "at")).alias("at"))
        first = F.greatest(F.lit(1), F.least(F.col("at"), F.col("n") - (anchor - 1)))
        anchors = own.join(rarest, "term", "left").withColumn(
            "gram", F.when(F.col("at").isNotNull(), F.array_join(F.slice(chars, first, anchor), "")).otherwise(F.col("term"))).drop("at")
    size = sum((F.octet_length(F.to_json(F.struct(c))) for c in ("term", "gram", *carried)), F.lit(16))
    anchors = reliable_checkpoint(anchors.select("term", "gram", *carried, F.xxhash64("term").alias("_deal"), size.cast("bigint").alias("_size")))
    seen = anchors.agg(F.count(F.lit(1)).alias("n"), F.sum("_size").alias("size")).first()
    slices = max(math.ceil(seen["n"] / SLICE_TERMS), math.ceil(seen["size"] / BROADCAST_MAX_BYTES))

    if words:
        # in rows rather than arrays, each run where it is first
        heads = low.select(*keys, "_hay", F.explode(F.sequence(F.lit(1), F.greatest(F.length("_hay"), F.lit(1)))).alias("_at")).withColumn(
            "_head", F.substring("_hay", F.col("_at"), F.lit(lengths[-1]))).filter(F.length("_head") >= lengths[0])
        parts = heads.select("*", F.explode(F.sequence(F.lit(lengths[0]), F.length("_head"))).alias("_n")).withColumn("gram", F.substring("_head", F.lit(1), F.col("_n")))
        runs = parts.filter(F.instr("_hay", F.col("gram")) == F.col("_at")).select(*keys, "_hay", "gram")
    else:
        some = [n for n in lengths if n]
        cut = F.concat(*([F.array(F.lit(""))] if 0 in lengths else []), *([runs_of(F.col("_chars"), some)] if some else []))
        runs = low.select(*keys, "_hay", F.explode(cut).alias("gram"))
    return [runs.join(F.broadcast(anchors.filter(F.pmod("_deal", F.lit(slices)) == k)), "gram")
            .filter(F.contains("_hay", "term")).select(*keys, "term", *carried) for k in range(slices)]


def in_words(texts: DataFrame, text_col: str, keys: list[str], terms: DataFrame, carried: tuple[str, ...] = ()) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """What ``matches`` finds in lower-case ``texts`` and ``terms``, in tables that together are smaller.

    ``keys..., _text, _times, word``: the distinct words of each text; ``_text``
    tells the texts of a key apart, ``_times`` is how many of its rows have that
    text.  ``word, term, carried...``: the terms in each word, a table a slice of
    the terms.  ``keys..., term, carried...``: the hits of the other terms, which
    are no part of a word.
    """
    low = texts.select(*keys, F.col(text_col).alias("_hay")).filter(F.col("_hay").isNotNull())
    low = low.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), *keys)
    each = F.split("_hay", f"[^{WORD_CHARS}]+").alias("_words")
    starts = lambda w: F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1)), F.lit(WORD_MOST + 1))
    parts = F.flatten(F.transform("_words", lambda w: F.transform(starts(w), lambda i: F.substring(w, i, 2 * WORD_MOST))))
    short = F.when(F.exists("_words", lambda w: F.length(w) > 2 * WORD_MOST), parts).otherwise(F.col("_words"))
    word = F.explode(F.array_remove(F.array_distinct(short), "")).alias("word")
    own = low.groupBy(*keys, "_hay").agg(F.count(F.lit(1)).alias("_times")).select(*keys, F.xxhash64("_hay").alias("_text"), "_times", each).select(*keys, "_text", "_times", word)
    vocabulary = reliable_checkpoint(low.select(each).select(word).distinct())
    worded = F.col("term").rlike(rf"\A[{WORD_CHARS}]{{1,{WORD_MOST}}}\z")
    inside = sliced_matches(vocabulary, "word", ["word"], terms.filter(worded), carried=carried, words=True)
    return own, inside, matches(texts, text_col, keys, terms.filter(~worded), carried=carried)
