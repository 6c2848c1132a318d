"""One query per operator over its whole table; the digest columns are derived from the operators' outputs."""

from __future__ import annotations

import functools
import math
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import feedweave
from feedweave.llm import block_labeller, byte_bpe, collision_search, collocations, exact_dedup, merkle_manifest, merkle_sql, ngram_join, packing, quality_lm, string_kernel, substring_dedup, token_counts, tokenizing, url_templates


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(_table(spark, sf_dir, "documents"), words=4, percent=85)


def ngram_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1_ngram_join with the number of links of each document; every pair of classes is searched."""
    return ngram_join.join_links(_table(spark, sf_dir, "documents"), words=4, percent=85)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), tokenizing.vocabulary_path("byte_bpe_50k.json"), limit=1024)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = tokenizing.vocabulary_path("byte_bpe_50k.tiktoken")
    return byte_bpe.encode_texts(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_exact(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_lm.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = block_labeller.extract(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collision_search.nearest(_table(spark, sf_dir, "embeddings"), k=20, is_query=F.col("vec_id") % 20 == 0)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"), words=35)
    return left.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizing.vocabulary_path("word_bpe_49k.json"), end_id=2, max_tokens=4096)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.filter_urls(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return string_kernel.predict_documents(_table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.verify_documents(_table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_table(spark, sf_dir, "documents"), top=2000, longest=5, least=100, subsumed_percent=100)


def shipped(spark: SparkSession) -> None:
    """Lets Python workers import this package wherever the session runs: one zip file, sent by Spark, once a context."""
    context = spark.sparkContext
    if getattr(context, "_feedweave_shipped", False):
        return
    package = Path(feedweave.__file__).parent
    to = Path(tempfile.mkdtemp(prefix="feedweave-")) / "feedweave.zip"
    with zipfile.ZipFile(to, "w") as out:
        for f in sorted(package.rglob("*.py")):
            out.write(f, f"feedweave/{f.relative_to(package)}")
    context.addPyFile(str(to))
    context._feedweave_shipped = True


def _query(run):
    @functools.wraps(run)
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        shipped(spark)
        return run(spark, sf_dir)

    return query


QUERIES = {f.__name__: _query(f) for f in (op1_ngram_join, ngram_links, op2_token_counts, op3_byte_bpe, op4_exact_dedup, op5_quality, op6_html_extraction, op7_nearest, op8_substring_dedup, op9_packing, op10_url_filter, op11_language, op12_merkle_manifest, op13_collocations)}

_LOWERED = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _merged_sql(nodes: str, parent: str) -> str:
    """Nodes with l_eff and b_eff, as url_templates merges them."""
    on = " AND ".join(f"n.{c} = w.{c}" for c in parent.split(", "))
    width = math.sqrt(0.5 * math.log(2 / url_templates.MERGE_ALPHA))
    return f"""(
        SELECT t.*, CASE WHEN alike THEN sum(CASE WHEN alike THEN l END) OVER (PARTITION BY {parent}) ELSE l END AS l_eff,
               CASE WHEN alike THEN sum(CASE WHEN alike THEN b END) OVER (PARTITION BY {parent}) ELSE b END AS b_eff
        FROM (SELECT n.*, n.l = 0 OR abs(n.b / n.l - w.b / w.l) <= {width!r} * (1 / sqrt(n.l) + 1 / sqrt(w.l)) AS alike
              FROM {nodes} n JOIN (SELECT {parent}, sum(l) AS l, sum(b) AS b FROM {nodes} GROUP BY ALL) w ON {on}) t)"""


def _url_sql() -> str:
    rules = sorted(url_templates.RULES, key=lambda r: (-len(r.text), r.text))
    case = lambda value: "CASE " + " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{value(r)}'" for r in rules) + " END"
    return rf"""
        WITH RECURSIVE cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), {_LOWERED}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
        u AS (SELECT *, {case(lambda r: r.text)} AS rule, {case(lambda r: r.verdict)} AS said,
                     [regexp_replace(CASE WHEN regexp_full_match(s, '[0-9A-Fa-f-]{{12,}}') AND regexp_matches(s, '[0-9]') THEN '<x>' ELSE s END, '[0-9]+', '<n>', 'g')
                      for s in string_split(path, '/') if s <> ''] AS forms FROM h),
        s AS (SELECT host, forms, count(*) AS n, count(said) AS l, count(*) FILTER (WHERE said = 'block') AS b FROM u GROUP BY ALL),
        lv AS (SELECT host, forms, n, unnest(range(1, len(forms) + 1)) AS k FROM s),
        lp AS (SELECT host, forms, n, k, array_to_string(forms[1:k - 1], '/') AS parent, forms[k] AS form FROM lv),
        c AS (SELECT host, k, parent, form, sum(n) AS n FROM lp GROUP BY ALL),
        v AS (SELECT host, k, parent FROM c GROUP BY ALL HAVING count(*) >= {url_templates.VARIABLE_CHILDREN} AND sum(n) <= {url_templates.VARIABLE_MEAN} * count(*)),
        t AS (SELECT lp.host, lp.forms, list(CASE WHEN v.k IS NULL THEN lp.form ELSE '<any>' END ORDER BY lp.k) AS template
              FROM lp LEFT JOIN v ON v.host = lp.host AND v.k = lp.k AND v.parent = lp.parent GROUP BY ALL),
        st AS (SELECT s.*, coalesce(t.template, []) AS template FROM s LEFT JOIN t ON t.host = s.host AND t.forms = s.forms),
        ne AS (SELECT host, template, l, b, unnest(range(0, len(template) + 1)) AS k FROM st),
        n AS (SELECT host, k, coalesce(array_to_string(template[1:k], '/'), '') AS node, CASE WHEN k > 0 THEN coalesce(array_to_string(template[1:k - 1], '/'), '') ELSE '' END AS parent,
                     sum(l) AS l, sum(b) AS b FROM ne GROUP BY ALL),
        g AS (SELECT k, node, parent, sum(l) AS l, sum(b) AS b FROM n GROUP BY ALL),
        e AS (SELECT * FROM {_merged_sql("g", "k, parent")}),
        p AS (SELECT k, node, (b_eff + {url_templates.SMOOTHING / 2}) / (l_eff + {url_templates.SMOOTHING}) AS p FROM e WHERE k = 0
              UNION ALL SELECT e.k, e.node, (e.b_eff + {url_templates.SMOOTHING} * p.p) / (e.l_eff + {url_templates.SMOOTHING}) FROM p JOIN e ON e.k = p.k + 1 AND e.parent = p.node),
        o AS (SELECT m.host, m.k, m.node, (m.b_eff + {url_templates.SMOOTHING} * p.p) / (m.l_eff + {url_templates.SMOOTHING}) AS purity
              FROM {_merged_sql("n", "host, k, parent")} m JOIN p ON p.k = m.k AND p.node = m.node)
        SELECT u.page_id, u.host, u.path, u.rule, coalesce(u.said, CASE WHEN o.purity >= {url_templates.THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict
        FROM u JOIN st ON st.host = u.host AND st.forms = u.forms
        JOIN o ON o.host = st.host AND o.k = len(st.template) AND o.node = coalesce(array_to_string(st.template, '/'), '')"""


ORACLE = {
    "op10_url_filter": _url_sql(),
    "op12_merkle_manifest": merkle_sql.MERKLE_SQL,
    "op13_collocations": collocations.COLLOCATIONS_SQL,
    "op1_ngram_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
        p AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS i FROM w WHERE len(words) > 0),
        s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS g FROM p),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
        r AS (SELECT doc_id, doc_id AS m FROM documents UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.m)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.m) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id, n.n""",
    "op8_substring_dedup": r"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
        v AS (SELECT doc_id, words, unnest(range(1, len(words) - 34 + 1)) AS i FROM d WHERE len(words) >= 35),
        h AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 34], ' ')) AS h FROM v),
        c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)),
        o AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM d),
        k AS (SELECT o.doc_id, string_agg(o.word, ' ' ORDER BY o.i) AS kept, count(*) AS n FROM o LEFT JOIN c ON c.doc_id = o.doc_id AND c.i = o.i WHERE c.i IS NULL GROUP BY o.doc_id)
        SELECT d.doc_id, len(words) AS n_words, len(words) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id""",
    "op4_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t)""",
}
