"""DuckDB SQL of op12_merkle_manifest: its own recursive levels and its own recursive climb."""

from __future__ import annotations

_LOWERED = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _leaf(text: str) -> str:
    fields = " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END" for c in ("doc_id", "source", "lang", "n_chars", text))
    return f"sha256({fields})"


#: CRC-32 by a table of 256 remainders of the reflected polynomial 0xEDB88320.
_CRC = """xor(4294967295, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
    lambda c, b: xor(c // 256, t[1 + CAST(xor(c % 256, b) AS INTEGER)]), CAST(4294967295 AS BIGINT)))"""

MERKLE_SQL = f"""
    WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, i)) AS t),
    d AS (SELECT doc_id, source, {_leaf('text')} AS leaf,
                 CASE WHEN doc_id IS NOT NULL AND {_CRC} % 5 = 0 THEN {_leaf(f'translate(text, {_LOWERED})')} ELSE {_leaf('text')} END AS held FROM documents, crc),
    e AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, held) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n,
                 dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM d),
    a(tree, level, idx, hash, n) AS (
        SELECT tree, 0, idx, leaf, n FROM e
        UNION ALL SELECT tree, level + 1, idx // 16, sha256(string_agg(hash, '' ORDER BY idx)), (max(n) + 15) // 16 FROM a WHERE n > 1 GROUP BY tree, level, idx // 16),
    b(level, idx, hash, n) AS (
        SELECT 0, tree, hash, (SELECT count(DISTINCT tree) FROM e) FROM a WHERE n = 1
        UNION ALL SELECT level + 1, idx // 16, sha256(string_agg(hash, '' ORDER BY idx)), (max(n) + 15) // 16 FROM b WHERE n > 1 GROUP BY level, idx // 16),
    nodes AS (SELECT tree, level, idx, hash, n FROM a UNION ALL SELECT -1, level, idx, hash, n FROM b),
    runs AS (SELECT tree, level, idx // 16 AS run, list(hash ORDER BY idx) AS kids FROM nodes WHERE n > 1 GROUP BY tree, level, idx // 16),
    c(row, own, doc_id, leaf, tree, level, idx, folded, proof) AS (
        SELECT row_number() OVER (), tree, doc_id, leaf, tree, 0, idx, held, '' FROM e
        UNION ALL
        SELECT c.row, c.own, c.doc_id, c.leaf, CASE WHEN r.run IS NULL THEN -1 ELSE c.tree END, CASE WHEN r.run IS NULL THEN 0 ELSE c.level + 1 END,
               CASE WHEN r.run IS NULL THEN c.own ELSE c.idx // 16 END,
               CASE WHEN r.run IS NULL THEN c.folded ELSE sha256(array_to_string(r.kids[1:c.idx % 16], '') || c.folded || array_to_string(r.kids[c.idx % 16 + 2:], '')) END,
               CASE WHEN r.run IS NULL THEN c.proof ELSE c.proof || array_to_string(r.kids[1:c.idx % 16], '') || array_to_string(r.kids[c.idx % 16 + 2:], '') END
        FROM c LEFT JOIN runs r ON r.tree = c.tree AND r.level = c.level AND r.run = c.idx // 16
        WHERE r.run IS NOT NULL OR c.tree >= 0)
    SELECT c.doc_id, c.leaf, s.hash AS subroot, t.hash AS root, sha256(c.proof) AS proof_sha256, c.folded AS folded_root, c.folded = t.hash AS verified
    FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY row ORDER BY tree, level DESC) = 1) c
    JOIN a s ON s.tree = c.own AND s.n = 1 JOIN b t ON t.n = 1"""
