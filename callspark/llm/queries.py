"""The queries of this subpackage: production parameters over whole tables, results as fixed by contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from callspark.llm.language_id import identify_language

    return identify_language(_table(spark, sf_dir, "documents"))


def op2_token_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from callspark.llm.packing import pack_token_matrix

    return pack_token_matrix(_table(spark, sf_dir, "documents"))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from callspark.llm.minhash_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from callspark.llm.license_scan import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from callspark.llm.secret_scan import secret_report

    return secret_report(_table(spark, sf_dir, "documents"))


def op6_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from callspark.llm.quote_links import format_conversations

    return format_conversations(_table(spark, sf_dir, "conversations"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from callspark.llm.quality import judge_quality

    out = judge_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def op8_online_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from callspark.llm.packing import pack_online

    return pack_online(_table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from callspark.llm.line_dedup import drop_repeated_lines

    out = drop_repeated_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join("removed", ",").alias("removed"), "text")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from callspark.llm.decontaminate import contamination_report

    return contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from callspark.llm.suffix_trees import repeated_passages

    out = repeated_passages(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from callspark.llm.prefix_trie import conversation_trie

    return conversation_trie(_table(spark, sf_dir, "conversations"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from callspark.llm.merkle import dataset_manifest

    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    out = dataset_manifest(_table(spark, sf_dir, "documents"), tampered)
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP3_SQL = rf"""
WITH RECURSIVE said AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS words FROM documents
), shingles AS (
  SELECT DISTINCT rid, array_to_string(words[k : k + 4], ' ') AS shingle
  FROM (SELECT rid, words, unnest(range(1, greatest(len(words) - 3, 2))) AS k FROM said WHERE len(words) > 0)
), sizes AS (
  SELECT said.rid, said.doc_id, count(shingle) AS n FROM said LEFT JOIN shingles USING (rid) GROUP BY ALL
), links AS (
  SELECT a, b FROM (SELECT x.rid AS a, y.rid AS b, count(*) AS same FROM shingles x JOIN shingles y USING (shingle) WHERE x.rid <> y.rid GROUP BY ALL)
  JOIN sizes p ON p.rid = a JOIN sizes q ON q.rid = b WHERE 100 * same >= 75 * (p.n + q.n - same)
), reached AS (
  SELECT rid AS a, rid AS b FROM sizes UNION SELECT reached.a, links.b FROM reached JOIN links ON links.a = reached.b
), named AS (
  SELECT a AS rid, min(doc_id) AS component_id FROM reached JOIN sizes ON sizes.rid = b GROUP BY a
)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM sizes JOIN named USING (rid)
"""

_OP10_SQL = rf"""
WITH said AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, words, least(10, len(words)) AS size
  FROM (SELECT item_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark) WHERE len(words) > 0
), wanted AS (
  SELECT DISTINCT item, size, array_to_string(words[k : k + size - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(words) - size + 2)) AS k FROM items)
), seen AS (
  SELECT rid, size, k, array_to_string(words[k : k + size - 1], ' ') AS gram
  FROM (SELECT rid, words, size, unnest(range(1, greatest(len(words) - size + 2, 1))) AS k FROM said, (SELECT DISTINCT size FROM items))
), hits AS (
  SELECT rid, k, size, item FROM seen JOIN wanted USING (size, gram)
), places AS (
  SELECT rid, count(DISTINCT place) AS n_hit FROM (SELECT rid, unnest(range(k, k + size)) AS place FROM hits) GROUP BY rid
), found AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM said LEFT JOIN places USING (rid) LEFT JOIN found USING (rid)
"""


#: CRC-32 of a decimal number's digits, bit by bit.
_CRC = "xor(list_reduce(list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT)), lambda crc, d: {bits}, 4294967295::BIGINT), 4294967295)"


def _crc(column: str) -> str:
    step = "xor(crc, d)"
    for _ in range(8):
        step = f"list_transform([{step}], lambda x: xor(x >> 1, (x & 1) * 3988292384))[1]"
    return _CRC.format(column, bits=step)


def _hashed(columns: str) -> str:
    fields = (f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')" for c in columns.split())
    return f"sha256({' || '.join(fields)})"


_OP13_SQL = f"""
WITH RECURSIVE said AS (
  SELECT *, CASE WHEN {_crc("doc_id")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS forged_text FROM documents
), leaves AS (
  SELECT row_number() OVER () AS rid, doc_id, source, {_hashed("doc_id source lang n_chars text")} AS leaf, {_hashed("doc_id source lang n_chars forged_text")} AS forged FROM said
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves
), tree AS (
  SELECT source, 0 AS level, pos, leaf AS digest, count(*) OVER (PARTITION BY source) AS n FROM placed
  UNION ALL
  SELECT source, level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (n + 2) // 3 FROM tree WHERE n > 1 GROUP BY source, level, pos // 3, n
), subroots AS (
  SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos FROM tree WHERE n = 1
), upper AS (
  SELECT 0 AS level, pos, subroot AS digest, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (n + 2) // 3 FROM upper WHERE n > 1 GROUP BY level, pos // 3, n
), steps AS (
  SELECT rid, 0 AS part, p.source, 0 AS level, pos FROM placed p
  UNION ALL
  SELECT rid, part, source, level + 1, pos // 3 FROM steps WHERE level < (SELECT max(level) FROM tree)
), upper_steps AS (
  SELECT source, 0 AS level, pos FROM subroots UNION ALL SELECT source, level + 1, pos // 3 FROM upper_steps WHERE level < (SELECT max(level) FROM upper)
), siblings AS (
  SELECT rid, 0 AS part, s.level, coalesce(string_agg(t.digest, '' ORDER BY t.pos) FILTER (t.pos < s.pos), '') AS l, coalesce(string_agg(t.digest, '' ORDER BY t.pos) FILTER (t.pos > s.pos), '') AS r
  FROM steps s JOIN tree t ON t.source IS NOT DISTINCT FROM s.source AND t.level = s.level AND t.pos // 3 = s.pos // 3 WHERE t.n > 1 GROUP BY ALL
  UNION ALL
  SELECT rid, 1, s.level, coalesce(string_agg(t.digest, '' ORDER BY t.pos) FILTER (t.pos < s.pos), ''), coalesce(string_agg(t.digest, '' ORDER BY t.pos) FILTER (t.pos > s.pos), '')
  FROM leaves JOIN upper_steps s ON s.source IS NOT DISTINCT FROM leaves.source JOIN upper t ON t.level = s.level AND t.pos // 3 = s.pos // 3 WHERE t.n > 1 GROUP BY ALL
), way AS (
  SELECT rid, l, r, row_number() OVER (PARTITION BY rid ORDER BY part, level) AS step FROM siblings
), fold AS (
  SELECT rid, 0 AS step, forged AS digest FROM leaves UNION ALL SELECT f.rid, w.step, sha256(w.l || f.digest || w.r) FROM fold f JOIN way w ON w.rid = f.rid AND w.step = f.step + 1
), ended AS (
  SELECT rid, arg_max(digest, step) AS folded_root FROM fold GROUP BY rid
), proofs AS (
  SELECT rid, sha256(string_agg(l || r, '' ORDER BY step)) AS proof_sha256 FROM way GROUP BY rid
)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves JOIN ended USING (rid) LEFT JOIN proofs USING (rid) JOIN subroots ON subroots.source IS NOT DISTINCT FROM leaves.source,
     (SELECT digest AS root FROM upper WHERE n = 1)
"""


_OP11_SQL = r"""
WITH said AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT rid, doc_id, k, array_to_string(words[k : k + 12], ' ') AS window13 FROM (SELECT *, unnest(range(1, greatest(len(words) - 11, 1))) AS k FROM said)
), least AS (
  SELECT window13, min(doc_id) AS low FROM windows GROUP BY window13 HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT rid, unnest(range(k, k + 13)) AS place FROM windows JOIN least USING (window13) WHERE low < doc_id
), left_over AS (
  SELECT rid, string_agg(word, ' ' ORDER BY place) AS kept
  FROM (SELECT rid, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM said) ANTI JOIN gone USING (rid, place) GROUP BY rid
), counts AS (
  SELECT rid, count(*) AS n_removed FROM gone GROUP BY rid
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM said LEFT JOIN counts USING (rid) LEFT JOIN left_over USING (rid)
"""

_OP12_SQL = f"""
WITH placed AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, {_crc("conv_id")} % 9 AS h, conv_id - conv_id % 5 AS base FROM (SELECT DISTINCT conv_id FROM placed)
), rebuilt AS (
  SELECT convs.conv_id, pos, role, text FROM convs JOIN placed ON placed.conv_id = base AND pos < h
  UNION ALL SELECT convs.conv_id, pos, role, text FROM convs JOIN placed USING (conv_id) WHERE pos >= h
), seqs AS (
  SELECT conv_id, list(sha256(length(role) || ':' || role || text) ORDER BY pos) FILTER (pos IS NOT NULL) AS keys, list(octet_length(encode(text)) ORDER BY pos) AS sizes, count(pos) AS size
  FROM convs LEFT JOIN rebuilt USING (conv_id) GROUP BY conv_id
), members AS (
  SELECT conv_id, d, d = size AS ended, coalesce(array_to_string(keys[1 : d], ''), '') AS node, coalesce(sizes[d], 0) AS bytes FROM (SELECT *, unnest(range(0, size + 1)) AS d FROM seqs)
), nodes AS (
  SELECT node, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) * (count(*) - 1) AS own, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ended) AS ends
  FROM members GROUP BY node, d
), families AS (
  SELECT p.node, max(up.conv_id) AS parent_conv_id, count(DISTINCT c.node) AS n_children
  FROM nodes p LEFT JOIN nodes up ON p.depth > 0 AND up.node = left(p.node, 64 * (p.depth - 1)) LEFT JOIN nodes c ON c.depth = p.depth + 1 AND left(c.node, 64 * p.depth) = p.node GROUP BY p.node
), subtrees AS (
  SELECT left(node, 64 * k) AS node, CAST(sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(sum(own) AS BIGINT) AS saved_tokens
  FROM (SELECT nodes.node, own, n_children, unnest(range(0, depth + 1)) AS k FROM nodes JOIN families USING (node)) GROUP BY ALL
)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM nodes JOIN families USING (node) JOIN subtrees USING (node)
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL can say in full; a label, a model, a packing or spans of a method can't be."""
    return {"op3_minhash_dedup": _OP3_SQL, "op10_decontaminate": _OP10_SQL, "op11_repeated_passages": _OP11_SQL, "op12_prefix_trie": _OP12_SQL, "op13_manifest": _OP13_SQL}
