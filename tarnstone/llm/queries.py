"""The queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnstone.llm import encoding, near_duplicates, packing, repeated_lines, residue, scan_repair, splitting
from tarnstone.runtime import spread, table

#: The profiles by which chunks and revisions are split.
SPLIT_PROFILES = {"chunk": "chunk-bound", "revision": "revision-read"}


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    items = splitting.items(table(spark, d, "knowledge_chunks"), table(spark, d, "asset_revisions"))
    return splitting.split_oversized(items, table(spark, d, "size_profiles"), SPLIT_PROFILES)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.found(p1_pieces(spark, d))


def p1_small_pieces(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "knowledge_chunks")
    items = chunks.select(F.lit("chunk").alias("item_kind"), F.col("chunk_id").alias("item_id"), "heading_path", "text")
    return splitting.split_oversized(items, table(spark, d, "size_profiles"), {"chunk": "chunk-small"})


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """By the count of assets alone; p2_excess and p2_texts have what the test of excess decides."""
    return repeated_lines.frequent_lines(table(spark, d, "knowledge_chunks"), table(spark, d, "assets")).select("chunk_id", "line_no")


def p2_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines in two assets of their site or more, with what is held against what."""
    lines = repeated_lines.repeated_lines(table(spark, d, "knowledge_chunks"), table(spark, d, "assets"))[1]
    return lines.select("source", F.hex("line_key").alias("line_key"), "n_assets", "n_source", "n_outside", "n_others", F.round("llr", 4).alias("llr"))


def p2_excess(spark: SparkSession, d: str) -> DataFrame:
    """The decision on each of these lines: in excess in its site, in six assets or more by chance, or neither."""
    lines = repeated_lines.repeated_lines(table(spark, d, "knowledge_chunks"), table(spark, d, "assets"))[1]
    decision = F.when(F.col("excess") & (F.col("n_assets") >= repeated_lines.MIN_ASSETS), "repeated").when(F.col("excess"), "excess, few assets").when(F.col("n_assets") >= repeated_lines.MIN_ASSETS, "commonplace").otherwise("ordinary")
    return lines.select("source", F.hex("line_key").alias("line_key"), "n_assets", F.round("llr", 4).alias("llr"), decision.alias("decision"))


def p2_texts(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.without_repeated_lines(table(spark, d, "knowledge_chunks"), table(spark, d, "assets"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return scan_repair.found(scan_repair.defects(table(spark, d, "asset_revisions")))


def p4_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    revisions = table(spark, d, "asset_revisions")
    return scan_repair.paragraphs(revisions, scan_repair.defects(revisions))


def p4_chunks(spark: SparkSession, d: str) -> DataFrame:
    return scan_repair.repaired_chunks(table(spark, d, "knowledge_chunks"), scan_repair.defects(table(spark, d, "asset_revisions")))


def _near(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    items = near_duplicates.current_items(table(spark, d, "assets"), table(spark, d, "asset_revisions"), table(spark, d, "knowledge_chunks"))
    return near_duplicates.near_duplicates(items)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.pairs(*_near(spark, d)).select("item_kind", "id_a", "id_b")


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.groups(*_near(spark, d))


def p5_links(spark: SparkSession, d: str) -> DataFrame:
    """The links between classes of equal texts, whatever assets their members are of; p5_groups has the members."""
    links = _near(spark, d)[0]
    return links.select("item_kind", "class_a", "class_b", F.round("similarity", 6).alias("similarity"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode_texts(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text", "byte_bpe_50k")


def _packed(spark: SparkSession, d: str, tokenizer: str) -> DataFrame:
    profiles = table(spark, d, "size_profiles").where((F.col("purpose") == "pack") & (F.col("tokenizer") == tokenizer)).orderBy("profile_id").collect()  # one row a profile
    sizes = encoding.count_tokens(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text", tokenizer)
    return packing.pack_profiles(sizes.withColumnRenamed("doc_id", "item_id"), {p.profile_id: p.capacity for p in profiles}).withColumnRenamed("item_id", "doc_id")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d, "byte_bpe_50k")


def p7_containers_piece(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d, "piece_bpe_32k")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_kinds(spark, d).select("doc_id")


def p8_kinds(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_documents(spread(table(spark, d, "documents").select("doc_id", "text")))


_SITE = "nullif(split_part(ltrim(replace(lower(source_path), '\\', '/'), '/'), '/', 2), '')"

_P2_BASE = f"""
WITH sites AS (SELECT asset_id, arg_max({_SITE}, (updated_at, source_path)) AS source FROM assets GROUP BY asset_id),
chunk_lines AS (SELECT chunk_id, asset_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no
                FROM knowledge_chunks WHERE text IS NOT NULL),
normal AS (SELECT chunk_id, asset_id, line_no,
                  trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS norm
           FROM chunk_lines WHERE regexp_matches(line, '^\\s*[^#\\s]')),
counted AS (SELECT n.*, s.source FROM normal n JOIN sites s USING (asset_id)
            WHERE s.source IS NOT NULL AND len(list_filter(string_split(norm, ' '), lambda w: regexp_full_match(w, '\\p{{L}}+'))) >= 4),
repeated AS (SELECT source, norm FROM counted GROUP BY source, norm HAVING count(DISTINCT asset_id) >= 6)
"""

SQL = {
    "p1_found": """
SELECT DISTINCT 'chunk' AS item_kind, chunk_id AS item_id FROM knowledge_chunks WHERE length(text) > 4000
UNION ALL SELECT DISTINCT 'revision', revision_id FROM asset_revisions WHERE length(markdown) > 20000""",
    "p2_found": _P2_BASE + "SELECT DISTINCT chunk_id, CAST(line_no AS INTEGER) AS line_no FROM counted JOIN repeated USING (source, norm)",
    "p2_lines": _P2_BASE + """,
line AS (SELECT source, norm, count(DISTINCT asset_id) AS k FROM counted GROUP BY ALL),
size AS (SELECT source, count(DISTINCT asset_id) AS n FROM counted GROUP BY ALL),
used AS (SELECT l.*, s.n, sum(CASE WHEN k < 6 THEN k ELSE 0 END) OVER w AS low, sum(CASE WHEN k >= 6 THEN s.n ELSE 0 END) OVER w AS taken, (SELECT sum(n) FROM size) AS total
         FROM line l JOIN size s USING (source) WINDOW w AS (PARTITION BY norm)),
held AS (SELECT source, norm, k, n, low - CASE WHEN k < 6 THEN k ELSE 0 END AS k2, total - taken - CASE WHEN k < 6 THEN n ELSE 0 END AS n2, total FROM used WHERE k >= 2),
test AS (SELECT source, norm, k::DOUBLE AS k1, n::DOUBLE AS n1, (CASE WHEN n2 > 0 THEN k2 ELSE 1 END)::DOUBLE AS k2, (CASE WHEN n2 > 0 THEN n2 WHEN total > n THEN total - n ELSE n END)::DOUBLE AS n2 FROM held),
share AS (SELECT *, (k1 + k2) / (n1 + n2) AS p FROM test)
SELECT source, upper(md5(norm)) AS line_key, k1::BIGINT AS n_assets, n1::BIGINT AS n_source, k2::BIGINT AS n_outside, n2::BIGINT AS n_others,
  round(CASE WHEN k1 * n2 > k2 * n1 THEN greatest(0, 2 * (k1 * ln(k1 / (n1 * p)) + CASE WHEN n1 > k1 THEN (n1 - k1) * ln((n1 - k1) / (n1 * (1 - p))) ELSE 0 END
    + CASE WHEN k2 > 0 THEN k2 * ln(k2 / (n2 * p)) ELSE 0 END + CASE WHEN n2 > k2 THEN (n2 - k2) * ln((n2 - k2) / (n2 * (1 - p))) ELSE 0 END)) ELSE 0 END, 4) AS llr
FROM share""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_pieces, p1_small_pieces, p2_found, p2_lines, p2_excess, p2_texts, p4_found, p4_paragraphs, p4_chunks, p5_found, p5_groups, p5_links, p6_ids, p7_containers, p7_containers_piece, p8_found, p8_kinds)
}
