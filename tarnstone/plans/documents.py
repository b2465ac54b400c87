"""Queries over texts: chunks of Markdown, packing, reading of parts, judgements on texts, folders of files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnstone.functions import text as T
from tarnstone.operators import chunking, evidence, heuristics, store
from tarnstone.plans import fragments as S
from tarnstone.plans.registry import query
from tarnstone.runtime import shared_dir, table
from tarnstone.sources import directory, files

_BLANK = "^[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x0B\\x1c-\\x1f]*$"

_LINES_SQL = S.REVISIONS + f""",
numbered AS (SELECT revision_id, unnest(l) AS line, generate_subscripts(l, 1) AS line_no FROM (SELECT revision_id, {S.lines('markdown')} AS l FROM revision)),
classed AS (SELECT *, CASE WHEN regexp_matches(line, '^#{{1,6}}\\s+\\S') THEN 'h' WHEN regexp_matches(line, '(?i)^\\s*<!--\\s*page\\s*:\\s*[^>]+?\\s*-->\\s*$') THEN 'm'
                        WHEN regexp_matches(line, '{_BLANK}') THEN 'b' ELSE 'p' END AS kind FROM numbered),
looked AS (SELECT *, lag(kind) OVER w AS previous, last_value(CASE WHEN kind <> 'b' THEN kind END IGNORE NULLS) OVER (PARTITION BY revision_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS solid
           FROM classed WINDOW w AS (PARTITION BY revision_id ORDER BY line_no)),
counted AS (SELECT *, sum(CASE WHEN kind IN ('h', 'm') OR (kind = 'p' AND (solid IS NULL OR (previous = 'b' AND solid = 'p'))) THEN 1 ELSE 0 END) OVER (PARTITION BY revision_id ORDER BY line_no) AS chunk_no FROM looked),
piece AS (SELECT revision_id, chunk_no, min(line_no) AS start_line, max(CASE WHEN kind <> 'b' THEN line_no END) AS end_line FROM counted WHERE chunk_no > 0 GROUP BY ALL)"""


def revisions_of(spark: SparkSession, d: str) -> DataFrame:
    return store.revisions_once(table(spark, d, "asset_revisions").select("asset_id", "revision_id", "markdown", "created_at")).select("revision_id", "markdown")


@query("WITH " + _LINES_SQL + """ SELECT p.revision_id, CAST(p.chunk_no AS BIGINT) AS chunk_no, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line,
string_agg(c.line, chr(10) ORDER BY c.line_no) AS text FROM piece p JOIN counted c ON c.revision_id = p.revision_id AND c.line_no BETWEEN start_line AND end_line GROUP BY ALL""")
def paragraph_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.markdown_chunks(revisions_of(spark, d), ["revision_id"], "markdown").drop("heading_path")


_TITLE = "trim(rtrim(trim(regexp_extract(c.line, '^#{1,6}\\s+(.+?)\\s*$', 1)), '#'))"
_PATHS_SQL = _LINES_SQL + f""",
above AS (SELECT p.revision_id, p.chunk_no, p.start_line, p.end_line, list({{'level': length(regexp_extract(c.line, '^(#{{1,6}})\\s', 1)), 'path': [{_TITLE}]}} ORDER BY c.line_no) FILTER (c.line IS NOT NULL) AS heads
  FROM piece p LEFT JOIN counted c ON c.revision_id = p.revision_id AND c.kind = 'h' AND c.chunk_no <= p.chunk_no GROUP BY ALL),
pathed AS (SELECT revision_id, chunk_no, start_line, end_line, CASE WHEN heads IS NULL THEN [] ELSE list_reduce(heads, lambda a, h: {{'level': h.level, 'path': list_concat(a.path[1:h.level - 1], h.path)}}).path END AS heading_path FROM above)"""


@query("WITH " + _PATHS_SQL + " SELECT revision_id, CAST(chunk_no AS BIGINT) AS chunk_no, heading_path FROM pathed")
def heading_paths(spark: SparkSession, d: str) -> DataFrame:
    return chunking.markdown_chunks(revisions_of(spark, d), ["revision_id"], "markdown").select("revision_id", "chunk_no", "heading_path")


@query("WITH RECURSIVE " + _PATHS_SQL + """,
body AS (SELECT p.revision_id, p.chunk_no, p.heading_path, p.start_line, p.end_line, string_agg(c.line, chr(10) ORDER BY c.line_no) AS text FROM pathed p JOIN counted c ON c.revision_id = p.revision_id AND c.line_no BETWEEN p.start_line AND p.end_line GROUP BY ALL),
part AS (SELECT revision_id, b.chunk_no, c.line_no AS no, unnest(range(greatest(1, ceil(length(line) / 4000.0)::INTEGER))) AS k, line FROM body b JOIN counted c USING (revision_id) WHERE length(b.text) > 4000 AND c.line_no BETWEEN b.start_line AND b.end_line),
cut AS (SELECT revision_id, chunk_no, no, CASE WHEN length(line) > 4000 THEN substr(line, k * 4000 + 1, 4000) ELSE line END AS piece, length(line) > 4000 AS alone, row_number() OVER (PARTITION BY revision_id, chunk_no ORDER BY no, k) AS i FROM part),
step AS (SELECT revision_id, chunk_no, i, no AS start_line, no AS end_line, piece AS text, alone, 1 AS g FROM cut WHERE i = 1
  UNION ALL SELECT c.revision_id, c.chunk_no, c.i, CASE WHEN j THEN s.start_line ELSE c.no END, c.no, CASE WHEN j THEN s.text || chr(10) || c.piece ELSE c.piece END, c.alone, CASE WHEN j THEN s.g ELSE s.g + 1 END
  FROM (SELECT s.*, c.i AS ci, NOT c.alone AND NOT s.alone AND length(s.text) + 1 + length(c.piece) <= 4000 AS j FROM step s JOIN cut c ON c.revision_id = s.revision_id AND c.chunk_no = s.chunk_no AND c.i = s.i + 1) s
  JOIN cut c ON c.revision_id = s.revision_id AND c.chunk_no = s.chunk_no AND c.i = s.ci),
last_step AS (SELECT DISTINCT ON (revision_id, chunk_no, g) revision_id, chunk_no, g, start_line, end_line, text FROM step ORDER BY revision_id, chunk_no, g, i DESC)
SELECT revision_id, CAST(chunk_no AS BIGINT) AS chunk_no, heading_path, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, text FROM body WHERE length(text) <= 4000 AND NOT regexp_matches(text, '""" + _BLANK + """')
UNION ALL SELECT l.revision_id, CAST(l.chunk_no AS BIGINT), b.heading_path, CAST(l.start_line AS INTEGER), CAST(l.end_line AS INTEGER), l.text FROM last_step l JOIN body b USING (revision_id, chunk_no) WHERE NOT regexp_matches(l.text, '""" + _BLANK + "')")
def bounded_chunks(spark: SparkSession, d: str) -> DataFrame:
    chunks = chunking.markdown_chunks(revisions_of(spark, d), ["revision_id"], "markdown")
    return chunking.bounded_chunks(chunks, ["revision_id"])


@query("""WITH RECURSIVE doc AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM doc),
part AS (SELECT doc_id, no, unnest(range(greatest(1, ceil(length(line) / 1200.0)::INTEGER))) AS k, line FROM line),
cut AS (SELECT doc_id, no, k, CASE WHEN length(line) > 1200 THEN substr(line, k * 1200 + 1, 1200) ELSE line END AS piece, length(line) > 1200 AS alone,
               row_number() OVER (PARTITION BY doc_id ORDER BY no, k) AS i FROM part),
step AS (SELECT doc_id, i, no AS start_line, no AS end_line, piece AS text, alone, 1 AS g FROM cut WHERE i = 1
  UNION ALL SELECT c.doc_id, c.i, CASE WHEN j THEN s.start_line ELSE c.no END, c.no, CASE WHEN j THEN s.text || chr(10) || c.piece ELSE c.piece END, c.alone, CASE WHEN j THEN s.g ELSE s.g + 1 END
  FROM (SELECT s.*, c.i AS ci, NOT c.alone AND NOT s.alone AND length(s.text) + 1 + length(c.piece) <= 1200 AS j FROM step s JOIN cut c ON c.doc_id = s.doc_id AND c.i = s.i + 1) s JOIN cut c ON c.doc_id = s.doc_id AND c.i = s.ci),
last_step AS (SELECT DISTINCT ON (doc_id, g) doc_id, g, start_line, end_line, text FROM step ORDER BY doc_id, g, i DESC)
SELECT doc_id, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, md5(text) AS digest FROM last_step WHERE NOT regexp_matches(text, '""" + _BLANK + "')")
def chunk_packing(spark: SparkSession, d: str) -> DataFrame:
    """Lines of every document packed into pieces of at most 1200 characters."""
    rows = table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", "text").distinct()
    pieces = rows.select("doc_id", F.inline(chunking.bounded(F.split("text", "\n"), F.lit(1), 1200)))
    return pieces.select("doc_id", F.col("start").alias("start_line"), F.col("last").alias("end_line"), F.md5("text").alias("digest"))


@query(f"""WITH {S.REVISIONS} SELECT revision_id, CASE WHEN len(l) >= 6 THEN array_to_string(l[3:6], chr(10)) END AS content FROM (SELECT revision_id, {S.lines('markdown')} AS l FROM revision)""")
def read_line_range(spark: SparkSession, d: str) -> DataFrame:
    return revisions_of(spark, d).select("revision_id", evidence.line_range(F.col("markdown"), F.lit(3), F.lit(6)).alias("content"))


@query(f"""WITH {S.REVISIONS},
numbered AS (SELECT revision_id, unnest(l) AS line, generate_subscripts(l, 1) AS no, len(l) AS n FROM (SELECT revision_id, {S.lines('markdown')} AS l FROM revision)),
head AS (SELECT revision_id, no, length(regexp_extract(line, '^(#{{1,6}})\\s', 1)) AS level, {S.fold("trim(rtrim(trim(regexp_extract(line, '^#{1,6}\\s+(.+?)\\s*$', 1)), '#'))")} AS title FROM numbered WHERE regexp_matches(line, '^#{{1,6}}\\s+\\S')),
own AS (SELECT revision_id, min(no) AS no, arg_min(level, no) AS level FROM head WHERE title = 'governance' GROUP BY revision_id),
bound AS (SELECT o.revision_id, o.no AS first, coalesce(min(h.no) - 1, any_value(m.n)) AS last FROM own o JOIN (SELECT DISTINCT revision_id, n FROM numbered) m USING (revision_id)
  LEFT JOIN head h ON h.revision_id = o.revision_id AND h.no > o.no AND h.level <= o.level GROUP BY o.revision_id, o.no)
SELECT b.revision_id, string_agg(line, chr(10) ORDER BY x.no) AS content FROM bound b JOIN numbered x ON x.revision_id = b.revision_id AND x.no BETWEEN first AND last GROUP BY b.revision_id""")
def read_section(spark: SparkSession, d: str) -> DataFrame:
    return revisions_of(spark, d).select("revision_id", evidence.section(F.col("markdown"), F.lit("Governance")).alias("content")).where(F.col("content").isNotNull())


@query(f"SELECT doc_id, {S.first_bytes('text', 1000)} AS content, strlen(text) > 1000 AS truncated FROM documents WHERE text IS NOT NULL")
def read_truncated(spark: SparkSession, d: str) -> DataFrame:
    """The first 1000 bytes of every document, no character cut."""
    rows = table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", "text")
    return rows.select("doc_id", T.first_bytes(F.col("text"), 1000).alias("content"), (F.octet_length("text") > 1000).alias("truncated"))


@query(f"""WITH {S.ASSETS}, locator AS (SELECT DISTINCT ON (chunk_id) asset_id, revision_id, chunk_id, start_line, end_line, text FROM knowledge_chunks WHERE chunk_id IS NOT NULL)
SELECT l.asset_id, l.revision_id, l.chunk_id, l.start_line, l.end_line,
       CASE WHEN a.current_revision_id IS NULL THEN 'NOT_FOUND' WHEN a.current_revision_id <> l.revision_id THEN 'STALE_LOCATOR' ELSE 'OK' END AS status,
       CASE WHEN a.current_revision_id = l.revision_id THEN sha256(coalesce(l.text, '')) END AS content_hash,
       CASE WHEN a.current_revision_id = l.revision_id THEN strlen(coalesce(l.text, '')) > 1000000 END AS truncated, a.current_revision_id AS source_revision
FROM locator l LEFT JOIN current_asset a USING (asset_id)""")
def read_status(spark: SparkSession, d: str) -> DataFrame:
    """Locators of all chunks ever made, read against what is current."""
    chunks = table(spark, d, "knowledge_chunks").where(F.col("chunk_id").isNotNull()).dropDuplicates(["chunk_id"])
    locators = chunks.select("asset_id", "revision_id", "chunk_id", "start_line", "end_line")
    return evidence.read_chunks(locators, store.current_assets(table(spark, d, "assets")), chunks, evidence.MAX_BYTES).drop("content")


@query(f"""SELECT doc_id, {S.collapse("regexp_replace(text, '([\\p{L}\\p{N}_])-\\s*\\n\\s*([\\p{L}\\p{N}_])', '\\1\\2', 'g')")} AS clean FROM documents WHERE text IS NOT NULL""")
def dehyphenate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", T.collapse(T.join_divided(F.col("text"))).alias("clean"))


def _any_of(signs: list[str]) -> str:
    return "(" + " OR ".join(f"contains(t, '{s}')" for s in signs) + ")"


@query(f"""WITH titled AS (SELECT doc_id, {S.collapse(S.fold('title'))} AS t FROM documents)
SELECT doc_id, coalesce(t = '' OR CASE WHEN length(regexp_replace(t, '[^\\x{{4e00}}-\\x{{9fff}}]', '', 'g')) <= 8 AND {_any_of(heuristics.CONTEXT)} THEN NOT {_any_of(heuristics.DOMAIN)}
  ELSE regexp_matches(t, '^(?:what|which)\\s+(?:are|about)\\s+(?:the\\s+)?(?:four|three|two)\\??$') END, true) AS needs_context FROM titled""")
def clarification_flags(spark: SparkSession, d: str) -> DataFrame:
    """Documents by whether their title could be searched for by itself."""
    return table(spark, d, "documents").select("doc_id", heuristics.needs_context(F.col("title")).alias("needs_context"))


@query("""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)(api[_-]?key|token|password|secret|authorization)(\\s*[:=]\\s*)([^\\s,;]+)', '\\1\\2[REDACTED]', 'g'),
'(?i)\\bBearer\\s+[^\\s,;]+', '[REDACTED]', 'g'), '\\b(?:sk-ant|lin_api)_[A-Za-z0-9_-]{6,}\\b', '[REDACTED]', 'g'), '\\bAKIA[0-9A-Z]{16}\\b', '[REDACTED]', 'g')) AS digest FROM documents WHERE text IS NOT NULL""")
def secret_redaction(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", F.md5(T.redact(F.col("text"))).alias("digest"))


@query("""SELECT lang, source, count(*) AS n_documents, count(text) AS n_texts, count(DISTINCT md5(text)) AS n_different, coalesce(sum(strlen(text)), 0)::BIGINT AS n_bytes FROM documents GROUP BY lang, source""")
def document_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("lang", "source", "text")
    return rows.groupBy("lang", "source").agg(F.count("*").alias("n_documents"), F.count("text").alias("n_texts"), F.countDistinct(F.md5("text")).alias("n_different"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("bigint").alias("n_bytes"))


@query("WITH " + _LINES_SQL + """ SELECT p.revision_id, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line FROM piece p JOIN counted c ON c.revision_id = p.revision_id AND c.line_no = p.start_line WHERE c.kind = 'm'""")
def page_marker_chunks(spark: SparkSession, d: str) -> DataFrame:
    chunks = chunking.markdown_chunks(revisions_of(spark, d), ["revision_id"], "markdown")
    return chunks.where(T.is_page_marker(F.get(F.split("text", "\n"), F.lit(0)))).select("revision_id", "start_line", "end_line")


def _put(spark: SparkSession, d: str) -> str:
    """A folder with the current revisions as files."""
    folder = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    current = store.current_revisions(table(spark, d, "assets"), table(spark, d, "asset_revisions").select("asset_id", "revision_id", "markdown", "created_at"))
    directory.put_directory(current, folder)
    return folder


@query(f"WITH {S.CURRENT} SELECT asset_id, revision_id, sha256(markdown) AS content_hash FROM current_revision WHERE markdown IS NOT NULL")
def directory_store(spark: SparkSession, d: str) -> DataFrame:
    """The current revisions put into a folder, put again, and read from there: each is there once."""
    folder = _put(spark, d)
    directory.put_directory(directory.scan_directory(spark, folder), folder)
    return directory.scan_directory(spark, folder).select("asset_id", "revision_id", F.sha2("markdown", 256).alias("content_hash"))


@query(f"""WITH {S.CURRENT} SELECT sha256(markdown || chr(10)) AS source_hash, 'local' AS parser_name, 'utf8-v1' AS parser_version, strlen(markdown) + 1 AS n_bytes,
len(list_filter({S.lines('markdown')}, lambda x: regexp_matches(x, '^#{{1,6}}\\s+\\S'))) AS n_headings, CAST(NULL AS VARCHAR) AS error FROM current_revision WHERE markdown IS NOT NULL""")
def ingest_folder(spark: SparkSession, d: str) -> DataFrame:
    """The same folder taken in as files that someone put there."""
    read = files.extract(files.scan_folder(spark, _put(spark, d)))
    return read.select("source_hash", "parser_name", "parser_version", F.octet_length("markdown").cast("bigint").alias("n_bytes"), F.size(files.content_list(F.col("markdown"))).cast("bigint").alias("n_headings"), "error")


@query("SELECT source_id, title, authority, practice_area, status, effective_date, landing_url, download_url, format, notes FROM source_manifest")
def manifest_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The manifest written as JSON lines and read as a manifest."""
    folder = f"{shared_dir(spark)}/manifest-{uuid.uuid4().hex}"
    table(spark, d, "source_manifest").write.json(folder)
    return files.read_manifest(spark, folder)


@query("SELECT case_id, question, len(expected_sources) AS n_sources, answerable, retrieval_max_expected_rank, len(required_claims) AS n_claims FROM gold_cases")
def cases_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The gold cases written as JSON lines and read as cases."""
    folder = f"{shared_dir(spark)}/cases-{uuid.uuid4().hex}"
    table(spark, d, "gold_cases").write.json(folder)
    count = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).cast("bigint")
    return files.read_cases(spark, folder).select("case_id", "question", count("expected_sources").alias("n_sources"), "answerable", "retrieval_max_expected_rank", count("required_claims").alias("n_claims"))


@query("""SELECT doc_id, regexp_matches(text, '\\bsk-ant-[A-Za-z0-9_-]{12,}\\b') OR regexp_matches(text, '\\blin_api_[A-Za-z0-9_-]{6,}\\b') OR regexp_matches(text, '\\bAKIA[0-9A-Z]{16}\\b')
OR regexp_matches(text, '(?i)\\b(?:api[_ -]?key|authorization|password|secret|token)\\s*[:=]\\s*\\S+') AS credential FROM documents WHERE text IS NOT NULL""")
def credential_flags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", T.holds_credential(F.col("text")).alias("credential"))


@query("SELECT doc_id, to_base64(encode(text)) AS content FROM documents WHERE text IS NOT NULL")
def binary_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Texts as evidence of bytes, in base64."""
    return table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", F.translate(F.base64(F.encode("text", "UTF-8")), "\r\n", "").alias("content"))
