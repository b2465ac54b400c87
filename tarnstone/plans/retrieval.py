"""Queries that search: literal, lexical, by vectors, and fused; all gold cases in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnstone.functions import ids
from tarnstone.functions import text as T
from tarnstone.operators import evaluation, evidence, fusion, index, lexical, store, vectors
from tarnstone.plans import fragments as S
from tarnstone.plans.registry import query
from tarnstone.runtime import broadcast_if_small, materialize, spread, table

TOP = 200


def chunks_of(spark: SparkSession, d: str) -> DataFrame:
    return store.current_chunks(table(spark, d, "assets"), spread(table(spark, d, "knowledge_chunks")))


def cases_of(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.gold_cases(table(spark, d, "gold_cases"))


def index_of(spark: SparkSession, d: str) -> index.Index:
    """The stored index of the current chunks, built by the first search of a session."""
    assets, chunks = table(spark, d, "assets"), table(spark, d, "knowledge_chunks")
    return index.of_table(spark, d, store.current_chunks(assets, chunks), lambda: store.current_chunks(assets, chunks, sized=True))


def terms_of(spark: SparkSession, d: str) -> DataFrame:
    return lexical.query_terms(cases_of(spark, d), "case_id", "query")


def with_ids(spark: SparkSession, d: str, hits: DataFrame, *columns: str) -> DataFrame:
    """hits (chunk_no, ...) with columns of their chunks; the hits are the small side."""
    chunks = index_of(spark, d).chunks.select("chunk_no", *columns)
    return chunks.join(broadcast_if_small(hits), "chunk_no").select(*hits.columns, *columns)


def numbered_hits(spark: SparkSession, d: str, limit: int = TOP, queries: DataFrame | None = None) -> DataFrame:
    """(case_id, chunk_no, score, rank): the best chunks of each gold case, or each row of queries
    (case_id, query), by BM25. A case without
    any gets the first chunks that hold one of its words inside other words."""
    stored = index_of(spark, d)
    cases = cases_of(spark, d).select("case_id", "query") if queries is None else queries
    terms = lexical.query_terms(cases, "case_id", "query")
    hits = materialize(index.lexical_hits(stored, terms, "case_id", limit).select("case_id", "chunk_no", "score", "rank"), "hits")
    rest = cases.join(hits.select("case_id").distinct(), "case_id", "left_anti")
    words = materialize(rest.select("case_id", F.explode(F.array_distinct(T.words(F.col("query")))).alias("word")), "words-without-hits")
    if words.isEmpty():
        return hits
    found = index.by_substrings(stored.chunks, "chunk_no", lexical.chunk_fields(), words, "case_id", ["start_line", "end_line"], limit)
    return hits.unionByName(found.select(*hits.columns))


def lexical_hits(spark: SparkSession, d: str, limit: int = TOP) -> DataFrame:
    """(case_id, chunk_id, score, rank), see numbered_hits."""
    return with_ids(spark, d, numbered_hits(spark, d, limit), "chunk_id").select("case_id", "chunk_id", "score", "rank")


@query(f"""WITH {S.CHUNKS},
found AS (SELECT chunk_id, {S.lines('text')} AS l, list_position(list_transform({S.lines('text')}, lambda x: contains({S.fold('x')}, 'settlement patterns')), true) AS line_no FROM chunk WHERE contains({S.fold('text')}, 'settlement patterns'))
SELECT chunk_id, CAST(line_no AS INTEGER) AS line_no, left(l[line_no], 240) AS preview FROM found WHERE line_no > 0""")
def literal_search(spark: SparkSession, d: str) -> DataFrame:
    return evidence.literal_hits(chunks_of(spark, d), "chunk_id", F.col("text"), "Settlement patterns")


@query(f"""WITH {S.CHUNKS},
found AS (SELECT chunk_id, {S.lines('text')} AS l, list_position(list_transform({S.lines('text')}, lambda x: contains(x, 'Neither the')), true) AS line_no FROM chunk WHERE contains(text, 'Neither the'))
SELECT chunk_id, CAST(line_no AS INTEGER) AS line_no, left(l[line_no], 240) AS preview FROM found WHERE line_no > 0""")
def literal_search_case(spark: SparkSession, d: str) -> DataFrame:
    return evidence.literal_hits(chunks_of(spark, d), "chunk_id", F.col("text"), "Neither the", case_sensitive=True)


@query(S.BM25.split(",\npart AS")[0].replace("\n  WHERE term IN (SELECT term FROM question_term)", "") .replace("WITH", "") and "WITH " + S.BM25.split(",\npart AS")[0] + " SELECT field, term, df FROM frequency")
def term_document_frequency(spark: SparkSession, d: str) -> DataFrame:
    return index_of(spark, d).frequency.join(broadcast_if_small(terms_of(spark, d).select("term").distinct()), "term", "left_semi").select("field", "term", "df")


@query("WITH " + S.BM25.split(",\neach_term AS")[0] + " SELECT n, round(average, 6) AS average FROM statistics")
def lexical_statistics(spark: SparkSession, d: str) -> DataFrame:
    return index_of(spark, d).statistics.select("n", F.round("average", 6).alias("average"))


@query("WITH " + S.BM25 + " SELECT case_id, chunk_id, score, rank FROM hit WHERE rank <= 10")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return lexical_hits(spark, d, 10)


@query("WITH " + S.BM25 + """, scoped AS (
  SELECT s.case_id, s.chunk_id, s.score FROM score s JOIN chunk k USING (chunk_id) JOIN current_asset a ON a.asset_id = k.asset_id
  WHERE starts_with(trim(replace(lower(a.source_path), chr(92), '/'), '/'), 'library/dorford-board-0000/'))
SELECT case_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY case_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM scoped QUALIFY rank <= 10""")
def bm25_scoped(spark: SparkSession, d: str) -> DataFrame:
    """The scope narrows the chunks before they are scored, not the statistics."""
    stored = index_of(spark, d)
    inside = store.current_assets(table(spark, d, "assets")).where(evidence.in_path_scope(F.col("source_path"), "library/dorford-board-0000")).select("asset_id")
    within = stored.chunks.select("chunk_no", "asset_id").join(broadcast_if_small(inside), "asset_id", "left_semi").select("chunk_no")
    hits = lexical.top(index.lexical_scores(stored, terms_of(spark, d), "case_id", within=within), "case_id", "chunk_no", 10)
    return with_ids(spark, d, materialize(hits, "hits"), "chunk_id").select("case_id", "chunk_id", "score", "rank")


@query("WITH " + S.BM25.replace("), 'heading'", "), 'heading'").replace("5.0 AS weight", "1.0 AS weight").replace("'heading', 3.0", "'heading', 1.0") + " SELECT case_id, chunk_id, score, rank FROM hit WHERE rank <= 5")
def bm25_equal_weights(spark: SparkSession, d: str) -> DataFrame:
    scores = index.lexical_scores(index_of(spark, d), terms_of(spark, d), "case_id", dict.fromkeys(lexical.CHUNK_WEIGHTS, 1.0))
    return with_ids(spark, d, materialize(lexical.top(scores, "case_id", "chunk_no", 5), "hits"), "chunk_id").select("case_id", "chunk_id", "score", "rank")


@query(f"""WITH {S.CURRENT},
{S.CASES},
question_word AS (SELECT DISTINCT case_id, unnest({S.words('query')}) AS word FROM gold),
question_term AS (SELECT case_id, word, unnest({S.terms('word')}) AS term FROM question_word),
sized AS (SELECT revision_id, {S.terms("coalesce(source_name, '')")} AS t1, {S.terms("coalesce(markdown, '')")} AS t2 FROM current_revision),
statistics AS (SELECT count(*) AS n, avg(len(t1) + len(t2)) AS average FROM sized),
each_term AS (SELECT revision_id, len(t1) + len(t2) AS length, 'source_name' AS field, 5.0 AS weight, unnest(t1) AS term FROM sized
  UNION ALL SELECT revision_id, len(t1) + len(t2), 'markdown', 1.0, unnest(t2) FROM sized),
posting AS (SELECT revision_id, field, weight, term, count(*) AS tf, any_value(length) AS length FROM each_term WHERE term IN (SELECT term FROM question_term) GROUP BY ALL),
frequency AS (SELECT field, term, count(*) AS df FROM posting GROUP BY ALL),
part AS (SELECT revision_id, p.term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END
         * (tf * weight) * 2.2 / (tf * weight + 1.2 * (0.25 + 0.75 * length / average)) AS value
  FROM posting p JOIN frequency f ON p.field = f.field AND p.term = f.term, statistics),
row_part AS (SELECT revision_id, term, sum(value) AS value FROM part GROUP BY ALL),
score AS (SELECT case_id, revision_id, round(sum(value), 6) AS score FROM row_part JOIN question_term USING (term) GROUP BY ALL)
SELECT case_id, revision_id, score, CAST(row_number() OVER (PARTITION BY case_id ORDER BY score DESC, revision_id) AS INTEGER) AS rank FROM score QUALIFY rank <= 200""")
def asset_search(spark: SparkSession, d: str) -> DataFrame:
    rows = store.current_revisions(table(spark, d, "assets"), table(spark, d, "asset_revisions").select("asset_id", "revision_id", "source_name", "markdown", "created_at"))
    terms = lexical.query_terms(cases_of(spark, d), "case_id", "query")
    scores = lexical.bm25(rows, "revision_id", {"source_name": F.col("source_name"), "markdown": F.col("markdown")}, lexical.ASSET_WEIGHTS, terms, "case_id")
    return lexical.top(scores, "case_id", "revision_id", TOP)


_CUT = S.CASES.replace("gold AS (", "whole_case AS (") + f""",
gold AS (SELECT case_id, substr(w, 1, length(w) - 2) AS query FROM (SELECT case_id, arg_max(w, (length(w), w)) AS w FROM (SELECT case_id, unnest({S.words('query')}) AS w FROM whole_case) WHERE length(w) > 5 GROUP BY case_id))"""


@query("WITH " + S.BM25.replace(S.CASES, _CUT) + f""",
word AS (SELECT DISTINCT case_id, unnest({S.words('query')}) AS w FROM gold WHERE case_id NOT IN (SELECT case_id FROM hit)),
held AS (SELECT case_id, chunk_id, start_line, end_line, count(*)::DOUBLE AS score FROM word JOIN chunk ON contains(lower(concat_ws(chr(10), coalesce(source_name, ''), array_to_string(coalesce(heading_path, []), ' '), coalesce(text, ''))), w) GROUP BY ALL),
placed AS (SELECT case_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY case_id ORDER BY start_line, end_line, chunk_id) AS INTEGER) AS rank FROM held)
SELECT case_id, chunk_id, score, rank FROM hit WHERE rank <= 20 UNION ALL SELECT * FROM placed WHERE rank <= 20""")
def substring_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The longest word of each case without its last two letters: mostly no word of the index, so
    that the first chunks that hold it inside a word are the hits."""
    word = cases_of(spark, d).select("case_id", F.explode(T.words(F.col("query"))).alias("w")).where(F.length("w") > 5)
    cut = word.groupBy("case_id").agg(F.max_by("w", F.struct(F.length("w"), "w")).alias("w")).select("case_id", F.expr("substring(w, 1, length(w) - 2)").alias("query"))
    return with_ids(spark, d, numbered_hits(spark, d, 20, materialize(cut, "cut-words")), "chunk_id").select("case_id", "chunk_id", "score", "rank")


_FEATURES = """
edged AS (SELECT word, '^' || word || '$' AS e FROM (SELECT DISTINCT word FROM counted)),
feature AS (SELECT word, 'w:' || word AS f, 2.0 AS weight FROM edged
  UNION ALL SELECT word, 'c' || n || ':' || substr(e, i, n), 0.5 FROM (SELECT word, e, n, unnest(range(1, length(e) - n + 2)) AS i FROM edged, (SELECT unnest([2, 3, 4]) AS n))),
bucket AS (SELECT word, CAST(('0x' || substr(sha256(f), 1, 12))::BIGINT % 2048 AS INTEGER) AS idx, sum(weight) AS weight FROM feature GROUP BY ALL),
raw AS (SELECT k, idx, sum(n * weight) AS val FROM counted JOIN bucket USING (word) GROUP BY ALL),
vec AS (SELECT k, idx, val / sqrt(sum(val * val) OVER (PARTITION BY k)) AS val FROM raw)"""


@query(f"""WITH {S.CASES}, counted AS (SELECT k, word, count(*) AS n FROM (SELECT case_id AS k, unnest({S.words('query')}) AS word FROM gold) GROUP BY ALL),
{_FEATURES} SELECT k AS case_id, idx, round(val, 9) AS val FROM vec""")
def ngram_query_vectors(spark: SparkSession, d: str) -> DataFrame:
    return vectors.ngram_vectors(cases_of(spark, d), "case_id", F.col("query")).withColumn("val", F.round("val", 9))


_SEMANTIC_SQL = f"""{S.CHUNKS},
{S.CASES},
counted AS (SELECT k, word, count(*) AS n FROM (
  SELECT case_id AS k, unnest({S.words('query')}) AS word FROM gold
  UNION ALL SELECT chunk_id, unnest({S.words("concat_ws(chr(10), array_to_string(heading_path, chr(10)), coalesce(text, ''))")}) FROM chunk) GROUP BY ALL),
{_FEATURES.strip()},
alike AS (SELECT q.k AS case_id, c.k AS chunk_id, round(sum(q.val * c.val), 6) AS score
  FROM vec q JOIN gold g ON q.k = g.case_id JOIN vec c ON q.idx = c.idx JOIN chunk h ON c.k = h.chunk_id GROUP BY ALL HAVING round(sum(q.val * c.val), 6) >= 0.12),
semantic AS (SELECT case_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY case_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM alike QUALIFY rank <= 200)"""


def semantic_numbers(spark: SparkSession, d: str, limit: int = TOP) -> DataFrame:
    """(case_id, chunk_no, score, rank): the best chunks of each gold case by n-gram cosine."""
    asked = cases_of(spark, d).select(F.col("case_id").alias("key"), F.col("query").alias("text"))
    return materialize(index.semantic_hits(index_of(spark, d), asked, limit).withColumnsRenamed({"query": "case_id", "key": "chunk_no"}), "semantic")


def semantic_hits(spark: SparkSession, d: str, limit: int = TOP) -> DataFrame:
    """(case_id, chunk_id, score, rank), see semantic_numbers."""
    return with_ids(spark, d, semantic_numbers(spark, d, limit), "chunk_id").select("case_id", "chunk_id", "score", "rank")


@query("WITH " + _SEMANTIC_SQL + " SELECT case_id, chunk_id, score, rank FROM semantic WHERE rank <= 10")
def ngram_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return semantic_hits(spark, d, 10)


def hybrid_numbers(spark: SparkSession, d: str, weight: float = fusion.SEMANTIC_WEIGHT, limit: int = TOP) -> DataFrame:
    """(case_id, chunk_no, score, rank); numbers rise with the ids, so ties rank as by id."""
    return fusion.reciprocal_rank_fusion(numbered_hits(spark, d, limit), semantic_numbers(spark, d, limit), "case_id", "chunk_no", weight)


_HYBRID_SQL = "WITH " + S.BM25 + ",\n" + _SEMANTIC_SQL.split(f"{S.CASES},\n", 1)[1] + """,
fused AS (SELECT case_id, chunk_id, round(sum(part), 9) AS score FROM (
  SELECT case_id, chunk_id, 0.65 / (60 + rank) AS part FROM hit UNION ALL SELECT case_id, chunk_id, 0.35 / (60 + rank) FROM semantic) GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY case_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM fused)"""


@query(_HYBRID_SQL + " SELECT case_id, chunk_id, score, rank FROM ranked WHERE rank <= 20")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    return with_ids(spark, d, hybrid_numbers(spark, d).where(F.col("rank") <= 20), "chunk_id").select("case_id", "chunk_id", "score", "rank")


@query(_HYBRID_SQL + " SELECT case_id, chunk_id, rank FROM ranked WHERE rank BETWEEN 21 AND 40")
def hybrid_page_2(spark: SparkSession, d: str) -> DataFrame:
    return with_ids(spark, d, hybrid_numbers(spark, d).where(F.col("rank").between(21, 40)), "chunk_id").select("case_id", "chunk_id", "rank")


@query("WITH " + S.BM25 + " SELECT case_id, chunk_id, round(1.0 / (60 + rank), 9) AS score FROM hit WHERE rank <= 20")
def fusion_lexical_only(spark: SparkSession, d: str) -> DataFrame:
    hits = lexical_hits(spark, d, 20)
    return fusion.reciprocal_rank_fusion(hits, hits, "case_id", "chunk_id", 0.0).select("case_id", "chunk_id", "score")


@query(_HYBRID_SQL + f""", shown AS (SELECT r.case_id, r.chunk_id, r.rank FROM ranked r JOIN gold g USING (case_id) JOIN chunk k USING (chunk_id)
  WHERE contains(concat_ws(' ', k.source_name, array_to_string(coalesce(k.heading_path, []), ' '), k.text), g.query))
SELECT case_id, chunk_id, rank FROM shown""")
def hybrid_case_sensitive(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid hits that hold the query as it is written."""
    whole = F.concat_ws(" ", "source_name", F.array_join(F.coalesce("heading_path", F.array().cast("array<string>")), " "), "text")
    asked = hybrid_numbers(spark, d).join(broadcast_if_small(cases_of(spark, d).select("case_id", "query")), "case_id")
    texts = index_of(spark, d).chunks.select("chunk_no", "chunk_id", whole.alias("whole"))
    met = texts.join(broadcast_if_small(asked.select("case_id", "chunk_no", "rank", "query")), "chunk_no")
    return met.where(F.contains("whole", F.col("query"))).select("case_id", "chunk_id", "rank")


@query("WITH " + S.BM25 + """ SELECT h.case_id, sha256(concat_ws(chr(2), h.case_id, string_agg(k.asset_id || chr(1) || k.revision_id, chr(2) ORDER BY h.rank))) AS snapshot_id, count(*) AS n_hits
FROM hit h JOIN chunk k USING (chunk_id) GROUP BY h.case_id""")
def snapshot_id(spark: SparkSession, d: str) -> DataFrame:
    where = chunks_of(spark, d).select("chunk_id", "asset_id", "revision_id")
    return evidence.snapshot_ids(lexical_hits(spark, d).join(where, "chunk_id"), "case_id", "rank", "asset_id", "revision_id")


@query("WITH " + S.BM25 + """ SELECT h.case_id, h.rank, '{"provider":"assets","resource_id":"' || k.asset_id || '","revision":"' || k.revision_id || '","selector":{"end":' || k.end_line || ',"id":"' || k.chunk_id || '","start":' || k.start_line || ',"type":"chunk"},"version":1}' AS locator,
left(k.text, 240) AS preview, printf('%s:%08d:%s', lower(k.source_name), k.start_line, k.chunk_id) AS ordering_key
FROM hit h JOIN chunk k USING (chunk_id) WHERE h.rank <= 3""")
def locator_hits(spark: SparkSession, d: str) -> DataFrame:
    met = lexical_hits(spark, d, 3).join(chunks_of(spark, d), "chunk_id")
    locator = ids.locator("assets", F.col("asset_id"), F.col("revision_id"), F.col("chunk_id"), F.col("start_line"), F.col("end_line"))
    key = F.format_string("%s:%08d:%s", F.lower("source_name"), "start_line", "chunk_id")
    return met.select("case_id", "rank", locator.alias("locator"), F.left("text", F.lit(240)).alias("preview"), key.alias("ordering_key"))


@query("""WITH asked AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0),
scored AS (SELECT a.vec_id AS query, b.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) / sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS score
  FROM asked a, embeddings b WHERE a.vec_id <> b.vec_id)
SELECT query, vec_id, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored QUALIFY rank <= 10""")
def dense_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    return vectors.nearest(rows, rows.where(F.col("vec_id") % 50 == 0), "vec_id", "embedding", 10)


def _chunk_text() -> Column:
    return F.concat_ws("\n", F.array_join("heading_path", "\n"), F.coalesce("text", F.lit("")))


@query()
def digest_vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors.sparse_vectors(index_of(spark, d).chunks, "chunk_id", _chunk_text(), "blake2b")
    return rows.withColumn("norm", F.when(F.size("idx") > 0, 1.0).otherwise(0.0))


@query()
def digest_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """The nearest chunks under another encoder, all above 0."""
    stored, asked = index_of(spark, d).chunks, cases_of(spark, d).select(F.col("case_id").alias("key"), F.col("query").alias("text"))
    rows = vectors.sparse_vectors(stored, "chunk_no", _chunk_text(), "blake2b")
    hits = vectors.search_blocks(vectors.sparse_blocks(rows, "chunk_no"), vectors.ngram_blocks(asked, "blake2b"), 10, None)
    return with_ids(spark, d, materialize(hits.withColumnsRenamed({"query": "case_id", "key": "chunk_no"}), "digest-hits"), "chunk_id").select("case_id", "chunk_id", "score", "rank")


@query(f"""WITH {S.CASES}, counted AS (SELECT k, word, count(*) AS n FROM (SELECT case_id AS k, unnest({S.words('query')}) AS word FROM gold UNION ALL SELECT 'q:' || case_id, unnest({S.words('question')}) FROM gold) GROUP BY ALL),
{_FEATURES} SELECT substr(q.k, 3) AS asked, c.k AS case_id, round(sum(q.val * c.val), 6) AS score FROM vec q JOIN vec c ON q.idx = c.idx WHERE starts_with(q.k, 'q:') AND NOT starts_with(c.k, 'q:') GROUP BY ALL HAVING round(sum(q.val * c.val), 6) >= 0.5""")
def alike_cases(spark: SparkSession, d: str) -> DataFrame:
    """For each case's question the cases whose queries are alike, by a join on the coordinates."""
    cases = cases_of(spark, d)
    asked = vectors.ngram_vectors(cases.select(F.col("case_id").alias("asked"), "question"), "asked", F.col("question"))
    return vectors.sparse_cosine(asked, "asked", vectors.ngram_vectors(cases, "case_id", F.col("query")), "case_id", 0.5)


@query("""SELECT a.vec_id, b.vec_id AS next_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) / sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS score
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def dense_cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each vector with the next one."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    following = rows.select(F.col("vec_id").alias("next_id"), F.col("embedding").alias("next"))
    met = rows.join(following, F.col("next_id") == F.col("vec_id") + 1)
    return met.select("vec_id", "next_id", F.round(vectors.dense_cosine(F.col("embedding"), F.col("next"), strict=True), 6).alias("score"))


@query("WITH " + S.BM25.split(",\nfrequency AS")[0] + " SELECT chunk_id, field, term, tf, CAST(length AS INTEGER) AS length FROM posting")
def term_postings(spark: SparkSession, d: str) -> DataFrame:
    asked = index_of(spark, d).postings.join(broadcast_if_small(terms_of(spark, d).select("term").distinct()), "term", "left_semi")
    return with_chunk_ids(spark, d, asked)


def with_chunk_ids(spark: SparkSession, d: str, posted: DataFrame) -> DataFrame:
    """Postings by chunk_id; both sides are bucketed by the number, so nothing is shuffled."""
    ids_ = index_of(spark, d).chunks.select("chunk_no", "chunk_id")
    return posted.join(ids_, "chunk_no").select("chunk_id", "field", "term", "tf", "length")


_INDEX_SQL = "WITH " + S.BM25.split(",\nfrequency AS")[0].replace("\n  WHERE term IN (SELECT term FROM question_term)", "")


@query(_INDEX_SQL + " SELECT chunk_id, field, term, tf, CAST(length AS INTEGER) AS length FROM posting")
def inverted_index(spark: SparkSession, d: str) -> DataFrame:
    """The postings of all terms; term_postings has those of the questions' terms."""
    return with_chunk_ids(spark, d, index_of(spark, d).postings)


@query(_INDEX_SQL + " SELECT field, term, count(*) AS df FROM posting GROUP BY ALL")
def inverted_index_frequency(spark: SparkSession, d: str) -> DataFrame:
    return index_of(spark, d).frequency.select("field", "term", "df")


@query("WITH " + _SEMANTIC_SQL + " SELECT case_id, chunk_id, round(1.0 / (60 + rank), 9) AS score FROM semantic WHERE rank <= 20")
def fusion_semantic_only(spark: SparkSession, d: str) -> DataFrame:
    hits = semantic_hits(spark, d, 20)
    return fusion.reciprocal_rank_fusion(hits, hits, "case_id", "chunk_id", 1.0).select("case_id", "chunk_id", "score")


@query("WITH " + S.BM25 + """, listed AS (SELECT h.case_id, 'search::' || h.case_id AS query_key, sha256(concat_ws(chr(2), h.case_id, string_agg(k.asset_id || chr(1) || k.revision_id, chr(2) ORDER BY h.rank))) AS snapshot_id, count(*) AS n
  FROM hit h JOIN chunk k USING (chunk_id) GROUP BY h.case_id)
SELECT case_id, o AS page_offset, replace(replace(rtrim(to_base64(encode('{"offset":' || o || ',"query_key":"' || query_key || '","snapshot_id":"' || snapshot_id || '"}')), '='), '+', '-'), '/', '_') AS cursor
FROM (SELECT *, unnest(range(20, n, 20))::INTEGER AS o FROM listed)""")
def page_cursors(spark: SparkSession, d: str) -> DataFrame:
    """The cursors of the pages of 20 of each case's hits, bound to the whole list of hits."""
    where = chunks_of(spark, d).select("chunk_id", "asset_id", "revision_id")
    listed = evidence.snapshot_ids(lexical_hits(spark, d).join(where, "chunk_id"), "case_id", "rank", "asset_id", "revision_id").where(F.col("n_hits") > 20)
    pages = listed.select("case_id", "snapshot_id", F.explode(F.sequence(F.lit(20), (F.col("n_hits") - 1).cast("int"), F.lit(20))).alias("page_offset"))
    key = F.concat(F.lit("search::"), F.col("case_id"))
    return pages.select("case_id", "page_offset", ids.cursor(F.col("snapshot_id"), key, F.col("page_offset")).alias("cursor"))


@query("WITH " + S.BM25 + """, listed AS (SELECT case_id, count(*) AS n FROM hit GROUP BY case_id)
SELECT case_id, o AS asked, kind, CASE WHEN kind = 'whole' THEN 'OK' ELSE 'CURSOR_INVALID' END AS status, CASE WHEN kind = 'whole' THEN o END AS page_offset
FROM (SELECT case_id, unnest(range(20, n, 20))::INTEGER AS o FROM listed), (SELECT unnest(['whole', 'cut', 'other query', 'outside']) AS kind)""")
def cursor_checks(spark: SparkSession, d: str) -> DataFrame:
    """The cursors of all pages read again, whole, without their end, of another query, and beyond the list."""
    hits = with_ids(spark, d, numbered_hits(spark, d), "asset_id", "revision_id")
    listed = evidence.snapshot_ids(hits, "case_id", "rank", "asset_id", "revision_id").withColumn("query_key", ids.query_key("search", None, F.col("case_id")))
    listed = materialize(listed, "listed")
    pages = listed.where(F.col("n_hits") > 20).select("*", F.explode(F.sequence(F.lit(20), (F.col("n_hits") - 1).cast("int"), F.lit(20))).alias("asked"))
    own = ids.cursor(F.col("snapshot_id"), F.col("query_key"), F.col("asked"))
    kinds = {"whole": own, "cut": F.expr("substring(c, 1, length(c) - 7)"), "other query": ids.cursor(F.col("snapshot_id"), F.lit("search::"), F.col("asked")), "outside": ids.cursor(F.col("snapshot_id"), F.col("query_key"), F.col("n_hits") + 1)}
    each = pages.withColumn("c", own).select("case_id", "asked", F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), c.alias("cursor")) for k, c in kinds.items()))))
    return evidence.resume(each, listed, "case_id").drop("cursor")


@query(f"""WITH {S.CHUNKS}, variant AS (SELECT unnest(['whole', 'version', 'no revision', 'no json']) AS kind)
SELECT chunk_id, kind, kind = 'whole' AS valid, CASE WHEN kind = 'whole' THEN asset_id END AS resource_id, CASE WHEN kind = 'whole' THEN chunk_id END AS selected, CASE WHEN kind = 'whole' THEN end_line END AS last_line FROM chunk, variant""")
def locator_checks(spark: SparkSession, d: str) -> DataFrame:
    """The locators of all current chunks read again, whole and in ways that aren't locators."""
    stored = index_of(spark, d).chunks
    own = ids.locator("assets", F.col("asset_id"), F.col("revision_id"), F.col("chunk_id"), F.col("start_line"), F.col("end_line"))
    kinds = {"whole": own, "version": F.replace(own, F.lit('"version":1'), F.lit('"version":2')), "no revision": F.regexp_replace(own, '"revision":"[^"]*"', '"revision":""'), "no json": F.expr("substring(l, 2)")}
    each = stored.withColumn("l", own).select("chunk_id", F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), c.alias("locator")) for k, c in kinds.items()))))
    read = each.select("chunk_id", "kind", ids.parse_locator(F.col("locator")).alias("p"))
    return read.select("chunk_id", "kind", F.col("p").isNotNull().alias("valid"), F.col("p.resource_id").alias("resource_id"), F.col("p.selector.id").alias("selected"), F.col("p.selector.end").alias("last_line"))


@query(f"""WITH {S.ASSETS}, {S.CASES}, source AS (SELECT DISTINCT unnest(expected_sources) AS s FROM gold),
asked AS (SELECT s || ':0012' AS shorthand, {S.fold('s')} AS name, 12 AS line FROM source UNION SELECT substr(s, 2, 9), {S.fold('substr(s, 2, 9)')}, NULL FROM source),
met AS (SELECT a.shorthand, a.line, c.asset_id, c.current_revision_id AS revision_id, row_number() OVER (PARTITION BY a.shorthand ORDER BY ({S.fold('c.source_name')} = a.name) DESC, lower(c.source_name), c.asset_id) AS place
  FROM asked a JOIN current_asset c ON contains({S.fold('c.source_name')}, a.name))
SELECT a.shorthand, m.asset_id, m.revision_id, CAST(a.line AS INTEGER) AS line FROM asked a LEFT JOIN met m ON m.shorthand = a.shorthand AND m.place = 1""")
def locator_shorthands(spark: SparkSession, d: str) -> DataFrame:
    """Expected sources by name and line, and by a part of their name, as assets."""
    source = cases_of(spark, d).select(F.explode("expected_sources").alias("s")).distinct()
    asked = source.select(F.explode(F.array(F.concat("s", F.lit(":0012")), F.substring("s", 2, 9))).alias("shorthand")).distinct()
    return evidence.resolve_shorthand(asked, "shorthand", store.current_assets(table(spark, d, "assets"))).select("shorthand", "asset_id", "revision_id", "line")


@query(f"""WITH {S.CHUNKS}, moved AS (SELECT asset_id, max(revision_id) AS revision_id FROM asset_revisions WHERE asset_id IS NOT NULL GROUP BY asset_id)
SELECT chunk_id FROM chunk k WHERE NOT EXISTS (SELECT 1 FROM moved m WHERE m.asset_id = k.asset_id AND m.revision_id = k.revision_id)""")
def index_outdated(spark: SparkSession, d: str) -> DataFrame:
    """The chunks to drop from the index once every asset points to its last revision by id."""
    moved = table(spark, d, "asset_revisions").where(F.col("asset_id").isNotNull()).groupBy("asset_id").agg(F.max("revision_id").alias("revision_id"))
    return index.outdated(index_of(spark, d), moved).select("chunk_id")


@query(f"""WITH {S.CHUNKS}, counted AS (SELECT asset_id, len({S.terms("concat_ws(' ', coalesce(source_name, ''), array_to_string(coalesce(heading_path, []), ' '), coalesce(text, ''))")}) AS n,
  len({S.words("concat_ws(chr(10), array_to_string(heading_path, chr(10)), coalesce(text, ''))")}) AS w FROM chunk)
SELECT asset_id, count(*) AS n_chunks, CAST(count(*) FILTER (n > 0) AS BIGINT) AS n_posted, CAST(count(*) FILTER (w > 0) AS BIGINT) AS n_vectors FROM counted GROUP BY asset_id""")
def index_coverage(spark: SparkSession, d: str) -> DataFrame:
    """For each asset its chunks, those with postings and those with a vector; chunks, postings and
    vectors meet by number where they lie."""
    stored = index_of(spark, d)
    posted = stored.postings.select("chunk_no").distinct().withColumn("p", F.lit(True))
    vectored = stored.vectors.where(F.size("idx") > 0).select("chunk_no", F.lit(True).alias("v"))
    met = stored.chunks.select("chunk_no", "asset_id").join(posted, "chunk_no", "left").join(vectored, "chunk_no", "left")
    return met.groupBy("asset_id").agg(F.count("*").alias("n_chunks"), F.count("p").alias("n_posted"), F.count("v").alias("n_vectors"))


_ANSWER = "WITH " + S.BM25 + """,
shown_part AS (SELECT h.case_id, h.rank, left(coalesce(k.text, ''), 300) AS shown,
    'ev-' || left(sha256('{"provider":"assets","resource_id":"' || k.asset_id || '","revision":"' || k.revision_id || '","selector":{"end":' || k.end_line || ',"id":"' || k.chunk_id || '","start":' || k.start_line || ',"type":"chunk"},"version":1}' || chr(10) || sha256(coalesce(k.text, ''))), 16) AS evidence_id
  FROM hit h JOIN chunk k USING (chunk_id) WHERE h.rank <= 3)"""


def cited_texts(spark: SparkSession, d: str) -> DataFrame:
    """(case_id, rank, shown, evidence_id): the beginnings of the first three hits with their evidence ids."""
    met = with_ids(spark, d, numbered_hits(spark, d, 3), "asset_id", "revision_id", "chunk_id", "start_line", "end_line", "text")
    locator = ids.locator("assets", *(F.col(c) for c in ("asset_id", "revision_id", "chunk_id", "start_line", "end_line")))
    text = F.coalesce("text", F.lit(""))
    return met.select("case_id", "rank", F.left(text, F.lit(300)).alias("shown"), ids.evidence_id(locator, ids.content_hash(text)).alias("evidence_id"))


@query(_ANSWER + " SELECT case_id, rank, evidence_id FROM shown_part")
def evidence_ids(spark: SparkSession, d: str) -> DataFrame:
    return cited_texts(spark, d).drop("shown")


@query(_ANSWER + f""", answer AS (SELECT case_id, string_agg(shown || ' [' || evidence_id || ']', chr(10) ORDER BY rank) AS answer FROM shown_part GROUP BY case_id),
cut AS (SELECT case_id, answer, list_filter(string_split(regexp_replace(replace(regexp_replace(answer, '([.!?。！？])[ \\t\\n\\f\\r\\x0B]+', '\\1' || chr(30), 'g'), chr(30) || '[ev-', ' [ev-'), '\\n+', chr(30), 'g'), chr(30)), lambda s: s <> '') AS sentences FROM answer),
wanted AS (SELECT case_id, unnest(range(len(required_phrases)))::INTEGER AS no, unnest(required_phrases) AS phrase FROM gold)
SELECT w.case_id, no, coalesce(contains({S.fold('answer')}, {S.fold('phrase')}), false) AS in_answer,
  coalesce(regexp_matches(list_filter(sentences, lambda s: contains({S.fold('s')}, {S.fold('phrase')}))[1], '\\[ev-[^\\]]+\\]'), false) AS cited FROM wanted w LEFT JOIN cut USING (case_id)""")
def answer_citations(spark: SparkSession, d: str) -> DataFrame:
    """Answers put together from the first three hits: which required phrases they hold, and whether
    the sentence that does cites its evidence."""
    from tarnstone.operators.answers import cited_phrases

    part = F.concat("shown", F.lit(" ["), "evidence_id", F.lit("]"))
    answer = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", part.alias("part")))), lambda x: x["part"]), "\n")
    answers = cited_texts(spark, d).groupBy("case_id").agg(answer.alias("answer"))  # three parts a case
    return cited_phrases(answers, cases_of(spark, d).select("case_id", F.posexplode("required_phrases").alias("no", "phrase")), "case_id")


@query(f"""WITH {S.CHUNKS} SELECT chunk_id, CAST(place AS INTEGER) AS place FROM (SELECT chunk_id, row_number() OVER (ORDER BY lower(source_name), asset_id, start_line, end_line, chunk_id) AS place FROM chunk) WHERE place BETWEEN 101 AND 300""")
def list_chunks_page(spark: SparkSession, d: str) -> DataFrame:
    """The second hundred of two of all current chunks, in reading order."""
    from pyspark.sql import Window

    keys = ["name", "asset_id", "start_line", "end_line", "chunk_id"]
    rows = index_of(spark, d).chunks.select(F.lower("source_name").alias("name"), *keys[1:])
    first = rows.orderBy(*keys).limit(300)
    return first.withColumn("place", F.row_number().over(Window.orderBy(*keys))).where(F.col("place") > 100).select("chunk_id", "place")
