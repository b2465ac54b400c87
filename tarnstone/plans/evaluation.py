"""Queries that score the search against the gold cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnstone.functions import text as T
from tarnstone.operators import evaluation, evidence, index, lexical
from tarnstone.plans import fragments as S
from tarnstone.plans.registry import query
from tarnstone.plans.retrieval import TOP, cases_of, index_of, numbered_hits, with_ids
from tarnstone.runtime import broadcast_if_small, materialize

_SOURCES = "WITH " + S.BM25 + """,
appearance AS (SELECT h.case_id, lower(k.source_name) AS source_name, min(h.rank) AS chunk_rank FROM hit h JOIN chunk k USING (chunk_id) GROUP BY ALL),
source AS (SELECT *, CAST(row_number() OVER (PARTITION BY case_id ORDER BY chunk_rank, source_name) AS INTEGER) AS source_rank FROM appearance)"""
_RANKS = _SOURCES + """,
expected AS (SELECT DISTINCT case_id, lower(unnest(expected_sources)) AS source_name FROM gold),
ranked AS (SELECT e.case_id, CASE WHEN count(*) = count(s.source_rank) THEN max(s.source_rank) END AS expected_rank,
                  CASE WHEN count(*) = count(s.source_rank) THEN max(s.chunk_rank) END AS expected_chunk_rank
           FROM expected e LEFT JOIN source s USING (case_id, source_name) GROUP BY e.case_id)"""
_VERDICTS = "WITH " + S.EVIDENCE + """,
appearance AS (SELECT h.case_id, lower(k.source_name) AS source_name, min(h.rank) AS chunk_rank FROM hit h JOIN chunk k USING (chunk_id) GROUP BY ALL),
source AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY chunk_rank, source_name) AS source_rank FROM appearance),
listed AS (SELECT case_id, unnest(range(len(expected_sources))) AS no, unnest(expected_sources) AS expected FROM gold),
looked_up AS (SELECT l.case_id, max(s.source_rank) AS last_rank, count(s.source_rank) AS n_found, coalesce(list('source not found: ' || expected ORDER BY no) FILTER (s.source_rank IS NULL), []) AS missing
  FROM listed l LEFT JOIN source s ON s.case_id = l.case_id AND s.source_name = lower(l.expected) GROUP BY l.case_id),
n_hit AS (SELECT case_id, count(*) AS n_hits FROM hit GROUP BY case_id),
verdict AS (
  SELECT g.case_id, g.query_style, g.answerable, CAST(len(g.expected_sources) AS INTEGER) AS n_expected, coalesce(n.n_hits, 0) AS n_hits,
         CAST(CASE WHEN len(g.expected_sources) > 0 AND l.n_found = len(g.expected_sources) THEN l.last_rank END AS INTEGER) AS expected_rank,
         list_concat(list_concat(coalesce(l.missing, []), list_filter([
             CASE WHEN g.answerable AND coalesce(l.n_found, 0) = 0 THEN 'answerable without a source' END,
             CASE WHEN NOT g.answerable AND coalesce(n.n_hits, 0) > 0 THEN 'unanswerable with hits' END,
             CASE WHEN l.last_rank > g.retrieval_max_expected_rank THEN 'source ranked too low' END], lambda x: x IS NOT NULL)),
           list_concat(list_transform(e.missing_phrases, lambda x: 'phrase not in the sources: ' || x), list_transform(e.missing_claims, lambda x: 'claim not in the sources: ' || x))) AS failures
  FROM gold g JOIN evidence e USING (case_id) LEFT JOIN looked_up l USING (case_id) LEFT JOIN n_hit n USING (case_id))"""


def hits_of(spark: SparkSession, d: str) -> DataFrame:
    """(case_id, rank, source_name, text): the hits of all cases with what is read of them."""
    return materialize(with_ids(spark, d, numbered_hits(spark, d), "source_name", "text").select("case_id", "rank", "source_name", "text"), "hits-read")


def sources_of(hits: DataFrame) -> DataFrame:
    return evidence.first_appearance(hits, "case_id", "source_name", "rank")


def named_hits(spark: SparkSession, d: str) -> DataFrame:
    return with_ids(spark, d, numbered_hits(spark, d), "source_name")


def verdicts_of(spark: SparkSession, d: str) -> DataFrame:
    cases, hits = cases_of(spark, d), hits_of(spark, d)
    return evaluation.verdicts(cases, sources_of(hits), hits, evaluation.evidence_of_targets(cases, hits))


@query(_SOURCES + " SELECT case_id, source_name, chunk_rank, source_rank FROM source")
def source_ranks(spark: SparkSession, d: str) -> DataFrame:
    return sources_of(named_hits(spark, d))


@query(_RANKS + " SELECT * FROM ranked")
def expected_ranks(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.expected_ranks(cases_of(spark, d), sources_of(named_hits(spark, d)))


@query(_VERDICTS + " SELECT *, len(failures) = 0 AS passed FROM verdict")
def case_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return verdicts_of(spark, d)


@query(_VERDICTS + """ SELECT count(*) AS n_cases, round(avg(CAST(len(failures) = 0 AS DOUBLE)), 6) AS pass_rate,
round(avg(coalesce(CAST(expected_rank <= 1 AS DOUBLE), 0)) FILTER (n_expected > 0), 6) AS hit_at_1, round(avg(coalesce(CAST(expected_rank <= 3 AS DOUBLE), 0)) FILTER (n_expected > 0), 6) AS hit_at_3,
round(avg(coalesce(1.0 / expected_rank, 0)) FILTER (n_expected > 0), 6) AS mrr FROM verdict""")
def retrieval_report(spark: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("n_expected") > 0, F.coalesce("expected_rank", F.lit(1 << 30)))
    share = lambda k: F.round(F.avg((rank <= k).cast("double")), 6)
    return verdicts_of(spark, d).agg(
        F.count("*").alias("n_cases"),
        F.round(F.avg(F.col("passed").cast("double")), 6).alias("pass_rate"),
        share(1).alias("hit_at_1"),
        share(3).alias("hit_at_3"),
        F.round(F.avg(F.when(F.col("n_expected") > 0, F.coalesce(1.0 / F.col("expected_rank"), F.lit(0.0)))), 6).alias("mrr"),
    )


@query(_VERDICTS + """ SELECT query_style, count(*) AS n_cases, round(avg(CAST(len(failures) = 0 AS DOUBLE)), 6) AS pass_rate,
round(avg(coalesce(CAST(expected_rank <= 1 AS DOUBLE), 0)) FILTER (n_expected > 0), 6) AS hit_at_1, round(avg(coalesce(CAST(expected_rank <= 3 AS DOUBLE), 0)) FILTER (n_expected > 0), 6) AS hit_at_3
FROM verdict WHERE query_style <> '' GROUP BY query_style""")
def style_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """All cases with a style; the shares of hits are of those that expect sources."""
    ranked = F.when(F.col("n_expected") > 0, F.coalesce("expected_rank", F.lit(1 << 30)))
    rows = verdicts_of(spark, d).where(F.col("query_style") != "")
    share = lambda k: F.round(F.avg((ranked <= k).cast("double")), 6)
    return rows.groupBy("query_style").agg(F.count("*").alias("n_cases"), F.round(F.avg(F.col("passed").cast("double")), 6).alias("pass_rate"), share(1).alias("hit_at_1"), share(3).alias("hit_at_3"))


@query(_RANKS + """ SELECT k, round(avg(coalesce(CAST(expected_rank <= k AS DOUBLE), 0)), 6) AS hit_rate FROM ranked, (SELECT unnest([1, 3, 5, 10, 20, 200]) AS k) GROUP BY k""")
def hit_at_k(spark: SparkSession, d: str) -> DataFrame:
    ranks = evaluation.expected_ranks(cases_of(spark, d), sources_of(named_hits(spark, d)))
    steps = ranks.select("expected_rank", F.explode(F.array(*map(F.lit, (1, 3, 5, 10, 20, 200)))).alias("k"))
    return steps.groupBy("k").agg(evaluation.hit_rate(F.col("expected_rank"), F.col("k")).alias("hit_rate"))


_EVIDENCE = "WITH " + S.EVIDENCE


def evidence_of(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.evidence_of_targets(cases_of(spark, d), hits_of(spark, d))


@query(_EVIDENCE + " SELECT case_id, evidence_rank, missing_phrases, missing_claims FROM evidence WHERE required")
def evidence_ranks(spark: SparkSession, d: str) -> DataFrame:
    return evidence_of(spark, d).where("required").select("case_id", "evidence_rank", "missing_phrases", "missing_claims")


@query(_EVIDENCE + """ SELECT count(*) AS n_cases, round(avg(CAST(evidence_rank IS NOT NULL AS DOUBLE)), 6) AS location_rate,
round(avg(coalesce(CAST(evidence_rank <= 1 AS DOUBLE), 0)), 6) AS hit_at_1, round(avg(coalesce(CAST(evidence_rank <= 3 AS DOUBLE), 0)), 6) AS hit_at_3, round(avg(coalesce(1.0 / evidence_rank, 0)), 6) AS mrr,
sum(evidence_bytes)::BIGINT AS evidence_bytes FROM evidence WHERE required""")
def evidence_report(spark: SparkSession, d: str) -> DataFrame:
    rank = F.col("evidence_rank")
    rates = [evaluation.hit_rate(rank, 1).alias("hit_at_1"), evaluation.hit_rate(rank, 3).alias("hit_at_3"), evaluation.mean_reciprocal_rank(rank).alias("mrr")]
    return evidence_of(spark, d).where("required").agg(F.count("*").alias("n_cases"), F.round(F.avg(rank.isNotNull().cast("double")), 6).alias("location_rate"), *rates, F.sum("evidence_bytes").cast("bigint").alias("evidence_bytes"))


@query(_EVIDENCE + """, shown AS (SELECT r.case_id, expected_chunk_rank, evidence_rank FROM (
  SELECT e.case_id, CASE WHEN count(*) = count(first) THEN max(first) END AS expected_chunk_rank FROM expected e LEFT JOIN (SELECT case_id, source_name, min(rank) AS first FROM target GROUP BY ALL) t USING (case_id, source_name) GROUP BY e.case_id) r
  JOIN evidence v USING (case_id) WHERE v.required)
SELECT count(*) AS n_cases, round(avg(CAST(evidence_rank IS NOT NULL AS DOUBLE)) FILTER (expected_chunk_rank IS NOT NULL), 6) AS located_if_retrieved,
  round(avg(evidence_rank - expected_chunk_rank), 6) AS mean_further_reads FROM shown""")
def conditional_location(spark: SparkSession, d: str) -> DataFrame:
    """How often the evidence is found where the sources were, and how many hits later."""
    cases, hits = cases_of(spark, d), hits_of(spark, d)
    ranks = evaluation.expected_ranks(cases, sources_of(hits))
    met = evaluation.evidence_of_targets(cases, hits).where("required").join(ranks, "case_id")
    located = F.when(F.col("expected_chunk_rank").isNotNull(), F.col("evidence_rank").isNotNull().cast("double"))
    return met.agg(F.count("*").alias("n_cases"), F.round(F.avg(located), 6).alias("located_if_retrieved"), F.round(F.avg(F.col("evidence_rank") - F.col("expected_chunk_rank")), 6).alias("mean_further_reads"))


@query(f"""WITH {S.CASES}, padded AS (SELECT case_id, query_anchor_groups AS g, ' ' || array_to_string({S.words('query')}, ' ') || ' ' AS p FROM gold)
SELECT case_id, round(CASE WHEN len(g) > 0 THEN len(list_filter(g, lambda x: len(list_filter(x, lambda a: len({S.words('a')}) > 0 AND contains(p, ' ' || array_to_string({S.words('a')}, ' ') || ' '))) > 0)) / len(g) ELSE 0.0 END, 6) AS coverage FROM padded""")
def anchor_coverage(spark: SparkSession, d: str) -> DataFrame:
    return cases_of(spark, d).select("case_id", evaluation.anchor_coverage(F.col("query_anchor_groups"), F.col("query")).alias("coverage"))


@query("WITH " + S.BM25 + f""", best AS (SELECT case_id, chunk_id FROM hit WHERE rank = 1),
checked AS (SELECT b.case_id, g.question, list_distinct(list_filter(regexp_extract_all(lower(g.question), '[a-z0-9]{{3,}}'), lambda t: NOT list_contains(['about', 'after', 'also', 'and', 'are', 'does', 'from', 'how', 'into', 'that', 'the', 'their', 'these', 'this', 'what', 'when', 'which', 'with', 'would', 'data', 'document', 'standard', 'actuarial', 'services'], t))) AS q,
  list_distinct(regexp_extract_all(lower(coalesce(k.text, '')), '[a-z0-9]{{3,}}')) AS t FROM best b JOIN gold g USING (case_id) JOIN chunk k USING (chunk_id))
SELECT case_id, len(q) >= 2 AND len(list_intersect(q, t)) >= CASE WHEN len(q) <= 3 THEN 2 ELSE 3 END AS supported FROM checked""")
def evidence_support(spark: SparkSession, d: str) -> DataFrame:
    """Whether the best chunk of a case plainly bears on its question."""
    from tarnstone.operators.heuristics import supports

    best = with_ids(spark, d, numbered_hits(spark, d, 1), "text")
    met = best.join(broadcast_if_small(cases_of(spark, d).select("case_id", "question")), "case_id")
    return met.select("case_id", supports(F.col("question"), F.coalesce("text", F.lit(""))).alias("supported"))


@query()
def best_passages(spark: SparkSession, d: str) -> DataFrame:
    """The passage of the best chunk of each case."""
    from tarnstone.operators.passages import best_passages as passages

    best = with_ids(spark, d, numbered_hits(spark, d, 1), "text")
    met = best.join(broadcast_if_small(cases_of(spark, d).select("case_id", "query")), "case_id").where(F.col("text").isNotNull())
    return passages(materialize(met.select("case_id", "text", "query"), "best"), "case_id", "text", "query")


@query("WITH " + S.BM25 + f""",
wanted AS (SELECT case_id, unnest(range(len(required_phrases))) AS no, unnest(required_phrases) AS phrase FROM gold),
read AS (SELECT h.case_id, {S.clean("coalesce(k.text, '')")} AS text FROM hit h JOIN chunk k USING (chunk_id)),
each AS (SELECT w.case_id, w.no, coalesce(bool_or(trim(w.phrase) = '' OR regexp_matches(r.text, {S.loose(S.fold('w.phrase'))})), false) AS holds FROM wanted w LEFT JOIN read r USING (case_id) GROUP BY ALL)
SELECT case_id, bool_and(holds) AS all_phrases, count(*) AS n_phrases FROM each GROUP BY case_id""")
def phrase_matches(spark: SparkSession, d: str) -> DataFrame:
    """The cases whose required phrases all stand in their hits, whatever the white space."""
    hits = hits_of(spark, d).select("case_id", evaluation.clean_evidence(F.col("text")).alias("text"))
    wanted = cases_of(spark, d).select("case_id", F.posexplode("required_phrases").alias("no", "phrase"))
    met = hits.join(broadcast_if_small(wanted), "case_id").where(evaluation.holds_phrase(F.col("text"), F.col("phrase"))).select("case_id", "no").distinct()
    held = F.col("met").isNotNull() | (T.collapse(F.col("phrase")) == "")
    each = wanted.join(broadcast_if_small(met.withColumn("met", F.lit(True))), ["case_id", "no"], "left")
    return each.groupBy("case_id").agg(F.min(held).alias("all_phrases"), F.count("*").alias("n_phrases"))


@query(_EVIDENCE + """ SELECT case_id, count(*) FILTER (kind = 'claim') AS n_claims, any_value(len(missing_claims)) = 0 AS satisfied FROM needed JOIN evidence USING (case_id) WHERE kind = 'claim' GROUP BY case_id""")
def claim_checks(spark: SparkSession, d: str) -> DataFrame:
    """Cases with claims, by whether the hits of the expected sources hold some phrase of each claim."""
    cases = cases_of(spark, d)
    claims = evaluation.requirements(cases).where("kind = 'claim'").groupBy("case_id").agg(F.count("*").alias("n_claims"))
    return evidence_of(spark, d).join(claims, "case_id").select("case_id", "n_claims", (F.size("missing_claims") == 0).alias("satisfied"))


@query(_EVIDENCE + " SELECT case_id, n_read, evidence_bytes FROM evidence")
def evidence_bytes(spark: SparkSession, d: str) -> DataFrame:
    """The hits that are read of each case, and their bytes."""
    return evidence_of(spark, d).select("case_id", "n_read", "evidence_bytes")


_SEARCHES = S.CASES.replace("gold AS (", "whole_case AS (") + """,
search AS (SELECT case_id, 1 AS search_no, question AS query FROM whole_case UNION ALL SELECT case_id, 2, query FROM whole_case WHERE query <> question),
gold AS (SELECT case_id || '#' || search_no AS case_id, query FROM search WHERE trim(query) <> '')"""
_SEARCH_SQL = "WITH " + S.BM25.replace(S.CASES, _SEARCHES) + f""",
appeared AS (SELECT h.case_id, lower(k.source_name) AS source_name, min(h.rank) AS chunk_rank FROM hit h JOIN chunk k USING (chunk_id) GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY chunk_rank, source_name) AS source_rank FROM appeared),
found_at AS (SELECT s.case_id, s.search_no, min(p.source_rank) AS rank FROM (SELECT s.*, unnest(expected_sources) AS e FROM search s JOIN whole_case USING (case_id)) s
  JOIN placed p ON p.case_id = s.case_id || '#' || s.search_no AND p.source_name = lower(s.e) GROUP BY ALL),
covered AS (SELECT s.case_id, s.search_no, query_anchor_groups AS g, ' ' || array_to_string({S.words('s.query')}, ' ') || ' ' AS p FROM search s JOIN whole_case USING (case_id)),
share AS (SELECT case_id, search_no, CASE WHEN len(g) > 0 THEN round(len(list_filter(g, lambda x: len(list_filter(x, lambda a: len({S.words('a')}) > 0 AND contains(p, ' ' || array_to_string({S.words('a')}, ' ') || ' '))) > 0)) / len(g), 6) END AS coverage FROM covered),
report AS (SELECT s.case_id, count(*) AS n_searches, CAST(arg_min(f.rank, s.search_no) FILTER (f.rank IS NOT NULL) AS INTEGER) AS first_rank, CAST(min(f.rank) AS INTEGER) AS best_rank,
    arg_min(coverage, s.search_no) AS first_coverage, max(coverage) AS best_coverage FROM search s LEFT JOIN found_at f USING (case_id, search_no) JOIN share USING (case_id, search_no) GROUP BY s.case_id)"""


def searches_report(spark: SparkSession, d: str) -> DataFrame:
    """Each case as two searches, by its question and by its retrieval query where that is another."""
    cases = cases_of(spark, d)
    first = cases.select("case_id", F.lit(1).alias("search_no"), F.col("question").alias("query"), "expected_sources", "query_anchor_groups")
    second = cases.where(F.col("query") != F.col("question")).select("case_id", F.lit(2).alias("search_no"), "query", "expected_sources", "query_anchor_groups")
    searches = materialize(first.unionByName(second), "searches")
    keyed = searches.withColumn("search", F.concat_ws("#", "case_id", "search_no"))
    stored = index_of(spark, d)
    scores = index.lexical_scores(stored, lexical.query_terms(keyed, "search", "query"), "search")
    hits = with_ids(spark, d, materialize(lexical.top(scores, "search", "chunk_no", TOP), "search-hits"), "source_name")
    placed = evidence.first_appearance(hits, "search", "source_name", "rank").join(broadcast_if_small(keyed.select("search", "case_id", "search_no")), "search")
    return evaluation.search_report(searches, evaluation.search_ranks(searches, placed.drop("search")))


@query(_SEARCH_SQL + " SELECT * FROM report")
def search_reports(spark: SparkSession, d: str) -> DataFrame:
    return searches_report(spark, d)


@query(_SEARCH_SQL + """ SELECT count(*) AS n_cases, round(avg(n_searches), 3) AS mean_searches,
round(avg(coalesce(CAST(first_rank <= 1 AS DOUBLE), 0)) FILTER (len(expected_sources) > 0), 6) AS first_hit_at_1, round(avg(coalesce(CAST(first_rank <= 3 AS DOUBLE), 0)) FILTER (len(expected_sources) > 0), 6) AS first_hit_at_3,
round(avg(coalesce(CAST(best_rank <= 1 AS DOUBLE), 0)) FILTER (len(expected_sources) > 0), 6) AS best_hit_at_1, round(avg(first_coverage), 6) AS mean_first_coverage, round(avg(best_coverage), 6) AS mean_best_coverage
FROM report JOIN whole_case USING (case_id)""")
def search_summary(spark: SparkSession, d: str) -> DataFrame:
    met = searches_report(spark, d).join(cases_of(spark, d).select("case_id", F.size("expected_sources").alias("n_expected")), "case_id")
    share = lambda rank, k: F.round(F.avg(F.when(F.col("n_expected") > 0, F.coalesce((F.col(rank) <= k).cast("double"), F.lit(0.0)))), 6)
    return met.agg(
        F.count("*").alias("n_cases"),
        F.round(F.avg("n_searches"), 3).alias("mean_searches"),
        share("first_rank", 1).alias("first_hit_at_1"),
        share("first_rank", 3).alias("first_hit_at_3"),
        share("best_rank", 1).alias("best_hit_at_1"),
        F.round(F.avg("first_coverage"), 6).alias("mean_first_coverage"),
        F.round(F.avg("best_coverage"), 6).alias("mean_best_coverage"),
    )


@query(_SEARCH_SQL + """ SELECT query_style, count(*) AS n_cases,
round(avg(coalesce(CAST(first_rank <= 1 AS DOUBLE), 0)) FILTER (len(expected_sources) > 0), 6) AS first_hit_at_1, round(avg(coalesce(CAST(first_rank <= 3 AS DOUBLE), 0)) FILTER (len(expected_sources) > 0), 6) AS first_hit_at_3,
round(avg(first_coverage), 6) AS mean_first_coverage, round(avg(best_coverage), 6) AS mean_best_coverage
FROM report JOIN whole_case USING (case_id) WHERE query_style <> '' GROUP BY query_style""")
def search_by_style(spark: SparkSession, d: str) -> DataFrame:
    met = searches_report(spark, d).join(cases_of(spark, d).where(F.col("query_style") != "").select("case_id", "query_style", F.size("expected_sources").alias("n_expected")), "case_id")
    share = lambda k: F.round(F.avg(F.when(F.col("n_expected") > 0, F.coalesce((F.col("first_rank") <= k).cast("double"), F.lit(0.0)))), 6)
    return met.groupBy("query_style").agg(F.count("*").alias("n_cases"), share(1).alias("first_hit_at_1"), share(3).alias("first_hit_at_3"), F.round(F.avg("first_coverage"), 6).alias("mean_first_coverage"), F.round(F.avg("best_coverage"), 6).alias("mean_best_coverage"))
