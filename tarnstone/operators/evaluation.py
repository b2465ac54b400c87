"""Evaluation of ranked results against gold cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnstone.functions import text as T
from tarnstone.runtime import broadcast_if_small, materialize

#: Most bytes that are read of a hit.
READ_BYTES = 20_000


def gold_cases(cases: DataFrame) -> DataFrame:
    """Cases with their defaults: answerable and must_cite true, lists empty, the query the question's."""
    empty = F.array().cast("array<string>")
    return cases.select(
        "case_id",
        "question",
        F.coalesce("expected_sources", empty).alias("expected_sources"),
        F.coalesce("required_phrases", empty).alias("required_phrases"),
        F.coalesce("required_evidence_phrases", empty).alias("required_evidence_phrases"),
        F.coalesce("answerable", F.lit(True)).alias("answerable"),
        F.coalesce("must_cite", F.lit(True)).alias("must_cite"),
        F.coalesce("retrieval_query", "question").alias("query"),
        "query_style",
        "query_anchor_groups",
        "retrieval_max_expected_rank",
        "required_claims",
    )


def expected_ranks(cases: DataFrame, sources: DataFrame) -> DataFrame:
    """(case_id, expected_rank, expected_chunk_rank): the largest of the ranks of the expected
    sources, null unless all of them were found. sources: case_id, source_name, source_rank,
    chunk_rank, names in lower case."""
    expected = cases.select("case_id", F.explode(F.array_distinct(F.transform("expected_sources", lambda s: F.lower(s)))).alias("source_name"))
    met = expected.join(sources, ["case_id", "source_name"], "left")
    all_found = F.count("*") == F.count("source_rank")
    return met.groupBy("case_id").agg(F.when(all_found, F.max("source_rank")).alias("expected_rank"), F.when(all_found, F.max("chunk_rank")).alias("expected_chunk_rank"))


def requirements(cases: DataFrame) -> DataFrame:
    """(case_id, kind, no, label, phrases): what the evidence of a case must hold, some phrase of
    each row. kind is phrase (a required evidence phrase) or claim (a claim's evidence phrases, known
    by its answer phrases). A blank phrase is in every text, so a row with one is left out."""
    string = "array<string>"
    phrase = cases.select("case_id", F.lit("phrase").alias("kind"), F.posexplode("required_evidence_phrases").alias("no", "label")).withColumn("phrases", F.array("label"))
    claim = cases.select("case_id", F.lit("claim").alias("kind"), F.posexplode("required_claims").alias("no", "c"))
    claim = claim.select("case_id", "kind", "no", F.array_join(F.coalesce("c.answer_phrases", F.array().cast(string)), " | ").alias("label"), F.coalesce("c.evidence_phrases", F.array().cast(string)).alias("phrases"))
    return phrase.unionByName(claim).where(~F.exists("phrases", lambda p: T.collapse(p) == ""))


def target_hits(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """hits (case_id, rank, source_name, ...) of the sources that their case expects, whatever the letters' case."""
    expected = cases.select("case_id", F.explode(F.array_distinct(F.transform("expected_sources", lambda s: F.lower(s)))).alias("expected"))
    met = hits.withColumn("expected", F.lower("source_name"))
    return met.join(broadcast_if_small(expected), ["case_id", "expected"]).drop("expected")


def holds_phrase(text: Column, phrase: Column) -> Column:
    """Whether phrase stands in text, with white space between any of its characters, but not inside
    a longer word; text is clean_evidence. What doesn't hold it even without blanks isn't searched."""
    close = F.contains(F.replace(text, F.lit(" "), F.lit("")), F.regexp_replace(T.casefold(phrase), r"(?U)\s+", ""))
    return F.when(close, F.regexp_like(text, T.loose_phrase(T.casefold(phrase)))).otherwise(F.lit(False))


def clean_evidence(text: Column) -> Column:
    return T.collapse(T.join_divided(T.casefold(F.coalesce(text, F.lit("")))))


def evidence_of_targets(cases: DataFrame, hits: DataFrame, max_bytes: int = READ_BYTES) -> DataFrame:
    """One row a case: evidence_rank, missing_phrases, missing_claims, n_read, evidence_bytes.

    hits: case_id, rank, source_name, text. The hits of expected sources are read in order, at most
    max_bytes of each, until all expected sources and requirements are met: evidence_rank is the
    rank where that is so, null if it never is or nothing is required. missing are the labels of
    what no hit holds. A phrase that only two hits together hold is not found."""
    targets = materialize(target_hits(cases, hits).select("case_id", "rank", F.lower("source_name").alias("source_name"), T.first_bytes(F.coalesce("text", F.lit("")), max_bytes).alias("text")), "targets")
    needed = materialize(requirements(cases), "requirements")
    alternatives = needed.select("case_id", "kind", "no", F.explode("phrases").alias("phrase"))
    met = targets.select("case_id", "rank", clean_evidence(F.col("text")).alias("text")).join(broadcast_if_small(alternatives), "case_id").where(holds_phrase(F.col("text"), F.col("phrase")))
    first = materialize(met.groupBy("case_id", "kind", "no").agg(F.min("rank").alias("first")), "first-evidence")
    each = needed.join(broadcast_if_small(first), ["case_id", "kind", "no"], "left")

    def missing(kind: str) -> Column:
        gone = F.collect_list(F.when(F.col("first").isNull() & (F.col("kind") == kind), F.struct("no", "label")))
        return F.transform(F.array_sort(gone), lambda x: x["label"])

    of_case = each.groupBy("case_id").agg((F.count("first") == F.count("*")).alias("complete"), F.max("first").alias("last"), missing("phrase").alias("missing_phrases"), missing("claim").alias("missing_claims"))
    found = targets.groupBy("case_id", "source_name").agg(F.min("rank").alias("first")).groupBy("case_id").agg(F.count("*").alias("n_found"), F.max("first").alias("last_source"))
    none = F.array().cast("array<string>")
    size = F.size(F.array_distinct(F.transform("expected_sources", lambda s: F.lower(s))))
    state = cases.select("case_id", size.alias("n_sources")).join(broadcast_if_small(of_case), "case_id", "left").join(broadcast_if_small(found), "case_id", "left")
    done = (F.coalesce("n_found", F.lit(0)) == F.col("n_sources")) & F.coalesce("complete", F.lit(True)) & (F.col("n_found") > 0)
    stop = F.when(done, F.greatest("last", "last_source"))
    state = materialize(state.select("case_id", stop.alias("stop"), F.col("complete").isNotNull().alias("required"), F.coalesce("missing_phrases", none).alias("missing_phrases"), F.coalesce("missing_claims", none).alias("missing_claims")), "case-evidence")
    read = targets.join(broadcast_if_small(state.select("case_id", "stop")), "case_id").where(F.col("stop").isNull() | (F.col("rank") <= F.col("stop")))
    read = read.groupBy("case_id").agg(F.count("*").alias("n_read"), F.sum(F.octet_length("text")).cast("bigint").alias("evidence_bytes"))
    zero = {c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_read", "evidence_bytes")}
    return state.join(broadcast_if_small(read), "case_id", "left").select("case_id", F.when(F.col("required"), F.col("stop")).alias("evidence_rank"), "required", "missing_phrases", "missing_claims", *zero.values())


def verdicts(cases: DataFrame, sources: DataFrame, hits: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row a case: n_expected, expected_rank (of the last expected source, null unless all are
    found), n_hits, failures, passed.

    A case fails for each expected source that isn't among the hits; if it is answerable and none
    is; if it is unanswerable and there are hits; if the last of the sources found ranks beyond the
    case's limit; and for each requirement that the evidence doesn't hold. sources: see
    expected_ranks; evidence: see evidence_of_targets."""
    counted = hits.groupBy("case_id").agg(F.count("*").alias("n_hits"))
    expected = cases.select("case_id", F.posexplode("expected_sources").alias("no", "expected")).withColumn("source_name", F.lower("expected"))
    met = expected.join(broadcast_if_small(sources), ["case_id", "source_name"], "left")
    gone = F.collect_list(F.when(F.col("source_rank").isNull(), F.struct("no", "expected")))
    ranks = met.groupBy("case_id").agg(F.max("source_rank").alias("last_rank"), F.count("source_rank").alias("n_found"), F.transform(F.array_sort(gone), lambda x: x["expected"]).alias("missing"))
    met = cases.join(ranks, "case_id", "left").join(counted, "case_id", "left").join(evidence, "case_id", "left").fillna(0, ["n_hits", "n_found"])
    none = F.array().cast("array<string>")

    def each(labels: str, message: str) -> Column:
        return F.transform(F.coalesce(labels, none), lambda x: F.concat(F.lit(message), x))

    failures = F.concat(
        each("missing", "source not found: "),
        F.array_compact(
            F.array(
                F.when(F.col("answerable") & (F.col("n_found") == 0), "answerable without a source"),
                F.when(~F.col("answerable") & (F.col("n_hits") > 0), "unanswerable with hits"),
                F.when(F.col("last_rank") > F.col("retrieval_max_expected_rank"), "source ranked too low"),
            )
        ),
        each("missing_phrases", "phrase not in the sources: "),
        each("missing_claims", "claim not in the sources: "),
    )
    n_expected = F.size("expected_sources")
    rank = F.when((F.col("n_found") == n_expected) & (n_expected > 0), F.col("last_rank"))
    return met.select("case_id", "query_style", "answerable", n_expected.alias("n_expected"), rank.alias("expected_rank"), "n_hits", failures.alias("failures"), (F.size(failures) == 0).alias("passed"))


def hit_rate(rank: Column, k: int) -> Column:
    """The share of rows whose rank is at most k; a missing rank is no hit."""
    return F.round(F.avg(F.coalesce((rank <= k).cast("double"), F.lit(0.0))), 6)


def mean_reciprocal_rank(rank: Column) -> Column:
    return F.round(F.avg(F.coalesce(1.0 / rank, F.lit(0.0))), 6)


def anchor_coverage(groups: Column, text: Column) -> Column:
    """The share of groups of which some alias stands in text, as whole words; 0 without groups."""
    padded = F.concat(F.lit(" "), F.array_join(T.words(text), " "), F.lit(" "))
    covered = F.size(F.filter(groups, lambda g: F.exists(g, lambda a: (F.size(T.words(a)) > 0) & F.contains(padded, F.concat(F.lit(" "), F.array_join(T.words(a), " "), F.lit(" "))))))
    return F.round(F.when(F.size(groups) > 0, covered / F.size(groups)).otherwise(0.0), 6)


def search_ranks(searches: DataFrame, hits: DataFrame) -> DataFrame:
    """(case_id, search_no, rank): for each search of a case the rank of the first source among its
    hits that the case expects, null if there is none.

    searches: case_id, search_no, expected_sources; hits: case_id, search_no, source_name,
    source_rank, names in lower case."""
    expected = searches.select("case_id", "search_no", F.explode_outer(F.array_distinct(F.transform("expected_sources", lambda s: F.lower(s)))).alias("source_name"))
    met = expected.join(hits, ["case_id", "search_no", "source_name"], "left")
    return met.groupBy("case_id", "search_no").agg(F.min("source_rank").alias("rank"))


def search_report(searches: DataFrame, ranks: DataFrame) -> DataFrame:
    """One row a case: n_searches, first_rank (of the first search that found an expected source),
    best_rank (the least over its searches), first_coverage and best_coverage of its anchor groups
    by the queries, null without groups. searches: case_id, search_no, query, query_anchor_groups."""
    covered = F.when(F.size("query_anchor_groups") > 0, anchor_coverage(F.col("query_anchor_groups"), F.col("query")))
    each = searches.select("case_id", "search_no", covered.alias("coverage")).join(ranks, ["case_id", "search_no"], "left")
    return each.groupBy("case_id").agg(
        F.count("*").alias("n_searches"),
        F.min_by("rank", F.when(F.col("rank").isNotNull(), F.col("search_no"))).alias("first_rank"),
        F.min("rank").alias("best_rank"),
        F.min_by("coverage", "search_no").alias("first_coverage"),
        F.max("coverage").alias("best_coverage"),
    )
