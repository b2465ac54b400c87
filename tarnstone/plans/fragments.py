"""Parts that several SQL texts share."""

from tarnstone.functions.text import LINE_END, MARKED, PLAIN

#: The last put row of each asset.
ASSETS = """current_asset AS (
  SELECT * FROM assets WHERE asset_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY updated_at DESC NULLS LAST, current_revision_id DESC NULLS LAST) = 1)"""

#: Each revision once, the earliest delivery.
REVISIONS = """revision AS (
  SELECT * FROM asset_revisions WHERE asset_id IS NOT NULL AND revision_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY asset_id, revision_id ORDER BY created_at NULLS LAST) = 1)"""

CURRENT = ASSETS + ",\n" + REVISIONS + """,
current_revision AS (
  SELECT r.* FROM revision r JOIN current_asset a ON r.asset_id = a.asset_id AND r.revision_id = a.current_revision_id)"""

CHUNKS = ASSETS + """,
chunk AS (
  SELECT DISTINCT ON (k.chunk_id) k.* FROM knowledge_chunks k
  JOIN current_asset a ON k.asset_id = a.asset_id AND k.revision_id = a.current_revision_id WHERE k.chunk_id IS NOT NULL)"""

CASES = """gold AS (
  SELECT case_id, question, coalesce(expected_sources, []) AS expected_sources, coalesce(required_phrases, []) AS required_phrases,
         coalesce(required_evidence_phrases, []) AS required_evidence_phrases, coalesce(answerable, true) AS answerable,
         coalesce(retrieval_query, question) AS query, query_style, query_anchor_groups, retrieval_max_expected_rank, required_claims
  FROM gold_cases)"""


def fold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def words(x: str) -> str:
    return f"regexp_extract_all({fold(x)}, '[\\p{{L}}\\p{{N}}_]+')"


def terms(x: str) -> str:
    return f"regexp_extract_all(translate(lower({x}), '{MARKED}', '{PLAIN}'), '[\\p{{L}}\\p{{N}}]+')"


def lines(x: str) -> str:
    parts = f"string_split_regex({x}, '{LINE_END}')"
    return f"CASE WHEN {parts}[-1] = '' THEN {parts}[1:-2] ELSE {parts} END"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '[\\s\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x0B\\x1c-\\x1f]+', ' ', 'g'))"


#: BM25 of the chunks for all cases: score (case_id, chunk_id, score).
BM25 = CHUNKS + ",\n" + CASES + f""",
question_word AS (SELECT DISTINCT case_id, unnest({words('query')}) AS word FROM gold),
question_term AS (SELECT case_id, word, unnest({terms('word')}) AS term FROM question_word),
field_terms AS (
  SELECT chunk_id, source_name, {terms("coalesce(source_name, '')")} AS t1,
         {terms("array_to_string(coalesce(heading_path, []), ' ')")} AS t2, {terms("coalesce(text, '')")} AS t3 FROM chunk),
sized AS (SELECT *, len(t1) + len(t2) + len(t3) AS length FROM field_terms),
statistics AS (SELECT count(*) AS n, avg(length) AS average FROM sized),
each_term AS (
  SELECT chunk_id, length, 'source_name' AS field, 5.0 AS weight, unnest(t1) AS term FROM sized
  UNION ALL SELECT chunk_id, length, 'heading', 3.0, unnest(t2) FROM sized
  UNION ALL SELECT chunk_id, length, 'text', 1.0, unnest(t3) FROM sized),
posting AS (
  SELECT chunk_id, field, weight, term, count(*) AS tf, any_value(length) AS length FROM each_term
  WHERE term IN (SELECT term FROM question_term) GROUP BY ALL),
frequency AS (SELECT field, term, count(*) AS df FROM posting GROUP BY ALL),
part AS (
  SELECT chunk_id, p.term,
         CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END
         * (tf * weight) * 2.2 / (tf * weight + 1.2 * (0.25 + 0.75 * length / average)) AS value
  FROM posting p JOIN frequency f ON p.field = f.field AND p.term = f.term, statistics),
chunk_part AS (SELECT chunk_id, term, sum(value) AS value FROM part GROUP BY ALL),
score AS (SELECT case_id, chunk_id, round(sum(value), 6) AS score FROM chunk_part JOIN question_term USING (term) GROUP BY ALL),
hit AS (
  SELECT case_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY case_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank
  FROM score QUALIFY rank <= 200)"""


def loose(phrase: str) -> str:
    """A pattern for phrase (folded already) with white space between any of its characters."""
    word = "array_to_string(list_transform(string_split(w, ''), lambda c: CASE WHEN regexp_matches(c, '[!-/:-@\\[-`{-~]') THEN '\\' || c ELSE c END), '\\s*')"
    return f"'(^|[^a-z0-9])' || array_to_string(list_transform(regexp_extract_all({phrase}, '\\S+'), lambda w: {word}), '\\s+') || '($|[^a-z0-9])'"


def clean(x: str) -> str:
    """Evidence as phrases are looked for in it."""
    joined = f"regexp_replace({fold(x)}, '([\\p{{L}}\\p{{N}}_])-\\s*\\n\\s*([\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g')"
    return collapse(joined)


def first_bytes(x: str, n: int) -> str:
    """The first n bytes without a cut character."""
    cut = ", ".join(f"try(decode(array_slice(encode({x}), 1, {k})))" for k in range(n, n - 4, -1))
    return f"CASE WHEN strlen({x}) <= {n} THEN {x} ELSE coalesce({cut}) END"


_REQUIRED = """
expected AS (SELECT DISTINCT case_id, lower(unnest(expected_sources)) AS source_name FROM gold),
needed AS (SELECT * FROM (
  SELECT case_id, 'phrase' AS kind, unnest(range(len(required_evidence_phrases))) AS no, unnest(required_evidence_phrases) AS label, unnest(list_transform(required_evidence_phrases, lambda p: [p])) AS phrases FROM gold
  UNION ALL SELECT case_id, 'claim', unnest(range(len(required_claims))), unnest(list_transform(required_claims, lambda c: array_to_string(c.answer_phrases, ' | '))), unnest(list_transform(required_claims, lambda c: c.evidence_phrases)) FROM gold)
  WHERE len(list_filter(phrases, lambda p: trim(p) = '')) = 0)"""

#: What the evidence of the expected sources holds: evidence (case_id, evidence_rank, required, missing_phrases, missing_claims, n_read, evidence_bytes).
EVIDENCE = BM25 + "," + _REQUIRED + f""",
target AS (SELECT h.case_id, h.rank, e.source_name, {first_bytes("coalesce(k.text, '')", 20000)} AS text
  FROM hit h JOIN chunk k USING (chunk_id) JOIN expected e ON e.case_id = h.case_id AND e.source_name = lower(k.source_name)),
cleaned AS (SELECT case_id, rank, {clean('text')} AS text FROM target),
first_met AS (SELECT case_id, kind, no, min(rank) AS first FROM cleaned JOIN (SELECT case_id, kind, no, unnest(phrases) AS phrase FROM needed) USING (case_id) WHERE regexp_matches(text, {loose(fold('phrase'))}) GROUP BY ALL),
need_state AS (SELECT case_id, count(f.first) = count(*) AS complete, max(f.first) AS last,
    coalesce(list(label ORDER BY no) FILTER (f.first IS NULL AND kind = 'phrase'), []) AS missing_phrases, coalesce(list(label ORDER BY no) FILTER (f.first IS NULL AND kind = 'claim'), []) AS missing_claims
  FROM needed LEFT JOIN first_met f USING (case_id, kind, no) GROUP BY case_id),
found_state AS (SELECT case_id, count(*) AS n_found, max(first) AS last_source FROM (SELECT case_id, source_name, min(rank) AS first FROM target GROUP BY ALL) GROUP BY case_id),
wanted_sources AS (SELECT case_id, count(*) AS n_sources FROM expected GROUP BY case_id),
stop AS (SELECT g.case_id, n.complete IS NOT NULL AS required, coalesce(n.missing_phrases, []) AS missing_phrases, coalesce(n.missing_claims, []) AS missing_claims,
    CASE WHEN f.n_found > 0 AND f.n_found = w.n_sources AND coalesce(n.complete, true) THEN greatest(coalesce(n.last, 0), f.last_source) END AS stop
  FROM gold g LEFT JOIN need_state n USING (case_id) LEFT JOIN found_state f USING (case_id) LEFT JOIN wanted_sources w USING (case_id)),
evidence AS (SELECT s.case_id, CASE WHEN required THEN stop END AS evidence_rank, required, any_value(missing_phrases) AS missing_phrases, any_value(missing_claims) AS missing_claims,
    count(t.rank) AS n_read, coalesce(sum(strlen(t.text)), 0)::BIGINT AS evidence_bytes
  FROM stop s LEFT JOIN target t ON t.case_id = s.case_id AND (stop IS NULL OR t.rank <= stop) GROUP BY s.case_id, stop, required)"""
