"""Lexical, vector and fused search against plain formulas."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tarnstone.operators import evidence, fusion, lexical, passages, vectors


def test_bm25_against_formula(spark):
    random.seed(5)
    vocabulary = "risk loss capital ratio model tail page claim".split()
    docs = [(f"d{i}", " ".join(random.choices(vocabulary[:3], k=2)), " ".join(random.choices(vocabulary, k=random.randint(1, 12)))) for i in range(40)]
    docs += [("null", None, None)]
    queries = [("q1", "risk tail"), ("q2", "Claim claim page"), ("q3", "nothing")]
    rows = spark.createDataFrame(docs, "id string, name string, text string")
    asked = spark.createDataFrame(queries, "q string, t string")
    fields, weights = {"name": F.col("name"), "text": F.col("text")}, {"name": 5.0, "text": 1.0}
    got = {(r.q, r.id): r.score for r in lexical.bm25(rows, "id", fields, weights, lexical.query_terms(asked, "q", "t"), "q").collect()}
    tokens = {d: {"name": (n or "").split(), "text": (t or "").split()} for d, n, t in docs}
    n, average = len(docs), sum(len(x["name"]) + len(x["text"]) for x in tokens.values()) / len(docs)
    want = {}
    for q, t in queries:
        for d, f in tokens.items():
            score = 0.0
            for term in dict.fromkeys(t.lower().split()):
                for field, w in weights.items():
                    tf = w * f[field].count(term)
                    df = sum(term in x[field] for x in tokens.values())
                    if tf:
                        idf = math.log((n - df + 0.5) / (df + 0.5))
                        score += (idf if idf > 0 else 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * (len(f["name"]) + len(f["text"])) / average))
            if score:
                want[q, d] = score
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_bm25_against_sqlite(spark):
    import sqlite3

    db = sqlite3.connect(":memory:")
    try:
        db.execute("create virtual table t using fts5(name, text)")
    except sqlite3.OperationalError:
        pytest.skip("sqlite without fts5")
    random.seed(6)
    docs = [(f"d{i:02}", " ".join(random.choices("alpha beta gamma".split(), k=2)), " ".join(random.choices("alpha beta gamma delta eta".split(), k=9))) for i in range(25)]
    db.executemany("insert into t(rowid, name, text) values (?, ?, ?)", [(i + 1, n, t) for i, (_, n, t) in enumerate(docs)])
    match = " OR ".join(f'name : "{w}" OR text : "{w}"' for w in ("alpha", "eta"))
    want = {docs[i - 1][0]: -s for i, s in db.execute("select rowid, bm25(t, 5.0, 1.0) from t where t match ?", (match,))}
    rows = spark.createDataFrame(docs, "id string, name string, text string")
    asked = spark.createDataFrame([("q", "alpha eta")], "q string, t string")
    got = lexical.bm25(rows, "id", {"name": F.col("name"), "text": F.col("text")}, {"name": 5.0, "text": 1.0}, lexical.query_terms(asked, "q", "t"), "q").collect()
    assert {r.id for r in got} == set(want) and all(abs(r.score - want[r.id]) < 2e-6 for r in got)


def test_vectors(spark):
    rows = spark.createDataFrame([("a", "loss ratio"), ("b", "loss ratios"), ("c", "zebra"), ("d", ""), ("e", None)], "id string, t string")
    long = vectors.ngram_vectors(rows, "id", F.coalesce("t", F.lit("")))
    norms = {r.id: r.n for r in long.groupBy("id").agg(F.sum(F.col("val") * F.col("val")).alias("n")).collect()}
    assert set(norms) == {"a", "b", "c"} and all(abs(x - 1) < 1e-9 for x in norms.values())
    cos = {(r.q, r.id): r.score for r in vectors.sparse_cosine(long.withColumnRenamed("id", "q"), "q", long, "id").collect()}
    assert cos["a", "a"] == 1.0 and cos["a", "b"] > 0.5 and ("a", "c") not in cos
    stored = {r.id: dict(zip(r.idx, r.val)) for r in vectors.sparse_vectors(rows, "id", F.col("t")).collect()}
    assert stored["d"] == stored["e"] == {} and set(stored) == {"a", "b", "c", "d", "e"}
    for r in long.collect():
        assert abs(stored[r.id][r.idx] - r.val) < 1e-9
    digest = {r.id: r for r in vectors.sparse_vectors(rows, "id", F.col("t"), "blake2b").collect()}
    assert digest["d"].idx == [] and abs(sum(v * v for v in digest["a"].val) - 1) < 1e-9 and digest["a"].idx != sorted(stored["a"])


def test_dense_cosine(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [r.c and round(r.c, 6) for r in rows.select(vectors.dense_cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [0.707107, 0.0, None]
    with pytest.raises(Exception, match="different sizes"):
        rows.select(vectors.dense_cosine(F.col("a"), F.col("b"), strict=True).alias("c")).collect()


def test_nearest_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(7)
    x = rng.normal(size=(120, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "id bigint, v array<double>").repartition(5)
    got = {}
    for r in vectors.nearest(rows, rows.where("id % 10 = 0"), "id", "v", 4).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append(r.id)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q, found in got.items():
        score = np.round(unit @ unit[q], 6)
        assert found == [i for i in sorted(range(120), key=lambda i: (-score[i], i)) if i != q][:4]
    assert len(got) == 12


def test_fusion(spark):
    a = spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], "q string, k string, rank int")
    b = spark.createDataFrame([("q", "y", 1), ("q", "z", 2)], "q string, k string, rank int")
    got = [(r.k, r.score) for r in fusion.reciprocal_rank_fusion(a, b, "q", "k", 0.35).orderBy("rank").collect()]
    assert got == [("y", round(0.65 / 62 + 0.35 / 61, 9)), ("x", round(0.65 / 61, 9)), ("z", round(0.35 / 62, 9))]
    assert [r.k for r in fusion.reciprocal_rank_fusion(a, b, "q", "k", 0.0).orderBy("rank").collect()] == ["x", "y"]
    with pytest.raises(ValueError):
        fusion.reciprocal_rank_fusion(a, b, "q", "k", 1.5)


def test_reading(spark):
    assets = spark.createDataFrame([("a", "r2"), ("b", "r1")], "asset_id string, current_revision_id string")
    chunks = spark.createDataFrame([("a", "r2", "c1", 1, 2, "héllo wörld"), ("a", "r1", "c0", 1, 1, "old"), ("b", "r1", "c3", 4, 5, None)], "asset_id string, revision_id string, chunk_id string, start_line int, end_line int, text string")
    asked = [("a", "r2", "c1", 1, 2), ("a", "r1", "c0", 1, 1), ("a", "r2", "c9", 1, 1), ("a", "r2", "c1", 1, 3), ("x", "r", "c", 1, 1), ("b", "r1", "c3", 4, 5)]
    locators = spark.createDataFrame(asked, "asset_id string, revision_id string, chunk_id string, start_line int, end_line int")
    got = {(r.asset_id, r.chunk_id, r.end_line): (r.status, r.content, r.truncated) for r in evidence.read_chunks(locators, assets, chunks, 2).collect()}
    assert got == {
        ("a", "c1", 2): ("OK", "h", True), ("a", "c0", 1): ("STALE_LOCATOR", None, None), ("a", "c9", 1): ("NOT_FOUND", None, None),
        ("a", "c1", 3): ("INVALID_LOCATOR", None, None), ("x", "c", 1): ("NOT_FOUND", None, None), ("b", "c3", 5): ("OK", "", False),
    }
    with pytest.raises(evidence.LimitExceeded):
        evidence.check_limit(201)


def test_sections_and_literals(spark):
    text = "# A\nx\n## B\ny\n### C\nz\n## D\nw"
    row = spark.createDataFrame([(text,)], "t string").select(evidence.section(F.col("t"), F.lit("b")).alias("s"), evidence.line_range(F.col("t"), F.lit(2), F.lit(3)).alias("l"), evidence.line_range(F.col("t"), F.lit(2), F.lit(99)).alias("n")).first()
    assert row.s == "## B\ny\n### C\nz" and row.l == "x\n## B" and row.n is None
    rows = spark.createDataFrame([("a", "one\nTwo two\ntwo"), ("b", "tw\no"), ("c", None)], "id string, t string")
    assert [tuple(r) for r in evidence.literal_hits(rows, "id", F.col("t"), "two").collect()] == [("a", 2, "Two two")]
    assert [tuple(r) for r in evidence.literal_hits(rows, "id", F.col("t"), "two", True).collect()] == [("a", 2, "Two two")]
    assert evidence.literal_hits(rows, "id", F.col("t"), "").count() == 0


def test_best_passage(spark):
    text = "intro words\nthe loss ratio of engineering\nnothing here\nloss elsewhere\nratio"
    rows = spark.createDataFrame([("a", text, "What is the loss ratio?"), ("b", text, "Nothing here"), ("c", text, "zebra"), ("d", text, "is it")], "id string, t string, q string")
    got = {r.id: (r.first_line, r.last_line) for r in passages.best_passages(rows, "id", "t", "q").collect()}
    assert got == {"a": (1, 3), "b": (3, 3), "c": (1, 1), "d": (1, 1)}


def test_inverted_index_has_all_terms(spark):
    """The whole index agrees with the part for the questions' terms, and has the other terms too."""
    import __spark_entry__ as entry

    d = "/root/testdata/sf0.001"
    run = lambda name: {tuple(r) for r in entry.queries()[name](spark, d).collect()}
    part, whole = run("term_postings"), run("inverted_index")
    asked = {r[2] for r in part}
    assert {r for r in whole if r[2] in asked} == part and len({r[2] for r in whole} - asked) > len(asked)
    counts = {}
    for _, field, term, _, _ in whole:
        counts[field, term] = counts.get((field, term), 0) + 1
    assert {(f, t): n for f, t, n in run("inverted_index_frequency")} == counts


def test_index(spark):
    """A stored index gives what plain rows give; ties by chunk_id; what is lacking and outdated."""
    from tarnstone.operators import index

    random.seed(9)
    vocabulary = "risk loss capital ratio model tail page claim reserve board".split()
    rows = [(f"c{i:03}", f"a{i % 7}", "r1", "n.md", [random.choice(vocabulary)], i, i + 1, " ".join(random.choices(vocabulary, k=random.randint(0, 9)))) for i in range(80)]
    rows += [rows[3], ("c900", "a9", "r1", None, None, 1, 1, None), (None, "a9", "r1", "x", [], 1, 1, "loss"), ("c901", "a9", "r0", "!", [], 1, 1, "?")]
    chunks = spark.createDataFrame(rows, "chunk_id string, asset_id string, revision_id string, source_name string, heading_path array<string>, start_line int, end_line int, text string")
    asked = spark.createDataFrame([("q1", "risk tail"), ("q2", "reserve"), ("q3", "zebra")], "q string, t string")
    stored = index.build(chunks)
    names = {r.chunk_no: r.chunk_id for r in stored.chunks.select("chunk_no", "chunk_id").collect()}
    assert len(names) == 82 and [names[k] for k in sorted(names)] == sorted(names.values())
    terms = lexical.query_terms(asked, "q", "t")
    once = chunks.where("chunk_id is not null").dropDuplicates(["chunk_id"])
    plain = {(r.q, r.chunk_id): r.score for r in lexical.bm25(once, "chunk_id", lexical.chunk_fields(), lexical.CHUNK_WEIGHTS, terms, "q").collect()}
    assert {(r.q, names[r.chunk_no]): r.score for r in index.lexical_scores(stored, terms, "q").collect()} == plain and plain
    inside = stored.chunks.where("asset_id = 'a1'").select("chunk_no")
    assert {(r.q, names[r.chunk_no]) for r in index.lexical_scores(stored, terms, "q", within=inside).collect()} == {k for k in plain if k[1] in {r[0] for r in rows if r[1] == "a1"}}
    pairs = asked.select(F.col("q").alias("key"), F.col("t").alias("text"))
    near = {(r.query, names[r.key]): r.score for r in index.semantic_hits(stored, pairs, 100).collect()}
    text = F.concat_ws("\n", F.array_join("heading_path", "\n"), F.coalesce("text", F.lit("")))
    want = vectors.sparse_cosine(vectors.ngram_vectors(asked, "q", F.col("t")), "q", vectors.ngram_vectors(once, "chunk_id", text), "chunk_id")
    want = {(r.q, r.chunk_id): r.score for r in want.collect()}
    assert near.keys() == want.keys() and all(abs(near[k] - want[k]) < 2e-6 for k in want) and want
    assert index.lacking(stored, "postings").count() == index.lacking(stored, "vectors").count() == 0
    pointers = spark.createDataFrame([(f"a{i}", "r1") for i in range(6)] + [("a9", "r1")], "asset_id string, revision_id string")
    assert {r.chunk_id for r in index.outdated(stored, pointers).collect()} == {r[0] for r in rows if r[1] == "a6"} | {"c901"}
    words = spark.createDataFrame([("s", "apita"), ("s", "oard"), ("t", "%")], "q string, word string")
    got = [(r.rank, r.score, names[r.chunk_no]) for r in index.by_substrings(stored.chunks, "chunk_no", lexical.chunk_fields(), words, "q", ["start_line", "end_line"], 5).orderBy("rank").collect()]
    held = [(float(("apita" in t) + ("oard" in t)), c) for c, t in ((r[0], " ".join(r[4]) + " " + r[7]) for r in rows[:80]) if "apita" in t or "oard" in t]
    assert got == [(k, *x) for k, x in enumerate(held[:5], 1)]


def test_index_without_rows(spark):
    from tarnstone.operators import index

    empty = spark.createDataFrame([], "chunk_id string, source_name string, heading_path array<string>, text string")
    stored = index.build(empty)
    asked = spark.createDataFrame([("q", "risk")], "key string, text string")
    assert index.lexical_scores(stored, lexical.query_terms(asked, "key", "text"), "key").count() == 0 and index.semantic_hits(stored, asked, 5).count() == 0


def test_cursors_and_locators(spark):
    from tarnstone.functions import ids

    listed = spark.createDataFrame([("q", "search::q", "snap", 45)], "q string, query_key string, snapshot_id string, n_hits int")
    good = ids.cursor(F.lit("snap"), F.lit("search::q"), F.lit(20))
    cursors = {"good": good, "other list": ids.cursor(F.lit("old"), F.lit("search::q"), F.lit(20)), "other query": ids.cursor(F.lit("snap"), F.lit("list:"), F.lit(20)), "end": ids.cursor(F.lit("snap"), F.lit("search::q"), F.lit(45)), "beyond": ids.cursor(F.lit("snap"), F.lit("search::q"), F.lit(46)), "before": ids.cursor(F.lit("snap"), F.lit("search::q"), F.lit(-1)), "noise": F.lit("%%%"), "empty": F.lit(""), "json": F.lit("W10"), "null": F.lit(None).cast("string")}
    frame = spark.range(1).select(F.lit("q").alias("q"), F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), c.alias("cursor")) for k, c in cursors.items()))))
    got = {r.kind: (r.status, r.page_offset) for r in evidence.resume(frame, listed, "q").collect()}
    assert got == dict.fromkeys(cursors, ("CURSOR_INVALID", None)) | {"good": ("OK", 20), "end": ("OK", 45)}
    locators = ['{"provider":"p","resource_id":"a","revision":"r","selector":null,"version":1}', '{"provider":"p","resource_id":"a","revision":"r","selector":{"type":"line","start":2,"end":3},"version":1}', '{"provider":"p","resource_id":"","revision":"r","version":1}', '{"provider":"p","resource_id":"a","revision":"r","version":2}', '{"provider":"p","revision":"r","version":1}', "a.md:3", "", None]
    parsed = spark.createDataFrame([(i, x) for i, x in enumerate(locators)], "i int, l string").select("i", ids.parse_locator(F.col("l")).alias("p")).orderBy("i").collect()
    assert [r.p is not None for r in parsed] == [True, True] + [False] * 6 and parsed[1].p.selector.start == 2 and parsed[0].p.selector is None
    keys = spark.range(1).select(ids.query_key("list"), ids.query_key("find", "lib", "Ab*"), ids.query_key("search", None, "Ab")).first()
    assert tuple(keys) == ("list:", "find:lib:ab*", "search::Ab")


def test_shorthands(spark):
    assets = spark.createDataFrame([("a2", "Guide.md", "r2"), ("a1", "guide.md", "r1"), ("a3", "Old guide.md", "r3"), ("a4", None, "r4"), ("a5", "z:7", "r5")], "asset_id string, source_name string, current_revision_id string")
    asked = spark.createDataFrame([(s,) for s in ("GUIDE.md", "guide.md:0012", "old", "uide", "none.md:3", "", ":5", "z:7")], "shorthand string")
    got = {r.shorthand: (r.asset_id, r.revision_id, r.line) for r in evidence.resolve_shorthand(asked, "shorthand", assets).collect()}
    assert got == {"GUIDE.md": ("a1", "r1", None), "guide.md:0012": ("a1", "r1", 12), "old": ("a3", "r3", None), "uide": ("a1", "r1", None), "none.md:3": (None, None, 3), "": (None, None, None), ":5": (None, None, None), "z:7": ("a5", "r5", 7)}


def test_broadcast_bounds(spark, monkeypatch):
    """A side goes beyond the bound by rows or by bytes, whatever it is made of."""
    from tarnstone import runtime

    def hinted(df):
        return "ResolvedHint" in df._jdf.queryExecution().analyzed().toString() or "strategy=broadcast" in df._jdf.queryExecution().analyzed().toString()

    small = spark.range(100).withColumn("t", F.lit("x"))
    long = spark.range(100).withColumn("t", F.repeat(F.lit("x"), 1000))
    assert hinted(runtime.broadcast_if_small(small)) and hinted(runtime.broadcast_if_small(small.groupBy("t").count()))
    assert not hinted(runtime.broadcast_if_small(small, 99))
    monkeypatch.setattr(runtime, "BROADCAST_BYTES", 50_000)
    assert hinted(runtime.broadcast_if_small(small)) and not hinted(runtime.broadcast_if_small(long)) and not hinted(runtime.broadcast_if_small(long.groupBy("id").agg(F.collect_list("t").alias("a"))))


def test_join_few(spark, monkeypatch):
    """With few rows, or too many to broadcast: the same rows, and the filter drops nearly all others."""
    from tarnstone import runtime

    rows = spark.range(4000).select(F.col("id").alias("a"), F.when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("b"), F.repeat(F.lit("x"), 10).alias("t"))
    few = spark.range(0, 4000, 40).select(F.col("id").alias("a"), F.col("id").cast("string").alias("b"), F.lit(1).alias("n"))
    want = {i for i in range(0, 4000, 40) if i % 7}
    for bound in (200_000, 0):
        monkeypatch.setattr(runtime, "BROADCAST_ROWS", bound)
        assert {(r.a, r.n) for r in runtime.join_few(rows, few, ["a", "b"]).collect()} == {(i, 1) for i in want}
        assert {r.a for r in runtime.join_few(rows, few.select("a", "b"), ["a", "b"], "left_semi").collect()} == want
        assert runtime.join_few(rows, few.limit(0), ["a", "b"]).count() == 0
    kept = {r.a for r in runtime._may_hold(rows, few, ["a", "b"]).collect()}
    assert want <= kept and len(kept) < len(want) + 200
    monkeypatch.setattr(runtime, "BLOOM_BITS", 1024)
    assert want <= {r.a for r in runtime._may_hold(rows, few, ["a", "b"]).collect()}


def test_best_by_blocks(spark):
    """Rankings by blocks are those of all pairs, ties and words asked twice included; a search writes
    no vectors and makes no row of a pair of query and chunk."""
    import numpy as np

    from tarnstone.operators import index, ranking

    random.seed(3)
    scores = np.round(np.array([[random.choice([-np.inf, 0.0, 0.5, random.random()]) for _ in range(900)] for _ in range(7)]), 6)
    keys = np.array(random.sample(range(10**12), 900))
    best = ranking.Best(7, 10, 0.0)
    for i in range(0, 900, 60):
        best.add(scores[:, i : i + 60], keys[i : i + 60])
    best.trim()
    got = list(zip(*(x.tolist() for x in best.rows())))
    assert got == [(q, k, s) for q in range(7) for s, k in sorted(((s, k) for s, k in zip(scores[q].tolist(), keys.tolist()) if s >= 0), key=lambda x: (-x[0], x[1]))[:10]]
    vocabulary = "risk loss capital ratio model tail page claim reserve board x_y".split()
    rows = [(f"c{i:04}", "n.md", [random.choice(vocabulary)], " ".join(random.choices(vocabulary, k=random.randint(0, 5)))) for i in range(3000)]
    stored = index.build(spark.createDataFrame(rows, "chunk_id string, source_name string, heading_path array<string>, text string"))
    asked = spark.createDataFrame([(f"q{i:04}", " ".join(random.choices([*vocabulary, "x", "unheard"], k=i % 4))) for i in range(60)], "key string, text string")
    terms = lexical.query_terms(asked, "key", "text")
    plain = lexical.top(index.lexical_scores(stored, terms, "key"), "key", "chunk_no", 25)
    assert {tuple(r) for r in index.lexical_hits(stored, terms, "key", 25).select(*plain.columns).collect()} == {tuple(r) for r in plain.collect()}
    near = index.semantic_hits(stored, asked, 25)
    assert "vectors" not in vars(stored)
    whole = vectors.search_blocks(vectors.sparse_blocks(stored.vectors, "chunk_no"), vectors.ngram_blocks(asked), 25, vectors.FLOOR)
    assert {tuple(r) for r in near.select(*whole.columns).collect()} == {tuple(r) for r in whole.collect()} and near.count() > 500
