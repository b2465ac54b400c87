"""The store: pointers, upserts, what is inserted once, files and streams."""

import datetime as dt
import io
import zipfile

from pyspark.sql import functions as F

from tarnstone.operators import answers, evidence, evaluation, heuristics, store
from tarnstone.sources import directory, files
from tarnstone.streaming import ingest

REVISION = "asset_id string, revision_id string, created_at timestamp_ntz, markdown string"


def at(n):
    return dt.datetime(2024, 1, n)


def test_put_keeps_revisions_and_moves_pointers(spark):
    assets = spark.createDataFrame([("a", "r1", at(1)), ("a", "r2", at(2)), ("b", "r1", at(1)), (None, "x", at(1))], "asset_id string, current_revision_id string, updated_at timestamp_ntz")
    revisions = spark.createDataFrame([("a", "r1", at(1), "one"), ("a", "r1", at(3), "late"), ("a", "r2", at(2), "two"), ("b", "r1", at(1), "b")], REVISION)
    new = spark.createDataFrame([("a", "r1", at(5))], "asset_id string, current_revision_id string, updated_at timestamp_ntz")
    again = spark.createDataFrame([("a", "r1", at(5), "again"), ("c", "r9", at(5), "c")], REVISION)
    out_assets, out_revisions = store.put(assets, revisions, new, again)
    assert {(r.asset_id, r.current_revision_id) for r in out_assets.collect()} == {("a", "r1"), ("b", "r1")}
    assert {(r.asset_id, r.revision_id, r.markdown) for r in out_revisions.collect()} == {("a", "r1", "one"), ("a", "r2", "two"), ("b", "r1", "b"), ("c", "r9", "c")}
    assert {r.revision_id for r in store.current_revisions(assets, revisions).collect()} == {"r2", "r1"}


def test_what_lacks_chunks(spark):
    assets = spark.createDataFrame([("a", "r1", at(1)), ("b", "r1", at(1))], "asset_id string, current_revision_id string, updated_at timestamp_ntz")
    revisions = spark.createDataFrame([("a", "r1", at(1), ""), ("b", "r1", at(1), "")], REVISION)
    chunks = spark.createDataFrame([("a", "r1", "c")], "asset_id string, revision_id string, chunk_id string")
    assert [r.asset_id for r in store.without_chunks(assets, revisions, chunks).collect()] == ["b"]
    assert store.without_chunks(assets.limit(0), revisions.limit(0), chunks.limit(0)).count() == 0


def office(members):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return data.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"# T\nx \xff")
    (tmp_path / "b.html").write_text("<h1>A &amp; b</h1><!-- no --><script>s</script><p>c <b>d</b></p>")
    (tmp_path / "c.docx").write_bytes(office({"word/document.xml": "<d><t>one</t><t> two </t></d>"}))
    (tmp_path / "d.pptx").write_bytes(office({f"ppt/slides/slide{n}.xml": f"<s><t>s{n}</t><t>x</t></s>" for n in (10, 2)}))
    (tmp_path / "e.docx").write_bytes(b"broken")
    (tmp_path / "f.exe").write_bytes(b"x")
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "g.md").write_text("no")
    rows = {r.source_name: r for r in files.extract(files.scan_folder(spark, str(tmp_path))).collect()}
    assert set(rows) == {"a.md", "b.html", "c.docx", "d.pptx", "e.docx", "f.exe"}
    assert rows["a.md"].markdown == "# T\nx \ufffd\n" and '"text":"T"' in rows["a.md"].content_list_json
    assert rows["b.html"].markdown == "A & b\ns\nc\nd\n"
    assert rows["c.docx"].markdown == "one\ntwo\n" and rows["d.pptx"].markdown == "s2 x\n\ns10 x\n"
    assert rows["e.docx"].markdown is None and "office" in rows["e.docx"].error and rows["f.exe"].error == "UNSUPPORTED: .exe"
    assert rows["a.md"].revision_id and rows["e.docx"].revision_id is None


def test_cases(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('# note\n\n{"case_id": "1", "question": "q", "expected_sources": ["A.md"]}\n')
    case = evaluation.gold_cases(files.read_cases(spark, str(tmp_path / "c.jsonl"))).first()
    assert case.answerable and case.must_cite and case.query == "q" and case.required_phrases == []


def test_stream_takes_each_revision_once(spark, tmp_path):
    rows = [("a", "r1", at(1), "x"), ("a", "r1", at(1), "x"), ("a", "r2", at(2), "y")]
    source = str(tmp_path / "in")
    frame = spark.createDataFrame(rows, REVISION)
    frame.write.parquet(source)
    for _ in range(2):
        ingest.ingest(ingest.arriving_revisions(spark, frame.schema, source), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r.revision_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["r1", "r2"]
    assert store.latest(spark.read.parquet(str(tmp_path / "out")), ["asset_id"], [F.col("created_at"), F.col("revision_id")]).first().revision_id == "r2"


def test_delete_takes_what_belongs_to_an_asset(spark):
    gone = spark.createDataFrame([("a",), ("a",), (None,)], "asset_id string")
    rows = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "asset_id string, n int")
    left = store.delete(gone, assets=rows, chunks=rows.limit(0))
    assert sorted(r.n for r in left["assets"].collect()) == [2, 3] and left["chunks"].count() == 0


def test_judgements(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("那四种？",), ("模型的适用范围？",), ("这个模型",), ("What are the four?",), ("",), (None,), ("loss ratio trend",)], "q string")
    assert [r.x for r in rows.select(heuristics.needs_context(F.col("q")).alias("x")).collect()] == [True, False, False, True, True, True, False]
    pairs = spark.createDataFrame([("loss ratio trend", "the loss ratio", False), ("loss ratio trend", "loss and ratio trend", True), ("loss", "loss", False), ("loss ratio trend cover", "loss ratio", False)], "q string, t string, ok boolean")
    got = pairs.select("q", "t", "ok", heuristics.supports(F.col("q"), F.col("t")).alias("x")).collect()
    assert [r.x for r in got] == [True, True, False, False]


def test_evaluation(spark):
    claim = [{"answer_phrases": ["seven", "7"], "evidence_phrases": ["never here", "TWO"]}, {"answer_phrases": ["x"], "evidence_phrases": ["nowhere"]}]
    cases = evaluation.gold_cases(spark.createDataFrame([
        ("1", "q", ["A.md", "b.md"], None, ["one", "two"], None, None, None, "short", None, 1, None),
        ("2", "q", None, None, None, False, None, None, None, None, None, None),
        ("3", "q", ["z.md"], None, ["never"], None, None, None, "short", None, None, None),
        ("4", "q", None, None, None, None, None, None, None, None, None, None),
        ("5", "q", ["a.md", "z.md"], None, ["", "elsewhere"], True, None, None, None, None, None, claim),
        ("6", "q", ["a.md"], None, None, None, None, None, None, None, 1, None),
        ("7", "q", ["Z.md"], None, None, False, None, None, None, None, None, None),
        ("8", "q", None, None, None, False, None, None, None, None, None, None),
    ], files.CASE_SCHEMA))
    hits = [("1", 1, "a.md", "has one"), ("1", 2, "c.md", "two"), ("1", 3, "B.md", "stone"), ("1", 4, "b.md", "t-\nwo here: two, and more"), ("1", 5, "a.md", "more"), ("2", 1, "a.md", "x")]
    hits += [("3", 1, "a.md", "never"), ("4", 1, "a.md", "x"), ("5", 1, "a.md", "one or two"), ("5", 2, "b.md", "elsewhere nowhere"), ("6", 1, "a.md", "é" * 15_000), ("6", 2, "a.md", "x"), ("7", 1, "y.md", "x")]
    hits = spark.createDataFrame(hits, "case_id string, rank int, source_name string, text string")
    sources = evidence.first_appearance(hits, "case_id", "source_name", "rank")
    ranks = evaluation.expected_ranks(cases, sources)
    assert {r.case_id: (r.expected_rank, r.expected_chunk_rank) for r in ranks.collect()} == {"1": (3, 3), "3": (None, None), "5": (None, None), "6": (1, 1), "7": (None, None)}
    found = evaluation.evidence_of_targets(cases, hits)
    got = {r.case_id: (r.evidence_rank, r.missing_phrases, r.missing_claims, r.n_read, r.evidence_bytes) for r in found.collect()}
    assert got["1"] == (4, [], [], 3, len("has one" + "stone" + "t-\nwo here: two, and more")) and got["3"] == (None, ["never"], [], 0, 0)
    assert got["5"] == (None, ["elsewhere"], ["x"], 1, 10) and got["6"] == (None, [], [], 1, 20_000) and got["2"] == got["8"] == (None, [], [], 0, 0)
    want = {
        "1": ["source ranked too low"], "2": ["unanswerable with hits"], "3": ["source not found: z.md", "answerable without a source", "phrase not in the sources: never"], "4": ["answerable without a source"],
        "5": ["source not found: z.md", "phrase not in the sources: elsewhere", "claim not in the sources: x"], "6": [], "7": ["source not found: Z.md", "unanswerable with hits"], "8": [],
    }
    verdicts = {r.case_id: r for r in evaluation.verdicts(cases, sources, hits, found).collect()}
    assert {k: r.failures for k, r in verdicts.items()} == want and all(r.passed == (not r.failures) for r in verdicts.values())
    assert verdicts["1"].expected_rank == 3 and verdicts["5"].expected_rank is None


def test_phrases_in_evidence(spark):
    rows = [("The loss- \nratio of  two", "LOSSRATIO", True), ("a l o s s ratio", "loss ratio", True), ("glossratio", "loss", False), ("loss 2", "loss 2.", False), ("(a+b)*", "(a + b)*", False), ("( a + b ) *", "(a + b)*", True), ("été passé", "ÉTÉ", True), (None, "x", False)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, p string, want boolean")
    got = frame.select("i", "want", evaluation.holds_phrase(evaluation.clean_evidence(F.col("t")), F.col("p")).alias("holds")).collect()
    assert [(r.i, r.holds) for r in got] == [(r.i, r.want) for r in got]


def test_searches(spark):
    groups = [["loss ratio", "lr"], ["", "tail"]]
    searches = spark.createDataFrame([("1", 1, "loss", ["A.md", "b.md"], groups), ("1", 2, "the loss ratio tail", ["A.md", "b.md"], groups), ("2", 1, "x", [], None), ("3", 1, "y", ["z.md"], [])], "case_id string, search_no int, query string, expected_sources array<string>, query_anchor_groups array<array<string>>")
    hits = spark.createDataFrame([("1", 1, "c.md", 1), ("1", 1, "b.md", 4), ("1", 2, "b.md", 3), ("1", 2, "a.md", 2), ("3", 1, "c.md", 1)], "case_id string, search_no int, source_name string, source_rank int")
    got = {r.case_id: tuple(r)[1:] for r in evaluation.search_report(searches, evaluation.search_ranks(searches, hits)).collect()}
    assert got == {"1": (2, 4, 2, 0.0, 1.0), "2": (1, None, None, None, None), "3": (1, None, None, None, None)}


def test_answers(spark):
    text = "The ratio is 7. [ev-1a] It rose\nNo one said so. End 8.5 of [ev-2b]"
    frame = spark.createDataFrame([("a", text), ("b", None)], "k string, answer string")
    assert frame.where("k = 'a'").select(answers.sentences(F.col("answer")).alias("s"), answers.citations(F.col("answer")).alias("c")).first() == (["The ratio is 7. [ev-1a] It rose", "No one said so.", "End 8.5 of [ev-2b]"], ["ev-1a", "ev-2b"])
    phrases = spark.createDataFrame([("a", 0, "RATIO"), ("a", 1, "no one"), ("a", 2, "absent"), ("b", 0, "x"), ("c", 0, "y")], "k string, no int, phrase string")
    got = {(r.k, r.no): (r.in_answer, r.cited) for r in answers.cited_phrases(frame, phrases, "k").collect()}
    assert got == {("a", 0): (True, True), ("a", 1): (True, False), ("a", 2): (False, False), ("b", 0): (False, False), ("c", 0): (False, False)}


def test_directory(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    rows = [("1e3", "007", "# One\n\ntwo"), ("1e3", "008", ""), ("b/c", "r", "x\n"), ("n", "r", None), (None, "r", "x"), ("1e3", "007", "# One\n\ntwo")]
    frame = spark.createDataFrame(rows, "asset_id string, revision_id string, markdown string")
    directory.put_directory(frame, folder)
    directory.put_directory(spark.createDataFrame([("1e3", "007", "changed"), ("d", "r", "new")], frame.schema), folder)
    got = {(r.asset_id, r.revision_id): r.markdown for r in directory.scan_directory(spark, folder).collect()}
    assert got == {("1e3", "007"): "# One\n\ntwo", ("1e3", "008"): "", ("b/c", "r"): "x\n", ("d", "r"): "new"}


def test_empty_files_are_files(spark, tmp_path):
    (tmp_path / "a b.txt").write_text("")
    (tmp_path / "c.md").write_text("# C")
    (tmp_path / ".d.md").write_text("")
    got = {r.source_name: (r.markdown, r.error) for r in files.extract(files.scan_folder(spark, str(tmp_path))).collect()}
    assert got == {"a b.txt": ("\n", None), "c.md": ("# C\n", None)}


def test_current_chunks_without_shuffled_texts(spark):
    """With sized pointers the texts meet them by broadcast; the rows are the same."""
    import datetime as dt

    from tarnstone.operators import store

    at = dt.datetime(2024, 1, 1)
    assets = spark.createDataFrame([("a", "r1", at), ("a", "r2", at + dt.timedelta(1)), ("b", None, at), ("c", "r9", at)], "asset_id string, current_revision_id string, updated_at timestamp_ntz")
    chunks = spark.createDataFrame([("c1", "a", "r1", "old"), ("c2", "a", "r2", "x"), ("c2", "a", "r2", "x"), (None, "a", "r2", "y"), ("c3", "b", "r1", "z")], "chunk_id string, asset_id string, revision_id string, text string")
    rows = store.current_chunks(assets, chunks, sized=True)
    assert [r.asDict() for r in rows.collect()] == [r.asDict() for r in store.current_chunks(assets, chunks).collect()] == [{"chunk_id": "c2", "asset_id": "a", "revision_id": "r2", "text": "x"}]
    assert "BroadcastHashJoin" in rows._jdf.queryExecution().toString()
