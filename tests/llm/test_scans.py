"""Scanned pages: labels of lines, divided and misread words, paragraphs."""

import numpy as np

from tarnstone.llm import scan_repair as sr

PAGE = """# Reserve review Norbano Mutual

The ratio for engineering rose from 19.2 percent to 41.8 percent
and the supervisor asked for evi‐
dence of the lapse assumpti0ns in
2014.

The steering group adjusted the look-
through report after the second re-

                              - 8 -
<!-- page: 9 -->
Reserve review Norbano Mutual

view of the year and the percerit rate was
kept under the watch of the board

9
Reserve revicw Norbano Mutual

for the rest of the season."""
CLEAN = "The review of the look-through report gave evidence. The lapse assumptions of one percent. review percent evidence assumptions " * 20


def test_defects_and_paragraphs(spark):
    rows = [("r1", "/library/harnby-archive-0003/1.pdf", PAGE), ("r1", "/library/harnby-archive-0003/1.pdf", PAGE), ("r2", None, CLEAN), ("r3", None, None), ("r4", None, ""), (None, None, PAGE)]
    frame = spark.createDataFrame(rows, "revision_id string, source_path string, markdown string")
    faults = sr.defects(frame)
    got = {(r.line_no, r.defect) for r in sr.found(faults).where("revision_id = 'r1'").collect()}
    assert got == {(4, "hyphen"), (9, "hyphen"), (5, "char"), (11, "page_no"), (13, "header"), (15, "char"), (18, "page_no"), (19, "header")}
    assert sr.found(faults).where("revision_id <> 'r1'").count() == 0
    parts = [r.text for r in sr.paragraphs(frame, faults).where("revision_id = 'r1'").orderBy("paragraph_no").collect()]
    assert parts == [
        "# Reserve review Norbano Mutual",
        "The ratio for engineering rose from 19.2 percent to 41.8 percent and the supervisor asked for evidence of the lapse assumptions in 2014.",
        "The steering group adjusted the look-through report after the second review of the year and the percent rate was kept under the watch of the board for the rest of the season.",
    ]
    chunks = spark.createDataFrame([("c1", "r1", 3, "\n".join(PAGE.split("\n")[2:6])), ("c2", "r2", 1, "x"), ("c3", "r1", 1, None)], "chunk_id string, revision_id string, start_line int, text string")
    assert [(r.chunk_id, r.n_defects, r.text) for r in sr.repaired_chunks(chunks, faults).collect()] == [("c1", 2, parts[1])]
    assert sr.defects(frame.limit(0)).count() == 0


def test_misread_halves_of_a_divided_word(spark):
    """The line of a misread half is that half's line; the repair puts the whole word right, and
    nothing that only holds the misread string inside another word."""
    page = "The board looked at the 5ettle-\nment of the claims and the assump-\nti0ns of the plan, as 5ettlements2 shows\nin the table of the re-\nport."
    clean = "The settlement of claims and the assumptions of the plan, settlement by settlement, and report. " * 30
    frame = spark.createDataFrame([("r1", None, page), ("r2", None, clean)], "revision_id string, source_path string, markdown string")
    faults = sr.defects(frame)
    got = {(r.line_no, r.defect) for r in sr.found(faults).where("revision_id = 'r1'").collect()}
    assert got == {(1, "hyphen"), (2, "hyphen"), (4, "hyphen"), (1, "char"), (3, "char")}
    (text,) = [r.text for r in sr.paragraphs(frame, faults).where("revision_id = 'r1'").collect()]
    assert text == "The board looked at the settlement of the claims and the assumptions of the plan, as 5ettlements2 shows in the table of the report."


def test_what_follows_what_is_learnt(spark):
    """A bare number that fits no sequence: inside a paragraph it is body, alone between page ends a
    page number. Only the fitted transitions tell."""
    import pandas as pd

    body, alone, blank, header, number = 8, 8 + 8, 0, 8 + 2, 8 + 3 * 8 + 4
    texts = [[body, body, body, blank, body, body, blank, number, blank, header, blank] * 6 for _ in range(30)]
    texts += [[body, body, body, alone, body, body, body], [body, body, blank, alone, blank, header, blank, body]]
    lines = spark.createDataFrame(pd.DataFrame({"symbols": texts}), "symbols array<int>")
    fitted = sr.viterbi(texts[-2:], *sr.fit(lines))
    assert fitted[0][3] == sr.BODY and fitted[1][3] == sr.PAGE_NO
    first = sr.viterbi(texts[-2:], *sr.first_model())
    assert first[0][3] == first[1][3]


def test_any_sign_of_scanning_is_enough(spark):
    """One wrapped line in a long text, wrapped lines of a script without case, page markers only."""
    long = "\n\n".join(["A whole paragraph in a line of its own, with an end."] * 200) + "\n\nOne line that goes\non in the next one."
    han = "监事会在年度会议上讨论了准备金的假设并要求\n提供更多证据。"
    marked = "A page.\n\n<!-- page: 3 -->\n\nAnother page."
    none = "A whole paragraph.\n\nAnother one.\n\n12\n\nThe last."
    frame = spark.createDataFrame([("long", None, long), ("han", None, han), ("marked", None, marked), ("none", None, none)], "revision_id string, source_path string, markdown string")
    assert {r.revision_id for r in sr.scanned_lines(frame).collect()} == {"long", "han", "marked"}


def test_page_numbers():
    for line, want in (("- 8 -", 8), ("Page 1O of 90", 10), ("SEITE 7", 7), ("[33]", 33), ("xiv", 14), ("  12", 12), ("61.", 61), ("3 / 9", 3), ("lO", 10), ("xxxxiv", 44), ("IV", 4), ("c", 100)):
        assert sr.page_number(line)[0] == want, line
    for line in ("8,936", "naïve −43", "in 1990.", "recoveries.", "", "Item 5", "−6", "civic", "ill", "vivid", "lix lix"):
        assert sr.page_number(line) is None, line


def test_side_by_side_labels_are_the_best():
    """The labels have the score that a plain recursion finds."""
    rng = np.random.default_rng(15)
    move, emit = sr.first_model()
    texts = [rng.choice([0, 1, 2, 8, 9, 10, 16, 20, 37], n).tolist() for n in rng.integers(1, 30, 40)]
    start = np.where(np.isin(np.arange(5), (sr.BODY, sr.STRUCTURE)), 0.0, -3.0)
    for symbols, path in zip(texts, sr.viterbi(texts, move, emit)):
        score = start + emit[:, symbols[0]]
        for s in symbols[1:]:
            score = (score[:, None] + move).max(0) + emit[:, s]
        own = start[path[0]] + emit[path[0], symbols[0]] + sum(move[a, b] + emit[b, s] for a, b, s in zip(path, path[1:], symbols[1:]))
        assert abs(own - score.max()) < 1e-9


def test_corrections():
    for read, right in (("percerit", "percent"), ("assumpti0ns", "assumptions"), ("rnillion", "million"), ("Insutute", "Institute"), ("mi11ion", "million"), ("milhon", "million")):
        assert right in sr.corrections(read)
