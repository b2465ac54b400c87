"""Splitting: cover, size, overlap and natural cuts, against the definition."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tarnstone.llm import splitting


def check(text, capacity, overlap):
    spans = splitting.split_spans(text, capacity, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert all(end - start + min(overlap, start) <= capacity for start, end, _ in spans)
    return spans


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n#é中", max_size=300), st.integers(10, 60), st.integers(0, 9))
def test_pieces_cover_the_text(text, capacity, overlap):
    check(text, capacity, overlap)


def test_cuts_are_natural():
    paragraph = " ".join(f"Sentence number {i} stands here." for i in range(6))
    text = "# A\n" + paragraph + "\n\n## B\n" + paragraph + "\n\n" + paragraph + "\n"
    spans = check(text, 300, 20)
    assert all(s >= 2 for _, _, s in spans) and not any(text[a:b].rstrip().split("\n")[-1].startswith("#") for a, b, _ in spans)
    assert any(text[a:].startswith("## B") for a, _, _ in spans)
    long = "word " * 200
    assert all(s == 1 for _, _, s in check(long, 120, 10)[1:])
    assert all(s == 0 for _, _, s in check("x" * 500, 120, 10)[1:])


def test_weakest_boundaries_go_first():
    """A brute force that always joins the weakest pair that fits gives the same cuts."""
    random.seed(8)
    for _ in range(60):
        text = "".join(random.choice(("ab cd. ", "efg\n", "hi\n\n", "# x\n", "jklmnop ")) for _ in range(40))
        capacity, overlap = 60, 5
        room = capacity - overlap
        cuts = splitting._line_cuts(text)
        edges = [0, *(p for p, _ in cuts), len(text)]
        for a, b in zip(edges, edges[1:]):
            if b - a > room // 2:
                cuts += splitting._finer(text, a, b, room)
        pieces = [[0, 9]]
        for p, s in sorted(cuts):
            if p != pieces[-1][0]:
                pieces.append([p, s])
        ends = [p for p, _ in pieces[1:]] + [len(text)]
        while True:
            fits = [(pieces[i][1], ends[i] - pieces[i - 1][0], pieces[i][0]) for i in range(1, len(pieces)) if ends[i] - pieces[i - 1][0] <= room]
            if not fits:
                break
            i = next(i for i in range(1, len(pieces)) if pieces[i][0] == min(fits)[2])
            ends[i - 1] = ends[i]
            del pieces[i], ends[i]
        assert [p for p, _ in pieces] == [a for a, _, _ in splitting.split_spans(text, capacity, overlap)]


def test_rows(spark):
    profiles = spark.createDataFrame([("p", "split", "chunk", "chars", 50, 8, None)], "profile_id string, purpose string, item_kind string, size_unit string, capacity int, overlap_size int, tokenizer string")
    text = "# H\n" + "A sentence of words. " * 10
    rows = [("chunk", "c1", ["T", ""], text), ("chunk", "c1", ["T", ""], text), ("chunk", "c2", None, text), ("chunk", "c3", None, None), ("chunk", None, None, text), ("chunk", "c4", [], ""), ("other", "o", None, text)]
    frame = spark.createDataFrame(rows, "item_kind string, item_id string, heading_path array<string>, text string")
    got = splitting.split_oversized(frame, profiles, {"chunk": "p"}).orderBy("item_id", "piece_no").collect()
    assert {r.item_id for r in got} == {"c1", "c2"}
    for item in ("c1", "c2"):
        own = [r for r in got if r.item_id == item]
        assert [r.piece_no for r in own] == list(range(1, own[0].n_pieces + 1))
        assert "".join(r.text[r.overlap :] for r in own) == text and all(len(r.text) <= 50 for r in own)
        assert all(b.text[: b.overlap] == a.text[-b.overlap :] and b.overlap == min(8, b.start_char) for a, b in zip(own, own[1:]))
        assert own[-1].heading_path == (["T"] if item == "c1" else ["H"])
    assert {r.item_id for r in splitting.found(splitting.split_oversized(frame, profiles, {"chunk": "p"})).collect()} == {"c1", "c2"}
    assert splitting.split_oversized(frame.limit(0), profiles, {"chunk": "p"}).count() == 0
