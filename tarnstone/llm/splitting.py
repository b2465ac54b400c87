"""Splitting of oversized texts at natural boundaries by agglomerative merging."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECES = "item_kind string, item_id string, piece_no int, n_pieces int, start_char int, end_char int, overlap int, cut_at string, heading_path array<string>, text string"

#: What a cut may follow, the strongest last; the strength of a cut is the place in this list.
CUTS = ["character", "word", "sentence", "line", "paragraph", "page", "heading"]

_SENTENCE = re.compile(r"[.!?…]+[\"'”’»)\]]*\s+|[。！？]+[”’」』]*\s*")
_WORD = re.compile(r"\s+")
_HEADING = re.compile(r"^(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$")
_PAGE = re.compile(r"^\s*<!--\s*page\b", re.I)


def _line_cuts(text: str) -> list[tuple[int, int]]:
    """(position, strength) of each start of a line but the first. What follows a heading is tied to
    it like a word, so that no heading ends a piece where its text fits."""
    cuts, at, blank, headed = [], 0, False, False
    for line in text.split("\n"):
        solid = bool(line.strip())
        heading = solid and bool(_HEADING.match(line))
        if at:
            if headed and not heading:
                strength = 1
            elif heading:
                strength = 6
            elif solid and _PAGE.match(line):
                strength = 5
            else:
                strength = 4 if solid and blank else 3
            cuts.append((at, strength))
        headed = heading or (headed and not solid)
        blank = not solid
        at += len(line) + 1
    return [c for c in cuts if c[0] < len(text)]


def _finer(text: str, start: int, end: int, room: int) -> list[tuple[int, int]]:
    """Cuts inside text[start:end], which is longer than room: at sentences, else words, else characters."""
    for strength, pattern in ((2, _SENTENCE), (1, _WORD)):
        inner = [(m.end(), strength) for m in pattern.finditer(text, start, end) if start < m.end() < end]
        if inner:
            edges = [start, *(p for p, _ in inner), end]
            deeper = [c for a, b in zip(edges, edges[1:]) if b - a > room for c in (_finer(text, a, b, room) if strength > 1 else _hard(a, b, room))]
            return sorted(inner + deeper)
    return _hard(start, end, room)


def _hard(start: int, end: int, room: int) -> list[tuple[int, int]]:
    return [(p, 0) for p in range(start + room, end, room)]


def split_spans(text: str, capacity: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, strength of the cut at start) of consecutive pieces that cover text.

    Atomic segments (lines, and sentences, words or runs of characters of longer ones) stand in a
    row; a heap holds the neighbours by the strength of the boundary between them, then by their
    joint size. The weakest boundary goes first, as long as the joint size and the overlap fit."""
    room = capacity - overlap
    if room <= 0:
        raise ValueError("overlap must be smaller than capacity")
    if len(text) <= capacity:
        return [(0, len(text), len(CUTS) - 1)]
    cuts = _line_cuts(text)
    edges = [0, *(p for p, _ in cuts), len(text)]
    for a, b in zip(edges, edges[1:]):
        if b - a > room // 2:  # sentences of a long line can join either neighbour
            cuts += _finer(text, a, b, room)
    cuts.sort()
    starts, strength = [0], [len(CUTS)]
    for p, s in cuts:
        if p != starts[-1]:
            starts.append(p)
            strength.append(s)
    n = len(starts)
    ends, left, right = starts[1:] + [len(text)], list(range(-1, n - 1)), [*range(1, n), -1]
    alive = [True] * n
    heap = [(strength[i], ends[i] - starts[i - 1], i) for i in range(1, n)]
    heapq.heapify(heap)
    while heap:
        _, size, i = heapq.heappop(heap)
        j = left[i]
        if not alive[i] or size != ends[i] - starts[j] or size > room:  # a side has grown since: a newer entry stands for it
            continue
        ends[j], right[j], alive[i] = ends[i], right[i], False
        if (k := right[i]) >= 0:
            left[k] = j
            heapq.heappush(heap, (strength[k], ends[k] - starts[j], k))
        if (h := left[j]) >= 0:
            heapq.heappush(heap, (strength[j], ends[j] - starts[h], j))
    return [(starts[i], ends[i], min(strength[i], len(CUTS) - 1)) for i in range(n) if alive[i]]


def _headings(text: str) -> list[tuple[int, list[str]]]:
    """(position, path that holds from there on) of each heading."""
    out, stack, at = [], [], 0
    for line in text.split("\n"):
        if line.startswith("#") and (m := _HEADING.match(line)):
            stack = [*stack[: len(m[1]) - 1], m[2]]
            out.append((at, stack))
        at += len(line) + 1
    return out


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for kind, item, path, text, capacity, overlap in zip(batch.item_kind, batch.item_id, batch.heading_path, batch.text, batch.capacity, batch.overlap_size):
            overlap = min(overlap, capacity - 1)
            spans = split_spans(text, capacity, overlap)
            base = [] if path is None else list(path)
            heads, h = ([] if base else _headings(text)), 0
            for no, (start, end, strength) in enumerate(spans, 1):
                while h < len(heads) and heads[h][0] <= start:
                    base, h = heads[h][1], h + 1
                repeated = min(overlap, start)
                rows.append((kind, item, no, len(spans), start, end, repeated, "start" if no == 1 else CUTS[strength], base, text[start - repeated : end]))
        yield pd.DataFrame(rows, columns=["item_kind", "item_id", "piece_no", "n_pieces", "start_char", "end_char", "overlap", "cut_at", "heading_path", "text"])


def items(chunks: DataFrame, revisions: DataFrame) -> DataFrame:
    """(item_kind, item_id, heading_path, text) of chunk texts and revision markdown."""
    chunk = chunks.select(F.lit("chunk").alias("item_kind"), F.col("chunk_id").alias("item_id"), "heading_path", "text")
    empty = F.lit(None).cast("array<string>").alias("heading_path")
    return chunk.unionByName(revisions.select(F.lit("revision").alias("item_kind"), F.col("revision_id").alias("item_id"), empty, F.col("markdown").alias("text")))


def split_oversized(rows: DataFrame, profiles: DataFrame, profile_of_kind: dict[str, str]) -> DataFrame:
    """Ordered pieces of the items that are larger than their profile's capacity.

    rows: item_kind, item_id, heading_path, text. profiles: size_profiles; profile_of_kind names a
    profile_id for each item_kind, and sizes are Unicode code points. Result, one row a piece:
    item_kind, item_id, piece_no (from 1), n_pieces, start_char and end_char (the part of the text
    that is new in this piece), overlap (characters repeated before it: overlap_size, fewer only
    where less text stands before), cut_at, heading_path, text (at most capacity characters). The
    parts from start_char to end_char put together give the text.

    Null texts and ids and texts within capacity give no pieces, repeated deliveries of an item
    count once, an empty table gives no pieces. heading_path is the item's; where that is null or
    empty it is read from the headings in the text. A text without any boundary is cut at
    characters."""
    chosen = profiles.where((F.col("size_unit") == "chars") & (F.col("purpose") == "split")).select("profile_id", "item_kind", "capacity", F.coalesce("overlap_size", F.lit(0)).alias("overlap_size"))
    chosen = chosen.where(F.array_contains(F.array(*map(F.lit, profile_of_kind.values())), F.col("profile_id"))).drop("profile_id").dropDuplicates(["item_kind"])
    limits = {r.item_kind: r for r in chosen.collect()}  # one row for each item kind

    def limit(field: str) -> Column:
        value = F.lit(None).cast("int")
        for kind, r in limits.items():
            value = F.when(F.col("item_kind") == kind, F.lit(r[field])).otherwise(value)
        return value

    oversized = (
        rows.where(F.col("item_id").isNotNull() & (F.length("text") > limit("capacity")))
        .dropDuplicates(["item_kind", "item_id"])
        .select("item_kind", "item_id", F.when(F.size("heading_path") > 0, F.filter("heading_path", lambda h: h.isNotNull() & (F.trim(h) != ""))).alias("heading_path"), "text", limit("capacity").alias("capacity"), limit("overlap_size").alias("overlap_size"))
    )
    return oversized.mapInPandas(_pieces, PIECES)


def found(pieces: DataFrame) -> DataFrame:
    """(item_kind, item_id) of the items that came out in more than one piece."""
    return pieces.where(F.col("piece_no") == 2).select("item_kind", "item_id")
