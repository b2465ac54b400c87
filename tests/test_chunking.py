"""Chunks of Markdown against a sequential reading of the same rules."""

import random

from pyspark.sql import functions as F

from tarnstone.operators import chunking


def sequential(text):
    """(path, start, end) by a walk over the lines: what opens a chunk is decided line by line."""
    import re

    out, path, opened, last, body, gap = [], [], None, None, False, False

    def close():
        if opened is not None:
            out.append((list(opened[1]), opened[0], last))

    for no, line in enumerate(text.splitlines(), 1):
        m = re.match(r"^(#{1,6})\s+(\S.*?)\s*$", line)
        if m or re.match(r"(?i)^\s*<!--\s*page\s*:\s*[^>]+?\s*-->\s*$", line):
            close()
            if m:
                path = path[: len(m[1]) - 1] + [m[2].rstrip("#").strip()]
            opened, last, body, gap = (no, list(path)), no, False, False
        elif not line.strip():
            gap = True
        else:
            if opened is None or (gap and body):
                close()
                opened = (no, list(path))
            last, body, gap = no, True, False
    close()
    return out


def test_chunks_as_sequential(spark):
    random.seed(3)
    parts = ["# A", "### B ##", "## C", "text", "more", "", "  ", "<!-- page: 4 -->", "#no heading"]
    texts = ["\n".join(random.choices(parts, k=random.randint(0, 14))) for _ in range(150)] + [None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {}
    for r in chunking.markdown_chunks(rows, ["i"], "text").orderBy("i", "chunk_no").collect():
        got.setdefault(r.i, []).append((list(r.heading_path), r.start_line, r.end_line))
        lines = texts[r.i].splitlines()
        assert r.text == "\n".join(lines[r.start_line - 1 : r.end_line])
    for i, t in enumerate(texts):
        assert got.get(i, []) == (sequential(t) if t else []), t


def test_packing(spark):
    random.seed(4)
    limit = 20

    def pack(lines):
        out, held = [], None
        for no, line in enumerate(lines, 1):
            if len(line) > limit:
                if held:
                    out.append(held)
                held = None
                out += [(no, no, line[k : k + limit]) for k in range(0, len(line), limit)]
            elif held and len(held[2]) + 1 + len(line) <= limit:
                held = (held[0], no, held[2] + "\n" + line)
            else:
                if held:
                    out.append(held)
                held = (no, no, line)
        return [x for x in out + ([held] if held else []) if x[2].strip()]

    texts = ["\n".join("x" * random.randint(0, 30) for _ in range(random.randint(1, 8))) for _ in range(80)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for r in rows.select("i", chunking.bounded(F.split("text", "\n"), F.lit(1), limit).alias("p")).collect():
        assert [tuple(x) for x in r.p] == pack(texts[r.i].split("\n"))
