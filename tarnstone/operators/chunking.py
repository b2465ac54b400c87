"""Chunks of Markdown: at headings, page markers and paragraphs, with the lines where they stand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnstone.functions import text as T

#: Most characters of a chunk.
BOUND = 4000


def numbered_lines(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, line_no (from 1), line."""
    return rows.select(*keys, F.posexplode(T.lines(F.col(text))).alias("at", "line")).select(*keys, (F.col("at") + 1).alias("line_no"), "line")


def heading_path(headings: Column) -> Column:
    """The titles that hold after headings (level, title), each at its level: a title drops what
    stands at its place and after."""
    return F.aggregate(headings, F.array().cast("array<string>"), lambda path, h: F.concat(F.slice(path, 1, h["level"] - 1), F.array(h["title"])))


def markdown_chunks(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, chunk_no, heading_path, start_line, end_line, text of each chunk of Markdown, not bounded.

    A chunk begins at a heading, at a page marker, at the first body line and at a body line after
    a blank one where the chunk has body. Blank lines at its end belong to no chunk. Null and empty
    texts have none. The windows are by text, so none is larger than one text."""
    order = Window.partitionBy(*keys).orderBy("line_no")
    line = F.col("line")
    kind = F.when(T.heading_level(line).isNotNull(), "h").when(T.is_page_marker(line), "m").when(T.is_blank(line), "b").otherwise("p")
    seen = numbered_lines(rows, keys, text).withColumn("kind", kind)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    seen = seen.withColumns({"previous": F.lag("kind").over(order), "solid": F.last(F.when(F.col("kind") != "b", F.col("kind")), True).over(before)})
    starts = F.col("kind").isin("h", "m") | ((F.col("kind") == "p") & (F.col("solid").isNull() | ((F.col("previous") == "b") & (F.col("solid") == "p"))))
    title = F.when(F.col("kind") == "h", F.struct(T.heading_level(line).alias("level"), T.heading_title(line).alias("title")))
    seen = seen.withColumns({"chunk_no": F.sum(F.when(starts, 1).otherwise(0)).over(order), "title": title})
    chunks = seen.where(F.col("chunk_no") > 0).groupBy(*keys, "chunk_no").agg(
        F.min("line_no").alias("start_line"),
        F.max(F.when(F.col("kind") != "b", F.col("line_no"))).alias("end_line"),
        F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("lines"),
        F.max("title").alias("title"),
    )
    path = heading_path(F.collect_list("title").over(Window.partitionBy(*keys).orderBy("chunk_no")))
    body = F.array_join(F.transform(F.slice("lines", F.lit(1), F.col("end_line") - F.col("start_line") + 1), lambda x: x["line"]), "\n")
    return chunks.select(*keys, "chunk_no", path.alias("heading_path"), "start_line", "end_line", body.alias("text"))


def bounded(lines: Column, first: Column, limit: int = BOUND) -> Column:
    """An array of (start_line, end_line, text) into which lines, the first with the number first,
    are packed: as many as fit in limit characters; a longer line is cut alone. Pieces of blanks
    only are left out."""
    piece = "struct<start:int,last:int,text:string>"
    state = F.struct(F.array().cast(f"array<{piece}>").alias("done"), F.lit(None).cast(piece).alias("open"))

    def step(s: Column, x: Column) -> Column:
        line, no = x["line"], x["no"]
        fits = s["open"].isNotNull() & (F.length(s["open"]["text"]) + 1 + F.length(line) <= limit)
        alone = F.struct(no.alias("start"), no.alias("last"), line.alias("text"))
        closed = F.when(s["open"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["open"])))
        cuts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(line) / limit).cast("int") - 1, F.lit(0))), lambda k: F.struct(no.alias("start"), no.alias("last"), F.substring(line, k * limit + 1, F.lit(limit)).alias("text")))
        joined = F.struct(s["open"]["start"].alias("start"), no.alias("last"), F.concat(s["open"]["text"], F.lit("\n"), line).alias("text"))
        return (
            F.when(F.length(line) > limit, F.struct(F.concat(closed, cuts).alias("done"), F.lit(None).cast(piece).alias("open")))
            .when(fits, F.struct(s["done"].alias("done"), joined.alias("open")))
            .otherwise(F.struct(closed.alias("done"), alone.alias("open")))
        )

    numbered = F.transform(lines, lambda x, i: F.struct(x.alias("line"), (first + i).cast("int").alias("no")))
    end = F.aggregate(numbered, state, step, lambda s: F.when(s["open"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))
    return F.filter(end, lambda x: ~T.is_blank(x["text"]))


def bounded_chunks(chunks: DataFrame, keys: list[str], limit: int = BOUND) -> DataFrame:
    """chunks with those over limit characters packed anew; the others come through untouched, so
    only large ones cost the fold."""
    small = chunks.where(F.length("text") <= limit).where(~T.is_blank(F.col("text")))
    pieces = chunks.where(F.length("text") > limit).select(*keys, "chunk_no", "heading_path", F.inline(bounded(F.split("text", "\n"), F.col("start_line"), limit)))
    large = pieces.select(*keys, "chunk_no", "heading_path", F.col("start").alias("start_line"), F.col("last").alias("end_line"), "text")
    return small.select(*large.columns).unionByName(large)
