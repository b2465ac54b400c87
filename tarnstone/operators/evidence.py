"""Finding resources, and reading what a locator points to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnstone.functions import ids
from tarnstone.functions import text as T

MAX_LIMIT, MAX_BYTES, PREVIEW = 200, 1_000_000, 240


class LimitExceeded(ValueError):
    """A limit is beyond what a request may ask for."""


def check_limit(limit: int, most: int = MAX_LIMIT) -> int:
    if limit <= 0:
        raise ValueError("limit must be positive")
    if limit > most:
        raise LimitExceeded(f"limit {limit} is beyond {most}")
    return limit


def in_path_scope(path: Column, scope: str | None) -> Column:
    """Whether a path is the scope or lies under it; an empty scope holds everything."""
    clean = (scope or "").replace("\\", "/").strip("/").lower().replace("ß", "ss")
    if not clean:
        return F.lit(True)
    own = F.trim(F.replace(T.casefold(path), F.lit("\\"), F.lit("/")), F.lit("/"))
    return (own == clean) | own.startswith(clean + "/")


def in_asset_scope(asset: Column, name: Column, path: Column, scope: str | None) -> Column:
    """Whether scope is an asset's id, name or path; a blank scope holds everything."""
    clean = (scope or "").strip()
    if not clean:
        return F.lit(True)
    return (asset == clean) | (F.lower(name) == clean.lower()) | (F.lower(path) == clean.lower())


def name_matches(name: Column, pattern: str) -> Column:
    """Whether a name holds the pattern or matches it as a file pattern, whatever the case."""
    low = pattern.lower()
    return F.contains(F.lower(name), F.lit(low)) | F.lower(name).rlike(T.glob_pattern(low))


def literal_hits(rows: DataFrame, key: str, text: Column, needle: str, case_sensitive: bool = False) -> DataFrame:
    """(key, line_no, preview): the first line of each text that holds needle. A needle over several
    lines has no hits, and neither has an empty one."""
    wanted = needle if case_sensitive else needle.lower().replace("ß", "ss")
    fold = (lambda c: c) if case_sensitive else T.casefold
    lines = T.lines(text)
    at = F.array_position(F.transform(lines, lambda x: F.contains(fold(x), F.lit(wanted))), F.lit(True)).cast("int")
    found = rows.where(F.contains(fold(text), F.lit(wanted)) & F.lit(bool(needle))).select(key, at.alias("line_no"), lines.alias("lines"))
    return found.where(F.col("line_no") > 0).select(key, "line_no", F.left(F.element_at("lines", F.col("line_no")), F.lit(PREVIEW)).alias("preview"))


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """Rows offset to offset + limit of an order, as a top-k of offset + limit rows."""
    check_limit(limit)
    return rows.orderBy(*order).limit(offset + limit).offset(offset)


def read_chunks(locators: DataFrame, assets: DataFrame, chunks: DataFrame, max_bytes: int) -> DataFrame:
    """locators (asset_id, revision_id, chunk_id, start_line, end_line) with status, content,
    content_hash, truncated and source_revision.

    status: OK, NOT_FOUND (no such asset, or no such chunk in its current revision),
    STALE_LOCATOR (another revision is current), INVALID_LOCATOR (the lines aren't the chunk's).
    content is cut to max_bytes of UTF-8 without cutting a character."""
    check_limit(max_bytes, MAX_BYTES)
    current = assets.select("asset_id", F.col("current_revision_id"))
    stored = chunks.select("asset_id", "revision_id", "chunk_id", F.col("start_line").alias("first"), F.col("end_line").alias("last"), "text")
    met = locators.join(current, "asset_id", "left").join(stored, ["asset_id", "revision_id", "chunk_id"], "left")
    status = (
        F.when(F.col("current_revision_id").isNull(), "NOT_FOUND")
        .when(F.col("current_revision_id") != F.col("revision_id"), "STALE_LOCATOR")
        .when(F.col("first").isNull(), "NOT_FOUND")
        .when((F.col("first") != F.col("start_line")) | (F.col("last") != F.col("end_line")), "INVALID_LOCATOR")
        .otherwise("OK")
    )
    text = F.when(F.col("status") == "OK", F.coalesce("text", F.lit("")))
    out = met.withColumn("status", status).withColumn("content", T.first_bytes(text, max_bytes))
    return out.select(
        *locators.columns,
        "status",
        "content",
        ids.content_hash(F.col("content")).alias("content_hash"),
        (F.octet_length(text) > max_bytes).alias("truncated"),
        F.col("current_revision_id").alias("source_revision"),
    )


def line_range(text: Column, start: Column, end: Column) -> Column:
    """Lines start to end of a text; null if they aren't lines of it."""
    lines = T.lines(text)
    return F.when((start >= 1) & (end >= start) & (end <= F.size(lines)), F.array_join(F.slice(lines, start, end - start + 1), "\n"))


def section(text: Column, heading: Column) -> Column:
    """The section under the first heading of that title, whatever the case, up to the next heading
    of the same or a higher level; null if there is none."""
    lines = T.lines(text)
    heads = F.filter(F.transform(lines, lambda x, i: F.struct((i + 1).alias("line"), T.heading_level(x).alias("level"), T.casefold(T.heading_title(x)).alias("title"))), lambda h: h["level"].isNotNull())
    own = F.get(F.filter(heads, lambda h: h["title"] == T.casefold(F.trim(heading))), 0)
    after = F.get(F.filter(heads, lambda h: (h["line"] > own["line"]) & (h["level"] <= own["level"])), 0)
    end = F.coalesce(after["line"] - 1, F.size(lines))
    return F.when(own.isNotNull(), F.array_join(F.slice(lines, own["line"], end - own["line"] + 1), "\n"))


def snapshot_ids(hits: DataFrame, query: str, rank: str, resource: str, revision: str) -> DataFrame:
    """(query, snapshot_id, n_hits): a digest of the whole result list of each query, in order."""
    entry = F.concat_ws("\u0001", resource, revision)
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("rank"), entry.alias("entry")))), lambda x: x["entry"])
    return hits.groupBy(query).agg(F.sha2(F.concat_ws("\u0002", F.col(query), F.array_join(listed, "\u0002")), 256).alias("snapshot_id"), F.count("*").alias("n_hits"))


def first_appearance(hits: DataFrame, query: str, name: str, rank: str) -> DataFrame:
    """(query, name, source_rank, chunk_rank): the order in which sources first appear among the hits."""
    first = hits.groupBy(query, F.lower(name).alias(name)).agg(F.min(rank).alias("chunk_rank"))
    return first.withColumn("source_rank", F.row_number().over(Window.partitionBy(query).orderBy("chunk_rank", name)))


def resume(cursors: DataFrame, listed: DataFrame, query: str) -> DataFrame:
    """cursors (query, cursor, ...) with status and page_offset: OK and where the next page begins, or
    CURSOR_INVALID and null where the cursor can't be read, is of another list or query, or lies
    outside. listed: query, query_key, snapshot_id, n_hits."""
    met = cursors.join(listed.select(query, "query_key", "snapshot_id", "n_hits"), query, "left").withColumn("at", ids.parse_cursor(F.col("cursor")))
    good = (F.col("at.snapshot_id") == F.col("snapshot_id")) & (F.col("at.query_key") == F.col("query_key")) & F.col("at.offset").between(0, F.col("n_hits"))
    good = F.coalesce(good, F.lit(False))
    return met.select(*cursors.columns, F.when(good, "OK").otherwise("CURSOR_INVALID").alias("status"), F.when(good, F.col("at.offset")).alias("page_offset"))


def resolve_shorthand(asked: DataFrame, key: str, assets: DataFrame) -> DataFrame:
    """asked (key, shorthand), each a document's name or name:line, with asset_id, revision_id and
    line: the asset of that name, else the first by name whose name holds it; null if there is none.

    assets: asset_id, source_name, current_revision_id. Names are compared whatever the letters'
    case; what no name equals meets the assets in at most 64 arrays."""
    from pyspark.sql import Window

    from tarnstone.runtime import broadcast_if_small, materialize

    parts = asked.select(*asked.columns, F.regexp_extract("shorthand", r"(?s)^(.+?)(?::0*(\d+))?$", 1).alias("name"), F.expr("nullif(regexp_extract(shorthand, '(?s)^(.+?)(?::0*([0-9]+))?$', 2), '')").cast("int").alias("line"))
    parts = materialize(parts.withColumn("name", T.casefold("name")), "shorthands")
    named = assets.select("asset_id", F.col("current_revision_id").alias("revision_id"), T.casefold("source_name").alias("own"), F.lower("source_name").alias("order"))
    one = Window.partitionBy("name").orderBy("order", "asset_id")
    wanted = parts.where("name <> ''").select("name").distinct()
    exact = named.join(broadcast_if_small(wanted), F.col("own") == F.col("name"))
    exact = materialize(exact.withColumn("place", F.row_number().over(one)).where("place = 1").select("name", "asset_id", "revision_id"), "names")
    rest = wanted.join(exact, "name", "left_anti").groupBy(F.pmod(F.xxhash64("name"), F.lit(64))).agg(F.collect_list("name").alias("names")).select("names")
    held = named.crossJoin(broadcast_if_small(rest)).select("asset_id", "revision_id", "order", F.explode(F.filter("names", lambda n: F.contains(F.col("own"), n))).alias("name"))
    held = held.withColumn("place", F.row_number().over(one)).where("place = 1").select("name", "asset_id", "revision_id")
    return parts.join(broadcast_if_small(exact.unionByName(held)), "name", "left").select(*asked.columns, "asset_id", "revision_id", "line")
