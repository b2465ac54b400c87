"""Identities of assets, revisions, chunks, evidence and result lists, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnstone.functions.text import casefold

LOCATOR_VERSION = 1


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def asset_id(path: Column) -> Column:
    """An asset is known by its path: slashes only, folded case."""
    return F.concat(F.lit("src-"), F.sha2(casefold(F.replace(path, F.lit("\\"), F.lit("/"))), 256))


def chunk_id(asset: Column, revision: Column, start: Column, end: Column, text: Column) -> Column:
    parts = [asset, revision, start.cast("string"), end.cast("string"), text]
    return F.concat(F.lit("chunk-"), F.sha2(F.concat_ws("\u0000", *parts), 256))


def json_string(text: Column) -> Column:
    """text as a JSON string, other letters than ASCII as they are; null stays null."""
    return F.when(text.isNotNull(), F.regexp_extract(F.to_json(F.struct(text.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1))


def revision_id(asset: Column, source_hash: Column, path: Column, name: Column, parser: Column, version: Column, markdown: Column, content_list: Column, metadata: Column) -> Column:
    """The digest of all that makes a revision, as a JSON list; artifacts come as an empty list."""
    parts = [asset, source_hash, path, name, parser, version, F.sha2(markdown, 256), F.sha2(content_list, 256), F.sha2(metadata, 256)]
    quoted = [F.coalesce(json_string(p), F.lit("null")) for p in parts]
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", *quoted), F.lit(",[]]")), 256)


def locator(provider: str, resource: Column, revision: Column, chunk: Column, start: Column, end: Column) -> Column:
    """A locator of a chunk as canonical JSON: keys in order, no blanks."""
    selector = F.struct(end.alias("end"), chunk.alias("id"), start.alias("start"), F.lit("chunk").alias("type"))
    return F.to_json(F.struct(F.lit(provider).alias("provider"), resource.alias("resource_id"), revision.alias("revision"), selector.alias("selector"), F.lit(LOCATOR_VERSION).alias("version")))


def evidence_id(locator_json: Column, digest: Column) -> Column:
    return F.concat(F.lit("ev-"), F.left(F.sha2(F.concat(locator_json, F.lit("\n"), digest), 256), F.lit(16)))


def cursor(snapshot: Column, query_key: Column, offset: Column) -> Column:
    """An opaque place in a result list: URL-safe base64 of JSON, without padding."""
    body = F.to_json(F.struct(offset.cast("int").alias("offset"), query_key.alias("query_key"), snapshot.alias("snapshot_id")))
    return F.translate(F.rtrim(F.base64(F.encode(body, "UTF-8")), F.lit("=")), "+/\r\n", "-_")  # base64 breaks lines


def query_key(kind: str, scope: Column | str | None = None, pattern: Column | str | None = None) -> Column:
    """What a list of results answers: list:scope, find:scope:pattern, search:scope:query or
    literal:scope:query; patterns in lower case."""
    parts = [F.lit(kind), F.coalesce(_text(scope), F.lit(""))]
    if pattern is not None:
        parts.append(F.lower(_text(pattern)) if kind == "find" else _text(pattern))
    return F.concat_ws(":", *parts)


def _text(value: Column | str | None) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def parse_cursor(cursor_: Column) -> Column:
    """(offset, query_key, snapshot_id) of a cursor; null if it is none."""
    base = F.translate(cursor_, "-_", "+/")
    padded = F.rpad(base, ((F.length(base) + 3) / 4).cast("int") * 4, F.lit("="))
    body = F.try_validate_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string"))
    parsed = F.from_json(body, "offset int, query_key string, snapshot_id string")
    return F.when(parsed["offset"].isNotNull() & parsed["query_key"].isNotNull() & parsed["snapshot_id"].isNotNull(), parsed)


def parse_locator(locator_json: Column) -> Column:
    """(provider, resource_id, revision, selector) of a locator; null if it isn't JSON, is of
    another version or lacks a part. selector (type, id, start, end, value) may be null."""
    parsed = F.from_json(locator_json, "version int, provider string, resource_id string, revision string, selector struct<type:string,id:string,start:int,end:int,value:string>")
    whole = (parsed["version"] == LOCATOR_VERSION) & (parsed["provider"] != "") & (parsed["resource_id"] != "") & (parsed["revision"] != "")
    return F.when(F.coalesce(whole, F.lit(False)), F.struct(*(parsed[c].alias(c) for c in ("provider", "resource_id", "revision", "selector"))))
