"""Folders of files as tables: bytes to revisions, with an error column in place of exceptions."""

from __future__ import annotations

import io
import re
import zipfile
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnstone.functions import ids
from tarnstone.functions import text as T

# Which endings are read how, and the tag of each reader.
TEXT = [".txt", ".md", ".markdown", ".rst", ".csv", ".json", ".xml"]
READERS = {".html": "html-text-v1", ".htm": "html-text-v1", ".docx": "docx-xml-v1", ".pptx": "pptx-xml-v1", ".pdf": "pypdf-v1"} | dict.fromkeys(TEXT, "utf8-v1")


def scan_folder(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, suffix, modificationTime, length, content) of all files under folder, those in
    or under names that begin with a dot left out. Empty files have an empty content: no task reads
    them, so they come from the list of files that Spark makes for the read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    listed = spark.createDataFrame([(re.sub("^file:/+", "file:/", unquote(p)),) for p in files.inputFiles()], "path string")
    empty = listed.join(files.select("path"), "path", "left_anti")
    at = F.lit(None).cast(dict(files.dtypes)["modificationTime"])
    files = files.unionByName(empty.select("path", at.alias("modificationTime"), F.lit(0).cast("bigint").alias("length"), F.lit(b"").alias("content")))
    root = folder.rstrip("/")
    inner = F.regexp_replace("path", "^file:", "")
    inside = F.substring(inner, F.lit(len(root) + 1), F.length(inner))
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(~inside.rlike(r"/\.")).withColumns({"name": name, "suffix": F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))})


class _Texts(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.found: list[str] = []

    def handle_data(self, data: str) -> None:
        if words := data.split():
            self.found.append(" ".join(words))


def html_text(markup: str) -> str:
    """Each piece of text of a page in a line of its own, scripts and styles too, comments not."""
    page = _Texts()
    page.feed(markup)
    return "\n".join(page.found)


def _xml_texts(data: bytes) -> list[str]:
    return [s for s in (x.strip() for x in ElementTree.fromstring(data).itertext()) if s]


def document_text(suffix: str, content: bytes) -> str:
    """The text of a page, an office document or a PDF. Raises ValueError where there is none."""
    if suffix in (".html", ".htm"):
        return html_text(content.decode("utf-8", "replace"))
    if suffix == ".pdf":
        try:
            from pypdf import PdfReader
        except ImportError:
            raise ValueError("reading PDF needs pypdf") from None
        pages = [p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages]
        return "\n\n".join(f"<!-- page:{no} -->\n{text}" for no, text in enumerate(pages, 1))
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile:
        raise ValueError("no valid office document") from None
    with archive:
        if suffix == ".docx":
            texts = _xml_texts(archive.read("word/document.xml")) if "word/document.xml" in archive.namelist() else []
            if not texts:
                raise ValueError("no text in the document")
            return "\n".join(texts)
        slides = {int(m[1]): n for n in archive.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n))}
        return "\n\n".join(" ".join(_xml_texts(archive.read(slides[k]))) for k in sorted(slides))


def _documents(suffix: pd.Series, content: pd.Series) -> pd.DataFrame:
    rows = []
    for s, c in zip(suffix, content):
        try:
            rows.append((document_text(s, c), None))
        except Exception as e:  # a file that can't be read is a row with an error
            rows.append((None, f"{type(e).__name__}: {e}"))
    return pd.DataFrame(rows, columns=["text", "error"])


def extract(files: DataFrame) -> DataFrame:
    """Revisions from files (path, name, suffix, content): asset_id, revision_id, source_path,
    source_name, source_hash, parser_name, parser_version, markdown, content_list_json,
    metadata_json, error.

    Texts are decoded in the JVM, bytes that are no UTF-8 replaced; pages, office documents and PDF
    go through Arrow. A file of another kind, or one that can't be read, has an error and nulls."""
    plain = F.col("suffix").isin(TEXT)
    known = F.col("suffix").isin(list(READERS))
    read = F.pandas_udf(_documents, "struct<text:string,error:string>")
    parsed = files.withColumn("parsed", F.when(known & ~plain, read("suffix", F.when(known & ~plain, F.col("content")).otherwise(F.lit(b"")))))
    text = F.when(plain, F.make_valid_utf8(F.col("content").cast("string"))).otherwise(F.col("parsed.text"))
    error = F.when(~known, F.concat(F.lit("UNSUPPORTED: "), F.col("suffix"))).otherwise(F.col("parsed.error"))
    version = F.lit(None).cast("string")
    for suffix, tag in READERS.items():
        version = F.when(F.col("suffix") == suffix, tag).otherwise(version)
    path = F.regexp_replace("path", "^file:/*", "/")
    rows = parsed.select(path.alias("source_path"), F.col("name").alias("source_name"), F.sha2("content", 256).alias("source_hash"), F.lit("local").alias("parser_name"), version.alias("parser_version"), F.when(text.endswith("\n"), text).otherwise(F.concat(text, F.lit("\n"))).alias("markdown"), error.alias("error"))
    rows = rows.withColumns({"asset_id": ids.asset_id(F.col("source_path")), "content_list_json": F.to_json(content_list(F.col("markdown"))), "metadata_json": F.lit("{}")})
    c = {x: F.col(x) for x in rows.columns}
    digest = ids.revision_id(c["asset_id"], c["source_hash"], c["source_path"], c["source_name"], c["parser_name"], c["parser_version"], c["markdown"], c["content_list_json"], c["metadata_json"])
    return rows.withColumn("revision_id", F.when(F.col("markdown").isNotNull(), digest))


def content_list(markdown: Column) -> Column:
    """The headings of a text: type, level, text, line."""
    lines = F.transform(T.lines(markdown), lambda x, i: F.struct(F.lit("heading").alias("type"), T.heading_level(x).alias("level"), F.trim(F.regexp_extract(x, r"^#{1,6}\s+(.+)$", 1)).alias("text"), (i + 1).alias("line")))
    return F.filter(lines, lambda h: h["level"].isNotNull())


CASE_SCHEMA = (
    "case_id string, question string, expected_sources array<string>, required_phrases array<string>, required_evidence_phrases array<string>, answerable boolean, must_cite boolean, "
    "retrieval_query string, query_style string, query_anchor_groups array<array<string>>, retrieval_max_expected_rank int, required_claims array<struct<answer_phrases:array<string>,evidence_phrases:array<string>>>"
)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Gold cases from JSON lines; blank lines and lines that begin with # are skipped, a line that
    is no such object fails the query."""
    rows = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)"))
    return rows.select(F.from_json("value", CASE_SCHEMA, {"mode": "FAILFAST"}).alias("c")).select("c.*")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of sources from JSON lines."""
    schema = "source_id string, title string, authority string, practice_area string, status string, effective_date string, landing_url string, download_url string, format string, notes string"
    return spark.read.schema(schema).json(path)
