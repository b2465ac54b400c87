"""Queries over the store: what is current, what was, what is lacking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnstone.functions import ids
from tarnstone.functions import text as T
from tarnstone.operators import evidence, store
from tarnstone.plans import fragments as S
from tarnstone.plans.registry import query
from tarnstone.runtime import table


@query(f"""WITH {S.CURRENT}
SELECT a.asset_id, a.source_name, a.source_path, r.revision_id, r.parser_name, r.parser_version, CAST(strlen(r.markdown) AS BIGINT) AS n_bytes
FROM current_asset a JOIN current_revision r USING (asset_id)""")
def asset_catalog(spark: SparkSession, d: str) -> DataFrame:
    assets = store.current_assets(table(spark, d, "assets")).select("asset_id", "source_name", "source_path")
    current = store.current_revisions(table(spark, d, "assets"), table(spark, d, "asset_revisions").select("asset_id", "revision_id", "parser_name", "parser_version", "markdown", "created_at"))
    size = F.octet_length("markdown").cast("bigint").alias("n_bytes")
    return assets.join(current.select("asset_id", "revision_id", "parser_name", "parser_version", size), "asset_id")


@query(f"""WITH {S.REVISIONS}
SELECT asset_id, revision_id, created_at, CAST(row_number() OVER (PARTITION BY asset_id ORDER BY created_at DESC NULLS LAST, revision_id) AS INTEGER) AS place FROM revision""")
def revision_history(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    rows = store.revisions_once(table(spark, d, "asset_revisions").select("asset_id", "revision_id", "created_at"))
    order = Window.partitionBy("asset_id").orderBy(F.desc_nulls_last("created_at"), "revision_id")
    return rows.withColumn("place", F.row_number().over(order))


@query(f"WITH {S.ASSETS} SELECT asset_id, current_revision_id AS revision_id FROM current_asset WHERE current_revision_id IS NOT NULL")
def current_revision_pointer(spark: SparkSession, d: str) -> DataFrame:
    return store.pointers(table(spark, d, "assets"))


@query(f"""WITH {S.ASSETS}
SELECT a.asset_id, a.current_revision_id AS revision_id FROM current_asset a
WHERE a.current_revision_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM asset_revisions r WHERE r.asset_id = a.asset_id AND r.revision_id = a.current_revision_id)""")
def dangling_pointers(spark: SparkSession, d: str) -> DataFrame:
    return store.pointers(table(spark, d, "assets")).join(table(spark, d, "asset_revisions").select("asset_id", "revision_id"), ["asset_id", "revision_id"], "left_anti")


@query(f"""WITH {S.CURRENT}
SELECT asset_id, revision_id FROM current_revision r WHERE NOT EXISTS (SELECT 1 FROM knowledge_chunks k WHERE k.asset_id = r.asset_id AND k.revision_id = r.revision_id)""")
def revisions_missing_chunks(spark: SparkSession, d: str) -> DataFrame:
    return store.without_chunks(table(spark, d, "assets"), table(spark, d, "asset_revisions"), table(spark, d, "knowledge_chunks"))


@query(f"""WITH {S.REVISIONS}
SELECT asset_id, source_hash, count(DISTINCT revision_id) AS n_revisions, count(DISTINCT coalesce(parser_version, '')) AS n_parsers
FROM revision GROUP BY asset_id, source_hash HAVING count(DISTINCT revision_id) > 1""")
def reparsed_sources(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "asset_revisions").where(F.col("asset_id").isNotNull() & F.col("revision_id").isNotNull())
    counted = rows.groupBy("asset_id", "source_hash").agg(F.countDistinct("revision_id").alias("n_revisions"), F.countDistinct(F.coalesce("parser_version", F.lit(""))).alias("n_parsers"))
    return counted.where(F.col("n_revisions") > 1)


@query("""WITH put AS (SELECT asset_id, revision_id, created_at FROM asset_revisions WHERE created_at >= TIMESTAMP '2024-07-01'),
old AS (SELECT asset_id, revision_id, created_at FROM asset_revisions WHERE created_at < TIMESTAMP '2024-07-01' OR created_at IS NULL),
last_put AS (SELECT asset_id, max((created_at, revision_id)) AS m FROM put GROUP BY asset_id),
last_old AS (SELECT asset_id, max((created_at, revision_id)) AS m FROM old WHERE asset_id NOT IN (SELECT asset_id FROM put) GROUP BY asset_id)
SELECT asset_id, m[2] AS revision_id, m[1] AS updated_at FROM (SELECT * FROM last_put UNION ALL SELECT * FROM last_old)""")
def pointer_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "asset_revisions").select("asset_id", "revision_id", F.col("created_at").alias("updated_at"))
    late = F.coalesce(F.col("updated_at") >= F.lit("2024-07-01").cast("timestamp_ntz"), F.lit(False))

    def last(x: DataFrame) -> DataFrame:
        return store.latest(x, ["asset_id"], [F.col("updated_at"), F.col("revision_id")])

    return store.upsert(last(rows.where(~late)), last(rows.where(late)), ["asset_id"])


@query("""SELECT asset_id, revision_id, count(*) AS n_rows FROM asset_revisions WHERE asset_id IS NOT NULL AND revision_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1""")
def repeated_deliveries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "asset_revisions").where(F.col("asset_id").isNotNull() & F.col("revision_id").isNotNull()).groupBy("asset_id", "revision_id").agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > 1)


@query(f"""WITH {S.REVISIONS}
SELECT revision_id, sha256(markdown) AS markdown_hash, 'src-' || sha256({S.fold("replace(source_path, chr(92), '/')")}) AS path_id, strlen(markdown) AS n_bytes FROM revision""")
def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    rows = store.revisions_once(table(spark, d, "asset_revisions").select("asset_id", "revision_id", "markdown", "source_path", "created_at"))
    return rows.select("revision_id", ids.content_hash(F.col("markdown")).alias("markdown_hash"), ids.asset_id(F.col("source_path")).alias("path_id"), F.octet_length("markdown").cast("bigint").alias("n_bytes"))


@query(f"""WITH {S.REVISIONS}, quoted AS (SELECT asset_id, revision_id, list_transform([asset_id, source_hash, source_path, source_name, parser_name, parser_version, sha256(markdown), sha256(content_list_json), sha256(metadata_json)],
  lambda x: coalesce(CAST(to_json(x) AS VARCHAR), 'null')) AS parts FROM revision)
SELECT asset_id, revision_id, sha256('[' || array_to_string(parts, ',') || ',[]]') AS digest FROM quoted""")
def revision_digests(spark: SparkSession, d: str) -> DataFrame:
    rows = store.revisions_once(table(spark, d, "asset_revisions"))
    c = {x: F.col(x) for x in rows.columns}
    digest = ids.revision_id(c["asset_id"], c["source_hash"], c["source_path"], c["source_name"], c["parser_name"], c["parser_version"], c["markdown"], c["content_list_json"], c["metadata_json"])
    return rows.select("asset_id", "revision_id", digest.alias("digest"))


@query(f"""WITH {S.CHUNKS}
SELECT chunk_id, 'chunk-' || sha256(concat_ws(chr(0), asset_id, revision_id, start_line, end_line, text)) AS own_id FROM chunk""")
def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = store.current_chunks(table(spark, d, "assets"), table(spark, d, "knowledge_chunks"))
    return rows.select("chunk_id", ids.chunk_id(F.col("asset_id"), F.col("revision_id"), F.col("start_line"), F.col("end_line"), F.col("text")).alias("own_id"))


@query(f"""WITH {S.CHUNKS}
SELECT asset_id, count(*) AS n_chunks, coalesce(sum(length(text)), 0)::BIGINT AS n_characters, max(end_line) AS last_line FROM chunk GROUP BY asset_id""")
def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = store.current_chunks(table(spark, d, "assets"), table(spark, d, "knowledge_chunks").select("chunk_id", "asset_id", "revision_id", "text", "end_line"))
    return rows.groupBy("asset_id").agg(F.count("*").alias("n_chunks"), F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("bigint").alias("n_characters"), F.max("end_line").alias("last_line"))


@query(f"WITH {S.ASSETS} SELECT asset_id, source_name, lower(source_name) AS sort_name FROM current_asset ORDER BY sort_name, asset_id LIMIT 50 OFFSET 50")
def list_resources_page(spark: SparkSession, d: str) -> DataFrame:
    rows = store.current_assets(table(spark, d, "assets")).select("asset_id", "source_name", F.lower("source_name").alias("sort_name"))
    return evidence.page(rows, [F.col("sort_name"), F.col("asset_id")], 50, 50)


@query(f"WITH {S.ASSETS} SELECT asset_id, source_path FROM current_asset WHERE starts_with(trim(replace({S.fold('source_path')}, chr(92), '/'), '/') || '/', 'library/dorford-board-0000/')")
def list_path_scope(spark: SparkSession, d: str) -> DataFrame:
    rows = store.current_assets(table(spark, d, "assets")).select("asset_id", "source_path")
    return rows.where(evidence.in_path_scope(F.col("source_path"), "/Library\\dorford-board-0000/"))


@query(f"WITH {S.ASSETS} SELECT asset_id, source_name FROM current_asset WHERE lower(source_name) LIKE '%reserve%'")
def find_substring(spark: SparkSession, d: str) -> DataFrame:
    return store.current_assets(table(spark, d, "assets")).select("asset_id", "source_name").where(evidence.name_matches(F.col("source_name"), "Reserve"))


@query(f"WITH {S.ASSETS} SELECT asset_id, source_name FROM current_asset WHERE regexp_full_match(lower(source_name), '.*review.*\\.m.')")
def find_glob(spark: SparkSession, d: str) -> DataFrame:
    return store.current_assets(table(spark, d, "assets")).select("asset_id", "source_name").where(evidence.name_matches(F.col("source_name"), "*review*.m?"))


@query("""SELECT lower(authority) AS authority, practice_area, count(*) AS n_sources, count(effective_date) AS n_dated, list_sort(list(DISTINCT lower(format))) AS formats FROM source_manifest GROUP BY 1, 2""")
def manifest_by_authority(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_manifest").groupBy(F.lower("authority").alias("authority"), "practice_area").agg(F.count("*").alias("n_sources"), F.count("effective_date").alias("n_dated"), F.array_sort(F.collect_set(F.lower("format"))).alias("formats"))


@query(f"""WITH {S.CURRENT}, site AS (SELECT asset_id, split_part(trim(replace(lower(source_path), chr(92), '/'), '/'), '/', 2) AS source_id FROM current_asset)
SELECT source_id, m.status, count(DISTINCT s.asset_id) AS n_assets, count(r.revision_id) AS n_current, coalesce(sum(strlen(r.markdown)), 0)::BIGINT AS n_bytes
FROM source_manifest m LEFT JOIN site s USING (source_id) LEFT JOIN current_revision r ON r.asset_id = s.asset_id GROUP BY source_id, m.status""")
def corpus_by_source(spark: SparkSession, d: str) -> DataFrame:
    assets, revisions = table(spark, d, "assets"), table(spark, d, "asset_revisions")
    site = store.current_assets(assets).select("asset_id", F.split_part(F.trim(F.replace(F.lower("source_path"), F.lit("\\"), F.lit("/")), F.lit("/")), F.lit("/"), F.lit(2)).alias("source_id"))
    size = store.current_revisions(assets, revisions.select("asset_id", "revision_id", "markdown", "created_at")).select("asset_id", "revision_id", F.octet_length("markdown").alias("n"))
    met = table(spark, d, "source_manifest").select("source_id", "status").join(site, "source_id", "left").join(size, "asset_id", "left")
    return met.groupBy("source_id", "status").agg(F.countDistinct("asset_id").alias("n_assets"), F.count("revision_id").alias("n_current"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_bytes"))


@query("""SELECT event_type, count(*) AS samples, round(quantile_disc(value, 0.5), 3) AS p50, round(quantile_disc(value, 0.95), 3) AS p95, round(sum(value), 3) AS total FROM events GROUP BY event_type""")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    p = "round(percentile_disc({}) WITHIN GROUP (ORDER BY value), 3)"
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("samples"), F.expr(p.format(0.5)).alias("p50"), F.expr(p.format(0.95)).alias("p95"), F.round(F.sum("value"), 3).alias("total"))


@query("""SELECT event_type, user_id, event_id, CAST(place AS INTEGER) AS place FROM (
SELECT event_type, user_id, event_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place <= 20""")
def last_events(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("event_type", "user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, d, "events").select("event_type", "user_id", "event_id", F.row_number().over(order).alias("place")).where(F.col("place") <= 20)


@query(f"""WITH {S.CURRENT}
SELECT revision_id, list_transform(list_filter(list_zip({S.lines('markdown')}, range(1, len({S.lines('markdown')}) + 1)), lambda x: regexp_matches(x[1], '^#{{1,6}}\\s+\\S')), lambda x: CAST(x[2] AS INTEGER)) AS heading_lines FROM current_revision""")
def heading_outline(spark: SparkSession, d: str) -> DataFrame:
    rows = store.current_revisions(table(spark, d, "assets"), table(spark, d, "asset_revisions").select("asset_id", "revision_id", "markdown", "created_at"))
    numbered = F.transform(T.lines(F.col("markdown")), lambda x, i: F.when(T.heading_level(x).isNotNull(), i + 1))
    return rows.select("revision_id", F.filter(numbered, lambda x: x.isNotNull()).alias("heading_lines"))


@query("""SELECT asset_id, count(DISTINCT revision_id) AS n_revisions FROM asset_revisions WHERE asset_id IS NOT NULL AND revision_id IS NOT NULL GROUP BY asset_id""")
def unchanged_reingest(spark: SparkSession, d: str) -> DataFrame:
    """All revisions put a second time: none is added."""
    revisions, assets = table(spark, d, "asset_revisions").select("asset_id", "revision_id", "created_at"), table(spark, d, "assets")
    _, after = store.put(assets, revisions, assets, revisions)
    return after.groupBy("asset_id").agg(F.count("*").alias("n_revisions"))


@query(f"WITH {S.ASSETS} SELECT asset_id, source_name FROM current_asset WHERE asset_id = 'Paper-001.MD' OR lower(source_name) = 'paper-001.md' OR lower(source_path) = 'paper-001.md'")
def list_asset_scope(spark: SparkSession, d: str) -> DataFrame:
    rows = store.current_assets(table(spark, d, "assets"))
    return rows.where(evidence.in_asset_scope(F.col("asset_id"), F.col("source_name"), F.col("source_path"), "Paper-001.MD")).select("asset_id", "source_name")


@query(f"""WITH {S.CURRENT} SELECT r.asset_id, r.revision_id, CAST(strlen(r.markdown) AS BIGINT) AS size_bytes, sha256(r.markdown) AS content_hash, r.parser_name,
list_sort(list(DISTINCT h.revision_id)) AS revisions FROM current_revision r JOIN revision h USING (asset_id) GROUP BY ALL""")
def stat_assets(spark: SparkSession, d: str) -> DataFrame:
    revisions = table(spark, d, "asset_revisions").select("asset_id", "revision_id", "markdown", "parser_name", "created_at")
    current = store.current_revisions(table(spark, d, "assets"), revisions)
    stat = current.select("asset_id", "revision_id", F.octet_length("markdown").cast("bigint").alias("size_bytes"), ids.content_hash(F.col("markdown")).alias("content_hash"), "parser_name")
    history = revisions.where(F.col("revision_id").isNotNull()).groupBy("asset_id").agg(F.array_sort(F.collect_set("revision_id")).alias("revisions"))
    return stat.join(history, "asset_id")


@query(f"""WITH {S.CHUNKS} SELECT chunk_id, asset_id, revision_id, start_line, end_line, CAST(strlen(text) AS BIGINT) AS size_bytes, sha256(text) AS content_hash FROM chunk""")
def stat_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = store.current_chunks(table(spark, d, "assets"), table(spark, d, "knowledge_chunks"))
    return rows.select("chunk_id", "asset_id", "revision_id", "start_line", "end_line", F.octet_length("text").cast("bigint").alias("size_bytes"), ids.content_hash(F.col("text")).alias("content_hash"))


@query(f"""WITH {S.CHUNKS}, {S.REVISIONS} SELECT (SELECT count(*) FROM current_asset) AS n_assets, (SELECT count(*) FROM revision) AS n_revisions,
(SELECT count(DISTINCT chunk_id) FROM knowledge_chunks) AS n_chunks, (SELECT count(*) FROM chunk) AS n_current_chunks""")
def store_counts(spark: SparkSession, d: str) -> DataFrame:
    """What a health check counts."""
    assets, chunks = table(spark, d, "assets"), table(spark, d, "knowledge_chunks").select("chunk_id", "asset_id", "revision_id")
    counts = {
        "n_assets": store.current_assets(assets.select("asset_id", "updated_at", "current_revision_id")).agg(F.count("*").alias("n")),
        "n_revisions": store.revisions_once(table(spark, d, "asset_revisions").select("asset_id", "revision_id", "created_at")).agg(F.count("*").alias("n")),
        "n_chunks": chunks.agg(F.countDistinct("chunk_id").alias("n")),
        "n_current_chunks": store.current_chunks(assets, chunks).agg(F.count("*").alias("n")),
    }
    rows = [one.select(F.lit(name).alias("name"), "n") for name, one in counts.items()]
    both = rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])
    return both.agg(*(F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in counts))


@query(f"""WITH {S.ASSETS}, gone AS (SELECT asset_id FROM current_asset WHERE starts_with(trim(replace({S.fold('source_path')}, chr(92), '/'), '/') || '/', 'library/dorford-board-0000/'))
SELECT 'assets' AS name, count(*) AS n FROM assets WHERE asset_id IS NULL OR asset_id NOT IN (SELECT asset_id FROM gone)
UNION ALL SELECT 'revisions', count(*) FROM asset_revisions WHERE asset_id IS NULL OR asset_id NOT IN (SELECT asset_id FROM gone)
UNION ALL SELECT 'chunks', count(*) FROM knowledge_chunks WHERE asset_id IS NULL OR asset_id NOT IN (SELECT asset_id FROM gone)""")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """The rows that are left once the assets of a site are deleted."""
    gone = store.current_assets(table(spark, d, "assets")).where(evidence.in_path_scope(F.col("source_path"), "library/dorford-board-0000")).select("asset_id")
    left = store.delete(gone, assets=table(spark, d, "assets").select("asset_id"), revisions=table(spark, d, "asset_revisions").select("asset_id"), chunks=table(spark, d, "knowledge_chunks").select("asset_id"))
    counted = [rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, rows in left.items()]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query("""SELECT asset_id, source_path, string_split(replace(ltrim(source_path, '/\\'), chr(92), '/'), '/') AS parts, len(list_filter(string_split(lower(replace(source_path, chr(92), '/')), '/'),
  lambda p: p IN ('.aws', '.azure', '.codex-credentials', '.git', '.gnupg', '.ssh', 'credentials', 'id_rsa', 'id_ed25519', 'secrets') OR starts_with(p, '.env') OR regexp_matches(p, '^.+\\.(key|pem|p12|pfx)$'))) > 0 AS sensitive FROM assets WHERE source_path IS NOT NULL""")
def relative_paths(spark: SparkSession, d: str) -> DataFrame:
    """The parts of all source paths below the root, and whether one names credentials."""
    rows = table(spark, d, "assets").where(F.col("source_path").isNotNull())
    parts = T.relative_path(F.expr("ltrim('/\\\\', source_path)"))
    return rows.select("asset_id", "source_path", parts.alias("parts"), T.is_sensitive(parts).alias("sensitive"))
