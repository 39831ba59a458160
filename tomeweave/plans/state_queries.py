"""Change detection, status and the change feed, each with the SQL that says the same.

The earlier state is the documents with every seventh text altered, every eleventh missing and, as
files that are gone, a copy of every thirteenth under another name. Every third file was enriched
then, every fifth is enriched now.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunk, manifest
from ..sources.corpus import entries, markdown, table
from ..streaming import changes
from .vector_queries import vectors


def before(rows: DataFrame) -> DataFrame:
    """Entries as they were."""
    was = rows.where("doc_id % 11 <> 0").withColumn("content", F.when(F.col("doc_id") % 7 == 0, F.concat("content", F.lit(" old"))).otherwise(F.col("content")))
    return was.unionByName(rows.where("doc_id % 13 = 0").withColumn("rel_path", F.concat(F.lit("gone/"), "rel_path")))


def state(spark: SparkSession, d: str) -> DataFrame:
    """The manifest now: md5 of each file, and of the text that was embedded and enriched."""
    rows = entries(table(spark, d, "documents"))
    now = rows.select("source_id", "rel_path", "doc_id", F.md5("content").alias("md5"))
    was = before(rows).select("source_id", "rel_path", F.md5("content").alias("semantic_md5"))
    done = F.when(F.col("doc_id") % 5 == 0, F.col("md5")).when(F.col("doc_id") % 3 == 0, F.col("semantic_md5"))
    return now.join(was, ["source_id", "rel_path"], "left").withColumn("compiled_md5", done)


def manifest_diff(spark: SparkSession, d: str) -> DataFrame:
    rows = entries(table(spark, d, "documents"))
    return manifest.diff(manifest.hashed(rows), manifest.hashed(before(rows)))


def stale_compilations(spark: SparkSession, d: str) -> DataFrame:
    return manifest.stale(state(spark, d))


def compile_status(spark: SparkSession, d: str) -> DataFrame:
    return manifest.compile_status(state(spark, d))


def uncompiled_files(spark: SparkSession, d: str) -> DataFrame:
    return manifest.uncompiled(state(spark, d))


def visible_vectors(spark: SparkSession, d: str) -> DataFrame:
    return manifest.visible_vectors(vectors(spark, d).select("source_id", "rel_path", "chunk_index"), state(spark, d).drop("doc_id"))


def embedding_reuse(spark: SparkSession, d: str) -> DataFrame:
    """How many chunks of each source keep the vector that they had."""
    rows = markdown(table(spark, d, "documents"))
    cut = lambda x: chunk.by_heading(x).withColumn("embed_text", F.col("raw_text"))
    old = cut(before(rows)).select("source_id", "rel_path", F.md5("embed_text").alias("content_md5"), F.lit(1).alias("embedding"))
    found = manifest.reused(cut(rows), old)
    return found.groupBy("source_id").agg(F.count("embedding").alias("reused"), F.count_if(F.col("embedding").isNull()).alias("embedded"))


def entries_after_changes(spark: SparkSession, d: str) -> DataFrame:
    """The earlier entries with changed files replaced and gone files removed: what there is now."""
    rows = entries(table(spark, d, "documents"))
    was = before(rows)
    changed = manifest.diff(manifest.hashed(rows), manifest.hashed(was)).where("status <> 'unchanged'")
    new = rows.join(changed.where("status <> 'deleted'").select("source_id", "rel_path"), ["source_id", "rel_path"], "left_semi")
    return manifest.replaced(was, changed, new).select("source_id", "rel_path", F.md5("content").alias("md5"))


def engine_status(spark: SparkSession, d: str) -> DataFrame:
    rows = entries(table(spark, d, "documents"))
    files = rows.agg(F.countDistinct("source_id").alias("sources"), F.count("*").alias("files"), F.sum(F.octet_length("content")).alias("bytes"))
    chunks = chunk.by_heading(markdown(table(spark, d, "documents"))).agg(F.count("*").alias("chunks"))
    embedded = vectors(spark, d).agg(F.count("*").alias("vectors"), F.countDistinct("source_id", "rel_path").alias("files_with_vectors"))
    compiled = manifest.compile_status(state(spark, d)).agg(F.sum("compiled").alias("compiled"))
    return files.crossJoin(chunks).crossJoin(embedded).crossJoin(compiled)  # a row each


def coalesce_changes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return changes.latest(rows, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value", "coalesced")


STATE = r"""
entries AS (SELECT source AS source_id, concat(lang, '/', doc_id, '.md') AS rel_path, text AS content, doc_id FROM documents),
before AS (SELECT source_id, rel_path, CASE WHEN doc_id % 7 = 0 THEN concat(content, ' old') ELSE content END AS content FROM entries WHERE doc_id % 11 <> 0 UNION ALL SELECT source_id, concat('gone/', rel_path), content FROM entries WHERE doc_id % 13 = 0),
state AS (SELECT e.source_id, e.rel_path, md5(e.content) AS md5, md5(b.content) AS semantic_md5, CASE WHEN doc_id % 5 = 0 THEN md5(e.content) WHEN doc_id % 3 = 0 THEN md5(b.content) END AS compiled_md5 FROM entries e LEFT JOIN before b ON e.source_id = b.source_id AND e.rel_path = b.rel_path)"""
CHUNKS = r"""
lines AS (SELECT source AS source_id, doc_id, concat(lang, '/', doc_id, '.md') AS rel_path, substr(split_part(text, chr(10), 1), 1, 60) AS title, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i, len(string_split(text, chr(10))) AS n FROM documents),
chunks AS (SELECT source_id, rel_path, doc_id, i // 3 AS k, concat(CASE WHEN i // 3 = 0 THEN any_value(title) ELSE trim(max(CASE WHEN i % 3 = 0 THEN concat('## ', line) END)) END, chr(10), string_agg(CASE WHEN i % 3 <> 0 THEN line END, chr(10) ORDER BY i)) AS now,
  max(i) = any_value(n) - 1 AS last, count(*) = 1 AS bare FROM lines GROUP BY source_id, rel_path, doc_id, i // 3)"""
QUERIES = {f.__name__: f for f in (manifest_diff, stale_compilations, compile_status, uncompiled_files, visible_vectors, embedding_reuse, entries_after_changes, engine_status, coalesce_changes)}
SQL = {
    "manifest_diff": f"WITH {STATE} SELECT coalesce(e.source_id, b.source_id) AS source_id, coalesce(e.rel_path, b.rel_path) AS rel_path, CASE WHEN b.rel_path IS NULL THEN 'new' WHEN e.rel_path IS NULL THEN 'deleted' WHEN md5(e.content) = md5(b.content) THEN 'unchanged' ELSE 'changed' END AS status FROM entries e FULL JOIN before b ON e.source_id = b.source_id AND e.rel_path = b.rel_path",
    "stale_compilations": f"WITH {STATE} SELECT source_id, rel_path FROM state WHERE compiled_md5 <> md5",
    "compile_status": f"WITH {STATE} SELECT source_id, count(*) AS total, count(*) FILTER (WHERE compiled_md5 = md5) AS compiled, count(*) FILTER (WHERE compiled_md5 IS NULL OR compiled_md5 <> md5) AS uncompiled FROM state GROUP BY source_id",
    "uncompiled_files": f"WITH {STATE} SELECT source_id, rel_path FROM state WHERE compiled_md5 IS NULL OR compiled_md5 <> md5",
    "visible_vectors": f"WITH {STATE} SELECT e.source_id, e.rel_path, CAST(vec_id % 4 AS INTEGER) AS chunk_index FROM embeddings JOIN entries e ON e.doc_id = vec_id // 4 JOIN state s ON e.source_id = s.source_id AND e.rel_path = s.rel_path WHERE semantic_md5 = md5",
    "embedding_reuse": f"WITH {CHUNKS} SELECT source_id, count(*) FILTER (WHERE doc_id % 11 <> 0 AND NOT (doc_id % 7 = 0 AND last AND NOT (k = 0 AND bare))) AS reused, count(*) FILTER (WHERE doc_id % 11 = 0 OR (doc_id % 7 = 0 AND last AND NOT (k = 0 AND bare))) AS embedded FROM chunks GROUP BY source_id",
    "entries_after_changes": f"WITH {STATE} SELECT source_id, rel_path, md5(content) AS md5 FROM entries",
    "engine_status": f"""WITH {STATE}, {CHUNKS} SELECT count(DISTINCT source_id) AS sources, count(*) AS files, CAST(sum(strlen(content)) AS BIGINT) AS bytes, (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM embeddings JOIN entries ON doc_id = vec_id // 4) AS vectors,
  (SELECT count(DISTINCT vec_id // 4) FROM embeddings JOIN entries ON doc_id = vec_id // 4) AS files_with_vectors, (SELECT count(*) FROM state WHERE compiled_md5 = md5) AS compiled FROM entries""",
    "coalesce_changes": "SELECT user_id, event_id, event_type, value, coalesced FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r, count(*) OVER (PARTITION BY user_id) AS coalesced FROM events) WHERE r = 1",
}
