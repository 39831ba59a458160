"""What has changed: content hashes against a manifest, and what can be used again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ("source_id", "rel_path")


def hashed(entries: DataFrame) -> DataFrame:
    return entries.select(*KEY, F.md5("content").alias("md5"), F.octet_length("content").alias("file_size"))


def diff(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """(source_id, rel_path, status): new, changed, unchanged or deleted. Both sides have md5."""
    both = current.select(*KEY, F.col("md5").alias("now")).join(manifest.select(*KEY, F.col("md5").alias("was")), list(KEY), "full")
    status = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("now") == F.col("was"), "unchanged").otherwise("changed")
    return both.select(*KEY, status.alias("status"))


def visible_vectors(vectors: DataFrame, manifest: DataFrame) -> DataFrame:
    """Vectors of the text that a file has now: those whose file has no row in the manifest, or whose text was embedded as it is."""
    state = manifest.select(*KEY, F.coalesce(F.col("semantic_md5") == F.col("md5"), F.lit(False)).alias("_ok"))
    return vectors.join(state, list(KEY), "left").where(F.coalesce("_ok", F.lit(True))).drop("_ok")


def usable_compiled(compiled: DataFrame, manifest: DataFrame) -> DataFrame:
    """Enrichment of the text that a file has now; files without a row in the manifest keep theirs."""
    state = manifest.select(*KEY, F.coalesce(F.col("compiled_md5") == F.col("md5"), F.lit(False)).alias("_ok"))
    return compiled.join(state, list(KEY), "left").where(F.coalesce("_ok", F.lit(True))).drop("_ok")


def stale(manifest: DataFrame) -> DataFrame:
    """Files enriched before their text changed."""
    return manifest.where("compiled_md5 is not null and compiled_md5 <> md5").select(*KEY)


def compile_status(manifest: DataFrame) -> DataFrame:
    done = F.coalesce(F.col("compiled_md5") == F.col("md5"), F.lit(False))
    return manifest.groupBy("source_id").agg(F.count("*").alias("total"), F.count_if(done).alias("compiled"), F.count_if(~done).alias("uncompiled"))


def uncompiled(manifest: DataFrame) -> DataFrame:
    return manifest.where("compiled_md5 is null or compiled_md5 <> md5").select(*KEY)


def reused(chunks: DataFrame, before: DataFrame) -> DataFrame:
    """chunks with the vector that a chunk of the same file and text had before; null where it must be embedded."""
    own = before.select(*KEY, F.col("content_md5").alias("md5"), "embedding").dropDuplicates([*KEY, "md5"])
    rows = chunks.withColumn("md5", F.md5("embed_text"))
    return rows.join(own, [*KEY, "md5"], "left").withColumnRenamed("md5", "content_md5")


def replaced(table: DataFrame, changed: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """A table without the rows of changed files, and with their new rows."""
    kept = table.join(changed.select(*KEY).distinct(), list(KEY), "left_anti")
    return kept if rows is None else kept.unionByName(rows, allowMissingColumns=True)
