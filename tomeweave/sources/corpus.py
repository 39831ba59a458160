"""Views of the driver's tables as collections of Markdown entries, and the Markdown scan."""

from __future__ import annotations

import datetime
import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


#: A smaller input comes in too few row groups to keep all cores busy.
SMALL_BYTES = 256 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, path: str) -> DataFrame:
    """The rows of a small file dealt out to all cores, for work that costs more than the shuffle; larger inputs as they are."""
    spark = df.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
    return df.repartition(spark.sparkContext.defaultParallelism) if size < SMALL_BYTES else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents for text analysis."""
    return spread(table(spark, sf_dir, "documents"), f"{sf_dir}/documents.parquet")


def entries(documents: DataFrame) -> DataFrame:
    """documents as entries: a source is a shard, a language a folder and the first line the title."""
    return documents.select(
        F.col("source").alias("source_id"),
        F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("rel_path"),
        F.substring(F.substring_index("text", "\n", 1), 1, 60).alias("title"),
        F.array("lang").alias("tags"),
        F.col("text").alias("content"),
        "doc_id",
    )


def markdown(documents: DataFrame) -> DataFrame:
    """Entries whose every third line is a level-2 heading."""
    lines = F.transform(F.split("content", "\n"), lambda x, i: F.when(i % 3 == 0, F.concat(F.lit("## "), x)).otherwise(x))
    return entries(documents).withColumn("content", F.array_join(lines, "\n"))


def chunk_vectors(embeddings: DataFrame, per_file: int = 4) -> DataFrame:
    """embeddings as chunk vectors, four to a file."""
    return embeddings.select((F.col("vec_id") / per_file).cast("long").alias("doc_id"), (F.col("vec_id") % per_file).cast("int").alias("chunk_index"), "embedding", "vec_id")


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(rel_path, content, mtime) of every .md file under root. Folders that start with a dot and node_modules are skipped, and so is what can't be read.

    Names are listed on the driver, contents are read by tasks: root must be in a folder that all executors share.
    """
    root = os.path.abspath(root)
    found = []
    for folder, folders, names in os.walk(root):
        folders[:] = sorted(d for d in folders if not d.startswith(".") and d != "node_modules")
        found += [os.path.relpath(os.path.join(folder, n), root).replace(os.sep, "/") for n in sorted(names) if n.endswith(".md")]
    schema = "rel_path string, content string, mtime string"
    if not found:
        return spark.createDataFrame([], schema)

    def read(batches):
        for batch in batches:
            rows = []
            for path in batch["rel_path"]:
                full = os.path.join(root, path)
                try:
                    with open(full, encoding="utf-8", newline="") as file:
                        rows.append((path, file.read(), datetime.datetime.fromtimestamp(os.stat(full).st_mtime, datetime.UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")))
                except (OSError, UnicodeDecodeError):
                    continue
            yield pd.DataFrame(rows, columns=["rel_path", "content", "mtime"])

    parts = max(1, min(len(found) // 64, 4096))
    return spark.createDataFrame([(x,) for x in found], "rel_path string").repartition(parts).mapInPandas(read, schema)


def parsed(files: DataFrame, source_id: str, source_dir: str) -> DataFrame:
    """Files as entries, with title and tags from front matter and headings."""
    return files.select(
        F.lit(source_id).alias("source_id"), "rel_path", T.title_of(F.col("content"), F.col("rel_path")).alias("title"), T.tags_of(F.col("content")).alias("tags"), "content", F.lit(source_dir).alias("source_dir"), "mtime",
    )
