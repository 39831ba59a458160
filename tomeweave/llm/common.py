"""What the corpus operators share: tables, the shared folder, words and labels."""

from __future__ import annotations

import atexit
import contextlib
import pickle
import tempfile
import uuid

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

#: Bytes of a word stay (A-Z as a-z); every other ASCII byte becomes a space. Bytes from 0x80 on belong to words.
ALNUM = bytes((b | 0x20) if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: The same words for Spark's and RE2's regular expressions, on text whose A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (tests) a temporary one set here."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tomeweave-"))
        found = sc.getCheckpointDir()
    return found


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: the lineage ends here, and a lost executor takes nothing with it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tomeweave/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def packed(documents: DataFrame, *cols) -> DataFrame:
    """documents as one column `_row`, whatever their columns are called, and further columns."""
    return documents.select(*cols, F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row"))


def widened(df: DataFrame, name: str, kind: DataType) -> StructType:
    """The schema of df with one more column."""
    return StructType([*df.schema.fields, StructField(name, kind)])


def unpacked(columns: list[str], *replaced: str) -> list:
    """The columns of `_row` again, less those that others of the same name replace."""
    gone = {c.lower() for c in replaced}
    return [F.col("_row").getField(c).alias(c) for c in columns if c.lower() not in gone]


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 32 << 20) -> None:
    """Bound what one Arrow batch holds, whatever the length of the texts."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    with contextlib.suppress(Exception):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def ship(spark: SparkSession, value):
    """Broadcast a value of bounded size; what comes back is a function that tasks call for it. Pickled by value, so workers need not import this package."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(sent.value)


def words_of(text: bytes | None) -> list[bytes]:
    """ASCII letters and digits and all bytes from 0x80 on make words; A-Z are lower-cased."""
    return text.translate(ALNUM).split() if text else []


def lowered(col):
    """A-Z as a-z, all else as it is."""
    return F.translate(col, UPPER, LOWER)


def held_out(doc_id, folds: int, fold: int):
    """Whether crc32 of doc_id as text leaves this remainder; a null doc_id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def labelled(labels: DataFrame, name: str, folds: int, fold: int) -> DataFrame:
    """doc_id and label (0/1) of the rows to learn from. Several labels of one document: the majority, 1 when even. Null ids and labels go."""
    rows = labels.select(F.col("doc_id"), F.col(name).cast("double").alias("label")).dropna()
    return rows.where(~held_out(F.col("doc_id"), folds, fold)).groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))


def labelled_texts(documents: DataFrame, labels: DataFrame, name: str, folds: int, fold: int, most: int, *extra: str) -> DataFrame:
    """The documents (text, label, _hash, doc_id, extra columns) of at most `most` labelled doc_ids, those of smallest hash."""
    chosen = labelled(labels, name, folds, fold).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = documents.select("doc_id", "text", *extra).join(F.broadcast(chosen), "doc_id")
    return rows.select(F.col("text").cast("string").alias("text"), F.col("label").cast("int").alias("label"), F.xxhash64("doc_id", "text").alias("_hash"), "doc_id", *extra)


def first_of(rows: DataFrame, most: int) -> DataFrame:
    """At most `most` rows where doc_ids are repeated, those of smallest hash."""
    return rows.orderBy("_hash", "doc_id").limit(most)


def logistic(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))
