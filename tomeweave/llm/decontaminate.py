"""Benchmark decontamination: a broadcast hash set of the test items' word windows.

Words are runs of ASCII letters and digits (A-Z lower-cased) and of all characters beyond
ASCII. An item's windows are its runs of `window` words; an item of fewer words is one window.
Document words are numbered by the items' vocabulary; wherever a run of known words is long
enough its rolling hash is looked up in the sorted hash set, and a find is verified word by
word. Every document word inside a verified window is hit.

The index goes to every task only if it has at most `most_windows` windows, each of which takes
about 700 bytes on the driver and 100 in a task; beyond that windows of documents and items meet in a
shuffled join on their words, with the same result. Owners come in lists of about 64, so that neither a window that many items share nor one that many documents hold is gathered
in one place.

Null and empty texts have no words. Texts of any length are read whole. Items with a null item_id hit words but are not listed;
equal items are listed each. Repeated documents are scored each by itself. Empty tables:
nothing is hit. Other columns are ignored by the report and kept by the filter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import WORD, lowered, packed, settle, ship, small_batches, table, unpacked, widened, words_of

REPORT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items string, spans string"


class Windows:
    """The items' windows by length: sorted hashes, word numbers for the check, and the items that hold each."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple, set]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1 if ids else 0):
                by_length.setdefault(size, {}).setdefault(tuple(ids[i : i + size]), set()).add(item)
        rng = np.random.default_rng(7)
        self.levels = []
        for size, found in sorted(by_length.items()):
            grams = np.array(list(found), np.int64).reshape(len(found), size)
            while True:
                base = rng.integers(0, 1 << 64, size, dtype=np.uint64) | np.uint64(1)
                keys = (grams.astype(np.uint64) * base).sum(1, dtype=np.uint64)
                if len(np.unique(keys)) == len(keys):
                    break
            order = np.argsort(keys)
            owners = [sorted(x for x in v if x is not None) for v in found.values()]
            self.levels.append((size, base, keys[order], grams[order], [owners[i] for i in order]))

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """Which words are hit, and the items found."""
        n, items = len(words), set()
        ids = np.fromiter(map(self.vocabulary.get, words, (0 for _ in words)), np.int64, n)
        unknown = np.concatenate(([0], np.cumsum(ids == 0)))
        edge = np.zeros(n + 1, np.int64)
        for size, base, keys, grams, owners in self.levels:
            if n < size:
                continue
            at = np.flatnonzero(unknown[size:] == unknown[:-size])
            if not len(at):
                continue
            key = np.zeros(len(at), np.uint64)
            for j in range(size):
                key += ids[at + j].astype(np.uint64) * base[j]
            where = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            ok = keys[where] == key
            at, where = at[ok], where[ok]
            if len(at):
                ok = (grams[where] == ids[at[:, None] + np.arange(size)]).all(1)
                at, where = at[ok], where[ok]
                np.add.at(edge, at, 1)
                np.add.at(edge, at + size, -1)
                for k in np.unique(where).tolist():
                    items.update(owners[k])
        return np.cumsum(edge[:n]) > 0, items


def report_of(hit: np.ndarray, items: set) -> tuple:
    listed = ",".join(sorted(items))
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    spans = ",".join(f"{a}:{b}" for a, b in edges.reshape(-1, 2).tolist())
    return len(hit), int(hit.sum()), len(items), hashlib.sha256(listed.encode()).hexdigest(), bool(hit.any()), listed, spans


def item_texts(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")


def windows_in(items: DataFrame, window: int) -> int:
    """How many windows the items have, repeats included: what an index of them takes is in proportion."""
    n = F.regexp_count(lowered(F.col("text")), F.lit(WORD))
    return items.agg(F.sum(F.when(n > 0, F.greatest(n - window, F.lit(0)) + 1).otherwise(0))).first()[0] or 0


def scan(documents: DataFrame, benchmark: DataFrame, window: int = 10, most_windows: int = 300_000) -> DataFrame:
    """`_row` with all columns of documents, and `_found` with the report's fields."""
    spark = documents.sparkSession
    items = item_texts(benchmark)
    if windows_in(items, window) > most_windows:
        return scan_joined(documents, benchmark, window)
    small_batches(spark)
    index = ship(spark, Windows([(r.item_id, r.text.encode()) for r in items.collect()], window))
    at = documents.columns.index("text")
    rows = packed(documents)

    def find(batches):
        windows = index()
        for batch in batches:
            found = [report_of(*windows.hits(words_of(t.as_py()))) for t in batch.column(0).field(at).cast(pa.binary())]
            kinds = {"n_words": pa.int64(), "n_hit": pa.int64(), "n_items": pa.int64(), "items_sha256": pa.string(), "contaminated": pa.bool_(), "items": pa.string(), "spans": pa.string()}
            columns = [pa.array([x[i] for x in found], kind) for i, kind in enumerate(kinds.values())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.StructArray.from_arrays(columns, list(kinds))], ["_row", "_found"])

    return rows.mapInArrow(find, widened(rows, "_found", StructType.fromDDL(REPORT)))


def scan_joined(documents: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The same where the items are too many to send to every task: windows of both sides meet by hash and words in a shuffled join."""
    words = lambda text: F.regexp_extract_all(lowered(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    runs = lambda size: F.when(F.size("w") >= size, F.sequence(F.lit(1), F.size("w") - size + 1)).otherwise(F.array().cast("array<int>"))
    items = item_texts(benchmark).select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0).withColumn("size", F.least(F.lit(window), F.size("w")))
    grams = items.select("item_id", "size", F.explode(runs(F.col("size"))).alias("i"), "w").select("item_id", "size", F.array_join(F.slice("w", F.col("i"), F.col("size")), " ").alias("gram")).distinct()
    # a window's owners in lists of about 64, however many there are
    some = F.pmod(F.xxhash64("item_id"), F.greatest(F.lit(1), F.ceil(F.col("n") / 64)))
    grams = settle(grams, "owned-grams")
    held = grams.groupBy("size", "gram").agg(F.count("*").alias("n"))
    grams = settle(grams.join(held, ["size", "gram"]).groupBy("size", "gram", some.alias("slot")).agg(F.collect_set("item_id").alias("owners")), "grams")
    known = settle(grams.select("size", "gram").distinct(), "known-grams")
    sizes = [r[0] for r in grams.select("size").distinct().collect()]  # at most `window` numbers
    kept = settle(packed(documents, F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("_id")), "documents")
    w = kept.select("_id", words(F.col("text")).alias("w"))
    each = [w.select("_id", F.lit(s).alias("size"), F.explode(runs(F.lit(s))).alias("i"), "w").select("_id", "size", "i", F.array_join(F.slice("w", F.col("i"), F.lit(s)), " ").alias("gram")) for s in sizes]
    if each:
        found = each[0]
        for x in each[1:]:
            found = found.unionByName(x)
        found = settle(found.join(known, ["size", "gram"]), "hits")
        hit = found.select("_id", F.explode(F.sequence("i", F.col("i") + F.col("size") - 1)).alias("p")).groupBy("_id").agg(F.countDistinct("p").alias("n_hit"), F.sort_array(F.collect_set("p")).alias("ps"))
        own = found.select("_id", "size", "gram").distinct().join(grams, ["size", "gram"]).select("_id", F.explode("owners").alias("o")).distinct().groupBy("_id").agg(F.sort_array(F.collect_set("o")).alias("os"))
        all_ = w.select("_id", F.size("w").cast("long").alias("n_words")).join(hit, "_id", "left").join(own, "_id", "left")
    else:
        all_ = w.select("_id", F.size("w").cast("long").alias("n_words"), F.lit(None).cast("long").alias("n_hit"), F.array().cast("array<int>").alias("ps"), F.array().cast("array<string>").alias("os"))
    starts = F.filter("ps", lambda p: ~F.array_contains("ps", p - 1))
    ends = F.filter("ps", lambda p: ~F.array_contains("ps", p + 1))
    listed = F.coalesce(F.array_join("os", ","), F.lit(""))
    got = all_.select("_id", F.struct("n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("os"), F.lit(0)).cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), listed.alias("items"), F.coalesce(F.array_join(F.zip_with(starts, ends, lambda a, b: F.concat_ws(":", a - 1, b)), ","), F.lit("")).alias("spans")).alias("_found"))
    return kept.join(got, "_id").select("_row", "_found")


def clean(documents: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Documents without contaminated ones, columns as they were."""
    return scan(documents, benchmark, window).where("not _found.contaminated").select(*unpacked(documents.columns))


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(documents, table(spark, sf_dir, "benchmark")).select("_row.doc_id", "_found.n_words", "_found.n_hit", "_found.n_items", "_found.items_sha256", "_found.contaminated", "_found.spans")


OP6_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, w, least(10, len(w)) AS size FROM (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL)
  WHERE len(w) > 0),
grams AS (
  SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS gram FROM (SELECT item, size, w, unnest(range(1, len(w) - size + 2)) AS i FROM items)),
sizes AS (SELECT DISTINCT size FROM grams),
runs AS (
  SELECT r, size, i, array_to_string(w[i:i + size - 1], ' ') AS gram FROM (
    SELECT r, size, w, unnest(range(1, len(w) - size + 2)) AS i FROM docs, sizes WHERE len(w) >= size)),
found AS (SELECT r, runs.size AS size, i, item FROM runs JOIN grams ON runs.gram = grams.gram AND runs.size = grams.size),
hit AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT r, i, size FROM found)) GROUP BY r),
own AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT r, item FROM found WHERE item IS NOT NULL) GROUP BY r),
marks AS (SELECT DISTINCT r, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT r, i, size FROM found)),
isle AS (SELECT r, p, p - row_number() OVER (PARTITION BY r ORDER BY p) AS g FROM marks),
span AS (SELECT r, string_agg(CAST(a AS VARCHAR) || ':' || CAST(b AS VARCHAR), ',' ORDER BY a) AS spans FROM (SELECT r, min(p) - 1 AS a, max(p) AS b FROM isle GROUP BY r, g) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(own.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated, coalesce(spans, '') AS spans
FROM docs LEFT JOIN hit ON docs.r = hit.r LEFT JOIN own ON docs.r = own.r LEFT JOIN span ON docs.r = span.r
"""
