"""Passages repeated across documents, found with sparse suffix arrays.

Words are ASCII letters and digits (A-Z lower-cased) and all characters beyond ASCII. A passage
is repeated if it has `least` words or more and stands in two documents; all its words are
reported, and those that stand in an earlier document (smaller doc_id) are marked for removal.

1. Each document keeps the suffixes that begin at minimisers: in any window of `least` words the
   run of `seed` words of smallest hash, the first if even. Equal windows choose the same place, so
   no repeat is lost though only about one suffix in 18 is kept. A suffix is represented by the
   hash of its first `seed` words, and by that of its reach: all the windows that chose it.
2. Suffixes are sorted by their beginning. One whose beginning stands in no other document is
   dropped. Where neighbours agree in their whole reach, the reach is a repeat at once.
3. The others are extended word by word to the left and right: each window of their reach is a
   denser suffix, sorted and compared in the same way. Of suffixes with the same reach only one or
   two speak for all, so this touches the edges of repeats, not their inside.
4. A document's windows merge into spans.

Sorting is by Spark's shuffle on (beginning, reach or window) with partial aggregates, so a
passage in a third of all documents is one row per task and not a group in one task; text is read
again only for documents with edges. Hashes meet as pairs of 64 bits.

Null and empty texts and those under `least` words have no repeats. Rows with equal doc_id and
text are one document; equal texts under different ids are repeats of each other as a whole. A
null doc_id comes after all others. Documents without repeats give no row. An empty table gives
no rows. Other columns are ignored by the report and kept by `deduplicated`.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, settle, ship, small_batches, table, unpacked, words_of

LEAST, SEED = 50, 16
#: An odd base has an inverse modulo 2**64, so prefix sums give the hash of any run of words.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
LAST = (1 << 63) - 1
CHUNK = 1 << 16
WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


class Hashed(dict):
    """Word to a hash; remembers up to a million words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 5)
        return value


class Powers:
    """Powers of the bases and of their inverses, as long as the longest text met."""

    def __init__(self):
        self.up, self.down = [], []
        self.reach(CHUNK)

    def reach(self, n: int) -> None:
        if not self.up or len(self.up[0]) < n:
            full = lambda b: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)]))
            self.up = [full(b) for b in BASES]
            self.down = [full(pow(b, -1, 1 << 64)) for b in BASES]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Runs:
    """Hashes of runs [a, b) of a text's words."""

    def __init__(self, words: list[bytes], hashed: Hashed, powers: Powers):
        self.n = len(words)
        own = np.fromiter(map(hashed.__getitem__, words), np.uint64, self.n)
        powers.reach(self.n + 1)
        self.down = powers.down
        self.sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * up[: self.n])]) for up in powers.up]

    def of(self, a: np.ndarray, b: np.ndarray, base: int) -> np.ndarray:
        return mixed((self.sums[base][b] - self.sums[base][a]) * self.down[base][a])


def minimisers(runs: Runs, least: int, seed: int) -> tuple[np.ndarray, ...]:
    """Places of the retained suffixes, the first and last window that chose each, and the hash of each beginning."""
    windows = runs.n - least + 1
    if windows < 1:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    at = np.arange(runs.n - seed + 1)
    grams = runs.of(at, at + seed, 0)
    width = least - seed + 1
    view = np.lib.stride_tricks.sliding_window_view(grams, width)
    place = np.concatenate([view[i : i + CHUNK].argmin(1) for i in range(0, windows, CHUNK)]) + np.arange(windows)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.append(first[1:] - 1, windows - 1)
    return place[first], first, last, grams[place[first]]


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def keyed(documents: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), F.xxhash64(F.col("doc_id").cast("long"), text).alias("uid"), text.alias("text"))


def suffixes(documents: DataFrame, least: int = LEAST, seed: int = SEED) -> DataFrame:
    """(d, uid, seed, ctx, lo, hi): the retained suffixes of each document."""
    small_batches(documents.sparkSession)
    kept = ship(documents.sparkSession, (Hashed, Powers, Runs, minimisers))

    def retain(batches):
        hashed_kind, powers_kind, runs_of, choose = kept()
        hashed, powers = hashed_kind(), powers_kind()
        for batch in batches:
            parts: list[list] = [[], [], [], [], []]
            for i, t in enumerate(batch.column(2).cast(pa.binary())):
                words = words_of(t.as_py())
                if len(words) < least:
                    continue
                runs = runs_of(words, hashed, powers)
                _, lo, hi, grams = choose(runs, least, seed)
                for part, x in zip(parts, (np.full(len(lo), i), grams, runs.of(lo, hi + least, 1), lo, hi)):
                    part.append(x)
            if parts[0]:
                own, grams, ctx, lo, hi = map(np.concatenate, parts)
                ids = batch.select(["d", "uid"]).take(pa.array(own))
                yield pa.RecordBatch.from_arrays([*ids.columns, signed(grams), signed(ctx), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], ["d", "uid", "seed", "ctx", "lo", "hi"])

    return keyed(documents).mapInArrow(retain, "d long, uid long, seed long, ctx long, lo int, hi int")


def windows(documents: DataFrame, speakers: DataFrame, least: int) -> DataFrame:
    """(d, uid, seed, win, at, u0, u1, d0): every window in the reach of the speaking suffixes."""
    small_batches(documents.sparkSession)
    kept = ship(documents.sparkSession, (Hashed, Powers, Runs))
    listed = speakers.groupBy("uid").agg(F.collect_list(F.struct("seed", "lo", "hi", "u0", "u1", "d0")).alias("own"))  # at most a document's suffixes
    rows = keyed(documents).join(listed, "uid").select("d", "uid", "text", "own")

    def extend(batches):
        hashed_kind, powers_kind, runs_of = kept()
        hashed, powers = hashed_kind(), powers_kind()
        for batch in batches:
            for i in range(batch.num_rows):
                runs = runs_of(words_of(batch.column(2)[i].cast(pa.binary()).as_py()), hashed, powers)
                own = batch.column(3)[i].values
                col = {n: own.field(n).to_numpy(zero_copy_only=False) for n in ("seed", "lo", "hi", "u0", "u1", "d0")}
                size = col["hi"] - col["lo"] + 1
                k = np.repeat(np.arange(len(size)), size)
                at = np.arange(len(k)) - np.repeat(np.cumsum(size) - size, size) + col["lo"][k]
                ids = batch.select(["d", "uid"]).take(pa.array(np.full(len(k), i)))
                yield pa.RecordBatch.from_arrays([*ids.columns, pa.array(col["seed"][k]), signed(runs.of(at, at + least, 1)), pa.array(at.astype(np.int32)), *(pa.array(col[n][k]) for n in ("u0", "u1", "d0"))], ["d", "uid", "seed", "win", "at", "u0", "u1", "d0"])

    return rows.mapInArrow(extend, "d long, uid long, seed long, win long, at int, u0 long, u1 long, d0 long")


def spread(lowest: str = "uid", highest: str = "uid", first: str = "d"):
    return F.min(lowest).alias("u0"), F.max(highest).alias("u1"), F.min(first).alias("d0")


def joined(runs: np.ndarray) -> np.ndarray:
    """Overlapping or touching [a, b) merged, in order."""
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    if not len(runs):
        return runs
    upto = np.maximum.accumulate(runs[:, 1])
    new = np.concatenate([[True], runs[1:, 0] > upto[:-1]])
    at = np.flatnonzero(new)
    return np.stack([runs[at, 0], np.append(upto[at[1:] - 1], upto[-1])], 1)


def repeats(documents: DataFrame, least: int = LEAST, seed: int = SEED) -> DataFrame:
    """(doc_id, uid, n_repeated, n_removed, spans, removed) of each document with repeats; spans are of words, a:b with b exclusive."""
    spark = documents.sparkSession
    rec = settle(suffixes(documents, least, seed), "suffixes")
    # beginnings that stand in two documents
    shared = rec.groupBy("seed").agg(*spread(), F.min("ctx").alias("c0"), F.max("ctx").alias("c1")).where("u0 <> u1")
    # small tables are written before they are joined, so that hot keys of the other side can be split
    shared = settle(shared.select("seed", F.col("d0").alias("s0"), (F.col("c0") != F.col("c1")).alias("several")), "shared-beginnings")
    found = settle(rec.join(shared, "seed"), "shared-suffixes")
    whole = found.where("not several").select("d", "uid", "lo", "hi", (F.col("d") == F.col("s0")).alias("first"))
    # several reaches with one beginning
    several = found.where("several").drop("s0", "several")
    reach = settle(several.groupBy("seed", "ctx").agg(*spread()), "reach")
    marked = settle(several.join(reach, ["seed", "ctx"]), "reaches")
    speaks = (F.col("uid") == F.col("u0")) | (F.col("d") == F.col("d0"))
    silent = marked.where(~speaks).select("d", "uid", "lo", "hi", F.lit(False).alias("first"))
    wins = settle(windows(documents, marked.where(speaks), least), "windows")
    twice = settle(wins.groupBy("seed", "win").agg(*spread("u0", "u1", "d0")).where("u0 <> u1").select("seed", "win", F.col("d0").alias("w0")), "twice")
    edges = wins.join(twice, ["seed", "win"]).select("d", "uid", F.col("at").alias("lo"), F.col("at").alias("hi"), (F.col("d") == F.col("w0")).alias("first"))
    every = whole.unionByName(silent).unionByName(edges)
    listed = every.groupBy("d", "uid").agg(F.collect_list(F.struct("lo", "hi", "first")).alias("own"))  # at most a document's windows
    merge = ship(spark, joined)

    def report(batches):
        merged = merge()
        text = lambda x: ",".join(f"{a}:{b}" for a, b in x.tolist())
        for batch in batches:
            out = []
            for own in batch.column(2):
                lo, hi, first = (own.values.field(n).to_numpy(zero_copy_only=False) for n in ("lo", "hi", "first"))
                runs = np.stack([lo.astype(np.int64), hi + np.int64(least)], 1)
                all_, gone = merged(runs), merged(runs[~first.astype(bool)])
                out.append((int((all_[:, 1] - all_[:, 0]).sum()), int((gone[:, 1] - gone[:, 0]).sum()), text(all_), text(gone)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array([x[i] for x in out], k) for i, k in enumerate(kinds))], ["d", "uid", "n_repeated", "n_removed", "spans", "removed"])

    out = listed.mapInArrow(report, "d long, uid long, n_repeated long, n_removed long, spans string, removed string")
    return out.select(F.when(F.col("d") != LAST, F.col("d")).alias("doc_id"), "uid", "n_repeated", "n_removed", "spans", "removed")


def without(text: str | None, removed: str | None) -> str | None:
    """The text less the words of these spans and what stands between them."""
    if not text or not removed:
        return text
    places = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    for span in removed.split(","):
        a, b = map(int, span.split(":"))
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join([*out, text[at:]])


def deduplicated(documents: DataFrame, least: int = LEAST, seed: int = SEED) -> DataFrame:
    """documents, columns as they were, with each repeated passage left only in the document of smallest doc_id."""
    cuts = repeats(documents, least, seed).where("removed <> ''").select(F.col("uid").alias("_uid"), F.col("removed").alias("_removed"))
    cut = F.udf(without, "string", useArrow=True)
    text = F.col("text").cast("string")
    rows = packed(documents, F.xxhash64(F.col("doc_id").cast("long"), text).alias("_uid"), text.alias("_text")).join(cuts, "_uid", "left")
    less = cut("_text", "_removed").alias("text")
    return rows.select(*[less if c == "text" else kept for c, kept in zip(documents.columns, unpacked(documents.columns))])


def op5_suffixes(spark, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents")).drop("uid")


OP5_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT DISTINCT doc_id, text FROM documents)),
wins AS (SELECT r, doc_id, i, array_to_string(w[i:i + 49], ' ') AS win FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM docs WHERE len(w) >= 50)),
twice AS (SELECT win, min(doc_id) AS first_doc FROM wins GROUP BY win HAVING count(DISTINCT r) > 1),
hits AS (SELECT r, wins.doc_id AS doc_id, i, wins.doc_id = first_doc AS first FROM wins JOIN twice ON wins.win = twice.win),
marks AS (
  SELECT r, doc_id, i, first, max(i) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
         max(CASE WHEN NOT first THEN i END) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_gone FROM hits),
runs AS (
  SELECT r, doc_id, i, first, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS g,
         sum(CASE WHEN NOT first AND (before_gone IS NULL OR i > before_gone + 50) THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS h FROM marks),
spans AS (SELECT r, doc_id, g, min(i) - 1 AS a, max(i) + 49 AS b FROM runs GROUP BY r, doc_id, g),
cuts AS (SELECT r, h, min(i) - 1 AS a, max(i) + 49 AS b FROM runs WHERE NOT first GROUP BY r, h),
listed AS (SELECT r, doc_id, sum(b - a) AS n, string_agg(a || ':' || b, ',' ORDER BY a) AS spans FROM spans GROUP BY r, doc_id),
gone AS (SELECT r, sum(b - a) AS n, string_agg(a || ':' || b, ',' ORDER BY a) AS removed FROM cuts GROUP BY r)
SELECT doc_id, CAST(listed.n AS BIGINT) AS n_repeated, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed, spans, coalesce(removed, '') AS removed
FROM listed LEFT JOIN gone ON listed.r = gone.r
"""
