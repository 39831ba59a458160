"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are counts and ratios of a whole text (length, characters by kind, word shapes,
repeated words and lines, marks at the end of words). Trees are grown level by level on
histograms of 64 quantile bins and flattened into arrays, complete to their depth, so that a
batch of documents walks all trees with a few numpy operations a level.

The model is fitted on at most `most` labelled documents (those of smallest hash); statistics
and scores cover every document. Null and empty texts have all counts zero and get the score
that those statistics lead to. Without labels of both kinds every score is the share of label 1
(0.5 without labels). Equal rows are scored alike; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import first_of, held_out, labelled_texts, logistic, ship, small_batches, table

FOLDS, FOLD = 4, 2
KIND = np.zeros(256, np.int64)  # 0 other controls, 1 a-z, 2 A-Z, 3 digit, 4 space, 5 newline, 6 . , ; : ! ? ' " ( ) -, 7 other ASCII marks, 8 UTF-8 lead, 9 UTF-8 tail
KIND[0x61:0x7B], KIND[0x41:0x5B], KIND[0x30:0x3A] = 1, 2, 3
KIND[[0x20, 0x09, 0x0B, 0x0C, 0x0D]], KIND[0x0A] = 4, 5
for _b in range(0x21, 0x7F):
    if KIND[_b] == 0:
        KIND[_b] = 6 if chr(_b) in ".,;:!?'\"()-" else 7
KIND[0x80:0xC0], KIND[0xC0:] = 9, 8
NAMES = ("bytes", "words", "lines", "lower", "upper", "digits", "space", "plain marks", "odd marks", "non-ASCII", "controls", "word length", "word length spread", "longest word", "distinct words", "commonest word", "words of marks", "words that end in odd marks", "short words", "capitals first", "line words", "distinct lines", "distinct line words", "ends of sentences", "pipes", "letter words")


def statistics(text: bytes | None) -> list[float]:
    """The numbers that the trees see, of the whole text."""
    text = text or b""
    n = len(text)
    if not n:
        return [0.0] * len(NAMES)
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    kinds = np.bincount(KIND, seen, 10)
    chars = n - kinds[9]
    words = text.split()
    k = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    count: dict[bytes, int] = {}
    for w in words:
        count[w] = count.get(w, 0) + 1
    last = np.bincount(KIND[np.frombuffer(b"".join([w[-1:] for w in words]), np.uint8)], minlength=10)
    first = np.bincount(KIND[np.frombuffer(b"".join([w[:1] for w in words]), np.uint8)], minlength=10)
    lines = [x for x in text.split(b"\n") if x.strip()]
    own = set(lines)
    size = sum(map(len, lines)) or 1
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), float(np.log1p(len(lines))), kinds[1] / chars, kinds[2] / chars, kinds[3] / chars, kinds[4] / chars, kinds[6] / chars, kinds[7] / chars, kinds[8] / chars, kinds[0] / chars,
        float(lengths.mean()), float(lengths.std()), float(lengths.max()), len(count) / k, max(count.values(), default=0) / k, (first[6] + first[7]) / k, last[7] / k, float((lengths <= 3).sum()) / k, first[2] / k,
        len(words) / max(1, len(lines)), len(own) / max(1, len(lines)), sum(map(len, own)) / size, float(seen[0x2E] + seen[0x21] + seen[0x3F]) / k, float(seen[0x7C]) / k, (first[1] + first[2] + first[8]) / k,
    ]


class Trees:
    """Boosted trees of one depth in flat arrays: feature and limit by node, value by leaf."""

    def __init__(self, depth: int = 3, rounds: int = 80, rate: float = 0.1, bins: int = 64):
        self.depth, self.rounds, self.rate, self.bins = depth, rounds, rate, bins
        self.base, self.feature = 0.5, None

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.base = float(y.mean()) if len(y) else 0.5
        if not len(y) or y.min() == y.max():
            return self
        n, width = x.shape
        limits = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(width)]
        binned = np.stack([np.searchsorted(limits[f], x[:, f], side="left") for f in range(width)], 1)
        nodes, leaves = 2**self.depth - 1, 2**self.depth
        self.feature, self.limit, self.value = np.zeros((self.rounds, nodes), np.int64), np.full((self.rounds, nodes), np.inf), np.zeros((self.rounds, leaves))
        margin = np.full(n, np.log(self.base / (1 - self.base)))
        least = max(1.0, n / 2000)
        for t in range(self.rounds):
            p = logistic(margin)
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            at = np.zeros(n, np.int64)  # place within the level
            for level in range(self.depth):
                wide = 2**level
                best, pick, cut = np.zeros(wide), np.zeros(wide, np.int64), np.full(wide, self.bins)
                for f in range(width):
                    key = at * self.bins + binned[:, f]
                    gs = np.bincount(key, g, wide * self.bins).reshape(wide, self.bins).cumsum(1)
                    hs = np.bincount(key, h, wide * self.bins).reshape(wide, self.bins).cumsum(1)
                    ga, ha = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + 1) + (ga - gs) ** 2 / (ha - hs + 1) - ga**2 / (ha + 1)
                    gain[(hs < least) | (ha - hs < least)] = 0
                    top = gain.argmax(1)
                    better = gain[np.arange(wide), top] > best + 1e-9
                    best[better], pick[better], cut[better] = gain[np.arange(wide), top][better], f, top[better]
                for i in range(wide):
                    node = wide - 1 + i
                    if cut[i] < len(limits[pick[i]]):
                        self.feature[t, node], self.limit[t, node] = pick[i], limits[pick[i]][cut[i]]
                    else:
                        cut[i] = self.bins
                at = 2 * at + (binned[np.arange(n), pick[at]] > cut[at])
            gl, hl = np.bincount(at, g, leaves), np.bincount(at, h, leaves)
            self.value[t] = -self.rate * gl / (hl + 1)
            margin += self.value[t][at]
        return self

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.feature is None:
            return np.full(len(x), self.base)
        margin, rows = np.full(len(x), np.log(self.base / (1 - self.base))), np.arange(len(x))
        for feature, limit, value in zip(self.feature, self.limit, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > limit[at])
            margin += value[at - len(feature)]
        return logistic(margin)


def fitted(documents: DataFrame, labels: DataFrame, most: int = 20000) -> Trees:
    """The model, learnt from at most `most` labelled documents outside the held-out fold; only their statistics come to the driver."""
    small_batches(documents.sparkSession)
    texts = labelled_texts(documents, labels, "quality", FOLDS, FOLD, most).withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = first_of(texts.mapInArrow(measured, "x array<double>, label int, _hash long, doc_id long"), most).collect()
    return Trees().fit(np.array([r.x for r in rows], np.float64).reshape(len(rows), len(NAMES)), np.array([r.label for r in rows], np.float64))


def measured(batches):
    for batch in batches:
        x = [statistics(t.as_py()) for t in batch.column(0).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), *batch.columns[1:]], ["x", "label", "_hash", "doc_id"])


def scored(documents: DataFrame, model: Trees) -> DataFrame:
    """(doc_id, score) of every row of documents."""
    spark = documents.sparkSession
    small_batches(spark)
    sent = ship(spark, model)

    def score(batches):
        trees = sent()
        for batch in batches:
            x = np.array([statistics(t.as_py()) for t in batch.column(1).cast(pa.binary())], np.float64).reshape(batch.num_rows, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(trees.scores(x), pa.float64())], ["doc_id", "score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(score, "doc_id long, score double")


def op3_quality(spark, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = scored(documents, fitted(documents, labels))
    return out.select("doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
