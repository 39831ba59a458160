"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

Words are ASCII letters and digits (A-Z lower-cased) and all characters beyond ASCII. Each word
is its CRC-32; hashes seen in at least `least_docs` training documents own an embedding, all
others share a zero one, so unseen words cannot collide with learnt ones. Filters one, two and
three words wide slide over the whole text, their maxima over the text pass a ReLU and a
logistic output. Embeddings start from the smoothed log-odds of the word among labelled
documents. Only the positions of the maxima receive gradients, so training costs little.

The classifier is fitted on at most `most` labelled documents (those of smallest hash) of together
at most `most_words` words: taken in order of their hash, each as a whole, until the next would pass
the bound; only that sample, 4 bytes a word, comes to the driver. A fifth of them is kept apart to
pick the epoch and, by language, the threshold from which a document is rejected, between 0.3 and 0.7;
a language with too few labelled documents takes the common threshold. lang never enters a score.

Null and empty texts have no words and get the score of a text of unknown words. Without labels
of both kinds every score is the share of toxic labels (0 without labels). Repeated rows are
scored alike. Texts of any length are read whole, in pieces that overlap by two words. Columns
other than doc_id, text and lang are kept by the filter and ignored otherwise.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import first_of, held_out, labelled_texts, logistic, packed, settle, ship, small_batches, table, unpacked, widened, words_of

WIDTHS, FILTERS, DIM = (1, 2, 3), 8, 8
PIECE = 1 << 16
FOLDS, FOLD = 5, 0


def hashes(text: str | None) -> np.ndarray:
    """The CRC-32 of each word."""
    words = words_of((text or "").encode())
    return np.fromiter(map(zlib.crc32, words), np.uint32, len(words))


class Rows(dict):
    """Word to row of the embedding table, 0 if unknown; remembers up to a million words."""

    def __init__(self, hashes: dict[int, int]):
        self.hashes = hashes

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        row = self[word] = self.hashes.get(zlib.crc32(word), 0)
        return row


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One array of all documents' words, each followed by two zero words (three if it has none); where each starts."""
    parts, starts, at = [], [], 0
    for r in rows:
        starts.append(at)
        pad = np.zeros(2 + (len(r) == 0), np.int32)
        parts += [r, pad]
        at += len(r) + len(pad)
    return np.concatenate(parts), np.array(starts)


def convolved(z: np.ndarray, width: int, ends: np.ndarray) -> np.ndarray:
    """Sums of a filter's parts over consecutive words; the two positions before each end can't be a maximum."""
    out = z[:, :FILTERS].copy()
    for i in range(1, width):
        out[:-i] += z[i:, i * FILTERS : (i + 1) * FILTERS]
    out[ends - 1] = out[ends - 2] = -1e9
    return out


class Convolution:
    """The network; `fit` trains it, `scores` applies it to lists of word lists."""

    def __init__(self, prior: float = 0.0):
        self.prior, self.hashes, self.tables = prior, None, None
        self.thresholds: dict[str | None, float] = {}

    # --- training ---------------------------------------------------------------------
    def fit(self, hashed: list[np.ndarray], y: np.ndarray, langs: list, least_docs: int = 3, epochs: int = 8, seed: int = 11) -> Convolution:
        self.prior = float(y.mean()) if len(y) else 0.0
        if not len(y) or y.min() == y.max():
            return self
        rng = np.random.default_rng(seed)
        kept = np.zeros(len(y), bool)
        if len(y) >= 500:
            kept[::5] = True
        learn = np.flatnonzero(~kept)
        counted = lambda ids: np.unique(np.concatenate([np.unique(hashed[i]) for i in ids]), return_counts=True)
        words, docs_with = counted(learn)
        toxic, n = counted(learn[y[learn] == 1])
        toxic_with = np.zeros(len(words))
        toxic_with[np.searchsorted(words, toxic)] = n
        often = docs_with >= least_docs
        words, docs_with, toxic_with = words[often], docs_with[often], toxic_with[often]
        prior = float(y[learn].mean())
        rate = (toxic_with + 10 * prior) / (docs_with + 10)
        odds = np.log(rate / (1 - rate)) - np.log(prior / (1 - prior))
        self.hashes = dict(zip(words.tolist(), range(1, len(words) + 1)))
        known = np.append(words, np.uint32(0))  # a place for what is beyond the last

        def numbered(x: np.ndarray) -> np.ndarray:
            i = np.searchsorted(words, x)
            return np.where((known[i] == x) & (i < len(words)), i + 1, 0).astype(np.int32)

        rows = [numbered(x) for x in hashed]
        e = np.zeros((len(words) + 1, DIM), np.float32)
        e[1:] = rng.normal(0, 0.05, (len(words), DIM))
        e[1:, 0] = np.clip(odds, -1, 5) / 2
        w = [rng.normal(0, 0.2, (n, DIM, FILTERS)).astype(np.float32) for n in WIDTHS]
        for x in w:
            x[0, 0, : FILTERS // 2] += 1
        params = {"b": np.full(FILTERS * len(WIDTHS), -0.5, np.float32), "u": np.full(FILTERS * len(WIDTHS), 0.15, np.float32), "u0": np.array([np.log(prior / (1 - prior))], np.float32)} | {f"w{i}": x for i, x in enumerate(w)}
        m, v = ({k: np.zeros_like(x) for k, x in params.items()} for _ in range(2))
        seen = np.full((len(words) + 1, 1), 1e-3, np.float32)
        best, step = (np.inf, None), 0
        for _ in range(epochs):
            order = rng.permutation(learn)
            for at in range(0, len(order), 64):
                batch = order[at : at + 64]
                step += 1
                grads, ids, de = self._gradients(params, e, [rows[i] for i in batch], y[batch])
                for k, g in grads.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    params[k] -= 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-7)
                seen[ids] += (de * de).mean(1, keepdims=True)
                e[ids] -= 0.02 * de / np.sqrt(seen[ids])
            self._table(params, e)
            if kept.any():
                s = self._scores([rows[i] for i in np.flatnonzero(kept)])
                t = y[kept]
                loss = -np.mean(np.where(t > 0, np.log(s + 1e-6), np.log(1 - s + 1e-6)))
                if loss < best[0]:
                    best = loss, (self.tables, self.out)
        if best[1]:
            self.tables, self.out = best[1]
        at = np.flatnonzero(kept) if kept.any() else np.arange(len(y))
        self._calibrate(self._scores([rows[i] for i in at]), y[at], [langs[i] for i in at])
        return self

    def _gradients(self, p: dict, e: np.ndarray, rows: list[np.ndarray], y: np.ndarray):
        token, starts = padded(rows)
        ends = np.append(starts[1:], len(token))
        x = e[token]
        doc = np.repeat(np.arange(len(rows)), ends - starts)
        tops, places = [], []
        for i, n in enumerate(WIDTHS):
            c = convolved(x @ p[f"w{i}"].transpose(1, 0, 2).reshape(DIM, n * FILTERS), n, ends)
            top = np.maximum.reduceat(c, starts)
            at, f = np.nonzero(c == top[doc])
            _, first = np.unique(doc[at] * FILTERS + f, return_index=True)
            tops.append(top)
            places.append(at[first].reshape(len(rows), FILTERS))
        pre = np.concatenate(tops, 1) + p["b"]
        h = np.maximum(pre, 0)
        wanted = 0.03 + 0.94 * y
        d = ((logistic(h @ p["u"] + p["u0"]) - wanted) / len(y)).astype(np.float32)
        dh = d[:, None] * p["u"] * (pre > 0)
        grads = {"u": h.T @ d + 1e-4 * p["u"], "u0": d.sum(keepdims=True), "b": dh.sum(0)}
        ids, de = [], []
        for i, n in enumerate(WIDTHS):
            g = dh[:, i * FILTERS : (i + 1) * FILTERS]
            dw = np.zeros_like(p[f"w{i}"])
            for j in range(n):
                at = places[i] + j
                dw[j] = np.einsum("bf,bfd->df", g, x[at])
                ids.append(token[at].ravel())
                de.append((g[:, :, None] * p[f"w{i}"][j].T[None]).reshape(-1, DIM))
            grads[f"w{i}"] = dw + 1e-4 * p[f"w{i}"]
        ids, inverse = np.unique(np.concatenate(ids), return_inverse=True)
        total = np.zeros((len(ids), DIM), np.float32)
        np.add.at(total, inverse, np.concatenate(de))
        known = ids > 0
        return grads, ids[known], total[known]

    def _table(self, p: dict, e: np.ndarray) -> None:
        """Each word's part in each filter, so that scoring only looks up and adds."""
        self.tables = [e @ p[f"w{i}"].transpose(1, 0, 2).reshape(DIM, n * FILTERS) for i, n in enumerate(WIDTHS)]
        self.out = p["b"].copy(), p["u"].copy(), float(p["u0"][0])

    def _calibrate(self, s: np.ndarray, y: np.ndarray, langs: list) -> None:
        def best(s, y):
            order = np.argsort(-s, kind="stable")
            hit = np.cumsum(y[order])
            f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
            k = int(np.argmax(f1))
            low = s[order[k + 1]] if k + 1 < len(s) else 0.0
            return float(np.clip((s[order[k]] + low) / 2, 0.3, 0.7))

        common = best(s, y) if y.sum() >= 5 else 0.5
        self.thresholds = {None: common}
        for lang in {x for x in langs if x is not None}:
            own = np.array([x == lang for x in langs])
            if own.sum() >= 50 and y[own].sum() >= 10:
                self.thresholds[lang] = best(s[own], y[own])

    # --- scoring ----------------------------------------------------------------------
    def _pooled(self, rows: list[np.ndarray]) -> np.ndarray:
        token, starts = padded(rows)
        ends = np.append(starts[1:], len(token))
        return np.concatenate([np.maximum.reduceat(convolved(t[token], n, ends), starts) for n, t in zip(WIDTHS, self.tables)], 1)

    def _scores(self, rows: list[np.ndarray]) -> np.ndarray:
        if not rows:
            return np.empty(0)
        pieces, owner = [], []
        for i, r in enumerate(rows):
            for at in range(0, max(1, len(r)), PIECE):
                pieces.append(r[at : at + PIECE + max(WIDTHS) - 1])
                owner.append(i)
        top = np.full((len(rows), FILTERS * len(WIDTHS)), -1e9, np.float32)
        at = 0
        while at < len(pieces):
            to, size = at, 0
            while to < len(pieces) and (to == at or size + len(pieces[to]) <= PIECE):
                size += len(pieces[to])
                to += 1
            np.maximum.at(top, owner[at:to], self._pooled(pieces[at:to]))
            at = to
        b, u, u0 = self.out
        return logistic(np.maximum(top + b, 0).astype(np.float64) @ u + u0)

    def scores(self, texts, known: Rows | None = None) -> np.ndarray:
        if self.hashes is None:
            return np.full(len(texts), self.prior)
        known = known if known is not None else Rows(self.hashes)
        rows = []
        for t in texts:
            words = words_of(t)
            rows.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
        return self._scores(rows)


def fitted(documents: DataFrame, labels: DataFrame, most: int = 8000, most_words: int = 6_000_000) -> Convolution:
    """The classifier, learnt from labelled documents outside the held-out fold: at most `most` and `most_words` words."""
    if "lang" not in documents.columns:
        documents = documents.withColumn("lang", F.lit(None).cast("string"))
    small_batches(documents.sparkSession)
    texts = labelled_texts(documents, labels, "toxic", FOLDS, FOLD, most, "lang").withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("lang", F.col("lang").cast("string"))
    sample = settle(first_of(texts.mapInArrow(hashed_words, "words binary, label int, _hash long, doc_id long, lang string"), most).withColumn("n", F.octet_length("words") / 4), "toxicity-sample")
    # at most `most` numbers: a running sum of the words, in one place
    upto = F.sum("n").over(Window.orderBy("_hash", "doc_id", "n").rowsBetween(Window.unboundedPreceding, 0))
    last = sample.select("_hash", "doc_id", "n", upto.alias("upto")).where(F.col("upto") <= most_words).agg(F.max(F.struct("_hash", "doc_id", "n")).alias("m")).first().m
    within = F.lit(False) if last is None else F.struct("_hash", "doc_id", "n") <= F.struct(F.lit(last[0]).cast("long"), F.lit(last[1]).cast("long"), F.lit(last[2]).cast("double"))
    sample = sample.where(within).orderBy("_hash", "doc_id", "n").select("words", "label", "lang").toArrow()
    rows = [np.frombuffer(w.as_py(), np.uint32) for w in sample.column(0)]  # views of the sample
    return Convolution().fit(rows, np.array(sample.column(1).to_pylist(), np.int64), sample.column(2).to_pylist())


def hashed_words(batches):
    """The texts of a sample as their words' hashes, 4 bytes each."""
    for batch in batches:
        words = [hashes(t.as_py()).tobytes() for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), *batch.columns[1:]], ["words", *batch.schema.names[1:]])


def scored(documents: DataFrame, model: Convolution) -> DataFrame:
    """`_row` with all columns of documents, and `_score` (0 to 1)."""
    spark = documents.sparkSession
    small_batches(spark)
    sent = ship(spark, model)
    at = documents.columns.index("text")
    rows = packed(documents)

    def score(batches):
        net = sent()
        known = Rows(net.hashes or {})
        for batch in batches:
            texts = [t.as_py() for t in batch.column(0).field(at).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(net.scores(texts, known), pa.float64())], ["_row", "_score"])

    return rows.mapInArrow(score, widened(rows, "_score", DoubleType()))


def threshold(model: Convolution, lang):
    """The rejection threshold of a language, as an expression."""
    out = F.lit(model.thresholds.get(None, 0.5))
    for name, value in sorted((k, v) for k, v in model.thresholds.items() if k is not None):
        out = F.when(lang == name, F.lit(value)).otherwise(out)
    return out


def keep_clean(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents whose score is under their language's threshold, columns as they were."""
    model = fitted(documents, labels)
    lang = F.col("_row.lang") if "lang" in documents.columns else F.lit(None).cast("string")
    return scored(documents, model).where(F.col("_score") < threshold(model, lang)).select(*unpacked(documents.columns))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fitted(documents, labels)
    out = scored(documents.select("doc_id", "text", "lang"), model)
    return out.select(
        "_row.doc_id",
        held_out(F.col("_row.doc_id"), FOLDS, FOLD).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"),
        threshold(model, F.col("_row.lang")).alias("threshold"),
        (F.col("_score") >= threshold(model, F.col("_row.lang"))).alias("rejected"),
    )
