"""Terms of texts without CJK, counted document by document in Arrow batches.

One pass over each text and nothing is shuffled: a document is one row, so its counts are whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from ..functions import lexicon as L

FIELDS = ("body", "title", "path", "tags")
COUNTED = "source_id string, rel_path string, len int, found array<struct<field:string,term:string,tf:int>>"
#: Characters of text counted before rows are handed on, and runs whose terms a task remembers.
SLICE, KNOWN = 1 << 22, 200_000
PART = re.compile("[A-Za-z0-9]+")
#: Characters of runs (`lexicon.RUN`) stay, every other byte becomes a space.
SPACED = bytes(b if re.fullmatch(L.RUN, chr(b)) else 0x20 for b in range(256))
LOWER_UPPER, UPPERS = re.compile("([a-z])([A-Z])"), re.compile("([A-Z]+)([A-Z][a-z])")


def last_dot(word: str) -> int:
    """Index of the last dot if it is neither first nor last, else -1."""
    at = word.rfind(".")
    return at if 0 < at < len(word) - 1 else -1


def identifier_terms(run: str) -> list[str]:
    """Terms of an identifier run, as `functions.text.identifier_terms` gives them."""
    word = run[:-1] if run[-1] == "." else run
    if word.isalnum() and word[1:] == word[1:].lower():  # a word, or one with a dot: nearly all runs
        return [t.lower() for t in ((word,) if word is run else (word, run)) if len(t) > 1]
    every: list[str] = []
    for part in PART.findall(run):
        every.append(part)
        pieces = UPPERS.sub(r"\1 \2", LOWER_UPPER.sub(r"\1 \2", part)).split(" ")
        if len(pieces) > 1:
            every += pieces
    segments, at = run.split("/") if "/" in run else [], last_dot(run)
    coarse = [run]
    if at >= 0 and not (segments and last_dot(segments[0]) >= 0 and at < len(segments[0])):
        coarse.append(run[:at])
    for s in segments:
        coarse.append(s)
        if (dot := last_dot(s)) >= 0:
            coarse += [s[:dot], s[dot + 1 :]]
    every += [c for c in coarse if not PART.fullmatch(c)]
    return [t.lower() for t in every if len(t) > 1]


def counting(only: list[str] | None = None) -> Callable[[str | None], tuple[int, dict[str, int]]]:
    """A function of a text: how many terms it has, and how often each of them (of `only`) stands there."""
    wanted = None if only is None else frozenset(only)
    known: dict[str, tuple[int, tuple[str, ...]]] = {}

    def count(text: str | None) -> tuple[int, dict[str, int]]:
        n, out = 0, {}
        for run, times in Counter((text or "").encode().translate(SPACED).decode("ascii").split()).items():
            own = known.get(run)
            if own is None:
                if len(known) >= KNOWN:
                    known.clear()
                terms = identifier_terms(run)
                own = known[run] = len(terms), tuple(t for t in terms if wanted is None or t in wanted)
            n += times * own[0]
            for term in own[1]:
                out[term] = out.get(term, 0) + times
        return n, out

    return count


def slices(batch: pa.RecordBatch, sizes: list[int], most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of at most `most` characters, or of one row."""
    first, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += size
    if first < len(sizes):
        yield batch.slice(first)


def counted(texts: DataFrame, only: list[str] | None = None) -> DataFrame:
    """(source_id, rel_path, len, found) from (source_id, rel_path, body, title, path, tags): the terms of the body, and each field's terms (of `only`) with how often they stand there."""

    def rows(batches):
        count = counting(only)
        for whole in batches:
            # byte lengths, so that one long text does not make a long piece
            sizes = [max(1, x) for x in pa.compute.binary_length(whole.column("body")).fill_null(0).to_pylist()]
            for batch in slices(whole, sizes):
                length, ends, at, terms, tfs = [], [0], [], [], []
                for texts in zip(*(batch.column(f).to_pylist() for f in FIELDS)):
                    for i, text in enumerate(texts):
                        n, own = count(text)
                        if i == 0:
                            length.append(n)
                        at.append((i, len(own)))
                        terms += own
                        tfs += own.values()
                    ends.append(len(terms))
                code, many = np.array(at, dtype=np.int32).reshape(-1, 2).T
                field = pa.DictionaryArray.from_arrays(pa.array(np.repeat(code, many)), list(FIELDS)).cast(pa.string())
                found = pa.StructArray.from_arrays([field, pa.array(terms, pa.string()), pa.array(tfs, pa.int32())], ["field", "term", "tf"])
                columns = [batch.column("source_id"), batch.column("rel_path"), pa.array(length, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)]
                yield pa.RecordBatch.from_arrays(columns, ["source_id", "rel_path", "len", "found"])

    return texts.select("source_id", "rel_path", *FIELDS).mapInArrow(rows, COUNTED)


# --- many queries at once ------------------------------------------------------------------

HIT, HIT_NAMES = "query_id long, source_id string, rel_path string, score int", ["query_id", "source_id", "rel_path", "score"]
#: Queries whose scores are held at once, and documents.
QUERIES, DOCUMENTS = 256, 4096


def best_of(rows: DataFrame, asked: list[tuple], known: list[tuple], part: Callable, top: int) -> DataFrame:
    """(query_id, source_id, rel_path, score): of every few thousand documents of `rows` (as `counted` gives them) the best `top` for each query.

    asked: (query_id, term), each once. known: (source_id, term, n, df, avgdl) of the terms that count. part: what tf postings of a field add, from arrays (field, n, df, avgdl, tf, len).
    """
    names = sorted({q for q, _ in asked})
    blocks = []
    for i in range(0, len(names), QUERIES):
        place = {q: j for j, q in enumerate(names[i : i + QUERIES])}
        mine = [(q, t) for q, t in asked if q in place]
        terms = sorted({t for _, t in mine})
        row = {t: j for j, t in enumerate(terms)}
        told = np.zeros((len(terms), len(place)), dtype=np.uint8)
        told[[row[t] for _, t in mine], [place[q] for q, _ in mine]] = 1
        blocks.append((names[i : i + QUERIES], terms, told))
    sources = sorted({k[0] for k in known})
    of = {s: [k[1:] for k in known if k[0] == s] for s in sources}

    def hits(batches):
        tables = []
        for ids, terms, told in blocks:
            row = {t: j for j, t in enumerate(terms)}
            values = {s: np.full((3, len(terms)), np.nan) for s in sources}
            for s in sources:
                for term, n, df, avgdl in of[s]:
                    if term in row:
                        values[s][:, row[term]] = n, df, avgdl
            tables.append((ids, pa.array(terms, pa.string()), told, np.stack([values[s] for s in sources]) if sources else np.empty((0, 3, len(terms)))))
        places = {s: i for i, s in enumerate(sources)}
        for whole in batches:
            for first in range(0, whole.num_rows, DOCUMENTS):
                batch = whole.slice(first, DOCUMENTS)
                source, paths, length = batch.column("source_id").to_pylist(), batch.column("rel_path").to_pylist(), batch.column("len").to_numpy(zero_copy_only=False)
                found = batch.column("found")
                flat = found.flatten()
                doc = np.repeat(np.arange(len(paths)), found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                code = np.array([places.get(s, -1) for s in source])[doc] if len(doc) else doc
                field, tf = pa.compute.index_in(flat.field("field"), value_set=pa.array(FIELDS)).to_numpy(zero_copy_only=False), flat.field("tf").to_numpy(zero_copy_only=False)
                for ids, terms, told, values in tables:
                    term = pa.compute.index_in(flat.field("term"), value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False)
                    at = np.flatnonzero((term >= 0) & (code >= 0))
                    n, df, avgdl = values[code[at], :, term[at]].T if len(at) else np.empty((3, 0))
                    added = part(field[at], n, df, avgdl, tf[at], length[doc[at]])
                    use = ~np.isnan(added)
                    at, added = at[use], added[use]
                    starts = np.searchsorted(doc[at], np.arange(len(paths) + 1))
                    sums = np.zeros((len(paths), len(ids)))
                    for j in np.flatnonzero(np.diff(starts)):
                        a, b = starts[j], starts[j + 1]
                        sums[j] = added[a:b] @ told[term[at[a:b]]]
                    score = np.where(sums > 0, np.floor(10 * sums + 0.5), -1).astype(np.int64)
                    out = []
                    for k, q in enumerate(ids):
                        own = score[:, k]
                        least = max(0, np.partition(own, -top)[-top]) if len(own) > top else 0
                        some = sorted((-int(own[j]), source[j], paths[j]) for j in np.flatnonzero(own >= least))[:top]
                        out += [(q, s, p, -x) for x, s, p in some]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.string(), pa.int32()))], HIT_NAMES)

    return rows.select("source_id", "rel_path", "len", "found").mapInArrow(hits, HIT)
