"""The analyser with offsets: identifiers, CJK segments, domain terms, stop words, weights and positions.

Offsets are in characters. It runs in Arrow batches; collections without CJK text can use the
expressions of `functions.text` instead, which give the same terms.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L

SPANS = re.compile(f"(?P<ascii>{L.RUN})|(?P<cjk>[{L.CJK}]+)")
ALNUM = re.compile("[A-Za-z0-9]+")
WORDLIKE = re.compile("[A-Za-z0-9_]")
TOKENS = "array<struct<normalized:string,start:int,end:int,position:int,weight:double,sources:array<string>,protected:boolean>>"


@dataclass(frozen=True)
class Token:
    normalized: str
    start: int
    end: int
    source: str
    base: float
    stop: float = 1.0
    confidence: float = 1.0
    protected: bool = False
    sources: tuple[str, ...] = ()
    position: int = 0

    @property
    def weight(self) -> float:
        raw = self.base * self.stop * self.confidence
        return min(L.MOST_WEIGHT, max(L.LEAST_WEIGHT, raw)) if raw > 0 else 0.0


def bigrams(text: str) -> list[tuple[int, int]]:
    return [(0, 1)] if len(text) == 1 else [(i, i + 2) for i in range(len(text) - 1)]


def longest_words(words: Iterable[str]) -> Callable[[str], list[tuple[int, int]]]:
    """A segmenter that takes the longest known word at each place, else one character."""
    known = frozenset(words)
    longest = max(map(len, known), default=1)

    def cut(text: str) -> list[tuple[int, int]]:
        out, at = [], 0
        while at < len(text):
            size = next((n for n in range(min(longest, len(text) - at), 1, -1) if text[at : at + n] in known), 1)
            out.append((at, at + size))
            at += size
        return out

    return cut


def camel_spans(word: str) -> list[tuple[int, int]]:
    marked = re.sub("([A-Z]+)([A-Z][a-z])", r"\1 \2", re.sub("([a-z])([A-Z])", r"\1 \2", word))
    out, at = [], 0
    for piece in marked.split(" "):
        out.append((at, at + len(piece)))
        at += len(piece)
    return out


def identifier_spans(run: str) -> list[tuple[int, int]]:
    """Distinct spans of two characters or more that an identifier run gives."""
    spans = [(0, len(run))]
    for m in ALNUM.finditer(run):
        spans.append(m.span())
        camel = camel_spans(m[0])
        spans += [(m.start() + a, m.start() + b) for a, b in camel] if len(camel) > 1 else []
    dot = run.rfind(".")
    if 0 < dot < len(run) - 1:
        spans.append((0, dot))
    if "/" in run:
        at = 0
        for part in run.split("/"):
            spans.append((at, at + len(part)))
            dot = part.rfind(".")
            if 0 < dot < len(part) - 1:
                spans += [(at, at + dot), (at + dot + 1, at + len(part))]
            at += len(part) + 1
    return list(dict.fromkeys(s for s in spans if s[1] - s[0] > 1))


def lowered(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


@dataclass(frozen=True)
class Analyser:
    """segmenter: dictionary segmenter of CJK runs; without one they are cut into bigrams."""

    segmenter: Callable[[str], list[tuple[int, int]]] | None = None
    recall: bool = True
    domain: tuple[tuple[str, float, str], ...] | None = L.DOMAIN
    weights: dict[str, float] = field(default_factory=lambda: dict(L.WEIGHTS))
    relief: float = L.RELIEF

    def status(self) -> dict[str, str]:
        return {"requested": "dictionary", "active": "dictionary" if self.segmenter else "bigram"}

    def _segments(self, run: str):
        cut = self.segmenter(run) if self.segmenter else []
        for a, b in cut:
            yield a, b, "dictionary"
        if not cut or self.recall:
            for a, b in bigrams(run):
                yield a, b, "unigram" if b - a == 1 else "bigram"

    def _domain(self, text: str):
        low = lowered(text)
        for term, weight, kind in self.domain or ():
            plain, at = re.fullmatch("[A-Za-z0-9_]+", term), low.find(term.lower())
            while at >= 0:
                end = at + len(term)
                if not plain or not (WORDLIKE.match(text[at - 1 : at]) or WORDLIKE.match(text[end : end + 1])):
                    yield Token(term.lower(), at, end, "identifier" if kind == "identifier" else "domain", weight)
                at = low.find(term.lower(), at + 1)

    def _candidates(self, text: str):
        for m in SPANS.finditer(text):
            if m.lastgroup == "ascii":
                for a, b in identifier_spans(m[0]):
                    yield Token(m[0][a:b].lower(), m.start() + a, m.start() + b, "identifier", self.weights["identifier"])
            else:
                for a, b, source in self._segments(m[0]):
                    yield Token(m[0][a:b], m.start() + a, m.start() + b, source, self.weights[source])
        yield from self._domain(text)

    def _weighed(self, t: Token, name: str | None) -> Token:
        if t.normalized in L.PROTECTED:
            return Token(t.normalized, t.start, t.end, t.source, max(t.base, self.weights["protected"]), 1.0, t.confidence, True)
        stop = 0.0 if t.normalized in L.HARD else L.SOFT.get(t.normalized, 1.0)
        if 0 < stop < 1 and name in L.RELIEF_FIELDS:
            stop += (1 - stop) * self.relief
        return Token(t.normalized, t.start, t.end, t.source, t.base, stop, t.confidence)

    def __call__(self, text: str | None, name: str | None = None) -> list[Token]:
        """Tokens in order; positions count distinct starts, those of suppressed tokens included."""
        best: dict[tuple, Token] = {}
        sources: dict[tuple, dict[str, None]] = {}
        for t in self._candidates(text or ""):
            t, key = self._weighed(t, name), (t.normalized, t.start, t.end)
            sources.setdefault(key, {})[t.source] = None
            if key not in best or t.weight > best[key].weight:
                best[key] = t
        ordered = sorted(best.values(), key=lambda t: (t.start, -t.weight, t.start - t.end, t.normalized))
        place = {s: i for i, s in enumerate(sorted({t.start for t in ordered}))}
        return [Token(**{**t.__dict__, "position": place[t.start], "sources": tuple(sources[t.normalized, t.start, t.end])}) for t in ordered if t.weight > 0]

    def terms(self, text: str | None, name: str | None = None) -> list[str]:
        return [t.normalized for t in self(text, name)]

    def query(self, text: str) -> dict[str, float]:
        """The weight of each term of a query, in order."""
        out: dict[str, float] = {}
        for t in self(text):
            out[t.normalized] = max(out.get(t.normalized, 0.0), t.weight)
        return out


def analysed(text: Column, name: Column, analyser: Analyser) -> Column:
    """The tokens of a text of the named field."""

    @F.pandas_udf(TOKENS)
    def tokens(texts: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([[{"normalized": t.normalized, "start": t.start, "end": t.end, "position": t.position, "weight": t.weight, "sources": list(t.sources), "protected": t.protected} for t in analyser(x, n)] for x, n in zip(texts, names)])

    return tokens(text, name)


def domain_places(text: Column, analyser: Analyser) -> Column:
    """Where the analyser's domain terms stand in a text, overlaps included."""

    @F.pandas_udf("array<struct<term:string,start:int,weight:double>>")
    def places(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: [{"term": t.normalized, "start": t.start, "weight": t.base} for t in analyser._domain(x or "")])

    return places(text)


def tokens_of(fields: DataFrame, analyser: Analyser | None = None) -> DataFrame:
    """(source_id, rel_path, field, tokens) of (source_id, rel_path, field, text)."""
    return fields.select("source_id", "rel_path", "field", analysed(F.col("text"), F.col("field"), analyser or Analyser()).alias("tokens"))
