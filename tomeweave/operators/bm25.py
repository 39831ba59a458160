"""Field-weighted BM25: index, search, evidence and the older scorers.

The index is three tables: documents (length and tokens by field), postings (term, document,
field) and statistics per source. All sources are ranked in one job, each by its own statistics;
path filters act on postings after the statistics are taken.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType

from ..functions import lexicon as L
from ..functions import text as T
from ..functions.vectors import half_up
from . import counts

KEY = ("source_id", "rel_path")


def fields(entries: DataFrame, compiled: DataFrame | None = None) -> DataFrame:
    """(source_id, rel_path, field, text): body with the path as first line, title, path, tags, and fields of `compiled` (source_id, rel_path, field, text)."""
    path = T.bracketed(F.col("rel_path"))
    own = F.array(
        F.struct(F.lit("body").alias("field"), F.concat(path, F.lit("\n"), F.coalesce("content", F.lit(""))).alias("text")),
        F.struct(F.lit("title").alias("field"), F.col("title").alias("text")),
        F.struct(F.lit("path").alias("field"), path.alias("text")),
        F.struct(F.lit("tags").alias("field"), F.array_join("tags", " ").alias("text")),
    )
    out = entries.where("content is not null").select(*KEY, F.inline(own))
    if compiled is not None:
        out = out.unionByName(compiled.join(entries.select(*KEY), list(KEY), "left_semi").select(*KEY, "field", "text").where("text <> ''"))
    return out


@dataclass
class Index:
    docs: DataFrame  # source_id, rel_path, len
    postings: DataFrame  # source_id, term, rel_path, field, tf, token_weight; len if it is at hand
    stats: DataFrame  # source_id, n, avgdl
    rows: DataFrame | None = None  # source_id, rel_path, len, found: all of it, a row for each document

    def of(self, terms: list[str]) -> DataFrame:
        return self.postings.where(F.col("term").isin(terms))

    def regrouped(self, source: Column) -> Index:
        """The same documents under other sources."""
        docs = self.docs.withColumn("source_id", source)
        return Index(docs, self.postings.withColumn("source_id", source), statistics(docs), self.rows and self.rows.withColumn("source_id", source))

    def measured(self, postings: DataFrame) -> DataFrame:
        """postings with their document's length."""
        return postings if "len" in postings.columns else postings.join(self.docs, list(KEY))


def statistics(docs: DataFrame) -> DataFrame:
    return docs.groupBy("source_id").agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"))


def counted(entries: DataFrame, only: list[str] | None = None) -> DataFrame:
    """(source_id, rel_path, len, found): a row for each document with its terms (of `only`) counted by field, for collections without CJK text."""
    path = T.bracketed(F.col("rel_path"))
    body = F.concat(path, F.lit("\n"), F.coalesce("content", F.lit("")))
    return counts.counted(entries.where("content is not null").select(*KEY, body.alias("body"), "title", path.alias("path"), F.array_join("tags", " ").alias("tags")), only)


def repeated(rows: DataFrame) -> bool:
    """Whether any key stands in several rows."""
    return not rows.groupBy(*KEY).count().where("count > 1").isEmpty()


def index_of_counts(rows: DataFrame, again: bool) -> Index:
    """An index from rows as `counted` gives them. again: whether keys are repeated; only then their counts are added up, else each row has whole counts and its length beside them."""
    docs, weight = rows.select(*KEY, "len"), F.lit(L.WEIGHTS["identifier"])
    if again:
        each = rows.select(*KEY, F.inline("found"))
        postings = each.groupBy("source_id", "term", "rel_path", "field").agg(F.sum("tf").cast("int").alias("tf")).withColumn("token_weight", weight)
        return Index(docs, postings, statistics(docs))
    postings = rows.select(*KEY, "len", F.inline("found")).select("source_id", "term", "rel_path", "field", "tf", weight.alias("token_weight"), "len")
    return Index(docs, postings, statistics(docs), rows)


def index_of_tokens(tokens: DataFrame) -> Index:
    """An index from (source_id, rel_path, field, tokens) as the analyser gives them."""
    docs = tokens.where("field = 'body'").select(*KEY, F.size("tokens").alias("len"))
    each = tokens.select(*KEY, "field", F.inline("tokens"))
    postings = each.groupBy("source_id", F.col("normalized").alias("term"), "rel_path", "field").agg(
        F.countDistinct("start", "end").cast("int").alias("tf"),
        F.max("weight").alias("token_weight"),
        F.array_sort(F.collect_set("position")).alias("positions"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"),
    )
    return Index(docs, postings, statistics(docs))


def plain_index(entries: DataFrame, only: list[str] | None = None) -> Index:
    """An index by one pass over each text, for collections without CJK text; `only` keeps postings of some terms."""
    return index_of_counts(counted(entries, only), repeated(entries.where("content is not null")))


def frequencies(index: Index) -> DataFrame:
    """(source_id, term, df): in how many documents of each source a term stands, in whatever field."""
    if index.rows is None:
        return index.postings.select("source_id", "term", "rel_path").distinct().groupBy("source_id", "term").agg(F.count("*").alias("df"))
    once = F.array_distinct(F.transform("found", lambda x: x["term"]))
    return index.rows.select("source_id", F.explode(once).alias("term")).groupBy("source_id", "term").agg(F.count("*").alias("df"))


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def saturation(tf: Column, length: Column, avgdl: Column) -> Column:
    return tf * (L.K1 + 1) / (tf + L.K1 * (1 - L.B + L.B * length / avgdl))


def field_weight(field: Column) -> Column:
    out = F.lit(1.0)
    for name, weight in L.FIELD_WEIGHTS.items():
        out = F.when(field == name, F.lit(weight)).otherwise(out)
    return out


def scored_postings(index: Index, query: dict[str, float], include: Column | None = None, protected: tuple[str, ...] = L.PROTECTED) -> DataFrame:
    """Each posting of the query's terms with what it adds to its document's score. include: a condition on rel_path and source_id."""
    found = index.of(list(query))
    df = found.groupBy("source_id", "term").agg(F.countDistinct("rel_path").alias("df"))
    weight = F.lit(0.0)
    for term, w in query.items():
        weight = F.when(F.col("term") == term, F.lit(float(w))).otherwise(weight)
    known = df.join(index.stats, "source_id").where((F.col("n") <= 1) | (F.col("df") < L.NOISE_SHARE * F.col("n")) | F.col("term").isin(*protected))
    rows = found.where(include) if include is not None else found
    rows = index.measured(rows.join(known, ["source_id", "term"])).where("avgdl > 0").withColumn("query_weight", weight)
    lexical = F.least(F.lit(L.LEXICAL_MOST), F.greatest(F.lit(L.LEXICAL_LEAST), F.sqrt(F.col("query_weight") * F.col("token_weight"))))
    part = field_weight(F.col("field")) * idf(F.col("n"), F.col("df")) * saturation(F.col("tf"), F.col("len"), F.col("avgdl")) * lexical
    return rows.withColumn("lexical_weight", lexical).withColumn("part", part)


def search(index: Index, query: dict[str, float], top: int | None = 200, include: Column | None = None) -> DataFrame:
    """(source_id, rel_path, score, rank): the best `top` documents of each source; ties go to the smaller path."""
    scores = scored_postings(index, query, include).groupBy(*KEY).agg(half_up(10 * F.sum("part")).alias("score")).where("score > 0")
    ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("score"), "rel_path")))
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def evidence(index: Index, query: dict[str, float], include: Column | None = None) -> DataFrame:
    """(source_id, rel_path, term, df, query_weight, document_weight, fields, contribution, place): why a document was found."""
    rows = scored_postings(index, query, include).groupBy(*KEY, "term").agg(
        F.max("df").alias("df"), F.max("query_weight").alias("query_weight"), F.max("token_weight").alias("document_weight"), F.max("lexical_weight").alias("lexical_weight"), F.array_join(F.array_sort(F.collect_set("field")), ",").alias("fields"), F.round(F.sum("part"), 4).alias("contribution"),
    )
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("contribution"), "term")))


#: Asked terms that are sent to tasks, (query, term) pairs, and terms by source that count; with more, postings are joined.
MOST_TERMS, MOST_ASKED, MOST_KNOWN = 100_000, 1_000_000, 1_000_000


def asked_terms(queries: DataFrame) -> list[str] | None:
    """The distinct terms of a table of queries (terms), none if they are more than `MOST_TERMS`."""
    found = queries.select(F.explode("terms").alias("term")).distinct().limit(MOST_TERMS + 1).collect()
    return None if len(found) > MOST_TERMS else sorted(r.term for r in found)


def batch(index: Index, queries: DataFrame, top: int = 10) -> DataFrame:
    """(query_id, source_id, rel_path, score, rank) for a table of queries (query_id, terms), each term once; statistics are shared by all."""
    asked = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "source_id", "rel_path")
    scores = _scores_by_rows(index, asked, top)
    if scores is None:
        scores = _scores_by_joins(index, asked)
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


def _known(index: Index, df: DataFrame) -> DataFrame:
    return df.join(index.stats, "source_id").where((F.col("n") <= 1) | (F.col("df") < L.NOISE_SHARE * F.col("n")))


def _scores_by_joins(index: Index, asked: DataFrame) -> DataFrame:
    mine = index.postings.join(asked.select("term").distinct(), "term")
    known = _known(index, mine.groupBy("source_id", "term").agg(F.countDistinct("rel_path").alias("df")))
    part = field_weight(F.col("field")) * idf(F.col("n"), F.col("df")) * saturation(F.col("tf"), F.col("len"), F.col("avgdl")) * F.least(F.lit(L.LEXICAL_MOST), F.sqrt(F.lit(L.WEIGHTS["identifier"]) * F.col("token_weight")))
    by_term = index.measured(mine.join(known, ["source_id", "term"])).groupBy("term", *KEY).agg(F.sum(part).alias("part"))
    return asked.join(by_term, "term").groupBy("query_id", *KEY).agg(half_up(10 * F.sum("part")).alias("score"))


def _scores_by_rows(index: Index, asked: DataFrame, top: int) -> DataFrame | None:
    """The best of every few thousand documents, scored where they lie: pairs of query and document are never shuffled. None if there are no such rows or too many queries for it."""
    if index.rows is None or asked.schema["query_id"].dataType not in (LongType(), IntegerType()):
        return None
    pairs = asked.where("query_id is not null").limit(MOST_ASKED + 1).collect()
    if len(pairs) > MOST_ASKED or len(terms := {p.term for p in pairs}) > MOST_TERMS or len(pairs) < asked.count():
        return None
    spark = asked.sparkSession
    mine = frequencies(index).join(F.broadcast(spark.createDataFrame([(t,) for t in terms], "term string")), "term", "left_semi")
    known = [tuple(r) for r in _known(index, mine).select("source_id", "term", "n", "df", "avgdl").limit(MOST_KNOWN + 1).collect()]
    if len(known) > MOST_KNOWN:
        return None
    fields = np.array([L.FIELD_WEIGHTS[f] for f in counts.FIELDS])
    lexical, k1, b = min(L.LEXICAL_MOST, L.WEIGHTS["identifier"]), L.K1, L.B

    def part(field, n, df, avgdl, tf, length):
        return fields[field] * np.log((n - df + 0.5) / (df + 0.5) + 1) * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avgdl))) * lexical

    return counts.best_of(index.rows, [tuple(p) for p in pairs], known, part, top)


def contains(needle: str):
    return lambda text: F.contains(F.lower(text), F.lit(needle))


def legacy_scores(index: Index, entries: DataFrame, query: list[str]) -> DataFrame:
    """(source_id, rel_path, score): boosts for title, path and tags, and BM25 of the body alone; terms in over `NOISE_SHARE` of the documents are left out."""
    body = index.of(query).where("field = 'body'")
    df = body.groupBy("source_id", "term").agg(F.count("*").alias("df")).join(index.stats, "source_id").where(F.col("df") < L.NOISE_SHARE * F.col("n"))
    asked = F.lit(0)
    for term in query:
        asked = asked + F.when(F.col("term") == term, 1).otherwise(0)
    rows = index.measured(body.join(df, ["source_id", "term"]))
    bm = rows.groupBy(*KEY).agg(F.sum(asked * idf(F.col("n"), F.col("df")) * saturation(F.col("tf"), F.col("len"), F.col("avgdl"))).alias("bm"))
    boost = F.lit(0.0)
    for term in query:
        has = contains(term)
        boost = boost + F.when(has(F.col("title")), 10.0).otherwise(0.0) + F.when(has(F.col("rel_path")), 5.0 / len(query)).otherwise(0.0) + F.when(F.exists("tags", has), 3.0).otherwise(0.0)
    total = boost + 10 * F.coalesce("bm", F.lit(0.0))
    return entries.join(bm, list(KEY), "left").select(*KEY, total.alias("total")).where("total > 0").select(*KEY, half_up(F.col("total")).alias("score"))


def substring_scores(entries: DataFrame, query: str) -> DataFrame:
    """(source_id, rel_path, score): 10 for the title, 5 for the path, 3 for tags, and 1 and up to 4 more for the text."""
    q = query.lower()
    low = F.lower(F.coalesce("content", F.lit("")))
    # occurrences may overlap
    count = F.least(F.lit(5), F.regexp_count(low, F.lit("(?=" + "".join(f"\\x{{{ord(c):x}}}" for c in q) + ")")))
    count = F.when(F.coalesce(F.col("content"), F.lit("")) == "", 0).otherwise(F.when(count > 0, 1).otherwise(0) + F.least(count - 1, F.lit(9)))
    has = contains(q)
    score = F.when(has(F.col("title")), 10).otherwise(0) + F.when(has(F.col("rel_path")), 5).otherwise(0) + F.when(F.exists("tags", has), 3).otherwise(0) + count
    return entries.select(*KEY, score.cast("int").alias("score")).where("score > 0")
