"""Queries on entries, paths and tokens, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..operators import bm25
from ..sources.corpus import documents, entries, table

ENTRIES = r"""
entries AS (
  SELECT source AS source_id, concat(lang, '/', doc_id, '.md') AS rel_path, substr(split_part(text, chr(10), 1), 1, 60) AS title, lang AS tag, text AS content, doc_id FROM documents)"""
#: Terms of an identifier run `run`, one for each distinct span.
TERMS = r"""
list_filter(list_transform(list_concat(
  flatten(list_transform(regexp_extract_all(run, '[A-Za-z0-9]+'), lambda p: CASE WHEN len(string_split(regexp_replace(regexp_replace(p, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), ' ')) > 1
    THEN list_concat([p], string_split(regexp_replace(regexp_replace(p, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), ' ')) ELSE [p] END)),
  list_filter(list_concat(
    [run],
    CASE WHEN regexp_matches(run, '^.+\.[^.]+$') AND NOT (contains(run, '/') AND regexp_matches(string_split(run, '/')[1], '^.+\.[^.]+$') AND NOT contains(substr(run, len(string_split(run, '/')[1]) + 1), '.')) THEN [regexp_extract(run, '^(.+)\.[^.]+$', 1)] ELSE [] END,
    CASE WHEN contains(run, '/') THEN flatten(list_transform(string_split(run, '/'), lambda s: CASE WHEN regexp_matches(s, '^.+\.[^.]+$') THEN [s, regexp_extract(s, '^(.+)\.[^.]+$', 1), regexp_extract(s, '^.+\.([^.]+)$', 1)] ELSE [s] END)) ELSE [] END),
    lambda c: NOT regexp_matches(c, '^[A-Za-z0-9]*$'))), lambda t: lower(t)), lambda t: len(t) > 1)"""
RUNS = "regexp_extract_all(txt, '[A-Za-z0-9_./-]+')"
POSTINGS = (
    ENTRIES
    + rf""",
fields AS (
  SELECT source_id, rel_path, 'body' AS field, concat('[', tag, ' > ', doc_id, ']', chr(10), content) AS txt FROM entries UNION ALL SELECT source_id, rel_path, 'title', title FROM entries
  UNION ALL SELECT source_id, rel_path, 'path', concat('[', tag, ' > ', doc_id, ']') FROM entries UNION ALL SELECT source_id, rel_path, 'tags', tag FROM entries),
runs AS (SELECT source_id, rel_path, field, unnest({RUNS}) AS run FROM fields),
terms AS (SELECT source_id, rel_path, field, unnest({TERMS}) AS term FROM runs),
postings AS (SELECT source_id, rel_path, field, term, count(*) AS tf FROM terms GROUP BY source_id, rel_path, field, term),
docs AS (SELECT entries.source_id, entries.rel_path, coalesce(n, 0) AS len FROM entries LEFT JOIN (SELECT source_id, rel_path, count(*) AS n FROM terms WHERE field = 'body' GROUP BY source_id, rel_path) t ON entries.source_id = t.source_id AND entries.rel_path = t.rel_path),
stats AS (SELECT source_id, count(*) AS n, avg(len) AS avgdl FROM docs GROUP BY source_id)"""
)
PREFIX, FILTER = "en", "ion"


def entries_from_documents(spark: SparkSession, d: str) -> DataFrame:
    return entries(documents(spark, d)).select("source_id", "rel_path", "title", F.array_join("tags", ",").alias("tags"), F.md5("content").alias("md5"), F.length("content").cast("long").alias("n_chars"))


def list_files_prefix(spark: SparkSession, d: str) -> DataFrame:
    rows = entries(table(spark, d, "documents")).where(T.under(F.col("rel_path"), PREFIX))
    return rows.select("source_id", "rel_path", F.row_number().over(Window.partitionBy("source_id").orderBy("rel_path")).alias("place"))


def directory_rollup(spark: SparkSession, d: str) -> DataFrame:
    """One level of each source: folders first, then files, each with what lies under it."""
    rows = entries(table(spark, d, "documents")).select("source_id", F.split("rel_path", "/").alias("p"))
    level = rows.groupBy("source_id", F.get("p", F.lit(0)).alias("name"), (F.size("p") > 1).alias("folder")).agg(F.count("*").alias("files"))
    return level.withColumn("place", F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("folder"), "name")))


def file_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = entries(table(spark, d, "documents"))
    return rows.where(F.contains(F.lower(F.concat_ws(" ", "rel_path", "title", F.array_join("tags", " "))), F.lit(FILTER))).select("source_id", "rel_path", "title")


def token_spans(spark: SparkSession, d: str) -> DataFrame:
    """Identifier runs of every text with where they begin and end, in characters."""
    pieces = F.split(F.regexp_replace("content", "[^A-Za-z0-9_./-]", " "), " ")
    rows = entries(documents(spark, d)).select("source_id", "rel_path", F.posexplode(pieces).alias("place", "run"))
    before = Window.partitionBy("source_id", "rel_path").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("run") + 1).over(before), F.lit(0))
    return rows.select("source_id", "rel_path", "run", start.alias("start"), (start + F.length("run")).alias("end")).where("run <> ''")


def listed(spark: SparkSession, d: str) -> bm25.Index:
    return bm25.plain_index(entries(documents(spark, d)))


def term_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return listed(spark, d).postings.select("source_id", "rel_path", "field", "term", F.col("tf").cast("long").alias("tf"))


def document_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return bm25.frequencies(listed(spark, d))


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return listed(spark, d).stats.select("source_id", "n", F.round("avgdl", 6).alias("avgdl"))


def identifier_parts(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "pages").select("page_id", F.explode(T.runs(F.col("url"))).alias("run"))
    return runs.select("page_id", F.explode(T.identifier_terms(F.col("run"))).alias("term")).groupBy("page_id", "term").agg(F.count("*").alias("tf"))


def camel_split(spark: SparkSession, d: str) -> DataFrame:
    """Words of the pages' HTML that are written in camel case, and their pieces."""
    words = table(spark, d, "pages").select(F.explode(F.regexp_extract_all("html", F.lit("[A-Za-z0-9]+"), F.lit(0))).alias("word"))
    pieces = T.camel_pieces(F.col("word"))
    return words.where(F.size(pieces) > 1).groupBy("word", F.array_join(pieces, " ").alias("pieces")).agg(F.count("*").alias("n"))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, (int, float)) else "'" + x + "'" for x in r) + ")" for r in rows)


def _list(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


QUERIES = {f.__name__: f for f in (entries_from_documents, list_files_prefix, directory_rollup, file_filter, token_spans, term_frequencies, document_frequencies, corpus_stats, identifier_parts, camel_split)}
SQL = {
    "entries_from_documents": f"WITH {ENTRIES} SELECT source_id, rel_path, title, tag AS tags, md5(content) AS md5, CAST(length(content) AS BIGINT) AS n_chars FROM entries",
    "list_files_prefix": f"WITH {ENTRIES} SELECT source_id, rel_path, CAST(row_number() OVER (PARTITION BY source_id ORDER BY rel_path) AS INTEGER) AS place FROM entries WHERE rel_path = '{PREFIX}' OR starts_with(rel_path, '{PREFIX}/')",
    "directory_rollup": f"WITH {ENTRIES}, level AS (SELECT source_id, split_part(rel_path, '/', 1) AS name, contains(rel_path, '/') AS folder, count(*) AS files FROM entries GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY source_id ORDER BY folder DESC, name) AS INTEGER) AS place FROM level",
    "file_filter": f"WITH {ENTRIES} SELECT source_id, rel_path, title FROM entries WHERE contains(lower(concat(rel_path, ' ', title, ' ', tag)), '{FILTER}')",
    "token_spans": rf"""WITH {ENTRIES}, split AS (SELECT source_id, rel_path, string_split(regexp_replace(content, '[^A-Za-z0-9_./-]', ' ', 'g'), ' ') AS pieces FROM entries),
each AS (SELECT source_id, rel_path, unnest(pieces) AS run, unnest(range(len(pieces))) AS place FROM split),
summed AS (SELECT source_id, rel_path, run, CAST(coalesce(sum(length(run) + 1) OVER (PARTITION BY source_id, rel_path ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM each)
SELECT source_id, rel_path, run, start, start + length(run) AS "end" FROM summed WHERE run <> ''""",
    "term_frequencies": f"WITH {POSTINGS} SELECT source_id, rel_path, field, term, tf FROM postings",
    "document_frequencies": f"WITH {POSTINGS} SELECT source_id, term, count(DISTINCT rel_path) AS df FROM postings GROUP BY source_id, term",
    "corpus_stats": f"WITH {POSTINGS} SELECT source_id, n, round(avgdl, 6) AS avgdl FROM stats",
    "identifier_parts": f"WITH runs AS (SELECT page_id, unnest({RUNS}) AS run FROM (SELECT page_id, url AS txt FROM pages)), terms AS (SELECT page_id, unnest({TERMS}) AS term FROM runs) SELECT page_id, term, count(*) AS tf FROM terms GROUP BY page_id, term",
    "camel_split": r"""WITH words AS (SELECT unnest(regexp_extract_all(html, '[A-Za-z0-9]+')) AS word FROM pages),
split AS (SELECT word, regexp_replace(regexp_replace(word, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g') AS pieces FROM words)
SELECT word, pieces, count(*) AS n FROM split WHERE contains(pieces, ' ') GROUP BY word, pieces""",
}
