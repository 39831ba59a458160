"""Chunks, their metadata and enrichment, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..operators import chunk, compile
from ..sources.corpus import documents, entries, markdown
from .corpus_queries import _list


def chunks_of(spark: SparkSession, d: str) -> DataFrame:
    return chunk.by_heading(markdown(documents(spark, d)))


def chunk_by_heading(spark: SparkSession, d: str) -> DataFrame:
    return chunks_of(spark, d).select("source_id", "rel_path", "chunk_index", "heading", "level", F.md5("raw_text").alias("md5"))


def chunk_context(spark: SparkSession, d: str) -> DataFrame:
    """The second chunk of each file with its neighbours."""
    rows = chunk.contexts(markdown(documents(spark, d)), 1)
    return rows.select("source_id", "rel_path", "chunk_index", "offset", F.substring_index("piece", "\n", 1).alias("heading"))


def heading_path(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose every third line is a heading of level 1, 2 or 3 in turn."""
    marks = lambda i: F.concat(F.repeat(F.lit("#"), (1 + F.floor(i / 3) % 3).cast("int")), F.lit(" "))
    lines = F.transform(F.split("content", "\n"), lambda x, i: F.when(i % 3 == 0, F.concat(marks(i), x)).otherwise(x))
    return chunk.heading_paths(entries(documents(spark, d)).withColumn("content", F.array_join(lines, "\n")))


def preprocess_metadata(spark: SparkSession, d: str) -> DataFrame:
    rows = chunk.enriched(chunks_of(spark, d))
    return rows.select("source_id", "rel_path", "chunk_index", "content_class", F.round("importance", 4).alias("importance"), "confidence", "temporal_anchor", "summary")


def keywords_extract(spark: SparkSession, d: str) -> DataFrame:
    rows = entries(documents(spark, d))
    return rows.select("source_id", "rel_path", F.array_join(T.keywords(F.col("content")), ",").alias("keywords"))


def embedding_text(spark: SparkSession, d: str) -> DataFrame:
    """What each entry is embedded as when its keywords and first lines are all that is known."""
    rows = entries(documents(spark, d))
    none = F.array().cast("array<string>")
    text = compile.chunk_embedding_text(T.content_class(F.col("rel_path")), T.temporal_anchor(F.col("content")), F.col("title"), none, F.col("tags"), T.keywords(F.col("content")), F.lit(""), F.col("content"))
    return rows.select("source_id", "rel_path", F.md5(text).alias("md5"), F.length(text).alias("length"))


MARKDOWN = r"""
lines AS (SELECT source AS source_id, concat(lang, '/', doc_id, '.md') AS rel_path, substr(split_part(text, chr(10), 1), 1, 60) AS title, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
marked AS (SELECT source_id, rel_path, title, i, i % 3 = 0 AS head, CASE WHEN i % 3 = 0 THEN concat('## ', line) ELSE line END AS line FROM lines),
numbered AS (SELECT *, i // 3 AS k FROM marked),
chunks AS (SELECT source_id, rel_path, CAST(k AS INTEGER) AS chunk_index, CASE WHEN k = 0 THEN any_value(title) ELSE trim(max(CASE WHEN head THEN line END)) END AS heading, CASE WHEN k = 0 THEN 0 ELSE 2 END AS level,
  coalesce(string_agg(CASE WHEN NOT head THEN line END, chr(10) ORDER BY i), '') AS body FROM numbered GROUP BY source_id, rel_path, k),
raw AS (SELECT *, CASE WHEN heading <> '' THEN concat(heading, chr(10), body) ELSE body END AS raw_text FROM chunks)"""
_words = "regexp_extract_all(content, '\\b[A-Za-z_]{3,}\\b')"
_keywords = f"""found AS (SELECT source_id, rel_path, {_words} AS ws FROM entries), each AS (SELECT source_id, rel_path, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM found),
firsts AS (SELECT source_id, rel_path, w, min(p) AS p FROM each WHERE w NOT IN {_list(L.NO_KEYWORDS)} GROUP BY source_id, rel_path, w), listed AS (SELECT source_id, rel_path, list(w ORDER BY p)[1:8] AS ws FROM firsts GROUP BY source_id, rel_path),
known AS (SELECT entries.*, coalesce(ws, []) AS ws FROM entries LEFT JOIN listed ON entries.source_id = listed.source_id AND entries.rel_path = listed.rel_path)"""
_type = r"""CASE WHEN regexp_matches(text, '```.*?```', 's') THEN 'code' WHEN regexp_matches(text, '(?m)^\s*[-*]\s*\[ \]') THEN 'todo' WHEN regexp_matches(text, '(?mi)^\s*[-*]\s*\[x\]') THEN 'log'
  """ + " ".join(f"WHEN regexp_matches(heading, '{'(?i)' if kind == 'idea' else ''}^#{{1,4}}\\s*({words})') THEN '{kind}'" for kind, words in T.HEADING_TYPES) + " WHEN length(text) < 50 THEN 'reference' ELSE 'note' END"
_class = lambda c: "CASE " + " ".join(f"WHEN regexp_matches({c}, '(?i){words}') THEN '{kind}'" for kind, words in T.PATH_CLASSES) + " ELSE 'reference' END"
_anchor = lambda c: f"nullif(replace(regexp_extract({c}, '\\b(20[0-9]{{2}}[-/][0-9]{{1,2}}[-/][0-9]{{1,2}})\\b', 1), '/', '-'), '')"
_summary = r"substr(trim(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw_text, '(?m)^#{1,6}\s+', '', 'g'), '(?s)```.*?```', '[代码]', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '\*\*|__|\*|_|`|~~', '', 'g'), chr(10), ' ')), 1, 30)"
ENTRY = "entries AS (SELECT source AS source_id, concat(lang, '/', doc_id, '.md') AS rel_path, substr(split_part(text, chr(10), 1), 1, 60) AS title, lang AS tag, text AS content FROM documents)"
QUERIES = {f.__name__: f for f in (chunk_by_heading, chunk_context, heading_path, preprocess_metadata, keywords_extract, embedding_text)}
SQL = {
    "chunk_by_heading": f"WITH {MARKDOWN} SELECT source_id, rel_path, chunk_index, heading, level, md5(raw_text) AS md5 FROM raw",
    "chunk_context": f"""WITH {MARKDOWN}, heads AS (SELECT source_id, rel_path, CAST(k AS INTEGER) AS chunk_index, line AS heading FROM numbered WHERE head), some AS (SELECT source_id, rel_path FROM heads WHERE chunk_index = 1)
SELECT h.source_id, h.rel_path, chunk_index, chunk_index - 1 AS offset, heading FROM heads h JOIN some s ON h.source_id = s.source_id AND h.rel_path = s.rel_path WHERE chunk_index <= 2""".replace("some ", "several ").replace("AS offset", 'AS "offset"'),
    "heading_path": f"""WITH {MARKDOWN}, heads AS (SELECT source_id, rel_path, k, k % 3 AS depth, trim(regexp_replace(line, '^#+\\s*', '')) AS name FROM (SELECT source_id, rel_path, i // 3 AS k, line FROM lines WHERE i % 3 = 0))
SELECT h.source_id, h.rel_path, CAST(h.k AS INTEGER) AS chunk_index, concat_ws(' > ', b.name, a.name, h.name) AS path FROM heads h
LEFT JOIN heads a ON h.depth >= 1 AND a.source_id = h.source_id AND a.rel_path = h.rel_path AND a.k = h.k - 1 LEFT JOIN heads b ON h.depth = 2 AND b.source_id = h.source_id AND b.rel_path = h.rel_path AND b.k = h.k - 2""",
    "preprocess_metadata": f"""WITH {MARKDOWN} SELECT source_id, rel_path, chunk_index, {_class("rel_path")} AS content_class,
  round(CAST(greatest(0.1, least(1.0, 0.3 + CASE WHEN length(raw_text) > 200 THEN 0.2 ELSE 0 END + CASE WHEN length(raw_text) > 500 THEN 0.1 ELSE 0 END + CASE WHEN contains(raw_text, '```') THEN 0.15 ELSE 0 END + CASE WHEN regexp_matches(heading, '^#{{1,3}}\\s') THEN 0.1 ELSE 0 END
    + CASE WHEN regexp_matches(raw_text, '{T.TROUBLE}') THEN 0.1 ELSE 0 END - CASE WHEN regexp_matches(raw_text, '(?i){T.LATER}') THEN 0.3 ELSE 0 END)) AS DOUBLE), 4) AS importance,
  CAST(CASE WHEN length(raw_text) < 20 THEN 0.3 WHEN length(raw_text) < 80 THEN 0.6 ELSE 0.85 END AS DOUBLE) AS confidence, {_anchor("raw_text")} AS temporal_anchor, {_summary} AS summary FROM raw""",
    "keywords_extract": f"WITH {ENTRY}, {_keywords} SELECT source_id, rel_path, array_to_string(ws, ',') AS keywords FROM known",
    "embedding_text": f"""WITH {ENTRY}, {_keywords}, texts AS (SELECT source_id, rel_path, concat_ws(chr(10), concat('[CLASS] ', {_class("rel_path")}), '[TIME] ' || {_anchor("content")}, '[TOPIC] ' || nullif(title, ''), '[ALIASES] ' || nullif(tag, ''), '[KEYWORDS] ' || nullif(array_to_string(ws, '; '), ''), '[RAW] ' || nullif(substr(content, 1, 400), '')) AS t FROM known)
SELECT source_id, rel_path, md5(t) AS md5, CAST(length(t) AS INTEGER) AS length FROM texts""",
}
