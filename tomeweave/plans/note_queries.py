"""Rules for notes, over notes made from all documents, each query with the SQL that says the same.

The tables hold plain prose. A note is a document in which common words are replaced by what the
rules look for: links, CJK runs, domain terms and dates. A typed note has headings, tasks and code
by line number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..operators import analyze, chunk, compile
from ..sources.corpus import documents, entries
from .chunk_queries import ENTRY, _anchor, _class, _type
from .corpus_queries import _list, _values

MARKS = (
    ("the", "[[the]]"), ("of", "[[of|von]]"), ("de", "[[de#la]]"), ("and", "[[ and ]]"), ("to", "数据上送异常"), ("en", "无法同步配置文件"), ("der", "倒排索引"), ("in", "DLMS与COSEM"), ("is", "xDLMS dlms."), ("le", "HLS5/GMAC"), ("la", "的"), ("que", "接口错误"), ("a", "2024-1-05"), ("die", "2023/12/31"), ("as", "x2024-01-01"),
)
FOLDERS = ("ChatGPT", "日报", "手册", "plain", "会议")
KINDS = ("架构", "决策", "附录", "故障", "周报", "idea", "调研", "其他")


def notes(spark: SparkSession, d: str) -> DataFrame:
    made = lambda c: reduce(lambda x, m: F.replace(x, F.lit(f" {m[0]} "), F.lit(f" {m[1]} ")), MARKS, F.col(c))
    return entries(documents(spark, d)).select("source_id", "rel_path", made("title").alias("title"), made("content").alias("content"))


def typed(spark: SparkSession, d: str) -> DataFrame:
    """Every third line a heading of levels 1 to 3 in turn that names a kind; some lines open tasks, some code."""
    kind = lambda i: F.element_at(F.array(*map(F.lit, KINDS)), (F.floor(i / 3) % len(KINDS) + 1).cast("int"))
    marks = lambda i: F.repeat(F.lit("#"), (1 + F.floor(i / 3) % 3).cast("int"))

    def line(x, i):
        head = F.concat_ws(" ", marks(i), kind(i), x)
        task = F.when((i % 3 == 1) & (F.floor(i / 3) % 5 == 3), F.concat(F.lit("- [ ] "), x))
        code = F.when((i % 3 == 2) & (F.floor(i / 3) % 7 == 5), F.concat(F.lit("```\n"), x, F.lit("\n```")))
        return F.when(i % 3 == 0, head).otherwise(F.coalesce(task, code, x))

    return entries(documents(spark, d)).where("content is not null").withColumn("content", F.array_join(F.transform(F.split("content", "\n"), line), "\n"))


def wikilinks(spark: SparkSession, d: str) -> DataFrame:
    return notes(spark, d).select("source_id", "rel_path", F.posexplode(T.wikilinks(F.col("content"))).alias("place", "target"))


def runs_of(spark: SparkSession, d: str) -> DataFrame:
    """CJK runs of the notes' bodies and titles, equal ones counted."""
    found = lambda c: F.transform(F.regexp_extract_all(c, F.lit(f"[{L.CJK}]+"), F.lit(0)), lambda r: F.struct(F.lit("body" if c == "content" else "title").alias("field"), r.alias("run")))
    rows = notes(spark, d).select("source_id", F.explode(F.concat(found("content"), found("title"))).alias("r"))
    return rows.groupBy("source_id", "r.field", "r.run").agg(F.count("*").alias("n"))


def cjk_bigrams(spark: SparkSession, d: str) -> DataFrame:
    rows = runs_of(spark, d).select("source_id", "field", "n", F.explode(T.bigrams(F.col("run"))).alias("term"))
    return rows.groupBy("source_id", "field", "term").agg(F.sum("n").alias("n"))


def stopword_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights of the notes' CJK terms by field."""
    base = T.base_weight(F.col("term"), F.lit(L.WEIGHTS["dictionary"]))
    stop = T.stop_weight(F.col("term"), F.col("field"))
    return cjk_bigrams(spark, d).select("source_id", "field", "term", F.round(base, 4).alias("base"), F.round(stop, 4).alias("stop"), F.round(T.effective_weight(base, stop, F.lit(1.0)), 4).alias("weight"))


def domain_matches(spark: SparkSession, d: str) -> DataFrame:
    """The analyser's places of domain terms, overlaps included; terms of ASCII need other neighbours."""
    rows = notes(spark, d).select("source_id", "rel_path", F.explode(analyze.domain_places(F.col("content"), analyze.Analyser())).alias("p"))
    return rows.select("source_id", "rel_path", "p.term", "p.start", "p.weight")


def temporal_anchors(spark: SparkSession, d: str) -> DataFrame:
    """The first date of each line that has one."""
    rows = notes(spark, d).select("source_id", "rel_path", F.posexplode(F.split("content", "\n")).alias("line", "text"))
    return rows.select("source_id", "rel_path", "line", T.temporal_anchor(F.col("text")).alias("anchor")).where("anchor is not null")


def content_classes(spark: SparkSession, d: str) -> DataFrame:
    """Documents in folders by the length of their text."""
    folder = F.element_at(F.array(*map(F.lit, FOLDERS)), (F.length("content") % len(FOLDERS) + 1).cast("int"))
    rows = entries(documents(spark, d)).select("source_id", F.concat_ws("/", folder, "rel_path").alias("rel_path"))
    return rows.select("source_id", "rel_path", T.content_class(F.col("rel_path")).alias("content_class"))


def chunk_types(spark: SparkSession, d: str) -> DataFrame:
    """What chunks by heading are, from their lines."""
    return chunk.by_heading(typed(spark, d)).select("source_id", "rel_path", "chunk_index", T.chunk_type(F.col("raw_text"), F.col("heading")).alias("chunk_type"))


def sections(spark: SparkSession, d: str) -> DataFrame:
    """Chunks by block structure: code stands apart, heading paths go by level."""
    rows = chunk.sections(typed(spark, d), written=True)
    return rows.select("source_id", "rel_path", "chunk_index", "heading", "level", F.array_join("heading_path", " > ").alias("path"), "start_line", "end_line", F.md5("raw_text").alias("md5"))


def chunk_type_hint(spark: SparkSession, d: str) -> DataFrame:
    """What sections are, from their parsed blocks."""
    return chunk.sections(typed(spark, d)).select("source_id", "rel_path", "chunk_index", "chunk_type")


def llm_result_parse(spark: SparkSession, d: str) -> DataFrame:
    """Replies that say a document's first line and text: plain, fenced, in segments, or without a topic."""
    rows = entries(documents(spark, d))
    said = F.struct(F.col("title").alias("topic"), F.col("content").alias("normalizedText"), F.col("tags").alias("concepts"))
    fence = lambda kind: F.concat(F.lit(f"```{kind}\n"), F.to_json(said), F.lit("\n```"))
    case = F.length("content") % 6
    reply = F.when(case == 0, F.to_json(said)).when(case == 1, fence("json")).when(case == 2, fence("")).when(case == 3, F.to_json(F.struct(F.array(said).alias("segments")))).when(case == 4, F.to_json(F.struct("content"))).otherwise(F.col("content"))
    out = rows.select("source_id", "rel_path", compile.file_result(reply).alias("r")).where("r is not null")
    return out.select("source_id", "rel_path", "r.topic", F.md5("r.normalizedText").alias("md5"), F.array_join("r.concepts", ";").alias("concepts"), F.size("r.aliases").alias("aliases"))


_made = lambda c: reduce(lambda x, m: f"replace({x}, ' {m[0]} ', ' {m[1]} ')", MARKS, c)
NOTES = f"{ENTRY}, notes AS (SELECT source_id, rel_path, {_made('title')} AS title, {_made('content')} AS content FROM entries)"
_CJK = "\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}\\x{20000}-\\x{2a6df}\\x{2f800}-\\x{2fa1f}"
BIGRAMS = rf"""{NOTES}, found AS (SELECT source_id, 'body' AS field, unnest(regexp_extract_all(content, '[{_CJK}]+')) AS run FROM notes UNION ALL SELECT source_id, 'title', unnest(regexp_extract_all(title, '[{_CJK}]+')) FROM notes),
terms AS (SELECT source_id, field, unnest(CASE WHEN length(run) = 1 THEN [run] ELSE list_transform(range(1, length(run)), lambda i: substr(run, i, 2)) END) AS term FROM found)"""
TYPED = f"""
lines AS (SELECT *, i // 3 AS k, i % 3 = 1 AND (i // 3) % 5 = 3 AS task, i % 3 = 2 AND (i // 3) % 7 = 5 AS code FROM (SELECT source AS source_id, concat(lang, '/', doc_id, '.md') AS rel_path, substr(split_part(text, chr(10), 1), 1, 60) AS title, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)),
placed AS (SELECT *, 1 + i + 2 * coalesce(sum(code::INT) OVER (PARTITION BY source_id, rel_path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ln, concat([{", ".join(f"'{k}'" for k in KINDS)}][k % {len(KINDS)} + 1], ' ', line) AS name FROM lines),
heads AS (SELECT source_id, rel_path, k, any_value(title) AS title, max(CASE WHEN i % 3 = 0 THEN name END) AS name, min(ln) AS first, max(CASE WHEN NOT code THEN ln END) AS last, string_agg(CASE WHEN i % 3 > 0 AND NOT code THEN CASE WHEN task THEN concat('- [ ] ', line) ELSE line END END, chr(10) ORDER BY i) AS body, max(CASE WHEN code THEN line END) AS code, bool_or(task) AS task FROM placed GROUP BY source_id, rel_path, k),
named AS (SELECT *, concat(repeat('#', CAST(1 + k % 3 AS INTEGER)), ' ', name) AS heading, coalesce(sum((code IS NOT NULL)::INT) OVER (PARTITION BY source_id, rel_path ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS codes,
  lag(name, 1) OVER (PARTITION BY source_id, rel_path ORDER BY k) AS one, lag(name, 2) OVER (PARTITION BY source_id, rel_path ORDER BY k) AS two FROM heads)"""
SECTIONS = f"""{TYPED},
cut AS (SELECT source_id, rel_path, 0 AS chunk_index, title AS heading, 0 AS level, '' AS path, 1 AS start_line, 1 AS end_line, '' AS raw, '' AS body, false AS code, false AS task FROM heads WHERE k = 0
  UNION ALL SELECT source_id, rel_path, k + 1 + codes, heading, 1 + k % 3, concat_ws(' > ', CASE WHEN k % 3 = 2 THEN two END, CASE WHEN k % 3 > 0 THEN one END, name), first, last, concat_ws(chr(10), heading, body), coalesce(body, ''), false, task FROM named
  UNION ALL SELECT source_id, rel_path, k + 2 + codes, '', 0, '', first + 2, first + 4, concat('```', chr(10), code, chr(10), '```'), '', true, false FROM named WHERE code IS NOT NULL)"""
_hint = (
    "CASE WHEN code THEN 'code' WHEN task THEN 'todo' "
    + " ".join(f"WHEN regexp_matches(head, '{words}')" + (f" OR regexp_matches(low, '{T.ASKS}')" if kind == "question" else "") + f" THEN '{kind}'" for kind, words in T.HINT_TYPES)
    + " WHEN length(low) < 50 THEN 'reference' ELSE 'note' END"
)
_starts = ", ".join(f"('{t.lower()}', {w}, {'true' if t.isascii() else 'false'})" for t, w, _ in L.DOMAIN)
QUERIES = {f.__name__: f for f in (wikilinks, cjk_bigrams, stopword_weights, domain_matches, temporal_anchors, content_classes, chunk_types, sections, chunk_type_hint, llm_result_parse)}
SQL = {
    "wikilinks": rf"""WITH {NOTES}, found AS (SELECT source_id, rel_path, list_transform(regexp_extract_all(content, '\[\[([^\]|#]+)(?:[#|][^\]]+)?\]\]', 1), lambda x: trim(x)) AS x FROM notes),
own AS (SELECT source_id, rel_path, list_filter(x, lambda w, i: w <> '' AND list_position(x, w) = i) AS targets FROM found) SELECT source_id, rel_path, CAST(unnest(range(len(targets))) AS INTEGER) AS place, unnest(targets) AS target FROM own""",
    "cjk_bigrams": f"WITH {BIGRAMS} SELECT source_id, field, term, count(*) AS n FROM terms GROUP BY source_id, field, term",
    "stopword_weights": f"""WITH {BIGRAMS}, soft AS (SELECT * FROM (VALUES {_values(L.SOFT.items())}) t(term, weight)),
w AS (SELECT source_id, field, terms.term, CASE WHEN terms.term IN {_list(L.PROTECTED)} THEN 1.3 ELSE 1.0 END AS base,
  CASE WHEN terms.term IN {_list(L.PROTECTED)} THEN 1.0 WHEN terms.term IN {_list(L.HARD)} THEN 0.0 WHEN soft.weight IS NULL THEN 1.0 WHEN field = 'title' THEN soft.weight + (1 - soft.weight) * 0.5 ELSE soft.weight END AS stop FROM (SELECT DISTINCT * FROM terms) terms LEFT JOIN soft ON terms.term = soft.term)
SELECT source_id, field, term, round(CAST(base AS DOUBLE), 4) AS base, round(CAST(stop AS DOUBLE), 4) AS stop, round(CAST(CASE WHEN base * stop <= 0 THEN 0 ELSE least(2.0, greatest(0.05, base * stop)) END AS DOUBLE), 4) AS weight FROM w""",
    "domain_matches": rf"""WITH {NOTES}, terms AS (SELECT * FROM (VALUES {_starts}) t(term, weight, plain)),
pieces AS (SELECT source_id, rel_path, term, weight, plain, content, unnest(string_split(lower(content), term)) AS piece, unnest(range(len(string_split(lower(content), term)))) AS i FROM notes, terms),
places AS (SELECT *, sum(length(piece)) OVER (PARTITION BY source_id, rel_path, term ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + (i - 1) * length(term) AS p FROM pieces)
SELECT source_id, rel_path, term, CAST(p AS INTEGER) AS start, CAST(weight AS DOUBLE) AS weight FROM places
WHERE i > 0 AND (NOT plain OR NOT (regexp_matches(substr(concat(' ', content, ' '), CAST(p + 1 AS BIGINT), 1), '[A-Za-z0-9_]') OR regexp_matches(substr(concat(' ', content, ' '), CAST(p + length(term) + 2 AS BIGINT), 1), '[A-Za-z0-9_]')))""",
    "temporal_anchors": f"""WITH {NOTES}, lines AS (SELECT source_id, rel_path, unnest(string_split(content, chr(10))) AS text, unnest(range(len(string_split(content, chr(10))))) AS i FROM notes)
SELECT source_id, rel_path, CAST(i AS INTEGER) AS line, {_anchor("text")} AS anchor FROM lines WHERE {_anchor("text")} IS NOT NULL""",
    "content_classes": f"WITH {ENTRY}, put AS (SELECT source_id, concat([{', '.join(repr(x) for x in FOLDERS)}][length(content) % {len(FOLDERS)} + 1], '/', rel_path) AS rel_path FROM entries) SELECT source_id, rel_path, {_class('rel_path')} AS content_class FROM put",
    "chunk_types": f"""WITH {TYPED}, raw AS (SELECT source_id, rel_path, k, CASE WHEN k = 0 THEN title ELSE heading END AS heading, concat(body, CASE WHEN code IS NOT NULL THEN concat(chr(10), '```', chr(10), code, chr(10), '```') ELSE '' END) AS rest FROM named)
SELECT source_id, rel_path, CAST(k AS INTEGER) AS chunk_index, {_type} AS chunk_type FROM (SELECT *, CASE WHEN heading <> '' THEN concat(heading, chr(10), rest) ELSE rest END AS text FROM raw)""",
    "sections": f"WITH {SECTIONS} SELECT source_id, rel_path, CAST(chunk_index AS INTEGER) AS chunk_index, heading, CAST(level AS INTEGER) AS level, path, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, md5(raw) AS md5 FROM cut",
    "chunk_type_hint": f"WITH {SECTIONS} SELECT source_id, rel_path, CAST(chunk_index AS INTEGER) AS chunk_index, {_hint} AS chunk_type FROM (SELECT *, lower(body) AS low, lower(regexp_replace(heading, '^#+\\s*', '')) AS head FROM cut)",
    "llm_result_parse": f"""WITH {ENTRY} SELECT source_id, rel_path, title AS topic, md5(content) AS md5, tag AS concepts, 0 AS aliases FROM entries WHERE length(content) % 6 = 3 OR (length(content) % 6 < 3 AND title <> '')""",
}
