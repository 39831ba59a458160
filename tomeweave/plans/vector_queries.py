"""Semantic, hybrid and re-ranked search, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bm25, semantic
from ..sources.corpus import chunk_vectors, entries, table
from .corpus_queries import POSTINGS, _list
from .keyword_queries import ASKED, HITS, QUERY, RANKED, WEIGHTS, index

ASKED_VECTOR = 7


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """Chunk vectors with their entry's keys."""
    rows = chunk_vectors(table(spark, d, "embeddings"))
    return rows.join(entries(table(spark, d, "documents")).select("doc_id", "source_id", "rel_path"), "doc_id")


def query_vector(spark: SparkSession, d: str):
    """The embedding of one row, as a literal."""
    row = table(spark, d, "embeddings").where(F.col("vec_id") == ASKED_VECTOR).select("embedding").first()
    return F.array(*[F.lit(float(x)) for x in row.embedding])


def vector_centroid(spark: SparkSession, d: str) -> DataFrame:
    return semantic.centres(vectors(spark, d)).select("source_id", F.posexplode("centre").alias("i", "x")).select("source_id", "i", F.round("x", 6).alias("x"))


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = semantic.similarities(table(spark, d, "embeddings"), query_vector(spark, d)).select("vec_id", F.round("similarity", 6).alias("similarity"))
    return rows.orderBy(F.desc("similarity"), "vec_id").limit(20)


def centroid_denoised_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d)
    found = semantic.similarities(rows, query_vector(spark, d), semantic.centres(rows)).select("vec_id", "source_id", F.round("similarity", 6).alias("similarity"))
    return found.orderBy(F.desc("similarity"), "vec_id").limit(20)


def semantic_search(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d)
    found = semantic.search(rows, query_vector(spark, d), semantic.centres(rows))
    return found.select("source_id", "rel_path", "chunk_index", "chunks", "strong", "rank", "score", F.round("semantic_score", 6).alias("semantic_score"))


def semantic_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d)
    found = semantic.candidates(rows, query_vector(spark, d), semantic.centres(rows))
    return found.select("source_id", "rel_path", "chunk_index", "chunks", "score", "rank")


def semantic_scoped(spark: SparkSession, d: str) -> DataFrame:
    """Files under a path; the centre is that of the whole source."""
    rows = vectors(spark, d)
    found = semantic.candidates(rows, query_vector(spark, d), semantic.centres(rows), include=T.under(F.col("rel_path"), "en"))
    return found.select("source_id", "rel_path", "score", "rank")


def fused(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d)
    return semantic.fused(bm25.search(index(spark, d), WEIGHTS, semantic.FUSION_TOP), semantic.candidates(rows, query_vector(spark, d), semantic.centres(rows))).drop("chunk_index", "semantic_score")


def hybrid_per_source(spark: SparkSession, d: str) -> DataFrame:
    return fused(spark, d)


def best_hybrid(spark: SparkSession, d: str, top: int) -> DataFrame:
    best = fused(spark, d).select("source_id", "rel_path", "score").orderBy(F.desc("score"), "source_id", "rel_path").limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "source_id", "rel_path")))


def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    """The best fifty of all sources."""
    return best_hybrid(spark, d, 50)


def rerank_topk(spark: SparkSession, d: str) -> DataFrame:
    """The best twenty hybrid hits by how many of the query's terms their text has, ten kept."""
    texts = entries(table(spark, d, "documents"))

    def scorer(hits: DataFrame) -> DataFrame:
        rows = texts.join(F.broadcast(hits), ["source_id", "rel_path"])  # twenty rows
        text = semantic.rerank_text(F.col("title"), F.lit(""), F.col("content"), F.lit(""))
        return rows.select("source_id", "rel_path", "score", "rank", semantic.overlap(list(QUERY), T.terms(text)).alias("rerank_score"))

    return semantic.reranked(best_hybrid(spark, d, 20), scorer)


_dot = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: CAST({a}[i] AS DOUBLE) * CAST({b}[i] AS DOUBLE)))"
_cos = lambda a, b: f"({_dot.format(a=a, b=b)} / (sqrt({_dot.format(a=a, b=a)}) * sqrt({_dot.format(a=b, b=b)})))"
ENTRIES_OF = "SELECT source AS source_id, concat(lang, '/', doc_id, '.md') AS rel_path, doc_id FROM documents"
VECTORS = f"""
vecs AS (SELECT vec_id, vec_id // 4 AS doc_id, CAST(vec_id % 4 AS INTEGER) AS chunk_index, CAST(embedding AS DOUBLE[]) AS v, e.source_id, e.rel_path FROM embeddings JOIN ({ENTRIES_OF}) e ON e.doc_id = vec_id // 4),
q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = {ASKED_VECTOR}),
means AS (SELECT source_id, i, avg(x) AS x FROM (SELECT source_id, unnest(v) AS x, unnest(range(len(v))) AS i FROM vecs) GROUP BY source_id, i),
centre AS (SELECT source_id, list(x ORDER BY i) AS c FROM means GROUP BY source_id),
moved AS (SELECT source_id, list_transform(range(1, len(c) + 1), lambda i: q[i] - 0.3 * c[i]) AS m FROM centre, q),
near AS (SELECT vecs.*, {_cos("v", "m")} AS similarity FROM vecs JOIN moved ON vecs.source_id = moved.source_id)"""
_files = lambda where: f"""grouped AS (SELECT source_id, rel_path, count(*) AS chunks, max(similarity) AS best, arg_min(chunk_index, (-similarity, chunk_index)) AS chunk_index FROM near {where} GROUP BY source_id, rel_path),
files AS (SELECT *, best + least(0.05 * (chunks - 1), 0.25) AS semantic_score, CAST(floor(100 * (best + least(0.05 * (chunks - 1), 0.25)) + 0.5) AS INTEGER) AS score FROM grouped)"""  # noqa: E731
CANDIDATES = _files("") + ", sem AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY source_id ORDER BY score DESC, rel_path) AS INTEGER) AS rank FROM files) WHERE rank <= 50)"
FUSED = f"""WITH {POSTINGS}, {ASKED}, {HITS}, {RANKED}, {VECTORS}, {CANDIDATES},
pairs AS (SELECT coalesce(best.source_id, sem.source_id) AS source_id, coalesce(best.rel_path, sem.rel_path) AS rel_path, best.rank AS keyword_rank, sem.rank AS semantic_rank FROM best FULL JOIN sem ON best.source_id = sem.source_id AND best.rel_path = sem.rel_path),
fused AS (SELECT *, CAST(floor(10000 * (1.0::DOUBLE / (60 + coalesce(keyword_rank, 120)) + 1.0::DOUBLE / (60 + coalesce(semantic_rank, 120))) + 0.5) AS INTEGER) AS score FROM pairs)"""
HYBRID = "(SELECT source_id, rel_path, score, CAST(row_number() OVER (ORDER BY score DESC, source_id, rel_path) AS INTEGER) AS rank FROM fused)"
QUERIES = {f.__name__: f for f in (vector_centroid, cosine_topk, centroid_denoised_topk, semantic_search, semantic_candidates, semantic_scoped, hybrid_per_source, hybrid_rrf, rerank_topk)}
SQL = {
    "vector_centroid": f"WITH {VECTORS} SELECT source_id, CAST(i AS INTEGER) AS i, round(x, 6) AS x FROM means",
    "cosine_topk": f"WITH {VECTORS} SELECT vec_id, round({_cos('v', 'q')}, 6) AS similarity FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, q FROM embeddings, q) ORDER BY similarity DESC, vec_id LIMIT 20",
    "centroid_denoised_topk": f"WITH {VECTORS} SELECT vec_id, source_id, round(similarity, 6) AS similarity FROM near ORDER BY similarity DESC, vec_id LIMIT 20",
    "semantic_search": f"""WITH {VECTORS}, {_files("WHERE similarity >= 0.2")}, marked AS (SELECT *, semantic_score >= 0.5 AS strong FROM files),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY source_id, strong ORDER BY semantic_score DESC, rel_path) AS INTEGER) AS rank, count(*) FILTER (WHERE strong) OVER (PARTITION BY source_id) AS n FROM marked)
SELECT source_id, rel_path, chunk_index, chunks, strong, rank, score, round(semantic_score, 6) AS semantic_score FROM ranked WHERE strong OR (n < 3 AND rank <= 3)""",
    "semantic_candidates": f"WITH {VECTORS}, {CANDIDATES} SELECT source_id, rel_path, chunk_index, chunks, score, rank FROM sem",
    "semantic_scoped": f"WITH {VECTORS}, {CANDIDATES.replace('FROM near', 'FROM (SELECT * FROM near WHERE starts_with(rel_path, ' + chr(39) + 'en/' + chr(39) + '))')} SELECT source_id, rel_path, score, rank FROM sem",
    "hybrid_per_source": f"{FUSED} SELECT source_id, rel_path, keyword_rank, semantic_rank, score, CAST(row_number() OVER (PARTITION BY source_id ORDER BY score DESC, rel_path) AS INTEGER) AS rank FROM fused",
    "hybrid_rrf": f"{FUSED} SELECT * FROM {HYBRID} WHERE rank <= 50",
    "rerank_topk": f"""{FUSED}, top AS (SELECT * FROM {HYBRID} WHERE rank <= 20),
own AS (SELECT top.source_id, top.rel_path, any_value(score) AS score, any_value(rank) AS rank, count(DISTINCT CASE WHEN term IN {_list(QUERY)} AND field IN ('title', 'body') THEN term END) AS n FROM top LEFT JOIN terms ON top.source_id = terms.source_id AND top.rel_path = terms.rel_path GROUP BY top.source_id, top.rel_path),
placed AS (SELECT source_id, rel_path, score, rank, round(CAST(n AS DOUBLE) / {len(QUERY)}, 6) AS rerank_score FROM own)
SELECT * FROM (SELECT *, CAST(row_number() OVER (ORDER BY rerank_score DESC, rank) AS INTEGER) AS place FROM placed) WHERE place <= 10""",
}
