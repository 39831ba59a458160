"""Semantic search over chunk vectors, fusion with keyword search, and re-ranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import vectors as V

# Least similarity of a chunk, of a strong file, the share of the corpus' centre, the bonus of further chunks, fusion.
LEAST, STRONG, WEAK_FILES = 0.20, 0.50, 3
CENTRE_SHARE, BONUS, MOST_BONUS = 0.3, 0.05, 0.25
FUSION_K, FUSION_TOP, MISSING_RANK = 60, 50, 120
KEY = ("source_id", "rel_path")


def centres(vectors: DataFrame) -> DataFrame:
    """(source_id, centre): the mean vector of each source; vectors of another length than the commonest count but add nothing."""
    sized = vectors.groupBy("source_id", F.size("embedding").alias("dim")).agg(F.count("*").alias("n"))
    pick = sized.groupBy("source_id").agg(F.sum("n").alias("n"), F.max(F.struct("n", "dim")).alias("top")).select("source_id", "n", F.col("top.dim").alias("dim"))
    parts = vectors.join(F.broadcast(pick), "source_id").where(F.size("embedding") == F.col("dim"))  # a row per source
    sums = parts.select("source_id", "n", F.posexplode("embedding").alias("i", "x")).groupBy("source_id", "i", "n").agg(F.sum(F.col("x").cast("double")).alias("x"))
    rows = sums.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("i", (F.col("x") / F.col("n")).alias("x")))).alias("c"))
    return rows.select("source_id", F.transform("c", lambda p: p.x).alias("centre"))


def similarities(vectors: DataFrame, query: Column, centre: DataFrame | None = None) -> DataFrame:
    """vectors with `similarity` to a literal query, less a share of their source's centre if centres are given."""
    if centre is None:
        return vectors.withColumn("similarity", V.cosine(F.col("embedding"), query))
    moved = centre.select("source_id", V.without_centre(query, F.col("centre"), CENTRE_SHARE).alias("_q"))
    rows = vectors.join(F.broadcast(moved), "source_id", "left")  # a row per source
    return rows.withColumn("similarity", V.cosine(F.col("embedding"), F.coalesce("_q", query))).drop("_q")


def files(similar: DataFrame, least: float | None, listed: bool = False) -> DataFrame:
    """(source_id, rel_path, chunk_index, chunks, similarity, semantic_score): each file's best chunk, the first if even, and a bonus for more. listed: also `indexes`, the chunks of the file that are similar enough."""
    rows = similar if least is None else similar.where(F.col("similarity") >= least)
    more = [F.sort_array(F.collect_set("chunk_index")).alias("indexes")] if listed else []
    best = rows.groupBy(*KEY).agg(F.min(F.struct((-F.col("similarity")).alias("s"), "chunk_index")).alias("b"), F.count("*").alias("chunks"), *more)
    bonus = F.least(F.lit(BONUS) * (F.col("chunks") - 1), F.lit(MOST_BONUS))
    return best.select(*KEY, F.col("b.chunk_index").alias("chunk_index"), "chunks", (-F.col("b.s")).alias("similarity"), (bonus - F.col("b.s")).alias("semantic_score"), *(["indexes"] if listed else []))


def search(vectors: DataFrame, query: Column, centre: DataFrame | None = None, include: Column | None = None, listed: bool = False) -> DataFrame:
    """Files with chunks similar enough: strong ones, and up to three weak ones where a source has fewer than three strong. include acts before similarities are taken."""
    rows = vectors.where(include) if include is not None else vectors
    found = files(similarities(rows, query, centre), LEAST, listed).withColumn("strong", F.col("semantic_score") >= STRONG)
    order = Window.partitionBy("source_id", "strong").orderBy(F.desc("semantic_score"), "rel_path")
    strong = F.sum(F.col("strong").cast("int")).over(Window.partitionBy("source_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).withColumn("_strong", strong)
    return ranked.where("strong or (_strong < 3 and rank <= 3)").drop("_strong").withColumn("score", V.half_up(100 * F.col("semantic_score")))


def candidates(vectors: DataFrame, query: Column, centre: DataFrame | None = None, top: int = FUSION_TOP, include: Column | None = None) -> DataFrame:
    """(source_id, rel_path, score, chunk_index, rank): the best `top` files of each source, without a least similarity."""
    rows = vectors.where(include) if include is not None else vectors
    found = files(similarities(rows, query, centre), None).withColumn("score", V.half_up(100 * F.col("semantic_score")))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("score"), "rel_path")))
    return ranked.where(F.col("rank") <= top)


def fused(keyword: DataFrame, semantic: DataFrame) -> DataFrame:
    """(source_id, rel_path, score, rank, keyword_rank, semantic_rank): reciprocal ranks of both lists, a missing one counting as rank 120. chunk_index and semantic_score stay where the semantic list has them."""
    told = [c for c in ("chunk_index", "semantic_score") if c in semantic.columns]
    both = keyword.where(F.col("rank") <= FUSION_TOP).select(*KEY, F.col("rank").alias("keyword_rank")).join(semantic.where(F.col("rank") <= FUSION_TOP).select(*KEY, F.col("rank").alias("semantic_rank"), *told), list(KEY), "full")
    part = lambda c: F.lit(1.0) / (FUSION_K + F.coalesce(c, F.lit(MISSING_RANK)))
    rows = both.withColumn("score", V.half_up(10000 * (part("keyword_rank") + part("semantic_rank"))))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("score"), "rel_path")))


# How a semantic hit is shown.
TOPIC, HEAD, MORE, WEAK = "💡 ", "▸ ", " | +", "⚠️ 弱匹配 ("
CHUNKS, FOUND, MOST_HEADS = "块: ", "块命中", 5


def shown(topic: Column, heading: Column, heads: Column, chunks: Column, strong: Column, score: Column) -> Column:
    """A semantic hit in a line: what the file is about or the heading of its best chunk, and the headings of up to five further chunks; of a weak hit only its score."""
    said = lambda mark, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(mark), c))
    others = F.slice(F.filter(heads, lambda h: h != F.coalesce(heading, F.lit(""))), 1, MOST_HEADS)
    number = F.concat(F.lit(MORE), (chunks - 1).cast("string"))
    more = F.when(chunks > 1, F.when(F.size(others) > 0, F.concat(number, F.lit(CHUNKS), F.array_join(others, ", "))).otherwise(F.concat(number, F.lit(FOUND))))
    weak = F.concat(F.lit(WEAK), V.half_up(100 * score).cast("int").cast("string"), F.lit("%)"))
    return F.when(strong, F.concat(F.coalesce(said(TOPIC, topic), said(HEAD, heading), F.lit("")), F.coalesce(more, F.lit("")))).otherwise(weak)


def rerank_text(title: Column, heading: Column, chunk: Column, snippet: Column) -> Column:
    """What a re-ranker reads: title, heading path and the chunk's lines, or else the snippet."""
    part = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return F.concat_ws("\n\n", part(title), part(heading), F.coalesce(part(chunk), part(snippet)))


def pair_scorer(load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], batch: int = 8) -> Callable[[DataFrame], DataFrame]:
    """A scorer of hits (query, text) in batches. load is called once in each task, so the model is made where it runs; another number of scores than of pairs is an error."""

    def score(hits: DataFrame) -> DataFrame:
        kinds = StructType([*hits.schema.fields, StructField("rerank_score", DoubleType())])

        def rated(frames):
            model = None
            for frame in frames:
                pairs, scores = list(zip(frame["query"], frame["text"])), []
                for at in range(0, len(pairs), batch):
                    model = model or load()
                    got = list(model(pairs[at : at + batch]))
                    if len(got) != len(pairs[at : at + batch]):
                        raise ValueError("the model gave another number of scores")
                    scores += got
                yield frame.assign(rerank_score=[float(x) for x in scores])

        return hits.mapInPandas(rated, kinds)

    return score


def overlap(query: list[str], terms: Column) -> Column:
    """A re-ranker for tests: the share of the query's terms that a text has."""
    return F.round(F.size(F.array_intersect(terms, F.array(*map(F.lit, query)))) / len(query), 6)


def reranked(hits: DataFrame, scorer: Callable[[DataFrame], DataFrame], inputs: int = 20, outputs: int = 10) -> DataFrame:
    """The best `inputs` of hits (with rank) scored anew, best `outputs` kept; ties keep their order. scorer adds `rerank_score`."""
    rows = scorer(hits.where(F.col("rank") <= inputs))
    order = Window.orderBy(F.desc("rerank_score"), "rank")  # at most `inputs` rows
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= outputs)


def reranked_or_as_was(hits: DataFrame, scorer: Callable[[DataFrame], DataFrame], inputs: int = 20, outputs: int = 10) -> list:
    """As rows; the hits as they were if the scorer fails or scores another number of rows."""
    before = hits.orderBy("rank").collect()  # a page of hits
    try:
        after = reranked(hits, scorer, inputs, outputs).orderBy("place").collect()
    except Exception:
        return before
    return after if len(after) == min(outputs, inputs, len(before)) else before
