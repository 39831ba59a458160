"""Scores by hand, rank rules, fusion and re-ranking."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomeweave.functions import text as T
from tomeweave.functions import vectors as V
from tomeweave.operators import analyze, bm25, embed, semantic

ENTRY = "source_id string, rel_path string, title string, tags array<string>, content string"
ROWS = [("s", "a.md", "alpha", ["x"], "alpha beta beta gamma"), ("s", "b.md", "two", [], "beta delta"), ("s", "c.md", "three", [], "delta delta epsilon zeta eta")]


def index(spark, rows=ROWS):
    return bm25.plain_index(spark.createDataFrame(rows, ENTRY))


def found(df):
    return {r.rel_path: r.score for r in df.collect()}


def brute(rows, query):
    a = analyze.Analyser()
    docs = {p: {"body": a.terms(f"[{p[:-3].replace('/', ' > ')}]\n{c}"), "title": a.terms(t), "path": a.terms(f"[{p[:-3].replace('/', ' > ')}]"), "tags": a.terms(" ".join(g))} for _, p, t, g, c in rows}
    n, avgdl = len(docs), sum(len(d["body"]) for d in docs.values()) / len(docs)
    weight = {"title": 3.0, "path": 2.5, "tags": 1.8, "body": 1.0}
    out = {}
    for p, d in docs.items():
        score = 0.0
        for q in query:
            df = sum(any(q in f for f in x.values()) for x in docs.values())
            if not df or n > 1 and df >= 0.8 * n:
                continue
            for field, terms in d.items():
                tf = terms.count(q)
                if tf:
                    score += weight[field] * math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d["body"]) / avgdl)) * 1.5
        if math.floor(10 * score + 0.5):
            out[p] = math.floor(10 * score + 0.5)
    return out


def test_scores_by_hand(spark):
    idf = math.log((3 - 1 + 0.5) / (1 + 0.5) + 1)
    # paths of one letter give no terms
    sat = 2.5 / (1 + 1.5 * (0.25 + 0.75 * 4 / ((4 + 2 + 5) / 3)))
    assert found(bm25.search(index(spark), {"alpha": 1.5})) == {"a.md": math.floor(10 * idf * sat * 1.5 * (3 + 1) + 0.5)}


@pytest.mark.parametrize("query", [["alpha", "beta"], ["delta"], ["zeta", "nothing"], ["beta", "delta", "eta"]])
def test_scores_match_brute_force(spark, query):
    assert found(bm25.search(index(spark), dict.fromkeys(query, 1.5))) == brute(ROWS, query)


def test_frequent_terms_add_nothing_unless_protected(spark):
    rows = [("s", f"{i}{i}.md", "t", [], f"common word{i}") for i in range(5)]
    assert found(bm25.search(index(spark, rows), {"common": 1.5})) == {}
    scored = bm25.scored_postings(index(spark, rows), {"common": 1.5}, protected=("common",))
    assert scored.count() == 5 and scored.first().df == 5
    assert found(bm25.search(index(spark, rows[:1]), {"common": 1.5})) != {}


def test_prefix_acts_after_statistics(spark):
    rows = [("s", f"{d}/n{i}.md", "t", [], f"word{'s' * (i % 2)} other{i}") for d in ("in", "out") for i in range(6)]
    whole = bm25.search(index(spark, rows), {"word": 1.5})
    scoped = bm25.search(index(spark, rows), {"word": 1.5}, include=F.col("rel_path").startswith("in/"))
    assert found(scoped) == {p: s for p, s in found(whole).items() if p.startswith("in/")}


def test_sources_have_their_own_statistics(spark):
    other = [("o", "a.md", "alpha", [], "alpha")]
    got = {(r.source_id, r.rel_path): r.score for r in bm25.search(index(spark, ROWS + other), {"alpha": 1.5}).collect()}
    alone = found(bm25.search(index(spark, ROWS), {"alpha": 1.5}))
    assert got["s", "a.md"] == alone["a.md"] and ("o", "a.md") in got


def test_empty_text_is_a_document_and_missing_text_is_none(spark):
    rows = [("s", "dir/empty.md", "", [], ""), ("s", "dir/none.md", "", [], None)]
    assert {r.rel_path for r in index(spark, rows).docs.collect()} == {"dir/empty.md"}
    assert found(bm25.search(index(spark, rows), {"empty": 1.5})).keys() == {"dir/empty.md"}


def test_evidence_adds_up(spark):
    rows = bm25.evidence(index(spark), {"alpha": 1.5, "beta": 1.5}).where("rel_path = 'a.md'").orderBy("place").collect()
    assert [r.term for r in rows] == ["alpha", "beta"] and rows[0].fields == "body,title" and rows[1].fields == "body"
    assert math.floor(10 * sum(r.contribution for r in rows) + 0.5) == pytest.approx(found(bm25.search(index(spark), {"alpha": 1.5, "beta": 1.5}))["a.md"], abs=1)


def test_substring_scores(spark):
    rows = [("s", "needle.md", "Needle", ["needle"], "needle " * 9), ("s", "b.md", "t", [], "aaaa"), ("s", "c.md", "t", [], ""), ("s", "d.md", "t", [], None)]
    df = spark.createDataFrame(rows, ENTRY)
    assert found(bm25.substring_scores(df, "NEEDLE")) == {"needle.md": 10 + 5 + 3 + 1 + 4}
    assert found(bm25.substring_scores(df, "aa")) == {"b.md": 1 + 2}
    assert found(bm25.substring_scores(df, "(.*")) == {}


VECS = "source_id string, rel_path string, chunk_index int, embedding array<double>"


def q(*x):
    return F.array(*[F.lit(float(v)) for v in x])


def test_centre_and_denoising(spark):
    rows = spark.createDataFrame([("s", "a", 0, [1.0, 0.0]), ("s", "b", 0, [0.0, 1.0]), ("s", "c", 0, [1.0, 1.0, 1.0])], VECS)
    assert semantic.centres(rows).first().centre == pytest.approx([1 / 3, 1 / 3])
    moved = spark.range(1).select(V.without_centre(q(1, 0), q(0.5, 0.5)).alias("v")).first().v
    assert moved == pytest.approx([0.85 / math.hypot(0.85, 0.15), -0.15 / math.hypot(0.85, 0.15)])
    assert spark.range(1).select(V.without_centre(q(1, 0), q(1, 2, 3)).alias("v")).first().v == [1.0, 0.0]
    zero = spark.range(1).select(V.cosine(q(0, 0), q(1, 0)).alias("a"), V.cosine(q(1), q(1, 0)).alias("b"), V.cosine(q(1, 1), q(2, 2)).alias("c")).first()
    assert (zero.a, zero.b) == (0.0, 0.0) and zero.c == pytest.approx(1.0)


def angled(cos):
    return [cos, math.sqrt(1 - cos * cos)]


def test_bonus_strong_and_weak_files(spark):
    rows = [("s", "many", i, angled(0.3)) for i in range(8)] + [("s", "two", i, angled(c)) for i, c in enumerate((0.48, 0.25))] + [("s", "one", 0, angled(0.9))] + [("s", f"weak{i}", 0, angled(0.2 + i / 100)) for i in range(1, 6)] + [("s", "none", 0, angled(0.1))]
    got = {r.rel_path: (round(r.semantic_score, 6), r.chunks, r.strong) for r in semantic.search(spark.createDataFrame(rows, VECS), q(1, 0)).collect()}
    assert got["many"] == (0.55, 8, True) and got["two"] == (0.53, 2, True) and got["one"] == (0.9, 1, True)
    assert set(got) == {"many", "two", "one"}
    few = {r.rel_path for r in semantic.search(spark.createDataFrame(rows[10:], VECS), q(1, 0)).collect()}
    assert few == {"one", "weak5", "weak4", "weak3"}
    all_ = semantic.candidates(spark.createDataFrame(rows, VECS), q(1, 0))
    assert all_.count() == 9 and all_.where("rel_path = 'none'").first().score == 10


def test_first_chunk_wins_ties_and_filters_act_before_scoring(spark):
    rows = spark.createDataFrame([("s", "a", 3, [1.0, 0.0]), ("s", "a", 1, [1.0, 0.0]), ("s", "bad", 0, None)], VECS)
    got = semantic.candidates(rows, q(1, 0), include=F.col("rel_path") == "a").collect()
    assert [(r.rel_path, r.chunk_index, r.score) for r in got] == [("a", 1, 105)]


def test_fusion_by_hand(spark):
    kw = spark.createDataFrame([("s", "a", 1), ("s", "b", 2)], "source_id string, rel_path string, rank int")
    sem = spark.createDataFrame([("s", "b", 1), ("s", "c", 2)], "source_id string, rel_path string, rank int")
    got = {r.rel_path: r.score for r in semantic.fused(kw, sem).collect()}
    part = lambda a, b: math.floor(10000 * (1 / (60 + a) + 1 / (60 + b)) + 0.5)
    assert got == {"a": part(1, 120), "b": part(2, 1), "c": part(120, 2)}
    assert part(1, 1) == 328


def test_reranking_caps_order_and_fallback(spark):
    hits = spark.createDataFrame([(f"{i:02d}", i) for i in range(1, 31)], "rel_path string, rank int")
    flat = semantic.reranked(hits, lambda h: h.withColumn("rerank_score", (F.col("rank") % 2).cast("double"))).orderBy("place").collect()
    assert [r.rank for r in flat] == list(range(1, 20, 2))

    def broken(h):
        raise RuntimeError

    assert [r.rank for r in semantic.reranked_or_as_was(hits, broken)] == list(range(1, 31))
    assert len(semantic.reranked_or_as_was(hits, lambda h: h.limit(3).withColumn("rerank_score", F.lit(1.0)))) == 30
    assert len(semantic.reranked_or_as_was(hits, lambda h: h.withColumn("rerank_score", F.lit(1.0)))) == 10


def test_rerank_text(spark):
    one = spark.range(1).select(semantic.rerank_text(F.lit(" T "), F.lit(""), F.lit(""), F.lit("snip")).alias("a"), semantic.rerank_text(F.lit("T"), F.lit("H > I"), F.lit("body"), F.lit("snip")).alias("b")).first()
    assert (one.a, one.b) == ("T\n\nsnip", "T\n\nH > I\n\nbody")


def test_hashing_embedder(spark):
    e = embed.hashing_embedder(16)
    v = e(["alpha beta", "alpha beta", "", "gamma"])
    assert np.allclose(v[0], v[1]) and np.allclose(np.linalg.norm(v[[0, 3]], axis=1), 1) and not v[2].any()
    rows = spark.createDataFrame([(0, "alpha beta"), (1, None)], "i int, t string").select("i", embed.embedded(F.col("t"), e).alias("v")).orderBy("i").collect()
    assert np.allclose(rows[0].v, v[0]) and rows[1].v is None


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_postings_of_documents_are_counted_without_a_shuffle(spark):
    assert exchanges(index(spark).postings) == 0
    again = index(spark, [*ROWS, ("s", "a.md", "alpha", ["x"], "alpha Omega.")]).postings
    assert {(r.field, r.term): r.tf for r in again.where("rel_path = 'a.md'").collect()} == {("body", "alpha"): 2, ("body", "beta"): 2, ("body", "gamma"): 1, ("body", "omega"): 1, ("body", "omega."): 1, ("title", "alpha"): 2}


def test_counted_terms_are_the_expressions_terms(spark):
    texts = ["Foo. fooBar.baz a/b.c.md HTTPServer/x ./a.b/c.d/ x. . -- É9.a_b A.B a", "", "v1.2.3/readme.MD. e.g. i", None]
    rows = [("s", f"{i}.md", t, [], t) for i, t in enumerate(texts)]
    said = spark.createDataFrame(rows, ENTRY).where("content is not null").select("rel_path", T.terms(F.concat(T.bracketed(F.col("rel_path")), F.lit("\n"), F.col("content"))).alias("w")).collect()
    got = {r.rel_path: r for r in bm25.counted(spark.createDataFrame(rows, ENTRY)).collect()}
    for r in said:
        own = sorted(p.term for p in got[r.rel_path].found if p.field == "body" for _ in range(p.tf))
        assert own == sorted(r.w) and got[r.rel_path].len == len(r.w)
    assert len(got) == len(said) == 3


def test_document_frequencies_shuffle_only_counts(spark):
    df = bm25.frequencies(index(spark))
    assert exchanges(df) == 1 and {r.term: r.df for r in df.collect()}["delta"] == 2
    again = bm25.frequencies(index(spark, [*ROWS, ROWS[1]]))
    assert {r.term: r.df for r in again.collect()}["delta"] == 2


def test_searches_index_the_asked_terms_alone(spark):
    from tomeweave.plans import keyword_queries

    own = keyword_queries.index(spark, "/root/testdata/sf0.001")
    assert {r.term for r in own.postings.select("term").distinct().collect()} <= set(keyword_queries.QUERY)
    assert own.docs.count() == 200 and exchanges(own.postings) == 0


def test_scores_take_lengths_from_the_postings(spark):
    own = index(spark)
    wide = bm25.Index(own.docs, own.postings.drop("len"), own.stats)
    entries = spark.createDataFrame(ROWS, ENTRY)
    for score in (lambda i: bm25.legacy_scores(i, entries, ["beta", "delta"]), lambda i: bm25.search(i, {"beta": 1.5, "delta": 1.5})):
        assert score(own)._jdf.queryExecution().optimizedPlan().toString().count("Join ") == score(wide)._jdf.queryExecution().optimizedPlan().toString().count("Join ") - 1
        assert sorted(map(tuple, score(own).collect())) == sorted(map(tuple, score(wide).collect()))


@pytest.mark.parametrize("sources", [1, 3])
def test_batch_scores_documents_where_they_lie(spark, sources):
    rng = np.random.default_rng(3)
    rows = [(f"s{i % sources}", f"{i}.md", f"w{i % 7}", [], " ".join(f"w{x}" for x in rng.zipf(1.4, 20) % 40)) for i in range(60)]
    own = index(spark, rows)
    queries = spark.createDataFrame([(q, [f"w{x}" for x in rng.integers(0, 45, 6)]) for q in range(300)], "query_id long, terms array<string>")
    got = bm25.batch(own, queries, 4)
    assert exchanges(got) == 1
    want = bm25.batch(bm25.Index(own.docs, own.postings, own.stats), queries, 4)
    assert exchanges(want) > 1
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 1000
