"""The engine end to end: loading, changes, scopes, semantic search, enrichment, and the store below."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tomeweave.operators import embed, semantic
from tomeweave.plans import engine as E
from tomeweave.sources.store import Conflict, Store
from tomeweave.streaming import changes


def write(root, files):
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text, encoding="utf-8")


def paths(df):
    return [r.rel_path for r in df.collect()]


@pytest.fixture
def wiki(spark, tmp_path):
    root = tmp_path / "Wiki One"
    write(root, {"a.md": "# Alpha\nzebra apple", "sub/b.md": "# Beta\nzebra banana", "sub/c.md": "---\ntags: [fruit]\n---\n# Gamma\ncherry"})
    e = E.Engine(spark, str(tmp_path / "home"), embed.hashing_embedder(32))
    sid = e.add_source(str(root))
    return e, sid, root


def test_load_search_and_change(wiki):
    e, sid, root = wiki
    assert sid.startswith("wiki-one-") and len(sid.rsplit("-", 1)[1]) == 10
    assert e.load(sid) == {"new": 3}
    assert e.load("Wiki One") == {"unchanged": 3}
    version = e.store.version()
    assert paths(e.search("apple")) == ["a.md"] and paths(e.search("fruit")) == ["sub/c.md"]
    assert paths(e.entries(sid, "sub")) == ["sub/b.md", "sub/c.md"]
    # an edit outside of the engine shows after the next load only
    write(root, {"a.md": "# Alpha\nmango"})
    assert paths(e.search("mango")) == [] and e.store.version() == version
    assert e.load(sid) == {"changed": 1, "unchanged": 2}
    assert paths(e.search("mango")) == ["a.md"] and paths(e.search("apple")) == []
    assert e.modify("sub/b", "# Beta\nkiwi") and paths(e.search("kiwi")) == ["sub/b.md"] and paths(e.search("banana")) == []
    assert e.rename("sub/b.md", "Renamed") and e.read("sub/b.md").startswith("---\ntitle: Renamed\n---") and e.entries(sid, "sub/b.md").first().title == "Renamed"
    assert e.move("sub/b.md", "moved/d") and paths(e.search("kiwi")) == ["moved/d.md"] and e.read("sub/b.md") is None
    assert e.create(sid, "new/E.MD", "# Eps\nlychee") == "new/E.md" and paths(e.search("lychee")) == ["new/E.md"]
    assert e.create(sid, "new/E", "x") == "exists:new/E.md" and e.create("none", "x", "") == "source-not-found:none" and e.create(sid, "../x", "") == "invalid-path:../x"
    assert e.modify("new/E", "") and paths(e.search("lychee")) == [] and e.read("new/E.md") == ""
    assert e.delete("new/E.md") and e.read("new/E.md") is None and not (root / "new/E.md").exists()
    assert not e.delete("new/E.md") and not e.modify("none", "x") and not e.move("a.md", "sub/c.md")
    # what changes left is what a full load gives
    fresh = E.Engine(e.spark, str(root.parent / "other"), embed.hashing_embedder(32))
    fresh.add_source(str(root))
    fresh.load_all()
    for name in ("docs", "postings", "chunks", "vectors"):
        both = [sorted(map(str, x._rows(name).select(sorted(x._rows(name).columns)).collect())) for x in (e, fresh)]
        assert both[0] == both[1], name
    before = e.status()
    e.store.compact()
    assert {**e.status(), "version": 0} == {**before, "version": 0} and paths(e.search("kiwi")) == ["moved/d.md"]
    assert e.modify("moved/d", "plum") and paths(e.search("plum")) == ["moved/d.md"] and paths(e.search("kiwi")) == []


def test_one_chunk_changed_means_one_embedding(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()
    inner = embed.hashing_embedder(16)

    def counting(texts):
        import uuid

        (asked / uuid.uuid4().hex).write_text("\n---\n".join(texts))
        return inner(texts)

    write(tmp_path / "w", {"g.md": "# Guide\nintro\n## First\none\n## Second\ntwo"})
    e = E.Engine(spark, str(tmp_path / "home"), counting)
    sid = e.add_source(str(tmp_path / "w"))
    e.load(sid)
    old = {r.chunk_index: r.embedding for r in e._rows("vectors").collect()}
    for f in asked.iterdir():
        f.unlink()
    e.modify("g.md", "# Guide\nintro\n## First\none\n## Second\nchanged")
    texts = [t for f in asked.iterdir() for t in f.read_text().split("\n---\n")]
    new = {r.chunk_index: r.embedding for r in e._rows("vectors").collect()}
    assert texts == ["[g]\nSecond\nchanged"] and [i for i in old if old[i] != new[i]] == [3]


def test_scopes(spark, tmp_path):
    for name in ("one", "two"):
        write(tmp_path / name, {"same.md": f"# S\nshared {name}", "in/x.md": "# X\nshared", "out/y.md": "# Y\nother"})
    e = E.Engine(spark, str(tmp_path / "home"), embed.hashing_embedder(32))
    one, two = e.add_source(str(tmp_path / "one")), e.add_source(str(tmp_path / "two"))
    assert e.add_source(str(tmp_path / "one")) == one and [s["id"] for s in e.sources()] == [one, two]
    e.load_all()
    for mode in ("keyword", "semantic", "hybrid"):
        assert {r.source_id for r in e.search("shared", mode, "two").collect()} == {two}
        assert set(paths(e.search("shared", mode, "one", "in"))) == {"in/x.md"}
    assert {(r.source_id, r.rel_path) for r in e.search("shared").collect()} == {(s, p) for s in (one, two) for p in ("same.md", "in/x.md")}
    with pytest.raises(ValueError):
        e.search("shared", prefix="in")
    with pytest.raises(KeyError):
        e.search("shared", which="none")
    assert not e.modify("same.md", "x") and e.modify("same.md", "# S\nquince", "one")
    assert e.read("same.md", "two").endswith("two") and [r.source_id for r in e.search("quince").collect()] == [one]
    assert e.remove_source("two").endswith("two") and paths(e.search("shared", which="one")) == ["in/x.md"] and e.status()["sources"] == 1
    assert e.entries().where(F.col("source_id") == two).count() == 0


def test_without_models(spark, tmp_path):
    write(tmp_path / "w", {"a.md": "# A\nword one", "b.md": "# B\nother"})
    e = E.Engine(spark, str(tmp_path / "home"))
    sid = e.add_source(str(tmp_path / "w"))
    assert paths(e.search("word")) == [] and e.status()["files"] == 0
    e.load(sid)
    assert paths(e.search("word", "hybrid")) == ["a.md"] and paths(e.search("word", "semantic")) == [] and paths(e.search("...")) == []
    assert not e.compile("a.md", sid) and e.compile_all() == 0
    with pytest.raises(ValueError):
        e.search("x", "odd")
    with pytest.raises(ValueError):
        E.Reranking(inputs=0)


def test_reranking(spark, tmp_path):
    write(tmp_path / "w", {f"n{i}.md": f"# N{i}\ntopic item{i}" for i in range(5)} | {f"decoy{i}.md": f"# D\nnothing{i}" for i in range(6)})
    last = lambda h: h.withColumn("rerank_score", -F.col("rank").cast("double"))
    e = E.Engine(spark, str(tmp_path / "home"), embed.hashing_embedder(32), scorer=last)
    sid = e.add_source(str(tmp_path / "w"))
    e.load(sid)
    assert len(paths(e.search("topic", "hybrid"))) == 11
    before = paths(e.search("topic", "hybrid").orderBy("rank"))
    e.reranking = E.Reranking(True, 4, 3)
    assert paths(e.search("topic", "hybrid").orderBy("place")) == before[:3]
    e.scorer = lambda h: h.withColumn("rerank_score", F.col("rank").cast("double"))
    assert paths(e.search("topic", "hybrid").orderBy("place")) == before[3:0:-1]
    assert len(paths(e.search("topic", "keyword"))) == 5


def test_enrichment(wiki):
    e, sid, root = wiki
    e.load(sid)
    reply = json.dumps({"topic": "durian", "normalizedText": "It smells.", "concepts": ["spikes"], "aliases": ["stinkfruit"]})
    e.model = lambda prompt: f"```json\n{reply}\n```" if "a.md" in prompt else "sorry"
    assert e.compile_all(limit=5) == 1
    assert paths(e.search("durian")) == ["a.md"] and paths(e.search("stinkfruit")) == ["a.md"] and e.status()["compiled"] == 1
    assert e._rows("vectors").where("chunk_index is null").count() == 1
    # enrichment of an earlier text counts no more
    e.modify("a.md", "# Alpha\nnew words")
    assert paths(e.search("durian")) == [] and e.status()["compiled"] == 0 and e._rows("vectors").where("chunk_index is null").count() == 0

    def meddling(prompt):
        e.modify("sub/b.md", "# Beta\nmeanwhile")
        return reply

    e.model = meddling
    assert not e.compile("sub/b.md", sid)


def test_chunks(wiki):
    e, sid, root = wiki
    e.load(sid)
    assert [r.heading for r in e.chunks("a.md", sid).collect()] == ["Alpha", "# Alpha"]
    assert [r.chunk_index for r in e.chunk_context("a.md", sid, 1).collect()] == [0, 1]


def test_targets():
    assert E.target_path("a\\b.MD") == "a/b.md" and E.target_path("./x") == "x.md"
    for bad in ("", "/a", "C:\\a", "a/../b", "\0", "."):
        with pytest.raises(ValueError):
            E.target_path(bad)


def test_links_out_of_a_source_are_refused(wiki, tmp_path):
    e, sid, root = wiki
    e.load(sid)
    (tmp_path / "outside").mkdir()
    (root / "link").symlink_to(tmp_path / "outside")
    assert e.create(sid, "link/x", "y") == "invalid-path:link/x"


def test_store_conflicts_and_formats(spark, tmp_path):
    s, other = Store(spark, str(tmp_path / "h")), Store(spark, str(tmp_path / "h"))
    rows = spark.createDataFrame([("s", "a", 1), ("s", "b", 2)], "source_id string, rel_path string, v int")
    s.commit(rows, {"t": rows})
    s.commit(rows.where("rel_path = 'a'"), {"t": rows.where("rel_path = 'a'").withColumn("v", F.lit(9))})
    assert sorted((r.rel_path, r.v) for r in other.read("t").collect()) == [("a", 9), ("b", 2)]
    other.version = lambda: 1
    with pytest.raises(Conflict):
        other.commit(settings={"x": 1})
    assert s.read("none") is None and s.settings() == {}
    s.commit(rows, {"t": rows.limit(0)})
    assert s.read("t").count() == 0
    (tmp_path / "h/log/000000000009.json").write_text(json.dumps({"format": 0, "version": 9}))
    with pytest.raises(ValueError):
        s.log()


def test_change_feed_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(f"k{i % 7}", i, f"op{i}") for i in range(100)], "key string, seq int, op string")
    rows.repartition(5).write.parquet(str(tmp_path / "in"))
    seen: dict[str, int] = {}

    def apply(batch, number):
        for r in batch.collect():
            seen[r.key] = max(seen.get(r.key, -1), r.seq)

    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    changes.follow(stream, ["key"], ["seq"], apply, str(tmp_path / "cp")).awaitTermination()
    want = {r.key: r.seq for r in changes.latest(rows, ["key"], ["seq"]).collect()}
    assert seen == want and sum(r.coalesced for r in changes.latest(rows, ["key"], ["seq"]).collect()) == 100
    assert changes.cancelled(rows, "key", "k1").where("key = 'k1'").count() == 0


def test_semantic_rows_need_current_text(wiki):
    e, sid, root = wiki
    e.load(sid)
    rows, vector, centre = e._semantic("zebra", sid, F.lit(True))
    assert {r.rel_path for r in semantic.candidates(rows, vector, centre).collect()} == {"a.md", "sub/b.md", "sub/c.md"}


def test_hits_tell_what_was_found(wiki):
    e, sid, root = wiki
    write(root, {"long.md": "# Long\nzebra\n## Herd\nzebra zebra\n## Other\nnothing here"})
    e.load(sid)
    hit = e.search("zebra").where("rel_path = 'long.md'").first()
    assert [x.term for x in hit.evidence] == ["zebra"] and hit.evidence[0].contribution > 0 and "body" in hit.evidence[0].fields and hit.source_dir == str(root)
    assert hit.chunk_index is None and "zebra" in hit.snippet
    found = {r.rel_path: r for r in e.search("zebra", "semantic").collect()}
    assert all(r.snippet.startswith(("▸ ", "⚠️ 弱匹配 (")) for r in found.values()) and found["long.md"].chunk_index is not None
    best = found["long.md"]
    assert best.chunk_heading in ("Long", "Herd") and best.start_line in (1, 3) and best.heading_path[0] == "Long" and best.evidence is None
    mixed = e.search("zebra", "hybrid").where("rel_path = 'long.md'").first()
    assert mixed.evidence and mixed.snippet == mixed.chunk_heading and mixed.semantic_score is not None


def test_shown(spark):
    none = F.array().cast("array<string>")
    heads = F.array(F.lit("A"), F.lit("B"), F.lit("C"))
    cases = [
        (semantic.shown(F.lit("t"), F.lit("A"), none, F.lit(1), F.lit(True), F.lit(0.7)), "💡 t"),
        (semantic.shown(F.lit(None), F.lit("A"), heads, F.lit(3), F.lit(True), F.lit(0.7)), "▸ A | +2块: B, C"),
        (semantic.shown(F.lit(None), F.lit(None).cast("string"), none, F.lit(2), F.lit(True), F.lit(0.7)), " | +1块命中"),
        (semantic.shown(F.lit("t"), F.lit("A"), heads, F.lit(3), F.lit(False), F.lit(0.425)), "⚠️ 弱匹配 (43%)"),
    ]
    row = spark.range(1).select(*[c.alias(str(i)) for i, (c, _) in enumerate(cases)]).first()
    assert list(row) == [want for _, want in cases]


def test_pair_scorer_reads_title_heading_and_chunk(spark, tmp_path):
    write(tmp_path / "w", {f"n{i}.md": f"# N{i}\nintro\n## Part\ntopic item{i}" for i in range(5)})
    e = E.Engine(spark, str(tmp_path / "home"), embed.hashing_embedder(32), reranking=E.Reranking(True, 5, 5, 2))
    sid = e.add_source(str(tmp_path / "w"))
    e.load(sid)

    def load():
        def rate(pairs):
            assert len(pairs) <= 2 and all(q == "topic item3" for q, _ in pairs)
            return [float("N3" in t and "item3" in t) for _, t in pairs]

        return rate

    e.scorer = semantic.pair_scorer(load, e.reranking.batch)
    first = e.search("topic item3", "hybrid").orderBy("place").first()
    assert first.rel_path == "n3.md" and first.rerank_score == 1.0
    before = paths(e.search("topic item3", "hybrid").orderBy("rank"))
    e.scorer = semantic.pair_scorer(lambda: lambda pairs: [1.0], 8)  # too few scores: as it was
    assert paths(e.search("topic item3", "hybrid").orderBy("rank")) == before


def test_chunk_enrichment(wiki):
    e, sid, root = wiki
    e.load(sid)
    raw = e.raw_chunks(sid).where("rel_path = 'a.md'").orderBy("chunk_index").collect()
    total = e.raw_chunks(sid).count()
    last = raw[-1].chunk_index
    was = {r.chunk_index: r.embedding for r in e._rows("vectors").where("rel_path = 'a.md'").collect()}
    said = [{"chunk_index": last, "topic": "fruit", "normalizedText": "Apples.", "concepts": ["pome"]}, {"chunk_index": 99, "topic": "x", "normalizedText": "y"}]
    assert e.store_chunks("a.md", sid, said) == 1
    now = {r.chunk_index: r.embedding for r in e._rows("vectors").where("rel_path = 'a.md'").collect()}
    assert set(was) == set(now) and [i for i in was if was[i] != now[i]] == [last]
    assert e.raw_chunks(sid).count() == total - 1 and e.raw_chunks(sid, only_new=False).where("compiled").count() == 1
    assert paths(e.search("apple")) == ["a.md"]
    assert e.store_segments("a.md", sid, [{"topic": "one", "normalizedText": "First."}, {"topic": "two", "normalizedText": "Second."}]) == 2
    assert sorted(r.chunk_index for r in e._rows("vectors").where("rel_path = 'a.md'").collect()) == [0, 1] and e._rows("told").count() == 2
    assert e.store_chunks("a.md", sid, []) == 0
    # enrichment goes with the text
    e.modify("a.md", "# Alpha\nother")
    assert e._rows("told").count() == 0 and e.raw_chunks(sid).where("rel_path = 'a.md'").count() == e.chunks("a.md", sid).count()


def test_feed_and_models(wiki, spark, tmp_path):
    e, sid, root = wiki
    e.load(sid)
    write(root, {"a.md": "# Alpha\npapaya", "new.md": "# New\nfig"})
    (root / "sub/b.md").unlink()
    rows = [(sid, "a.md", 1), (sid, "a.md", 2), (sid, "a.md", 3), (sid, "new.md", 4), (sid, "sub/b.md", 5), (sid, "../out.md", 6), ("none", "x.md", 7)]
    spark.createDataFrame(rows, "source_id string, rel_path string, seq long").write.parquet(str(tmp_path / "feed"))
    stream = spark.readStream.schema("source_id string, rel_path string, seq long").parquet(str(tmp_path / "feed"))
    query = e.follow(stream, str(tmp_path / "point"))
    query.awaitTermination()
    assert query.exception() is None and e.fed == {"applied": 3, "superseded": 2, "unknown": 2}
    assert paths(e.search("papaya")) == ["a.md"] and paths(e.search("fig")) == ["new.md"] and paths(e.search("banana")) == []
    assert e.model_choice()["dim"] == 768 and e.select_model("none") is None
    assert e.select_model("bge-m3")["dim"] == 1024 and e.model_choice()["id"] == "bge-m3"
