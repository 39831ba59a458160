"""Analyser, metadata rules and chunkers."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tomeweave.functions import lexicon as L
from tomeweave.functions import text as T
from tomeweave.operators import analyze, bm25, chunk, compile, snippets
from tomeweave.sources import corpus

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "text,want",
    [
        ("parseHTTPRequest", ["parsehttprequest", "parse", "http", "request"]),
        ("foo_bar", ["foo_bar", "foo", "bar"]),
        ("src/lib/a.test.ts", ["src/lib/a.test.ts", "src/lib/a.test", "src", "lib", "a.test.ts", "a.test", "test", "ts"]),
        ("word. x", ["word.", "word"]),
        ("---", ["---"]),
        ("réaux", ["aux"]),
        ("数据库", ["数据", "据库"]),
        ("字", ["字"]),
        ("的 了", []),
        ("调用getName接口", ["调用", "getname", "get", "name", "接口"]),
        ("", []),
    ],
)
def test_terms(text, want):
    assert analyze.Analyser().terms(text) == want


def test_weights_and_positions():
    a = analyze.Analyser()
    tokens = {t.normalized: t for t in a("系统失败 DLMS v2")}
    assert (tokens["失败"].protected, tokens["失败"].weight) == (True, 1.3)
    assert tokens["系统"].weight == pytest.approx(0.2 * 0.35)
    assert a("系统", "title")[0].weight == pytest.approx(0.2 * (0.35 + 0.65 * 0.5))
    assert tokens["dlms"].sources == ("identifier",) and tokens["dlms"].weight == 1.5
    # a suppressed token keeps its place
    positions = [(t.normalized, t.position) for t in analyze.Analyser(segmenter=analyze.longest_words(["这个", "接口"]), recall=False)("接口 这个 接口")]
    assert positions == [("接口", 0), ("接口", 2)]


def test_dictionary_with_bigram_recall():
    a = analyze.Analyser(segmenter=analyze.longest_words(["倒排索引", "数据"]))
    tokens = {(t.normalized, t.start): t for t in a("倒排索引")}
    assert tokens["倒排索引", 0].weight == 1.5 and set(tokens["倒排索引", 0].sources) == {"dictionary", "domain"}
    assert tokens["排索", 1].weight == pytest.approx(0.2)
    assert a.status() == {"requested": "dictionary", "active": "dictionary"} and analyze.Analyser().status()["active"] == "bigram"


def test_domain_terms_of_ascii_need_other_neighbours():
    found = [(t.normalized, t.start) for t in analyze.Analyser()._domain("xDLMS DLMS_ (DLMS) 数据上送数据上送")]
    assert found == [("数据上送", 19), ("数据上送", 23), ("dlms", 13)]


def test_lexicon_file(tmp_path):
    (tmp_path / "l.tsv").write_text("term\tweight\ttype\n# note\nA\t9\tdomain\nB\t0\nC\tx\n", encoding="utf-8")
    assert L.lexicon(str(tmp_path / "l.tsv")) == [("A", 2.0, "domain"), ("B", 0.05, "domain")]


def test_expressions_give_the_analysers_terms(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("aBc1_./- é") for _ in range(rng.randrange(30))) for _ in range(800)] + [r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.terms(F.col("t")).alias("w")).collect()
    a = analyze.Analyser()
    for r in rows:
        assert sorted(r.w) == sorted(a.terms(texts[r.i])), texts[r.i]


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet=st.sampled_from("aA0_./-数据的 é𠀀İ"), max_size=30))
def test_spans_hold_their_terms(text):
    for t in analyze.Analyser()(text):
        assert analyze.lowered(text)[t.start : t.end].lower() == t.normalized and t.weight > 0


def rows_of(spark, content, path="a/b.md"):
    return spark.createDataFrame([("s", path, content)], "source_id string, rel_path string, content string")


@pytest.mark.parametrize(
    "content,title,tags",
    [
        ("no head", "b", []), ("# One\ntext", "One", []), ("---\ntitle: \"Front\"\ntags: [x, 'y', ]\n---\n# Head\n", "Front", ["x", "y"]), ("---\ntitle: Front\n---\ntext\n# Head\n", "Head", []), ("---\ntags: [x]\n---\n\n# Head", "b", ["x"]),
        ("---\ntitle: Front\n---\nno head", "Front", []), ("---\r\ntitle: F\r\n---\r\n", "b", []), ("## Two\n", "b", []), ("---\ntags:\n - a\n---\n", "b", []),
    ],
)
def test_title_and_tags(spark, content, title, tags):
    r = rows_of(spark, content).select(T.title_of(F.col("content"), F.col("rel_path")).alias("t"), T.tags_of(F.col("content")).alias("g")).first()
    assert (r.t, r.g) == (title, tags)


def test_scan_keeps_what_the_rules_keep(spark, tmp_path):
    for name in ("a.md", "_x.md", ".x.md", "_d/y.md", ".d/y.md", "node_modules/z.md", "b.MD", "c.txt", "sub/deep/e.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe")
    got = corpus.scan(spark, str(tmp_path)).collect()
    assert {r.rel_path for r in got} == {"a.md", "_x.md", ".x.md", "_d/y.md", "sub/deep/e.md"}
    assert all(r.content == r.rel_path and r.mtime.endswith("Z") for r in got)
    assert corpus.scan(spark, str(tmp_path / "c.txt")).count() == 0


def test_paths(spark):
    rows = spark.createDataFrame([(p,) for p in ("a/b.md", "./a//b", "\\x\\y.md", "../z", "ab/c.md", "a")], "p string")
    assert [r[0] for r in rows.select(T.normal_path(F.col("p"))).collect()] == ["a/b.md", "a/b", "x/y.md", None, "ab/c.md", "a"]
    assert [r.p for r in rows.where(T.under(F.col("p"), "a/")).collect()] == ["a/b.md", "a"]
    assert rows.where(T.under(F.col("p"), "a/b.md")).count() == 1 and rows.where(T.under(F.col("p"), "")).count() == 6


DOC = """---
title: T
---
lead [[Link|l]]

# One
text *bold* and [a](u)
- [ ] task

### Deep
para

```py
x = "# no heading"
```
after [[Other#x]]

## 决策
""" + "why " * 20


def test_sections():
    got = chunk.cut("T", "d/f.md", DOC)
    assert [(c["heading"], c["level"], c["heading_path"]) for c in got] == [("T", 0, []), ("# One", 1, ["One"]), ("### Deep", 3, ["One", "Deep"]), ("", 0, []), ("## 决策", 2, ["One", "决策"])]
    assert got[0]["wikilinks"] == ["Link"] and got[3]["wikilinks"] == ["Other"] and got[3]["has_code"]
    assert got[1]["embed_text"] == "[d > f]\nOne\ntext bold and a\n[ ] task" and got[1]["has_tasks"]
    assert got[3]["embed_text"] == "[d > f]\n[代码: py]\nafter [[Other#x]]"
    assert (got[2]["start_line"], got[2]["end_line"], got[2]["raw_text"]) == (10, 11, "### Deep\npara")
    skipped = chunk.cut("T", "f.md", "# a\n### b\n### c")
    assert [c["heading_path"] for c in skipped[1:]] == [["a"], ["a", "b"], ["a", "c"]]
    assert [c["heading_path"] for c in chunk.cut("T", "f.md", "# a\n### b\n### c", compat=True)[1:]] == [["a"], ["a", "b"], ["a", "b", "c"]]


def test_section_edges():
    assert [c["heading"] for c in chunk.cut("T", "f.md", "")] == ["T"]
    assert [c["level"] for c in chunk.cut("T", "f.md", "Top\n===\nx\n\nSub\n---\ny\n##### five\nz")] == [0, 1, 2]
    assert chunk.cut("T", "f.md", "```\nnever closed\n# x")[1]["has_code"]
    assert len(chunk.cut("T", "f.md", "```\na\n```\n\n~~~\nb\n~~~")) == 2
    assert chunk.cut("T", "f.md", "<div>\n# x\n</div>\n\n***\ntext")[0]["heading"] == "T"


def test_chunk_types(spark):
    rows = spark.createDataFrame([("s", "f.md", "T", DOC), ("s", "g.md", "U", "# 架构\n" + "x " * 40 + "\n# Other\nwhat?\n# 灵感\n" + "y " * 40)], "source_id string, rel_path string, title string, content string")
    got = {(r.rel_path, r.heading): r.chunk_type for r in chunk.sections(rows).collect()}
    assert got == {("f.md", "T"): "reference", ("f.md", "# One"): "todo", ("f.md", "### Deep"): "reference", ("f.md", ""): "code", ("f.md", "## 决策"): "decision", ("g.md", "U"): "reference", ("g.md", "# 架构"): "architecture", ("g.md", "# Other"): "question", ("g.md", "# 灵感"): "idea"}


def test_regex_chunks_match_lines(spark):
    def brute(title, content):
        out = []
        for line in content.split("\n"):
            if len(line) - len(line.lstrip("#")) in (1, 2, 3, 4) and line.lstrip("#").startswith(" "):
                out.append([line.strip(), []])
            elif out:
                out[-1][1].append(line)
            else:
                out.append(["", [line]])
        out[0][0] = title
        return ["\n".join([h, "\n".join(x)]) if h else "\n".join(x) for h, x in out]

    rng = random.Random(4)
    texts = ["\n".join(rng.choice(["# a", "## b", "##### no", "text", "", "#none", "#### d e "]) for _ in range(rng.randrange(1, 9))) for _ in range(200)]
    rows = spark.createDataFrame([("s", f"{i}.md", "T", t) for i, t in enumerate(texts)], "source_id string, rel_path string, title string, content string")
    got = {}
    for r in chunk.by_heading(rows).orderBy("rel_path", "chunk_index").collect():
        got.setdefault(int(r.rel_path[:-3]), []).append(r.raw_text)
    for i, t in enumerate(texts):
        assert got[i] == brute("T", t), t


def test_metadata_rules(spark):
    cases = [("x" * 600 + "```a``` 错误", "# h", 0.95), ("TODO later", "", 0.1), ("short", "#### h", 0.3)]
    rows = spark.createDataFrame(cases, "t string, h string, want double")
    for r in rows.select(F.round(T.importance(F.col("t"), F.col("h")), 4).alias("got"), "want").collect():
        assert r.got == pytest.approx(r.want)
    r = spark.createDataFrame([("The cat_x and for 数据上送数据 Cat cat_x ab 可以",)], "t string").select(T.keywords(F.col("t")).alias("k"), T.plain(F.lit("# H\n* a `b` [c](d)\n\n\n1. e")).alias("p"), T.summary(F.lit("# H\n```x```  **b**")).alias("s")).first()
    assert r.k == ["The", "cat_x", "Cat", "数据上送", "数据"] and r.p == "H\n a b c\ne" and r.s == "H [代码]  b"


def test_snippets():
    text = "one\nTwo hit\nthree\nhit\nfive\nsix\nHIT\neight"
    assert snippets.around(text, ["hit"]) == "L1: one\nL2: Two hit\nL3: three\nL4: hit\nL5: five"
    assert snippets.around("x" * 300 + "hit", ["hit"]) == "L1: " + "x" * 100
    assert snippets.around(text, ["none"]) == ""


def test_replies(spark):
    replies = ['[{"key":"a","normalizedText":"b"}]', '[{"key":"a"}]', "```json\n[]\n```", "x", '{"segments":[{"topic":"t","normalizedText":"n"}]}']
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, r string")
    assert [r.n for r in rows.orderBy("i").select(F.size(compile.listed_results(F.col("r"))).alias("n")).collect()] == [1, None, 0, None, None]
    assert rows.select(F.size(compile.listed_results(F.col("r"), "topic")).alias("n"), "i").where("i = 4").first().n in (1, None)
    assert compile.parsed_reply('```\n{"topic":"a","normalizedText":"b"}\n```') == {"topic": "a", "normalizedText": "b", "concepts": [], "aliases": []}
    assert compile.parsed_reply("[1]") is None and compile.parsed_reply(None) is None and compile.parsed_reply('{"topic":"a"}') is None
    assert compile.ask(lambda p: 1 / 0, "p", "t", "c") is None
    assert "a.md" in compile.file_prompt("a.md", "t", "c") and "a.md" in compile.segments_prompt("a.md", "c") and "k1" in compile.chunks_prompt([{"key": "k1", "heading": "h", "raw_text": "r"}])


def test_analysed_fields(spark):
    rows = spark.createDataFrame([("s", "a/b.md", "Title 数据", ["tag"], "text foo_bar 失败")], "source_id string, rel_path string, title string, tags array<string>, content string")
    index = bm25.index_of_tokens(analyze.tokens_of(bm25.fields(rows)))
    got = {(r.field, r.term): (r.tf, r.positions, r.sources) for r in index.postings.collect()}
    assert got["body", "foo_bar"] == (1, [1], ["identifier"]) and got["body", "foo"][0] == 1 and ("tags", "tag") in got and ("path", "b") not in got
    assert index.docs.first().len == len(analyze.Analyser()("[a > b]\ntext foo_bar 失败"))


def test_sections_hold_few_chunks_at_once(spark):
    from unittest.mock import MagicMock

    import pyarrow as pa

    entries = MagicMock()
    chunk.sections(entries)
    chosen = entries.select.return_value
    (parse, _), = [c.args for c in (*chosen.mapInArrow.call_args_list, *chosen.mapInPandas.call_args_list)]
    text = "\n".join("## head\nsome words of a text" for _ in range(12_000))
    rows = pa.RecordBatch.from_pydict({"source_id": ["s"] * 9, "rel_path": [f"{i}.md" for i in range(9)], "title": ["t"] * 9, "content": [text] * 8 + [None]})
    got = list(parse(iter([rows])))
    assert max(x.num_rows for x in got) < 50_000 and sum(x.num_rows for x in got) == 8 * 12_001 + 1
