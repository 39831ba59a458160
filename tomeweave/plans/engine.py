"""The facade: sources, entries, changes, search, enrichment and status over a store."""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..functions import lexicon as L
from ..functions import text as T
from ..operators import analyze, bm25, chunk, compile, embed, manifest, semantic, snippets
from ..sources.corpus import parsed, scan
from ..sources.store import Store
from ..streaming import changes as feed

KEY = ["source_id", "rel_path"]
EMPTY = "source_id string, rel_path string"
EVIDENCE = "array<struct<term:string,query_weight:double,document_weight:double,df:bigint,contribution:double,fields:string>>"
PLACES = "array<struct<chunk_index:int,heading:string,heading_path:array<string>,start_line:int,end_line:int>>"


@dataclass(frozen=True)
class Reranking:
    enabled: bool = False
    inputs: int = 20
    outputs: int = 10
    batch: int = 8

    def __post_init__(self):
        if min(self.inputs, self.outputs, self.batch) < 1:
            raise ValueError("inputs, outputs and batch must be positive")


def source_id(path: str) -> str:
    """A readable name of a folder and ten digits of its path's SHA-256."""
    real = os.path.realpath(path)
    name = unicodedata.normalize("NFKD", os.path.basename(real))
    slug = re.sub(r"[^\w]+", "-", "".join(c for c in name if not unicodedata.combining(c))).strip("-_").lower() or "source"
    return f"{slug}-{hashlib.sha256(real.encode()).hexdigest()[:10]}"


def target_path(path: str) -> str:
    """The path of a file to write, relative to its source and with the suffix .md; ValueError if it isn't one."""
    if "\0" in path or path.startswith(("/", "\\")) or re.match(r"^[A-Za-z]:", path):
        raise ValueError("invalid path")
    parts = [p for p in path.replace("\\", "/").split("/") if p not in ("", ".")]
    if not parts or ".." in parts:
        raise ValueError("invalid path")
    name = "/".join(parts)
    return name[:-3] + ".md" if name.lower().endswith(".md") else name + ".md"


class Engine:
    """embedder, scorer and model stand for the models, which are passed in: texts to vectors, hits to hits with rerank_score, prompt to reply."""

    def __init__(self, spark: SparkSession, home: str, embedder: embed.Embedder | None = None, analyser: analyze.Analyser | None = None, reranking: Reranking | None = None, scorer: Callable[[DataFrame], DataFrame] | None = None, model: Callable[[str], str] | None = None):
        self.spark, self.store = spark, Store(spark, home)
        self.embedder, self.analyser, self.model = embedder, analyser or analyze.Analyser(), model
        self.reranking, self.scorer = reranking or Reranking(), scorer
        self.fed = {"applied": 0, "superseded": 0, "unknown": 0}

    # --- sources ------------------------------------------------------------------------
    def sources(self) -> list[dict]:
        """Registered sources in order of registration."""
        return self.store.settings().get("sources", [])

    def add_source(self, path: str) -> str:
        own = {"id": source_id(path), "name": os.path.basename(os.path.realpath(path)), "path": os.path.realpath(path)}
        if own["id"] not in {s["id"] for s in self.sources()}:
            self.store.commit(settings={"sources": [*self.sources(), own]})
        return own["id"]

    def remove_source(self, which: str) -> str | None:
        own = self.source(which)
        if own is None:
            return None
        kept = [s for s in self.sources() if s["id"] != own["id"]]
        self.store.commit(self._rows("entries").where(F.col("source_id") == own["id"]).select(*KEY), {}, {"sources": kept})
        return own["path"]

    def source(self, which: str) -> dict | None:
        """By id or path, else by a name that only one source has."""
        known = self.sources()
        exact = [s for s in known if which == s["id"] or os.path.realpath(which) == s["path"]]
        named = [s for s in known if s["name"] == which]
        return exact[0] if exact else named[0] if len(named) == 1 else None

    # --- tables -------------------------------------------------------------------------
    def _rows(self, name: str) -> DataFrame:
        found = self.store.read(name)
        if found is not None:
            return found
        extra = {"entries": ", title string, tags array<string>, content string, source_dir string, mtime string", "manifest": ", md5 string, file_size int, semantic_md5 string, compiled_md5 string", "vectors": ", chunk_index int, content_md5 string, embedding array<double>", "docs": ", len int", "postings": ", term string, field string, tf int, token_weight double", "chunks": ", chunk_index int, heading string, level int, embed_text string, raw_text string, heading_path array<string>, wikilinks array<string>, start_line int, end_line int, chunk_type string", "told": ", chunk_index int, topic string, normalizedText string, concepts array<string>, aliases array<string>, keywords array<string>", "compiled": ", topic string, normalizedText string, concepts array<string>, aliases array<string>"}
        return self.spark.createDataFrame([], EMPTY + extra[name])

    def _apply(self, rows: DataFrame, gone: DataFrame | None = None) -> int:
        """Commit entries that are new or changed, and the keys of those that are gone."""
        rows = rows.persist()
        old, compiled = self._rows("manifest"), self._rows("compiled")
        keys = rows.select(*KEY)
        chunks = chunk.sections(rows)
        index = bm25.index_of_tokens(analyze.tokens_of(bm25.fields(rows, self._fields(compiled, rows)), self.analyser))
        state = manifest.hashed(rows).join(old.select(*KEY, "compiled_md5"), KEY, "left")
        tables = {"entries": rows, "chunks": chunks, "docs": index.docs, "postings": index.postings, "compiled": compiled.join(keys, KEY, "left_semi")}
        if self.embedder is not None:
            known = manifest.reused(chunks.select(*KEY, "chunk_index", "embed_text"), self._rows("vectors").where("chunk_index is not null"))
            fresh = embed.embedded(F.when(F.col("embedding").isNull(), F.col("embed_text")), self.embedder)
            tables["vectors"] = known.withColumn("embedding", F.coalesce("embedding", fresh)).drop("embed_text")
            state = state.withColumn("semantic_md5", F.col("md5"))
        else:
            state = state.withColumn("semantic_md5", F.lit(None).cast("string"))
        tables["manifest"] = state
        version = self.store.commit(keys if gone is None else keys.unionByName(gone.select(*KEY)), tables)
        rows.unpersist()
        return version

    def _fields(self, compiled: DataFrame, rows: DataFrame) -> DataFrame:
        """Enrichment of the text as it is, as fields of the index."""
        now = rows.select(*KEY, F.md5("content").alias("md5"))
        kept = compiled.join(self._rows("manifest").select(*KEY, "compiled_md5"), KEY).join(now, KEY).where("compiled_md5 = md5")
        join = lambda c: F.coalesce(F.array_join(c, " "), F.lit(""))
        own = F.array(*[F.struct(F.lit(n).alias("field"), v.alias("text")) for n, v in (("topic", F.coalesce("topic", F.lit(""))), ("normalizedText", F.coalesce("normalizedText", F.lit(""))), ("concepts", join("concepts")), ("aliases", join("aliases")))])
        return kept.select(*KEY, F.inline(own))

    # --- loading and changes --------------------------------------------------------------
    def load(self, which: str) -> dict[str, int]:
        """Bring a source's tables in line with its files; only what has changed is worked on."""
        own = self.source(which)
        if own is None:
            raise KeyError(which)
        found = parsed(scan(self.spark, own["path"]), own["id"], own["path"]).persist()
        was = self._rows("manifest").where(F.col("source_id") == own["id"])
        status = manifest.diff(manifest.hashed(found), was).persist()
        count = {r.status: r["count"] for r in status.groupBy("status").count().collect()}
        if set(count) - {"unchanged"}:
            self._apply(found.join(status.where("status in ('new', 'changed')").select(*KEY), KEY, "left_semi"), status.where("status = 'deleted'"))
        found.unpersist()
        status.unpersist()
        return count

    def load_all(self) -> dict[str, dict[str, int]]:
        return {s["id"]: self.load(s["id"]) for s in self.sources()}

    def _refresh(self, own: dict, *paths: str) -> None:
        """Read some files of a source again."""
        rows = []
        for path in paths:
            full = os.path.join(own["path"], path)
            if os.path.isfile(full):
                with open(full, encoding="utf-8", newline="") as file:
                    rows.append((path, file.read(), str(os.stat(full).st_mtime)))
        files = self.spark.createDataFrame(rows, "rel_path string, content string, mtime string")
        gone = self.spark.createDataFrame([(own["id"], p) for p in paths], EMPTY)
        self._apply(parsed(files, own["id"], own["path"]), gone)

    def _target(self, path: str, which: str | None) -> tuple[dict, str] | str:
        """The one registered file that a change means, or what is wrong."""
        try:
            name = target_path(path)
        except ValueError:
            return "invalid-path"
        rows = self._rows("entries").where(F.col("rel_path") == name)
        if which is not None:
            own = self.source(which)
            if own is None:
                return "source-not-found"
            rows = rows.where(F.col("source_id") == own["id"])
        found = rows.select("source_id").limit(2).collect()
        if len(found) != 1:
            return "ambiguous" if found else "not-found"
        return self.source(found[0].source_id), name

    @staticmethod
    def _full(own: dict, name: str) -> str | None:
        """The file's place, if links don't lead out of the source."""
        full = os.path.realpath(os.path.join(own["path"], name))
        return full if full.startswith(own["path"] + os.sep) else None

    def create(self, which: str, path: str, content: str) -> str:
        own = self.source(which)
        if own is None:
            return f"source-not-found:{which}"
        try:
            name = target_path(path)
        except ValueError:
            return f"invalid-path:{path}"
        full = self._full(own, name)
        if full is None:
            return f"invalid-path:{path}"
        if os.path.exists(full):
            return f"exists:{name}"
        try:
            os.makedirs(os.path.dirname(full), exist_ok=True)
            with open(full, "x", encoding="utf-8", newline="") as file:
                file.write(content)
        except OSError:
            return f"write-failed:{name}"
        self._refresh(own, name)
        return name

    def modify(self, path: str, content: str, which: str | None = None) -> bool:
        found = self._target(path, which)
        if isinstance(found, str) or (full := self._full(*found)) is None or not os.path.isfile(full):
            return False
        with open(full, "w", encoding="utf-8", newline="") as file:
            file.write(content)
        self._refresh(*found)
        return True

    def rename(self, path: str, title: str, which: str | None = None) -> bool:
        """Set the title in the front matter."""
        found = self._target(path, which)
        if isinstance(found, str) or (full := self._full(*found)) is None or not os.path.isfile(full):
            return False
        with open(full, encoding="utf-8", newline="") as file:
            content = file.read()
        front = re.match(r"---\n(.*?)\n---", content, re.S)
        if front:
            lines = [x for x in front[1].split("\n") if x.split(":")[0].strip() != "title"]
            content = "\n".join(["---", f"title: {title}", *[x for x in lines if x], "---"]) + content[front.end() :]
        else:
            content = f"---\ntitle: {title}\n---\n\n{content}"
        return self.modify(path, content, which)

    def move(self, path: str, to: str, which: str | None = None) -> bool:
        found = self._target(path, which)
        try:
            name = target_path(to)
        except ValueError:
            return False
        if isinstance(found, str):
            return False
        own, was = found
        source, target = self._full(own, was), self._full(own, name)
        if source is None or target is None or os.path.exists(target) or not os.path.isfile(source):
            return False
        try:
            os.makedirs(os.path.dirname(target), exist_ok=True)
            os.rename(source, target)
        except OSError:
            return False
        self._refresh(own, was, name)
        return True

    def delete(self, path: str, which: str | None = None) -> bool:
        found = self._target(path, which)
        if isinstance(found, str) or (full := self._full(*found)) is None or not os.path.isfile(full):
            return False
        os.remove(full)
        self._refresh(*found)
        return True

    # --- reading --------------------------------------------------------------------------
    def _scope(self, which: str | None, prefix: str | None) -> tuple[str | None, object]:
        if prefix and which is None:
            raise ValueError("a path prefix needs a source")
        own = self.source(which) if which is not None else None
        if which is not None and own is None:
            raise KeyError(which)
        include = T.under(F.col("rel_path"), prefix)
        return (own["id"] if own else None), include

    def entries(self, which: str | None = None, prefix: str | None = None) -> DataFrame:
        own, include = self._scope(which, prefix)
        rows = self._rows("entries").where(include)
        return (rows if own is None else rows.where(F.col("source_id") == own)).orderBy("rel_path", "source_id")

    def read(self, path: str, which: str | None = None) -> str | None:
        """An entry's text; without a source also by the end of its path."""
        own, _ = self._scope(which, None)
        rows = self._rows("entries")
        name = path if path.lower().endswith(".md") else f"{path}.md"
        exact = F.col("rel_path").isin(path, name)
        if own is not None:
            hit = rows.where((F.col("source_id") == own) & exact)
        else:
            hit = rows.where(exact | F.col("rel_path").endswith(f"/{name}")).orderBy(F.desc(exact), "rel_path", "source_id")
        found = hit.select("content").first()
        return found.content if found else None

    def chunks(self, path: str, which: str) -> DataFrame:
        own, _ = self._scope(which, None)
        return self._rows("chunks").where((F.col("source_id") == own) & (F.col("rel_path") == path)).orderBy("chunk_index")

    def chunk_context(self, path: str, which: str, index: int, before: int = 1, after: int = 1) -> DataFrame:
        return self.chunks(path, which).where(F.col("chunk_index").between(index - before, index + after))

    def status(self) -> dict[str, int]:
        state = self._rows("manifest")
        own = state.agg(F.count("*").alias("files"), F.count("semantic_md5").alias("embedded"), F.count_if(F.coalesce(F.col("compiled_md5") == F.col("md5"), F.lit(False))).alias("compiled")).first()
        return {"sources": len(self.sources()), **own.asDict(), "chunks": self._rows("chunks").count(), "vectors": self._rows("vectors").count(), "version": self.store.version()}

    # --- search ---------------------------------------------------------------------------
    def _keyword(self, query: str, own: str | None, include, top: int) -> DataFrame:
        terms = self.analyser.query(query)
        scoped = lambda name: self._rows(name) if own is None else self._rows(name).where(F.col("source_id") == own)
        docs = scoped("docs")
        return bm25.search(bm25.Index(docs, scoped("postings"), bm25.statistics(docs)), terms or {"": 0.0}, top, include)

    def _semantic(self, query: str, own: str | None, include) -> tuple[DataFrame, object, DataFrame]:
        rows = self._rows("vectors") if own is None else self._rows("vectors").where(F.col("source_id") == own)
        rows = manifest.visible_vectors(rows, self._rows("manifest"))
        vector = F.array(*[F.lit(float(x)) for x in self.embedder([query])[0]])
        return rows, vector, semantic.centres(rows)

    def search(self, query: str, mode: str = "keyword", which: str | None = None, prefix: str | None = None, top: int = 50) -> DataFrame:
        """The best entries: source_id, rel_path, source_dir, title, tags, snippet, score and rank; of semantic finds the best chunk's place and heading, of keyword finds the evidence by term. All sources are ranked in one job, each by its own statistics."""
        if mode not in ("keyword", "semantic", "hybrid"):
            raise ValueError(mode)
        own, include = self._scope(which, prefix)
        if mode != "keyword" and self.embedder is None:
            mode = "keyword" if mode == "hybrid" else mode
        weights = self.analyser.query(query)
        if mode == "keyword":
            hits = self._keyword(query, own, include, 200)
        elif self.embedder is None:
            hits = self._keyword(query, own, F.lit(False), 1)
        else:
            rows, vector, centre = self._semantic(query, own, include)
            if mode == "semantic":
                hits = semantic.search(rows, vector, centre, include, listed=True)
            else:
                hits = semantic.fused(self._keyword(query, own, include, semantic.FUSION_TOP), semantic.candidates(rows, vector, centre, include=include))
        order = {s["id"]: i for i, s in enumerate(self.sources())}
        known = F.from_json(F.lit(json.dumps(order)), "map<string,int>")
        place = F.coalesce(F.element_at(known, F.col("source_id")), F.lit(len(order)))
        cut = max(top, self.reranking.inputs if mode == "hybrid" and self.reranking.enabled else top)
        empty = {"semantic_score": "double", "chunk_index": "int", "chunks": "long", "indexes": "array<int>", "strong": "boolean"}
        told = [F.col(c).cast(kind) if c in hits.columns else F.lit(None).cast(kind).alias(c) for c, kind in empty.items()]
        best = hits.select(*KEY, "score", F.col("rank").alias("_own"), *told).withColumn("_place", place).orderBy(F.desc("score"), "_place", "_own").limit(cut)
        page = best.collect()  # at most `cut` rows, which the tables below are then read for
        best = self.spark.createDataFrame([(*r, i + 1) for i, r in enumerate(page)], StructType([*best.schema.fields, StructField("rank", IntegerType())])).drop("_own", "_place")
        out = self._shown(best, {r.rel_path for r in page}, mode, query, weights)
        if mode == "hybrid" and self.reranking.enabled and self.scorer is not None:
            rows = semantic.reranked_or_as_was(out.withColumn("query", F.lit(query)), self.scorer, self.reranking.inputs, self.reranking.outputs)
            kinds = StructType([*out.schema.fields, StructField("rerank_score", DoubleType()), StructField("place", IntegerType())])
            return self.spark.createDataFrame([tuple(r.asDict().get(n) for n in kinds.names) for r in rows], kinds).drop("content", "text")
        return out.drop("content", "text").orderBy("rank").limit(top)

    def _shown(self, best: DataFrame, paths: set[str], mode: str, query: str, weights: dict[str, float]) -> DataFrame:
        """A page of hits with what is shown of each and the text that a re-ranker reads. Hits of hybrid search whose entry is gone keep their place with defaults."""
        mine = lambda name: self._rows(name).where(F.col("rel_path").isin(*paths) if paths else F.lit(False))
        best = F.broadcast(best)  # a page of hits
        entry = mine("entries").select(*KEY, "title", "tags", "source_dir", "content")
        rows = best.join(entry, KEY, "left" if mode == "hybrid" else "inner")
        if mode == "keyword":
            rows = rows.withColumn("_chunks", F.lit(None).cast(PLACES))
        else:
            place = F.struct("chunk_index", F.regexp_replace("heading", "^#+\\s*", "").alias("heading"), "heading_path", "start_line", "end_line")
            chunks = mine("chunks").select(*KEY, place.alias("c")).join(best.select(*KEY), KEY, "left_semi")
            rows = rows.join(chunks.groupBy(*KEY).agg(F.array_sort(F.collect_list("c")).alias("_chunks")), KEY, "left")  # a file's chunks
        if mode == "semantic":
            rows = rows.join(manifest.usable_compiled(mine("compiled"), mine("manifest")).select(*KEY, "topic"), KEY, "left")
        if weights and mode != "semantic":
            docs = self._rows("docs")
            why = bm25.evidence(bm25.Index(docs, self._rows("postings"), bm25.statistics(docs)), weights).join(best.select(*KEY), KEY, "left_semi")
            why = why.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "term", "query_weight", "document_weight", "df", "contribution", "fields"))), lambda e: e.dropFields("place")).alias("evidence"))  # a query's terms
            rows = rows.join(why, KEY, "left")
        else:
            rows = rows.withColumn("evidence", F.lit(None).cast(EVIDENCE))
        hit = F.get(F.filter("_chunks", lambda c: c["chunk_index"] == F.col("chunk_index")), F.lit(0))
        rows = rows.withColumn("_hit", hit).withColumn("chunk_heading", F.col("_hit.heading"))
        found = snippets.snippet(F.col("content"), list(weights) or [query.lower()])
        if mode == "semantic":
            heads = F.transform(F.filter("_chunks", lambda c: F.array_contains("indexes", c["chunk_index"])), lambda c: c["heading"])
            shown = semantic.shown(F.col("topic"), F.col("chunk_heading"), F.coalesce(heads, F.array().cast("array<string>")), F.col("chunks"), F.col("strong"), F.col("semantic_score"))
        elif mode == "hybrid":
            shown = F.when(F.coalesce("chunk_heading", F.lit("")) != "", F.col("chunk_heading")).otherwise(F.coalesce(found, F.lit("")))
        else:
            shown = found
        lines = F.array_join(F.slice(F.split("content", "\n"), F.col("_hit.start_line"), F.greatest(F.lit(1), F.col("_hit.end_line") - F.col("_hit.start_line") + 1)), "\n")
        path = F.array_join(F.coalesce("_hit.heading_path", F.array().cast("array<string>")), " > ")
        rows = rows.withColumn("snippet", shown).withColumn("title", F.coalesce("title", F.lit(""))).withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
        text = semantic.rerank_text(F.col("title"), F.when(path != "", path).otherwise(F.col("chunk_heading")), F.when(F.col("_hit").isNotNull(), lines), F.col("snippet"))
        return rows.select(*KEY, "source_dir", "title", "tags", "snippet", "score", "rank", "semantic_score", "chunk_index", "chunk_heading", "_hit.heading_path", "_hit.start_line", "_hit.end_line", "evidence", "content", text.alias("text"))

    # --- enrichment -----------------------------------------------------------------------
    def compile(self, path: str, which: str) -> bool:
        """Ask the model about a file and keep what it says, unless the file has changed meanwhile."""
        own, _ = self._scope(which, None)
        mine = lambda df: df.where((F.col("source_id") == own) & (F.col("rel_path") == path))
        row = mine(self._rows("entries")).first()
        if row is None or self.model is None:
            return False
        reply = compile.ask(self.model, path, row.title, row.content)
        now = mine(self._rows("entries")).first()
        if reply is None or now is None or now.content != row.content:
            return False
        md5 = hashlib.md5(row.content.encode()).hexdigest()
        keys = mine(self._rows("entries")).select(*KEY)
        result = self.spark.createDataFrame([(own, path, reply["topic"], reply["normalizedText"], reply["concepts"], reply["aliases"])], EMPTY + ", topic string, normalizedText string, concepts array<string>, aliases array<string>")
        state = mine(self._rows("manifest")).withColumn("compiled_md5", F.lit(md5))
        entry = mine(self._rows("entries"))
        fields = bm25.fields(entry, result.select(*KEY, F.inline(F.array(*[F.struct(F.lit(n).alias("field"), v.alias("text")) for n, v in (("topic", F.col("topic")), ("normalizedText", F.col("normalizedText")), ("concepts", F.array_join("concepts", " ")), ("aliases", F.array_join("aliases", " ")))]))))
        index = bm25.index_of_tokens(analyze.tokens_of(fields, self.analyser))
        tables = {"entries": entry, "manifest": state, "chunks": mine(self._rows("chunks")), "docs": index.docs, "postings": index.postings, "compiled": result, "told": mine(self._rows("told"))}
        if self.embedder is not None:
            told = F.struct("topic", "normalizedText", "concepts", "aliases")
            text = result.select(*KEY, compile.file_embedding_text(F.col("rel_path"), told).alias("t"))
            extra = text.select(*KEY, F.lit(None).cast("int").alias("chunk_index"), F.md5("t").alias("content_md5"), embed.embedded(F.col("t"), self.embedder).alias("embedding"))
            tables["vectors"] = mine(self._rows("vectors")).where("chunk_index is not null").unionByName(extra, allowMissingColumns=True)
        self.store.commit(keys, tables)
        return True

    def compile_all(self, limit: int | None = None) -> int:
        """Enrich files whose text has no enrichment yet, until `limit` succeed; one question at a time, as models are asked from the driver."""
        done = 0
        for r in manifest.uncompiled(self._rows("manifest")).orderBy(*KEY).toLocalIterator():
            if limit is not None and done >= limit:
                break
            done += self.compile(r.rel_path, r.source_id)
        return done

    def raw_chunks(self, which: str | None = None, only_new: bool = True) -> DataFrame:
        """(source_id, rel_path, chunk_index, heading, raw_text, compiled): chunks to enrich, those that are enriched too if asked for."""
        own, _ = self._scope(which, None)
        rows = self._rows("chunks") if own is None else self._rows("chunks").where(F.col("source_id") == own)
        done = self._rows("told").where("normalizedText <> ''").select(*KEY, "chunk_index", F.lit(True).alias("compiled"))
        rows = rows.select(*KEY, "chunk_index", "heading", "raw_text").join(done, [*KEY, "chunk_index"], "left").withColumn("compiled", F.coalesce("compiled", F.lit(False)))
        return rows.where("not compiled") if only_new else rows

    def store_chunks(self, path: str, which: str, results: list[dict]) -> int:
        """Keep what a model said of a file's chunks (chunk_index, topic, normalizedText, concepts, aliases, keywords) and embed them by it; results for chunks that don't exist are passed over. A change of the file drops it all."""
        return self._store_told(path, which, results, False)

    def store_segments(self, path: str, which: str, segments: list[dict]) -> int:
        """Keep a file's segments in place of its chunks' enrichment and vectors, numbered from 0."""
        return self._store_told(path, which, [{**s, "chunk_index": i} for i, s in enumerate(segments)], True)

    def _store_told(self, path: str, which: str, results: list[dict], instead: bool) -> int:
        own, _ = self._scope(which, None)
        mine = lambda name: self._rows(name).where((F.col("source_id") == own) & (F.col("rel_path") == path))
        rows = [(own, path, r["chunk_index"], r.get("topic") or "", r.get("normalizedText") or "", r.get("concepts") or [], r.get("aliases") or [], r.get("keywords") or []) for r in results]
        told = self.spark.createDataFrame(rows, self._rows("told").schema if not rows else EMPTY + ", chunk_index int, topic string, normalizedText string, concepts array<string>, aliases array<string>, keywords array<string>").dropDuplicates(["chunk_index"])
        chunks = mine("chunks")
        told = told.join(chunks.select(*KEY, "chunk_index"), [*KEY, "chunk_index"], "left_semi") if not instead else told
        told = self.spark.createDataFrame(told.collect(), told.schema)  # a file's results
        n = told.count()
        if not n:
            return 0
        same = ["source_id", "rel_path", "chunk_index"]
        old = mine("told").select(*told.columns)
        tables = {name: mine(name) for name in ("entries", "manifest", "chunks", "docs", "postings", "compiled")}
        tables["told"] = told if instead else told.unionByName(old.join(told.select(*same), same, "left_anti"))
        if self.embedder is not None:
            text = F.coalesce("raw_text", F.lit(""))
            rows = told.withColumnRenamed("keywords", "said").join(chunks.select(*same, "raw_text"), same, "left")
            keys = F.when(F.size("said") > 0, F.col("said")).otherwise(T.keywords(text))
            said = compile.chunk_embedding_text(T.content_class(F.col("rel_path")), T.temporal_anchor(text), F.col("topic"), F.col("concepts"), F.col("aliases"), keys, F.col("normalizedText"), text)
            new = rows.select(*same, said.alias("t")).select(*same, F.md5("t").alias("content_md5"), embed.embedded(F.col("t"), self.embedder).alias("embedding"))
            before = mine("vectors").where("chunk_index is null") if instead else mine("vectors").join(told.select(*same), same, "left_anti")
            tables["vectors"] = before.select(*new.columns).unionByName(new)
        self.store.commit(mine("entries").select(*KEY), tables)
        return n

    # --- feed and models ------------------------------------------------------------------
    def apply_changes(self, changes: DataFrame, number: int = 0) -> dict[str, int]:
        """Read the files named by changes (source_id, rel_path, seq) again, each once however often it changed; counts so far. Files are taken as they are now, so a batch that is sent again does no harm."""
        counted = changes if "coalesced" in changes.columns else feed.latest(changes.select(*KEY, "seq"), KEY, ["seq"])
        for source in [r.source_id for r in counted.select("source_id").distinct().collect()]:  # registered folders
            own = self.source(source)
            part: list[str] = []
            for row in counted.where(F.col("source_id") == source).orderBy("rel_path").toLocalIterator():
                if own is None or self._full(own, row.rel_path) is None:
                    self.fed["unknown"] += 1
                    continue
                self.fed["applied"] += 1
                self.fed["superseded"] += row.coalesced - 1
                part.append(row.rel_path)
                if len(part) == 500:
                    self._refresh(own, *part)
                    part = []
            if part:
                self._refresh(own, *part)
        return dict(self.fed)

    def follow(self, stream: DataFrame, checkpoint: str, once: bool = True):
        """Apply a stream of changes; with once, what has come so far, after which the query ends (awaitTermination drains it)."""
        return feed.follow(stream, KEY, ["seq"], self.apply_changes, checkpoint, once)

    @staticmethod
    def models() -> list[dict]:
        return [{"id": i, "dim": dim, "max_tokens": most} for i, dim, most in L.MODELS]

    def model_choice(self) -> dict:
        """The embedding model that is chosen, by default the first."""
        known = {m["id"]: m for m in self.models()}
        return known.get(self.store.settings().get("model"), self.models()[0])

    def select_model(self, which: str) -> dict | None:
        """Choose a known model; null for an unknown one. The embedder itself is passed in; vectors that are stored stay until their text changes."""
        if which not in {m["id"] for m in self.models()}:
            return None
        self.store.commit(settings={"model": which})
        return self.model_choice()
