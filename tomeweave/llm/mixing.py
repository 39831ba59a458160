"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source gets a target of words: weights share out the words of the whole corpus; a target
above `most` times its source stops there and the excess is shared again by weight. A source is
read `target div words` times whole; the rest is drawn from its blocks. Blocks are cut by hash
(about `block` documents each), permuted by another hash and taken whole until the next would
pass the rest; that one is cut into sub-blocks and treated alike, and the last sub-block gives
the documents that still fit, in permuted order. No document is cut.

Each source's block draws are a quota. A binary tree splits the quotas among the output shards:
at each node the left half's counts by source are multivariate hypergeometric, so every output
shard holds an exact number of blocks and all draws are used once. A shard's draws are a run of
each source's permuted sequence, disjoint from every other shard's; `drawn` orders rows within
it by hash.

The driver plans with one row per source (at most `most_sources`; more are refused) and the
block tables have at most 4096 rows per source. Only DataFrame functions run on the executors.

A null or empty text has no words and is never missing: it is kept as often as its block is
read, with nothing taken. Null sources form a source of their own, after all others. Equal rows
(doc_id, source and size) are decided alike. An empty table gives no rows. Other columns are
kept.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, settle, table, unpacked
from .sharding import small_table

SEED = 20240607


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], most: float) -> list[float]:
    """Shares of sum(sizes) by weight, none above most times its size, the excess shared again by weight."""
    out, open_ = [0.0] * len(sizes), list(range(len(sizes)))
    left = float(sum(sizes))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        for i in over or open_:
            out[i] = float(most * sizes[i]) if over else unit * weights[i]
        if not over:
            break
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def splitting_tree(quotas: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Draws by source and output shard: rows sum to the quotas, columns differ by one at most."""
    rng = np.random.default_rng(seed)
    out = np.zeros((len(quotas), shards), np.int64)

    def part(left: np.ndarray, n: int) -> np.ndarray:
        got, rest, total = np.zeros_like(left), n, int(left.sum())
        for i, q in enumerate(left.tolist()):  # the marginals, one source after the other
            total -= q
            got[i] = rng.hypergeometric(q, total, rest) if 0 < rest and q + total else 0
            rest -= int(got[i])
        return got

    def node(left: np.ndarray, a: int, b: int) -> None:
        if b - a == 1:
            out[:, a] = left
            return
        mid = (a + b) // 2
        total = int(left.sum())
        mine = part(left, total * (mid - a) // (b - a))
        node(mine, a, mid)
        node(left - mine, mid, b)

    node(np.array(quotas, np.int64), 0, shards)
    return out


class Mix:
    """The plan: small tables that tell each document how often it is read and by which output shards."""

    def __init__(self, rows: DataFrame, weights=(1, 2, 3), most: int = 3, block: int = 512, shards: int = 64, most_sources: int = 100_000, seed: int = SEED):
        """rows: doc_id, source, size (settled)."""
        spark, self.seed, self.shards = rows.sparkSession, seed, shards
        found = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs"))
        if found.count() > most_sources:
            raise ValueError(f"more than {most_sources} sources")
        found = sorted(found.collect(), key=lambda r: (r.source is None, r.source or ""))
        want = targets([r.size for r in found], [weights[i % len(weights)] for i in range(len(found))], most)
        self.parts = max(1, round(sum(r.size for r in found) / shards / 100_000))
        plan = []
        for r, t in zip(found, want):
            whole = min(most, int(t // r.size)) if r.size else 1
            plan.append({"source": r.source, "source_size": r.size, "target": t, "whole": whole, "rest": max(0.0, t - whole * r.size) if whole < most and r.size else 0.0, "blocks": min(4096, max(1, round(r.docs / block)))})
        schema = "source string, source_size bigint, target double, whole int, rest double, blocks int"
        self.sources = settle(small_table(spark, plan, schema), "mix-sources")
        keyed = self._blocked(rows)
        subs = F.greatest(F.lit(1), F.least(F.lit(4096), F.round(F.col("_docs") / block))).cast("int").alias("_subs")
        self.blocks = settle(self._filled(keyed, "_block", "rest").select("*", subs), "mix-blocks")
        edge = self.blocks.where("_fit = 1").select("source", "_block", "_left", "_subs")
        inner = self._matched(keyed, edge, ["source", "_block"]).where("_left is not null").select("source", "doc_id", "size", "_left", "_subs")
        inner = settle(inner.withColumn("_sub", F.pmod(self._hash("sub"), F.col("_subs")).cast("int")), "mix-edge")
        self.subs = settle(self._filled(inner, "_sub", "_left"), "mix-subs")
        last = self.subs.where("_fit = 1").select(F.col("source").alias("_s"), F.col("_sub").alias("_t"), F.col("_left").alias("_room"))
        some = inner.join(F.broadcast(last), (F.col("source").eqNullSafe(F.col("_s"))) & (F.col("_sub") == F.col("_t")))
        some = some.groupBy("source", "doc_id", "size", "_room").agg(F.count("*").alias("n"))
        listed = some.groupBy("source", "_room").agg(F.array_sort(F.collect_list(F.struct(self._hash("fill").alias("h"), "doc_id", "size", "n"))).alias("docs"))
        kind = "struct<room:double,took:array<struct<doc_id:bigint,size:bigint>>>"
        took = F.aggregate(
            "docs",
            F.struct(F.col("_room").alias("room"), F.array().cast("array<struct<doc_id:bigint,size:bigint>>").alias("took")).cast(kind),
            lambda acc, d: F.when(d.size * d.n <= acc.room, F.struct((acc.room - d.size * d.n).alias("room"), F.concat(acc.took, F.array(F.struct(d.doc_id.cast("bigint").alias("doc_id"), d["size"].alias("size")))).alias("took")).cast(kind)).otherwise(acc),
        )
        self.picks = settle(listed.select("source", F.explode(took["took"]).alias("p")).select("source", "p.doc_id", "p.size"), "mix-picks")
        part = {r.source: r.n for r in self.blocks.where("_fit >= 1").groupBy("source").agg(F.count("*").alias("n")).collect()}
        quotas = [p["whole"] * p["blocks"] + part.get(p["source"], 0) for p in plan]
        counts = splitting_tree(quotas, shards, seed)
        firsts = np.cumsum(counts, 1) - counts
        self.firsts = settle(small_table(spark, [{"source": p["source"], "firsts": f.tolist()} for p, f in zip(plan, firsts)], "source string, firsts array<bigint>"), "mix-shards")

    def _hash(self, what: str, *cols: str) -> Column:
        return F.xxhash64(F.lit(f"{what}{self.seed}"), *(cols or ("doc_id",)))

    def _with_source(self, df: DataFrame, small: DataFrame, *names: str) -> DataFrame:
        small = small.select(F.col("source").alias("_s"), *names)
        return df.join(F.broadcast(small), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")

    def _blocked(self, df: DataFrame) -> DataFrame:
        df = self._with_source(df, self.sources, "source_size", "target", "whole", "rest", "blocks")
        return df.withColumn("_block", F.pmod(self._hash("block"), F.col("blocks")).cast("int"))

    def _filled(self, df: DataFrame, part: str, room: str) -> DataFrame:
        """Parts of each source in permuted order: `_fit` 2 taken whole, 1 taken in part (with `_left` words), 0 not taken."""
        parts = df.groupBy("source", part).agg(F.sum("size").alias("_words"), F.count("*").alias("_docs"), F.first(room).alias("_room"))
        order = Window.partitionBy("source").orderBy(self._hash("order", "source", part), part)
        upto = F.sum("_words").over(order.rowsBetween(Window.unboundedPreceding, 0))
        parts = parts.select("source", part, "_docs", "_room", "_words", (F.row_number().over(order) - 1).alias("_rank"), upto.alias("_upto"))
        before = F.col("_upto") - F.col("_words")
        fit = F.when(F.col("_upto") <= F.col("_room"), 2).when(before <= F.col("_room"), 1).otherwise(0)
        return parts.select("source", part, "_docs", "_rank", fit.alias("_fit"), (F.col("_room") - before).alias("_left"))

    def _matched(self, df: DataFrame, small: DataFrame, on: list[str], bound: int = 500_000) -> DataFrame:
        """Left join, null sources meeting; broadcast if the table is small, else shuffled."""
        names = {c: f"_r{i}" for i, c in enumerate(on)}
        other = small.withColumnsRenamed(names)
        both = F.lit(True)
        for c, r in names.items():
            both = both & F.col(c).eqNullSafe(F.col(r))
        return df.join(F.broadcast(other) if small.count() <= bound else other, both, "left").drop(*names.values())

    def decided(self, df: DataFrame) -> DataFrame:
        """df (doc_id, source, size and more) with source_size, target, repeats and mix_shards (the output shard of each reading)."""
        df = self._matched(self._blocked(df), self.blocks.select("source", "_block", "_rank", "_fit", "_subs"), ["source", "_block"])
        df = df.withColumn("_sub", F.when(F.col("_fit") == 1, F.pmod(self._hash("sub"), F.col("_subs")).cast("int")))
        df = self._matched(df, self.subs.select("source", "_sub", F.col("_fit").alias("_subfit")), ["source", "_sub"])
        df = self._matched(df, self.picks.withColumn("_pick", F.lit(1)), ["source", "doc_id", "size"])
        more = F.when(F.col("_fit") == 2, 1).when((F.col("_fit") == 1) & (F.col("_subfit") == 2), 1).when((F.col("_fit") == 1) & (F.col("_subfit") == 1), F.coalesce("_pick", F.lit(0))).otherwise(0)
        df = df.withColumn("repeats", (F.col("whole") + more).cast("int"))
        df = self._with_source(df, self.firsts, "firsts")
        draw = lambda i: F.size(F.filter("firsts", lambda f: f <= i * F.col("blocks") + F.col("_rank"))) - 1
        at = F.when(F.col("repeats") > 0, F.transform(F.sequence(F.lit(0), F.col("repeats") - 1), draw)).otherwise(F.array().cast("array<int>"))
        return df.withColumn("mix_shards", at).drop("whole", "rest", "blocks", "_block", "_rank", "_fit", "_subs", "_sub", "_subfit", "_pick", "firsts")

    def drawn(self, df: DataFrame) -> DataFrame:
        """One row per reading, dealt by output shard and shuffled within it: by hash into parts of about a hundred thousand words, and by hash within each part."""
        df = self.decided(df).select("*", F.posexplode("mix_shards").alias("_reading", "mix_shard"))
        df = df.withColumn("_at", self._hash("shuffle", "doc_id", "_reading")).withColumn("_part", F.pmod("_at", F.lit(self.parts)))
        return df.repartition("mix_shard", "_part").sortWithinPartitions("mix_shard", "_part", "_at").drop("mix_shards", "_reading", "_at", "_part")


def mixed(documents: DataFrame, weights=(1, 2, 3), most: int = 3, shards: int = 64, name: str | None = "mix_shard") -> DataFrame:
    """The mix itself: documents as often as they are drawn, dealt by output shard and shuffled within it, with the shard under a name, if one is given."""
    size = words_in(F.col("text"))
    mix = Mix(settle(documents.select("doc_id", "source", size.alias("size")), "mix-sizes"), weights, most, shards=shards)
    return mix.drawn(packed(documents, "doc_id", "source", size.alias("size"))).select(*unpacked(documents.columns, name or ""), *([F.col("mix_shard").alias(name)] if name else []))


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    rows = settle(documents.select("doc_id", "source", words_in(F.col("text")).alias("size")), "mix-sizes")
    out = Mix(rows).decided(rows)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).cast("long").alias("taken"), "repeats", F.array_join(F.col("mix_shards").cast("array<string>"), ",").alias("mix_shards"))
