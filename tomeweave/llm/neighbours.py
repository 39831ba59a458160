"""Approximate nearest neighbours with balanced posting lists.

1. Equal vectors become one class with its smallest ids; a class however large is indexed and
   searched once, and ties go to the smaller id.
2. Centroids come from a bounded sample (`sample` vectors, those of smallest hash): clusters are
   split until each holds at most its share of a posting list. Every class is then indexed.
3. A proximity graph joins the centroids; a best-first walk over it finds the centroids near a
   vector, for indexing and for searching.
4. A vector near a boundary goes to several lists: to up to `copies` whose centroid is within
   `spill` times the distance of the nearest.
5. Lists that grow beyond four times `per_list` get centroids of their own, fitted in tasks on a
   bounded sample of each list, and are split by these, level after level, each with a ratio of its own, so that lists stay
   bounded however many vectors there are. Only the first level is held in memory everywhere.
6. A query reads the lists whose centroid is within a ratio of its third nearest's distance, and in
   any case its nearest lists until they hold a full answer, each member counted in one list only;
   if that takes more than one list, those up to 1.4 times as far as well.
   The ratio is calibrated on the sample, as the least that finds the share `aim` of the sample's own
   neighbours: vectors in clusters are found in few lists, vectors without structure need many.
7. Lists and the queries that meet in one are dealt into parts of at most about `part` rows.
   Distances are taken in double precision on the original vectors, in blocks; each part returns
   its best, as far as they are as near as the sample's best, which count themselves, and the best
   over all remain.

Vectors that are null, zero or hold null or non-finite components take no part, nor do vectors of
another length than the commonest (the shorter if even) or rows without an id. Equal rows count
each. An empty table gives no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, ship, table

NEAREST = 10


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


class Centroids:
    """Centroids and the graph over them."""

    def __init__(self, centres: np.ndarray, degree: int = 24):
        self.centres, self.norms = centres, (centres**2).sum(1)
        n = len(centres)
        near = np.empty((n, min(degree, n)), np.int64)
        for at in range(0, n, 1024):
            d = squared(centres[at : at + 1024], centres)
            near[at : at + 1024] = np.argsort(d, 1, kind="stable")[:, : near.shape[1]]
        # a few far links keep the graph in one piece
        far = np.random.default_rng(5).integers(0, max(n, 1), (n, min(8, n)))
        self.links = np.concatenate([near, far], 1)
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 16)).astype(np.int64))

    def nearest(self, x: np.ndarray, width: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """For each row of x the `width` centroids that a best-first walk finds, nearest first, and their distances."""
        n, width = len(self.centres), min(width, len(self.centres))
        q, rows = len(x), np.arange(len(x))
        seen = np.zeros((q, n), bool)
        beam = np.full((q, width), -1)
        dist = np.full((q, width), np.inf)
        done = np.zeros((q, width), bool)
        new = np.tile(self.entries, (q, 1))
        live = rows
        while len(live):
            fresh = ~seen[live[:, None], new]
            seen[live[:, None], new] = True
            d = np.sqrt(np.maximum(self.norms[new] + (x[live] ** 2).sum(1)[:, None] - 2 * np.einsum("qnd,qd->qn", self.centres[new], x[live]), 0))
            d[~fresh] = np.inf
            ids = np.concatenate([beam[live], new], 1)
            ds = np.concatenate([dist[live], d], 1)
            fin = np.concatenate([done[live], np.zeros(new.shape, bool)], 1)
            # a centroid met twice in one step counts once
            order = np.lexsort((ids, ds), axis=1)
            ids, ds, fin = (np.take_along_axis(v, order, 1) for v in (ids, ds, fin))
            twice = np.zeros(ids.shape, bool)
            twice[:, 1:] = (ids[:, 1:] == ids[:, :-1]) & np.isfinite(ds[:, 1:])
            ds[twice] = np.inf
            order = np.argsort(ds, 1, kind="stable")[:, :width]
            beam[live], dist[live], done[live] = (np.take_along_axis(v, order, 1) for v in (ids, ds, fin))
            # the next `step` centroids of each beam that were not left yet
            open_ = ~done[live] & np.isfinite(dist[live])
            going = open_.any(1)
            live, open_ = live[going], open_[going]
            order = np.argsort(~open_, 1, kind="stable")[:, :step]
            order = np.where(np.take_along_axis(open_, order, 1), order, order[:, :1])
            done[live[:, None], order] = True
            new = self.links[beam[live[:, None], order]].reshape(len(live), order.shape[1] * self.links.shape[1])
        return beam, dist


def balanced(x: np.ndarray, most: int, seed: int = 3) -> np.ndarray:
    """Centroids of clusters of at most `most` rows: clusters are split in up to 8 by k-means until they fit."""
    rng = np.random.default_rng(seed)
    work, out = [np.arange(len(x))], []
    while work:
        rows = work.pop()
        own = x[rows]
        k = min(8, -(-len(rows) // most))
        if k < 2 or (own == own[0]).all():
            out.append(own.mean(0))
            continue
        centres = own[rng.choice(len(rows), k, replace=False)]
        for _ in range(12):
            to = squared(own, centres).argmin(1)
            count = np.bincount(to, minlength=k)
            centres = np.stack([own[to == i].mean(0) if count[i] else own[rng.integers(len(own))] for i in range(k)])
        to = squared(own, centres).argmin(1)
        if (to == to[0]).all():
            to = np.arange(len(rows)) % k
        work += [rows[to == i] for i in range(k) if (to == i).any()]
    return np.array(out)


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part; -0.0 is stored as 0.0."""
    v = F.transform(F.col("embedding").cast("array<double>"), lambda c: F.when(c == 0, F.lit(0.0)).otherwise(c))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    odd = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.where(~F.coalesce(odd, F.lit(True)) & F.exists("v", lambda c: c != 0))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (common.d if common else 0))


def classes(rows: DataFrame, keep: int = NEAREST + 1) -> DataFrame:
    """(v, members): distinct vectors with their `keep` smallest ids, ascending; no search needs more."""
    few = rows.withColumn("_n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("_n") <= keep)
    return few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("members"))


def split_share(x: np.ndarray, clusters: int) -> np.ndarray:
    return balanced(x, max(1, len(x) // max(1, clusters)))


def calibrated(x: np.ndarray, centres: np.ndarray, place, aim: float, tries: int = 256) -> tuple[float, int]:
    """The ratio within which the share `aim` of the neighbours of some sample vectors is found in the sample, and how many lists are within it for nine of ten. place: the lists of vectors and their distances."""
    asked = np.random.default_rng(9).permutation(len(x))[:tries]
    keep = min(NEAREST, len(x) - 1)
    if not keep:
        return 1.0, len(centres)
    far = np.sqrt(squared(x[asked], centres))
    third = measure_of(np.sort(far, 1))
    close = squared(x[asked], x)
    close[np.arange(len(asked)), asked] = np.inf
    close = np.argpartition(close, keep - 1, 1)[:, :keep]
    ids, dist = place(x[close.ravel()])
    ratio = np.where(np.isfinite(dist), far[np.repeat(np.arange(len(asked)), keep)[:, None], np.maximum(ids, 0)], np.inf).min(1) / np.repeat(third, keep)
    ratio = max(1.0, float(np.quantile(ratio, aim)))
    return ratio, int(np.quantile((far <= ratio * third[:, None]).sum(1), 0.9))


def measure_of(dist: np.ndarray) -> np.ndarray:
    """What ratios are taken of: the distance of the third centroid, as the nearest may be the vector's own. dist is sorted."""
    return np.maximum(dist[:, min(2, dist.shape[1] - 1)], 1e-12)


def listed(graph: Centroids, x: np.ndarray, copies: int, spill: float) -> tuple[np.ndarray, np.ndarray]:
    """The lists of the first level that vectors go to, nearest first, and the distances (infinite: none)."""
    ids, dist = graph.nearest(x, 32)
    ids, dist = ids[:, :copies], dist[:, :copies]
    return ids, np.where(dist <= spill * dist[:, :1] + 1e-12, dist, np.inf)


def divided(centres: np.ndarray, x: np.ndarray, spill: float) -> tuple[np.ndarray, np.ndarray]:
    """The same within a list that is split: two at most."""
    far = np.sqrt(squared(x, centres))
    ids = np.argsort(far, 1, kind="stable")[:, :2]
    dist = np.take_along_axis(far, ids, 1)
    return ids, np.where(dist <= spill * dist[:, :1] + 1e-12, dist, np.inf)


def reach(dist: np.ndarray, held: np.ndarray, ratio: float, apart: float = 1.4) -> np.ndarray:
    """Which lists, in order of distance, are read: those within the ratio, and the nearest until they hold NEAREST + 1 members. A query whose nearest list holds fewer lies apart from most: it reads all within `apart` times the distance at which it has enough."""
    before = np.cumsum(np.where(np.isfinite(dist), held, 0), 1) - held
    needed = np.isfinite(dist) & (before <= NEAREST)
    far = np.where(needed.sum(1) > 1, apart * np.where(needed, dist, 0).max(1), 0)
    return np.isfinite(dist) & (needed | (dist <= np.maximum(ratio * measure_of(dist), far)[:, None] + 1e-12))


def vectors_of(column: pa.Array, rows: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(rows, len(flat) // max(1, rows))


POSTED = "rep long, v array<double>, members array<long>, list long, first boolean"
PROBED = "rep long, v array<double>, list long, dist double"


def posted(classes: DataFrame, graph, copies: int, spill: float) -> DataFrame:
    """classes (rep, v, members) with a row for each list of the first level; `first` marks the nearest."""

    def deal(batches):
        own = graph()
        for batch in batches:
            x = vectors_of(batch.column(1), batch.num_rows)
            for at in range(0, len(x), 512):
                ids, dist = listed(own, x[at : at + 512], copies, spill)
                r, k = np.nonzero(np.isfinite(dist))
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(r + at)).columns, pa.array(ids[r, k].astype(np.int64)), pa.array(k == 0)], ["rep", "v", "members", "list", "first"])

    return classes.mapInArrow(deal, POSTED)


def probed(queries: DataFrame, graph, width: int, ratio: float, held: np.ndarray) -> DataFrame:
    """queries (rep, v) with a row for each list of the first level that they read, and its centroid's distance."""

    def deal(batches):
        own = graph()
        n = len(own.centres)
        for batch in batches:
            x = vectors_of(batch.column(1), batch.num_rows)
            for at in range(0, len(x), 256):
                some = x[at : at + 256]
                whole = np.arange(len(some))
                if 4 * width < n:
                    ids, dist = own.nearest(some, width)
                    good = reach(dist, held[np.maximum(ids, 0)], ratio)
                    r, k = np.nonzero(good)
                    # where the last list found is read, there may be more: these see all
                    whole = np.flatnonzero(good[:, -1])
                    mine = ~np.isin(r, whole)
                    r, k = r[mine], k[mine]
                    yield pa.RecordBatch.from_arrays([*batch.take(pa.array(r + at)).columns, pa.array(ids[r, k].astype(np.int64)), pa.array(dist[r, k])], ["rep", "v", "list", "dist"])
                far = np.sqrt(squared(some[whole], own.centres))
                order = np.argsort(far, 1, kind="stable")
                dist = np.take_along_axis(far, order, 1)
                r, k = np.nonzero(reach(dist, held[order], ratio))
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(whole[r] + at)).columns, pa.array(order[r, k].astype(np.int64)), pa.array(dist[r, k])], ["rep", "v", "list", "dist"])

    return queries.select("rep", "v").mapInArrow(deal, PROBED)


FOUND = "query long, rep long, low long, score double, members array<long>"


def in_sample(queries: DataFrame, sample) -> DataFrame:
    """The nearest NEAREST + 1 classes of the sample to each query: members of every answer, or what bounds it."""

    def look(batches):
        b, reps, members = sample()
        low = np.array([m[0] for m in members])
        keep = min(NEAREST + 1, len(b))
        for batch in batches:
            x, ids = vectors_of(batch.column(1), batch.num_rows), batch.column(0).to_numpy()
            out: list[list] = [[], [], [], [], []]
            for at in range(0, len(x), 128):
                rough = squared(x[at : at + 128], b)
                cut = np.partition(rough, keep - 1, 1)[:, keep - 1]
                for i in range(len(rough)):
                    j = np.flatnonzero(rough[i] <= cut[i] + 1e-9 * (1 + cut[i]))
                    d = np.sqrt(((b[j] - x[at + i]) ** 2).sum(1))
                    for k in np.lexsort((low[j], d))[:keep]:
                        for column, value in zip(out, (ids[at + i], reps[j[k]], low[j[k]], d[k], members[j[k]])):
                            column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["query", "rep", "low", "score", "members"])

    return queries.select("rep", "v").mapInArrow(look, FOUND)


def sized(postings: DataFrame) -> DataFrame:
    """(list, n, held): rows of each list, and members of those that are there first."""
    return settle(postings.groupBy("list").agg(F.count("*").alias("n"), F.sum(F.when(F.col("first"), F.size("members")).otherwise(0)).alias("held")), "list-sizes")


def refined(postings: DataFrame, probes: DataFrame, sizes: DataFrame, per_list: int, part: int, aim: float, spill: float, fan: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings, probes and sizes with each list of over 4 times per_list split into up to `fan`."""
    subs = F.least(F.lit(fan), F.ceil(F.col("n") / per_list)).cast("int")
    cut = settle(sizes.where(F.col("n") > 4 * per_list).select("list", "n", subs.alias("subs"), F.ceil(F.col("n") / part).cast("int").alias("parts")), "long-lists")
    drawn = postings.join(cut, "list").where(F.pmod(F.xxhash64("rep", F.lit(7)), F.lit(1 << 20)) < F.lit(1 << 20) * 8 * F.col("subs") / F.col("n"))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(group["v"].to_numpy())
        centres = split_share(x, int(group["subs"].iloc[0]))[:fan]
        ratio, _ = calibrated(x, centres, lambda v: divided(centres, v, spill), aim, 64)
        return pd.DataFrame({"list": group["list"].iloc[0], "sub": np.arange(len(centres)), "centre": list(centres), "ratio": ratio})

    # about 8 rows a centroid, 8 times fan at most
    centres = settle(drawn.select("list", "subs", "v").groupBy("list").applyInPandas(fit, "list long, sub long, centre array<double>, ratio double"), "list-centres")
    dealt = postings.join(cut.select("list", "parts"), "list").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    each = centres.join(cut.select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")), "list")

    def move(rows: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(c):
            return rows[["rep", "v", "members", "list", "first"]].assign(list=rows["list"] * fan)
        sub = c["sub"].to_numpy()
        order, dist = divided(np.stack(c["centre"].to_numpy()), np.stack(rows["v"].to_numpy()), spill)
        r, k = np.nonzero(np.isfinite(dist))
        out = rows[["rep", "v", "members", "list", "first"]].iloc[r].copy()
        out["list"] = out["list"].to_numpy() * fan + sub[order[r, k]]
        out["first"] = out["first"].to_numpy() & (k == 0)
        return out

    moved = dealt.groupBy("list", "part").cogroup(each.groupBy("list", "part")).applyInPandas(move, POSTED)
    kept = postings.join(cut, "list", "left_anti").withColumn("list", F.col("list") * fan).select("rep", "v", "members", "list", "first")
    postings = settle(kept.unionByName(moved), "postings")
    sizes = sized(postings)
    # the same for the queries
    held = centres.withColumn("_to", F.col("list") * fan + F.col("sub")).join(sizes.select(F.col("list").alias("_to"), "held"), "_to", "left").select("list", "sub", "centre", "ratio", F.coalesce("held", F.lit(0)).alias("held"))
    many = probes.join(cut.select("list"), "list").groupBy("list").agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
    many = settle(many, "query-parts")
    asked = probes.join(many, "list").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    each = held.join(many.select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")), "list")

    def look(rows: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(c):
            return rows[["rep", "v", "list", "dist"]].assign(list=rows["list"] * fan)
        far = np.sqrt(squared(np.stack(rows["v"].to_numpy()), np.stack(c["centre"].to_numpy())))
        order = np.argsort(far, 1, kind="stable")
        dist = np.take_along_axis(far, order, 1)
        r, k = np.nonzero(reach(dist, c["held"].to_numpy().astype(np.int64)[order], float(c["ratio"].iloc[0])))
        out = rows[["rep", "v", "list", "dist"]].iloc[r].copy()
        out["list"] = out["list"].to_numpy() * fan + c["sub"].to_numpy()[order[r, k]]
        out["dist"] = dist[r, k]
        return out

    looked = asked.groupBy("list", "part").cogroup(each.groupBy("list", "part")).applyInPandas(look, PROBED)
    same = probes.join(cut, "list", "left_anti").withColumn("list", F.col("list") * fan).select("rep", "v", "list", "dist")
    return postings, settle(same.unionByName(looked), "probes"), sizes


def nearest_neighbours(embeddings: DataFrame, every: int = 100, sample: int = 20_000, per_list: int = 128, copies: int = 4, spill: float = 1.02, aim: float = 0.97, part: int = 2048, fan: int = 512) -> DataFrame:
    """(query_id, rank, vec_id, score): the 10 nearest found of each row whose vec_id is divisible by `every`."""
    spark = embeddings.sparkSession
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > 4096:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    rows = settle(usable(embeddings), "vectors")
    whole = settle(classes(rows).select(F.monotonically_increasing_id().alias("rep"), "v", "members"), "vector-classes")
    count = whole.count()
    result = "query_id long, rank int, vec_id long, score double"
    if not count:
        return spark.createDataFrame([], result)
    drawn = whole.select("rep", "v", "members", F.xxhash64("v").alias("_h"), F.col("members")[0].alias("_low")).orderBy("_h", "_low").limit(sample).select("rep", "v", "members").toArrow().combine_chunks()
    x = vectors_of(drawn.column("v").chunk(0), len(drawn))
    # as many lists as the classes need, 8 sample rows each at least
    centres = split_share(x, max(1, min(count // per_list, len(x) // 8)))
    own = Centroids(centres)
    ratio, width = calibrated(x, centres, lambda v: listed(own, v, copies, spill), aim)
    width = max(16, width * 5 // 4)
    graph = ship(spark, own)
    postings = settle(posted(whole, graph, copies, spill), "postings")
    sizes = sized(postings)
    held = np.zeros(len(centres), np.int64)
    for r in sizes.collect():  # the first level's lists, at most `sample` / 8
        held[r.list] = r.held
    asked = rows.where(F.col("vec_id") % every == 0)
    queries = settle(asked.select("v").distinct().join(whole, "v").select("rep", "v"), "queries")
    seen = settle(in_sample(queries, ship(spark, (x, drawn.column("rep").to_numpy(), drawn.column("members").to_pylist()))), "in-sample")
    probes = settle(probed(queries, graph, width, ratio, held), "probes")
    longest = None
    while (n := sizes.agg(F.max("n")).first()[0]) is not None and n > 4 * per_list and n != longest:
        longest = n
        postings, probes, sizes = refined(postings, probes, sizes, per_list, part, aim, spill, fan)
    parts = sizes.select("list", F.ceil(F.col("n") / part).cast("int").alias("parts"))
    groups = settle(probes.groupBy("list").agg(F.ceil(F.count("*") / part).cast("int").alias("groups")).join(parts, "list"), "list-parts")
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    # no query needs more than what is as near as the last of the sample's
    bounds = seen.groupBy(F.col("query").alias("rep")).agg(F.when(F.count("*") > NEAREST, F.max("score") * (1 + 1e-9)).otherwise(F.lit(float("inf"))).alias("bound"))
    sought = probes.join(bounds, "rep").join(groups, "list").withColumn("group", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("groups")).cast("int")).select("rep", "v", "bound", "list", "group", upto("parts").alias("part"))
    dealt = postings.join(groups, "list").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).select("rep", "v", "members", "list", "part", upto("groups").alias("group"))

    def search(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        out = {"query": [], "rep": [], "low": [], "score": [], "members": []}
        if len(q) and len(p):
            b = np.stack(p["v"].to_numpy())
            reps, members = p["rep"].to_numpy(), p["members"].to_numpy()
            low = np.array([m[0] for m in members])
            keep = min(NEAREST + 1, len(b))
            for at in range(0, len(q), 256):
                a = np.stack(q["v"].iloc[at : at + 256].to_numpy())
                rough = squared(a, b)
                cut = np.partition(rough, keep - 1, 1)[:, keep - 1]
                for i, (rep, bound) in enumerate(zip(q["rep"].iloc[at : at + 256], q["bound"].iloc[at : at + 256])):
                    j = np.flatnonzero(rough[i] <= min(cut[i], bound * bound) + 1e-9 * (1 + cut[i]))
                    d = np.sqrt(((b[j] - a[i]) ** 2).sum(1))
                    order = np.lexsort((low[j], d))[:keep]
                    for k in order[d[order] <= bound]:
                        out["query"].append(rep)
                        out["rep"].append(reps[j[k]])
                        out["low"].append(low[j[k]])
                        out["score"].append(d[k])
                        out["members"].append(members[j[k]])
        kinds = {"query": "int64", "rep": "int64", "low": "int64", "score": "float64", "members": "object"}
        return pd.DataFrame({k: pd.Series(v, dtype=kinds[k]) for k, v in out.items()})

    meet = ["list", "part", "group"]
    found = sought.groupBy(*meet).cogroup(dealt.groupBy(*meet)).applyInPandas(search, FOUND)
    found = found.unionByName(seen).dropDuplicates(["query", "rep"])
    best = found.withColumn("_n", F.row_number().over(Window.partitionBy("query").orderBy("score", "low", "rep"))).where(F.col("_n") <= NEAREST + 1)
    best = best.groupBy("query").agg(F.collect_list(F.struct("score", "members")).alias("near"))
    # back to the rows: each query of a class meets the same members, less itself
    each = asked.join(queries.select("v", F.col("rep").alias("query")), "v").select(F.col("vec_id").alias("query_id"), "query").join(best, "query")
    pairs = F.flatten(F.transform("near", lambda c: F.transform(c.members, lambda m: F.struct(c.score.alias("score"), m.alias("vec_id")))))
    top = F.slice(F.filter(F.array_sort(pairs), lambda x: x.vec_id != F.col("query_id")), 1, NEAREST)
    return each.select("query_id", F.posexplode(top).alias("_r", "x")).select("query_id", (F.col("_r") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def op4_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))
