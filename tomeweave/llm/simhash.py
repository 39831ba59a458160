"""SimHash near-duplicates with pivot distance tables.

A fingerprint has a bit set if it is set in over half of the XXH64 hashes (seed 42) of a
document's word shingles. Fingerprints that differ in at most `radius` bits are linked;
a document's component is the smallest doc_id that links reach.

How links are found without forming all pairs:

1. Equal fingerprints become one class, so groups of exact copies cost one row.
2. Fingerprints are cut into blocks. Two that differ in at most r bits agree on at least
   (blocks - r) whole blocks, so rows are dealt by each choice of that many blocks. The number of
   blocks follows the number of classes, which keeps the rows that meet few.
3. The table of each class's Hamming distances to many reference fingerprints (pivots) is
   computed once. By the triangle inequality a pair is out if any coordinate differs by more than r:
   where rows meet they are walked in the order of the first coordinate, the others discard, and
   survivors are verified bit by bit.
4. Blocks on which more than `CROWD` classes agree are dealt again by further blocks before they
   meet in a task, until they are smaller or at most 16 bits are free, which bounds them. Each
   meeting place returns only a spanning forest of its links, never its pairs.
5. Components come from alternating large-star and small-star rounds, each settled in the
   shared folder.

Given a `similarity`, texts whose sets of five-word shingles have that Jaccard similarity are linked
as well. SimHash can't find these: at similarity 0.8 two fingerprints differ in about ten bits, too
many for blocks. Candidates share a band of MinHashes (a pair of similarity 0.8 is missed once in
about 2000). Within a band's bucket some texts at a time, taken from the smaller groups, are compared
with all others that nothing links to them yet, first by sketches: their MinHashes (which lose one
pair of similarity 0.8 in a million) and a map of bits, one set for each shingle, from which follows
the highest similarity that the pair can have (which loses none). What is left is compared exactly.
Then they leave the bucket, until all that is left
there is linked. So no link is lost, and a bucket of copies takes one comparison a text. Buckets and
comparisons are streams that hold a few hundred sketches or one text, dealt into parts where many meet.
The texts to compare exactly are picked by a broadcast of at most `FEW` hashes, else by a shuffled join.

Null and empty texts have fingerprint zero, linked like any other. Texts of any length are read
whole. Repeated rows and equal doc_ids are harmless; a null doc_id is never chosen as a component's
name unless it has no other. An empty table gives an empty result. Columns other than doc_id and text
are ignored.
"""

from __future__ import annotations

import functools
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, settle, small_batches, table, unpacked

BITS = 64
#: Above so many in one meeting place, rows are dealt again by further blocks; with so few free bits they are not.
CROWD, FEW_BITS = 16384, 16
#: Texts that are compared with one text by one task, at most about; texts of a bucket in one task, at most about; texts of a bucket compared with all others in the first and in later rounds; and in buckets of so few.
STREAM, PART, HUBS, SMALL = 512, 4096, (1, 4096), 64
#: MinHash bands and hashes in each; words of a shingle for similarity.
BANDS, DEPTH, WORDS = 32, 7, 5
#: Up to so many hashes of texts are broadcast (about 64 bytes each), so that only their texts are shuffled; beyond, all texts are.
FEW = 2_000_000
#: Bytes of a sketch: MinHashes, the number of shingles, the map of their bits.
LOW, NUMBER, MAP = BANDS * DEPTH // 2, 8, 128


def shingle_hashes(text: bytes | None, size: int) -> np.ndarray:
    """XXH64 of each run of `size` words, repeats included; the whole sequence if there are fewer; none without words."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts[: len(words) - size + 1].tolist(), (ends[size - 1 :] - 1).tolist())], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes, as a signed 64-bit number."""
    count = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].astype("<u8")
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * count > len(hashes)).astype(np.uint8), bitorder="little").view("<i8")[0])


@functools.cache
def permutations() -> tuple[np.ndarray, np.ndarray]:
    """Of 32-bit numbers: odd factors and terms."""
    rng = np.random.default_rng(11)
    times, plus = (rng.integers(0, 1 << 32, (BANDS * DEPTH, 1), dtype=np.uint32) for _ in range(2))
    return times | np.uint32(1), plus


def band_keys(grams: np.ndarray) -> tuple[np.ndarray, bytes]:
    """A key for each band of MinHashes of distinct shingle hashes, and their sketch: a byte of every second MinHash, their number, a map with a bit set for each; none without shingles."""
    if not len(grams):
        return np.empty(0, np.int64), b""
    times, plus = permutations()
    bits = np.zeros(MAP * 8, bool)
    bits[grams % np.uint64(MAP * 8)] = True
    number = len(grams)
    grams = (grams ^ (grams >> np.uint64(32))).astype(np.uint32)
    low = np.full(BANDS * DEPTH, (1 << 32) - 1, np.uint32)
    for at in range(0, len(grams), 128):
        np.minimum(low, (times * grams[None, at : at + 128] + plus).min(1), out=low)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in low.reshape(BANDS, DEPTH).T:
        key = (key ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64), low[::2].astype(np.uint8).tobytes() + np.array([number], "<i8").tobytes() + np.packbits(bits).tobytes()


def sizes_and_maps(sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of shingles and the maps of bits in sketches, a row each."""
    return np.ascontiguousarray(sketches[:, LOW : LOW + NUMBER]).view("<i8")[:, 0], np.ascontiguousarray(sketches[:, LOW + NUMBER :]).view(np.uint64)


def at_most(many: np.ndarray, maps: np.ndarray, number: int, own: np.ndarray) -> np.ndarray:
    """The highest Jaccard similarity that each of some sets, by size and map of bits, can have with one: a bit that only one of two maps has stands for a shingle that only that set has."""
    less, more = np.bitwise_count(own & ~maps).sum(1, dtype=np.int64), np.bitwise_count(maps & ~own).sum(1, dtype=np.int64)
    both = np.minimum(number - less, many - more)
    return both / (number + many - both)


def fingerprints(documents: DataFrame, shingle: int = 3, banded: bool = False) -> DataFrame:
    """(doc_id, text_hash, fp): one row per row of documents; banded: and `bands`, the keys of its MinHash bands, and `sketch`, a byte of MinHashes each."""
    small_batches(documents.sparkSession)

    def scan(batches):
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            fps = [fingerprint(shingle_hashes(t.as_py(), shingle)) for t in texts]
            columns, names = [batch.column(0), batch.column(1), pa.array(fps, pa.int64())], ["doc_id", "text_hash", "fp"]
            if banded:
                bands = [band_keys(np.unique(shingle_hashes(t.as_py(), WORDS))) for t in texts]
                columns += [pa.array([b for b, _ in bands], pa.list_(pa.int64())), pa.array([b for _, b in bands], pa.binary())]
                names += ["bands", "sketch"]
            yield pa.RecordBatch.from_arrays(columns, names)

    text = F.col("text").cast("string")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return rows.mapInArrow(scan, "doc_id long, text_hash long, fp long" + (", bands array<long>, sketch binary" if banded else ""))


def blocks_of(count: int) -> list[int]:
    """Masks of the blocks: 4 blocks up to about 4 million classes, 5 up to 2 billion, else 6."""
    n = 4 if count <= 1 << 22 else 5 if count <= 1 << 31 else 6
    edges = [BITS * i // n for i in range(n + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]


def pivots(count: int = 16) -> np.ndarray:
    return np.random.default_rng(20240607).integers(0, 1 << 64, count, dtype=np.uint64)


def pivot_table(fp: Column) -> Column:
    """The Hamming distance of a fingerprint to each pivot, a byte each."""
    return F.array(*[F.bit_count(fp.bitwiseXOR(F.lit(int(p)))).cast("byte") for p in pivots().view(np.int64)])


def roots_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n reaches over the links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(root, up := root[root]):
            root = up
        if np.array_equal(root, before):
            return root


def forest(fps: np.ndarray, table: np.ndarray, group: np.ndarray, radius: int) -> np.ndarray:
    """For rows sorted by group, with their pivot table: the row that each is linked to (itself if none), a spanning forest of links of at most radius bits within groups."""
    n = len(fps)
    if n < 2:
        return np.arange(n)
    table = table.astype(np.int16)
    order = np.lexsort((table[:, 0], group))
    fps, group, table = fps[order], group[order], table[order]
    last = np.searchsorted(group, group, side="right")
    # a walk ends where the first coordinate is more than radius ahead
    key = group.astype(np.int64) * 256 + table[:, 0]
    reach = np.minimum(np.searchsorted(key, key + radius, side="right"), last)
    root, pa_, pb_, held = np.arange(n), [], [], 0
    live = np.arange(n)
    step = 1
    while True:
        live = live[reach[live] > live + step]
        if not len(live):
            break
        a = live
        for c in range(1, table.shape[1]):
            a = a[np.abs(table[a, c] - table[a + step, c]) <= radius]
        a = a[np.bitwise_count(fps[a] ^ fps[a + step]) <= radius]
        if len(a):
            pa_.append(a)
            pb_.append(a + step)
            held += len(a)
        if held > 4 * n + 1_000_000:
            root = roots_of(n, np.concatenate([np.arange(n), *pa_]), np.concatenate([root, *pb_]))
            pa_, pb_, held = [], [], 0
        step += 1
    root = roots_of(n, np.concatenate([np.arange(n), *pa_]), np.concatenate([root, *pb_]))
    out = np.empty(n, np.int64)
    out[order] = order[root]
    return out


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def finer(mask: int, radius: int) -> list[int]:
    """The mask with each of radius + 1 blocks of the bits that it leaves free: two rows that differ in at most radius bits agree on one of these."""
    free = [1 << i for i in range(BITS) if not mask >> i & 1]
    return [mask | sum(free[len(free) * i // (radius + 1) : len(free) * (i + 1) // (radius + 1)]) for i in range(radius + 1)]


def dealt(classes: DataFrame, radius: int, crowd: int) -> DataFrame:
    """(mask, key, fp, table): rows of classes (fp, table) by the blocks on which they may agree."""
    blocks = blocks_of(classes.count())
    masks = [sum(chosen) for chosen in combinations(blocks, len(blocks) - radius)]
    by = lambda df, own: df.select(F.explode(own).alias("mask"), "fp", "table").select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("key"), "fp", "table")
    rows, done = by(classes, F.array(*[F.lit(signed(m)) for m in masks])), None
    while masks and BITS - max(m.bit_count() for m in masks) > FEW_BITS:
        crowded = settle(rows.groupBy("mask", "key").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("mask", "key"), "crowded")
        if crowded.isEmpty():
            break
        apart = rows.join(crowded, ["mask", "key"], "left_anti")
        done = apart if done is None else done.unionByName(apart)
        into = F.lit(None).cast("array<bigint>")
        for m in masks:  # a few hundred at most
            into = F.when(F.col("mask") == signed(m), F.array(*[F.lit(signed(x)) for x in finer(m, radius)])).otherwise(into)
        rows = settle(by(rows.join(crowded, ["mask", "key"], "left_semi"), into), "crowd")
        masks = sorted({signed(x) & ((1 << 64) - 1) for m in masks for x in finer(m, radius)})
    return rows if done is None else done.unionByName(rows)


def links(classes: DataFrame, radius: int, crowd: int = CROWD) -> DataFrame:
    """(a, b): links between different fingerprints of classes (fp, table), a spanning forest per meeting place."""

    def meet(batches):
        rest = None

        def linked(mask, key, fp, table):
            group = np.cumsum(np.concatenate(([True], (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])))) - 1
            root = forest(fp, table, group, radius)
            i = np.flatnonzero(root != np.arange(len(fp)))
            return pa.RecordBatch.from_arrays([pa.array(fp[i].view(np.int64)), pa.array(fp[root[i]].view(np.int64))], ["a", "b"])

        for batch in batches:
            mask, key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            table = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(len(fp), -1)
            own = mask, key, fp.astype(np.int64).view(np.uint64), table
            if rest:
                own = tuple(np.concatenate(x) for x in zip(rest, own))
            mask, key = own[:2]
            # the last group may go on in the next batch
            same = np.flatnonzero((mask != mask[-1]) | (key != key[-1]))
            cut = int(same[-1]) + 1 if len(same) else 0
            rest = tuple(x[cut:] for x in own)
            if cut:
                yield linked(*(x[:cut] for x in own))
        if rest and len(rest[0]):
            yield linked(*rest)

    rows = dealt(classes, radius, crowd)
    return rows.repartition("mask", "key").sortWithinPartitions("mask", "key").mapInArrow(meet, "a long, b long").where("a <> b").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of every node that has a link: alternating large-star and small-star rounds until the links are stars."""
    e = settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    digest = lambda x: tuple(x.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))).first())
    was = digest(e)
    while was[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        e = settle(small, name)
        now = digest(e)
        if now == was:
            break
        was = now
    stars = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets; 0 if one is empty."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Of pairs (h, hfp, t, tfp) of text hashes and fingerprints those (a, b), as fingerprints, whose texts (text_hash, text) have this similarity."""
    pairs = settle(pairs, "pairs")
    wanted = settle(pairs.select(F.col("h").alias("text_hash")).unionByName(pairs.select(F.col("t").alias("text_hash"))).distinct(), "wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= FEW else wanted

    def measure(batches):
        for batch in batches:
            grams = [np.unique(shingle_hashes(t.as_py(), WORDS)).tobytes() for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grams, pa.binary())], ["text_hash", "grams"])

    have = settle(texts.join(wanted, "text_hash", "left_semi").dropDuplicates(["text_hash"]).mapInArrow(measure, "text_hash long, grams binary"), "compared")
    many = pairs.groupBy("h").agg(F.ceil(F.count("*") / STREAM).cast("int").alias("parts"))
    hubs = have.join(many, have["text_hash"] == many["h"]).select("h", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "grams")
    others = pairs.join(many, "h").join(have, pairs["t"] == have["text_hash"]).select("h", F.pmod(F.xxhash64("t"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"), F.col("tfp").alias("a"), F.col("hfp").alias("b"), "grams")

    def compare(batches):
        own = np.empty(0, np.uint64)
        for batch in batches:
            kind, keep = batch.column(2).to_pylist(), []
            for i, grams in enumerate(batch.column(5).to_pylist()):
                grams = np.frombuffer(grams, np.uint64)
                if kind[i] == 0:
                    own = grams
                elif jaccard(own, grams) >= similarity:
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    rows = hubs.unionByName(others).repartition("h", "part").sortWithinPartitions("h", "part", "kind")
    return rows.mapInArrow(compare, "a long, b long").where("a <> b").distinct()


def sketched(asked: DataFrame, mixed: DataFrame, similarity: float) -> DataFrame:
    """(h, hfp, t, tfp): pairs of a hub and another member of its bucket (key, t, fp, root, sketch, n) in different groups, whose sketches allow the similarity: MinHashes five standard deviations below what it leads to, and maps of bits."""
    parts = F.ceil(F.col("n") / PART).cast("int")
    hubs = asked.select("key", "t", "fp", "root", "sketch", F.lit(0).alias("kind"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    rows = hubs.unionByName(mixed.select("key", "t", "fp", "root", "sketch", F.lit(1).alias("kind"), F.pmod(F.xxhash64("t", F.lit(3)), parts).cast("int").alias("part")))
    least = LOW * similarity - 5 * (LOW * similarity * (1 - similarity)) ** 0.5

    def meet(batches):
        at, h, hfp, hroot, hs = None, *(np.empty(0, np.int64),) * 3, np.empty((0, LOW + NUMBER + MAP), np.uint8)
        for batch in batches:
            key, t, fp, root, kind, part = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("key", "t", "fp", "root", "kind", "part"))
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, LOW + NUMBER + MAP)
            many, maps = sizes_and_maps(sketch)
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1]) | (kind[1:] != kind[:-1])) + 1
            out = []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)]):
                place = key[a], part[a]
                if kind[a] == 0:
                    if place == at:  # hubs that the last batch has cut in two
                        h, hfp, hroot, hs = (np.concatenate(x) for x in ((h, t[a:b]), (hfp, fp[a:b]), (hroot, root[a:b]), (hs, sketch[a:b])))
                    else:
                        at, h, hfp, hroot, hs = place, t[a:b], fp[a:b], root[a:b], sketch[a:b]
                    continue
                if place != at:
                    continue
                hmany, hmaps = sizes_and_maps(hs)
                for i in range(len(h)):
                    k = np.flatnonzero(((sketch[a:b, :LOW] == hs[i, :LOW]).sum(1) >= least) & (root[a:b] != hroot[i])) + a
                    k = k[at_most(many[k], maps[k], hmany[i], hmaps[i]) >= similarity]
                    if len(k):
                        out.append((np.full(len(k), h[i]), np.full(len(k), hfp[i]), t[k], fp[k]))
            columns = [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, np.int64)] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["h", "hfp", "t", "tfp"])

    columns = ["key", "t", "fp", "root", "sketch", "kind", "part"]
    return rows.select(columns).repartition("key", "part").sortWithinPartitions("key", "part", "kind").mapInArrow(meet, "h long, hfp long, t long, tfp long")


def similar_groups(documents: DataFrame, fps: DataFrame, near: DataFrame, similarity: float) -> DataFrame:
    """(node, root): components of fingerprints by near, links between them, and by texts of this similarity; fps with bands."""
    texts = documents.select(F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").alias("text"))
    each = settle(fps.dropDuplicates(["text_hash"]).select(F.col("text_hash").alias("t"), "fp", "bands", "sketch"), "texts")
    keys = each.select(F.explode("bands").alias("key"), "t")
    shared = settle(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "shared-bands")
    buckets = settle(keys.join(shared, "key").join(each.select("t", "fp", "sketch"), "t"), "buckets")
    found, roots, step = near, None, 0
    while True:
        rooted = buckets.withColumn("root", F.col("fp")) if roots is None else buckets.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        own = settle(rooted.select("key", "t", "fp", "sketch", "root"), "buckets")
        # the largest group of each bucket that has several
        groups = own.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "root")).alias("top"), F.count("*").alias("groups"), F.sum("n").alias("n")).where("groups > 1").select("key", "n", F.col("top.root").alias("most"))
        mixed = settle(own.join(groups, "key"), "mixed")
        if mixed.isEmpty():
            return components(found) if roots is None else roots
        slot = F.pmod(F.xxhash64("t", "key"), F.when(F.col("n") <= SMALL, SMALL).otherwise(HUBS[min(step, len(HUBS) - 1)]))
        asked = mixed.where("root <> most").groupBy("key", "n", slot.alias("slot")).agg(F.min(F.struct("t", "fp", "root", "sketch")).alias("hub"))
        asked = settle(asked.select("key", "n", "hub.*"), "hubs")
        pairs = sketched(asked, mixed, similarity).dropDuplicates(["h", "t"])
        more = settle(verified(pairs, texts, similarity), "similar")
        buckets = mixed.join(asked.select("key", "t"), ["key", "t"], "left_anti").select("key", "t", "fp", "sketch")
        # links between fingerprints count from here on
        if roots is None or not more.isEmpty():
            found = settle(found.unionByName(more), "linked")
            roots = components(found, "groups")
        step += 1


def near_duplicates(documents: DataFrame, shingle: int = 3, radius: int = 3, similarity: float | None = None) -> DataFrame:
    """(doc_id, text_hash, fp, component_id, root) for every row of documents; `root`, a fingerprint, tells components apart where ids are null or repeated."""
    fps = settle(fingerprints(documents, shingle, similarity is not None), "fingerprints")
    classes = settle(fps.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("table", pivot_table(F.col("fp"))), "classes")
    linked = links(classes.select("fp", "table"), radius)
    comp = components(linked) if similarity is None else similar_groups(documents, fps, settle(linked, "links"), similarity)
    named = classes.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.join(ids, "root").select("fp", "component_id", "root")
    return fps.join(by_fp, "fp").select("doc_id", "text_hash", "fp", "component_id", "root")


def keep_one(documents: DataFrame, shingle: int = 3, radius: int = 3, similarity: float | None = None) -> DataFrame:
    """One document of each component, the one of smallest doc_id; columns as they were."""
    near = settle(near_duplicates(documents, shingle, radius, similarity), "near-duplicates")
    first = near.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("k")).select(F.col("k.doc_id").alias("_id"), F.col("k.text_hash").alias("_hash"))
    rows = packed(documents, F.col("doc_id").cast("long").alias("_d"), F.xxhash64(F.col("text").cast("string")).alias("_h"))
    kept = rows.join(first.distinct(), F.col("_d").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hash")), "left_semi")
    if near.groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty():
        return kept.select(*unpacked(documents.columns))
    return kept.dropDuplicates(["_d", "_h"]).select(*unpacked(documents.columns))  # rows that are repeated


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=3)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
