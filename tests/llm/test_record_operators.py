"""op1 to op4, op10 and the pipeline: laws, brute force and held-out accuracy, and their edge cases."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tomeweave.llm import mixing, neighbours, quality, sharding, toxicity

from .helpers import SF, benchmark, crc, embeddings, folder, labels, odd_rows, prose

BIG = "/root/testdata/sf0.1"


def size_of(text):
    return 8 + len((text or "").encode())


# --- op1 ------------------------------------------------------------------------------


def check_shards(rows, got):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, size_of(t), None if t is None else zlib.crc32(t.encode())) for d, t, *_ in rows)
    places = defaultdict(list)
    for r in got:
        places[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in places.values())
    assert all(0 <= r.shard < 24 and r.law == "bytes" and r.grown_shard is None for r in got)


def test_sharding_of_odd_rows(spark, tmp_path):
    rows = odd_rows()
    check_shards(rows, sharding.op1_sharding(spark, folder(tmp_path / "t", rows, extra=True)).collect())


def test_shards_have_near_equal_bytes(spark):
    got = sharding.op1_sharding(spark, BIG).select("shard", "size").collect()
    load = Counter()
    for r in got:
        load[r.shard] += r["size"]
    assert len(load) == 24 and max(load.values()) <= 1.01 * min(load.values())


def test_one_doc_id_in_a_third_of_the_rows_is_spread(spark, tmp_path):
    rows = [(7 if i % 3 == 0 else i, "x" * (i % 50), "en", "a", 1) for i in range(18_000)]
    got = sharding.op1_sharding(spark, folder(tmp_path / "t", rows)).collect()
    check_shards(rows, got)
    load = Counter()
    for r in got:
        load[r.shard] += r.size
    assert max(load.values()) <= 1.02 * min(load.values())


def test_slot_map_is_versioned_and_edited(spark, tmp_path):
    rng = random.Random(1)
    size = [rng.randrange(1, 200) for _ in range(2000)]
    first = sharding.SlotMap.even(8, 2000).rebalanced(size)
    first.stored(spark, str(tmp_path / "map"))
    grown = sharding.SlotMap.load(spark, str(tmp_path / "map"), 1).rebalanced(size, 9)
    assert (first.version, grown.version, grown.shards) == (1, 2, 9)
    moved = sum(s for s, a, b in zip(size, first.shard_of, grown.shard_of) if a != b)
    assert moved < 1.2 * sum(size) / 9
    load = Counter()
    for s, shard in zip(size, grown.shard_of):
        load[shard] += s
    assert max(load.values()) - min(load.values()) <= 2 * max(size)
    fewer = grown.rebalanced(size, 5)
    assert set(fewer.shard_of) == set(range(5))


# --- op2 ------------------------------------------------------------------------------


def brute_targets(sizes):
    weight, want, capped = [i % 3 + 1 for i in range(len(sizes))], [0.0] * len(sizes), set()
    while True:
        left = sum(sizes) - sum(3 * sizes[i] for i in capped)
        free = [i for i in range(len(sizes)) if i not in capped]
        over = [i for i in free if left * weight[i] / sum(weight[j] for j in free) > 3 * sizes[i]]
        if not over:
            break
        capped |= set(over)
    for i in range(len(sizes)):
        want[i] = 3.0 * sizes[i] if i in capped else left * weight[i] / sum(weight[j] for j in free)
    return want


def check_mix(rows, got, near):
    words = lambda t: len((t or "").encode().split())
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d, words(t)) for d, t, *_ in rows)
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += words(t)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, brute_targets([sizes[s] for s in names])))
    source = {}
    for d, t, _, s, _ in rows:
        source.setdefault((d, words(t)), s)
    taken, longest = Counter(), Counter()
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        by = (r.source_size, r.target)
        assert any(abs(want[s] - r.target) < 1e-6 * (1 + r.target) and sizes[s] == r.source_size for s in names)
        taken[by] += r.taken
        longest[by] = max(longest[by], r.size)
    for by, n in taken.items():
        assert by[1] - n <= near(longest[by]) and n <= by[1] + 1e-6, (by, n)


def test_mix_of_odd_rows(spark, tmp_path):
    rows = odd_rows()
    path = folder(tmp_path / "t", rows, extra=True)
    got = mixing.op2_mixing(spark, path).collect()
    check_mix(rows, got, lambda longest: longest)
    again = mixing.op2_mixing(spark, path).repartition(3).collect()
    assert Counter(tuple(r) for r in got) == Counter(tuple(r) for r in again)


def test_mix_of_many_documents(spark):
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{BIG}/documents.parquet").collect()]
    check_mix(rows, mixing.op2_mixing(spark, BIG).collect(), lambda longest: longest)


def test_splitting_tree_keeps_all_quotas():
    counts = mixing.splitting_tree([0, 1, 7, 1000, 12345], 13)
    assert counts.sum(1).tolist() == [0, 1, 7, 1000, 12345]
    assert counts.min() >= 0 and np.ptp(counts.sum(0)) <= 1
    assert (counts == mixing.splitting_tree([0, 1, 7, 1000, 12345], 13)).all()
    assert mixing.splitting_tree([0, 0], 4).sum() == 0


def test_mixed_documents_are_dealt_to_disjoint_shards(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randrange(1, 60)), "en", rng.choice(["a", "b", "c", None]), 1) for i in range(900)]
    docs = spark.read.parquet(folder(tmp_path / "t", rows, extra=True) + "/documents.parquet")
    got = mixing.mixed(docs, shards=8)
    assert set(got.columns) == set(docs.columns)
    rows_of = got.select("doc_id", "mix_shard", "size", "text").collect()
    assert {r["size"] for r in rows_of} == {"extra size"}
    report = {r.doc_id: r for r in mixing.op2_mixing(spark, str(tmp_path / "t")).collect()}
    assert Counter(r.doc_id for r in rows_of) == Counter({d: r.repeats for d, r in report.items() if r.repeats})
    assert {r.mix_shard for r in rows_of} <= set(range(8))


# --- op3 and op10 ---------------------------------------------------------------------


def accuracy(got, key, name):
    truth = key
    held = [(r.score, r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    pos, neg = [s for s, _, y in held if y], [s for s, _, y in held if not y]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    return auc, np.mean([p == y for _, p, y in held])


@pytest.mark.parametrize("name,query,folds,fold,cut,least", [("quality", quality.op3_quality, 4, 2, 0.7, 0.9), ("toxic", toxicity.op10_toxicity, 5, 0, 0.5, 0.9)])
def test_classifiers_on_the_held_out_fold(spark, name, query, folds, fold, cut, least):
    got = query(spark, BIG).collect()
    truth = {r.doc_id: r[name] for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    assert len(got) == 10_000
    assert all(r.held_out == (crc(r.doc_id, folds) == fold) and r.predicted == (r.score >= cut) and 0 <= r.score <= 1 for r in got)
    auc, right = accuracy(got, truth, name)
    assert auc > least and right > least, (auc, right)


@pytest.mark.parametrize("query,name,folds,fold", [(quality.op3_quality, 1, 4, 2), (toxicity.op10_toxicity, 2, 5, 0)])
def test_held_out_labels_change_nothing(spark, tmp_path, query, name, folds, fold):
    rng = random.Random(11)
    rows = [(i, prose(rng, 30) + (" vile words" if i % 3 == 0 else "."), "en", "a", 1) for i in range(120)] + odd_rows()[:-60]
    own = [(i, int(i % 3 == 0), int(i % 3 == 0)) for i in range(120)] + [(None, 1, 1), (3, None, None), (9999, 1, 1), (5, 0, 0)]
    turned = [r if r[0] is None or crc(r[0], folds) != fold else (r[0], *(None if x is None else 1 - x for x in r[1:])) for r in own]
    a = query(spark, folder(tmp_path / "a", rows, extra=True, labels=labels(own))).collect()
    b = query(spark, folder(tmp_path / "b", rows, labels=labels(turned))).collect()
    score = lambda x: sorted((str(r.doc_id), round(r.score, 12), r.predicted) for r in x)
    assert score(a) == score(b) and len(a) == len(rows)


@pytest.mark.parametrize("query", [quality.op3_quality, toxicity.op10_toxicity])
def test_classifiers_without_labels(spark, tmp_path, query):
    rows = odd_rows()
    got = query(spark, folder(tmp_path / "a", rows, labels=labels([]))).collect()
    assert len(got) == len(rows) and len({r.score for r in got}) == 1
    got = query(spark, folder(tmp_path / "b", rows, labels=labels([(4, 1, 1), (5, 1, 1)]))).collect()
    assert all(0 <= r.score <= 1 for r in got)
    assert query(spark, folder(tmp_path / "c", [], labels=labels([(4, 1, 1)]))).collect() == []


def test_trees_walked_in_arrays_score_as_trees_walked_one_by_one():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, len(quality.NAMES)))
    model = quality.Trees(rounds=10).fit(x, (x[:, 0] + x[:, 3] > 0).astype(float))

    def one(row):
        margin = np.log(model.base / (1 - model.base))
        for feature, limit, value in zip(model.feature, model.limit, model.value):
            at = 0
            for _ in range(model.depth):
                at = 2 * at + (2 if row[feature[at]] > limit[at] else 1)
            margin += value[at - len(feature)]
        return 1 / (1 + np.exp(-margin))

    assert np.allclose(model.scores(x), [one(r) for r in x])
    assert ((model.scores(x) > 0.5) == (x[:, 0] + x[:, 3] > 0)).mean() > 0.9


def test_long_texts_score_as_a_whole(monkeypatch):
    rng = random.Random(3)
    texts = [prose(rng, 40) + (" vile" if i % 2 else "") for i in range(400)]
    net = toxicity.Convolution().fit([toxicity.hashes(t) for t in texts], np.array([i % 2 for i in range(400)]), ["en"] * 400)
    long = [(prose(rng, 3000) + end).encode() for end in ("", " vile", "")] + [b"", None, b"vile"]
    whole = net.scores(long)
    monkeypatch.setattr(toxicity, "PIECE", 64)
    assert np.allclose(whole, net.scores(long), atol=1e-5)
    assert whole[1] > 0.5 > whole[0] and whole[5] > 0.5 > whole[3] == whole[4]


# --- op4 ------------------------------------------------------------------------------


def brute_near(rows, top=10):
    usable = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, np.float32))]
    if not usable:
        return {}
    width = Counter(len(v) for _, v in usable).most_common(1)[0][0]
    usable = [(i, v) for i, v in usable if len(v) == width]
    out = {}
    for q, v in usable:
        if q % 100 == 0:
            out[q] = sorted((float(np.sqrt(((x - v) ** 2).sum())), i) for i, x in usable if i != q)[:top]
    return out


def compare(got, want):
    found = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(found[r.query_id]) + 1
        found[r.query_id].append((r.score, r.vec_id))
    assert {q for q, v in want.items() if v} == set(found)
    hit = total = 0
    for q, v in want.items():
        assert found[q] == sorted(found[q])
        hit += len({i for _, i in v} & {i for _, i in found[q]})
        total += len(v)
    return hit / max(1, total)


def test_neighbours_of_odd_vectors(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(0, 300)]
    rows += [(1000, None), (1100, [0.0] * 8), (1200, [1.0, None] * 4), (1300, [float("nan")] * 8), (1400, [float("inf")] * 8), (1500, []), (1600, [1.0] * 3), (None, [1.0] * 8), (1700, [-0.0] * 8)]
    rows += [(2000 + i, rows[100][1]) for i in range(40)] + [(4000, [0.0] * 7 + [1.0]), (4001, [-0.0] * 7 + [1.0])]
    path = folder(tmp_path / "t", [], embeddings=embeddings(rows))
    got = neighbours.op4_neighbours(spark, path).collect()
    want = brute_near(rows)
    assert compare(got, want) >= 0.9
    scores = {(r.query_id, r.vec_id): r.score for r in got}
    for q, v in want.items():
        for s, i in v:
            if (q, i) in scores:
                assert scores[q, i] == s
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 100] == list(range(2000, 2010))


@pytest.mark.parametrize("count", [0, 1, 2, 5])
def test_neighbours_of_few_vectors(spark, tmp_path, count):
    rows = [(100 * i, [1.0 + i, 2.0]) for i in range(count)]
    got = neighbours.op4_neighbours(spark, folder(tmp_path / "t", [], embeddings=embeddings(rows))).collect()
    assert compare(got, brute_near(rows)) == (1 if count > 1 else 0)
    assert len(got) == count * (count - 1)


def test_vectors_apart_have_ten_neighbours(spark, tmp_path):
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    rng = np.random.default_rng(0)
    middles = unit(rng.normal(size=(40, 64)))
    bulk = unit(middles[np.arange(6000) % 40] + 0.05 * rng.normal(size=(6000, 64)))
    rows = [(10_001 + i + i // 99, v.tolist()) for i, v in enumerate(bulk)]  # none is asked for
    for size in range(1, 10):
        group = unit(unit(rng.normal(size=64)) + 0.001 * rng.normal(size=(size, 64)))
        rows += [(100 * size + i, v.tolist()) for i, v in enumerate(group)]
    got = neighbours.op4_neighbours(spark, folder(tmp_path / "t", [], embeddings=embeddings(rows))).collect()
    found = Counter(r.query_id for r in got)
    assert {q: n for q, n in found.items() if q < 1000} == {100 * size: 10 for size in range(1, 10)}
    assert compare(got, brute_near(rows)) >= 0.9


@pytest.mark.parametrize("kind", ["scattered", "clustered", "split"])
def test_recall_and_replicas(spark, tmp_path, kind):
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    rng = np.random.default_rng(8)
    n = 4000 if kind == "scattered" else 6000
    x = unit(rng.normal(size=(n, 64)))
    if kind != "scattered":
        x = unit(unit(rng.normal(size=(60, 64)))[rng.integers(60, size=n)] + rng.normal(size=(n, 64)) / 8)
    rows = list(enumerate(x.tolist()))
    frame = spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<float>")
    more = {"per_list": 8, "sample": 400, "fan": 16} if kind == "split" else {"per_list": 32}  # split: long lists get centroids of their own
    got = neighbours.nearest_neighbours(frame, **more).collect()
    assert len(got) == n // 10 and compare(got, brute_near(rows)) >= 0.9
    graph = neighbours.Centroids(neighbours.split_share(x, n // 32))
    held = np.isfinite(neighbours.listed(graph, x, 4, 1.02)[1]).sum(1)
    assert held.min() == 1 and held.max() > 1 and held.mean() > 1.02  # boundary vectors are in several lists


def test_neighbours_under_one_id(spark):
    """Equal ids of different vectors are rows of their own, and other columns don't matter."""
    rows = [(100, [1.0, 0.0], "x", 1.0), (7, [1.0, 0.1], "y", 2.0), (7, [1.0, 0.2], "z", 3.0), (8, [1.0, 0.3], None, None)]
    got = neighbours.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>, rep string, dist double")).collect()
    assert [(r.rank, r.vec_id) for r in sorted(got, key=lambda r: r.rank)] == [(1, 7), (2, 7), (3, 8)]


def test_recall_on_all_vectors(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{BIG}/embeddings.parquet").collect()]
    assert compare(neighbours.op4_neighbours(spark, BIG).collect(), brute_near(rows)) >= 0.9


# --- pipeline ---------------------------------------------------------------------------


def test_pipeline_stage_by_stage(spark, tmp_path):
    rng = random.Random(12)
    item = prose(rng, 30)
    base = [(i, prose(rng, 80) + (" vile filth" if i % 4 == 0 else ""), "en", rng.choice("ab"), 1) for i in range(600)]
    rows = base + [(1000 + i, base[4 * i + 1][1], "en", "c", 1) for i in range(20)] + [(2000 + i, f"{prose(rng, 20)} {item} {prose(rng, 20)}", "en", "d", 1) for i in range(10)] + [(None, None, None, None, None), (3000, "", "en", "a", 0)]
    path = folder(tmp_path / "t", rows, extra=True, labels=labels([(i, 1, int(i % 4 == 0)) for i in range(500)]), benchmark=benchmark([(1, item)]))
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        kept[name] = Counter(r.doc_id for r in docs.select("doc_id").collect())
    toxic = {r[0] for r in base if r[0] % 4 == 0}
    assert set(kept["toxicity"]) == {r[0] for r in rows} - toxic
    assert set(kept["toxicity"]) - set(kept["simhash"]) >= set(range(1000, 1020))
    assert not set(kept["decontamination"]) & set(range(2000, 2010)) and set(kept["simhash"]) - set(kept["decontamination"]) <= set(range(2000, 2010))
    assert set(kept["mixing"]) <= set(kept["decontamination"]) and max(kept["mixing"].values()) <= 3
    assert kept["sharding"] == kept["mixing"]
    assert [c for c in docs.columns if c not in ("size", "shard", "slot")] == [c for c in columns if c not in ("size", "shard", "slot")]


def test_pipeline_of_no_documents(spark, tmp_path):
    path = folder(tmp_path / "t", [], labels=labels([]), benchmark=benchmark([]))
    assert corpus_pipeline.run(spark, path).collect() == []


def test_pipeline_rows(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    assert got and {r.shard for r in got} <= set(range(24))
