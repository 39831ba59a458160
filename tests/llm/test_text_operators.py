"""op5 to op9 against brute force, and their edge cases."""

from __future__ import annotations

import base64
import bz2
import gzip
import hashlib
import lzma
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations
from urllib.parse import quote

import numpy as np
import pytest
from pyspark.sql import functions as F
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from tomeweave.llm import decontaminate, licenses, secrets, simhash, suffixes
from tomeweave.llm.common import words_of

from .helpers import SF, benchmark, folder, odd_rows, prose

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def words(text):
    return WORD.findall(lower(text))


@given(st.text(alphabet=st.sampled_from("aZ09 _.-\x00\x7f\x80é漢\n 𝄞"), max_size=40))
def test_words_of_bytes_are_the_words_of_the_pattern(text):
    assert [w.decode() for w in words_of(text.encode())] == words(text)


# --- op5 ------------------------------------------------------------------------------


def brute_repeats(rows, least):
    docs = [(d, words(t)) for d, t in dict.fromkeys((r[0], r[1]) for r in rows)]
    where = {}
    for k, (d, w) in enumerate(docs):
        for i in range(len(w) - least + 1):
            where.setdefault(tuple(w[i : i + least]), []).append((d if d is not None else suffixes.LAST, k, i))
    hit = {}
    for places in where.values():
        if len({k for _, k, _ in places}) > 1:
            first = min(d for d, _, _ in places)
            for d, k, i in places:
                for p in range(i, i + least):
                    hit.setdefault(k, {}).setdefault(p, False)
                    hit[k][p] |= d != first

    def spans(at):
        at, out = sorted(at), []
        for p in at:
            if out and out[-1][1] == p:
                out[-1][1] = p + 1
            else:
                out.append([p, p + 1])
        return ",".join(f"{a}:{b}" for a, b in out)

    return sorted((str(docs[k][0]), len(h), sum(h.values()), spans(h), spans([p for p in h if h[p]])) for k, h in hit.items())


def passages(rng):
    shared = [prose(rng, n) for n in (49, 50, 51, 60, 130, 400)]
    rows = [(1000 + i, " ".join([prose(rng, rng.randrange(40)), rng.choice(shared), prose(rng, rng.randrange(60)), rng.choice(shared) if rng.random() < 0.5 else ""]), "en", "a", 1) for i in range(80)]
    parts = shared[5].split()
    # edits, crossings and runs of one word
    rows += [(2000 + i, " ".join(parts[: 40 + i] + ["odd"] + parts[60 - i :]), "en", "a", 1) for i in range(20)]
    rows += [(3000 + i, " ".join(parts[i * 7 : i * 7 + 55]), "en", "a", 1) for i in range(20)] + [(3100 + i, "a " * (30 + 10 * i), "en", "a", 1) for i in range(6)]
    return rows + [(1, shared[4], "en", "a", 1), (1, shared[4] + " more", "en", "a", 1)] + odd_rows()


def test_suffixes_match_brute_force(spark, tmp_path):
    rows = passages(random.Random(5))
    got = suffixes.op5_suffixes(spark, folder(tmp_path / "t", rows, extra=True)).collect()
    assert sorted((str(r.doc_id), r.n_repeated, r.n_removed, r.spans, r.removed) for r in got) == brute_repeats(rows, 50)


@pytest.mark.parametrize("least,seed", [(8, 3), (5, 5)])
def test_suffixes_of_other_lengths(spark, tmp_path, least, seed):
    rng = random.Random(least)
    rows = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randrange(40))), "en", "a", 1) for i in range(60)]
    docs = spark.read.parquet(folder(tmp_path / "t", rows) + "/documents.parquet")
    got = suffixes.repeats(docs, least, seed).collect()
    assert sorted((str(r.doc_id), r.n_repeated, r.n_removed, r.spans, r.removed) for r in got) == brute_repeats(rows, least)


def test_deduplicated_leaves_each_passage_once(spark, tmp_path):
    rng = random.Random(8)
    shared, own = prose(rng, 70), [prose(rng, 30) for _ in range(4)]
    rows = [(i, f"{own[i]}. {shared}! {own[i]}", "en", "a", 1) for i in range(3)] + [(3, own[3], "en", "a", 1), (4, None, None, None, None)]
    docs = spark.read.parquet(folder(tmp_path / "t", rows, extra=True) + "/documents.parquet")
    out = suffixes.deduplicated(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {0: rows[0][1], 1: f"{own[1]}. ! {own[1]}", 2: f"{own[2]}. ! {own[2]}", 3: own[3], 4: None}


# --- op6 ------------------------------------------------------------------------------


def brute_hits(rows, items, window):
    windows = {}
    for item, text in items:
        w = words(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(item)
    out = []
    for d, text, *_ in rows:
        w, hit, own = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if (x := tuple(w[i : i + size])) in windows:
                    hit |= set(range(i, i + size))
                    own |= windows[x]
        listed = ",".join(sorted(str(x) for x in own if x is not None))
        out.append((str(d), len(w), len(hit), len([x for x in own if x is not None]), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)))
    return sorted(out)


def leaks():
    rng = random.Random(6)
    items = [(i, prose(rng, n)) for i, n in enumerate((3, 9, 10, 11, 40, 200))] + [(50, None), (51, ""), (None, "lonely words of no item"), (7, "a a a a"), (8, prose(rng, 12)), (9, "...")]
    items.append((10, items[4][1]))
    text = lambda i: items[i][1]
    rows = [(i, " ".join([prose(rng, 20), text(i % 6).upper() if i % 2 else text(i % 6), prose(rng, 5)]), "en", "a", 1) for i in range(24)]
    cut = text(4).split()
    rows += [(500 + i, " ".join(cut[i : i + 9 + i % 3]), "en", "a", 1) for i in range(12)] + [(600, "x a-a,a;a a b lonely words of no item", "en", "a", 1)]
    return rows + odd_rows(), items


@pytest.mark.parametrize("most_windows", [300_000, 0])
def test_decontamination_matches_brute_force(spark, tmp_path, most_windows):
    rows, items = leaks()
    path = folder(tmp_path / "t", rows, extra=True, benchmark=benchmark(items))
    docs, bench = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/benchmark.parquet")
    got = decontaminate.scan(docs, bench, most_windows=most_windows).select("_row.doc_id", "_found.*").collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == brute_hits(rows, items, 10)
    spans = {r.spans for r in got if r.doc_id == 600}
    assert spans == {"1:6,7:12"}


def test_clean_keeps_columns_and_clean_documents(spark, tmp_path):
    rows, items = leaks()
    path = folder(tmp_path / "t", rows, extra=True, benchmark=benchmark(items))
    docs = spark.read.parquet(f"{path}/documents.parquet")
    out = decontaminate.clean(docs, spark.read.parquet(f"{path}/benchmark.parquet"))
    assert out.columns == docs.columns
    assert out.count() == sum(not x[5] for x in brute_hits(rows, items, 10))


# --- op7 ------------------------------------------------------------------------------

SECRET = "token=abcdef123456"


def test_secret_base_findings():
    text = 'x password: "abc" PassWord = hunter22! api-key:1 apikey=AKIA' + "B" * 16 + " AKIA123 " + "0f" * 12 + " deadbeef"
    base, every = secrets.scan(text.encode())
    found = [(secrets.KINDS[k], text[a:b]) for a, k, b in base]
    assert found == [("assign", "PassWord = hunter22"), ("assign", "apikey=AKIA" + "B" * 16), ("access", "AKIA" + "B" * 16), ("hex", "0f" * 12)]
    assert set(base) <= set(every)


def test_failing_match_still_takes_its_place():
    base, _ = secrets.scan(b"password:secret token:abc secret=token=abcdefgh")
    assert [(k, a, b) for a, k, b in base] == [(0, 0, 15), (0, 26, 47)]


@pytest.mark.parametrize(
    "wrapped",
    [
        quote(SECRET, safe=""), "".join(f"%{b:02x}" for b in SECRET.encode()), "".join(f"\\u{ord(c):04x}" for c in SECRET), "".join(f"\\x{ord(c):02X}" for c in SECRET), "".join(f"\\u{{{ord(c):x}}}" for c in SECRET),
        base64.b64encode(SECRET.encode()).decode(), base64.urlsafe_b64encode(SECRET.encode()).decode(), base64.b64encode(gzip.compress(SECRET.encode() * 3)).decode(), base64.b64encode(zlib.compress(SECRET.encode())).decode(), base64.b64encode(bz2.compress(SECRET.encode())).decode(),
        quote(base64.b64encode(quote(SECRET, safe="").replace("t", "%74").encode()).decode(), safe=""), base64.b64encode(base64.b64encode(base64.b64encode(SECRET.encode()))).decode(),
    ],
)
def test_wrapped_secrets_are_mapped_to_where_they_stand(wrapped):
    text = f"vor é 漢 <{wrapped}> nach"
    _, every = secrets.scan(text.encode())
    a, b = text.index("<") + 1, text.index(">")
    assert any(a <= x and y <= b for x, k, y in every if k == 0), every
    assert all(0 <= x < y <= len(text) for x, _, y in every)


b64 = lambda b: base64.b64encode(b).decode()
WRAPPERS = {
    "percent": lambda s: quote(s, safe=""), "every percent": lambda s: "".join(f"%{b:02X}" for b in s.encode()), "escape": lambda s: "".join(f"\\u{ord(c):04x}" for c in s), "hex escape": lambda s: "".join(f"\\x{ord(c):02x}" for c in s),
    "base64": lambda s: b64(s.encode()), "unpadded": lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("="), "gzip": lambda s: b64(gzip.compress(s.encode())), "zlib": lambda s: b64(zlib.compress(s.encode())), "bzip2": lambda s: b64(bz2.compress(s.encode())), "xz": lambda s: b64(lzma.compress(s.encode())),
    "lines": lambda s: base64.encodebytes(s.encode()).decode(), "gzip in lines": lambda s: base64.encodebytes(gzip.compress(s.encode())).decode(), "utf-16": lambda s: b64(s.encode("utf-16-le")), "glued": lambda s: "io/v1/" + b64(s.encode()), "newline sign": lambda s: "\\n" + b64(s.encode()),
    "odd bytes": lambda s: "%ff%FE" + quote(s, safe=""), "odd text": lambda s: b64(("\u00a0\u3000\ufeff" + s).encode()), "members": lambda s: b64(gzip.compress(b"first ") + gzip.compress(s.encode())), "percent gzip": lambda s: "".join(f"%{b:02x}" for b in gzip.compress(s.encode())),
}


@pytest.mark.parametrize("name", WRAPPERS)
def test_each_wrapper_is_undone(name):
    for before in ("", "x", "longer words before it "):
        text = f"é {before}<{WRAPPERS[name](before + SECRET + ' ' + before * 3)}> nach"
        _, every = secrets.scan(text.encode())
        a, b = text.index("<") + 1, text.index(">")
        assert any(a <= x and y <= b for x, k, y in every if k == 0), (name, every)


def test_random_nestings():
    rng = random.Random(21)
    for _ in range(150):
        names = [rng.choice(list(WRAPPERS)) for _ in range(rng.randrange(1, 5))]
        inner = f"{SECRET} AKIA{'B2' * 9} {'0a' * 14} "
        for n in names:
            inner = WRAPPERS[n](inner)
        text = f"vor 漢 <{inner}> nach"
        _, every = secrets.scan(text.encode())
        a, b = text.index("<") + 1, len(text) - 6
        assert {k for x, k, y in every if a <= x and y <= b} >= {0, 1, 2}, names


def test_runs_across_pieces_are_whole():
    inner = b64((f"{'word ' * 60_000}{SECRET} " + "tail " * 60_000).encode())
    text = b64(gzip.compress(b". " * (secrets.PIECE // 2 - 100_000) + inner.encode()))
    _, every = secrets.scan(text.encode())
    assert any(k == 0 for _, k, _ in every)


def brute_base(text):
    """Leftmost matches that don't overlap, place by place."""
    out = []
    for kind, pattern, least in ((0, "(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6), (1, "(AKIA[A-Z0-9]+)", 20), (2, "([0-9a-f]+)", 24)):
        at = 0
        while at < len(text):
            m = re.compile(pattern, re.ASCII).match(text, at)
            if m and len(m[1]) >= least:
                out.append((at, kind, m.end()))
            at = m.end() if m else at + 1
    return sorted(out)


def test_base_findings_match_brute_force():
    rng = random.Random(22)
    bits = ["password", "SECRET", "token", "apikey", "api_key", "Api_KEY", ":", "=", " ", '"', "'", "abc", "abcdef", "AKIA", "B" * 16, "0f" * 5, "0f" * 12, "g", "é", "_", "-", "\n"]
    for _ in range(1500):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 25)))
        assert secrets.scan(text.encode())[0] == brute_base(text), text


def test_decoding_stops_on_cycles_and_bombs():
    bomb = base64.b64encode(gzip.compress(b"0" * 50_000_000 + b" " + SECRET.encode())).decode()
    _, every = secrets.scan(f"{bomb} %25%32%35%25%32%35 \\u005cu005c".encode())
    assert any(k == 0 for _, k, _ in every)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60), st.integers(0, 3))
def test_any_text_is_scanned(text, depth):
    for _ in range(depth):
        text = quote(base64.b64encode(text.encode("utf-8", "replace")).decode())
    base, every = secrets.scan(text.encode("utf-8", "replace"))
    assert set(base) <= set(every)


def test_secrets_query(spark, tmp_path):
    rows = odd_rows() + [(900, "é " + SECRET, "en", "a", 1)]
    got = {r.doc_id: r for r in secrets.op7_secrets(spark, folder(tmp_path / "t", rows, extra=True)).collect()}
    assert len(secrets.op7_secrets(spark, folder(tmp_path / "t", rows)).collect()) == len(rows)
    r = got[900]
    assert (r.n_assign, r.n_access, r.n_hex, r.spans, r.base_sha256) == (1, 0, 0, "assign:2:20", hashlib.sha256(b"assign:2:20").hexdigest())
    assert got[1].base_sha256 == hashlib.sha256(b"").hexdigest() and got[1].spans == ""


# --- op8 ------------------------------------------------------------------------------


def brute_licenses(text):
    w, places, own = words(text), [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        at = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        places += at
        own |= {label} if at else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(own))


def brute_labels(texts, rarest=3, share=0.6):
    """Every notice at every place of every text, with anchors by document frequencies counted anew."""
    sets = [set(words(t)) for t in texts]
    known = {w for _, text, _ in licenses.TEMPLATES for w in text.split()} - licenses.GENERAL
    idf = {w: math.log((len(texts) + 1) / (sum(w in s for s in sets) + 1)) for w in known}
    out = []
    for text in texts:
        w, found = words(text), []
        for label, notice, keys in licenses.TEMPLATES:
            n = notice.split()
            own = sorted(set(n) & known, key=lambda x: (-idf[x], x))[:rarest]
            for start in range(len(w)):
                part = w[start : start + len(n)]
                same = [a for a, b in zip(part, n) if a == b]
                if len(set(same) & set(own)) < 2 or len(same) < share * len(n):
                    continue
                places = [next(i for i in range(len(n)) if n[i : i + len(k.split())] == k.split()) for k in keys]
                if all(part[i : i + len(k.split())] == k.split() for i, k in zip(places, keys)):
                    found.append((len(same) / len(n), label))
        base = brute_licenses(text)
        out.append((",".join(sorted({x for _, x in found} | set(base[4].split(",")) - {""})), round(1.0 if base[1] else max((x for x, _ in found), default=0.0), 9)))
    return out


def test_license_labels_match_brute_force(spark, tmp_path):
    rng = random.Random(31)
    notices = [text for _, text, _ in licenses.TEMPLATES]
    texts = [r[1] for r in odd_rows()[:20]] + [". ".join(notices), "\n".join(reversed(notices)) + " endorse neither obtaining holder products promote"]
    for _ in range(150):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            n = rng.choice(notices).split()
            for _ in range(rng.randrange(4)):
                n[rng.randrange(len(n))] = rng.choice(["word", "license", "the", "public"])
            parts += [prose(rng, rng.randrange(6)), " ".join(n[: rng.randrange(len(n) // 2, len(n) + 1)])]
        texts.append(" ".join(parts))
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(texts)]
    got = {r.doc_id: (r.labels, round(r.score, 9)) for r in licenses.op8_licenses(spark, folder(tmp_path / "t", rows)).collect()}
    want = brute_labels(texts)
    assert [got[i] for i in range(len(rows))] == want
    assert set(got[20][0].split(",")) == {label for label, _, _ in licenses.TEMPLATES}


def test_license_scan(spark, tmp_path):
    rows = odd_rows() + [
        (800, "Under the MIT license. under the mit-license", "en", "a", 1), (801, "Apache License, Version 2.0 and CC BY-NC", "en", "a", 1), (802, "Licensed under the BSD 3-Clause License", "en", "a", 1), (803, "under the mit licenses; cc by", "en", "a", 1),
        (804, "this work is licensed under the GNU General Public License version 3", "en", "a", 1), (805, "GNU general license public words under the mit", "en", "a", 1), (806, "cc by nc " * 3000, "en", "a", 1), (807, "words " * 500 + "permission is hereby granted, free of charge, to any person obtaining a copy of this software", "en", "a", 1),
    ]
    got = licenses.op8_licenses(spark, folder(tmp_path / "t", rows, extra=True)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == Counter((r[0], *brute_licenses(r[1])) for r in rows)
    assert all(set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    found = {r.doc_id: r.labels for r in got}
    assert (found[802], found[804], found[805], found[807]) == ("bsd-3", "gpl-3", "", "mit")


# --- op9 ------------------------------------------------------------------------------


def brute_fingerprint(text):
    w = re.findall("[^\x20\x09-\x0d]+", lower(text))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(ids, fps, radius=3):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(ids)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= radius:
            root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]


def test_simhash_matches_brute_force(spark, tmp_path):
    rng = random.Random(9)
    rows = odd_rows()
    for i in range(12):
        w = prose(rng, 300).split()
        for j in range(8):
            w[rng.randrange(300)] = "edit"
            rows.append((5000 - 10 * i - j, " ".join(w), "en", "a", 1))
    fps = [brute_fingerprint(r[1]) for r in rows]
    want = sorted((str(r[0]), f"{f:016x}", str(c)) for r, f, c in zip(rows, fps, brute_components([r[0] for r in rows], fps)))
    got = simhash.op9_simhash(spark, folder(tmp_path / "t", rows, extra=True)).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want


def test_links_and_components_of_any_fingerprints(spark):
    """Chains, crowds and far pairs: the same components as by comparing all pairs."""
    rng = random.Random(10)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for f in list(fps)[:60]:
        for _ in range(rng.randrange(12)):
            f ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6)))
            fps.add(f)
    fps |= {(1 << 63) | i for i in range(400)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    classes = spark.createDataFrame([(f,) for f in signed], "fp long").repartition(5).withColumn("table", simhash.pivot_table(F.col("fp")))
    want = brute_components(signed, [f & ((1 << 64) - 1) for f in signed])
    for crowd in (simhash.CROWD, 16):  # few rows to a block: crowds are dealt by further blocks
        got = {r.node: r.root for r in simhash.components(simhash.links(classes, 3, crowd)).collect()}
        assert {f: got.get(f, f) for f in signed} == dict(zip(signed, want))


def test_finer_blocks_keep_every_near_pair():
    rng = random.Random(3)
    for mask in (0, 0xFFFF, 0xFF00FF00FF00FF00):
        for _ in range(200):
            a = rng.getrandbits(64)
            free = [i for i in range(64) if not mask >> i & 1]
            b = a ^ sum(1 << i for i in rng.sample(free, rng.randrange(4)))
            assert any(a & m == b & m for m in simhash.finer(mask, 3)) and all(m & mask == mask and m != mask for m in simhash.finer(mask, 3))


def shingle_set(text, size=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) > size else {b" ".join(w)} - {b""}


def test_similar_texts_are_linked_as_by_brute_force(spark, tmp_path):
    """Near copies of one text in many versions, chains of versions, and pairs on both sides of the limit."""
    rng = random.Random(12)
    rows = odd_rows()
    for i in range(6):
        w = prose(rng, 200).split()
        for j in range(20):
            own = list(w) if i % 2 else w  # versions of one text, or a chain of versions
            for _ in range(rng.randrange(1, 9)):
                own[rng.randrange(200)] = f"edit{rng.randrange(1000)}"
            rows.append((7000 + 20 * i + j, " ".join(own), "en", "a", 1))
    docs = spark.read.parquet(folder(tmp_path / "t", rows, extra=True) + "/documents.parquet")
    got = simhash.near_duplicates(docs, similarity=0.8).collect()
    texts = [r[1] for r in rows]
    sets, fps = [shingle_set(t) for t in texts], [brute_fingerprint(t) for t in texts]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (fps[i] ^ fps[j]).bit_count() <= 3 or both and both >= 0.8 * len(sets[i] | sets[j]):
                up[max(find(i), find(j))] = min(find(i), find(j))
    want = Counter(Counter(find(i) for i in range(len(rows))).values())
    assert Counter(Counter(r.root for r in got).values()) == want and max(want) >= 10


def test_keep_one_document_of_each_component(spark, tmp_path):
    rng = random.Random(4)
    text = prose(rng, 200)
    rows = [(9, text, "en", "a", 1), (4, text, "de", "b", 2), (6, text, None, "c", 3), (4, text, "de", "b", 2), (5, "other words entirely here", "en", "a", 1), (7, prose(rng, 90), "en", "a", 1), (None, text, "en", "a", 1)]
    docs = spark.read.parquet(folder(tmp_path / "t", rows, extra=True) + "/documents.parquet")
    out = simhash.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [4, 5, 7]


def test_keep_one_tells_components_apart_without_ids(spark, tmp_path):
    rng = random.Random(5)
    a, b, c, d = (prose(rng, 100) for _ in range(4))
    rows = [(None, a, "en", "a", 1), (None, b, "en", "a", 1), (None, a, "en", "b", 1), (7, c, "en", "a", 1), (7, d, "en", "a", 1), (8, d, "en", "a", 1)]
    docs = spark.read.parquet(folder(tmp_path / "t", rows) + "/documents.parquet")
    kept = [(r.doc_id, r.text) for r in simhash.keep_one(docs).collect()]
    assert Counter(kept) == Counter([(None, a), (None, b), (7, c), (7, d)])


def test_only_texts_to_compare_are_shuffled(spark, tmp_path, monkeypatch):
    """Beyond Spark's own limit for broadcasts too; with more hashes than are broadcast, the links are the same."""
    rng = random.Random(7)
    texts = [" ".join(f"{rng.getrandbits(64):x}" for _ in range(600)) for _ in range(200)]
    texts += [t + " tail" for t in texts[:3]] + [texts[0]]
    docs = spark.read.parquet(folder(tmp_path / "t", [(i, t, "en", "a", 1) for i, t in enumerate(texts)]) + "/documents.parquet")
    rows = docs.select(F.xxhash64("text").alias("text_hash"), "text")
    keys = dict(docs.select("doc_id", F.xxhash64("text")).collect())
    pairs = [(keys[i], i, keys[200 + i], 200 + i) for i in range(3)] + [(keys[0], 0, keys[1], 1)]
    pairs = spark.createDataFrame(pairs, "h long, hfp long, t long, tfp long")

    def shuffled():
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorSummary("driver").totalShuffleWrite()

    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled()
        got = {(r.a, r.b) for r in simhash.verified(pairs, rows, 0.8).collect()}
        assert shuffled() - before < sum(map(len, texts)) / 4
        monkeypatch.setattr(simhash, "FEW", 0)
        assert {(r.a, r.b) for r in simhash.verified(pairs, rows, 0.8).collect()} == got == {(200 + i, i) for i in range(3)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_pipeline_drops_copies_of_five_word_similarity(spark, tmp_path):
    rng = random.Random(6)
    rows = []
    for i in range(40):
        w = prose(rng, 300).split()
        rows.append((i, " ".join(w), "en", "a", 1))
        for j in range(2 + i % 8):
            w[10 + j * 28] = f"edit{i}"
        rows.append((100 + i, " ".join(w), "en", "a", 1))
    rows += [(200 + i, f"short text {i}", "en", "a", 1) for i in range(5)] + [(300, None, "en", "a", 1)]
    grams = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in ((r[1] or "").split() for r in rows)]
    root = list(range(len(rows)))
    fps = [brute_fingerprint(r[1]) for r in rows]
    for i, j in combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 3 or len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]):
            root = [root[i] if r == root[j] else r for r in root]
    want = {min(rows[i][0] for i in range(len(rows)) if root[i] == r) for r in root}
    docs = spark.read.parquet(folder(tmp_path / "t", rows, extra=True) + "/documents.parquet")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert {r.doc_id for r in out.collect()} == want and out.columns == docs.columns


# --- empty tables -----------------------------------------------------------------------


def test_empty_tables(spark, tmp_path):
    path = folder(tmp_path / "t", [], benchmark=benchmark([]))
    for query in (suffixes.op5_suffixes, decontaminate.op6_decontamination, secrets.op7_secrets, licenses.op8_licenses, simhash.op9_simhash):
        assert query(spark, path).collect() == []
    rows = odd_rows()
    path = folder(tmp_path / "u", rows, benchmark=benchmark([]))
    assert {r.n_hit for r in decontaminate.op6_decontamination(spark, path).collect()} == {0}


@pytest.mark.parametrize("name", ["op5_suffixes", "op6_decontamination"])
def test_sql_says_the_same(spark, name):
    import duckdb

    from tomeweave.llm.queries import QUERIES, SQL

    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = db.execute(SQL[name]).to_arrow_table().to_pylist()
    got = [r.asDict() for r in QUERIES[name](spark, SF).collect()]
    key = lambda r: sorted((k, str(v)) for k, v in r.items())
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_numbers_have_the_types_asked_for(spark):
    kinds = dict(suffixes.op5_suffixes(spark, SF).dtypes)
    assert kinds == {"doc_id": "bigint", "n_repeated": "bigint", "n_removed": "bigint", "spans": "string", "removed": "string"}


def test_a_sketch_never_bounds_a_similarity_too_low():
    rng = np.random.default_rng(5)
    for size in (1, 3, 40, 400, 20_000):
        base = rng.integers(0, 1 << 64, size, dtype=np.uint64)
        for kept in (0.0, 0.5, 0.85, 0.95, 1.0):
            sets = [np.unique(base), np.unique(np.concatenate([base[rng.random(size) < kept], rng.integers(0, 1 << 64, 1 + size // 20, dtype=np.uint64)]))]
            sketches = np.stack([np.frombuffer(simhash.band_keys(x)[1], np.uint8) for x in sets])
            many, maps = simhash.sizes_and_maps(sketches)
            assert many.tolist() == [len(x) for x in sets]
            for a, b in ((0, 1), (1, 0), (0, 0)):
                assert simhash.at_most(many[[b]], maps[[b]], many[a], maps[a])[0] >= simhash.jaccard(sets[a], sets[b])
