"""Small document tables for the operators' tests."""

from __future__ import annotations

import random
import zlib

import pyarrow as pa
import pyarrow.parquet as pq

SF = "/root/testdata/sf0.001"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ru", "te") for b in ("nor", "sel", "vid") for c in ("a", "en", "ist", "ou")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls in any column, empty and long texts, ties and repeated rows."""
    rng = random.Random(3)
    long = prose(rng, 30_000)
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "   \n\t ", None, None, None), (None, "no id here but words enough", "en", "b", 27), (None, None, None, None, None),
        (4, long, "en", "a", len(long)), (5, long + " tail", "de", "b", len(long)), (6, "one", "fr", "c", 3), (6, "one", "fr", "c", 3), (6, "two", "fr", "c", 3), (7, "é ü ß ſ K 漢字   \x00 \x0b x", "fr", "c", 9),
        (-8, "negative id", "es", "", 11), (9, "same text", "es", "d", 9), (10, "same text", "es", "d", 9),
    ]
    return rows + [(100 + i, prose(rng, rng.randrange(1, 120)), rng.choice(["en", "de", None]), rng.choice(["a", "b", "hot", "hot", "hot"]), 1) for i in range(60)]


def folder(path, documents: list[tuple], extra: bool = False, **others: pa.Table) -> str:
    """A folder of Parquet tables; extra adds columns whose names clash with those of operators."""
    path.mkdir(parents=True, exist_ok=True)
    table = pa.table([pa.array([r[i] for r in documents], f.type) for i, f in enumerate(SCHEMA)], schema=SCHEMA)
    if extra:
        for name in ("size", "shard", "slot", "label", "score", "_score", "_found", "_row", "uid", "_id", "_d", "component_id", "fp", "mix_shard", "repeats", "rank", "d", "_size", "_slot", "a.b"):
            table = table.append_column(name, pa.array([f"extra {name}"] * len(documents), pa.string()))
    pq.write_table(table, path / "documents.parquet")
    for name, t in others.items():
        pq.write_table(t, path / f"{name}.parquet")
    return str(path)


def labels(rows: list[tuple]) -> pa.Table:
    return pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "quality": pa.array([r[1] for r in rows], pa.int32()), "toxic": pa.array([r[2] for r in rows], pa.int32())})


def benchmark(rows: list[tuple]) -> pa.Table:
    return pa.table({"item_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())})


def embeddings(rows: list[tuple]) -> pa.Table:
    return pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32())), "label": pa.array([0] * len(rows), pa.int32())})


def crc(doc_id: int, folds: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % folds
