"""Every registered query of this package against its SQL."""

from __future__ import annotations

import os

import duckdb
import pytest

from tomeweave.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{SF}/{name}')")
    return con


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    if name not in SQL:
        assert name == "keyword_snippet"
        return
    rows = db.execute(SQL[name])
    names = [x[0] for x in rows.description]
    assert sorted(names) == columns
    assert got == sorted(str([plain(r[names.index(c)]) for c in columns]) for r in rows.fetchall())


def test_entry_without_the_corpus_operators(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/tomeweave", tmp_path / "tomeweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.stdout.split() == [str(len(QUERIES)), str(len(SQL))], done.stderr


def test_sections_of_odd_texts(spark, tmp_path):
    """Empty and missing texts, blank lines, blanks and marks that end a line."""
    texts = ["", None, "one\ntwo\nthree\n", "one\n\ntwo\nthree", "one\ntwo\n\nfour\nfive\n", "one \ntwo\nthree ", "one ##\ntwo #\nthree", "\none", " \n \n ", "a\r\nb\r\nc\r\nd", "a\nb\n***\nc", "a\nb\n<b>\nc", "\n" * 24]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name in ("sections", "chunk_type_hint"):
        df = QUERIES[name](spark, str(tmp_path))
        assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, con.execute(f"select {', '.join(df.columns)} from ({SQL[name]})").fetchall()))
