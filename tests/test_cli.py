"""The command line."""

from __future__ import annotations

import json

from tomeweave.plans import cli


def call(capsys, home, *args):
    code = cli.main(["--home", str(home), *args])
    got = capsys.readouterr()
    return code, json.loads(got.out or got.err)


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "w").mkdir()
    (tmp_path / "w/a.md").write_text("# A\nfirst word\n## B\nmore")
    home = tmp_path / "home"
    code, source = call(capsys, home, "add", str(tmp_path / "w"))
    assert code == 0 and call(capsys, home, "load")[1] == {source: {"new": 1}}
    assert call(capsys, home, "create", source, "b", "# New\nsecond word")[1] == "b.md"
    assert [h["rel_path"] for h in call(capsys, home, "search", "second")[1]] == ["b.md"]
    assert [h["rel_path"] for h in call(capsys, home, "list", "--filter", "NEW")[1]] == ["b.md"]
    assert [c["heading"] for c in call(capsys, home, "chunks", "a.md", source)[1]] == ["A", "# A", "## B"]
    assert call(capsys, home, "search", "first second", "--top", "1", "--page", "2")[1][0]["rank"] == 2
    assert call(capsys, home, "search", "word", "--source", "none")[0] == 2
    assert call(capsys, home, "delete", "none")[0] == 1
    assert len(call(capsys, home, "uncompiled")[1]) == 2 and call(capsys, home, "status")[1]["files"] == 2
