"""Lines around what a keyword search found."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def around(content: str, words: list[str], most: int = 100, enough: int = 5) -> str:
    """Each line with one of the words between its neighbours, until there are `enough`; the line after a find isn't looked at."""
    lines = content.split("\n")
    low = [x.lower() for x in lines]
    out: dict[str, None] = {}  # each once, in order
    at = 0
    while at < len(lines) and len(out) < enough:
        if any(w in low[at] for w in words):
            for i in range(max(0, at - 1), min(len(lines), at + 2)):
                out[f"L{i + 1}: {lines[i].strip()[:most]}"] = None
            at += 1
        at += 1
    return "\n".join(out)


def snippet(content: Column, words: list[str]) -> Column:
    @F.pandas_udf("string")
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: around(t, words) if t else "")

    return find(content)


def first_context(content: Column, needle: str, most: int = 100) -> Column:
    """The line of the first occurrence between its neighbours, as far as these aren't empty; null without one."""
    low = F.lower(content)
    at = F.instr(low, needle.lower())
    number = F.size(F.split(F.substring(low, F.lit(1), at - 1), "\n"))
    line = lambda i: F.trim(F.coalesce(F.get(F.split(content, "\n"), i), F.lit("")))
    shown = lambda i: F.concat(F.lit("L"), (i + 1).cast("string"), F.lit(": "), F.substring(line(i), 1, most))
    side = lambda i: F.when((i >= 0) & (line(i) != ""), shown(i))
    return F.when(at > 0, F.concat_ws("\n", side(number - 2), shown(number - 1), side(number)))
