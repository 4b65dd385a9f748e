"""Words of unspaced text by a dictionary."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


def full(text: str, known: dict[str, int], longest: int) -> list[str]:
    """All words of the dictionary that stand in the text, from left to right and the shorter first; characters that are in none stand alone."""
    out, covered = [], 0
    for k in range(len(text)):
        found = [text[k:e] for e in range(k + 2, min(len(text), k + longest) + 1) if text[k:e] in known]
        out += found
        if not found and k >= covered:
            out.append(text[k])
        covered = max(covered, *(k + len(w) for w in found), 0) if found else covered
    return out


def precise(text: str, known: dict[str, int], longest: int) -> list[str]:
    """The likeliest parting into words, each as likely as its share of all counts; unknown characters count once."""
    total = math.log(sum(known.values()) or 1)
    best: list[tuple[float, int]] = [(0.0, 0)] * (len(text) + 1)
    for k in range(len(text) - 1, -1, -1):
        ways = [(math.log(known[text[k:e]]) - total + best[e][0], e) for e in range(k + 1, min(len(text), k + longest) + 1) if text[k:e] in known]
        best[k] = max(ways) if ways else (best[k + 1][0] - total, k + 1)
    out, k = [], 0
    while k < len(text):
        out.append(text[k : best[k][1]])
        k = best[k][1]
    return out


def segmenter(known: dict[str, int], mode: str = "precise"):
    """A column function: text -> array of words, by a dictionary of words and their counts (of a size that workers can hold).
    Runs of white space part words in any case; null gives null."""
    longest, way = max(map(len, known), default=1), {"precise": precise, "full": full}[mode]

    @F.pandas_udf(ArrayType(StringType()))
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [w for part in t.split() for w in way(part, known, longest)] for t in texts], dtype=object)

    def column(text: Column) -> Column:
        return cut(text)

    return column
