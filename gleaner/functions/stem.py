"""The English (Porter2) stemmer, from its published definition."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Fixed values of the published definition: vowels, double letters, whole words, words that step 1a ends, endings by step, longest first.
_V = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = [("ational", "ate"), ("fulness", "ful"), ("iveness", "ive"), ("ization", "ize"), ("ousness", "ous"), ("biliti", "ble"), ("lessli", "less"), ("tional", "tion"), ("alism", "al"), ("aliti", "al"), ("ation", "ate"), ("entli", "ent"), ("fulli", "ful"), ("iviti", "ive"), ("ousli", "ous"), ("abli", "able"), ("alli", "al"), ("anci", "ance"), ("ator", "ate"), ("enci", "ence"), ("izer", "ize"), ("bli", "ble"), ("ogi", "og"), ("li", "")]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("ative", ""), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP4 = ["ement", "able", "ance", "ence", "ible", "ment", "ant", "ate", "ent", "ion", "ism", "iti", "ive", "ize", "ous", "al", "er", "ic"]


#: Letters that a stem loses at most: the longest endings of all steps together.
_LOST = 30


def _after(w: str, start: int) -> int:
    m = re.search(f"[{_V}][^{_V}]", w[start:])
    return start + m.end() if m else len(w)


def _short_end(w: str) -> bool:
    return bool(re.search(f"(?:^[{_V}][^{_V}]|[^{_V}][{_V}][^{_V}wxY])$", w))


def stem(word: str) -> str:
    """Of a lower-case word."""
    w = word.replace("’", "'")
    if len(w) <= 2:
        return w
    if w in _WHOLE:
        return _WHOLE[w]
    w = w.removeprefix("'")
    w = re.sub(f"^y|(?<=[{_V}])y", "Y", w)
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None) or _after(w, 0)
    r2 = _after(w, r1)
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith(("us", "ss")):
        pass
    elif w.endswith("s") and re.search(f"[{_V}].+s$", w):
        w = w[:-1]
    if w in _AFTER_1A:
        return w
    for s in ("eedly", "eed"):
        if w.endswith(s):
            if len(w) - len(s) >= r1:
                w = w[: len(w) - len(s)] + "ee"
            break
    else:
        for s in ("ingly", "edly", "ing", "ed"):
            if w.endswith(s):
                if re.search(f"[{_V}]", w[: -len(s)]):
                    w = w[: -len(s)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif w.endswith(_DOUBLES):
                        w = w[:-1]
                    elif r1 >= len(w) and _short_end(w):
                        w += "e"
                break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    for s, to in _STEP2:
        if w.endswith(s):
            at = len(w) - len(s)
            if at >= r1 and (s != "ogi" or w[at - 1 : at] == "l") and (s != "li" or w[at - 1 : at] in tuple("cdeghkmnrt")):
                w = w[:at] + to
            break
    for s, to in _STEP3:
        if w.endswith(s):
            at = len(w) - len(s)
            if at >= r1 and (s != "ative" or at >= r2):
                w = w[:at] + to
            break
    for s in _STEP4:
        if w.endswith(s):
            at = len(w) - len(s)
            if at >= r2 and (s != "ion" or w[at - 1 : at] in ("s", "t")):
                w = w[:at]
            break
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1])) or w.endswith("l") and len(w) - 1 >= r2 and w[-2:-1] == "l":
        w = w[:-1]
    return w.lower()


@F.pandas_udf(ArrayType(StringType()))
def stems(tokens: pd.Series) -> pd.Series:
    """Stems of arrays of words; each distinct word of a batch is stemmed once."""
    known: dict[str, str] = {}

    def one(t: str) -> str:
        if t not in known:
            known[t] = stem(t.lower())
        return known[t]

    return tokens.map(lambda ts: None if ts is None else [one(t) for t in ts])


def word_break(word: str, known: frozenset[str], longest: int | None = None) -> list[str] | None:
    """Words of the dictionary (or words whose stem it holds) that make up the word, a longer one first at each place; null
    if none do. Without recursion, and with pieces no longer than the dictionary's longest word and what a stem can lose."""
    n = len(word)
    most = (max(map(len, known), default=0) if longest is None else longest) + _LOST
    ends: list[int | None] = [None] * n + [n]
    for i in range(n - 1, -1, -1):
        ends[i] = next((j for j in range(min(n, i + most), i, -1) if ends[j] is not None and (word[i:j] in known or stem(word[i:j]) in known)), None)
    if not n or ends[0] is None:
        return None
    out, i = [], 0
    while i < n:
        out.append(word[i : ends[i]])
        i = ends[i]
    return out


def breaker(dictionary: frozenset[str], longest: int = 4):
    """Pandas UDF: of each array of tokens, those longer than `longest` broken up where that is possible, then all tokens again."""

    most = max(map(len, dictionary), default=0)

    @F.pandas_udf(ArrayType(StringType()))
    def broken(tokens: pd.Series) -> pd.Series:
        def one(ts):
            return None if ts is None else [w for t in ts for w in ((word_break(t, dictionary, most) or []) if len(t) > longest else [])] + list(ts)

        return tokens.map(one)

    return broken
