"""Tokens and text scalars."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~，。、；：？！“”‘’（）《》【】…—·"
#: Words left out, by language.
STOPS = {
    "en": tuple("a an and are as at be by for from in is it of on or that the this to was with".split()),
    "de": tuple("der die das und von zu mit den ist".split()),
    "fr": tuple("le la les de des et en un une que qui pour par".split()),
    "es": tuple("el los las y se su con".split()),
}
STOP = tuple(w for words in STOPS.values() for w in words)
CJK = r"[⺀-鿿]"
_NO_MARKS = {ord(c): None for c in PUNCTUATION}


def spaced_cjk(text: Column) -> Column:
    """CJK characters parted from all else by blanks."""
    return F.regexp_replace(text, f"({CJK})", " $1 ")


def title_words(text: Column) -> Column:
    t = F.split(F.lower(spaced_cjk(text)), r"\s+")
    return F.filter(t, lambda x: (x != "") & (F.translate(x, PUNCTUATION, "") != ""))


def plain_title_words(text: str) -> list[str]:
    """As title_words, of one text."""
    return [w for w in re.sub(f"({CJK})", r" \1 ", text).lower().split() if w.translate(_NO_MARKS)]


def has_letter(token: Column) -> Column:
    return token.rlike(r"[a-zA-Z⺀-鿿]")


def without_punctuation(text: Column) -> Column:
    return F.translate(text, PUNCTUATION, "")


def words(text: Column) -> Column:
    """Lower-case words with a letter, without punctuation."""
    return F.filter(F.split(F.lower(without_punctuation(F.coalesce(text, F.lit("")))), r"[ \t\n\r]+"), has_letter)


def without_stops(tokens: Column, stops: tuple[str, ...] = STOP) -> Column:
    return F.filter(tokens, lambda x: ~x.isin(*stops))


def without_stops_of(tokens: Column, language: Column) -> Column:
    """Without the words left out in a language; of other languages all stay."""
    lists = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for pair in STOPS.items() for x in pair))
    own = F.coalesce(F.try_element_at(lists, language), F.array().cast("array<string>"))
    return bound(own, lambda stops: F.filter(tokens, lambda x: ~F.array_contains(stops, x)))


def squeezed(text: Column) -> Column:
    """'' for less than 2 characters, otherwise without any white space."""
    return F.when(F.length(text) < 2, "").otherwise(F.regexp_replace(F.regexp_replace(text, r"[\r,\n]\s", ""), r"\s+", ""))


def bound(value: Column, use) -> Column:
    """use(value), with value evaluated once: a lambda that names an expression evaluates it for each element."""
    return F.transform(F.array(value), use)[0]


def bigrams(tokens: Column) -> Column:
    def pairs(t: Column) -> Column:
        n = F.greatest(F.size(t) - 1, F.lit(0))
        return F.zip_with(F.slice(t, F.lit(1), n), F.slice(t, F.lit(2), n), lambda x, y: F.concat(x, F.lit(" "), y))

    return bound(tokens, pairs)


def grams(tokens: Column) -> Column:
    """Bigrams, then words."""
    return bound(tokens, lambda t: F.concat(bigrams(t), t))


def counted(items: Column) -> Column:
    """Array of (item, n) of an array's distinct items, in order: the runs of the sorted array."""
    def runs(g: Column) -> Column:
        first = F.array_compact(F.transform(g, lambda x, i: F.when((i == 0) | (x != F.get(g, i - 1)), i)))
        upto = lambda at: F.slice(F.concat(at, F.array(F.size(g))), F.lit(2), F.size(at))
        return bound(first, lambda at: F.zip_with(at, upto(at), lambda i, j: F.struct(F.get(g, i).alias("item"), (j - i).cast("long").alias("n"))))

    return bound(F.sort_array(items), runs)


def codes(text: Column, which: str) -> Column:
    """Steps by letters, in turn: _ drops line ends, b tags, t parts words, n makes them lower-case and plain, v puts one on a line, r drops white space."""
    for c in which:
        text = {
            "_": lambda x: F.regexp_replace(x, r"[\r\n]+", " "),
            "b": lambda x: F.regexp_replace(x, "<[^>]+>", " "),
            "t": lambda x: F.regexp_replace(x, "([A-Za-z0-9]+)", " $1 "),
            "n": lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9\n ]", " "),
            "v": lambda x: F.regexp_replace(F.trim(x), " +", "\n"),
            "r": lambda x: F.regexp_replace(x, r"\s+", ""),
        }[c](text)
    return text


def simple_path(xpath: Column) -> Column:
    """An element's path without places."""
    return F.regexp_replace(xpath, r"\[\d+\]", "")


def place(step: Column) -> Column:
    """The place that a step of a path names, or 0."""
    return F.coalesce(F.regexp_extract(step, r"\[(\d+)\]", 1).try_cast("int"), F.lit(0))


def index_of(text: Column, what: str, start: int = 0) -> Column:
    return F.locate(what, text, start + 1) - 1


def common(a: list, b: list, within: bool) -> int:
    """Length of the longest common subsequence; a column of its table is the bits of one whole number (Hyyrö's recurrence)."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    if within:
        own = at
        at = {y: sum(bits for x, bits in own.items() if x in y) for y in set(b)}
    full = (1 << len(a)) - 1
    free = full
    for y in b:
        if hit := free & at.get(y, 0):
            free = (free + hit | free - hit) & full
    return len(a) - free.bit_count()


@F.arrow_udf(IntegerType())
def lcs(a: pa.Array, b: pa.Array) -> pa.Array:
    """Length of the longest common subsequence of two arrays; one row's words at a time are Python's."""
    return pa.array((common(x.as_py(), y.as_py(), False) if x.is_valid and y.is_valid else 0 for x, y in zip(a, b)), pa.int32())


@F.arrow_udf(IntegerType())
def lcs_within(a: pa.Array, b: pa.Array) -> pa.Array:
    """As lcs, where a word also equals one that it is part of."""
    return pa.array((common(x.as_py(), y.as_py(), True) if x.is_valid and y.is_valid else 0 for x, y in zip(a, b)), pa.int32())
