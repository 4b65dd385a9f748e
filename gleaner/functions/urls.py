"""URLs as columns: parts, resolution, scope, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCHEME, _HOST, _PATH = r"^([a-zA-Z][a-zA-Z0-9+.-]*):", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)"
#: Words left out of a URL's tokens.
COMMON = ("http", "https", "www", "com", "cn", "asp", "ftp", "net")
_JUNK = "\t\r\n \"'"


def trim(url: Column) -> Column:
    return F.trim(url, F.lit(_JUNK))


def scheme(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _SCHEME, 1), F.lit(""))


def host(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _HOST, 1), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PATH, 1), F.lit(""))


def without_dots(path: Column) -> Column:
    """A path without its dot segments."""
    step = lambda z, x: F.when(x == ".", z).when(x == "..", F.slice(z, 1, F.greatest(F.size(z) - 1, F.lit(1)))).otherwise(F.concat(z, F.array(x)))
    # The first part, before the path's first slash, stays; a path that ends in a dot segment ends in a slash.
    parts = F.split(path, "/", -1)
    kept = F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), F.slice(parts, 1, 1), step)
    kept = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.array_join(kept, "/")).otherwise(path)


def resolve(url: Column, base: Column) -> Column:
    """url as seen from base, without dot segments; null if it is null or only a fragment."""
    root = F.concat(scheme(base), F.lit("://"), host(base))
    folder = F.regexp_replace(F.when(path(base) == "", "/").otherwise(path(base)), "[^/]*$", "")
    own = F.regexp_extract(url, "^([^?#]*)", 1)
    rest = F.substr(url, F.length(own) + 1)
    return (
        F.when(url.isNull() | url.startswith("#"), F.lit(None).cast("string"))
        .when(scheme(url) != "", url)
        .when(url.startswith("//"), F.concat(scheme(base), F.lit(":"), url))
        .when(url.startswith("/"), F.concat(root, without_dots(own), rest))
        .when(url.startswith("?"), F.concat(root, path(base), url))
        .otherwise(F.concat(root, without_dots(F.concat(folder, own)), rest))
    )


def normalized(url: Column, base: Column) -> Column:
    """Resolved if it names no host; a URL without a path gets a slash at its end."""
    u = F.when(host(url) == "", resolve(url, base)).otherwise(url)
    return F.when((host(u) != "") & (path(u) == ""), F.concat(u, F.lit("/"))).otherwise(u)


def key(url: Column) -> Column:
    return F.md5(url.cast("binary"))


def in_scope(raw: Column, url: Column, base: Column) -> Column:
    """A page of the same site that is no tag list and no video."""
    return ~raw.rlike("tag|video") & scheme(url).isin("http", "https") & (host(url) == host(base)) & (F.length(path(url)) > 1)


def worth_anchor(text: Column, least: int = 5) -> Column:
    return (F.length(text) > least) & text.rlike(r"[^0-9\t\n \r]")


def decoded(url: Column) -> Column:
    """Percent escapes read (kept as they are where they are broken), then all but ASCII letters and digits as blanks."""
    return F.regexp_replace(F.coalesce(F.try_url_decode(url), url), "[^a-zA-Z0-9]", " ")


def words(url: Column) -> Column:
    return F.split(url, r"\W+")


def tokens(url: Column) -> Column:
    """Words of the decoded URL without the common ones."""
    return F.filter(F.split(F.lower(decoded(url)), " +"), lambda x: (x != "") & ~x.isin(*COMMON))


def char_ngrams(token: Column, n: int = 3) -> Column:
    return F.when(F.length(token) >= n, F.transform(F.sequence(F.lit(1), F.length(token) - (n - 1)), lambda i: F.substr(token, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def tokens_with_ngrams(url: Column, n: int = 3, longest: int = 4) -> Column:
    """n-grams of the tokens longer than `longest`, then all tokens."""
    t = tokens(url)
    return F.concat(F.flatten(F.transform(F.filter(t, lambda x: F.length(x) > longest), lambda x: char_ngrams(x, n))), t)


def without_words(text: Column) -> Column:
    """Without runs of CJK characters, letters and digits."""
    return F.regexp_replace(text, r"[一-龥a-zA-Z0-9]+", "")


def agent(url: Column, names: tuple[str, ...]) -> Column:
    """One of the names for each URL, the same in every run."""
    place = F.conv(F.substring(key(url), 1, 4), 16, 10).cast("int") % len(names)
    return F.get(F.array(*map(F.lit, names)), place)
