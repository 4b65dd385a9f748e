"""Small tables with what a real one may hold: nulls, empty and long texts, ties, repeated rows, clashing names."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use within.
CLASHING = ["id", "t", "th", "rid", "fp", "root", "kind", "hits", "spans", "size", "key", "at", "gone", "__gone", "y", "score", "runs", "blob", "block", "bucket", "value", "item_id", "doc", "words", "target", "kept_text"]


def rows(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["é", "中文", "naïve", "x y", "😀"]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage = words(70)
    texts = [None, "", " \t\n\x0b\x0c\r ", "a", "a b", "A b C", " ".join(words(49)), " ".join(words(50))]
    texts += [" ".join(words(rng.randrange(1, 120))) for _ in range(12)]
    texts += [" ".join(words(10) + passage + words(9)), "  ".join(passage) + "\n" + " ".join(words(5)), "\t".join(words(3) + passage[:51])]
    texts += [" ".join(["again"] * 300), " ".join(["again"] * 120), " ".join(words(30) * 5)]
    texts += [" ".join(words(30_000)), "q" * 50_000, texts[8], texts[8].upper()]
    out = [(k * 3 - 9, x, rng.choice(["en", "de", None]), rng.choice(["a", "b", "é", "Z", None]), None if x is None else len(x)) for k, x in enumerate(texts)]
    out += [out[9], out[9], (out[9][0], texts[15], "en", "a", 1)]  # repeated rows, and an id with two texts
    out += [(None, texts[10], "en", None, 0), (None, "only here", None, "a", None), (None, None, None, None, None)]
    rng.shuffle(out)
    return out


def documents(spark, seed: int = 1, clashing: bool = True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows(seed), DOCS).repartition(5)
    return df.withColumns({c: F.lit(f"<{c}>") for c in CLASHING}) if clashing else df


def empty(spark):
    return spark.createDataFrame([], DOCS)


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")
