import random

import odd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gleaner.llm import tokens

OWN = tokens.load("byte_bpe_50k.json")
CLEAN = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def want(t, tok=CLEAN):
    return len(tok.encode(t or "", add_special_tokens=False).ids)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()), key=repr)


def brute(rows):
    return sorted(((i, len((t or "").encode()), want(t), want(t) > 1024) for i, t in rows), key=repr)


SPECIAL = ["<|endoftext|>", " <|endoftext|>", "a<|endoftext|>b <|endoftext|> c", "<|endof", "text|>", "  a  b ", "\ta", " \n x", "a   b", "don't I'll 've", "x" * 100, "1 22 333", " a b　c"]


def test_tables_and_odd(spark, sf):
    rows = [tuple(r) for r in odd.table(spark, sf, "documents").select("doc_id", "text").collect()]
    rows += [r[:2] for r in odd.rows()] + list(enumerate(SPECIAL)) + [(99, " ".join(SPECIAL) * 3)]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, n_bytes int, n_tokens string").repartition(3)
    assert got(tokens.token_counts(df)) == brute(rows)


@pytest.mark.parametrize("chunk,overlap", [(300, 64), (1000, 100)])
def test_spliced(chunk, overlap):
    """Huge texts in small chunks: words, digits, blanks and letters without an end, special strings on the cuts."""
    rng = random.Random(chunk)
    parts = [" ", "  ", "\n\n", "word", "Wörter", "中文字", "12345", "'s", "<|endoftext|>", "😀😀", "a" * 150, " " * 90, "-" * 70, "x1" * 60, ".", " the", " of"]
    for _ in range(40):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(50, 800)))
        assert tokens.count(OWN, t, chunk, overlap) == want(t)
    for t in ("a" * 5000, " " * 5000, "1" * 5000, "ab " * 3000, "\n" * 4000, "<|endoftext|>" * 400, "é" * 4000, "a\n" * 3000):
        assert tokens.count(OWN, t, chunk, overlap) == want(t)


def test_other_vocabulary(spark):
    """A tokeniser whose blanks are no boundary: pieces are not parted."""
    other = tokens.load("word_bpe_49k.json")
    assert not tokens.Pieces(other).apart and tokens.Pieces(tokens.load("byte_bpe_50k.json")).apart
    df = spark.createDataFrame(list(enumerate(["Some words, here", None, "and <|endoftext|> there"])), "doc_id long, text string")
    assert [r["n_tokens"] for r in tokens.token_counts(df, "word_bpe_49k.json", limit=2).orderBy("doc_id").collect()] == [want(t, other) for t in ("Some words, here", None, "and <|endoftext|> there")]


def test_empty(spark):
    assert tokens.token_counts(odd.empty(spark)).count() == 0
