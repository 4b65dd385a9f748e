"""Token counts by a public tokenizer, with huge documents encoded in overlapping chunks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only

#: Characters of a chunk, of the first overlap of two, and kept from a cut on either side of a splice.
CHUNK, OVERLAP, MARGIN = 32_768, 1_024, 32


def load(vocabulary: str):
    """The tokenizer of a .json file: its place, or its name among the installed public ones."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, processors

    if os.sep not in vocabulary:
        import public_tokenizers

        vocabulary = public_tokenizers.path(vocabulary)
    tok = Tokenizer.from_file(vocabulary)
    tok.no_truncation()
    tok.no_padding()
    # Starts are then those of tokens, blanks included; nothing else is left of the post-processor without special tokens.
    tok.post_processor = processors.ByteLevel(trim_offsets=False)
    return tok


def _encoded(tok, text: str, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of text encoded alone: token ids, their starts counted from `at` on, and which begin a pre-token."""
    e = tok.encode(text, add_special_tokens=False)
    ids = np.array(e.ids, np.int64)
    starts = np.array([a for a, _ in e.offsets], np.int64).reshape(-1) + at
    words = np.array([-1 if w is None else w for w in e.word_ids], np.int64)
    return ids, starts, np.concatenate([[True], words[1:] != words[:-1]]) if len(ids) else np.zeros(0, bool)


def count(tok, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, margin: int = MARGIN) -> int:
    """Tokens of the whole text.

    Encodings of two overlapping chunks are spliced at the first place where both begin a pre-token with the same
    token. Pre-tokens are found from left to right and depend on nothing before their start and, but for a
    look-ahead and special strings (both shorter than the margin), on nothing behind their end; so from such a place
    on the second encoding is the whole text's, and up to it the first is. Without such a place the overlap is
    doubled, by encoding the first chunk further, until there is one or the text ends."""
    n = len(text)
    # No special string may reach across the margin.
    margin = max([margin, *(2 * len(t.content) for t in tok.get_added_tokens_decoder().values())])
    overlap = max(overlap, 4 * margin)
    if n <= chunk:
        return len(tok.encode(text, add_special_tokens=False).ids)
    total, begin, end = 0, 0, chunk
    left = _encoded(tok, text[begin:end], begin)
    low = 0  # tokens of `left` before this place are counted already
    while end < n:
        wide = overlap
        while True:
            start = max(begin, end - wide)
            right_end = min(n, max(end, start + chunk))
            right = _encoded(tok, text[start:right_end], start)
            ok = [(s >= max(start + margin, low)) & (s < end - margin) & w for _, s, w in (left, right)]
            a = {(int(s), int(i)): k for k, (i, s) in zip(np.flatnonzero(ok[0]), zip(left[0][ok[0]], left[1][ok[0]]))}
            hit = next(((a[key], k) for k, key in zip(np.flatnonzero(ok[1]), zip(right[1][ok[1]].tolist(), right[0][ok[1]].tolist())) if key in a), None)
            if hit:
                break
            wide *= 2
            end = min(n, end + wide)
            left = _encoded(tok, text[begin:end], begin)
            if end == n:
                break
        if not hit:
            break
        total += hit[0]
        begin, low, end = int(right[1][hit[1]]), int(right[1][hit[1]]), right_end
        # Encoded anew only if it must be widened: its own start is a proven boundary.
        left = tuple(x[hit[1]:] for x in right)
    return total + len(left[0])


class Pieces:
    """Counts of texts by their pieces, which are parted where one blank stands between two characters that are not
    white space. There a byte-level pre-tokeniser always begins a pre-token and looks at nothing before it, and special
    strings hold no blank, so a text's count is the sum over its pieces. Equal pieces are encoded once for as long as
    one of two tables of them (KNOWN pieces each at most) holds: pieces still met move from the older to the newer."""

    KNOWN, LONGEST, JOINED = 400_000, 64, 2_000

    def __init__(self, tok):
        import json
        import re

        self.tok, self.known, self.older = tok, {}, {}
        self.parted = re.compile(r"(?<=\S) (?=\S)").split
        spec = json.loads(tok.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.apart = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer") and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])
        # Which tokens begin with a blank, as its byte is written.
        names = tok.get_vocab(with_added_tokens=False)
        self.blank = np.zeros(max([*tok.get_vocab().values(), 0]) + 1, bool)
        self.blank[[i for name, i in names.items() if name.startswith("\u0120")]] = True

    def encoded(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def each(self, pieces: list[str]):
        """(piece, count) behind a blank. Pieces without white space at their end or blanks are encoded many at a time: of
        their tokens just the first begins with a blank."""
        plain = [p for p in pieces if " " not in p and not p[-1].isspace()]
        rest = [p for p in pieces if " " in p or p[-1].isspace()]
        lines = [plain[lo : lo + self.JOINED] for lo in range(0, len(plain), self.JOINED)]
        for some, e in zip(lines, self.tok.encode_batch_fast([" " + " ".join(x) for x in lines], add_special_tokens=False)):
            ids = np.array(e.ids)
            first = np.flatnonzero(self.blank[ids])
            if len(first) == len(some):
                yield from zip(some, np.diff(np.append(first, len(ids))).tolist())
            else:
                rest += some
        yield from zip(rest, self.encoded([" " + p for p in rest]))

    def counts(self, texts: list[str]) -> list[int]:
        if not self.apart:
            return self.encoded(texts)
        heads, tails = [], []
        for t in texts:
            head, *tail = self.parted(t)
            heads.append(head)
            tails.append(tail)
        if len(self.known) > self.KNOWN:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = set().union(*tails).difference(known)
        met = new.intersection(older)
        known.update((p, older[p]) for p in met)
        new -= met
        known.update(self.each(list(new)))
        out = [n + sum(map(known.__getitem__, tail)) for n, tail in zip(self.encoded(heads), tails)]
        for p in new:
            if len(p) > self.LONGEST:
                del known[p]
        return out


def shared(vocabulary: str) -> Pieces:
    """The tokenizer of a worker process, which its tasks share with the pieces it knows. It hangs on a module of the process's
    own, as this package's functions reach each task anew, by value."""
    import sys
    import types

    known = sys.modules.setdefault("_gleaner_of_process", types.ModuleType("_gleaner_of_process")).__dict__
    if vocabulary not in known:
        known[vocabulary] = Pieces(load(vocabulary))
    return known[vocabulary]


def token_counts(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 1024, id: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row. Null and empty texts have no tokens; repeated rows and null or
    repeated ids stay rows of their own; texts longer than `chunk` are encoded in overlapping chunks; an empty table
    gives an empty result."""

    def run(batches):
        pieces = shared(vocabulary)
        tok = pieces.tok
        for b in batches:
            texts = [(t or b"").decode("utf-8", "replace") for t in b.column(1).to_pylist()]
            sizes = [len(t or b"") for t in b.column(1).to_pylist()]
            counts = np.zeros(len(texts), np.int64)
            short = [i for i, t in enumerate(texts) if len(t) <= chunk]
            at = 0
            while at < len(short):
                some, held = [], 0
                while at < len(short) and held < 1 << 20:
                    some.append(short[at])
                    held += len(texts[short[at]])
                    at += 1
                counts[some] = pieces.counts([texts[i] for i in some])
            for i, t in enumerate(texts):
                if len(t) > chunk:
                    counts[i] = count(tok, t, chunk, overlap)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(counts)], ["doc_id", "n_bytes", "n_tokens"])

    narrow = only(docs, doc_id=id, text=text).select("doc_id", F.col("text").cast("binary").alias("text"))
    out = narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
