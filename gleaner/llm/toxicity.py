"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy."""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gram_hashes, only, span_hashes, spread, word_bounds
from .decontamination import words_line

#: Words of a window, which starts at every word that has as many behind it; units; numbers of an embedding.
WIDTH, UNITS, DIM = 32, 8, 8
#: Character inputs of a word: all runs of so many bytes of it between marks of its ends, dealt to so many learnt vectors.
GRAMS, BUCKETS = (3, 4), 1 << 14
#: The bounded sample to fit on: rows of either label, bytes of a text that may be in it. Documents that must hold an input for it to be learnt; passes.
SAMPLE, SAMPLE_BYTES, LEAST, PASSES = 1_500, 1 << 16, 3, 8
#: First passes, which learn from windows drawn at random, how many of each text, and steps of a pass at least.
DRAWN, DRAWS, STEPS = 2, 6, 40
#: Bytes of texts and words read at a time; windows of a step.
_GROUP, _WORDS, _CHUNK = 1 << 20, 1 << 20, 2_048
#: e^v is ((w^2 + a)^2 + b w + c)^32 with w = slope v + shift: 1 / (1 + e^v) is then off by 2e-6 at most, for v from _LEAST_V on.
_SLOPE, _SHIFT, _A, _B, _C = map(np.float32, (0.014103287, 0.45379826, 0.60964465, 0.73536384, 0.0011264787))
_LEAST_V = -64.0


def _rows(offsets: np.ndarray, ids: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some of the lists that offsets cut ids into, as offsets and ids."""
    count = np.diff(offsets)[which]
    owner, number = spread(count)
    return np.append(0, np.cumsum(count)), ids[offsets[which][owner] + number]


class Inputs:
    """Texts as words: for each distinct word its hash and its character runs (ids, cut by offsets), and the words of each
    text in turn."""

    def __init__(self, texts: list[bytes | None]):
        lines = [words_line(t) for t in texts]
        self.sizes = np.array([x.count(b" ") + 1 if x else 0 for x in lines], np.int64)
        line = b" ".join(x for x in lines if x)
        data = np.frombuffer(line, np.uint8)
        if not len(data):
            self.words, self.seq, self.offsets, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64)
            return
        starts, ends = word_bounds(data)
        self.words, at, self.seq = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        size = (ends - starts)[at] + 2
        owner, number = spread(size)
        marked = data[np.clip(starts[at][owner] + number - 1, 0, len(data) - 1)]
        marked[number == 0], marked[number == size[owner] - 1] = 60, 62
        who, ids = [], []
        for n in GRAMS:
            g = gram_hashes(marked, n)
            whole = number[: len(g)] + n <= size[owner[: len(g)]]
            who.append(owner[: len(g)][whole])
            ids.append((g[whole] % np.uint64(BUCKETS)).astype(np.int64))
        turn = np.argsort(np.concatenate(who), kind="stable")
        self.ids = np.concatenate(ids)[turn]
        self.offsets = np.append(0, np.cumsum(np.bincount(np.concatenate(who), minlength=len(at))))

    @classmethod
    def gathered(cls, texts: list[bytes | None]) -> Inputs:
        """Those of many texts, read by _GROUP bytes."""
        parts, at = [], 0
        while at < len(texts):
            first, held = at, 0
            while at < len(texts) and held < _GROUP:
                held += len(texts[at] or b"")
                at += 1
            parts.append(cls(texts[first:at]))
        out = cls([])
        if parts:
            out.sizes = np.concatenate([x.sizes for x in parts])
            out.words, first, place = np.unique(np.concatenate([x.words for x in parts]), return_index=True, return_inverse=True)
            offsets = np.append(0, np.cumsum(np.concatenate([np.diff(x.offsets) for x in parts])))
            out.offsets, out.ids = _rows(offsets, np.concatenate([x.ids for x in parts]), first)
            starts = np.cumsum([0, *(len(x.words) for x in parts)])
            out.seq = np.concatenate([place[x.seq + a].astype(np.int32) for x, a in zip(parts, starts)])
        return out

    def part(self, first: int, last: int) -> Inputs:
        """Texts first to last - 1."""
        out, ends = Inputs([]), np.append(0, np.cumsum(self.sizes))
        out.words, out.offsets, out.ids, out.sizes, out.seq = self.words, self.offsets, self.ids, self.sizes[first:last], self.seq[ends[first] : ends[last]]
        return out

    def starts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of each window's first word in seq, words from there to the text's end, text of each window): a window
        at every word that WIDTH - 1 follow. A shorter text has one window, and one without words a window of nothing."""
        owner, number = spread(np.maximum(1, self.sizes - WIDTH + 1))
        return (np.cumsum(self.sizes) - self.sizes)[owner] + number, self.sizes[owner] - number, owner

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(places of each window's words in seq, -1 behind the text's end; text of each window)."""
        begin, left, owner = self.starts()
        return places(begin, left), owner


def places(begin: np.ndarray, left: np.ndarray) -> np.ndarray:
    step = np.arange(WIDTH)
    return np.where(step < left[:, None], begin[:, None] + step, -1)


def _find(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    """1 + place in the sorted array, 0 for what is not there."""
    if not len(known):
        return np.zeros(h.shape, np.int64)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[at] == h, at + 1, 0)


def _firsts(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each window of words, which begins at `at`: the first window with the same words, compared one by one."""
    h = span_hashes(words.astype(np.uint64), at, at + WIDTH)
    code, kinds = pd.factorize(h)
    first = np.empty(len(kinds), np.int64)
    first[code[::-1]] = np.arange(len(at))[::-1]
    out = first[code]
    again = np.flatnonzero(out != np.arange(len(at)))
    for k in range(WIDTH):
        differ = words[at[again] + k] != words[at[out[again]] + k]
        if differ.any():
            out[again[differ]] = again[differ]
            again = again[~differ]
    return out


def _power(w: np.ndarray, out: np.ndarray, floor: np.float32 | None = None) -> np.ndarray:
    """e^v of w = _SLOPE v + _SHIFT, into out; w is spent. What lies below the floor counts as the floor."""
    if floor is not None:
        np.maximum(w, floor, out=w)
    np.square(w, out=out)
    out += _A
    np.square(out, out=out)
    w *= _B
    out += w
    out += _C
    for _ in range(5):
        np.square(out, out=out)
    return out


def _moved(g: np.ndarray, t: int, size: int) -> np.ndarray:
    """Columns t to t + size of the first of two tables, and of the second those as far from its end."""
    return np.ndarray((2, g.shape[1], size), g.dtype, g, 4 * t, (g.strides[0] + 4 * (WIDTH - 1 - 2 * t), g.strides[1], 4))


class Model:
    """words: hashes of those that have a vector of their own; p: parameters by name."""

    def __init__(self, words: np.ndarray, p: dict[str, np.ndarray]):
        self.words, self.p = words, p

    def vectors(self, x: Inputs, which: np.ndarray | None = None) -> np.ndarray:
        """Inputs of words (all distinct ones of x, or some): the word's vector, and the mean of its character runs'."""
        words, offsets, ids = x.words, x.offsets, x.ids
        if which is not None:
            words, (offsets, ids) = words[which], _rows(offsets, ids, which)
        if not len(words):
            return np.zeros((0, 2 * DIM), np.float32)
        chars = np.add.reduceat(self.p["char"][ids], offsets[:-1]) / np.diff(offsets)[:, None]
        return np.concatenate([self.p["word"][_find(self.words, words)], chars], 1).astype(np.float32)

    def logits(self, x: Inputs) -> tuple[np.ndarray, np.ndarray]:
        """Each window's logit, and its text. In long texts a step's words are those of the step before, moved by one;
        windows that reach into the next text are dropped, and windows of equal words are scored once."""
        begin, left, owner = x.starts()
        v = self.vectors(x)
        v = np.concatenate([v, np.zeros((1, v.shape[1]), np.float32)])
        # A reset or update gate is 1 / (1 + e^-g), a new state 1 - 2 / (1 + e^2g): the tables and heads hold what _power
        # takes. The last columns of a table are the state behind a window's first word.
        factor = np.where(np.arange(3 * UNITS) < 2 * UNITS, -1, 2).astype(np.float32)
        tables, heads, floor = [], [], None
        for d in "fb":
            g, u = (v @ self.p[f"w{d}"] + self.p[f"b{d}"]) * factor, self.p[f"u{d}"] * factor
            if (g.min(0) - np.abs(u).sum(0)).min() < _LEAST_V:
                floor = np.float32(_SLOPE * _LEAST_V + _SHIFT)
            with np.errstate(over="ignore"):
                n = 1 - 2 / (1 + np.exp(g[:, 2 * UNITS :]))
                h = n - n / (1 + np.exp(g[:, :UNITS]))
            tables.append(np.concatenate([_SLOPE * g + _SHIFT, h], 1).astype(np.float32))
            heads.append(np.concatenate([_SLOPE * u.T, [self.p[f"a{d}"], self.p[f"o{d}"]]]).astype(np.float32))
        heads = np.stack(heads)
        out = np.empty(len(begin), np.float32)
        long = x.sizes >= 2 * WIDTH
        each = np.flatnonzero(~long[owner])
        for lo in range(0, len(each), _CHUNK):
            some = each[lo : lo + _CHUNK]
            at = places(begin[some], left[some]).T
            s = np.append(x.seq, len(v) - 1)[at]
            got = lambda t: np.stack([tables[k].take(s[i], 0).T for k, i in enumerate((t, WIDTH - 1 - t))])  # noqa: B023, E731
            out[some] = self._pooled(got, heads, at.shape[1], floor, at >= 0)
        if long.any():
            words = np.append(x.seq[np.repeat(long, x.sizes)], np.full(WIDTH - 1, len(v) - 1))
            # What shorter texts before it hold is not in words.
            shift = np.cumsum(np.where(long, 0, x.sizes))
            mine = long[owner]
            place = begin[mine] - shift[owner[mine]]
            first = _firsts(words, place)
            # Words of no window that is the first of its kind are left out.
            edges = np.zeros(len(words) + 1, np.int64)
            np.add.at(edges, place[first], 1)
            np.subtract.at(edges, place[first] + WIDTH, 1)
            held = np.cumsum(edges[:-1]) > 0
            kept, rank = words[held], np.cumsum(held) - 1
            n = len(kept) - WIDTH + 1
            got = np.empty(n, np.float32)
            for lo in range(0, n, _CHUNK):
                size = min(_CHUNK, n - lo)
                s = kept[lo : lo + size + WIDTH - 1]
                g = np.stack([np.ascontiguousarray(t.take(s, 0).T) for t in tables])
                got[lo : lo + size] = self._pooled(lambda t: _moved(g, t, size), heads, size, floor)  # noqa: B023
            out[mine] = got[rank[place[first]]]
        return out, owner

    def _pooled(self, inputs, heads: np.ndarray, size: int, floor: np.float32 | None, live: np.ndarray | None = None) -> np.ndarray:
        """Logits of `size` windows: inputs(t) are those of step t in both directions, live says which steps have words."""
        score, value = np.zeros((WIDTH, size), np.float32), np.zeros((WIDTH, size), np.float32)
        one, two, whole = np.float32(1), 2 * UNITS, None if live is None else live.all(1)
        got = np.empty((2, heads.shape[1], size), np.float32)
        w, zr = np.empty((2, two, size), np.float32), np.empty((2, two, size), np.float32)
        n, e = np.empty((2, UNITS, size), np.float32), np.empty((2, UNITS, size), np.float32)
        # Both directions take their steps side by side. What overflows stands for a gate that is shut.
        with np.errstate(over="ignore"):
            for t in range(WIDTH):
                steps, gx = (t, WIDTH - 1 - t), inputs(t)
                if not t:
                    h = np.ascontiguousarray(gx[:, 3 * UNITS :])
                    if live is not None:
                        h *= live[list(steps), None]
                else:
                    old = None if live is None or whole[list(steps)].all() else h.copy()
                    np.add(gx[:, :two], got[:, :two], out=w)
                    _power(w, zr, floor)
                    zr += one
                    np.divide(got[:, two : two + UNITS], zr[:, UNITS:], out=n)
                    n += gx[:, two : two + UNITS]
                    _power(n, e, floor)
                    e += one
                    np.divide(np.float32(-2), e, out=n)
                    n += one
                    h -= n
                    h /= zr[:, :UNITS]
                    h += n
                    if old is not None:
                        for k in (0, 1):
                            h[k] = np.where(live[steps[k]], h[k], old[k])
                np.matmul(heads, h, out=got)
                for k in (0, 1):
                    score[steps[k]] += got[k, -2]
                    value[steps[k]] += got[k, -1]
        if live is not None:
            score = np.where(live, score, -1e9)
        weight = np.exp(score - score.max(0))
        if live is not None:
            weight *= live
        weight /= np.maximum(weight.sum(0), 1e-9)
        return (value * weight).sum(0) + self.p["o"]

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        """A text's score is that of its most toxic window. Equal texts are scored once."""
        place: dict[bytes, int] = {}
        which = np.array([place.setdefault(t or b"", len(place)) for t in texts], np.int64)
        return self._scores(list(place))[which] if texts else np.zeros(0)

    def _scores(self, texts: list[bytes]) -> np.ndarray:
        out, at = np.empty(len(texts)), 0
        while at < len(texts):
            first, held = at, 0
            while at < len(texts) and held < _GROUP:
                held += len(texts[at] or b"")
                at += 1
            logit, owner = self.logits(Inputs(texts[first:at]))
            top = np.maximum.reduceat(logit, np.searchsorted(owner, np.arange(at - first)))
            out[first:at] = 1 / (1 + np.exp(-np.clip(top, -30, 30)))
        return out


def _step(p: dict[str, np.ndarray], m: Model, inputs: Inputs, at: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean cross-entropy over a batch of windows: at (B, T) holds places in inputs.seq, -1 for none."""
    live = at >= 0
    which, word = np.unique(inputs.seq[at[live]], return_inverse=True)
    x = np.zeros((*at.shape, 2 * DIM), np.float32)
    x[live] = m.vectors(inputs, which)[word]
    size, grads, kept, states = len(y), {}, {}, {}
    for d in "fb":
        u = p[f"u{d}"]
        gx_all = x @ p[f"w{d}"] + p[f"b{d}"]
        h = np.zeros((size, UNITS), np.float32)
        hs, tape = np.zeros((WIDTH, size, UNITS), np.float32), []
        for t in range(WIDTH) if d == "f" else range(WIDTH - 1, -1, -1):
            gx, gh = gx_all[:, t], h @ u
            zr = 1 / (1 + np.exp(-np.clip(gx[:, : 2 * UNITS] + gh[:, : 2 * UNITS], -30, 30)))
            z, r = zr[:, :UNITS], zr[:, UNITS:]
            n = np.tanh(gx[:, 2 * UNITS :] + r * gh[:, 2 * UNITS :])
            new = (1 - z) * n + z * h
            on = live[:, t, None]
            tape.append((t, h, z, r, n, gh[:, 2 * UNITS :], on))
            h = np.where(on, new, h)
            hs[t] = h
        kept[d], states[d] = tape, hs
    score = np.where(live.T, states["f"] @ p["af"] + states["b"] @ p["ab"], -1e9)
    weight = np.exp(score - score.max(0)) * live.T
    weight /= np.maximum(weight.sum(0), 1e-9)
    value = states["f"] @ p["of"] + states["b"] @ p["ob"]
    logit = (value * weight).sum(0) + p["o"]
    dl = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y).astype(np.float32) / size
    grads["o"] = dl.sum(keepdims=True).reshape(p["o"].shape)
    dvalue = weight * dl
    dscore = weight * (value - (value * weight).sum(0)) * dl
    dx = np.zeros_like(x)
    for d in "fb":
        hs, u = states[d], p[f"u{d}"]
        grads[f"o{d}"], grads[f"a{d}"] = np.einsum("tb,tbh->h", dvalue, hs), np.einsum("tb,tbh->h", dscore, hs)
        dhs = dvalue[..., None] * p[f"o{d}"] + dscore[..., None] * p[f"a{d}"]
        du, dw, dh = np.zeros_like(u), np.zeros_like(p[f"w{d}"]), np.zeros((size, UNITS), np.float32)
        db = np.zeros_like(p[f"b{d}"])
        for t, h, z, r, n, ghn, on in reversed(kept[d]):
            dh = dh + dhs[t]
            dnew, passed = np.where(on, dh, 0), np.where(on, 0, dh)
            dn = dnew * (1 - z) * (1 - n * n)
            dz = dnew * (h - n) * z * (1 - z)
            dr = dn * ghn * r * (1 - r)
            dgx = np.concatenate([dz, dr, dn], 1)
            dgh = np.concatenate([dz, dr, dn * r], 1)
            du += h.T @ dgh
            dw += x[:, t].T @ dgx
            db += dgx.sum(0)
            dx[:, t] += dgx @ p[f"w{d}"].T
            dh = passed + dnew * z + dgh @ u.T
        grads[f"u{d}"], grads[f"w{d}"], grads[f"b{d}"] = du, dw, db
    each = np.zeros((len(which), 2 * DIM), np.float32)
    np.add.at(each, word, dx[live])
    grads["word"], grads["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
    np.add.at(grads["word"], _find(m.words, inputs.words[which]), each[:, :DIM])
    grads["word"][0] = 0
    offsets, ids = _rows(inputs.offsets, inputs.ids, which)
    n = np.diff(offsets)
    np.add.at(grads["char"], ids, np.repeat(each[:, DIM:] / n[:, None], n, 0))
    return grads


def _highest(score: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Each text's first window of the highest score."""
    top = np.maximum.reduceat(score, np.searchsorted(owner, np.arange(owner[-1] + 1)))
    hit = np.flatnonzero(score == top[owner])
    return hit[np.unique(owner[hit], return_index=True)[1]]


def train(texts: list[bytes | None], labels: np.ndarray, seed: int = 11, passes: int = PASSES) -> Model:
    """Fits the network on texts and their labels (0 or 1).

    All vectors and weights begin at random. The first passes learn from windows drawn from each text; then a text's
    label is taken to be that of its most toxic window: each pass scores all windows and learns from the highest of
    each text."""
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, np.float64)
    x = Inputs.gathered(texts)
    doc = np.repeat(np.arange(len(texts)), x.sizes)
    pair = np.unique(x.seq.astype(np.int64) * max(1, len(texts)) + doc)
    words = x.words[np.bincount(pair // max(1, len(texts)), minlength=len(x.words)) >= LEAST]
    small = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
    p = {"word": small(len(words) + 1, DIM), "char": small(BUCKETS, DIM), "o": np.full(1, -1, np.float32)}
    p["word"][0] = 0
    for d in "fb":
        p |= {f"w{d}": small(2 * DIM, 3 * UNITS) * 4, f"u{d}": small(UNITS, 3 * UNITS) * 2, f"b{d}": np.zeros(3 * UNITS, np.float32), f"a{d}": small(UNITS), f"o{d}": small(UNITS) * 3}
    m = Model(words, p)
    if not len(texts) or not 0 < y.sum() < len(y):
        p["o"][:] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
        p["of"][:] = p["ob"][:] = 0
        return m
    ends = np.cumsum(x.sizes)
    groups = [0, *(np.flatnonzero(np.diff(ends // _WORDS)) + 1), len(texts)]
    clean = np.flatnonzero(y[doc] == 0)
    if not len(clean):
        clean = np.array([-1])
    mean, var, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for k in range(passes):
        begin, left, owner = [], [], []
        for lo, hi in zip(groups, groups[1:]):
            part = x.part(lo, hi)
            at, rest, who = part.starts()
            if k < DRAWN:
                count = np.bincount(who)
                some = np.unique((np.cumsum(count) - count)[:, None] + rng.integers(0, count[:, None], (len(count), DRAWS)))
                begin.append(at[some] + (ends - x.sizes)[lo])
                left.append(rest[some])
                owner.append(lo + who[some])
                continue
            score = m.logits(part)[0]
            best = _highest(score, who)
            # Of clean texts, the highest window that shares no word with the first is clean as well.
            score = np.where((np.abs(at - at[best][who]) >= WIDTH) & (y[lo + who] == 0), score, -np.inf)
            second = _highest(score, who)
            some = np.sort(np.concatenate([best, second[score[second] > -np.inf]]))
            begin.append(at[some] + (ends - x.sizes)[lo])
            left.append(rest[some])
            owner.append(lo + who[some])
        begin, left, owner = np.concatenate(begin), np.concatenate(left), np.concatenate(owner)
        chosen = np.arange(len(begin))
        for _ in range(max(STEPS, -(-len(chosen) // 128))):
            some = chosen[rng.integers(0, len(chosen), 128)]
            a = places(begin[some], left[some])
            # Windows of one clean word over and over are clean too.
            a = np.concatenate([a, np.repeat(clean[rng.integers(0, len(clean), 16)][:, None], WIDTH, 1)])
            g = _step(p, m, x, a, np.append(y[owner[some]], np.zeros(16)))
            step += 1
            rate = 0.02 * (1 - k / passes) + 0.001
            for name, v in g.items():
                v = np.clip(v, -1, 1)
                mean[name] += 0.1 * (v - mean[name])
                var[name] += 0.01 * (v * v - var[name])
                p[name] -= (rate * (mean[name] / (1 - 0.9**step)) / (np.sqrt(var[name] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return m


def _held_out(id_column) -> F.Column:
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """The model of the labelled rows whose crc32(id as text) mod 5 is not 0: of either label at most `sample` rows, by
    the least hash of their ids, of texts up to SAMPLE_BYTES. An id with several labels counts as toxic if one says so."""
    y = only(labels, id=id, y=label).where(F.col("y").isNotNull() & F.col("id").isNotNull() & ~_held_out(F.col("id")))
    y = y.groupBy("id").agg(F.max((F.col("y") > 0).cast("int")).alias("y"))
    h = F.xxhash64("id")
    d = only(docs, id=id, t=text).where(F.octet_length("t") <= SAMPLE_BYTES)
    ids = d.join(y, "id").select("id", "y", F.octet_length("t"))
    chosen = ids.where("y = 1").orderBy(h, "id").limit(sample).union(ids.where("y = 0").orderBy(h, "id").limit(sample)).select("id", "y").distinct()

    def fit(batches):
        got = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
        got.sort(key=lambda r: (r[0], r[1]))
        m = train([r[1] for r in got], np.array([r[2] for r in got]))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((m.words, m.p))], pa.binary())], ["model"])

    # 2 * sample ids at most, and their texts in one task, which is not the driver.
    rows = d.join(F.broadcast(chosen), "id").select("id", F.col("t").cast("binary").alias("t"), "y").repartition(1)
    made = rows.mapInArrow(fit, "model binary").first()
    return Model(*pickle.loads(made["model"])) if made else train([], np.zeros(0))


def scored(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs: the score of the most toxic of all overlapping windows
    of the whole text. Null and empty texts get the score of a window without words; repeated rows stay; a null id
    counts as the empty string for held_out. Without labels of both kinds all scores are the share of toxic ones."""
    model = fitted(docs, labels, sample, id, text, label)
    held = docs.sparkSession.sparkContext.broadcast((model.words, model.p))

    def run(batches):
        m = Model(*held.value)
        for b in batches:
            s = m.scores(b.column(1).to_pylist()) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    d = only(docs, doc_id=id, t=text).select("doc_id", F.col("t").cast("binary").alias("t"))
    out = d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, limit: float = 0.5) -> DataFrame:
    """docs without the rows whose score reaches the limit, in one pass and with nothing moved."""
    model = fitted(docs, labels, sample, id, text, label)
    held = docs.sparkSession.sparkContext.broadcast((model.words, model.p))
    at = docs.columns.index(text)

    def run(batches):
        m = Model(*held.value)
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(m.scores(b.column(at).cast(pa.binary()).to_pylist()) < limit))

    return docs.mapInArrow(run, docs.schema)
