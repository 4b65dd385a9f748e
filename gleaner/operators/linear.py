"""Linear models of sparse rows by accelerated proximal gradients: each step is one pass over the rows, of which the driver
sees a sum. Losses and penalties of one family, with class weights and a start from a model that is there already."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import checkpointed

#: Loss and penalty of the solvers by number; a dual solver has its primal's solution.
SOLVERS = {0: ("logistic", "l2"), 1: ("squared_hinge", "l2"), 2: ("squared_hinge", "l2"), 3: ("hinge", "l2"), 4: ("crammer", "l2"), 5: ("squared_hinge", "l1"), 6: ("logistic", "l1"), 7: ("logistic", "l2")}
#: Numbers of a gradient that travel in one row; width of what rounds off the corners of hinges, and the losses' greatest curvature.
CHUNK, ROUND = 1 << 14, 0.1
CURVE = {"logistic": 0.25, "squared_hinge": 2.0, "hinge": 1 / ROUND, "crammer": 1 / ROUND, "regression": 1 / ROUND, "square": 1.0}


def rows(df: DataFrame, size: int = 1 << 16, tokens: str = "tokens", label: str = "label", keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep.., label double, ids array<int>): a text as the hashed numbers of its tokens, which count as often as they stand there."""
    ids = F.transform(F.coalesce(F.col(tokens), F.array().cast("array<string>")), lambda t: F.pmod(F.xxhash64(t), F.lit(size)).cast("int"))
    return df.select(*keep, F.col(label).cast("double").alias("label"), ids.alias("ids"))


def _values(w: np.ndarray, ids: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(z (classes, rows), owner of each id, ids, scale of each row): rows have length about one, and the last weight is a bias."""
    count = np.asarray(ids.value_lengths().fill_null(0), np.int64)
    flat, owner = np.asarray(ids.flatten(), np.int64), np.repeat(np.arange(len(count)), count)
    scale = 1 / np.sqrt(np.maximum(count, 1))
    z = np.stack([np.bincount(owner, v[flat], len(count)) * scale + v[-1] for v in w])
    return z, owner, flat, scale


def loss(kind: str, z: np.ndarray, y: np.ndarray, margin: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Loss of each row and its slope in z; y is 1 or -1, a class's number (crammer) or a number (regression)."""
    if kind == "crammer":
        own, k = z[y, np.arange(len(y))], np.arange(len(z))[:, None] != y
        a = (z - own + k) / ROUND
        top = a.max(0)
        e = np.exp(a - top)
        d = e / e.sum(0)
        d[y, np.arange(len(y))] -= 1
        return ROUND * (top + np.log(e.sum(0))), d
    v = z[0]
    if kind == "square":
        return v * v / 2, v[None]
    if kind == "regression":
        over = np.abs(v - y) - margin
        return np.where(over > ROUND, over - ROUND / 2, np.maximum(over, 0) ** 2 / (2 * ROUND)), (np.sign(v - y) * np.clip(over / ROUND, 0, 1))[None]
    m = y * v
    if kind == "logistic":
        return np.logaddexp(0, -m), (-y / (1 + np.exp(np.clip(m, -500, 500))))[None]
    if kind == "squared_hinge":
        return np.maximum(0, 1 - m) ** 2, (-2 * y * np.maximum(0, 1 - m))[None]
    if kind == "hinge":
        return np.where(m < 1 - ROUND, 1 - m - ROUND / 2, np.maximum(0, 1 - m) ** 2 / (2 * ROUND)), (-y * np.clip((1 - m) / ROUND, 0, 1))[None]
    raise ValueError(kind)


def chosen_rows(corpus: DataFrame, known: DataFrame) -> DataFrame:
    """corpus (doc_id, label, text), known (tok, id from 1) -> (doc_id, label double, ids array<int>): the known words of each
    text, as often as they stand there; texts without any stay. Words meet their numbers in one join."""
    from . import terms as M

    found = M.tokens(corpus.select("doc_id", "text")).join(known.select("tok", (F.col("id") - 1).cast("int").alias("i")), "tok")
    lists = found.groupBy("doc_id").agg(F.collect_list("i").alias("ids"))
    none = F.array().cast("array<int>")
    return corpus.join(lists, "doc_id", "left").select("doc_id", F.col("label").cast("double").alias("label"), F.coalesce("ids", none).alias("ids"))


def by_chi(corpus: DataFrame, ratio: float = 0.4, least: int = 2) -> DataFrame:
    """(tok, id): the share `ratio` of the words of `least` documents or more, by chi-square over all labels, numbered from 1."""
    from . import terms as M

    counts = checkpointed(M.class_counts(corpus.where("label is not null")))
    common = counts.groupBy("tok").agg(F.sum("a").alias("df")).where(F.col("df") >= least).select("tok")
    best = M.top_ratio(M.chi_full(counts.join(common, "tok", "left_semi")), ratio)
    return checkpointed(M.numbered(best, F.col("chi").desc(), "tok", name="id").select("tok", "id"))


class Linear:
    """w (classes or 1, size + 1), classes: labels by number (of two, the second is the positive one); None for numbers."""

    def __init__(self, w: np.ndarray, classes: list[float] | None):
        self.w, self.classes = w, classes

    def scored(self, df: DataFrame) -> DataFrame:
        """df (with ids) with raw array<double> and prediction."""
        w, classes, at = self.w, self.classes, df.columns.index("ids")

        def run(batches):
            for b in batches:
                z = _values(w, b.column(at))[0]
                p = z[0] if classes is None else np.array(classes)[z.argmax(0) if len(w) > 1 else (z[0] >= 0).astype(int)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(z.T)), pa.array(p.astype(np.float64))], [*b.schema.names, "raw", "prediction"])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        return df.mapInArrow(run, f"{kinds}, raw array<double>, prediction double")


def _pass(data: DataFrame, w: np.ndarray, kind: str, classes: list | None, weights: dict, margin: float) -> np.ndarray:
    """Sum over all rows of the gradients of their losses, of w's shape: partial sums by task meet by stretches."""
    shape = w.shape

    def run(batches):
        g = np.zeros(shape)
        for b in batches:
            label = b.column(0).to_numpy()
            z, owner, flat, scale = _values(w, b.column(1))
            place = None if classes is None else np.searchsorted(np.array(classes), label)
            y = label if classes is None else place if kind == "crammer" else 2.0 * place - 1
            d = loss(kind, z, y, margin)[1] * np.array([weights.get(x, 1.0) for x in label.tolist()])
            for k in range(shape[0]):
                g[k, :-1] += np.bincount(flat, (d[k] * scale)[owner], shape[1] - 1)
                g[k, -1] += d[k].sum()
        parts = np.array_split(g.ravel(), -(-g.size // CHUNK))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["part", "g"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py()) for x in table.column("g"))
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "g": pa.array([total.tobytes()], pa.binary())})

    got = data.mapInArrow(run, "part int, g binary").groupBy("part").applyInArrow(add, "part int, g binary").collect()
    return np.concatenate([np.frombuffer(r["g"]) for r in sorted(got, key=lambda r: r["part"])]).reshape(shape) if got else np.zeros(shape)


def fit(data: DataFrame, kind: str = "logistic", penalty: str = "l2", c: float = 1.0, size: int = 1 << 16, steps: int = 30, weights: dict | None = None, start: Linear | None = None, margin: float = 0.1) -> Linear:
    """Least of c * (sum of losses) + the penalty (half the square, or the sum of magnitudes) of the weights, over data (label,
    ids); the bias goes free. Labels are two classes, any number of them (crammer) or numbers (regression). With a
    start, further steps from it: a model can go on learning from new rows. `weights` weigh classes' rows. Without any
    rows all predictions are 0."""
    data = checkpointed(data.where("label is not null").select("label", "ids"))
    n = data.count()
    classes = None if kind == "regression" else start.classes if start else sorted(r[0] for r in data.select("label").distinct().collect())
    if classes is not None and kind != "crammer" and len(classes) > 2:
        raise ValueError("two classes, or crammer for more")
    shape = (max(1, len(classes)) if kind == "crammer" else 1, size + 1)
    w = start.w.copy() if start else np.zeros(shape)
    if not n:
        return Linear(w, classes or None)
    weights = weights or {}
    run = lambda v, k: _pass(data, v, k, classes, weights, margin) / n
    # The greatest curvature, by a few steps of the power method.
    v = np.random.default_rng(1).normal(size=(1, size + 1))
    for _ in range(4):
        v = _pass(data, v / np.linalg.norm(v), "square", None, weights, margin) / n
    top = CURVE[kind] * 1.5 * np.linalg.norm(v)
    lam = 1 / (c * n)
    rate = 1 / (top + (lam if penalty == "l2" else 0))
    u, before, t = w.copy(), w.copy(), 1.0
    for _ in range(steps):
        g = run(u, kind)
        if penalty == "l2":
            g[:, :-1] += lam * u[:, :-1]
        w = u - rate * g
        if penalty == "l1":
            w[:, :-1] = np.sign(w[:, :-1]) * np.maximum(np.abs(w[:, :-1]) - rate * lam, 0)
        again = ((u - w) * (w - before)).sum() > 0  # steps that turn back lose their momentum
        t, last = 1.0 if again else (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        u, before = (w.copy() if again else w + (last - 1) / t * (w - before)), w
    return Linear(w, classes)


def solved(data: DataFrame, solver: int, **options) -> Linear:
    """fit() by a solver's number."""
    kind, penalty = SOLVERS[solver]
    return fit(data, kind, penalty, **options)
