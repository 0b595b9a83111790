"""Quality classifier by co-training: a text view and a metadata view teach each other.

Text view: hashed word shapes and words of the whole text, with a few figures of its layout.
Metadata view: the other columns of the row (source, language, number of characters), never the text.

Each view is a logistic regression. In each round a view, calibrated on held-out labelled rows, hands
the HANDED pool rows of each class it is surest of to the other view as pseudo-labels, each weighed by
what the view knows beyond the class' share: a view that knows nothing teaches nothing. At the end both views are calibrated
anew (Platt scaling), their log odds beyond the base rate are added, and every document is scored.

Fitting sees a bounded sample: at most LABELLED labelled rows and POOL unlabelled rows, in the order
of a hash, as vectors of WIDTH numbers; both bounds are parameters. Their ids are the only rows
broadcast. Scoring is one pass over all whole texts, with models of a few KB.

Edge cases: a null text or null metadata is a value of its own. Without labels of both classes every
score is the base rate (0.5 without any label). Documents that repeat are each scored, but fitted on
once; labels that repeat for a document count once each, conflicting ones too. Empty tables give empty results.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELLED, POOL, ROUNDS = 4000, 4000, 5
SHAPES, WORDS, FIGURES, META = 512, 512, 8, 256
WIDTH = SHAPES + WORDS + FIGURES
#: A view hands on so many pool rows of each class in a round, its surest ones, if they gain at least so much on the class' share.
LEAST_GAIN, HANDED = 0.02, 200
#: How strongly calibration is held to the view's own odds.
PULL = 0.1
KEEP_FROM = 0.5
REMEMBERED = 300_000

_RUNS = (re.compile(r"[^\W\d_]+"), re.compile(r"\d+"))


def _shape(word: str) -> str:
    def letters(m: re.Match) -> str:
        x = m[0]
        return "X" if x.isupper() and len(x) > 1 else "Aa" if x[0].isupper() else "aa"

    return _RUNS[1].sub("0", _RUNS[0].sub(letters, word))


class TextView:
    """Whole texts to vectors; remembers a bounded number of words."""

    def __init__(self):
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.shape: list[int] = []
        self.word: list[int] = []
        self.arrays = (np.zeros(0, np.int32), np.zeros(0, np.int32))

    def _learn(self, words: list[str]) -> np.ndarray:
        if len(self.index) > REMEMBERED:
            self.reset()
        index = self.index
        if new := [w for w in dict.fromkeys(words) if w not in index]:
            for w in new:
                index[w] = len(index)
                self.shape.append(zlib.crc32(_shape(w).encode("utf-8", "replace")) % SHAPES)
                self.word.append(zlib.crc32(w.lower().encode("utf-8", "replace")) % WORDS)
            self.arrays = (self.arrays[0], self.arrays[1])
        return np.fromiter(map(index.__getitem__, words), np.int32, len(words))

    def vector(self, text: str | None) -> np.ndarray:
        out = np.zeros(WIDTH, np.float32)
        words = (text or "").split()
        n = len(words)
        if n:
            i = self._learn(words)
            if len(self.arrays[0]) < len(self.shape):
                grow = 1.0 if len(self.shape) < 4096 else 1.25
                size = int(len(self.shape) * grow)
                a, b = np.zeros(size, np.int32), np.zeros(size, np.int32)
                a[: len(self.shape)], b[: len(self.word)] = self.shape, self.word
                self.arrays, self.filled = (a, b), len(self.shape)
            elif self.filled < len(self.shape):
                self.arrays[0][self.filled : len(self.shape)] = self.shape[self.filled :]
                self.arrays[1][self.filled : len(self.word)] = self.word[self.filled :]
                self.filled = len(self.shape)
            out[:SHAPES] = np.sqrt(np.bincount(self.arrays[0][i], minlength=SHAPES) / n)
            out[SHAPES : SHAPES + WORDS] = np.bincount(self.arrays[1][i], minlength=WORDS) / n
            lines = [x for x in text.split("\n") if x.strip()]
            kinds = len(np.unique(i))
            out[SHAPES + WORDS :] = [
                math.log1p(n) / 8,
                kinds / n,
                float((i[1:] == i[:-1]).mean()) if n > 1 else 0.0,
                1 - len(set(lines)) / len(lines) if lines else 0.0,
                min(sum(map(len, words)) / n / 10, 3.0),
                min(n / max(len(lines), 1) / 100, 3.0),
                float(n < 20),
                float(n < 50),
            ]
        else:
            out[-1] = out[-2] = 1.0
        return out


def meta_vector(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    out = np.zeros(META, np.float32)
    size = "none" if n_chars is None else str(int(math.log2(max(n_chars, 1)) * 2))
    for kind, value in (("source", source), ("lang", lang), ("size", size)):
        out[zlib.crc32(f"{kind}={value}".encode("utf-8", "replace")) % META] += 1
    return out


class Logistic:
    """L2-regularised logistic regression by accelerated gradient steps, with Platt scaling."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 150, decay: float = 1e-4):
        x = x.astype(np.float32)
        self.mean, self.scale = x.mean(0), x.std(0) + 0.02
        z = (x - self.mean) / self.scale
        weight = (weight / weight.sum()).astype(np.float32)
        step = 1.0 / (0.25 * float((weight[:, None] * z * z).sum()) / 8 + decay + 0.25)
        w, b, last, t = np.zeros(z.shape[1], np.float32), 0.0, np.zeros(z.shape[1], np.float32), 1.0
        for _ in range(steps):
            t_next = (1 + math.sqrt(1 + 4 * t * t)) / 2
            look = w + (t - 1) / t_next * (w - last)
            error = (1 / (1 + np.exp(-np.clip(z @ look + b, -30, 30))) - y) * weight
            last, w, t = w, look - step * (z.T @ error + decay * look), t_next
            b -= step * float(error.sum())
        self.w, self.b, self.a, self.c = w, b, 1.0, 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.w + self.b, -30, 30)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling on rows that the fit didn't see: damped Newton steps, with a weak pull to a = 1, c = 0."""
        s = self.raw(x).astype(np.float64)
        # targets kept off 0 and 1, as Platt proposed
        t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))

        def loss(a: float, c: float) -> float:
            z = a * s + c
            return float((np.logaddexp(0, z) - t * z).sum() + PULL / 2 * ((a - 1) ** 2 + c**2))

        a, c, now = 1.0, 0.0, loss(1.0, 0.0)
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(a * s + c, -30, 30)))
            v = p * (1 - p)
            g = np.array([((p - t) * s).sum() + PULL * (a - 1), (p - t).sum() + PULL * c])
            h = np.array([[(v * s * s).sum() + PULL, (v * s).sum()], [(v * s).sum(), v.sum() + PULL]])
            d, step = np.linalg.solve(h, g), 1.0
            while step > 1e-6 and (new := loss(max(a - step * d[0], 0.0), c - step * d[1])) > now - 1e-4 * step * float(g @ d):
                step /= 2
            if step <= 1e-6:
                break
            a, c, now = max(a - step * d[0], 0.0), c - step * d[1], new
        self.a, self.c = float(a), float(c)

    def odds(self, x: np.ndarray) -> np.ndarray:
        return self.a * self.raw(x) + self.c


class CoTrained:
    """Both views after the last round; without labels of both classes only the base rate."""

    def __init__(self, text: Logistic | None, meta: Logistic | None, base: float):
        self.text, self.meta, self.base = text, meta, base

    def scores(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """Columns: text view, metadata view, both."""
        if self.text is None:
            return np.full((len(text), 3), self.base)
        prior = math.log(self.base / (1 - self.base))
        a, b = self.text.odds(text), self.meta.odds(meta)
        return 1 / (1 + np.exp(-np.clip(np.stack([a, b, a + b - prior], 1), -30, 30)))


def co_train(x: list[np.ndarray], y: np.ndarray, pool: list[np.ndarray], rounds: int = ROUNDS) -> CoTrained:
    """x, pool: matrices of the text and the metadata view; y: 0 or 1 for the rows of x."""
    if len(y) < 8 or y.min() == y.max():
        return CoTrained(None, None, float(y.mean()) if len(y) else 0.5)
    held = np.arange(len(y)) % 4 == 3
    if y[held].min() == y[held].max() or y[~held].min() == y[~held].max():
        held = np.zeros(len(y), bool)
    fit, check = ~held, held if held.any() else ~held
    base = float(np.clip(y.mean(), 0.01, 0.99))
    own = [(v[fit], y[fit].astype(np.float32), np.ones(int(fit.sum()), np.float32)) for v in x]
    free = np.ones(len(pool[0]), bool)
    views: list[Logistic] = []
    for turn in range(rounds + 1):
        views = []
        for j in range(2):
            view = Logistic(*own[j])
            view.calibrate(x[j][check], y[check])
            views.append(view)
        if turn == rounds or not free.any():
            break
        for j in range(2):
            p = 1 / (1 + np.exp(-np.clip(views[j].odds(pool[j]), -30, 30)))
            for label, sure, share in ((1.0, p, base), (0.0, 1 - p, 1 - base)):
                # the surest rows of each class go over, each for as much as the view says beyond the class' share
                gain = np.clip((sure - share) / (1 - share), 0.0, 1.0)
                at = np.flatnonzero(free & (gain > LEAST_GAIN))
                at = at[np.argsort(-gain[at], kind="stable")][:HANDED]
                free[at] = False
                a, b, w = own[1 - j]
                own[1 - j] = (np.concatenate([a, pool[1 - j][at]]), np.concatenate([b, np.full(len(at), label, np.float32)]), np.concatenate([w, (0.5 * gain[at]).astype(np.float32)]))
    return CoTrained(views[0], views[1], base)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    view = TextView()
    for batch in batches:
        d = batch.to_pydict()
        t = [view.vector(x).tobytes() for x in d["text"]]
        m = [meta_vector(*x).tobytes() for x in zip(d["source"], d["lang"], d["n_chars"], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(t, pa.binary()), pa.array(m, pa.binary())], ["doc_id", "quality", "t", "m"])


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL, rounds: int = ROUNDS) -> CoTrained:
    order = F.xxhash64(F.col("doc_id"), F.lit(11))
    own = labels.where("doc_id is not null and quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality"), order.alias("o")).orderBy("o", "doc_id", "quality").limit(labelled)
    rest = docs.where("doc_id is not null").select("doc_id", F.lit(None).cast("int").alias("quality"), order.alias("o")).orderBy("o", "doc_id").limit(pool)
    picked = own.unionByName(rest).drop("o")
    # both sides of the union end in a limit, so what is broadcast is bounded by the parameters
    rows = docs.select("doc_id", "text", "source", "lang", "n_chars").join(F.broadcast(picked), "doc_id")
    # of rows that share a doc_id and a label, the one with the least vectors stands for all: at most as many as were picked
    least = F.min(F.struct("t", "m")).alias("v")
    found = rows.mapInArrow(_vectors, "doc_id bigint, quality int, t binary, m binary").groupBy("doc_id", "quality").agg(least).select("doc_id", "quality", "v.t", "v.m").collect()
    known = {r["doc_id"] for r in found if r["quality"] is not None}
    a = sorted((r for r in found if r["quality"] is not None), key=lambda r: (r["doc_id"], r["quality"]))
    b = sorted((r for r in found if r["quality"] is None and r["doc_id"] not in known), key=lambda r: r["doc_id"])
    matrix = lambda rows, k, width: np.frombuffer(b"".join(bytes(r[k]) for r in rows), np.float32).reshape(-1, width)
    return co_train([matrix(a, "t", WIDTH), matrix(a, "m", META)], np.array([r["quality"] for r in a]), [matrix(b, "t", WIDTH), matrix(b, "m", META)], rounds)


def quality_scores(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """One row for each row of docs: doc_id, text_score, meta_score, score (0 to 1), kept."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 512)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("bigint").alias("n_chars"))
    model = spark.sparkContext.broadcast(fit(docs, labels))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, view = model.value, TextView()
        for batch in batches:
            if not batch.num_rows:
                continue
            d = batch.to_pydict()
            t = np.stack([view.vector(x) for x in d["text"]])
            m = np.stack([meta_vector(*x) for x in zip(d["source"], d["lang"], d["n_chars"], strict=True)])
            p = own.scores(t, m)
            columns = [pa.array(p[:, j].astype(float), pa.float64()) for j in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, pa.array(p[:, 2] >= keep_from, pa.bool_())], ["doc_id", "text_score", "meta_score", "score", "kept"])

    return docs.mapInArrow(score, "doc_id bigint, text_score double, meta_score double, score double, kept boolean")
