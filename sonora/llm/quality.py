"""A quality classifier from trusted positives and unlabelled text: non-negative positive-unlabelled learning."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship_package
from .common import read, settled
from .textmodels import ROWS, gram_counts, in_fold, sampled, scored, unit

GRAMS = 512
#: Trusted documents that the classifier is fitted on, about: the bound of what is drawn from labelled rows.
POSITIVES = 3000
#: Unlabelled documents that are learnt from together, and rounds of averaging and steps of a round, for the prior's scorer and for the classifier.
BLOCK = 4096
PRIOR_ROUNDS, ROUNDS_OF_RISK, STEPS = 3, 8, 25
#: Features are summed over all documents as whole multiples of 1 / FIXED.
FIXED = 1 << 24
ALONE = re.compile(rb"(?<![^\s])[!-/:-@\[-`{-~]+(?![^\s])")
SYMBOLS = re.compile(rb"[#*$%&|<>!^~=_@{}\[\]\\+]")


def features(text: str) -> np.ndarray | None:
    """Hashed byte n-grams and measures of the whole text; an empty text has features too."""
    data = text.encode("utf-8", "replace")
    words = data.split()
    n, size = max(1, len(words)), max(1, len(data))
    lines = [x for x in data.split(b"\n") if x.strip()]
    upper = sum(map(str.isupper, text)) / max(1, len(text))
    same = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    own = [
        min(1.0, len(SYMBOLS.findall(data)) / n) ** 0.5,
        min(1.0, 4 * len(ALONE.findall(data)) / n),
        min(1.0, 2 * upper),
        same,
        len(set(words)) / n,
        min(2.0, sum(map(len, words)) / n / 8),
        np.log1p(len(words)) / 10,
        len(set(lines)) / max(1, len(lines)),
        min(1.0, 10 * sum(data.count(c) for c in b"0123456789") / size),
        float(len(words) < 5),
    ]
    grams = unit(gram_counts(np.frombuffer(data, np.uint8), GRAMS)) if data else np.zeros(GRAMS, np.float32)
    return np.concatenate([np.array(own, np.float32), grams])


@dataclass
class Model:
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    prior: float
    fitted: bool = True

    def margin(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x).astype(float), -30, 30)))


def _adam(gradient, size: int, rounds: int, rate: float = 0.05, start: np.ndarray | None = None) -> np.ndarray:
    w, m, v = np.zeros(size, np.float32) if start is None else start.astype(np.float32), np.zeros(size), np.zeros(size)
    for k in range(1, rounds + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = (w - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)).astype(np.float32)
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def prior_cuts(positive: np.ndarray) -> np.ndarray:
    return np.quantile(positive, np.linspace(0.0, 0.9, 91))


def class_prior(positive: np.ndarray, above: np.ndarray, n: int, confidence: float = 0.05) -> float:
    """Share of positives among n unlabelled rows, by the best bin of a classifier's scores; above: how many of them reach each of prior_cuts.

    Among the highest scores both samples hold positives alone, so the ratio of the shares above a
    threshold nears the prior from above; the smallest ratio, with an allowance for small bins, is taken.
    """
    above_p = np.array([(positive >= c).mean() for c in prior_cuts(positive)])
    above_u = above / n
    slack = np.sqrt(np.log(4 / confidence) / 2) * (1 / np.sqrt(len(positive)) + 1 / np.sqrt(n))
    best = int(((above_u + slack) / above_p).argmin())
    return float(np.clip(above_u[best] / above_p[best], 0.05, 0.98))


def pu_gradient(p: np.ndarray, u: np.ndarray, prior: float, decay: float = 1e-3) -> Callable[[np.ndarray], np.ndarray]:
    """Gradient of prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) under the logistic loss.

    Where the estimated negative risk falls below zero (over-fitting), the step goes the other way on it.
    """

    def gradient(w: np.ndarray) -> np.ndarray:
        zp, zu = p @ w, u @ w
        loss_neg = lambda z: np.logaddexp(0, z)
        as_positive = -p.T @ _sigmoid(-zp) / len(p)
        negative = u.T @ _sigmoid(zu) / len(u) - prior * (p.T @ _sigmoid(zp)) / len(p)
        risk = loss_neg(zu).mean() - prior * loss_neg(zp).mean()
        penalty = decay * np.append(w[:-1], 0)
        return (prior * as_positive + negative if risk >= 0 else -negative) + penalty

    return gradient


def against_gradient(p: np.ndarray, u: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Gradient of the logistic loss of positives against unlabelled rows."""
    return lambda w: -p.T @ _sigmoid(-(p @ w)) / len(p) + u.T @ _sigmoid(u @ w) / len(u) + 1e-2 * np.append(w[:-1], 0)


def non_negative_pu(p: np.ndarray, u: np.ndarray, prior: float, rounds: int = 300, decay: float = 1e-3) -> np.ndarray:
    """Linear weights of least non-negative unbiased risk (see pu_gradient)."""
    return _adam(pu_gradient(p, u, prior, decay), p.shape[1], rounds)


def scales(mean: np.ndarray, square: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations that features are standardised by; all n-grams together weigh like some measures."""
    own = len(mean) - GRAMS
    scale = np.sqrt(np.maximum(square - mean**2, 1e-6))
    scale[own:] = np.sqrt(max(1e-6, square[own:].mean() - mean[own:].mean() ** 2))
    scale[own:] *= np.sqrt(GRAMS) / 4
    return mean.astype(np.float32), scale.astype(np.float32)


def _stand(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.hstack([(x - mean) / scale, np.ones((len(x), 1), np.float32)])


def unfitted() -> Model:
    size = features("").shape[0]
    return Model(np.zeros(size + 1), np.zeros(size), np.ones(size), 0.5, False)


def fit_arrays(p: np.ndarray, u: np.ndarray, moments: tuple[np.ndarray, np.ndarray] | None = None) -> Model:
    """A model of trusted positives p and unlabelled u, all in one place; moments (means and mean squares of features) are u's if not given."""
    if not len(p) or not len(u):
        return unfitted()
    mean, scale = scales(*(moments or (u.mean(axis=0, dtype=float), np.square(u, dtype=float).mean(axis=0))))
    sp, su, prior = _stand(p, mean, scale), _stand(u, mean, scale), 0.5
    if len(sp) > 3 and len(su) > 3:  # positives against unlabelled on one half, to estimate the prior on the other
        w = _adam(against_gradient(sp[::2], su[::2]), sp.shape[1], 150)
        own = sp[1::2] @ w
        prior = class_prior(own, (su[1::2] @ w >= prior_cuts(own)[:, None]).sum(axis=1), len(su[1::2]))
    return Model(non_negative_pu(sp, su, prior), mean, scale, prior)


def packed(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The keep columns and _x: features of every row's whole text as packed half-precision numbers, made once and written to the shared folder (about a kilobyte a document)."""
    ship_package(docs.sparkSession)
    schema = docs.select(*keep).schema.add("_x", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py() or "").astype(np.float16).tobytes() for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.binary())], schema.names)

    return settled(docs.select(*keep, F.col(text).cast("string").alias("_text")).mapInArrow(run, schema))


def _matrices(batches: Iterator[pa.RecordBatch], made: bool, rows: int) -> Iterator[np.ndarray]:
    """Features of the rows of a task, up to `rows` at a time; made: they come packed, and not as texts."""
    held: list[np.ndarray] = []
    for batch in batches:
        for value in batch.column(0):
            held.append(np.frombuffer(value.as_py(), np.float16) if made else features(value.as_py()))
            if len(held) == rows:
                yield np.stack(held).astype(np.float32)
                held = []
    if held:
        yield np.stack(held).astype(np.float32)


def _added(rows: DataFrame) -> list[int]:
    """Sums by place of arrays of whole numbers, so that any order of tasks gives the same."""
    by_place = rows.select(F.posexplode("counts").alias("i", "n")).groupBy("i").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
    return [int(r["n"]) for r in by_place.orderBy("i").collect()]


def summed(docs: DataFrame, count: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, int]:
    """Sums of count(features of a block of rows), whole numbers, over all rows, and the number of rows. docs: packed features, or texts."""
    made = "_x" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = 0, 0
        for x in _matrices(batches, made, ROWS):
            sums, n = sums + count(x).astype(np.int64), n + len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([[n, *sums.tolist()]], pa.list_(pa.int64()))], ["counts"])

    ship_package(docs.sparkSession)
    sums = _added(docs.select("_x" if made else F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, "counts array<long>"))
    return np.array(sums[1:], float), sums[0]


def averaged(docs: DataFrame, gradient: Callable[[np.ndarray, np.ndarray], Callable], positive: np.ndarray, mean: np.ndarray, scale: np.ndarray, rounds: int) -> np.ndarray:
    """Weights learnt from all rows of packed features: in a round, every block of rows goes STEPS steps on from the common weights, on its own rows and the positives, and the weights of the blocks are averaged.

    Blocks have up to BLOCK rows, so memory and the shuffled sums don't follow the partitions; averages are of whole
    numbers, so that reruns agree.
    """
    sc, w = docs.sparkSession.sparkContext, np.zeros(positive.shape[1], np.float32)
    shared = sc.broadcast(positive)  # POSITIVES rows, about
    for k in range(rounds):
        now, rate = w, 0.05 / (1 + k / 2)

        def run(batches: Iterator[pa.RecordBatch], now=now, rate=rate) -> Iterator[pa.RecordBatch]:
            sums, n = 0, 0
            for x in _matrices(batches, True, BLOCK):
                own = _adam(gradient(shared.value, _stand(x, mean, scale)), len(now), STEPS, rate, now)
                sums, n = sums + np.rint(np.clip(own.astype(float), -1e3, 1e3) * (len(x) * FIXED)).astype(np.int64), n + len(x)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([[n, *sums.tolist()]], pa.list_(pa.int64()))], ["counts"])

        n, *sums = _added(docs.select("_x").mapInArrow(run, "counts array<long>"))
        w = (np.array([s / n for s in sums]) / FIXED).astype(np.float32)
    shared.unpersist()
    return w


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, seed: int = 5) -> Model:
    """docs: doc_id, and text or packed features (_x); labels: doc_id, quality. Fits on about `positives` documents of label 1,
    drawn by a hash of doc_id, and on all documents as the unlabelled ones; labels 0 are not used.
    Without a label 1 among the documents the model isn't fitted; where there is one, a fit without is an error.
    Features are made once. Over all documents go: their sums and squares, for means and scales; rounds of averaged
    steps of a scorer of positives against unlabelled, and a count of how many reach each of 91 of its scores, for the
    class prior; and rounds of averaged steps on the non-negative risk."""
    trusted = labels.filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id")
    trusted = trusted.join(docs.select("doc_id"), "doc_id", "left_semi")  # ids alone: only what is among the documents is drawn from
    n_trusted = trusted.count()
    if not n_trusted:
        return unfitted()
    docs = docs.select("doc_id", "_x") if "_x" in docs.columns else packed(docs, ["doc_id"])
    trusted = trusted.filter(sampled(F.col("doc_id"), seed, positives / n_trusted)).distinct()
    drawn = docs.join(F.broadcast(trusted), "doc_id").select(F.xxhash64(F.lit(seed), "doc_id").alias("_order"), "_x").collect()  # about `positives` rows
    if not drawn:
        raise RuntimeError("there are trusted positives, but none was drawn")
    p = np.stack([np.frombuffer(r["_x"], np.float16) for r in sorted(drawn, key=lambda r: (r["_order"], r["_x"]))]).astype(np.float32)
    both, n = summed(docs, lambda x: np.concatenate([np.rint(x * FIXED), np.rint(np.square(x) * FIXED)]).reshape(2, len(x), -1).sum(axis=1).ravel())
    mean, scale = scales(*(both / (n * FIXED)).reshape(2, -1))
    docs = docs.coalesce(max(1, n // BLOCK + 1))
    sp, prior = _stand(p, mean, scale), 0.5
    if len(sp) > 3 and n > 3:  # half of the positives teach the scorer, the other half measures it
        scorer = Model(averaged(docs, against_gradient, sp[::2], mean, scale, PRIOR_ROUNDS), mean, scale, prior)
        own = sp[1::2] @ scorer.weights
        cuts = prior_cuts(own)
        above, _ = summed(docs, lambda x: (scorer.margin(x) >= cuts[:, None]).sum(axis=1))
        prior = class_prior(own, above, n)
    return Model(averaged(docs, lambda a, u: pu_gradient(a, u, prior), sp, mean, scale, ROUNDS_OF_RISK), mean, scale, prior)


def fit_on_fold(docs: DataFrame, labels: DataFrame) -> Model:
    """Fitted on the documents that aren't held out; docs may have packed features."""
    kept = lambda df: df.filter(~in_fold(F.col("doc_id"), 4, 2) & F.col("doc_id").isNotNull())
    return fit(kept(docs.select("doc_id", "_x" if "_x" in docs.columns else "text")), kept(labels.select("doc_id", "quality")))


def rate(docs: DataFrame, model: Model, keep: list[str], text: str = "text", name: str = "score") -> DataFrame:
    """The keep columns and score (0 to 1) of every row by its whole text; `name` is its name, where a kept column has this.

    Null and empty texts score like an empty text; without training rows every score is 0.5. Repeated
    rows and null ids are scored like others; other columns are neither read nor returned.
    """
    empty = float(model.score(features("")[None, :])[0])
    return scored(docs, keep, text, features, lambda x: [model.score(x)], (empty,), [(name, "double", pa.float64())])


def rate_packed(rows: DataFrame, model: Model, keep: list[str], name: str = "score") -> DataFrame:
    """rate, of rows that come with packed features."""
    schema = rows.select(*keep).schema.add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = np.stack([np.frombuffer(v.as_py(), np.float16) for v in part.column(part.num_columns - 1)]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(model.score(x), pa.float64())], schema.names)

    return rows.select(*keep, "_x").mapInArrow(run, schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with its quality score; null and empty texts score like an empty text, and odd rows are treated as in rate."""
    docs = read(spark, sf_dir, "documents")
    rows = packed(docs.select("doc_id", in_fold(F.col("doc_id"), 4, 2).alias("held_out"), "text"), ["doc_id", "held_out"])
    out = rate_packed(rows, fit_on_fold(rows, read(spark, sf_dir, "labels")), ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).cast("int").alias("predicted"))
