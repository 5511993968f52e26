"""Toxicity by a subsequence string kernel with Nystroem landmarks and a linear support vector machine over sentences."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship_package
from .common import read, settled
from .textmodels import ROWS, in_fold, sampled

#: Letters of a subsequence, letters that it may stretch over, and the weight of each letter stretched over.
LENGTH, STRETCH, DECAY = 3, 6, 0.7
#: Kernel values are raised to this power, and those below NEAR before that count as 0.
POWER, NEAR = 3, 0.45
#: Landmarks, and the least evidence (root of the likelihood ratio; chance among millions of words gives up to about 5) and documents of one.
LANDMARKS, EVIDENCE, LEAST_DOCS = 96, 5.0, 2
#: Letters of a word that are compared at once; longer words are compared in overlapping pieces, of so many letters and so far apart.
PIECE, CUT, STEP = 24, 8, 2
#: Labelled documents of each kind that the classifier is fitted on, about; the sample's bound.
TOXIC, CLEAN = 3000, 6000
#: Sentences of a labelled document that are learnt from.
TOP = 4
#: Letters of texts that are read together, and words that a task remembers.
TOGETHER, REMEMBERED = 1_000_000, 300_000
BITS = 20

#: Other white space becomes a space; ASCII signs are left out of words, so that "i.d-i*o_t" is one; sentences end at ". ", "! ", "? " and line feeds.
BLANK = bytes.maketrans(b"\t\r\x0b\x0c\x1c\x1d\x1e\x1f", b" " * 8)
WIDE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
#: Letters that stand alone, three or more in a row, are also taken together.
SPACED = re.compile(r" \w(?: +\w){2,}(?= )")
OFFSETS = [(a, b) for b in range(LENGTH - 1, STRETCH) for a in range(1, b)]
FIRST, LAST = ord("^"), ord("$")


def plain(text: str) -> str:
    """Lower-cased words, without ASCII signs, between spaces; sentences end at line feeds."""
    data = text.lower().encode("utf-8", "replace").translate(BLANK)
    for end in (b". ", b"! ", b"? ", b"\n"):
        data = data.replace(end, b" \n ")
    out = data.translate(None, SIGNS).decode()
    return f" {out if out.isascii() else WIDE.sub(' ', out)} "


def words_of(part: str) -> list[str]:
    """Words of a plain text or sentence; spaced out letters are also a word of their own."""
    return part.split() + ["".join(m.split()) for m in SPACED.findall(part)]


def pieces(word: str) -> list[str]:
    """The word between marks of its start and end; if it is longer than PIECE, in overlapping pieces of CUT letters, STEP apart, which cover it."""
    marked = f"^{word}$"
    if len(word) <= PIECE:
        return [marked]
    return [marked[max(0, min(at, len(marked) - CUT)) :][:CUT] for at in range(0, len(marked) - CUT + STEP, STEP)]


@cache
def weights_of(size: int) -> np.ndarray:
    """Weights of the subsequences of a string of so many letters, in the order of `subsequences`."""
    return np.concatenate([np.full(max(0, size - b), DECAY ** (b + 1), np.float32) for _, b in OFFSETS])


def subsequences(marked: list[str]) -> np.ndarray:
    """Hashes of the subsequences of LENGTH letters within STRETCH of every string; all strings are equally long."""
    size = len(marked[0])
    letters = np.array(marked, f"U{size}").view(np.uint32).reshape(len(marked), size)
    first, second, third = letters * np.uint32(0x9E3779B1), letters * np.uint32(0x85EBCA77), letters * np.uint32(0xC2B2AE3D)
    out = np.empty((len(marked), len(weights_of(size))), np.uint32)
    at = 0
    for a, b in OFFSETS:
        if size > b:
            np.add(first[:, : size - b], second[:, a : size - b + a], out=out[:, at : at + size - b])
            out[:, at : at + size - b] += third[:, b:]
            at += size - b
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x2C1B3C6D)
    return out >> np.uint32(32 - BITS)


def lengths(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Norms of the rows' feature vectors; a subsequence that occurs twice has the sum of its weights."""
    square = np.full(len(codes), np.square(weights, dtype=float).sum())
    order = np.argsort(codes, axis=1)
    for i in np.flatnonzero((np.diff(np.take_along_axis(codes, order, axis=1), axis=1) == 0).any(axis=1)):
        _, where = np.unique(codes[i], return_inverse=True)
        square[i] = np.square(np.bincount(where, weights)).sum()
    return np.sqrt(np.maximum(square, 1e-12))


class Kernel:
    """Normalised kernel values of words against the landmarks, to the power of POWER; those below NEAR are 0, and words without others are not near."""

    def __init__(self, landmarks: list[str]):
        found = []
        for k, word in enumerate(landmarks):
            codes, weights = subsequences([word]), weights_of(len(word))
            found.append((codes[0], np.full(codes.shape[1], k), weights / lengths(codes, weights)[0]))
        codes, owner, weights = map(np.concatenate, zip(*found, strict=True))
        known, place = np.unique(codes, return_inverse=True)
        self.table = np.zeros((len(known), len(landmarks)), np.float32)
        np.add.at(self.table, (place, owner), weights)
        self.place = np.full(1 << BITS, -1, np.int32)
        self.place[known] = np.arange(len(known))
        self.most = np.zeros(1 << BITS, np.float32)
        self.most[known] = self.table.max(axis=1)
        similar = np.argsort(landmarks)  # groups of landmarks that begin alike
        self.groups = np.stack([self.table[:, similar[at : at + 8]].max(axis=1) for at in range(0, len(landmarks), 8)], axis=1)
        self.groups = np.vstack([self.groups, np.zeros((1, self.groups.shape[1]), np.float32)])  # place -1

    def rows(self, marked: list[str]) -> np.ndarray:
        """Values of every string; strings of one length are taken together, some thousand at a time."""
        out = np.zeros((len(marked), self.table.shape[1]), np.float32)
        size = np.array([len(m) for m in marked])
        for n in np.unique(size):
            own = np.flatnonzero(size == n)
            for at in range(0, len(own), 4096):
                part = own[at : at + 4096]
                self._fill([marked[i] for i in part.tolist()], part, out)
        return out

    def _fill(self, marked: list[str], to: np.ndarray, out: np.ndarray) -> None:
        weights = weights_of(len(marked[0]))
        if not len(weights):
            return
        codes = subsequences(marked)
        # no value is above these: each subsequence counts for the landmark (of all, then of each group) that it fits best, and equal ones only lengthen the vector
        least = NEAR * np.sqrt(np.square(weights).sum())
        near = np.flatnonzero(self.most[codes] @ weights >= least)
        place = self.place[codes[near]]
        near = near[np.einsum("ijk,j->ik", self.groups[place], weights).max(axis=1, initial=0) >= least]
        if not len(near):
            return
        codes = codes[near]
        place = self.place[codes]
        row, column = np.nonzero(place >= 0)
        start = np.flatnonzero(np.diff(row, prepend=-1))
        value = np.add.reduceat(self.table[place[row, column]] * weights[column, None], start, axis=0)
        own = row[start]
        hit = value.max(axis=1) >= least
        value, own = value[hit], own[hit]
        value /= lengths(codes[own], weights)[:, None]
        value[value < NEAR] = 0
        out[to[near[own]]] = value**POWER


@dataclass
class Model:
    landmarks: list[str]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))  # of kernel values
    bias: float = 0.0
    curve: tuple[np.ndarray, np.ndarray] = (np.zeros(1), np.zeros(1))  # scores of decisions
    fitted: bool = True
    share: float = 0.5

    def score(self, decision: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(decision), self.share)
        return np.interp(decision, *self.curve)


class Reader:
    """Decisions about the sentences of whole texts. Kernel values of words are remembered within a task, up to REMEMBERED words."""

    def __init__(self, model: Model):
        self.model, self.kernel = model, Kernel(model.landmarks) if model.landmarks else None
        self.far: set[str] = set()
        self.near: dict[str, np.ndarray] = {}

    def learn(self, words: set[str]) -> None:
        """Kernel values of words that aren't remembered yet."""
        if len(self.far) + len(self.near) > REMEMBERED:
            self.far.clear()
            self.near.clear()
        new = list(words - self.far - self.near.keys())
        if not new:
            return
        cut = [pieces(w) for w in new]
        values = self.kernel.rows([p for x in cut for p in x])
        if len(values) > len(new):
            values = np.maximum.reduceat(values, np.cumsum([0, *map(len, cut[:-1])]), axis=0)
        hits = values.any(axis=1)
        self.far.update(w for w, hit in zip(new, hits.tolist(), strict=True) if not hit)
        self.near.update((new[i], values[i].copy()) for i in np.flatnonzero(hits).tolist())

    def sentences(self, texts: list[str]) -> Iterator[list[tuple[float, np.ndarray]]]:
        """For each text, decision and values of every sentence that has a word near a landmark: for each landmark, the largest of its words'."""
        group, size = [], 0
        for text in texts:
            group.append(plain(text))
            size += len(text)
            if size >= TOGETHER:
                yield from self._decided(group)
                group, size = [], 0
        yield from self._decided(group)

    def _decided(self, group: list[str]) -> Iterator[list[tuple[float, np.ndarray]]]:
        words = [set(words_of(text)) if self.kernel else set() for text in group]
        self.learn(set().union(*words))
        weights, bias = self.model.weights, self.model.bias
        for text, own in zip(group, words, strict=True):
            out = []
            for values in self._found(text, own & self.near.keys()):
                value = values[0] if len(values) == 1 else np.max(values, axis=0)
                out.append((float(value @ weights) + bias, value))
            yield out

    def _found(self, text: str, hits: set[str]) -> list[list[np.ndarray]]:
        """Values of the words near a landmark, by sentence; hits: those of the text, each of which is looked for."""
        if not hits:
            return []
        if SPACED.search(text):
            parts = [[self.near[w] for w in hits.intersection(words_of(s))] for s in text.split("\n")]
            return [p for p in parts if p]
        ends = list(accumulate(len(s) + 1 for s in text.split("\n")))
        out: dict[int, list[np.ndarray]] = {}
        for w in sorted(hits):
            value, looked, last = self.near[w], f" {w} ", -1
            at = text.find(looked)
            while at >= 0:
                if (sentence := bisect_right(ends, at)) != last:
                    out.setdefault(sentence, []).append(value)
                    last = sentence
                at = text.find(looked, at + 1)
        return list(out.values())

    def decisions(self, texts: list[str]) -> list[float]:
        """The largest of each text's sentences, and half of what the next largest has above 0; a text without a near word has the bias."""
        out = []
        for found in self.sentences(texts):
            top = sorted((d for d, _ in found), reverse=True)
            out.append(max([self.model.bias, *top[:1]]) + max([0.0, *top[1:2]]) / 2)
        return out


def top_sentences(sample: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Label and values of the TOP sentences of largest decision of every document of a bounded sample (doc_id, toxic, text), of those near a landmark."""
    m = len(model.landmarks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch in batches:
            for toxic, found in zip(batch.column(1).to_pylist(), reader.sentences([t or "" for t in batch.column(2).to_pylist()]), strict=True):
                top = sorted(found, key=lambda x: -x[0])[:TOP]
                yield pa.RecordBatch.from_arrays([pa.array([toxic] * len(top), pa.int32()), pa.array([v.astype(np.float16).tobytes() for _, v in top], pa.binary())], ["toxic", "packed"])

    rows = sorted((r["toxic"], bytes(r["packed"])) for r in sample.mapInArrow(run, "toxic int, packed binary").collect())
    values = np.frombuffer(b"".join(v for _, v in rows), np.float16).astype(np.float32).reshape(len(rows), m)
    return np.array([t for t, _ in rows]), values


def decisions(sample: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Label and decision of every document of a bounded sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(reader.decisions([t or "" for t in batch.column(2).to_pylist()]), pa.float64())], ["toxic", "decision"])

    rows = sorted((r["toxic"], r["decision"]) for r in sample.mapInArrow(run, "toxic int, decision double").collect())
    return np.array([t for t, _ in rows]), np.array([d for _, d in rows])


def associated(sample: DataFrame, count: int = LANDMARKS) -> tuple[list[str], np.ndarray]:
    """Words (^word$) and beginnings of four to six letters (^begin) that most set toxic documents apart, and their evidence: the root of the likelihood ratio of document counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for toxic, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = {w for w in words_of(plain(text or "")) if len(w) <= PIECE}
                found = [f"^{w}$" for w in words] + list({f"^{w[:k]}" for w in words for k in (4, 5, 6) if len(w) > k})
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([toxic] * len(found), pa.int32())], ["word", "toxic"])

    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    counts = sample.mapInArrow(run, "word string, toxic int").groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).filter(F.col("a") >= LEAST_DOCS)
    a, b, both = F.col("a"), F.col("b"), n[0] + n[1]
    due, rest = (a + b) * (n[1] / both), (a + b) * (n[0] / both)
    z = F.when(a > due, F.sqrt(2 * (a * F.log(a / due) + F.when(b > 0, b * F.log(b / rest)).otherwise(0.0)))).otherwise(0.0)
    rows = counts.select("word", z.alias("z")).filter(F.col("z") >= EVIDENCE).orderBy(F.desc("z"), "word").limit(count).collect()
    return [r["word"] for r in rows], np.array([r["z"] for r in rows])


def machine(x: np.ndarray, y: np.ndarray, c: float = 1e5) -> np.ndarray:
    """Weights (the last is the bias, not shrunk) of least squared hinge loss, both classes weighing the same, by Newton steps; y is -1 or 1."""
    x = np.hstack([x, np.ones((len(x), 1))])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    shrink = np.append(np.full(x.shape[1] - 1, 1 / c), 1e-9)
    loss = lambda w: (shrink * w * w).sum() / 2 + (share * np.maximum(0, 1 - y * (x @ w)) ** 2).sum()
    w = np.zeros(x.shape[1])
    for _ in range(100):
        slack = np.maximum(0, 1 - y * (x @ w))
        gradient = shrink * w - 2 * x.T @ (share * y * slack)
        within = slack > 0
        step = np.linalg.solve(np.diag(shrink) + 2 * (x[within] * share[within, None]).T @ x[within], gradient)
        rate, now = 1.0, loss(w)
        while rate > 1e-4 and loss(w - rate * step) > now - 1e-4 * rate * float(gradient @ step):
            rate /= 2
        w = w - rate * step
        if now - loss(w) <= 1e-10 * now:
            break
    return w


def calibrated(decision: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points (decision, share of toxic documents) of a rising curve: neighbouring decisions are pooled while the share falls."""
    points, where = np.unique(decision, return_inverse=True)
    ones, every, middle = [], [], []
    for d, a, n in zip(points, np.bincount(where, weight * toxic), np.bincount(where, weight), strict=True):
        ones.append(a)
        every.append(n)
        middle.append(d * n)
        while len(ones) > 1 and ones[-2] * every[-1] >= ones[-1] * every[-2]:
            for column in (ones, every, middle):
                column[-2:] = [column[-2] + column[-1]]
    ones, every, middle = map(np.array, (ones, every, middle))
    return middle / every, np.maximum.accumulate((ones + 0.5) / (every + 1))


def fit(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN, landmarks: int = LANDMARKS, seed: int = 9) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic. Fitted on about `toxic` and `clean` labelled documents, drawn by a hash of doc_id.

    Landmarks are the words and beginnings that most set toxic documents apart. The
    sentences of a document that look most toxic carry its label, up to TOP of those that have a word near a
    landmark: first by the landmarks' evidence, then by the machine fitted so far. Squared-hinge weights are fitted
    on their Nystroem features, and a rising curve turns a document's largest decision into a score. With labels of one kind only, or none, nothing is fitted.
    """
    ship_package(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    marked = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marked = settled(marked.join(docs.select("doc_id"), "doc_id", "left_semi"))
    n = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return Model([], fitted=False, share=1.0 if 1 in n else 0.0 if 0 in n else 0.5)
    drawn = marked.filter(F.when(F.col("toxic") == 1, sampled(F.col("doc_id"), seed, toxic / n[1])).otherwise(sampled(F.col("doc_id"), seed, clean / n[0])))
    sample = settled(docs.join(F.broadcast(drawn), "doc_id").select("doc_id", "toxic", F.col("text").cast("string").alias("text")))  # about toxic + clean ids
    words, evidence = associated(sample, landmarks) if sample.groupBy("toxic").count().count() == 2 else ([], np.zeros(0))
    model = Model(words, evidence.astype(float))
    if words:
        own = Kernel(words).rows(words)
        values, vectors = np.linalg.eigh((own + own.T).astype(float) / 2)
        root = vectors / np.sqrt(np.maximum(values, 0) + 1e-3) @ vectors.T  # of the landmarks' kernel matrix, damped
        for _ in range(2):
            kind, found = top_sentences(sample, model)
            x = np.vstack([found, np.zeros((1, len(words)), np.float32)])  # and a clean sentence without a near word
            y = np.append(np.where(kind == 1, 1, -1), -1).astype(np.float32)
            if not (y > 0).any():
                break
            w = machine(x @ root, y)
            model = Model(words, (root @ w[:-1]).astype(float), float(w[-1]))
    kind, decision = decisions(sample, model)
    if len(set(kind.tolist())) < 2:
        raise RuntimeError("there are labels of both kinds, but only one was drawn")
    weight = np.where(kind == 1, n[1] / (kind == 1).sum(), n[0] / (kind == 0).sum())
    model.curve = calibrated(decision, kind, weight)
    return model


def fit_on_fold(docs: DataFrame, labels: DataFrame) -> Model:
    kept = lambda df: df.filter(~in_fold(F.col("doc_id"), 3, 1) & F.col("doc_id").isNotNull())
    return fit(kept(docs.select("doc_id", "text")), kept(labels.select("doc_id", "toxic")))


def rated(docs: DataFrame, model: Model, keep: list[str], text: str = "text", name: str = "score") -> DataFrame:
    """The keep columns and score (0 to 1) of every row by its whole text: that of its worst sentence.

    Null and empty texts have no sentence and score like a text without a word near a landmark. Repeated rows
    and null ids are scored like others; other columns are neither read nor returned. Long texts are read to
    their end, and long words in overlapping pieces.
    """
    ship_package(docs.sparkSession)
    schema = docs.select(*keep).schema.add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                decision = np.array(reader.decisions([x.as_py() or "" for x in part.column(part.num_columns - 1)]), float)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(model.score(decision), pa.float64())], schema.names)

    return docs.select(*keep, F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with its toxicity score; odd rows are treated as in rated."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_on_fold(docs, read(spark, sf_dir, "labels"))
    out = rated(docs.select("doc_id", in_fold(F.col("doc_id"), 3, 1).alias("held_out"), "text"), model, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).cast("int").alias("predicted"))
