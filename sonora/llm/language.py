"""Language identification in two steps: the language family, then linear support vector machines between pairs of its languages."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .textmodels import gram_counts, in_fold, linear_svm, sample_features, sampled, scored, unit

DIMS = 4096
#: Documents of each language that the models are fitted on, about, and of all languages together; the sample's bounds.
PER_LANGUAGE, DOCUMENTS = 800, 16_000
#: Languages that the training rows may name; more means that `lang` doesn't hold language codes, and is an error.
LANGUAGES = 1000
UNDETERMINED = "und"
#: Families of language codes. A code that isn't here stands in a family with the others that aren't.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af yi lb fy",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg",
    "indic": "hi bn mr ne gu pa ur si",
    "turkic": "tr az kk uz ky tk tt",
    "uralic": "fi et hu",
    "semitic": "ar he mt am",
    "sinitic": "zh yue wuu",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


@dataclass
class Model:
    families: list[str]
    family_weights: np.ndarray
    languages: dict[str, list[str]]
    pairs: dict[tuple[str, str], np.ndarray]


#: Every byte but letters (and what UTF-8 needs for other alphabets) reads as a space.
_LETTERS = np.array([b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)


def features(text: str) -> np.ndarray | None:
    """Hashed byte n-grams of the whole lower-cased text; None without a letter (of any alphabet: numerals such as \u00bd or \u2167 are none)."""
    if not any(map(str.isalpha, text)):
        return None
    return unit(gram_counts(_LETTERS[np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)], DIMS))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, seed: int = 6) -> Model:
    """Fits on about per_language documents of each language (fewer where DOCUMENTS divided by the languages is less), drawn by a hash of their id."""
    counts = {r["lang"]: r["n"] for r in docs.filter(F.col(lang).isNotNull()).groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n")).limit(LANGUAGES + 1).collect()}
    if not counts:
        return Model([], np.zeros((0, DIMS + 1), np.float32), {}, {})
    if len(counts) > LANGUAGES:
        raise ValueError(f"over {LANGUAGES} languages")
    per_language, drawn = max(8, min(per_language, DOCUMENTS // len(counts))), None
    for name, n in counts.items():
        this = F.when(F.col(lang) == name, sampled(F.col(doc_id), seed, per_language / n))
        drawn = this if drawn is None else F.coalesce(drawn, this)
    labels, x = sample_features(docs.filter(F.coalesce(drawn, F.lit(False))).select(F.xxhash64(F.lit(seed), F.col(doc_id)).alias("_order"), F.col(lang).alias("label"), F.col(text).alias("text")), features)
    y = np.array(labels)
    family = np.array([FAMILY_OF.get(v, "other") for v in labels])
    families = sorted(set(family))
    weights = [linear_svm(x, np.where(family == f, 1, -1).astype(x.dtype)) for f in families] if len(families) > 1 else [np.zeros(DIMS + 1, np.float32) for _ in families]
    languages = {f: sorted(set(y[family == f])) for f in families}
    pairs = {}
    for names in languages.values():
        for a, b in combinations(names, 2):
            both = (y == a) | (y == b)
            pairs[a, b] = linear_svm(x[both], np.where(y[both] == a, 1, -1).astype(x.dtype))
    return Model(families, np.stack(weights) if weights else np.zeros((0, DIMS + 1), np.float32), languages, pairs)


def classify(model: Model, x: np.ndarray) -> list[np.ndarray]:
    """Language and confidence of each row: the family of largest margin, then the language that wins most pairs (ties: larger sum of margins)."""
    squash = lambda m: 1 / (1 + np.exp(-np.clip(4 * m, -30, 30)))
    n = len(x)
    out, score = np.full(n, UNDETERMINED, object), np.zeros(n)
    if not model.families:
        return [out, score]
    margins = x @ model.family_weights[:, :-1].T + model.family_weights[:, -1]
    chosen = margins.argmax(axis=1)
    sure = squash(margins[np.arange(n), chosen]) if len(model.families) > 1 else np.ones(n)
    for f, family in enumerate(model.families):
        rows = np.flatnonzero(chosen == f)
        names = model.languages[family]
        if not len(rows) or not names:
            continue
        wins, total, least = np.zeros((len(rows), len(names))), np.zeros((len(rows), len(names))), np.full((len(rows), len(names)), np.inf)
        for i, j in combinations(range(len(names)), 2):
            w = model.pairs[names[i], names[j]]
            m = x[rows] @ w[:-1] + w[-1]
            for k, own in ((i, m), (j, -m)):
                wins[:, k] += own > 0
                total[:, k] += own
                least[:, k] = np.minimum(least[:, k], own)
        best = (wins + 0.5 / len(names) * np.tanh(total)).argmax(axis=1)
        out[rows] = np.array(names, object)[best]
        score[rows] = sure[rows] * (squash(least[np.arange(len(rows)), best]) if len(names) > 1 else 1)
    return [out, score]


def identify(docs: DataFrame, model: Model, keep: list[str], text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The keep columns, lang_pred and score (0 to 1) of every row by its whole text; `names` are theirs, where kept columns have these.

    A null text or one without a letter is `und` with score 0; without training rows all are. Repeated
    rows and null ids are scored like others; other columns are neither read nor returned.
    """
    return scored(docs, keep, text, features, lambda x: classify(model, x), (UNDETERMINED, 0.0), [(names[0], "string", pa.string()), (names[1], "double", pa.float64())])


def fit_on_fold(docs: DataFrame) -> Model:
    return fit(docs.filter(~in_fold(F.col("doc_id"), 3, 1) & F.col("doc_id").isNotNull()))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with its language; a null text or one without a letter is `und`, and odd rows are treated as in identify."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify(docs.select("doc_id", in_fold(F.col("doc_id"), 3, 1).alias("held_out"), "text"), fit_on_fold(docs), ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score")
