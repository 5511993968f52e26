"""The string kernel against a plain one, the machine against small steps, held-out labels, gapped insults, and awkward rows."""

from __future__ import annotations

import itertools
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonora.llm import queries, toxicity
from sonora.llm.common import read

DOCS = "doc_id long, text string, lang string, score double, label string, toxic int, n_chars long"


def plain_kernel(a, b):
    """Normalised, from all subsequences written out."""

    def features(s):
        out = defaultdict(float)
        for places in itertools.combinations(range(len(s)), toxicity.LENGTH):
            stretch = places[-1] - places[0] + 1
            if stretch <= toxicity.STRETCH:
                out["".join(s[i] for i in places)] += toxicity.DECAY**stretch
        return out

    x, y = features(a), features(b)
    dot = lambda p, q: sum(v * q.get(k, 0) for k, v in p.items())
    return dot(x, y) / math.sqrt(max(dot(x, x), 1e-12) * max(dot(y, y), 1e-12))


def test_kernel_equals_a_plain_one():
    rng = random.Random(3)
    landmarks = ["^idiot$", "^stup", "^réeuxa", "^aaaa$", "^worthless$"]
    words = ["".join(rng.choice("abidotsu") for _ in range(rng.randint(1, 12))) for _ in range(300)]
    words += ["idiot", "idxiot", "stupid", "réeuxaux", "aaaaaaaa", "worthlessness", "a", "é"]
    marked = [f"^{w}$" for w in words]
    got = toxicity.Kernel(landmarks).rows(marked)
    for w, row in zip(marked, got, strict=True):
        want = np.array([plain_kernel(w, x) for x in landmarks])
        want = np.where(want < toxicity.NEAR, 0, want**toxicity.POWER)
        close = np.abs(want - row) < 1e-4
        edge = [abs(plain_kernel(w, x) - toxicity.NEAR) < 1e-4 for x in landmarks]
        assert (close | np.array(edge)).all(), (w, want, row)


def test_long_words_are_read_to_their_end():
    reader = toxicity.Reader(toxicity.Model(["^idiot$"], np.ones(1)))
    filler = "".join(random.Random(1).choice("bcdefghjklmn") for _ in range(5000))
    assert reader.decisions([filler + "idiot", filler])[0] > 0 == reader.decisions([filler])[0]
    cut = toxicity.pieces(filler)
    assert "".join(p[: toxicity.STEP] for p in cut[:-1]) + cut[-1] in (f"^{filler}$", f"^{filler}"[: toxicity.STEP * (len(cut) - 1)] + cut[-1]) and cut[-1].endswith("$")


def test_words_close_gaps():
    words = lambda text: toxicity.words_of(toxicity.plain(text))
    assert words("You I.D-i*o_t!") == ["you", "idiot"]
    assert words("a b\tc dd e") == ["a", "b", "c", "dd", "e", "abc"]
    assert words("a b. c d") == ["a", "b", "c", "d"]  # letters of two sentences aren't joined
    assert words(" *** ") == []


def test_sentences_hold_the_words_that_they_hold():
    """Words found by place against words read sentence by sentence."""
    rng = random.Random(6)
    reader = toxicity.Reader(toxicity.Model(["^idiot$", "^moron$"], np.array([1.0, 0.5])))
    words = ["idiot", "moron", "idiots", "a", "b", "fine", "idiot's", "mo.ron", "été", "\u00a0", "\t", "c d e"]
    for _ in range(200):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", ". ", "! ", "\n", "\u3000", "  "]) for _ in range(rng.randint(0, 25)))
        got = sorted(round(d, 6) for d, _ in next(reader.sentences([text])))
        want = []
        for sentence in toxicity.plain(text).split("\n"):
            own = [reader.near[w] for w in toxicity.words_of(sentence) if w in reader.near]
            if own:
                want.append(round(float(np.max(own, axis=0) @ reader.model.weights), 6))
        assert got == sorted(want)


def test_machine_finds_the_least_loss():
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (200, 4))
    y = np.where(x[:, 0] + 0.5 * rng.normal(0, 1, 200) > 0.4, 1.0, -1.0)
    w = toxicity.machine(x, y, c=5.0)
    z = np.hstack([x, np.ones((200, 1))])
    share = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
    shrink = np.array([0.2] * 4 + [1e-9])
    v = np.zeros(5)
    for _ in range(20_000):
        v -= 0.1 * (shrink * v - 2 * z.T @ (share * y * np.maximum(0, 1 - y * (z @ v))))
    assert np.abs(w - v).max() < 1e-5


def test_curve_rises_and_pools():
    d, share = toxicity.calibrated(np.array([0.0, 0, 1, 2, 3, 3]), np.array([0, 0, 1, 0, 1, 1]), np.ones(6))
    assert np.allclose(d, [0, 1.5, 3]) and np.allclose(share, [0.5 / 3, 1.5 / 3, 2.5 / 3])


@pytest.fixture(scope="module")
def planted(spark):
    """Documents of made-up words; toxic ones hold an insult, some held-out ones in a disguise."""
    rng = random.Random(12)
    syllables = ["ta", "ren", "o", "li", "mes", "ku", "sto", "id", "pi", "lo", "ser", "or"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    insults = ["idiot", "stupid", "moronic"]
    rows, labels, disguised = [], [], []
    for i in range(1500):
        held = zlib.crc32(str(i).encode()) % 3 == 1
        text = [[word() for _ in range(rng.randint(4, 12))] for _ in range(rng.randint(1, 6))]
        toxic = i % 4 == 0
        if toxic:
            insult = rng.choice(insults)
            if held and i % 8 == 0:
                at = rng.randint(1, len(insult) - 1)
                insult = rng.choice([".".join(insult), " ".join(insult), insult[:at] + "*" + insult[at:], insult[:at] + insult[at - 1] + insult[at:]])
                disguised.append(i)
            rng.choice(text).insert(1, insult)
        rows.append((i, ". ".join(" ".join(s).capitalize() for s in text) + ".", "en", 1.0, "l", 5, 3))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, DOCS).repartition(4), spark.createDataFrame(labels, "doc_id long, toxic int"), set(disguised)


def test_gapped_and_inserted_letters_are_caught(spark, planted):
    docs, labels, disguised = planted
    model = toxicity.fit_on_fold(docs, labels)
    again = toxicity.fit_on_fold(docs.repartition(3), labels)
    assert model.landmarks == again.landmarks and np.allclose(model.weights, again.weights)
    out = {r["doc_id"]: r["_s"] for r in toxicity.rated(docs, model, ["doc_id"], name="_s").collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [i for i in out if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((out[i] >= 0.7) == (truth[i] == 1) for i in held) > 0.97 * len(held)
    caught = [i for i in disguised if out[i] >= 0.5]
    assert len(disguised) > 30 and len(caught) > 0.85 * len(disguised)
    assert not [i for i in held if not truth[i] and out[i] >= 0.7]


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    out = queries.op12_toxicity(spark, sf)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    seen = out.join(read(spark, sf, "labels"), "doc_id").join(read(spark, sf, "documents").select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (seen["predicted"] == seen["toxic"]).mean() > 0.94
    english = seen[seen["lang"] == "en"]
    assert english[english["toxic"] == 1]["predicted"].mean() > 0.85 and english[english["toxic"] == 0]["predicted"].mean() < 0.01


def test_odd_rows_and_labels(spark, planted):
    docs, labels, _ = planted
    model = toxicity.fit_on_fold(docs, labels)
    odd = spark.createDataFrame([(1, None, None, None, None, None, None), (None, "", "en", 1.0, "x", 1, 1), (2, " \n", "en", 1.0, "x", 1, 1), (3, "idiot " * 30_000, "en", 1.0, "x", 1, 1), (3, "idiot", "en", 1.0, "x", 1, 1), (3, "idiot", "en", 1.0, "x", 1, 1)], DOCS)
    out = toxicity.rated(odd, model, odd.columns, name="s")
    assert out.columns == [*odd.columns, "s"]
    got = sorted((r["doc_id"] or 0, r["s"]) for r in out.collect())
    assert len(got) == 6 and len({s for i, s in got if i in (0, 1, 2)}) == 1 and len({s for i, s in got if i == 3}) == 1
    assert got[-1][1] > 0.7 > got[0][1]
    assert toxicity.rated(odd.limit(0), model, ["doc_id"]).collect() == []
    none = toxicity.fit(docs.limit(0), labels)
    assert not none.fitted and {r["score"] for r in toxicity.rated(odd, none, ["doc_id"]).collect()} == {0.5}
    one_kind = toxicity.fit(docs, labels.filter("toxic = 0").unionByName(spark.createDataFrame([(None, 1), (5, None)], "doc_id long, toxic int")))
    assert {r["score"] for r in toxicity.rated(odd, one_kind, ["doc_id"]).collect()} == {0.0}
    plain = toxicity.fit(docs.withColumn("text", F.lit("same words")), labels)  # nothing tells the kinds apart
    assert plain.fitted and not plain.landmarks and len({round(r["score"], 6) for r in toxicity.rated(odd, plain, ["doc_id"]).collect()}) == 1
