"""Vector codes: Orchard's search against a plain one, codebooks against a plain loop, SQL, and awkward rows."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from sqlcheck import connection, same

from sonora.llm import codes, queries

SCHEMA = "vec_id long, embedding array<double>, label int, code string, x int, n long, error string"


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    """{row number: (vec_id, code, error, label_error)} and the digest, by loops; rows: (vec_id, vector, label)."""
    kept = [(i, v, [math.floor(scale * c) for c in x], label) for i, (v, x, label) in enumerate(rows) if x is not None and len(x) and all(c is not None and math.isfinite(c) for c in x)]
    width = len(kept[0][2]) // parts
    cut = lambda x, p: x[p * width : (p + 1) * width]
    first = {}
    for _, v, x, _ in sorted((k for k in kept if k[1] is not None), key=lambda k: (k[1], k[2])):
        first.setdefault(v, x)
    books = [[cut(first[v], p) for v in sorted(first)[:entries]] for p in range(parts)]
    squared = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b, strict=True))
    nearest = lambda x, p: min((squared(x, e), j) for j, e in enumerate(books[p]))
    for _ in range(rounds):
        put = {}
        for _, _, x, _ in kept:
            for p in range(parts):
                put.setdefault((p, nearest(cut(x, p), p)[1]), []).append(cut(x, p))
        for (p, j), own in put.items():
            books[p][j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out, sums = {}, {}
    for i, v, x, label in kept:
        found = [nearest(cut(x, p), p) for p in range(parts)]
        out[i] = (v, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found), label)
        sums[label] = sums.get(label, 0) + out[i][2]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((v, code, error, sums[label]) for v, code, error, label in out.values()), key=str), digest


def test_orchard_finds_the_nearest_and_the_lowest_of_ties():
    rng = np.random.default_rng(4)
    for spread in (3, 50, 100_000):  # the first has many ties and equal entries
        x, book = rng.integers(-spread, spread, (400, 3)), rng.integers(-spread, spread, (23, 3))
        distance = np.square(x[:, None] - book[None]).sum(axis=2)
        best, near = codes.orchard(x, book)
        assert (best == distance.argmin(axis=1)).all() and (near == distance.min(axis=1)).all()


def test_orchard_skips_most_entries_of_parted_clusters():
    """The walk must end early: counted by the entries that a subclass of the arrays is asked for."""
    rng = np.random.default_rng(5)
    centres = rng.integers(-(10**6), 10**6, (64, 2))
    x = np.repeat(centres, 20, axis=0) + rng.integers(-50, 50, (1280, 2))
    met = 0

    class Counting(np.ndarray):
        def __getitem__(self, key):
            nonlocal met
            if self.ndim == 2 and isinstance(key, np.ndarray):
                met += len(key)
            return super().__getitem__(key)

    codes.orchard(x, centres.view(Counting))
    assert met < 0.3 * len(x) * len(centres)


@pytest.mark.parametrize("parts,entries,width", [(8, 16, 2), (2, 5, 3)])
def test_codes_equal_plain_loops(spark, parts, entries, width):
    rng = np.random.default_rng(6)
    rows = [(int(i) if i % 17 else None, rng.normal(0, 1, parts * width).round(2).tolist(), int(i % 4) if i % 5 else None) for i in range(120)]
    rows += [rows[3], rows[3], (3, rng.normal(0, 1, parts * width).tolist(), 1)]  # repeated rows, and an id with another vector
    rows += [(500, None, 1), (501, [], 1), (502, [None] + [0.0] * (parts * width - 1), 1), (503, [math.nan] + [0.0] * (parts * width - 1), 1), (504, [math.inf] + [0.0] * (parts * width - 1), 1), (505, [1.0, 2.0], 1)]
    df = spark.createDataFrame([(*r, "c", 1, 2, "e") for r in rows], SCHEMA).repartition(3)
    out = codes.compressed(df, parts=parts, entries=entries).collect()
    want, digest = plain(rows[:-1], parts, entries)
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in out), key=str) == want
    assert {r["codebooks_sha256"] for r in out} == {digest}


def test_codes_of_few_odd_and_no_vectors(spark):
    df = lambda rows: spark.createDataFrame([(*r, "c", 1, 2, "e") for r in rows], SCHEMA)
    assert codes.compressed(df([])).collect() == []
    assert codes.compressed(df([(None, [1.0] * 8, 1)])).collect() == []
    one = codes.compressed(df([(7, [1.0] * 8, None), (None, [1.5] * 8, None)])).collect()
    assert {(r["vec_id"], r["code"]) for r in one} == {(7, "00" * 8), (None, "00" * 8)}
    assert codes.compressed(df([(1, [0.5] * 10, 1)])).first()["error"] == 0  # no multiple of 8: zeros are added
    assert codes.compressed(df([(1, [1e300] * 8, 1)])).first()["error"] == 0  # held within the largest


def test_a_pass_shuffles_sums_alone(spark, sf_dir):
    kept = codes.kept_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", "label")
    books = codes.first_books(kept)
    assert books.shape[:2] == (8, 16)
    rows = codes.encoded(kept, books)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert rows.agg(F.sum("error")).first()[0] > codes.encoded(kept, codes.trained(kept, books)).agg(F.sum("error")).first()[0]


def test_codes_equal_sql(spark, sf_dir):
    same(queries.op11_codes(spark, sf_dir), connection(sf_dir), queries.ORACLES["op11_codes"])
