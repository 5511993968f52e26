"""Near duplicates among pages of one template: alike but not linked, some linked, against brute force at every block size."""

from __future__ import annotations

import numpy as np
import pytest

from sonora.llm import neardup


def pages(n, words=60, own=2, seed=1):
    """Texts of one template with some words of their own; every tenth has a twin that differs by a word, and one large group is linked."""
    rng = np.random.default_rng(seed)
    base = [f"t{i}" for i in range(words)]
    rows = []
    for i in range(n):
        text = list(base)
        for at in rng.choice(words, own, replace=False):
            text[at] = f"o{i}x{at}"
        rows.append((2 * i + 1, " ".join(text)))
        if i % 10 == 0:
            rows.append((10_000 - i, " ".join([*text[:-1], f"z{i}"])))
    rows += [(20_000 + i, " ".join([*base, f"e{i}"])) for i in range(n // 4)]
    return rows


def brute(rows, percent=85):
    sets = {i: set(neardup.shingles(t).tolist()) for i, t in rows}
    up = {i: i for i in sets}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("block", [1024, 40, 7])
def test_template_families_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK_DOCS", block)
    rows = pages(200)
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == brute(rows)


def test_links_share_an_early_shingle(spark):
    """Every linked pair of crowded classes meets in a band of rare shingles in which one of both is first."""
    rows = pages(120)
    sets = spark.createDataFrame([(i, bytearray(neardup.shingles(t).tobytes())) for i, t in rows], "cid long, items binary")
    crowded = spark.createDataFrame([(i, i, len(neardup.shingles(t))) for i, t in rows], "cid long, root long, n long")
    bands = {}
    for r in neardup.by_rare_shingles(sets, crowded, 85).collect():
        bands.setdefault(r["band"], {})[r["cid"]] = r["first"]
    meet = {(a, b) for own in bands.values() for a in own for b in own if a < b and (own[a] or own[b])}
    found = {i: set(neardup.shingles(t).tolist()) for i, t in rows}
    linked = {(a, b) for a in found for b in found if a < b and 100 * len(found[a] & found[b]) >= 85 * len(found[a] | found[b])}
    assert linked and linked <= meet


def test_common_counts_intersections():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint64)) for _ in range(30)]
    left, right = np.arange(12), np.arange(12, 30)
    want = np.array([[len(np.intersect1d(sets[a], sets[b])) for b in right] for a in left])
    for columns in (4096, 7):
        neardup.COLUMNS, before = columns, neardup.COLUMNS
        assert (neardup.common(sets, left, right) == want).all()
        neardup.COLUMNS = before
    assert (neardup.common([sets[0]], np.arange(1), np.arange(1)) == 0).all()
