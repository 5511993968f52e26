"""The prefix trie against a plain one, at every height of its rows, on long, odd, repeated and missing conversations."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from sqlcheck import connection, same

from sonora.llm import queries, trie

SCHEMA = "conv_id long, turn long, role string, text string, name string, depth int, row string, total int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """The contract by loops; rows: (conv_id, turn, role, text)."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(t)] for c, t in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        built[c] = turns.get(base, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    saved, leaves = {}, {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        saved[p] = own + sum(saved[k] for k in children[p])
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
    digest = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if len(built[c]) == len(p)).encode()).hexdigest()
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], digest(p)) for p, m in members.items()), key=str)


def found(spark, rows, leaf=trie.LEAF):
    df = spark.createDataFrame([(*r, "n", 1, "r", 2) for r in rows], SCHEMA).repartition(3)
    turns, ids = trie.rebuilt(trie.ordered_turns(df))
    out = trie.prefix_trie(turns, ids, leaf)
    assert out.columns == COLUMNS
    return sorted((tuple(r) for r in out.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    """Many shared beginnings; one conversation of 150 turns and a copy of it, copies, ties, nulls, negative ids, and families whose first is missing."""
    rng = random.Random(8)
    out = [(c, t, rng.choice("ua"), rng.choice(["", "é", "yes", "no"])) for c in range(60) if c % 15 != 10 for t in range(rng.randint(1, 9))]
    long = [("u" if t % 2 else "a", f"turn {t % 3}") for t in range(150)]
    out += [(c, t, *x) for c in (65, 70) for t, x in enumerate(long)]
    out += [(75, t, *x) for t, x in enumerate(long[:70])]
    out += [(c, t, "u", f"same {t}") for c in range(80, 100) for t in range(4)]
    out += [(c, None, None, None) for c in (101, 101, 102)] + [(103, 1, "u", None), (103, 1, None, "z"), (103, 1, "u", "b"), (103, None, "u", "late")]
    out += [(-c, t, "u", "neg") for c in (3, 5, 8) for t in range(5)] + [(None, 0, "u", "lost")]
    return out


@pytest.mark.parametrize("leaf", [1, 4, 16])
def test_trie_equals_a_plain_one(spark, rows, leaf):
    assert found(spark, rows, leaf) == plain(rows)


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    assert found(spark, []) == [] and found(spark, [(None, 1, "u", "x")]) == []
    without = [(c, 0, "u", "x") for c in range(1000, 1400) if c % 5 and zlib.crc32(str(c).encode()) % 9]  # no first of a family, one turn that is cut off
    assert found(spark, without) == plain(without)
    assert len(plain(without)) == 1 and plain(without)[0][3] == len(without)


def test_every_prefix_has_one_name():
    labels = [hashlib.sha256(str(i).encode()).digest() for i in range(16)]
    names = [trie.prefix_names(trie.ROOT, labels[:n], b"end" if n == 16 else None, 16) for n in range(1, 17)]
    assert all(x == names[-1][: len(x)] for x in names) and len(set(names[-1])) == 16
    other = trie.prefix_names(trie.ROOT, [*labels[:5], b"x", *labels[6:]], b"END", 16)
    assert other[:5] == names[-1][:5] and not set(other[5:]) & set(names[-1])


def test_digests_of_large_groups_are_cut_into_pieces(spark):
    ends = spark.range(5000).select(F.when(F.col("id") < 4000, F.lit(b"a")).otherwise(F.lit(b"b")).alias("name"), F.col("id").alias("conv_id"))
    got = {bytes(r["name"]): r["ends_sha256"] for r in trie.ends_digests(ends).collect()}
    want = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got == {b"a": want(range(4000)), b"b": want(range(4000, 5000))}


def test_trie_equals_sql(spark, sf_dir):
    same(queries.op13_trie(spark, sf_dir), connection(sf_dir), queries.ORACLES["op13_trie"])
