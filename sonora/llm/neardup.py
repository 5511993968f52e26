"""Near-duplicate documents by SetSketch registers: banded candidates, joint likelihood estimates, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..runtime import ship_package
from .common import files, read, settled
from .components import components

SHINGLE = 5
#: Registers, base and rate of the sketch; registers fit 16 bits for any set size.
REGISTERS, BASE, RATE = 256, 1.001, 20.0
#: Registers in a band. A pair of similarity s shares one of the 32 bands with probability 1 - (1 - s**8)**32: over 0.9999 at 0.85.
BAND = 8
#: Estimates this far below the threshold are still verified: over four standard errors of 256 registers.
SLACK = 0.1
#: Documents and shingles in a block of a band; larger ones are compared block by block.
BLOCK_DOCS, BLOCK_SHINGLES = 1024, 1_000_000
#: Rows of a few numbers that a class with its bands is as wide as.
WIDTH = 16
#: Numbers of blocks of one kind lie below this.
KIND = 1 << 24
#: Shingles whose indicator columns a product takes at once.
COLUMNS = 4096
#: Classes whose keys are broadcast at most, to read their texts (about 100 bytes each).
BROADCAST_MEMBERS = 1_000_000

_GOLDEN, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """64-bit hashes of the set of SHINGLE-word shingles, sorted; A-Z are lower-cased, words end at ASCII white space, fewer words are one shingle."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(SHINGLE, len(w))
    h = w[: len(w) - k + 1].copy()
    for i in range(1, k):
        h = h * _STEP + w[i : len(w) - k + 1 + i]
    return np.unique(_mixed(h + np.uint64(k)))


def registers(items: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of hashes.

    Every item owns a Poisson process of rate RATE * REGISTERS whose points fall on registers at random, so
    a register's least point is exponential with rate RATE; register = 1 - log_BASE(least point), cut to
    whole numbers. Registers of a union are the larger of both. Points are drawn in order from a counter,
    and only until they pass the largest least point so far.
    """
    least = np.full(REGISTERS, np.inf)
    item, at, drawn = items, np.zeros(len(items)), 0
    while len(item):
        k = int(min(4096, max(1, -(-REGISTERS * 8 // len(item)))))
        counter = np.arange(drawn + 1, drawn + k + 1, dtype=np.uint64) * _GOLDEN
        bits = _mixed(item[:, None] + counter[None, :])
        times = at[:, None] + np.cumsum(-np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53), axis=1) / (RATE * REGISTERS)
        np.minimum.at(least, (bits & np.uint64(REGISTERS - 1)).astype(np.intp).ravel(), times.ravel())
        drawn += k
        going = times[:, -1] < least.max()
        item, at = item[going], times[going, -1]
    return np.clip(np.floor(1 - np.log(least) / np.log(BASE)), 0, 65535).astype(np.uint16)


def estimate(equal: np.ndarray, greater: np.ndarray, less: np.ndarray, n_own: int, n_other: np.ndarray) -> np.ndarray:
    """Similarity of greatest joint likelihood, given how many registers are equal, greater and less and both set sizes.

    A register of one set is greater with probability p(u - v J), where u and v are the sets' shares of
    n_own + n_other and p(x) = -log_BASE(1 - x (BASE - 1) / BASE). J is searched on a grid of steps of 0.01.
    """
    grid = np.linspace(0.4, 1.0, 61)
    u = (n_own / (n_own + n_other))[:, None]
    v = 1 - u
    top = np.minimum(u / v, v / u)
    j = np.minimum(grid[None, :], top)
    p = lambda x: -np.log1p(-np.maximum(x, 1e-12) * (BASE - 1) / BASE) / np.log(BASE)
    more, fewer = p(u - v * j), p(v - u * j)
    same = np.maximum(1 - more - fewer, 1e-12)
    fit = equal[:, None] * np.log(same) + greater[:, None] * np.log(np.maximum(more, 1e-12)) + less[:, None] * np.log(np.maximum(fewer, 1e-12))
    return j[np.arange(len(j)), fit.argmax(axis=1)]


def sketched(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_key, n_shingles, sig (a 128-bit digest of the set; null if empty), bands (a hash of each band)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sigs, bands = [], [], []
            for value in batch.column(2):
                s = shingles(value.as_py())
                sizes.append(len(s))
                if not len(s):
                    sigs.append(None)
                    bands.append(None)
                    continue
                sigs.append(xxhash.xxh3_128_digest(s.tobytes()))
                r = registers(s).reshape(-1, BAND)
                bands.append(np.array([xxhash.xxh3_64_intdigest(row.tobytes(), seed=i) for i, row in enumerate(r)], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "text_key", "n_shingles", "sig", "bands"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_key(F.col(text)).alias("text_key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_key binary, n_shingles long, sig binary, bands array<long>")


def text_key(text):
    return F.unhex(F.md5(text.cast("string")))


class _Sets:
    """Union-find over the rows of a task."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, a: int) -> int:
        while self.up[a] != a:
            self.up[a] = self.up[self.up[a]]
            a = self.up[a]
        return a


class _Members:
    """Shingle sets and registers of a task's rows, and whether two of them meet the threshold."""

    def __init__(self, rows: pd.DataFrame, percent: int):
        self.sets, self.percent = [np.frombuffer(x, np.uint64) for x in rows["items"]], percent
        self.size = np.array([len(s) for s in self.sets])
        self.sketches = np.stack([np.frombuffer(x, np.uint16) for x in rows["registers"]])

    def likely(self, a: int, others: np.ndarray) -> np.ndarray:
        """Those of the others that may be linked with a by size and registers, the likeliest first."""
        size = self.size[others]
        others = others[100 * np.minimum(size, self.size[a]) >= self.percent * np.maximum(size, self.size[a])]
        if not len(others):
            return others
        own, their, threshold = self.sketches[a][None, :], self.sketches[others], self.percent / 100
        equal = (own == their).sum(axis=1)
        near = equal >= REGISTERS * (threshold - 0.25)
        others, their, equal = others[near], their[near], equal[near]
        if not len(others):
            return others
        greater = (own > their).sum(axis=1)
        guess = estimate(equal, greater, REGISTERS - equal - greater, self.size[a], self.size[others])
        order = np.argsort(-guess, kind="stable")
        return others[order[guess[order] >= threshold - SLACK]]

    def linked(self, a: int, b: int) -> bool:
        x, y = self.sets[a], self.sets[b]  # sorted
        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
        both = int(np.count_nonzero(y[at] == x))
        return 100 * both >= self.percent * (self.size[a] + self.size[b] - both)


def _with_centre(percent: int):
    def verify(rows: pd.DataFrame) -> pd.DataFrame:
        """Which rows are linked with the centre."""
        rows = rows.reset_index(drop=True)
        found = _Members(rows, percent)
        cid = rows["cid"].to_numpy()
        at = int(np.flatnonzero(cid == rows["centre"].iloc[0])[0])
        hits = [int(b) for b in found.likely(at, np.flatnonzero(np.arange(len(rows)) != at)) if found.linked(at, int(b))]
        return pd.DataFrame({"u": cid[hits], "v": np.full(len(hits), cid[at])})

    return verify


def common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets of the left with sets of the right, by products of indicator columns, COLUMNS at a time; what stands in one set alone has none."""
    _, where, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[where]
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[column >= 0]
    column = column[column >= 0]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    out = np.zeros((len(left), len(right)), np.float32)
    n = int(column[-1]) + 1 if len(column) else 0
    for first in range(0, n, COLUMNS):
        low, high = np.searchsorted(column, [first, first + COLUMNS])
        part = np.zeros((len(sets), min(COLUMNS, n - first)), np.float32)
        part[row[low:high], column[low:high] - first] = 1
        out += part[left] @ part[right].T
    return out.astype(np.int64)


def _among(percent: int):
    def verify(rows: pd.DataFrame) -> pd.DataFrame:
        """Links between the groups of a block, or of two blocks, as a spanning forest of the groups."""
        i, j = int(rows["i"].iloc[0]), int(rows["j"].iloc[0])
        rows = rows.sort_values("cid").reset_index(drop=True)
        sets, block = [np.frombuffer(x, np.uint64) for x in rows["items"]], rows["block"].to_numpy()
        names, own = np.unique(rows["root"].to_numpy(), return_inverse=True)
        left, right = (np.flatnonzero(block == k) for k in (i, j))
        if not len(left) or not len(right):
            return pd.DataFrame({"u": [], "v": []}, dtype=np.int64)
        both, size = common(sets, left, right), np.array([len(s) for s in sets])
        linked = (100 * both >= percent * (size[left][:, None] + size[right][None, :] - both)) & (own[left][:, None] != own[right][None, :])
        a, b = np.nonzero(linked)
        pairs = np.unique(np.sort(np.stack([own[left[a]], own[right[b]]], axis=1), axis=1), axis=0)
        groups, edges = _Sets(len(names)), []
        for x, y in pairs.tolist():
            p, q = groups.find(x), groups.find(y)
            if p != q:
                groups.up[p] = q
                edges.append((names[x], names[y]))
        return pd.DataFrame(edges, columns=["u", "v"], dtype=np.int64)

    return verify


def by_rare_shingles(sets: DataFrame, crowded: DataFrame, percent: int) -> DataFrame:
    """band, cid, root, first: classes of crowded bands (cid, root, n) dealt anew by their rarest shingles, so that linked ones meet.

    Each class's shingles are taken in one order, the rarest among these classes first. Of two linked sets the
    first shingle that they share stands so early in both that overlap can still be reached: within n - t n + 1
    of the larger and n - 2 t / (1 + t) n + 1 of the smaller one (first is true there), t being the threshold. So
    no link is lost, and rows that aren't first needn't meet, while what a template gives to all of its texts stands late and brings none together.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cid, root, n, items in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([x] * n, pa.int64()) for x in (cid, root, n)] + [pa.array(np.frombuffer(items, np.int64))], ["cid", "root", "n", "item"])

    items = settled(crowded.join(sets.select("cid", "items"), "cid").select("cid", "root", "n", "items").mapInArrow(spread, "cid long, root long, n long, item long"))
    times = items.groupBy("item").agg(F.count("*").alias("times")).filter("times > 1")  # what stands in one set alone comes first in it, and links none
    own = W.Window.partitionBy("cid")
    place = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("times", "item"))
    ordered = items.join(times, "item").withColumn("place", place)
    reach = lambda part, whole: F.col("n") - F.expr(f"({part} * n + {whole - 1}) div {whole}") + 1
    early = ordered.filter(F.col("place") <= reach(percent, 100)).withColumn("first", F.col("place") <= reach(2 * percent, 100 + percent))
    early = settled(early.select("item", "cid", "root", "first"))
    met = early.groupBy("item").agg(F.min("root").alias("_a"), F.max("root").alias("_b"), F.max("first").alias("_first")).filter("_first AND _a <> _b")
    return early.join(met.select("item"), "item").select(F.xxhash64(F.lit("rare"), "item").alias("band"), "cid", "root", "first")


def _blocks(n: Column) -> Column:
    """Blocks that so many documents, with so many shingles each, make."""
    return F.coalesce(F.ceil(F.greatest(F.count(n) / BLOCK_DOCS, F.sum(n) / BLOCK_SHINGLES)), F.lit(0)).cast("int")


def _pointed(links: DataFrame, n: int) -> DataFrame:
    """cid, root of links (u, v) in which every u has one v, and v < u: pointers are followed, twice as far every round. n: members."""
    up = links.select(F.col("u").alias("cid"), F.col("v").alias("root"))
    while True:
        on = up.select(F.col("cid").alias("root"), F.col("root").alias("_on"))
        further = settled(up.join(on, "root", "left").select("cid", F.coalesce("_on", "root").alias("root"), F.col("_on").isNotNull().alias("_moved")), n)
        up = further.drop("_moved")
        if not further.filter("_moved").head(1):
            return up


def _moved(roots: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """roots (cid, root) of n members after the groups that edges (u, v) link have become one."""
    to = components(edges, n).select(F.col("u").alias("root"), F.col("root").alias("_to"))
    return settled(roots.join(to, "root", "left").select("cid", F.coalesce("_to", "root").alias("root")), n)


def _sets_of(docs: DataFrame, members: DataFrame, n: int, doc_id: str, text: str) -> DataFrame:
    """cid, items (the shingles' hashes, packed) and registers of each of n members, each from one row of docs.

    Up to BROADCAST_MEMBERS members their keys are broadcast, so that no other text is moved; beyond, docs are
    dealt by id and text, which spreads the copies of one text.
    """
    keys = members.select("cid", F.col("rep.text_key").alias("text_key"), F.col("rep.doc_id").alias("_id"))
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), text_key(F.col(text)).alias("text_key"), F.col(text).cast("string").alias("text"))
    same = (rows["text_key"] == keys["text_key"]) & rows["_id"].eqNullSafe(keys["_id"])
    texts = rows.join(F.broadcast(keys) if n <= BROADCAST_MEMBERS else keys, same).select("cid", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([registers(s).tobytes() for s in sets], pa.binary())], ["cid", "items", "registers"])

    return settled(texts.mapInArrow(run, "cid long, items binary, registers binary").dropDuplicates(["cid"]))


def near_duplicates(docs: DataFrame, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, kept: one row per row of docs.

    Equal sets are one class. Classes that share a band of registers are candidates of each other:

    1. Each class is verified against one centre, the least class of its bands: one comparison a class, so a
       large group of near copies is linked in linear time. The links make groups.
    2. Classes whose group differs from that of the largest class of their bands are verified against that.
    3. In every band that still holds two groups or more, classes of different groups are compared; the largest
       group of a band never with itself. Bands of the same classes are compared once. The classes of bands larger
       than a block (pages of one template, say, that are alike but not linked) are dealt anew by their rarest
       shingles, which loses no link. What is still larger is compared in blocks of bounded size, so none is cut.

    In steps 1 and 2 sizes and register estimates leave out pairs far below the threshold, and the others are
    checked on their full shingle sets; in step 3 all intersections of a block are counted at once. Only classes that share a band ship their set, made of one row each. Tasks return
    a spanning forest of the links, not the pairs.

    Shingles stand as 64-bit hashes (two different ones of a pair collide with a chance below 1e-9 a pair of
    texts of 100,000 words). Null, empty and blank texts have no shingles and are linked with nothing. A null
    doc_id is never a component's id unless the component has no other (then it is null, and its rows are kept).
    Rows that repeat the kept doc_id are all kept. An empty table gives an empty result; other columns are ignored.
    """
    ship_package(docs.sparkSession)
    all_rows = settled(sketched(docs, doc_id, text))
    rows, n_rows = all_rows.filter("sig IS NOT NULL"), all_rows.count()
    found = rows.groupBy("sig").agg(F.min("doc_id").alias("class_id"), F.min(F.struct("text_key", "doc_id")).alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = settled(found.repartition(files(WIDTH * n_rows)).withColumn("cid", F.monotonically_increasing_id()))  # numbered in the stage that writes them

    banded = classes.select("cid", F.explode("bands").alias("band"))
    ends = banded.groupBy("band").agg(F.min("cid").alias("least"), F.max("cid").alias("largest")).filter("least <> largest")
    shared = settled(banded.join(ends, "band"), REGISTERS // BAND * n_rows)
    centres = shared.groupBy("cid").agg(F.min("least").alias("least"), F.max("largest").alias("largest"))
    members = settled(classes.select("cid", "n", "class_id", "rep").join(centres, "cid"), n_rows)
    n_members = members.count()
    n_banded = REGISTERS // BAND * n_members
    sets = _sets_of(docs, members, n_members, doc_id, text)

    def starred(pairs: DataFrame) -> DataFrame:
        """Links among pairs (cid, n, centre): a centre's pairs are dealt to blocks, each with the centre's set."""
        blocks = pairs.groupBy("centre").agg(_blocks(F.col("n")).alias("blocks"))
        dealt = pairs.join(blocks, "centre").select("cid", "centre", F.pmod(F.xxhash64("cid"), "blocks").cast("int").alias("block"))
        hubs = blocks.select(F.col("centre").alias("cid"), "centre", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        return settled(dealt.union(hubs).join(sets, "cid").groupBy("centre", "block").applyInPandas(_with_centre(percent), "u long, v long"), n_members)

    up = _pointed(starred(members.filter("cid <> least").select("cid", "n", F.col("least").alias("centre"))), n_members)
    roots = settled(members.select("cid").join(up, "cid", "left").select("cid", F.coalesce("root", "cid").alias("root")), n_members)
    root_of = lambda name: roots.select(F.col("cid").alias(name), F.col("root").alias(f"{name}_root"))
    apart = members.join(roots, "cid").join(root_of("largest"), "largest").filter("root <> largest_root").select("cid", "n", F.col("largest").alias("centre"))
    between = lambda links: links.join(root_of("u"), "u").join(root_of("v"), "v").select(F.col("u_root").alias("u"), F.col("v_root").alias("v")).filter("u <> v")
    roots = _moved(roots, between(starred(apart)), n_members)

    def inside_of(held: DataFrame) -> DataFrame:
        """band, cid, root, n of the bands that hold two groups or more; of bands of the same classes one."""
        mixed = held.groupBy("band").agg(F.min("root").alias("_a"), F.max("root").alias("_b"), F.count("*").alias("_n"), F.bit_xor(F.xxhash64("cid")).alias("_x"), F.bit_xor(F.xxhash64("cid", F.lit(1))).alias("_y")).filter("_a <> _b")
        once = mixed.groupBy("_n", "_x", "_y").agg(F.min("band").alias("band")).select("band")
        return settled(held.join(once, "band").join(members.select("cid", "n"), "cid").select("band", "cid", "root", "n", "first"), n_banded)

    inside = inside_of(settled(shared.select("band", "cid").join(roots, "cid").withColumn("first", F.lit(True)), n_banded))
    crowded = settled(inside.groupBy("band").agg(_blocks(F.col("n")).alias("blocks")).filter("blocks > 1").select("band"), n_members)
    if crowded.head(1):
        finer = by_rare_shingles(sets, settled(inside.join(crowded, "band").select("cid", "root", "n").distinct(), n_members), percent)
        inside = inside_of(settled(inside.join(crowded, "band", "left_anti").select("band", "cid", "root", "first").unionByName(finer), n_banded))
    # what is compared: the rows of the largest group (kind 1) and of others (0); of bands by rare shingles, rows that only look for partners (3 and 2) don't meet each other
    crowds = inside.groupBy("band", "root").agg(F.count("*").alias("_n")).groupBy("band").agg(F.max_by("root", F.struct("_n", "root")).alias("crowd"))
    kind = (F.col("root") == F.col("crowd")).cast("int") + 2 * (~F.col("first")).cast("int")
    inside = settled(inside.join(crowds, "band").withColumn("kind", kind).select("band", "cid", "root", "n", "kind"), n_banded)
    sizes = inside.groupBy("band").agg(_blocks(F.col("n")).alias("blocks"), *[_blocks(F.when(F.col("kind") == k, F.col("n"))).alias(f"_{k}") for k in range(4)])
    own = F.when(F.col("blocks") == 1, F.lit(0)).otherwise(F.col("kind") * KIND + F.pmod(F.xxhash64("cid"), F.greatest(F.lit(1), F.element_at(F.array("_0", "_1", "_2", "_3"), F.col("kind") + 1))).cast("int"))
    numbers = lambda k: F.when(F.col(f"_{k}") > 0, F.transform(F.sequence(F.lit(0), F.col(f"_{k}") - 1), lambda i: i + k * KIND)).otherwise(F.array().cast("array<int>"))
    partners = F.when(F.col("blocks") == 1, F.array(F.lit(0)))
    for k, meets in enumerate(((0, 1, 2, 3), (0, 2), (0, 1), (0,))):
        partners = partners.when(F.col("kind") == k, F.concat(*map(numbers, meets)))
    pair = F.transform(partners, lambda k: F.struct(F.least(k, "block").alias("i"), F.greatest(k, "block").alias("j")))
    tasks = inside.join(sizes, "band").withColumn("block", own).withColumn("p", F.explode(pair))
    links = settled(tasks.select("cid", "root", "band", "block", "p.i", "p.j").join(sets, "cid").groupBy("band", "i", "j").applyInPandas(_among(percent), "u long, v long"), n_members)
    roots = _moved(roots, links, n_members)

    least = roots.join(members.select("cid", "class_id"), "cid").groupBy("root").agg(F.min("class_id").alias("least"))
    # written first, so that the last join stands alone and adaptive execution can split the rows of a large group of copies
    to = settled(roots.join(least, "root").select("cid", "least"), n_members)
    ids = settled(classes.select("sig", "cid", "class_id").join(to, "cid", "left").select("sig", F.coalesce("least", "class_id").alias("component_id")), n_rows)
    linked = rows.select("doc_id", "text_key", "n_shingles", "sig").join(ids, "sig").select("doc_id", "text_key", "n_shingles", "component_id")
    alone = all_rows.filter("sig IS NULL").select("doc_id", "text_key", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_duplicates(docs: DataFrame, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that near_duplicates doesn't keep; all columns stay."""
    gone = near_duplicates(docs, percent, doc_id, text).filter("NOT kept").select(F.col("doc_id").alias("_gone_id"), F.col("text_key").alias("_gone_key")).distinct()
    same = F.col(doc_id).cast("long").eqNullSafe(F.col("_gone_id")) & (text_key(F.col(text)) == F.col("_gone_key"))
    return docs.join(gone, same, "left_anti")


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with the size of its shingle set and the id of its component; odd rows are treated as in near_duplicates."""
    out = near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_shingles", "component_id", "kept")
