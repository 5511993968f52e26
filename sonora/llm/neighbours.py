"""Approximate nearest neighbours by stable projections under a kd-tree, verified until a chi-square test holds."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..runtime import ship_package
from .common import read, settled
from .textmodels import sampled

#: Projected dimensions (even, for the closed form of the chi-square distribution).
PROJECTED = 16
#: Confidence of the stopping test: a nearer vector is missed with at most one minus this probability.
CONFIDENCE = 0.97
#: Vectors that the upper tree is fitted on at least (all, if there are fewer), and at least for each cell; only their projections reach the driver.
SAMPLE, PER_CELL = 16_384, 4
#: Vectors in a block and a leaf, about.
BLOCK, LEAF = 16_384, 256
#: Query vectors that meet a block in one task, about.
QUERIES = 8_192


def chi_square_quantile(p: float, freedom: int) -> float:
    """For even degrees of freedom: 1 - exp(-x/2) * sum of (x/2)**i / i! for i < freedom/2, inverted by bisection."""
    below = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(freedom // 2))
    lo, hi = 0.0, 100.0 * freedom
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


def projection(size: int, projected: int, seed: int) -> np.ndarray:
    """A matrix of standard normal (2-stable) numbers: a projected distance over the distance is chi-distributed."""
    return np.random.default_rng(seed).standard_normal((size, projected))


@dataclass
class Tree:
    """A kd-tree with 2**depth cells: split dimension and value of each inner node, and the boxes of all nodes, cells last."""

    dims: np.ndarray
    cuts: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @property
    def inner(self) -> int:
        return len(self.low) // 2

    @staticmethod
    def fit(points: np.ndarray, depth: int) -> Tree:
        inner, m = (1 << depth) - 1, points.shape[1]
        dims, cuts = np.zeros(inner, int), np.zeros(inner)
        low, high = np.full((2 * inner + 1, m), -np.inf), np.full((2 * inner + 1, m), np.inf)
        own: dict[int, np.ndarray] = {0: points}
        for node in range(inner):
            p = own.pop(node)
            if len(p):
                dims[node] = int(np.ptp(p, axis=0).argmax())
                cuts[node] = np.median(p[:, dims[node]])
            left = p[:, dims[node]] < cuts[node]
            for child, rows in ((2 * node + 1, p[left]), (2 * node + 2, p[~left])):
                own[child], low[child], high[child] = rows, low[node], high[node]
            high[2 * node + 1, dims[node]] = low[2 * node + 2, dims[node]] = cuts[node]
        return Tree(dims, cuts, low, high)

    def cell(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), int)
        for _ in range(int(math.log2(self.inner + 1))):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.dims[node]] >= self.cuts[node])
        return node - self.inner

    def within(self, points: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (point, cell) whose squared distance is at most the point's limit, found from the root down."""
        point, node = np.arange(len(points)), np.zeros(len(points), int)
        for _ in range(int(math.log2(self.inner + 1))):
            point, node = np.repeat(point, 2), np.concatenate([2 * node[:, None] + 1, 2 * node[:, None] + 2], axis=1).ravel()
            x = points[point]
            gap = np.maximum(np.maximum(self.low[node] - x, x - self.high[node]), 0)
            near = np.einsum("ij,ij->i", gap, gap) <= limit[point]
            point, node = point[near], node[near]
        return point, node - self.inner


def _box_squared(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    out = np.zeros((len(points), len(low)))
    for j in range(points.shape[1]):
        x = points[:, j][:, None]
        gap = np.maximum(np.maximum(low[:, j][None, :] - x, x - high[:, j][None, :]), 0)
        out += gap * gap
    return out


def _leaves(points: np.ndarray) -> list[np.ndarray]:
    """Row numbers of the leaves of a kd-tree over a block, halved at medians along the widest dimension."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= LEAF:
            out.append(rows)
            continue
        dim = int(np.ptp(points[rows], axis=0).argmax())
        half = len(rows) // 2
        order = np.argpartition(points[rows, dim], half)
        todo += [rows[order[:half]], rows[order[half:]]]
    return out


def usable(vector: Column) -> Column:
    """Neither null nor all zero nor holding null or non-finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 0))


def _searcher(k: int, size: int, projected: int, seed: int, confidence: float):
    limit = chi_square_quantile(confidence, projected)

    def search(points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        """The nearest k of a block for each query: leaves in the order of their projected distance, until the next one fails the test."""
        columns = ["query", "vec_id", "score"]
        if not len(points) or not len(queries):
            return pd.DataFrame([], columns=columns).astype({"query": "int64", "vec_id": "int64", "score": "float64"})
        points = points.sort_values("key").reset_index(drop=True)
        x, q = _matrix(points["vector"]), _matrix(queries["ask"])
        matrix = projection(size, projected, seed)
        px, pq = x @ matrix, q @ matrix
        leaves = _leaves(px)
        low, high = np.stack([px[r].min(axis=0) for r in leaves]), np.stack([px[r].max(axis=0) for r in leaves])
        ids = points["ids"].to_numpy()
        counts = np.array([len(i) for i in ids])
        out_q, out_v, out_d = [], [], []
        reach = queries["reach"].to_numpy()
        keys = queries["query"].to_numpy()
        for at in range(0, len(q), 256):
            boxes = _box_squared(pq[at : at + 256], low, high)
            for i, box in enumerate(boxes, at):
                rows, far = np.zeros(0, int), np.zeros(0)
                kth = reach[i] ** 2  # squared distance of the k-th so far
                for leaf in np.argsort(box, kind="stable"):
                    if box[leaf] > limit * kth:
                        break
                    own = leaves[leaf]
                    difference = x[own] - q[i]
                    rows, far = np.concatenate([rows, own]), np.concatenate([far, np.einsum("ij,ij->i", difference, difference)])
                    order = np.argsort(far, kind="stable")
                    enough = int(np.searchsorted(np.cumsum(counts[rows[order]]), k)) + 1
                    if enough <= len(order):
                        kth = min(kth, far[order[enough - 1]])
                        near = far <= far[order[enough - 1]]  # ties stay, as ids decide among them
                        rows, far = rows[near], far[near]
                score = np.sqrt(far)
                found = sorted((s, v) for s, r in zip(score, rows, strict=True) for v in ids[r])[:k]
                out_q += [keys[i]] * len(found)
                out_v += [v for _, v in found]
                out_d += [s for s, _ in found]
        return pd.DataFrame({"query": np.array(out_q, np.int64), "vec_id": np.array(out_v, np.int64), "score": np.array(out_d, np.float64)})

    return search


def search(vectors: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", projected: int = PROJECTED, confidence: float = CONFIDENCE, seed: int = 2) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row its k nearest other rows by Euclidean distance.

    Equal vectors are one entry of the index with their k + 1 smallest ids, which is all that any result
    can hold, so a group of copies of any size costs one. Entries are projected and dealt to the cells of
    a kd-tree, one for each BLOCK of entries, whose cuts are medians of SAMPLE entries, or of PER_CELL for
    each cell if that is more (all entries are indexed); cells that turn out larger are split by hash, and the
    queries that meet a cell are dealt by their own number, so the entries are moved about twice in all. A query is first searched in its own cell; then in every cell that its k-th distance so
    far doesn't rule out: a cell at projected distance b can be left out when b**2 exceeds the chi-square
    quantile times the squared k-th distance. In a cell, leaves are verified in the order of projected
    distance until the same test holds. Rows with null, zero or non-finite vectors, with a null id, or
    with another number of components than most, take no part; repeated rows are candidates of each
    other unless they share the id; with fewer rows all candidates are returned.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks")).filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    sizes = rows.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").limit(1).collect()
    out_schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], out_schema)
    size = sizes[0]["n"]
    rows = rows.filter(F.size("vector") == size)
    first = W.Window.partitionBy("vector").orderBy("vec_id")
    some = rows.groupBy("vector", "vec_id").agg(F.max("asks").alias("asks"))
    asked = some.filter("asks").select("vector").distinct().withColumn("asked", F.lit(True))
    entries = some.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= k + 1).groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    entries = entries.join(asked, "vector", "left").select(F.xxhash64("vector", F.lit(seed)).alias("key"), "vector", "ids", F.coalesce("asked", F.lit(False)).alias("asked"))

    matrix_args = (size, projected, seed)
    placed_in = settled(entries)
    n = placed_in.count()
    depth = max(0, math.ceil(math.log2(max(1, n) / BLOCK)))
    share = max(SAMPLE, PER_CELL << depth) / max(1, n)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = projection(*matrix_args)
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in (_matrix(batch.column(1).to_pandas()) @ matrix).astype(np.float32)], pa.binary())], ["key", "p"])

    drawn = placed_in.filter(sampled(F.col("key"), seed, share)).select("key", "vector").mapInArrow(project, "key long, p binary").collect()  # 64 bytes each
    drawn.sort(key=lambda r: (r["key"], r["p"]))
    tree = Tree.fit(np.stack([np.frombuffer(r["p"], np.float32) for r in drawn]).astype(float) if drawn else np.zeros((0, projected)), depth)
    limit = chi_square_quantile(confidence, projected)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = projection(*matrix_args)
        for batch in batches:
            x = _matrix(batch.column(1).to_pandas())
            cells = tree.cell(x @ matrix) if len(x) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int32())], ["key", "vector", "ids", "asked", "cell"])

    points = settled(placed_in.mapInArrow(place, "key long, vector array<double>, ids array<long>, asked boolean, cell int"))
    parts = points.groupBy("cell").agg(F.ceil(F.count("*") / (2 * BLOCK)).cast("int").alias("parts"))  # one row for each BLOCK of entries
    asking = points.filter("asked").select(F.col("key").alias("query"), F.col("vector").alias("ask"), F.col("cell").alias("at"))
    run = _searcher(k + 1, size, projected, seed, confidence)

    def met(queries: DataFrame) -> DataFrame:
        """queries: query, ask (its vector), at (the cell to search), reach. A cell that none meets isn't moved."""
        load = queries.groupBy("at").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("chunks"))
        cells = parts.join(load, F.col("cell") == F.col("at")).select("cell", "parts", "chunks")
        dealt = points.join(F.broadcast(cells), "cell").withColumn("part", F.pmod("key", F.col("parts")).cast("int")).select("key", "vector", "ids", "cell", "part", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
        to = queries.join(F.broadcast(cells.withColumnRenamed("cell", "at")), "at").withColumn("lot", F.pmod(F.xxhash64("query"), F.col("chunks")).cast("int"))
        to = to.select("query", "ask", "reach", "at", "lot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("piece"))
        return dealt.groupBy("cell", "part", "chunk").cogroup(to.groupBy("at", "piece", "lot")).applyInPandas(run, "query long, vec_id long, score double")

    def best(found: DataFrame) -> DataFrame:
        order = W.Window.partitionBy("query").orderBy("score", "vec_id")
        return found.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k + 1).drop("_n")

    near = settled(best(met(asking.withColumn("reach", F.lit(float("inf"))))))
    reach = near.groupBy("query").agg(F.when(F.count("*") > k, F.max("score")).otherwise(F.lit(float("inf"))).alias("reach"))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = projection(*matrix_args)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x, home, far = _matrix(part.column(1).to_pandas()), np.array(part.column(2)), np.array(part.column(3))
                row, cell = tree.within(x @ matrix, limit * far * far)
                row, cell = row[cell != home[row]], cell[cell != home[row]]
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([taken.column(0), pa.array(cell, pa.int32()), taken.column(3)], ["query", "at", "reach"])

    if depth:
        again = settled(asking.join(reach, "query").select("query", "ask", "at", "reach").mapInArrow(others, "query long, at int, reach double"))
        near = best(near.union(met(again.join(asking.select("query", "ask"), "query"))))
    lists = near.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("near"))
    ask = some.filter("asks").select(F.col("vec_id").alias("query_id"), F.xxhash64("vector", F.lit(seed)).alias("query"))
    own = ask.join(lists, "query").select("query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    return own.select("query_id", F.posexplode("near").alias("rank", "x")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest others of every 100th vector; null, zero and non-finite vectors take no part, and odd rows are treated as in search."""
    return search(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)
