"""Vector compression to codes: per-part codebooks in whole numbers, the nearest entry found by Orchard's search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship_package
from .common import read, settled

#: Parts of a vector, entries of a part's codebook (one or two hex digits), rounds of training, and whole steps in 1.
PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Scaled components beyond this are held here, so that sums of squares stay whole numbers of 64 bits.
LARGEST = 1 << 26
#: Rows that are searched together.
ROWS = 4096


def orchard(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of book (ties to the lower index) and squared distance of every row of x, in whole numbers.

    Every entry has a list of all entries sorted by distance from it. A row walks the list of its best entry so
    far; an entry that improves on it (nearer, or as near with a lower index) becomes the best, and the walk goes
    on at the start of its own list. Entries met before are skipped. The walk ends where the list is more than
    twice as far from the best entry as the row is: by the triangle inequality no entry behind can be as near.
    All rows of x walk at once, a step each.
    """
    n, k = len(x), len(book)
    between = np.square(book[:, None, :] - book[None, :, :]).sum(axis=2)
    order = np.argsort(between, axis=1, kind="stable")
    far = np.take_along_axis(between, order, axis=1)
    best = np.zeros(n, np.int64)
    near = np.square(x - book[0]).sum(axis=1)
    visited = np.zeros((n, k), bool)
    visited[:, 0] = True
    place = np.zeros(n, np.int64)
    going = np.arange(n)
    while len(going):
        at = place[going]
        going = going[at < k]
        at = at[at < k]
        going = going[far[best[going], at] <= 4 * near[going]]  # squares: twice the distance is four times the square
        if not len(going):
            break
        entry = order[best[going], place[going]]
        place[going] += 1
        fresh = ~visited[going, entry]
        row, entry = going[fresh], entry[fresh]
        visited[row, entry] = True
        distance = np.square(x[row] - book[entry]).sum(axis=1)
        better = (distance < near[row]) | ((distance == near[row]) & (entry < best[row]))
        row = row[better]
        best[row], near[row], place[row] = entry[better], distance[better], 0
    return best, near


def whole(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component, held within LARGEST."""
    held = lambda x: F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), F.floor(F.lit(float(scale)) * x.cast("double")).cast("double")))
    return F.transform(vector, lambda x: held(x).cast("long"))


def kept_vectors(vectors: DataFrame, key: str, vector: str, label: str, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """vec_id, label and x (whole numbers, zeros added up to a multiple of `parts`) of the rows that take part.

    Rows with a null or empty vector, or with null or non-finite components, don't. Nor do rows of another
    length than the most frequent one (of equally frequent ones the shortest).
    """
    finite = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.select(F.col(key).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("_v")).filter(F.coalesce((F.size("_v") > 0) & finite, F.lit(False)))
    lengths = rows.groupBy(F.size("_v").alias("size")).count()
    top = lengths.orderBy(F.desc("count"), "size").first()
    size = top["size"] if top else parts
    pad = -size % parts
    x = whole(F.col("_v"), scale)
    if pad:
        x = F.concat(x, F.array_repeat(F.lit(0).cast("long"), pad))
    return rows.filter(F.size("_v") == size).select("vec_id", "label", x.alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def first_books(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """parts x entries x width: the vectors of the smallest ids; of rows that repeat an id, the least vector.

    Every task returns its own smallest ids alone, so no vectors are shuffled.
    """
    ship_package(kept.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, list[int]] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            smallest = np.unique(ids)[:entries]
            for i in np.flatnonzero(ids <= smallest[-1]) if len(smallest) else ():
                key, x = int(ids[i]), batch.column(1)[int(i)].as_py()
                least[key] = min(x, least.get(key, x))
            least = {k: least[k] for k in sorted(least)[:entries]}
        yield pa.RecordBatch.from_arrays([pa.array(list(least), pa.int64()), pa.array(list(least.values()), pa.list_(pa.int64()))], ["vec_id", "x"])

    found = kept.filter("vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(run, "vec_id long, x array<long>")
    rows = [r["x"] for r in found.groupBy("vec_id").agg(F.min("x").alias("x")).orderBy("vec_id").limit(entries).collect()]
    if not rows:
        return np.zeros((parts, 0, 0), np.int64)
    return np.array(rows, np.int64).reshape(len(rows), parts, -1).transpose(1, 0, 2)


def trained(kept: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks after so many rounds: every part goes to its nearest entry, entries become floor(sum / count).

    A round is one pass over the vectors. Tasks return sums by part and entry, so at most parts x entries rows
    a task are shuffled, and as many rows in all reach the driver.
    """
    parts, entries, width = books.shape
    ship_package(kept.sparkSession)
    for _ in range(rounds):
        now = books

        def run(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    x = _matrix(batch.column(0).slice(at, ROWS)).reshape(-1, parts, width)
                    for p in range(parts):
                        code, _ = orchard(x[:, p], now[p])
                        counts[p] += np.bincount(code, minlength=entries)
                        np.add.at(sums[p], code, x[:, p])
            p, e = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), pa.array(sums[p, e].tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

        found = kept.select("x").mapInArrow(run, "part int, entry int, n long, sums array<long>")
        large = lambda c: F.sum(c.cast("decimal(38,0)"))
        sums = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[large(F.get("sums", F.lit(i))) for i in range(width)]).alias("sums"))
        books = books.copy()
        for r in sums.collect():
            books[r["part"], r["entry"]] = [int(s) // r["n"] for s in r["sums"]]
    return books


def encoded(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (hex digits of the entries in part order, as many each as the last entry needs) and error (squared distances summed over parts)."""
    parts, entries, width = books.shape
    digits = max(2, len(f"{max(0, entries - 1):x}"))
    ship_package(kept.sparkSession)
    schema = kept.select("vec_id", "label").schema.add("code", "string").add("error", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hexed = [f"{e:0{digits}x}" for e in range(entries)]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = _matrix(part.column(2)).reshape(-1, parts, width)
                found = [orchard(x[:, p], books[p]) for p in range(parts)]
                codes = ["".join([hexed[e] for e in row]) for row in np.stack([c for c, _ in found], axis=1).tolist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(codes, pa.string()), pa.array(np.sum([d for _, d in found], axis=0))], schema.names)

    return kept.select("vec_id", "label", "x").mapInArrow(run, schema)


def books_sha256(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compressed(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, label, code, error, label_error and codebooks_sha256: one row per vector that takes part (see kept_vectors).

    Codebooks start as the parts of the vectors of the smallest ids. Each of `rounds` passes and the last
    assignment find the nearest entry by Orchard's search. label_error sums error over the rows of a label, nulls
    together. Rows of a null id take part, but never start a codebook; with no id at all there is nothing to start
    from and no row is returned. Repeated rows count each; a repeated id starts one entry. Fewer ids than entries
    make smaller codebooks. An empty table gives no rows; other columns are ignored. Components beyond
    LARGEST / scale are held there.
    """
    kept = kept_vectors(vectors, key, vector, label, parts, scale)
    books = first_books(kept, parts, entries)
    if not books.shape[1]:
        return kept.limit(0).select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    books = trained(kept, books, rounds)
    rows = settled(encoded(kept, books))  # narrow; assigned once for the sums and the result
    by_label = rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    out = rows.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", "label", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of eight parts by codebooks of 16 entries after six rounds; odd rows are treated as in compressed."""
    out = compressed(read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return out.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _round_sql(k: int) -> str:
    """Codebook b{k+1} from b{k}: plain search over all entries, then floored means; unused entries stay."""
    return f"""
    a{k} AS MATERIALIZED (SELECT vec_id, label, part, arg_min(entry, d * 16 + entry) AS entry, min(d) AS d, any_value(x) AS x FROM (
        SELECT v.rid, v.vec_id, v.label, v.part, v.x, b.entry, CAST(list_sum(list_transform(list_zip(v.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS HUGEINT) AS d
        FROM v JOIN b{k} b ON v.part = b.part) GROUP BY rid, vec_id, label, part),
    m{k} AS (SELECT part, entry, i, CAST(floor_div AS BIGINT) AS c FROM (
        SELECT part, entry, i, CASE WHEN s >= 0 OR s % n = 0 THEN s // n ELSE s // n - 1 END AS floor_div
        FROM (SELECT part, entry, i, sum(x[i]) AS s, count(*) AS n FROM a{k}, (SELECT unnest(generate_series(1, (SELECT max(len(x)) FROM v))) AS i) GROUP BY part, entry, i))),
    b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN (SELECT part, entry, list(c ORDER BY i) AS x FROM m{k} GROUP BY part, entry) m ON b.part = m.part AND b.entry = m.entry)"""


OP11_SQL = f"""
WITH k AS (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
        WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    v AS MATERIALIZED (SELECT rid, vec_id, label, part, list_slice(x, part * len(x) // {PARTS} + 1, (part + 1) * len(x) // {PARTS}) AS x FROM k, (SELECT unnest(generate_series(0, {PARTS - 1})) AS part)),
    b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM v WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT {ENTRIES})),
    {",".join(_round_sql(k) for k in range(ROUNDS))},
    last AS (SELECT rid, vec_id, label, part, arg_min(entry, d * 16 + entry) AS entry, min(d) AS d FROM (
        SELECT v.rid, v.vec_id, v.label, v.part, b.entry, CAST(list_sum(list_transform(list_zip(v.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS HUGEINT) AS d
        FROM v JOIN b{ROUNDS} b ON v.part = b.part) GROUP BY rid, vec_id, label, part),
    coded AS (SELECT rid, vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM last GROUP BY rid, vec_id, label),
    books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, books
"""
