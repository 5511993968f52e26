"""Shared by the text classifiers: hashed byte n-grams, bounded samples, and linear training in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import ship_package

#: Rows that are scored together.
ROWS = 256


def in_fold(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32(doc_id as text) has the remainder; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


def sampled(key: Column, seed: int, rate: float) -> Column:
    """A share of rows by a 63-bit hash of their key, however small the share: the same rows in every run."""
    if rate >= 1:
        return F.lit(True)
    return F.xxhash64(F.lit(seed), key).bitwiseAND(F.lit((1 << 63) - 1)) < F.lit(int(rate * (1 << 63)))


def gram_counts(data: np.ndarray, dims: int) -> np.ndarray:
    """Counts of one to three bytes in a row, hashed into dims (a power of two)."""
    b = data.astype(np.uint32)
    mask = np.uint32(dims - 1)
    out = np.bincount((b * np.uint32(2654435761) >> np.uint32(16)) & mask, minlength=dims)
    if len(b) > 1:
        two = b[:-1] << np.uint32(8) | b[1:]
        out += np.bincount((two * np.uint32(2246822519) >> np.uint32(15)) & mask, minlength=dims)
    if len(b) > 2:
        three = two[:-1] << np.uint32(8) | b[2:]
        out += np.bincount((three * np.uint32(3266489917) >> np.uint32(14)) & mask, minlength=dims)
    return out


def unit(counts: np.ndarray) -> np.ndarray:
    v = np.sqrt(counts.astype(np.float32))
    return v / max(float(np.linalg.norm(v)), 1e-9)


def scored(docs: DataFrame, keep: list[str], text: str, features: Callable[[str], np.ndarray | None], score: Callable[[np.ndarray], list[np.ndarray]], empty: tuple, fields: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    """Adds score(matrix of features)'s columns to the keep columns; rows without features get `empty`.

    Works through Arrow batches in blocks of ROWS, so memory follows the block and not the partition.
    """
    ship_package(docs.sparkSession)
    schema = docs.select(*keep).schema
    for name, kind, _ in fields:
        schema = schema.add(name, kind)

    own = [*keep, *([] if text in keep else ["_text"])]
    at_text = own.index(text) if text in keep else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                found = [features(x.as_py()) if x.is_valid else None for x in part.column(at_text)]
                full = [i for i, x in enumerate(found) if x is not None]
                columns = [[e] * part.num_rows for e in empty]
                if full:
                    for column, values in zip(columns, score(np.stack([found[i] for i in full])), strict=True):
                        for i, v in zip(full, values, strict=True):
                            column[i] = v.item() if hasattr(v, "item") else v
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *[pa.array(c, t) for c, (_, _, t) in zip(columns, fields, strict=True)]], [f.name for f in schema])

    return docs.select(*keep, *([] if text in keep else [F.col(text).cast("string").alias("_text")])).mapInArrow(run, schema)


def sample_features(rows: DataFrame, features: Callable[[str], np.ndarray | None], text: str = "text", label: str = "label") -> tuple[list, np.ndarray]:
    """Labels and features of a bounded sample, brought to the driver as packed half-precision numbers in the order of _order; the last column is 1.

    The driver holds them packed and once as single-precision numbers, which the fits take as they stand.
    The sample is drawn from rows that exist, so it must not come back without any: that would leave out the
    model in silence, and is an error. Drawn rows without features count as drawn, but aren't returned.
    """

    ship_package(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [None if x is None or (v := features(x)) is None else v.astype(np.float16).tobytes() for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["_order", "label", "packed"])

    found = rows.select("_order", F.col(label).cast("string").alias("label"), F.col(text).cast("string").alias("text")).mapInArrow(run, "_order long, label string, packed binary").toArrow()
    if not found.num_rows:
        raise RuntimeError("nothing was drawn from a table with rows")
    orders, names, packed = (found.column(c) for c in ("_order", "label", "packed"))
    kept = [(order, name, i) for i, (order, name, full) in enumerate(zip(orders.to_pylist(), names.to_pylist(), packed.is_valid().to_pylist(), strict=True)) if full]
    if not kept:
        return [], np.zeros((0, 0), np.float32)
    kept.sort(key=lambda r: r[:2])
    x = np.ones((len(kept), len(packed[kept[0][2]].as_py()) // 2 + 1), np.float32)
    for row, (_, _, i) in zip(x, kept, strict=True):
        row[:-1] = np.frombuffer(packed[i].as_py(), np.float16)
    return [name for _, name, _ in kept], x


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 150) -> np.ndarray:
    """Weights (the last is the bias) of least squared hinge loss, by accelerated gradient steps; the last column of x is 1; y is -1 or 1, both classes weigh the same."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(x.dtype)
    step = 1.0 / (1.0 / c + 2.0 * 2.0 * float(share.max()) * len(x) / 1.0)
    w = v = np.zeros(x.shape[1], x.dtype)
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - step * (v / c - 2 * (x.T @ (share * y * slack)))
        v = new + k / (k + 3) * (new - w)
        w = new
    return w
