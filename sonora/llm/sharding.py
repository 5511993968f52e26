"""Shards by a k-d tree: recursive weighted median splits along the widest metadata dimension."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ranked, read, settled

#: Cells of one histogram pass over a node.
CELLS = 4096
#: The low bits of a split key that hold the text's hash, so that equal texts stand together along every dimension.
HASH_BITS = 31
#: The low bits of a row's hash that come from its place in the table; 62 bits in all.
POSITION_BITS = 22


@dataclass
class Node:
    """A part of the tree that is to become `shards` shards from number `first` on."""

    number: int
    first: int
    shards: int
    dim: int = 0
    cut: tuple[int, int] | None = None
    children: list[Node] = field(default_factory=list)


def _code(text: Column) -> Column:
    """The first four characters of a string as an order-preserving whole number below 2**31; null is 0."""
    value = F.lit(0).cast("long")
    for i in range(1, 5):
        c = F.coalesce(F.ascii(F.substring(text, i, 1)), F.lit(0))
        value = value * 215 + F.least(c, F.lit(214))
    return F.coalesce(value, F.lit(0).cast("long"))


def _leaf(root: Node, of, dims: list[str]) -> Column:
    """A column of `of(node)` for the deepest node that a row falls into."""

    def walk(node: Node) -> Column:
        if not node.children:
            return F.lit(of(node))
        k1, k2 = node.cut
        key = F.col(dims[node.dim])
        return F.when((key < k1) | ((key == k1) & (F.col("row_hash") < k2)), walk(node.children[0])).otherwise(walk(node.children[1]))

    return walk(root)


def _pick(column: str, by: dict[int, object]) -> Column:
    """by[number] for the row's node number; numbers are few (at most the number of shards)."""
    out = None
    for number, value in by.items():
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(F.col(column) == number, value) if out is None else out.when(F.col(column) == number, value)
    return out


def _descend(rows: DataFrame, nodes: list[Node], keys: dict[int, str], bounds: dict[int, tuple[int, int]], want: dict[int, int], only: Column, stop: int) -> dict[int, tuple[int, int, int]]:
    """Weighted quantiles of many nodes at once, by histograms of CELLS cells narrowed pass by pass.

    bounds: the half-open range of each node's key; want: bytes that go left. Returns for each node
    (key, bytes in keys below it, bytes at that key or 0 if the edge at key is near enough): the driver
    sees at most CELLS sums a node and pass, whatever the number of rows.
    """
    below = dict.fromkeys(bounds, 0)
    found: dict[int, tuple[int, int, int]] = {}
    while bounds:
        step = {n: max(1, -(-(hi - lo) // CELLS)) for n, (lo, hi) in bounds.items()}
        key = _pick("node", {n: F.col(keys[n]) for n in bounds})
        lo = _pick("node", {n: F.lit(b[0]).cast("long") for n, b in bounds.items()})
        hi = _pick("node", {n: F.lit(b[1]).cast("long") for n, b in bounds.items()})
        width = _pick("node", {n: F.lit(s).cast("long") for n, s in step.items()})
        active = rows.filter(F.col("node").isin(list(bounds)) & only).select("node", "size", key.alias("key"), lo.alias("lo"), hi.alias("hi"), width.alias("width"))
        cells = active.filter("key >= lo AND key < hi").groupBy("node", F.expr("(key - lo) DIV width").alias("cell")).agg(F.sum("size").alias("bytes")).collect()
        by_node: dict[int, list] = {n: [] for n in bounds}
        for c in cells:
            by_node[c["node"]].append((c["cell"], c["bytes"]))
        for n, own in by_node.items():
            at = below[n]
            lo_n, hi_n = bounds[n]
            best = (abs(want[n] - at), lo_n, at)
            crossing = None
            for cell, size in sorted(own):
                edge = min(hi_n, lo_n + (cell + 1) * step[n])
                if at < want[n] < at + size:
                    crossing = (lo_n + cell * step[n], edge, at, size)
                at += size
                best = min(best, (abs(want[n] - at), edge, at))
            if best[0] <= stop or crossing is None:
                found[n] = (best[1], best[2], 0)
                del bounds[n]
            elif step[n] == 1:
                found[n] = (crossing[0], crossing[2], crossing[3])
                del bounds[n]
            else:
                bounds[n] = crossing[:2]
                below[n] = crossing[2]
    return found


def plan_tree(rows: DataFrame, dims: list[str], n_shards: int) -> Node:
    """Splits nodes level by level until each is one shard.

    rows: size, row_hash and the dims (whole numbers below 2**62). Every level takes one pass for the
    spread of each node and a few histogram passes for the medians; the driver holds the tree alone.
    A split that would part a group of equal texts is moved to the group's edge if that costs at most
    1 % of a shard; a larger group is cut by row hash.
    """
    root = Node(0, 0, n_shards)
    level, count = [root], 1
    ranges: list[tuple[int, int]] | None = None
    while todo := [n for n in level if n.shards > 1]:
        at = rows.withColumn("node", _leaf(root, lambda n: n.number, dims))
        spread = at.filter(F.col("node").isin([n.number for n in todo])).groupBy("node").agg(F.sum("size").alias("bytes"), *[f(d).alias(f"{k}_{i}") for i, d in enumerate(dims) for k, f in (("lo", F.min), ("hi", F.max))]).collect()
        seen = {r["node"]: r for r in spread}
        if ranges is None and seen:
            ranges = [(seen[0][f"lo_{i}"], seen[0][f"hi_{i}"]) for i in range(len(dims))]
        nodes, bounds, want, keys = [], {}, {}, {}
        for n in todo:
            left = n.shards // 2
            n.children = [Node(count, n.first, left), Node(count + 1, n.first + left, n.shards - left)]
            count += 2
            n.cut = (1 << 62, 0)
            if n.number not in seen:  # no rows: any cut does
                continue
            r = seen[n.number]
            width = [(r[f"hi_{i}"] - r[f"lo_{i}"]) / max(1, hi - lo) for i, (lo, hi) in enumerate(ranges)]
            n.dim = max(range(len(dims)), key=lambda i: (width[i], -i))
            nodes.append(n)
            keys[n.number] = dims[n.dim]
            bounds[n.number] = (r[f"lo_{n.dim}"], r[f"hi_{n.dim}"] + 1)
            want[n.number] = round(r["bytes"] * left / n.shards)
        if nodes:
            leaf = sum(r["bytes"] / n.shards for n in nodes if (r := seen[n.number])) / len(nodes)
            found = _descend(at, nodes, keys, dict(bounds), want, F.lit(True), int(leaf * 0.002))
            inside: dict[int, tuple[int, int]] = {}
            for n in nodes:
                key, below, group = found[n.number]
                n.cut = (key, 0)
                if group:
                    short, over = want[n.number] - below, below + group - want[n.number]
                    if min(short, over) <= leaf * 0.01:
                        n.cut = (key, 0) if short <= over else (key + 1, 0)
                    else:
                        inside[n.number] = (key, below)
            if inside:
                same = _pick("node", {n.number: F.col(keys[n.number]) == inside[n.number][0] for n in nodes if n.number in inside})
                cuts = _descend(at, nodes, dict.fromkeys(inside, "row_hash"), dict.fromkeys(inside, (0, 1 << 62)), {k: want[k] - below for k, (_, below) in inside.items()}, same, int(leaf * 0.001))
                for n in nodes:
                    if n.number in cuts:
                        key, below, group = cuts[n.number]
                        after = group and below + group - (want[n.number] - inside[n.number][1]) < want[n.number] - inside[n.number][1] - below
                        n.cut = (inside[n.number][0], key + bool(after))
        level = [c for n in todo for c in n.children]
    return root


def shard_documents(docs: DataFrame, n_shards: int = 24, text: str = "text", doc_id: str = "doc_id", lang: str = "lang") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot.

    Dimensions are language, size and the text's hash. Null text counts no bytes (size 8, crc 0); null
    language and null doc_id are values of their own; languages are told apart by their first four characters;
    repeated rows stay rows of their own with a slot each, and a group of them is cut like others; with no
    rows there are no shards; other columns are ignored. Shards hold near equal bytes: each
    cut lies at the row edge nearest the weighted median, or beside a group of equal texts where that
    costs under 1 % of a shard.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(value) + F.lit(8)).cast("long").alias("size"), F.crc32(value).alias("text_crc32"), F.xxhash64(value).alias("h"), _code(F.col(lang)).alias("code"), F.monotonically_increasing_id().alias("position"))
    low = F.col("h").bitwiseAND(F.lit((1 << HASH_BITS) - 1))
    dims = {"dim_lang": F.col("code"), "dim_size": F.least(F.col("size"), F.lit((1 << 31) - 1)), "dim_text": F.shiftrightunsigned(F.col("h"), 33)}
    # ids and texts first; rows equal in both go by their position, so that a group of these can be cut anywhere
    row_hash = F.shiftleft(F.shiftrightunsigned(F.xxhash64("doc_id", "h"), 2 + POSITION_BITS), POSITION_BITS).bitwiseOR(F.xxhash64("position").bitwiseAND(F.lit((1 << POSITION_BITS) - 1)))
    rows = settled(base.select("doc_id", "size", "text_crc32", *[(v * (1 << HASH_BITS) + low).alias(k) for k, v in dims.items()], row_hash.alias("row_hash")))
    root = plan_tree(rows, list(dims), n_shards)
    placed = rows.select("doc_id", "size", "text_crc32", "row_hash", _leaf(root, lambda n: n.first, list(dims)).cast("int").alias("shard"))
    return ranked(placed, ["shard"], ["row_hash", "doc_id"], rows.count(), "slot").drop("row_hash")


def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document in shards 0 to 23 of near equal bytes; odd rows as in shard_documents."""
    out = shard_documents(read(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
