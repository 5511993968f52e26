"""Prefix trie of conversations by van Emde Boas recursion: cut at half depth, name the cut prefixes, graft totals upward."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..runtime import ship_package
from .common import read, settled

#: Turns that one row holds (a power of two): the recursion below this height runs inside a row, above it in Spark.
LEAF = 16
#: Ids in a piece of the text whose digest is taken.
PIECE = 512
#: Conversations of a family share the first turns of its first one: ids c - c % FAMILY, and at most BORROWED - 1 turns.
FAMILY, BORROWED = 5, 9
ROOT = hashlib.sha256(b"root").digest()
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _joined(kind: str, left: Column, right: Column) -> Column:
    """Name of two names one after the other."""
    return F.unhex(F.sha2(F.concat(F.lit(bytearray(kind.encode())), left, right), 256))


def block_name(labels: list[bytes]) -> bytes:
    """Name of a power of two of labels, from the names of its halves."""
    while len(labels) > 1:
        labels = [hashlib.sha256(b"b" + a + b).digest() for a, b in zip(labels[::2], labels[1::2], strict=True)]
    return labels[0]


def prefix_names(group: bytes, labels: list[bytes], end: bytes | None, height: int) -> list[bytes]:
    """Names of all prefixes of labels below the prefix `group`, by halving the height; `end` names a full row's last one.

    A cut in the middle names the prefix that ends there from its group and the upper half's block; the upper half
    goes on with the same group, the lower one with the new name. Every prefix is named by exactly one cut.
    """
    n, blocks = len(labels), [labels]
    while len(blocks[-1]) > 1:
        last = blocks[-1]
        blocks.append([hashlib.sha256(b"b" + a + b).digest() for a, b in zip(last[::2], last[1::2], strict=False)])
    names: list = [None] * n
    todo = [(0, height.bit_length() - 1, group)]
    while todo:
        low, level, own = todo.pop()
        if not level:
            continue
        level -= 1
        middle = low + (1 << level)
        todo.append((low, level, own))
        if middle <= n:
            names[middle - 1] = hashlib.sha256(b"p" + own + blocks[level][low >> level]).digest()
            if middle < n:
                todo.append((middle, level, names[middle - 1]))
    if n == height:
        names[-1] = end
    return names


def ordered_turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, pos (from 0, by turn, null first), label (digest of role and text) and size (UTF-8 bytes of the text).

    Null roles and texts are empty; equal turns of a conversation go by role and text; rows without a conv_id are
    no conversation's. Rows are sorted in ranges of all of conv_id, turn and what breaks ties, so that a
    conversation of any length is spread; a range counts on where the ranges before it end. Texts move only where
    turns tie: else their digest does.
    """
    ship_package(conversations.sparkSession)
    rows = conversations.filter(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role, "role"), (text, "text"))])
    tied = settled(rows.groupBy("conv_id", "turn").count().filter("count > 1").select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.lit(True).alias("_tied")))
    if tied.head(1):
        rows = rows.join(tied, (F.col("conv_id") == F.col("_c")) & F.col("turn").eqNullSafe(F.col("_t")), "left")
        first, second = F.when(F.col("_tied"), F.col("role")), F.when(F.col("_tied"), F.col("text"))
    else:
        first = second = F.lit(None).cast("string")
    label = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    # equal rows are told apart by where they stand, so that any number of them is spread; which one comes first is all the same
    rows = rows.select("conv_id", "turn", first.alias("_a"), second.alias("_b"), F.monotonically_increasing_id().alias("_row"), label.alias("label"), F.octet_length("text").cast("long").alias("size"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("_a"), F.col("_b"), F.col("_row")]
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", F.spark_partition_id().alias("range"), "label", "size")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n = None, 0
        for batch in batches:
            places = []
            for c in batch.column(0).to_pylist():
                own, n = c, (n + 1 if c == own else 0)
                places.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], [*batch.schema.names, "place"])

    turns = settled(sorted_.mapInArrow(count, "conv_id long, range int, label binary, size long, place long"))
    ends = turns.groupBy("conv_id", "range").agg((F.max("place") + 1).alias("n"))
    cut = ends.join(ends.groupBy("conv_id").count().filter("count > 1").select("conv_id"), "conv_id")
    before = F.coalesce(F.sum("n").over(W.Window.partitionBy("conv_id").orderBy("range").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    carried = cut.select("conv_id", "range", before.alias("before"))  # at most two rows a range
    return turns.join(F.broadcast(carried), ["conv_id", "range"], "left").select("conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("pos"), "label", "size")


def rebuilt(turns: DataFrame, family: int = FAMILY, borrowed: int = BORROWED) -> tuple[DataFrame, DataFrame]:
    """(turns, ids): every conversation c begins with the first h turns of c - c % family (all if fewer, none if absent)
    and goes on with its own turns after its first h; h = crc32(c as text) % borrowed. ids: conv_id, total (turns)."""
    h = lambda c: F.crc32(c.cast("string")) % borrowed
    n = settled(turns.groupBy("conv_id").agg(F.count("*").alias("n")))
    first = n.select(F.col("conv_id").alias("_first"), F.col("n").alias("_n"))
    c = F.col("conv_id")
    ids = n.withColumn("_first", c - c % family).join(first, "_first", "left").withColumn("taken", F.least(h(c), F.coalesce("_n", F.lit(0).cast("long"))))
    ids = settled(ids.select("conv_id", "taken", (F.col("taken") + F.greatest(F.col("n") - h(c), F.lit(0))).alias("total")))
    own = turns.filter(F.col("pos") >= h(c)).select("conv_id", (F.col("pos") - h(c)).alias("pos"), F.lit(True).alias("_own"), "label", "size")
    lent = turns.filter((F.col("pos") < borrowed) & (c % family == 0)).withColumn("_to", F.explode(F.sequence(c - (family - 1), c + (family - 1))))
    lent = lent.filter((F.col("_to") - F.col("_to") % family == c) & (F.col("pos") < h(F.col("_to")))).select(F.col("_to").alias("conv_id"), "pos", F.lit(False).alias("_own"), "label", "size")
    out = own.unionByName(lent).join(ids, "conv_id").select("conv_id", "total", F.when(F.col("_own"), F.col("pos") + F.col("taken")).otherwise(F.col("pos")).alias("pos"), "label", "size")
    return out, ids.select("conv_id", "total")


def _cut_prefixes(full: DataFrame, n: int) -> DataFrame:
    """conv_id, k, name of the first k rows' prefix, for every k up to the number of full rows (row, block) of a conversation.

    Blocks of twice the height are named from the names of their halves, then prefixes from the top down: a cut
    halves the height, and all cuts of one height are named in one join.
    """
    levels, heights = [full.select("conv_id", F.col("row").alias("i"), F.col("block").alias("b"))], max(1, n.bit_length())
    for _ in range(heights - 1):
        halves = levels[-1].groupBy("conv_id", F.expr("i div 2").alias("i")).agg(F.max(F.when(F.col("i") % 2 == 0, F.col("b"))).alias("_l"), F.max(F.when(F.col("i") % 2 == 1, F.col("b"))).alias("_r"))
        levels.append(settled(halves.filter("_l IS NOT NULL AND _r IS NOT NULL").select("conv_id", "i", _joined("b", F.col("_l"), F.col("_r")).alias("b"))))
    names = None
    for k in reversed(range(heights)):
        upper = levels[k].filter("i % 2 = 0").select("conv_id", F.shiftleft("i", k).alias("k"), F.shiftleft(F.col("i") + 1, k).alias("to"), "b")
        new = upper.filter("k = 0").select("conv_id", F.col("to").alias("k"), _joined("p", F.lit(bytearray(ROOT)), F.col("b")).alias("name"))
        if names is not None:
            below = upper.filter("k > 0").join(names, ["conv_id", "k"])
            new = names.unionByName(new).unionByName(below.select("conv_id", F.col("to").alias("k"), _joined("p", F.col("name"), F.col("b")).alias("name")))
        names = settled(new)
    return names


def named_paths(turns: DataFrame, leaf: int = LEAF) -> DataFrame:
    """conv_id, row, total, parent (name of the prefix before the row), names (of the prefixes that end in it) and sizes; a row holds up to `leaf` turns."""
    ship_package(turns.sparkSession)
    rows = turns.groupBy("conv_id", F.expr(f"pos div {leaf}").alias("row")).agg(F.sort_array(F.collect_list(F.struct("pos", "label", "size"))).alias("_t"), F.first("total").alias("total"))
    rows = settled(rows.select("conv_id", "row", "total", F.col("_t.label").alias("labels"), F.col("_t.size").alias("sizes")))
    full = rows.filter(F.size("labels") == leaf)
    most = full.agg(F.max("row")).first()[0]
    parent, end = F.lit(bytearray(ROOT)), F.lit(None).cast("binary")
    if most is not None:

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(map(block_name, batch.column(2).to_pylist())), pa.binary())], ["conv_id", "row", "block"])

        cut = _cut_prefixes(settled(full.select("conv_id", "row", "labels").mapInArrow(blocks, "conv_id long, row long, block binary")), most + 1)
        rows = rows.join(cut.select("conv_id", F.col("k").alias("row"), F.col("name").alias("_parent")), ["conv_id", "row"], "left")
        rows = rows.join(cut.select("conv_id", (F.col("k") - 1).alias("row"), F.col("name").alias("_end")), ["conv_id", "row"], "left")
        parent, end = F.coalesce("_parent", parent), F.col("_end")

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [prefix_names(g, x, e, leaf) for g, x, e in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(names, pa.list_(pa.binary())), batch.column(6)], ["conv_id", "row", "total", "parent", "names", "sizes"])

    return settled(rows.select("conv_id", "row", "total", parent.alias("parent"), "labels", end.alias("_end"), "sizes").mapInArrow(name, "conv_id long, row long, total long, parent binary, names array<binary>, sizes array<long>"))


def grafted(nodes: DataFrame, paths: DataFrame, depth: int, leaf: int = LEAF) -> DataFrame:
    """nodes with n_leaves and saved_tokens summed over their subtrees (they come with each node's own).

    Tries of height h that lie below one another are joined to tries of 2h, for all pairs at once: the totals of
    the lower tries' roots are summed for the cut node that they hang on, and each goes to the cut node's
    ancestors in the upper trie, which are the path of its smallest member. Every node is written log2(depth)
    times, and a round makes at most one row for each prefix of a path.
    """
    kept = [c for c in nodes.columns if c not in ("name", "n_leaves", "saved_tokens")]
    h = 1
    while h < depth:
        roots = nodes.filter((F.col("depth") - 1) % (2 * h) == h).groupBy("parent", "depth").agg(F.max("parent_conv_id").alias("conv_id"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
        cut = roots.withColumn("_to", F.col("depth") - 1).withColumn("_from", F.col("_to") - h)  # ancestors have depths over _from, up to _to
        cut = cut.withColumn("row", F.explode(F.sequence(F.expr(f"_from div {leaf}"), F.expr(f"(_to - 1) div {leaf}"))))
        start = F.greatest(F.col("_from") - F.col("row") * leaf, F.lit(0))
        own = F.slice("names", (start + 1).cast("int"), (F.least(F.col("_to") - F.col("row") * leaf, F.lit(leaf)) - start).cast("int"))
        new = cut.join(paths.select("conv_id", "row", "names"), ["conv_id", "row"]).select(F.explode(own).alias("name"), "n_leaves", "saved_tokens")
        both = nodes.unionByName(new, allowMissingColumns=True).groupBy("name")
        nodes = settled(both.agg(*[F.max(c).alias(c) for c in kept], F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")))
        h *= 2
    return nodes


def ends_digests(ends: DataFrame) -> DataFrame:
    """name, ends_sha256 of (name, conv_id): SHA-256 of a name's ids in order, comma-joined.

    Ids are sorted in ranges of name and id, which cut a large group, and leave them as pieces of joined text. A
    digest reads its bytes in order by its nature: one task streams the pieces of a name and holds one at a time.
    """
    ship_package(ends.sparkSession)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ids, done = None, [], ([], [], [])
        for batch in batches:
            for name, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name != own or len(ids) == PIECE:
                    if ids:
                        for column, value in zip(done, (own, ids[0], ",".join(map(str, ids))), strict=True):
                            column.append(value)
                    own, ids = name, []
                ids.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(done, (pa.binary(), pa.int64(), pa.string()), strict=True)], ["name", "first", "ids"])
            done = ([], [], [])
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([own], pa.binary()), pa.array(ids[:1], pa.int64()), pa.array([",".join(map(str, ids))], pa.string())], ["name", "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state = None, None
        for batch in batches:
            names, found = [], []
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name == own:
                    state.update(b"," + ids.encode())
                    continue
                if own is not None:
                    names.append(own)
                    found.append(state.hexdigest())
                own, state = name, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(found, pa.string())], ["name", "ends_sha256"])
        if own is not None:
            yield pa.RecordBatch.from_arrays([pa.array([own], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["name", "ends_sha256"])

    cut = ends.select("name", "conv_id").repartitionByRange("name", "conv_id").sortWithinPartitions("name", "conv_id").mapInArrow(pieces, "name binary, first long, ids string")
    return cut.repartition("name").sortWithinPartitions("name", "first").select("name", "ids").mapInArrow(digests, "name binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, ids: DataFrame, leaf: int = LEAF) -> DataFrame:
    """One row per distinct prefix of the sequences: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: conv_id, total, pos (gapless from 0), label (bytes that name a turn), size; ids: conv_id (once each),
    total (0 for those without a turn). The root has depth 0 and every id as a member; without ids there is no
    row. No sequence is held by one task, however long: rows hold `leaf` turns.
    """
    least, n, deepest, without = ids.agg(F.min("conv_id"), F.count("*"), F.max("total"), F.count(F.when(F.col("total") == 0, 1))).first()
    paths = named_paths(turns, leaf)
    at = F.posexplode(F.arrays_zip("names", "sizes"))
    prefixes = paths.select("conv_id", "row", "total", "parent", "names", at.alias("i", "_p"))
    depth = F.col("row") * leaf + F.col("i") + 1
    prefixes = prefixes.select("conv_id", "total", depth.alias("depth"), F.col("_p.names").alias("name"), F.col("_p.sizes").alias("size"), F.when(F.col("i") == 0, F.col("parent")).otherwise(F.get("names", F.col("i") - 1)).alias("parent"))
    nodes = settled(prefixes.groupBy("name").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.count("*").alias("n_convs"), F.max("size").alias("size")))
    children = nodes.groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    ends = prefixes.filter("depth = total").select("name", "conv_id").unionByName(ids.filter("total = 0").select(F.lit(bytearray(ROOT)).alias("name"), "conv_id"))

    first = nodes.filter("depth = 1").withColumn("parent_conv_id", F.lit(least).cast("long"))
    above = nodes.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    linked = first.unionByName(nodes.filter("depth > 1").join(above, "parent"))
    linked = linked.join(children, "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    own = settled(linked.select("name", "conv_id", "depth", "parent", "parent_conv_id", "n_convs", "n_children", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens")))
    top = own.agg(F.count(F.when(F.col("depth") == 1, 1)), F.sum("n_leaves"), F.sum("saved_tokens")).first()
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    root = ids.sparkSession.createDataFrame([(ROOT, least, 0, None, n, top[0], top[1] or 1, top[2] or 0)] if n else [], "name binary, " + ", ".join(f"{c} long" for c in out))
    found = grafted(own, paths, deepest or 0, leaf).select("name", *out).unionByName(root)
    return found.join(ends_digests(ends), "name", "left").select(*out, F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of the rebuilt conversations; odd rows are treated as in ordered_turns, and an empty table gives no row."""
    turns, ids = rebuilt(ordered_turns(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))
    return prefix_trie(turns, ids)


_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(s) + 1), lambda i: ascii(s[i])::BIGINT)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, (y & 1) * 3988292384))), 4294967295::BIGINT)"
OP13_SQL = f"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    n AS (SELECT c, n, c - c % {FAMILY} AS b, {_CRC} % {BORROWED} AS h FROM (SELECT c, count(*) AS n, CAST(c AS VARCHAR) AS s FROM t GROUP BY c)),
    i AS (SELECT n.c, n.b, n.h, least(n.h, coalesce(f.n, 0)) AS taken FROM n LEFT JOIN n f ON f.c = n.b),
    r AS (SELECT i.c, t.pos + 1 AS depth, role, text FROM i JOIN t ON t.c = i.b AND t.pos < i.taken UNION ALL SELECT i.c, t.pos - i.h + i.taken + 1, role, text FROM i JOIN t ON t.c = i.c AND t.pos >= i.h),
    totals AS (SELECT i.c, count(r.c) AS total FROM i LEFT JOIN r ON r.c = i.c GROUP BY i.c),
    p AS (SELECT c, depth, strlen(text) AS size, list({{'r': role, 't': text}}) OVER (PARTITION BY c ORDER BY depth) AS prefix FROM r),
    a AS MATERIALIZED (SELECT c, depth, size, dense_rank() OVER (ORDER BY prefix) AS node FROM p UNION ALL SELECT c, 0, 0, 0 FROM i),
    nodes AS MATERIALIZED (SELECT node, min(c) AS conv_id, max(depth) AS depth, count(*) AS n_convs, max(size) AS size, coalesce(string_agg(CASE WHEN depth = total THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '') AS ends FROM a JOIN totals USING (c) GROUP BY node),
    links AS (SELECT n.node, p.node AS parent FROM nodes n JOIN a p ON p.c = n.conv_id AND p.depth = n.depth - 1),
    children AS (SELECT parent AS node, count(*) AS n_children FROM links GROUP BY parent),
    below AS (SELECT a.node, sum((n.n_convs - 1) * n.size) AS saved_tokens, count(*) FILTER (WHERE k.n_children IS NULL) AS n_leaves FROM nodes n LEFT JOIN children k ON k.node = n.node JOIN a ON a.c = n.conv_id AND a.depth <= n.depth GROUP BY a.node)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, m.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, b.n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN below b ON b.node = n.node LEFT JOIN children k ON k.node = n.node LEFT JOIN links l ON l.node = n.node LEFT JOIN nodes m ON m.node = l.parent
"""
