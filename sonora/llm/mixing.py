"""Mixes sources to target weights by a min-cost flow over membership patterns."""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..runtime import ship_package
from .common import n_words, ranked, read, settled
from .components import components

#: Membership patterns whose decisions are broadcast; more are joined by Spark.
BROADCAST_PATTERNS = 20_000
#: Patterns over sources that overlap, directly or through others: one flow, solved in one task.
LINKED_PATTERNS = 20_000
#: Patterns that a task solves, about, where their sources don't overlap; and sources in a range.
TASK_PATTERNS, RANGE_SOURCES = 5_000, 50_000


def source_targets(sizes: DataFrame, weights: Sequence[float], total: float, most: int = 2) -> DataFrame:
    """Adds _position (0-based, in code point order, null last) and target to rows of _source and size.

    `total` is shared by weight; a target stops at `most` times its size, and the excess is shared again among
    the rest. The share of one weight only rises from round to round, so a round is one sum over all sources.
    """
    place = [F.col("_source") == "n", "_source"]
    ranges = sizes.count() // RANGE_SOURCES + 1
    ranged = settled(sizes.repartitionByRange(ranges, *place).withColumn("_range", F.spark_partition_id()))
    before = W.Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(W.Window.unboundedPreceding, -1)  # a row a range
    first = ranged.groupBy("_range").agg(F.count("*").alias("_n")).withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    own = F.row_number().over(W.Window.partitionBy("_range").orderBy(*place)) - 1
    out = ranged.withColumn("_own", own).join(F.broadcast(first), "_range").withColumn("_position", F.col("_own") + F.col("_first"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_position") % len(weights) + 1).cast("int"))
    out = settled(out.select("_source", "size", "_position", weight.alias("_weight")))
    share, n_full = 0.0, -1
    while True:
        full = (F.col("size") * most <= F.col("_weight") * share) if n_full >= 0 else F.lit(False)
        seen = out.filter("size > 0").agg(F.count_if(full), F.sum(F.when(full, F.col("size") * most)), F.sum(F.when(~full, F.col("_weight")))).first()
        if seen[0] == n_full or not seen[2]:
            break
        n_full, share = seen[0], (total - (seen[1] or 0)) / seen[2]
    target = F.when(F.col("size") > 0, F.least(F.col("_weight") * share, (F.col("size") * most).cast("double"))).otherwise(F.lit(0.0))
    return out.select("_source", "size", "_position", target.alias("target"))


def water_fill(sizes: Sequence[int], weights: Sequence[float], total: float, most: float = 2.0) -> list[float]:
    """Shares `total` by weight, of a short list; source_targets is the same for a table."""
    targets, left, open_ = [0.0] * len(sizes), float(total), [i for i, s in enumerate(sizes) if s > 0]
    while open_ and left > 0:
        share = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if share * weights[i] >= most * sizes[i]]
        if not full:
            for i in open_:
                targets[i] = share * weights[i]
            break
        for i in full:
            targets[i] = most * sizes[i]
            left -= targets[i]
        open_ = [i for i in open_ if i not in full]
    return targets


def min_cost_flow(patterns: Sequence[tuple[Sequence[int], int]], quotas: Sequence[int], epochs: int) -> list[int]:
    """Words that each pattern gives, at the least total repetition cost.

    patterns: (numbers of its sources, words). The k-th repetition of a pattern costs k a word, so costs
    are convex and the cheapest augmenting paths use up one repetition after the other; within one, paths
    may re-route what was sent before (breadth first search over the residual network).
    """
    given = [0] * len(patterns)
    sent: list[dict[int, int]] = [{} for _ in patterns]  # by source
    need = list(quotas)
    takers: dict[int, set[int]] = {}
    for epoch in range(1, epochs + 1):
        for p, (members, words) in enumerate(patterns):
            while given[p] < epoch * words:
                # from p over sources and the patterns that feed them to a source in need
                back: dict[int, tuple[int, int] | None] = {}
                queue, end = deque([p]), None
                visited = {p}
                via: dict[int, tuple[int, int]] = {}
                while queue and end is None:
                    q = queue.popleft()
                    for s in patterns[q][0]:
                        if s in back:
                            continue
                        back[s] = (q, 0)
                        if need[s] > 0:
                            end = s
                            break
                        for r in takers.get(s, ()):
                            if r not in visited and sent[r].get(s, 0) > 0:
                                visited.add(r)
                                via[r] = (s, 0)
                                queue.append(r)
                if end is None:
                    break
                path, s = [], end
                while True:
                    q = back[s][0]
                    path.append((q, s))
                    if q == p:
                        break
                    s = via[q][0]
                amount = min(need[end], epoch * words - given[p])
                for q, s in path[:-1]:
                    amount = min(amount, sent[q][via[q][0]])
                for q, s in path:
                    sent[q][s] = sent[q].get(s, 0) + amount
                    takers.setdefault(s, set()).add(q)
                    if q != p:
                        sent[q][via[q][0]] -= amount
                need[end] -= amount
                given[p] += amount
    return given


def measured(docs: DataFrame, members: Column, size: Column, seed: int = 17, keep: Sequence[str | Column] = ("doc_id",), doc_id: str = "doc_id", alike: Sequence[str | Column] = ()) -> DataFrame:
    """The keep columns, _size (null: 0), _key (the sorted source set; "s" marks a name, "n" is null) and _hash (the place in the seeded order).

    Rows of one id and size, and of the same values in `alike`, share a place; what is drawn among them is a number of rows.
    """
    members = F.when(F.coalesce(F.size(members), F.lit(-1)) < 1, F.array(F.lit(None).cast("string"))).otherwise(members)
    key = F.transform(F.array_sort(F.array_distinct(members)), lambda x: F.coalesce(F.concat(F.lit("s"), x.cast("string")), F.lit("n")))
    size = F.coalesce(size, F.lit(0)).cast("long")
    return docs.select(*keep, size.alias("_size"), key.alias("_key"), F.xxhash64(F.lit(seed), F.col(doc_id), size, *alike).alias("_hash"))


def _given(named: DataFrame, sources: DataFrame, n: int, overlapping: bool, most: int) -> DataFrame:
    """_key, words, given, and size and target of the first source: the flow, solved for each set of overlapping sources on its own."""
    joined = named.join(sources, "_source")
    by = F.sort_array(F.collect_list(F.struct("_at", "_position", "target", "size")))
    patterns = settled(joined.groupBy("_key", "words").agg(by.alias("_m")).withColumn("_first", F.col("_m")[0]["_position"]), n)
    if overlapping:
        links = patterns.select(F.col("_first").alias("u"), F.explode("_m._position").alias("v"))
        patterns = patterns.join(components(links).withColumnRenamed("u", "_first"), "_first", "left").withColumn("_root", F.coalesce("root", "_first"))
        patterns = settled(patterns.drop("root"), n)
        largest = patterns.groupBy("_root").count().agg(F.max("count")).first()[0] or 0
        if largest > LINKED_PATTERNS:
            raise ValueError(f"over {LINKED_PATTERNS} membership patterns of sources that overlap")
    else:
        patterns = patterns.withColumn("_root", F.col("_first"))
    tasks = n // TASK_PATTERNS + 1

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(_key=[list(k) for k in rows["_key"]]).sort_values("_key")
        places = sorted({p for own in rows["positions"] for p in own})
        number = {p: i for i, p in enumerate(places)}
        quotas = [0] * len(places)
        for own, targets in zip(rows["positions"], rows["targets"], strict=True):
            for p, t in zip(own, targets, strict=True):
                quotas[number[p]] = round(t)
        flow = [([number[p] for p in own], int(w)) for own, w in zip(rows["positions"], rows["words"], strict=True)]
        return pd.DataFrame({"_key": rows["_key"], "words": rows["words"], "given": min_cost_flow(flow, quotas, most), "size": rows["size"], "target": rows["target"]})

    ready = patterns.select("_key", "words", F.col("_m._position").alias("positions"), F.col("_m.target").alias("targets"), F.col("_m")[0]["size"].alias("size"), F.col("_m")[0]["target"].alias("target"), F.pmod(F.xxhash64("_root"), F.lit(tasks)).alias("_task"))
    return settled(ready.groupBy("_task").applyInPandas(solve, "_key array<string>, words long, given long, size long, target double"), n)


def decide(rows: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """One row for each membership pattern: how often to take all its documents, and which ones once more.

    Up to the hash _last all are taken once more; of the rows at the hash _next, which share an id and a size,
    _next_rows are, and of those at _closing one is.

    rows: _size, _key, _hash. Sources in code point order, null last, take the weights in turn; targets
    share `share` times all words. Documents are summed by pattern and the flow gives each pattern its
    words, apart for each set of sources that overlap (of at most LINKED_PATTERNS patterns; more are an error, and
    sources that share no document are never linked); whole documents are drawn in the order of a seeded hash until these are reached, with one
    closing document whose size is nearest to what is left.
    """
    ship_package(rows.sparkSession)
    patterns = settled(rows.groupBy("_key").agg(F.sum("_size").alias("words"), F.count("*").alias("rows")))
    n, n_rows, words, widest = patterns.agg(F.count("*"), F.sum("rows"), F.sum("words"), F.max(F.size("_key"))).first()
    small = F.broadcast if n <= BROADCAST_PATTERNS else lambda df: df
    named = patterns.select("_key", "words", F.posexplode("_key").alias("_at", "_source"))
    sources = settled(source_targets(named.groupBy("_source").agg(F.sum("words").alias("size")), weights, share * (words or 0), most), n * (widest or 1))
    given = _given(named, sources, n, (widest or 1) > 1, most)
    buckets = max(1, (n_rows or 0) // 20_000)
    per = F.greatest(F.col("words"), F.lit(1))
    plan = given.select("_key", F.floor(F.col("given") / per).alias("_whole"), (F.col("given") % per).alias("_part"), F.col("size").alias("_source_size"), F.col("target").alias("_target"), F.lit(buckets).alias("_buckets"))

    # Documents before the bucket in which the running sum passes the part are in; only that bucket is sorted.
    rows = rows.join(small(plan), "_key").withColumn("_bucket", F.pmod("_hash", F.lit(buckets)).cast("int"))
    before = W.Window.partitionBy("_key").orderBy("_bucket").rowsBetween(W.Window.unboundedPreceding, -1)
    sums = rows.groupBy("_key", "_bucket").agg(F.sum("_size").alias("_words"), F.first("_part").alias("_cap")).withColumn("_below", F.coalesce(F.sum("_words").over(before), F.lit(0)))
    edge = sums.filter((F.col("_below") < F.col("_cap")) & (F.col("_below") + F.col("_words") >= F.col("_cap"))).select("_key", F.col("_bucket").alias("_edge"), F.col("_below"))
    plan = settled(plan.join(small(edge), "_key", "left"), n)
    rows = rows.select("_key", "_size", "_hash", "_bucket").join(small(plan), "_key")
    run = W.Window.partitionBy("_key").orderBy("_hash").rangeBetween(W.Window.unboundedPreceding, W.Window.currentRow)
    inside = rows.filter(F.col("_bucket") == F.col("_edge")).groupBy("_key", "_hash").agg(F.sum("_size").alias("_words"), F.max("_size").alias("_own"), F.first("_below").alias("_start"), F.first("_part").alias("_cap"))
    inside = inside.withColumn("_sum", F.col("_start") + F.sum("_words").over(run))
    whole, left = F.col("_sum") <= F.col("_cap"), F.col("_cap") - (F.col("_sum") - F.col("_words"))
    next_ = F.min(F.when(~whole, F.struct(F.col("_hash").alias("hash"), F.floor(left / F.greatest(F.col("_own"), F.lit(1))).alias("rows"), F.col("_own").alias("size"))))
    last = inside.groupBy("_key").agg(F.max(F.when(whole, F.col("_hash"))).alias("_last"), F.max(F.when(whole, F.col("_sum"))).alias("_got"), next_.alias("_n"))
    last = last.select("_key", "_last", "_got", F.col("_n.hash").alias("_next"), F.coalesce("_n.rows", F.lit(0)).alias("_next_rows"), F.coalesce(F.col("_n.rows") * F.col("_n.size"), F.lit(0)).alias("_next_words"))
    plan = settled(plan.join(small(last), "_key", "left"), n)
    rows = rows.select("_key", "_size", "_hash", "_bucket").join(small(plan), "_key").withColumn("_gap", F.col("_part") - F.coalesce("_got", "_below", F.lit(0)) - F.coalesce("_next_words", F.lit(0)))
    near = rows.filter(~_drawn() & ~F.coalesce((F.col("_hash") == F.col("_next")) & (F.col("_next_rows") > 0), F.lit(False)) & (F.col("_part") > 0) & (F.col("_size") > 0)).groupBy("_key").agg(F.min(F.struct(F.abs(F.col("_size") - F.col("_gap")).alias("off"), F.col("_hash").alias("hash"), F.col("_gap").alias("gap"))).alias("m"))
    near = near.filter("m.off < m.gap").select("_key", F.col("m.hash").alias("_closing"))
    plan = settled(plan.join(small(near), "_key", "left"), n)
    closing = rows.select("_key", "_hash").join(small(plan.select("_key", F.col("_closing").alias("_hash"))), ["_key", "_hash"])
    several = closing.groupBy("_key").agg(F.count("*").alias("_closing_rows"))
    return settled(plan.join(small(several), "_key", "left").withColumn("_tied", F.coalesce((F.col("_next_rows") > 0) | (F.col("_closing_rows") > 1), F.lit(False))), n)


def _drawn() -> Column:
    bucket = F.pmod(F.col("_hash"), F.col("_buckets"))
    return F.coalesce((F.col("_part") > 0) & ((bucket < F.col("_edge")) | ((bucket == F.col("_edge")) & (F.col("_hash") <= F.col("_last")))), F.lit(False))


def with_copies(rows: DataFrame, decisions: DataFrame, most: int = 2) -> DataFrame:
    """Adds _copies, _source_size and _target (both of the document's first source) to measured rows.

    Up to BROADCAST_PATTERNS patterns rows are not shuffled. Where repeated rows share the place up to which is drawn, these alone are numbered
    in a second pass, in hash buckets of their position, as one repeated row may be a large part of the table.
    """
    own = [c for c in rows.columns if c not in ("_key", "_hash")]
    joined = rows.join(F.broadcast(decisions) if decisions.count() <= BROADCAST_PATTERNS else decisions, "_key")
    closing = F.coalesce(F.col("_hash") == F.col("_closing"), F.lit(False))
    taken = lambda more: F.when(F.col("_size") == 0, F.lit(0)).otherwise(F.least(F.col("_whole") + more.cast("long"), F.lit(most)))
    out = lambda df, more: df.select(*own, "_source_size", "_target", taken(more).cast("int").alias("_copies"))
    if not decisions.filter("_tied").head(1):
        return out(joined, _drawn() | closing)
    tied = closing | F.coalesce(F.col("_hash") == F.col("_next"), F.lit(False))
    some = joined.filter(tied).withColumns({"_position": F.monotonically_increasing_id(), "_group": F.to_json("_key")})
    some = ranked(some, ["_group", "_hash"], ["_position"], 0, "_rank", buckets=64)
    few = F.when(F.col("_hash") == F.col("_next"), F.col("_next_rows")).otherwise(F.lit(0)) + closing.cast("long")
    return out(joined.filter(~tied), _drawn()).unionByName(out(some, F.col("_rank") < few))


def mix_documents(docs: DataFrame, members: Column, size: Column, **parameters) -> DataFrame:
    """docs, each row as often as the mix takes it.

    A size of 0 is never taken; null or empty `members` count as the null source; null ids are documents of
    their own; rows that are equal in all columns are drawn as a number of rows; an empty table gives an empty
    mix; all columns stay. Re-runs draw the same rows.
    """
    alike = [F.xxhash64(*[c for c, kind in docs.dtypes if not kind.startswith("map")])]
    decisions = decide(settled(measured(docs, members, size, keep=(), alike=alike)), **parameters)
    taken = with_copies(measured(docs, members, size, keep=(F.struct(*docs.columns).alias("_row"),), alike=alike), decisions)
    return taken.filter("_copies > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with the words that the mix takes of it.

    Null text: size 0, never taken. The null source comes last. Null ids are documents of their own; among
    rows of one id and size a number of rows is drawn. An empty table gives no rows; long texts count whole.
    """
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rows = settled(measured(docs, F.array("source"), n_words(F.col("text"))))
    out = with_copies(rows, decide(rows))
    return out.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"))
