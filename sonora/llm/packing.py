"""Packs token sequences by bulk-synchronous best fit."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cached_property

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship_package
from .common import ranked, read, settled

#: Closes every document.
END_ID = 0
#: Words whose ids a Python worker remembers (about 100 bytes each); it starts anew when they are reached.
CACHE_WORDS = 200_000
#: Ranges of the token axis that are swept each by a task.
RANGES = 16
#: Runs that are broadcast at most (about 60 bytes each); beyond, they are joined by a shuffle.
BROADCAST_RUNS = 500_000
#: A space that isn't surely the start of a pre-token.
ODD_SPACE = re.compile(r" (?:\s|\Z)|\A ")

_encoders: dict[str, Encoder] = {}


class Encoder:
    """Ids of a byte-level BPE vocabulary as packed little-endian unsigned 32-bit numbers.

    A space before anything but white space always starts a pre-token, so a text's ids are those of its
    space-separated parts in turn; parts are looked up in a bounded memory. Other texts, and those that
    hold a special token's string, are encoded whole.
    """

    def __init__(self, vocabulary: str, special: list[str]):
        import base64

        import public_tokenizers
        import tiktoken

        self.vocabulary, self.special = vocabulary, special
        ranks_file = public_tokenizers.path(vocabulary.replace(".json", ".tiktoken"))
        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.part = tiktoken.Encoding("part", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.cache: dict[str, bytes] = {}

    @cached_property
    def whole(self):
        """The tokenizer itself, read once a text needs it."""
        return _tokenizer(self.vocabulary)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        if ODD_SPACE.search(text):
            return array("I", self.part(text)).tobytes()
        first, *parts = text.split(" ")
        found: list = list(map(self.cache.get, parts))
        if None in found:
            if len(self.cache) > CACHE_WORDS:
                self.cache.clear()
            i = -1
            for _ in range(found.count(None)):
                i = found.index(None, i + 1)
                word = parts[i]
                if (ids := self.cache.get(word)) is None:
                    ids = self.cache[word] = array("I", self.part(" " + word)).tobytes()
                found[i] = ids
        return array("I", self.part(first)).tobytes() + b"".join(found)


def _tokenizer(vocabulary: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(vocabulary))


def special_strings(vocabulary: str) -> list[str]:
    return [t.content for t in _tokenizer(vocabulary).get_added_tokens_decoder().values()]


def _encoder(vocabulary: str, special: list[str]) -> Encoder:
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary, special)
    return _encoders[vocabulary]


def pieces(docs: DataFrame, capacity: int, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the token sequence of each text and END_ID, cut only beyond the capacity, where all pieces but the first are full.

    Null and empty texts are END_ID alone; null and repeated ids are documents of their own; no rows give no pieces.
    """
    ship_package(docs.sparkSession)
    special = special_strings(vocabulary)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary, special)
        end = array("I", [END_ID]).tobytes()
        for batch in batches:
            rows: tuple[list, list, list, list, list] = ([], [], [], [], [])
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.encode(value.as_py() or "") + end
                total = len(ids) // 4
                start, stop = 0, total % capacity or capacity
                while start < total:
                    for column, x in zip(rows, (key, len(rows[0]), start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])), strict=True):
                        column.append(x)
                    rows[1][-1] = 0 if start == 0 else rows[1][-2] + 1
                    start, stop = stop, stop + capacity
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sweep(gaps: list[tuple[int, int, int]], lengths: list[tuple[int, int, int]], capacity: int) -> tuple[list, list, list, list]:
    """Matches documents and gaps by successors, from the longest document down.

    gaps: (gap, first sequence, sequences); lengths: (length, first rank, documents). A document claims the
    smallest gap that holds it and is not yet claimed; where several want one, their rank decides and the
    rest go on to the next larger gap. A sequence takes as many documents of one length as its gap holds,
    and is not claimed again in this sweep. Returns placed runs (length, first rank, documents, documents in
    a sequence, first sequence, offset), the gaps that these leave, and the gaps and lengths left over.
    """
    gaps, stack, placed, changed, left = sorted(gaps, reverse=True), [], [], [], []
    at = 0
    for length, rank, n in sorted(lengths, reverse=True):
        while at < len(gaps) and gaps[at][0] >= length:
            stack.append(gaps[at])
            at += 1
        while n and stack:
            gap, sequence, free = stack.pop()
            each = gap // length
            whole = min(free, n // each)
            rest = n - whole * each if whole < free and n - whole * each < each else 0
            for documents, share, first, count in ((whole * each, each, sequence, whole), (rest, rest, sequence + whole, 1)):
                if documents:
                    placed.append((length, rank, documents, share, first, capacity - gap))
                    changed.append((gap - share * length, first, count))
                    rank, n = rank + documents, n - documents
            used = whole + (rest > 0)
            if free > used:
                stack.append((gap, sequence + used, free - used))
        if n:
            left.append((length, rank, n))
    return placed, [c for c in changed if c[0]], stack + gaps[at:], left


def opened(lengths: list[tuple[int, int, int]], capacity: int, first: int) -> tuple[list, list, list, int]:
    """The longest documents each open a sequence, as many as all tokens left need at least: placed runs, gaps, lengths left, next sequence."""
    new = max(1, -(-sum(length * n for length, _, n in lengths) // capacity))
    placed, gaps, left = [], [], []
    for length, rank, n in sorted(lengths, reverse=True):
        take = min(new, n)
        if take:
            placed.append((length, rank, take, 1, first, 0))
            gaps.append((capacity - length, first, take))
            first, new = first + take, new - take
        if n > take:
            left.append((length, rank + take, n - take))
    return placed, [g for g in gaps if g[0]], left, first


STATE = "kind string, value long, first long, n long, each long, sequence long, offset long"


def _read(rows: pd.DataFrame, kind: str) -> list[tuple[int, int, int]]:
    own = rows[rows["kind"] == kind]
    return list(zip(own["value"].tolist(), own["first"].tolist(), own["n"].tolist(), strict=True))


def _written(placed: list, changed: list, gaps: list, lengths: list, others: pd.DataFrame) -> pd.DataFrame:
    rows = [("placed", *p) for p in placed] + [(kind, *x, 0, 0, 0) for kind, own in (("changed", changed), ("gap", gaps), ("length", lengths)) for x in own]
    return pd.concat([pd.DataFrame(rows, columns=others.columns), others]) if rows else others


def best_fit(pieces: DataFrame, capacity: int) -> DataFrame:
    """Bulk-synchronous best fit over classes of equal length: runs length, first, n, each, sequence, offset.

    The state is a table of runs: documents of one length with consecutive ranks, and sequences of one gap
    with consecutive numbers. A round sorts both into RANGES ranges of the token axis, and a task sweeps
    each range; documents that their range has no gap for are then carried to the gaps of larger ranges by
    one more sweep. Gaps are updated, and the next round begins. Where a round places nothing, the longest
    documents open new sequences. A round adds at most one run for each run that it meets, and there are
    at most `capacity` lengths, so the state follows the capacity and the rounds, not the number of pieces;
    the driver only asks whether documents are left.
    """
    ship_package(pieces.sparkSession)
    width = -(-(capacity + 1) // RANGES)

    def in_range(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop(columns="range")
        return _written(*sweep(_read(rows, "gap"), _read(rows, "length"), capacity), rows[rows["kind"] == "next"])

    def carried(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop(columns="all")
        done = rows[rows["kind"].isin(["placed", "changed"])]
        placed, changed, gaps, lengths = sweep(_read(rows, "gap"), _read(rows, "length"), capacity)
        following = int(rows.loc[rows["kind"] == "next", "n"].max())
        if lengths and not placed and not len(done):
            placed, new, lengths, following = opened(lengths, capacity, following)
            gaps = gaps + new
        out = _written(placed, changed, gaps, lengths, done)
        out["kind"] = out["kind"].replace("changed", "gap")
        return pd.concat([out, pd.DataFrame([("next", 0, 0, following, 0, 0, 0)], columns=out.columns)])

    empty = [F.lit(0).cast("long").alias(c) for c in ("each", "sequence", "offset")]
    classes = pieces.groupBy(F.col("length").alias("value")).agg(F.count("*").alias("n")).select(F.lit("length").alias("kind"), "value", F.lit(0).cast("long").alias("first"), "n", *empty)
    state = settled(classes.union(pieces.sparkSession.createDataFrame([("next", 0, 0, 0, 0, 0, 0)], STATE)), capacity)
    runs = state.filter("kind = 'placed'")
    while state.filter("kind = 'length'").head(1):
        ranges = state.filter("kind <> 'placed'").withColumn("range", F.expr(f"value DIV {width}"))
        swept = ranges.groupBy("range").applyInPandas(in_range, STATE)
        state = settled(swept.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(carried, STATE), capacity)
        runs = runs.union(state.filter("kind = 'placed'"))
    return runs.select(F.col("value").alias("length"), "first", "n", "each", "sequence", "offset")


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to pieces (length of 1 to capacity).

    Spark counts the lengths and numbers the pieces of each in hash buckets; best_fit places runs of these
    numbers. Runs are dealt to blocks of numbers, as many as a length has runs, and joined by length and
    block, so a piece meets a few runs whatever their number. Ties and repeated rows are pieces of their own.
    """
    runs = settled(best_fit(pieces, capacity), capacity * RANGES)
    n_runs, n_rows = runs.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    blocks = runs.groupBy("length").agg(F.ceil(F.sum("n") / F.count("*")).cast("long").alias("_width"))  # at most one row a length
    held = F.broadcast if n_runs <= BROADCAST_RUNS else lambda df: df
    last = F.col("first") + F.col("n") - 1
    table = runs.join(F.broadcast(blocks), "length").withColumn("_block", F.explode(F.sequence(F.expr("first DIV _width"), (last / F.col("_width")).cast("long"))))
    rows = ranked(pieces.withColumn("_position", F.monotonically_increasing_id()), ["length"], ["doc_id", "piece", "_position"], n_rows, "_rank", buckets=max(64, n_rows // 50_000))
    rows = rows.join(F.broadcast(blocks), "length").withColumn("_block", F.expr("_rank DIV _width"))
    joined = rows.join(held(table.drop("_width")), ["length", "_block"]).filter((F.col("_rank") >= F.col("first")) & (F.col("_rank") <= last))
    place = F.col("_rank") - F.col("first")
    return joined.select(*pieces.columns, (F.col("sequence") + F.floor(place / F.col("each"))).alias("sequence_id"), (F.col("offset") + place % F.col("each") * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, capacity: int = 2048, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece of END_ID; null and repeated doc_id are documents of their own; an
    empty table has no pieces; other columns are ignored. Every piece stands in one sequence, and the
    pieces of a sequence follow each other without gaps.
    """
    return pack(settled(pieces(docs, capacity, vocabulary)), capacity)


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per piece of every document, with its place in a sequence of at most 2048 tokens; odd rows are treated as in pack_documents."""
    return pack_documents(read(spark, sf_dir, "documents"))
