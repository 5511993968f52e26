"""License scans: base phrases, and an exact set-similarity join of text blocks with license templates."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, read, settled
from .rules import let

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Fixed phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Template texts by label; their words are the sets that blocks are compared with.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl-2", "this work is licensed under the gnu general public license version 2"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 3"),
    ("lgpl-3", "this work is licensed under the gnu lesser general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc0", "dedicated to the public domain under cc0 1 0"),
]
#: Share of a template's distinct words that a block must hold.
CONTAINMENT = 0.9
#: Words in a block, as a multiple of the template's (rounded up).
SPAN = 1.5


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), SEPARATORS), "")


def _starts(words: Column, joined: Column, phrase: str) -> Column:
    """Word numbers (from 0) at which the phrase's words stand one after the other."""
    own = phrase.split(" ")

    def here(i: Column) -> Column:
        hit = F.get(words, i) == own[0]
        for j, word in enumerate(own[1:], 1):
            hit = hit & (F.get(words, i + j) == word)
        return hit

    none = F.array().cast("array<int>")
    return F.when(F.contains(joined, F.lit(f" {phrase} ")), F.filter(F.sequence(F.lit(0), F.size(words) - len(own)), here)).otherwise(none)


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    need: int
    length: int


def templates_of(templates: list[tuple[str, str]], containment: float = CONTAINMENT, span: float = SPAN) -> list[Template]:
    """Distinct words of each template, how many of them a block must hold, and a block's length in words."""
    out = []
    for label, text in templates:
        words = [w for w in re.split(SEPARATORS, text.lower()) if w]
        own = tuple(sorted(set(words)))
        out.append(Template(label, own, math.ceil(round(containment * len(own), 9)), math.ceil(round(span * len(words), 9))))
    return out


def _met(around: Column, at: Column, ranks: Column, size: Column, need: Column, length: Column, rivals: Column) -> Column:
    """Starts of the blocks around place `at` that meet a template: a struct of the words held and whether a rival covers them.

    around: ranks of the words near the place (-1: no template word); a block starts with one of the template's words.
    """

    def block(start: Column) -> Column:
        last = lambda run, own: F.array_max(F.transform(own, lambda r: F.array_position(run, r))).cast("int")  # noqa: E731  how far the run goes until the last of the words has come up
        return let(F.slice(around, start + 1, length), lambda run: let(F.array_distinct(F.filter(run, lambda r: F.array_contains(ranks, r))), lambda own: F.struct(F.size(own).alias("held"), let(last(run, own), lambda n: shortest(start, n, run, own)).alias("covered"))))

    def shortest(start: Column, n: Column, run: Column, own: Column) -> Column:
        """Whether the shortest run that ends where the block's words are complete, and still holds them all, is covered."""
        first = lambda back: start + n - F.array_max(F.transform(own, lambda r: F.array_position(back, r))).cast("int")
        return let(first(F.reverse(F.slice(run, 1, n))), lambda at: covered(at, start + n - 1, own))

    def covered(start: Column, end: Column, own: Column) -> Column:
        """Whether a block of a rival template lies around these words, which are all its own, and holds more words (or as many of a smaller template)."""

        def by(rival: Column) -> Column:
            first = F.greatest(end - rival["length"] + 1, F.lit(0))
            holds = lambda w: let(F.size(F.array_intersect(F.slice(around, w + 1, rival["length"]), rival["ranks"])), lambda n: (n >= rival["need"]) & ((n > F.size(own)) | ((n == F.size(own)) & (F.size(rival["ranks"]) < size))))
            return F.when((F.size(F.array_except(own, rival["ranks"])) == 0) & (first <= start), F.exists(F.sequence(first, start), holds)).otherwise(F.lit(False))

        return F.when(F.size(own) >= need, F.exists(rivals, by)).otherwise(F.lit(True))

    starts = F.filter(F.sequence(F.greatest(at - length + 1, F.lit(0)), at), lambda i: F.array_contains(ranks, F.get(around, i)))
    return F.filter(F.transform(starts, block), lambda b: b["held"] >= need)


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT, span: float = SPAN) -> DataFrame:
    """The keep columns, n_words, starts (of base phrases), base_labels, block_labels, containment.

    A block is a run of consecutive words, across line breaks, that starts with one of a template's words and
    is `span` times as long as the template. It meets the template if it holds at least `containment` of the
    template's distinct words. Every template that some block meets gives its label, unless all such blocks are
    covered: the words held all belong to another template too, of which a block around them holds more, or as
    many of a smaller one (as the words of "gpl version 2" within "gpl version 3"). containment is the largest share that a block holds.

    One pass over the texts notes which template words each holds, and keeps the text only where these could
    reach a template; document frequencies of these words, over all documents, give the global order in
    which tokens are sorted rare first. Words of the templates' prefixes (the tokens one of which any
    sufficient block must hold) are then joined with the templates, pruned by how many tokens stand near and
    by position in the order, and verified. Templates and their words are a parameter, so the broadcast side
    does not grow with the data. Null and empty texts have no words and labels; long texts are read whole;
    null or repeated keys are rows of their own; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    sets = templates_of(templates, containment, span)
    vocabulary = sorted({w for t in sets for w in t.words})
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    literal = lambda own: F.array(*[F.lit(w) for w in own])

    def of_words(words: Column) -> Column:
        # base phrases need the words in a row, so they are looked for only where all of a phrase's words occur
        starts = let(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), lambda joined: F.struct(*[_starts(words, joined, p).alias(f"s{i}") for i, p in enumerate(phrases)]))
        return F.struct(F.size(words).cast("long").alias("n_words"), starts.alias("starts"), F.array_intersect(words, literal(vocabulary)).alias("hits"))

    first = docs.select(*keep, value.alias("_text"), let(words_of(value), of_words).alias("_w"))
    reach = F.lit(False)
    for t in sets:
        reach = reach | (F.size(F.array_intersect(F.col("_w.hits"), literal(t.words))) >= t.need)
    rows = settled(first.select(*keep, "_w.n_words", "_w.starts", "_w.hits", F.when(reach, F.xxhash64("_text")).alias("_key"), F.when(reach, F.crc32("_text")).alias("_crc"), F.when(reach, F.col("_text")).alias("_text")))

    frequency = {r["w"]: r["n"] for r in rows.select(F.explode("hits").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}  # as many rows as template words at most
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w)))}
    ranked = [sorted(order[w] for w in t.words) for t in sets]
    index = []
    for n, (t, own) in enumerate(zip(sets, ranked, strict=True)):
        rivals = [(other, o.need, o.length) for m, (o, other) in enumerate(zip(sets, ranked, strict=True)) if m != n and len(set(own) & set(other)) >= t.need]
        index += [(rank, n, t.label, place, t.need, t.length, own, rivals) for place, rank in enumerate(own[: len(own) - t.need + 1])]
    prefixes = F.broadcast(spark.createDataFrame(index, "rank int, template int, label string, place int, need int, length int, ranks array<int>, rivals array<struct<ranks array<int>, need int, length int>>"))

    rank_of = F.create_map(*[x for w, i in order.items() for x in (F.lit(w), F.lit(i))])
    prefix = F.array(*[F.lit(r) for r in sorted({row[0] for row in index})])
    far = max(t.length for t in sets)

    def tokens_of(words: Column) -> Column:
        """Place, rank and surroundings of every prefix word."""
        places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))), lambda i: F.array_contains(prefix, F.get(words, i)))
        from_ = lambda i: F.greatest(i - far + 1, F.lit(0))
        return F.transform(places, lambda i: F.struct(F.get(words, i).alias("rank"), (i - from_(i)).alias("at"), F.slice(words, from_(i) + 1, i - from_(i) + far).alias("around")))

    near = rows.filter("_text IS NOT NULL").select("_key", "_crc", F.explode(let(F.transform(words_of(F.col("_text")), lambda w: F.coalesce(rank_of[w], F.lit(-1))), tokens_of)).alias("_t")).select("_key", "_crc", "_t.*")
    pairs = near.join(prefixes, "rank").filter(F.size(F.array_distinct(F.filter("around", lambda x: x >= F.col("rank")))) >= F.col("need"))
    met = pairs.select("_key", "_crc", "label", F.size("ranks").alias("_size"), F.explode(_met(F.col("around"), F.col("at"), F.col("ranks"), F.size("ranks"), F.col("need"), F.col("length"), F.col("rivals"))).alias("_b"))
    labels = met.groupBy("_key", "_crc").agg(F.collect_set(F.when(~F.col("_b.covered"), F.col("label"))).alias("block_labels"), F.max(F.col("_b.held") / F.col("_size")).alias("containment"))
    none = F.array().cast("array<string>")
    base = F.array_compact(F.array(*[F.when(F.size(F.col(f"starts.s{i}")) > 0, F.lit(label)) for i, label in enumerate(phrases.values())]))
    # only texts within reach are joined; the others keep no key
    out = rows.filter("_text IS NOT NULL").drop("_text").join(labels, ["_key", "_crc"], "left").drop("_key", "_crc").unionByName(rows.filter("_text IS NULL").drop("_text", "_key", "_crc"), allowMissingColumns=True)
    return out.select(*keep, "n_words", F.flatten(F.array(*[F.col(f"starts.s{i}") for i in range(len(phrases))])).alias("starts"), F.array_sort(F.array_distinct(base)).alias("base_labels"), F.array_sort(F.coalesce("block_labels", none)).alias("block_labels"), F.coalesce("containment", F.lit(0.0)).alias("containment"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with its base phrases and licence labels; null and empty texts have none, and odd rows are treated as in scan."""
    out = scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    score = F.when(F.size("base_labels") > 0, F.lit(1.0)).otherwise(F.col("containment"))
    return out.select("doc_id", "n_words", F.size("starts").cast("long").alias("n_base"), F.array_min("starts").cast("long").alias("first_word"), F.array_max("starts").cast("long").alias("last_word"), F.array_join("base_labels", ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union("base_labels", "block_labels")), ",").alias("labels"), score.alias("score"))


def _sql() -> str:
    """Every block of every template, compared word by word."""
    templates = ", ".join(f"({i}, '{t.label}', {list(t.words)!r}, {t.need}, {t.length})" for i, t in enumerate(templates_of(TEMPLATES)))
    phrases = ", ".join(f"('{phrase}', {len(phrase.split(' '))}, '{label}')" for phrase, label in PHRASES.items())
    return rf"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d),
p(phrase, k, label) AS (VALUES {phrases}),
i AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, w FROM w WHERE text LIKE '%license%' OR text LIKE '%nc%'),
s AS (SELECT doc_id, i - 1 AS i, label FROM i JOIN p ON array_to_string(w[i:i + k - 1], ' ') = phrase),
b AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels, list(DISTINCT label) AS base FROM s GROUP BY doc_id),
t(t, label, words, need, span) AS (VALUES {templates}),
c AS (SELECT doc_id, w FROM w WHERE EXISTS (SELECT 1 FROM t WHERE len(list_intersect(list_distinct(w.w), t.words)) >= t.need)),
a AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM c),
h AS (SELECT doc_id, t, word, i FROM a JOIN (SELECT t, unnest(words) AS word FROM t) USING (word)),
n AS (SELECT x.doc_id, x.t, x.i AS s, y.word, min(y.i) AS e FROM h x JOIN t USING (t) JOIN h y ON y.doc_id = x.doc_id AND y.t = x.t AND y.i BETWEEN x.i AND x.i + t.span - 1 GROUP BY ALL),
m0 AS (SELECT doc_id, t, s, max(e) AS e, list(word) AS own FROM n GROUP BY ALL),
g AS (SELECT doc_id, t, s, min(last) AS tight FROM (SELECT m0.doc_id, m0.t, m0.s, h.word, max(h.i) AS last FROM m0 JOIN h ON h.doc_id = m0.doc_id AND h.t = m0.t AND h.i BETWEEN m0.s AND m0.e GROUP BY ALL) GROUP BY ALL),
m AS (SELECT m0.*, tight FROM m0 JOIN g USING (doc_id, t, s)),
f AS (SELECT m.*, t.label, t.words FROM m JOIN t USING (t) WHERE len(own) >= need),
r AS (SELECT f.doc_id, f.t, s, e, own, len(f.words) AS size, b.t AS b, b.need, b.span, len(b.words) AS bsize, unnest(range(greatest(0, e - b.span + 1), tight + 1)) AS at FROM f JOIN t b ON b.t <> f.t AND list_has_all(b.words, own)),
v AS (SELECT DISTINCT doc_id, t, s FROM (SELECT r.doc_id, r.t, s, r.own, size, need, bsize, r.b, r.at, count(DISTINCT h.word) AS o FROM r JOIN h ON h.doc_id = r.doc_id AND h.t = r.b AND h.i BETWEEN r.at AND r.at + r.span - 1 GROUP BY ALL)
  WHERE o >= need AND (o > len(own) OR (o = len(own) AND bsize < size))),
l AS (SELECT doc_id, list(DISTINCT label) FILTER (v.t IS NULL) AS found, max(len(own) / len(words)) AS held FROM f LEFT JOIN v USING (doc_id, t, s) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(found, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0e0 ELSE coalesce(held, 0.0e0) END AS score
FROM w LEFT JOIN b USING (doc_id) LEFT JOIN l USING (doc_id)
"""


OP4_SQL = _sql()
