"""Quality rules: a bitmask ledger of failed rules, versioned policies, and ablations by bitwise aggregation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, read, settled

#: Words in a window that counts as repeated.
WINDOW = 8
SPACES = r"[\x20\x09-\x0D]+"

#: Rule name -> whether a row of measurements fails it; the place in this list is the rule's bit.
RULES: dict[str, Callable[[], Column]] = {
    "few_words": lambda: F.col("n_words") < 20,
    "repeated_words": lambda: 100 * F.col("n_repeat_words") > 30 * F.col("n_words"),
    "symbols": lambda: 10 * F.col("n_symbols") > 3 * F.col("n_words"),
    "repeated_lines": lambda: 100 * F.col("n_dup_lines") > 50 * F.col("n_lines"),
    "shouting": lambda: 2 * F.col("n_upper") > F.col("n_letters"),
    "word_length": lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words")),
}
#: Policy name and version -> the rules that drop a document. The ledger holds all rules, so a new version needs no new pass over texts.
POLICIES: dict[str, tuple[str, ...]] = {
    "base/1": ("few_words", "repeated_words"),
    "web/1": ("few_words", "repeated_words", "symbols", "repeated_lines"),
    "web/2": tuple(RULES),
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def mask_of(rules: tuple[str, ...]) -> int:
    return sum(1 << i for i, name in enumerate(RULES) if name in rules)


def _repeat_words(words: Column) -> Column:
    """Words that stand in a window of WINDOW words which occurs twice or more in the text."""

    def covered(places: Column) -> Column:
        """Each repeated window covers its words up to the start of the next one."""
        steps = F.transform(places, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b.cast("long"))

    def repeated(hashes: Column) -> Column:
        by_hash = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        twins = lambda s: F.filter(s, lambda x, i: (x["h"] == F.get(s, i + 1)["h"]) | ((i > 0) & (x["h"] == F.get(s, F.greatest(i - 1, F.lit(0)))["h"])))
        places = let(by_hash, lambda s: F.array_sort(F.transform(twins(s), lambda x: x["p"])))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(places, covered))

    windows = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, F.lit(WINDOW)))))
    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(let(windows, repeated))


def measures(text: Column) -> Column:
    """A struct of all measurements of a text; each is taken once. Null and empty texts measure 0."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    has_word = lambda line: line.rlike(WORD)

    def of_words(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"), _repeat_words(words).alias("n_repeat_words"))

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    return F.struct(
        let(F.array_remove(F.split(text, SPACES), ""), of_words).alias("words"),
        let(F.filter(F.split(text, "\n"), has_word), of_lines).alias("lines"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count(text, F.lit(r"\p{L}")).cast("long").alias("n_letters"),
    )


def ledger(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The keep columns, every measurement, and failed: a bit for each rule that the text fails.

    Every row of docs is one row of the ledger (null and repeated keys too); a null or empty text fails
    few_words; other columns are ignored. No shuffle and no limit on a text's length.
    """
    found = docs.select(*keep, measures(F.col(text)).alias("_m")).select(*keep, "_m.words.*", "_m.lines.*", "_m.n_symbols", "_m.n_upper", "_m.n_letters")
    bits = [F.when(fails(), F.lit(1 << i)).otherwise(F.lit(0)) for i, fails in enumerate(RULES.values())]
    return found.withColumn("failed", sum(bits[1:], bits[0]).cast("int"))


def judged(ledger: DataFrame, policy: str = "web/2") -> DataFrame:
    """Adds kept: no rule of the policy has failed."""
    return ledger.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask_of(POLICIES[policy]))) == 0)


def ablations(ledger: DataFrame, policy: str = "web/2", n: str | None = None) -> DataFrame:
    """For each rule of the policy: documents that fail it, that only it drops, and that are kept with and without it; `n` counts rows that stand for several.

    Documents are first counted by failure bits (at most 2**rules rows), and all figures come from these counts.
    """
    rules = POLICIES[policy]
    whole = mask_of(rules)
    counts = ledger.groupBy("failed").agg((F.sum(n) if n else F.count("*")).alias("n"))
    table = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(mask_of((name,))).alias("bit")) for name in rules])
    each = counts.select("failed", "n", F.explode(table).alias("r")).select("failed", "n", "r.*")
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    dropped = F.col("failed").bitwiseAND(F.lit(whole))
    without = F.col("failed").bitwiseAND(F.lit(whole).bitwiseXOR(F.col("bit")))
    return each.groupBy("rule").agg(total(F.col("failed").bitwiseAND(F.col("bit")) != 0).alias("n_failed"), total(dropped == F.col("bit")).alias("n_only"), total(dropped == 0).alias("n_kept"), total(without == 0).alias("n_kept_without"))


def op3_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with its measurements and verdicts; null and empty texts measure 0 and fail, and odd rows are treated as in ledger."""
    out = judged(ledger(read(spark, sf_dir, "documents").select("doc_id", "text")))
    failed = F.col("failed").bitwiseAND(F.lit(mask_of(POLICIES["base/1"]))) != 0
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept")


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every policy and each of its rules: documents that fail it, that only it drops, and that are kept with and without it."""
    found = ledger(read(spark, sf_dir, "documents").select("doc_id", "text")).select("failed")
    counts = settled(found.groupBy("failed").agg(F.count("*").alias("n")))  # at most 2**rules rows
    out = None
    for policy in POLICIES:
        one = ablations(counts, policy, "n").select(F.lit(policy).alias("policy"), "rule", "n_failed", "n_only", "n_kept", "n_kept_without")
        out = one if out is None else out.unionByName(one)
    return out


_LEDGER_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM d WHERE len(w) >= 8),
h AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM g),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM h) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM r) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(d.w) AS n_words, length(array_to_string(d.w, '')) AS word_chars,
  len(regexp_extract_all(d.text, '[#*$%&|<>]')) AS n_symbols, len(l.l) AS n_lines, len(l.l) - len(list_distinct(l.l)) AS n_dup_lines,
  coalesce(c.n, 0) AS n_repeat_words, len(regexp_extract_all(d.text, '\p{Lu}')) AS n_upper, len(regexp_extract_all(d.text, '\p{L}')) AS n_letters
  FROM d JOIN l USING (doc_id) LEFT JOIN c USING (doc_id))"""

OP3_SQL = _LEDGER_SQL + """,
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 3 * n_words OR 100 * n_dup_lines > 50 * n_lines OR 2 * n_upper > n_letters
       OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept
FROM b
"""

_FAILS_SQL = {
    "few_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "repeated_lines": "100 * n_dup_lines > 50 * n_lines",
    "shouting": "2 * n_upper > n_letters",
    "word_length": "(word_chars < 2 * n_words OR word_chars > 15 * n_words)",
}


def _ablations_sql() -> str:
    parts = []
    for policy, rules in POLICIES.items():
        any_of = lambda names: " OR ".join(_FAILS_SQL[r] for r in names) or "false"
        for rule in rules:
            others = any_of([r for r in rules if r != rule])
            parts.append(f"SELECT '{policy}' AS policy, '{rule}' AS rule, count(*) FILTER ({_FAILS_SQL[rule]}) AS n_failed, count(*) FILTER ({_FAILS_SQL[rule]} AND NOT ({others})) AS n_only, count(*) FILTER (NOT ({any_of(rules)})) AS n_kept, count(*) FILTER (NOT ({others})) AS n_kept_without FROM m")
    return _LEDGER_SQL + " " + " UNION ALL ".join(parts)


ABLATIONS_SQL = _ablations_sql()
