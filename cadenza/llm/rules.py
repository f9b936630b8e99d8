"""Quality rules as a bitmask ledger, by DataFrame functions only.

Every rule is evaluated once for each document; the ledger keeps the measurements and one bit a rule that fails. A policy is
a versioned mask over those bits, applied without reading a text again; what a rule alone removes is a bitwise aggregation
of the ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import let, table, words

WINDOW = 8


def _repeat_words(w: Column) -> Column:
    """How many words of the array lie in windows of WINDOW words that occur twice or more. Only texts with such a window
    pay for the sort that finds which."""

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twice(p: Column) -> Column:
            last = F.size(p) - 1
            same = lambda x, i: ((i > 0) & (F.get(p, i - 1)["h"] == x["h"])) | ((i < last) & (F.get(p, i + 1)["h"] == x["h"]))
            return F.array_sort(F.transform(F.filter(p, same), lambda x: x["i"]))

        def total(at: Column) -> Column:  # each window adds what it reaches beyond the one before
            return F.aggregate(
                at,
                F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
                lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + i + WINDOW - F.greatest(a["end"], i)).alias("n")),
                lambda a: a["n"],
            )

        return let(pairs, lambda p: let(twice(p), total))

    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(WINDOW)]))
    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))
    return F.when(F.size(w) <= WINDOW, 0).otherwise(found)


#: What is measured of a text. `w` is its array of words, `text` the text (null as empty).
MEASURES = {
    "n_words": lambda w, text: F.size(w),
    "word_chars": lambda w, text: F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")),
    "n_symbols": lambda w, text: F.length(text) - F.length(F.translate(text, "#*$%&|<>", "")),
    "n_lines": lambda w, text: F.size(_lines(text)),
    "n_dup_lines": lambda w, text: let(_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))),
    "n_repeat_words": lambda w, text: _repeat_words(w),
    "n_shouted": lambda w, text: F.length(text) - F.length(F.translate(text, "!", "")),
    "n_stuttered": lambda w, text: F.size(F.filter(w, lambda x, i: (i > 0) & (x == F.get(w, i - 1)))),
}


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != "")


@dataclass(frozen=True)
class Rule:
    """Fails where its condition over the measures holds. Its bit never changes once a ledger was written with it."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 20"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 20 * n_words"),
    Rule(3, "repeated_lines", "n_lines >= 4 and 100 * n_dup_lines > 40 * n_lines"),
    Rule(4, "word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    Rule(5, "shouting", "100 * n_shouted > 30 * n_words"),
    Rule(6, "stuttering", "100 * n_stuttered > 30 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return self.bits(RULES)

    def bits(self, rules: tuple[Rule, ...]) -> int:
        """The bits of the policy's rules, by the table of rules that the ledger was written with."""
        of = {r.name: 1 << r.bit for r in rules}
        return sum(of[n] for n in self.rules)


BASE = Policy("base", ("few_words", "repeated_windows"))
STRICT = Policy("2", tuple(r.name for r in RULES))


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with the measures (long) and failed_bits (long, bit i for rule i), in one pass without a shuffle.

    A null text is measured as an empty one. Columns of docs with the name of a measure are replaced. Rows are kept as they
    are, repeated ones too; an empty table gives an empty table.
    """
    plain = docs.drop(*MEASURES, "failed_bits")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # measured in a generator of one row: no filter on the results is pushed below it, where it would measure again
    one = plain.select("*", F.inline(F.transform(F.array(words("text")), lambda w: F.struct(*[f(w, text).cast("long").alias(n) for n, f in MEASURES.items()]))))
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in rules]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return one.withColumn("failed_bits", total)


def passes(policy: Policy, rules: tuple[Rule, ...] = RULES) -> Column:
    """Does a row of the ledger, written with these rules, pass the policy?"""
    return F.col("failed_bits").bitwiseAND(F.lit(policy.bits(rules)).cast("long")) == 0


def ablations(led: DataFrame, policy: Policy = STRICT, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of the policy: rows that fail it, and rows that fail it alone and would be kept without it. Rows are
    first summed by mask, so at most 2**rules sums leave each task."""
    masks = led.groupBy(F.col("failed_bits").bitwiseAND(F.lit(policy.bits(rules)).cast("long")).alias("mask")).agg(F.count(F.lit(1)).alias("n"))
    own = [r for r in rules if r.name in policy.rules]
    each = masks.select("n", "mask", F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in own])).alias("r"))
    has = each["mask"].bitwiseAND(F.col("r.bit")) != 0
    return each.groupBy("r.rule").agg(F.sum(F.when(has, F.col("n")).otherwise(0)).alias("n_failed"), F.sum(F.when(F.col("mask") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"))


def accepted(docs: DataFrame, policy: Policy = STRICT) -> DataFrame:
    """The rows of docs that pass, with their own columns."""
    from pyspark.sql.functions import struct

    whole = docs.select(struct(*[docs[c] for c in docs.columns]).alias("row"), docs["text"].alias("text"))
    return ledger(whole).where(passes(policy)).select("row.*")


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Every document's measures, the base verdict and that of the strict policy."""
    led = ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes(BASE)).alias("base_failed"), (passes(BASE) & passes(STRICT)).alias("kept"), "failed_bits",
    )


OP7_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
win AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM w WHERE len(w) >= 8),
h AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM win),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM h) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM d, (SELECT unnest(range(0, 8)) AS j) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w.w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
        length(regexp_replace(text, '[^!]', '', 'g')) AS n_shouted,
        len(list_filter(range(2, len(w.w) + 1), lambda i: w.w[i] = w.w[i - 1])) AS n_stuttered FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
b AS (SELECT *, CAST((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (100 * n_symbols > 20 * n_words)::INT
        + 8 * (n_lines >= 4 AND 100 * n_dup_lines > 40 * n_lines)::INT + 16 * (word_chars < 2 * n_words OR word_chars > 20 * n_words)::INT
        + 32 * (100 * n_shouted > 30 * n_words)::INT + 64 * (100 * n_stuttered > 30 * n_words)::INT AS BIGINT) AS failed_bits FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits FROM b
"""
