"""Sharding by a Feistel permutation with cycle walking over global row numbers, by DataFrame functions only.

Row numbers 0..n-1 are written as (left, right) in a grid of a x b >= n cells, a and b near the root of n. Rounds add a keyed
hash of one half to the other, modulo a or b: a permutation of the grid. A number that falls beyond n is sent through again
until it falls below (cycle walking), which makes a permutation of 0..n-1. Shard and slot of a row are then its permuted
number modulo and divided by the number of shards: computable for any row from (n, seed) alone, without a look at others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import documents, let, saved, table
from .numbering import numbered

ROUNDS = 6
PRIME = (1 << 31) - 1


def grid(n: int) -> tuple[int, int]:
    a = max(1, int(n**0.5))
    while a * a < n:
        a += 1
    return a, max(1, -(-n // a))


def keys(seed: int) -> list[tuple[int, int]]:
    """Multiplier and offset of each round, below 2**31."""
    out, x = [], seed % PRIME or 1
    for _ in range(ROUNDS):
        x = x * 48271 % PRIME
        y = x * 48271 % PRIME
        out.append((x, y))
        x = y
    return out


def _hash(x: Column, k: tuple[int, int]) -> Column:
    """Keyed hash of x < 2**31 to below PRIME; all products stay below 2**62."""
    t = (x * F.lit(k[0]).cast("long") + F.lit(k[1]).cast("long")) % F.lit(PRIME).cast("long")
    t = t.bitwiseXOR(F.shiftright(t, 15))
    t = (t % F.lit(PRIME).cast("long")) * F.lit(48271).cast("long") % F.lit(PRIME).cast("long")
    return t.bitwiseXOR(F.shiftright(t, 13))


def _once(number: Column, a: int, b: int, seed: int) -> Column:
    state = F.struct(F.call_function("div", number, F.lit(b)).alias("l"), (number % b).alias("r"))
    for i, k in enumerate(keys(seed)):
        state = let(state, _left(k, a) if i % 2 == 0 else _right(k, b))
    return let(state, lambda s: s["l"] * b + s["r"])


def _left(k: tuple[int, int], a: int):
    return lambda s: F.struct(((s["l"] + _hash(s["r"], k)) % a).alias("l"), s["r"].alias("r"))


def _right(k: tuple[int, int], b: int):
    return lambda s: F.struct(s["l"].alias("l"), ((s["r"] + _hash(s["l"], k)) % b).alias("r"))


def permuted(number: Column, n: int, seed: int = 1) -> Column:
    """The place of row `number` (0..n-1) in the shuffle. A walk is needed by about one row in the root of n; it ends within
    a * b - n + 1 steps, as only so many cells lie beyond n."""
    a, b = grid(max(n, 1))
    beyond = a * b - n
    first = _once(number.cast("long"), a, b, seed)
    if not beyond:
        return first
    walk = lambda x: F.aggregate(F.sequence(F.lit(1), F.lit(beyond)), x, lambda y, _: F.when(y < n, y).otherwise(_once(y, a, b, seed)))
    return let(first, lambda x: F.when(x < n, x).otherwise(walk(x)))


def sharded(docs: DataFrame, shards: int = 40, seed: int = 1) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, size (UTF-8 bytes and 16), text_crc32, row_number, shard and slot.

    Rows are numbered by (doc_id, text's crc32, size), null ids first; rows that tie in all are the same to the result. Null
    texts have no bytes. Shards' row counts differ by one at most and slots have no gaps. Only ids, sizes and checksums are
    written and shuffled, never a text, and texts are read once. Equal texts and hot sources don't matter to it. An empty table gives an empty table.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = saved(documents(docs).select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32")))
    n = narrow.count()
    rows = numbered(narrow, "doc_id", "text_crc32", "size", n_rows=n)
    place = rows.withColumn("__p", permuted(F.col("row_number"), n, seed))
    return place.withColumns({"shard": F.pmod("__p", F.lit(shards)).cast("int"), "slot": ((F.col("__p") - F.pmod("__p", F.lit(shards))) / shards).cast("long")}).drop("__p")


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    """Every document's shard and slot under the law of equal row counts."""
    out = sharded(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
