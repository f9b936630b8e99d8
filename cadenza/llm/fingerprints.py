"""Document fingerprints: bottom-k sketches of shingle hashes, by DataFrame functions only.

A sketch is the k least 48-bit hashes of a text's distinct 5-word shingles, sorted. The sketch of two parts together is the k
least of both sketches, so sketches merge in any order. They estimate resemblance (Jaccard), containment and the number of
distinct shingles; a set of at most k shingles is known exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import documents, let, table, text_bytes, words

K = 256
BITS = 48
LONGS = "array<bigint>"


def sketch(text: str, k: int = K, n: int = 5) -> Column:
    """The sketch of a text column: A-Z is lower-cased, words are runs of non-space bytes; of fewer than n words the whole
    sequence is one shingle; without words it is empty. Null is an empty text."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

    def hashes(w: Column) -> Column:
        one = F.array(F.xxhash64(F.concat_ws(" ", w)))
        many = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(n)]))
        return F.when(F.size(w) == 0, F.array().cast(LONGS)).when(F.size(w) < n, one).otherwise(many)

    cut = lambda h: F.transform(h, lambda x: F.shiftrightunsigned(x, 64 - BITS))
    return let(F.transform(words(text), lambda x: F.translate(x, upper, lower)), lambda w: F.slice(F.sort_array(F.array_distinct(cut(hashes(w)))), 1, k))


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_groups(df: DataFrame, by: list[str], column: str, k: int = K) -> DataFrame:
    """The sketch of each group's union: the k least distinct hashes, one by one, so that no group is gathered in one row.
    Hashes are made distinct before the shuffle."""
    each = df.select(*by, F.explode(column).alias("__h")).distinct()
    ranked = each.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy("__h"))).where(F.col("__r") <= k)
    return ranked.groupBy(*by).agg(F.sort_array(F.collect_list("__h")).alias(column))


def distinct_shingles(s: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) by the k-th least hash as a part of the space."""
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) * F.lit(float(1 << BITS)) / F.get(s, F.lit(k - 1)))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the part of the union's k least hashes that both have. 1 for two empty sketches."""

    def of(u: Column) -> Column:
        return F.size(F.array_intersect(u, F.array_intersect(a, b))) / F.size(u)

    return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(let(merged(a, b, k), of))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated part of a's shingles that b has, from resemblance and the estimated sizes; 1 if a is empty."""
    j, n, m = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j / (1 + j) * (n + m) / n))


def as_text(s: Column) -> Column:
    """A sketch as a string: 12 hexadecimal digits a hash, ascending; empty for the empty sketch."""
    return F.array_join(F.transform(s, lambda h: F.lower(F.lpad(F.hex(h), BITS // 4, "0"))), "")


def from_text(s: Column) -> Column:
    width = BITS // 4
    at = F.sequence(F.lit(0), (F.length(s) / width).cast("int") - 1)
    return F.when(F.length(s) == 0, F.array().cast(LONGS)).otherwise(F.transform(at, lambda i: F.conv(F.substring(s, i * width + 1, F.lit(width)), 16, 10).cast("long")))


def _reached(bounds: list[int], x: Column) -> Column:
    """How many of the ascending bounds are at most x, by binary search over one folded literal."""
    all_ = F.split(F.lit(",".join(map(str, bounds))), ",").cast(LONGS)

    def halve(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        up = F.get(all_, mid) <= x
        return F.when(s["lo"] >= s["hi"], s).otherwise(F.struct(F.when(up, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(up, s["hi"]).otherwise(mid).alias("hi")))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length())), start, halve, lambda s: s["lo"])


def with_next(docs: DataFrame, target: int = 2 << 20) -> DataFrame:
    """docs (doc_id, text; null texts as empty) with next_text, that of the next row by descending doc_id, the first's after the
    last. Null ids come last. Rows of one id follow each other by descending text, or, where they fill several ranges, by a
    hash and then by descending text; repeated rows each have a next one. An empty table gives an empty table.

    Ranges of about `target` bytes are ordered each for itself; a doc_id (or null) that would fill several is dealt to as many
    by a hash of text and input partition. Each range's last row takes the first row of the next range that has rows: only
    the ranges' numbers meet in one task. Texts are shuffled once."""
    n, size = text_bytes(docs)
    parts = max(1, min(-(-size // target), 100_000))
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cuts = []
    if parts > 1:
        shares = F.split(F.lit(",".join(str(i / parts) for i in range(1, parts))), ",").cast("array<double>")
        got = docs.agg(F.percentile_approx("doc_id", shares, max(10_000, 10 * parts)).alias("c"), F.sum(F.when(F.col("doc_id").isNull(), 1).otherwise(0)).alias("none")).first()
        cuts, none = sorted(got["c"] or []), -(-got["none"] * parts // max(1, n))
    if cuts:
        upto, below = _reached(cuts, F.col("doc_id")), _reached(cuts, F.col("doc_id") - 1)
        docs = docs.withColumns({"part": F.coalesce(-upto, F.lit(1)), "m": F.coalesce(upto - below, F.lit(none))})
    else:
        docs = docs.withColumns({"part": F.lit(0), "m": F.lit(0 if parts == 1 else none)})
    spread = F.pmod(F.xxhash64("text", F.spark_partition_id()), F.col("m")).cast("int") + 1
    docs = docs.withColumn("sub", F.when(F.col("m") > 1, spread).otherwise(0)).drop("m")
    order = [F.col("doc_id").desc_nulls_last(), F.col("text").desc()]
    w = Window.partitionBy("part", "sub").orderBy(*order)
    first = docs.groupBy("part", "sub").agg(F.max(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "text"))["text"].alias("after"))
    ring = Window.orderBy("part", "sub")
    at = F.struct("part", "sub")
    places = docs.select("part", "sub").distinct().withColumn("to", F.coalesce(F.lead(at).over(ring), F.first(at).over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    nexts = places.join(first.select(F.struct("part", "sub").alias("to"), "after"), "to").select("part", "sub", "after")
    inner = docs.withColumn("inner", F.lead("text").over(w))
    return inner.join(nexts, ["part", "sub"]).select("doc_id", "text", F.coalesce("inner", "after").alias("next_text"))


def op3_fingerprints(spark, sf_dir: str, k: int = K) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness to each other and to the next document's. Null
    texts are empty ones, with empty fingerprints; rows come and follow each other as `with_next` says."""
    near = with_next(documents(table(spark, sf_dir, "documents")))
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - third), F.substring("next_text", F.lit(1), third))
    made = near.withColumns({"n_chars": F.length("text").cast("long"), "edited": edited})
    made = made.withColumns({"own": sketch("text", k), "other": sketch("edited", k), "beside": sketch("next_text", k)})
    return made.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), as_text(F.col("own")).alias("fingerprint"), as_text(F.col("other")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("other"), k).alias("near_edited"), resemblance(F.col("own"), F.col("beside"), k).alias("near_next"),
    )
