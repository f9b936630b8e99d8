"""Conversations and texts: turns, boundaries, redaction, cleaning, chunking, evidence in contexts, bigram recall."""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

# Patterns of credentials, and what replaces them.
SECRETS = (
    (r"(?i)\bBearer\s+[^\s,;]+", "Bearer [REDACTED]"),
    (r"(?i)\b(api[_-]?key|authorization|password|secret|token)\b\s*[:=]\s*[^\s,;]+", "$1=[REDACTED]"),
    (r"(?i)\b(access[\s_-]?key(?:[\s_-]?id)?|secret(?:[\s_-]?key)?|token|password|credential)\s*\[[^\]\s]+\]", "$1[REDACTED]"),
    (r"(?i)\b(?:ghp|github_pat|sk|xox[baprs])[-_][A-Za-z0-9._-]+", "[REDACTED]"),
)


def redact(text: Column) -> Column:
    for pattern, put in SECRETS:
        text = F.regexp_replace(text, pattern, put)
    return text


# A path goes on to the line's end, a double quote, or a colon before a blank; where it may begin.
PATH_TAIL = r"(?:(?!:(?:\s|$))[^\"\n])*"
PATHS = (
    r"(?im)\bfile://(?:[^/\s]+)?/" + PATH_TAIL, r"(?im)\b(?:smb|nfs|afp)://[^/\s]+/" + PATH_TAIL, r"(?m)(?<![A-Za-z0-9:])//[^/\s]+/" + PATH_TAIL, r"(?m)(?<![A-Za-z0-9])\\\\" + PATH_TAIL,
    r"(?im)(?<![A-Za-z0-9])[A-Z]:[\\/]" + PATH_TAIL, r"(?m)(?<![A-Za-z0-9/\]])/(?![/\s])" + PATH_TAIL,
)


def redact_paths(text: Column) -> Column:
    """Absolute paths and file or share addresses of each line as [PATH]; what is said after them stays; blanks are folded."""
    for pattern in PATHS:
        text = F.regexp_replace(text, pattern, "[PATH]")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clean_line(text: Column) -> Column:
    """Characters that don't print become blanks; runs of blanks are one; none at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[\p{C}\p{Z}]", " "), r"\s+", " "))


def turns(messages: DataFrame) -> DataFrame:
    """messages (conv_id, turn, role) with turn_no: a user message that doesn't follow another user message starts a turn."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    starts = (F.col("role") == "user") & (F.coalesce(F.lag("role").over(w), F.lit("")) != "user")
    return messages.withColumn("turn_no", F.sum(starts.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def turn_summary(messages: DataFrame) -> DataFrame:
    """Per turn: messages, characters, and complete if it ends in an assistant message."""
    by = turns(messages).groupBy("conv_id", "turn_no")
    return by.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), (F.max_by("role", "turn") == "assistant").alias("complete"))


def safe_boundaries(messages: DataFrame) -> DataFrame:
    """Messages after which a conversation may be cut: an assistant's, with a user's or nothing after it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    after = F.lead("role").over(w)
    return messages.withColumn("after", after).where((F.col("role") == "assistant") & (F.col("after").isNull() | (F.col("after") == "user"))).drop("after")


#: Characters outside the wide scripts.
NOT_WIDE = "[^ᄀ-ᅟ⺀-꓏가-힣豈-﫿︰-﹯＀-｠￠-￦]"


def estimated_tokens(text: Column) -> Column:
    """Rounded up: 0.25 a character, 1.5 for wide scripts, 2 beyond the basic plane."""
    wide = F.length(F.regexp_replace(text, NOT_WIDE, ""))
    astral = F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))
    return F.ceil(wide * 1.5 + astral * 2 + (F.length(text) - wide - astral) * 0.25).cast("long")


def evidence_hits(contexts: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """Evidence (key, evidence_id, evidence) in its context (key, context): as a part of the normalised text, or by at least
    80% of its tokens, counted, if it has four or more. Texts are compared lower-cased with single blanks."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    both = evidence.join(contexts, key).select(key, "evidence_id", plain(F.col("evidence")).alias("e"), plain(F.col("context")).alias("c"))
    tokens = lambda c: F.filter(F.split(c, r"[^\p{L}\p{N}_]+"), lambda x: x != "")
    # the n-th occurrence of a token is an element of its own, so an intersection of sets counts a multiset's overlap
    ids = both.select(key, "evidence_id", (F.expr("instr(c, e)") > 0).alias("inside"), tokens(F.col("e")).alias("et"), tokens(F.col("c")).alias("ct"))
    need = ids.where("not inside and size(et) >= 4").select(key, "evidence_id", F.size("et").alias("n"), F.explode("et").alias("t")).groupBy(key, "evidence_id", "n", "t").agg(F.count("*").alias("a"))
    have = ids.where("not inside and size(et) >= 4").select(key, "evidence_id", F.explode("ct").alias("t")).groupBy(key, "evidence_id", "t").agg(F.count("*").alias("b"))
    part = need.join(have, [key, "evidence_id", "t"]).groupBy(key, "evidence_id", "n").agg(F.sum(F.least("a", "b")).alias("s")).select(key, "evidence_id", (F.col("s") >= 0.8 * F.col("n")).alias("close"))
    return ids.select(key, "evidence_id", "inside").join(part, [key, "evidence_id"], "left").select(key, "evidence_id", (F.col("inside") | F.coalesce("close", F.lit(False))).alias("hit"))


#: Items of a stated query set that are broadcast at once.
BLOCK = 2000


def _blocks(items: DataFrame, key: str) -> Iterator[pa.Table]:
    """Items in blocks of half BLOCK on the mean, by a hash of their key; all of them where they are BLOCK at most."""
    n = items.count()
    blocks = 1 if n <= BLOCK else -(-2 * n // BLOCK)
    for k in range(blocks):
        yield (items if blocks == 1 else items.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == k)).toArrow()


class _Incidence:
    """Items by the elements they hold: a matrix with a column for the n-th occurrence of each element."""

    def __init__(self, held: list[list]):
        self.columns, entries, size = {}, [], 0
        for i, elements in enumerate(held):
            seen = {}
            for x in elements:
                at, k = self.columns.setdefault(x, []), seen.get(x, 0)
                if k == len(at):
                    at.append(size)
                    size += 1
                entries.append((i, at[k]))
                seen[x] = k + 1
        self.matrix = np.zeros((len(held), size), np.float32)
        if entries:
            self.matrix[tuple(np.array(entries).T)] = 1

    def overlaps(self, rows: list) -> np.ndarray:
        """How many elements each row shares with each item, occurrences counted."""
        d = np.zeros((len(rows), self.matrix.shape[1]), np.float32)
        for i, elements in enumerate(rows):
            seen = {}
            for x in elements:
                at = self.columns.get(x)
                if at is not None and (k := seen.get(x, 0)) < len(at):
                    d[i, at[k]] = 1
                    seen[x] = k + 1
        return d @ self.matrix.T


def evidence_everywhere(contexts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each evidence (evidence_id, evidence) and each context (key, context) that holds it, by the rule of evidence_hits: a row
    (key, evidence_id, hit) for each such pair. Contexts are read once against each block of evidence, as a product of
    incidence matrices; only where all but two of a passage's tokens are there can it stand as a part of the text, and is
    looked for. Null texts hold nothing and are in nothing."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    tokens = lambda c: F.filter(F.split(c, r"[^\p{L}\p{N}_]+"), lambda x: x != "")
    c = contexts.where("context is not null").select("key", plain(F.col("context")).alias("c")).withColumn("t", tokens(F.col("c")))
    e = evidence.where("evidence is not null").select("evidence_id", plain(F.col("evidence")).alias("e")).withColumn("t", tokens(F.col("e")))
    kinds = [c.schema["key"].dataType.simpleString(), e.schema["evidence_id"].dataType.simpleString()]
    found = None
    for block in _blocks(e, "evidence_id"):
        texts, held = block.column("e").to_pylist(), block.column("t").to_pylist()
        shared = contexts.sparkSession.sparkContext.broadcast((texts, np.array([len(x) for x in held], np.int64), _Incidence(held)))
        ids = block.column("evidence_id").combine_chunks()

        def run(batches: Iterator[pa.RecordBatch], shared=shared, ids=ids) -> Iterator[pa.RecordBatch]:
            texts, n, matrix = shared.value
            for b in batches:
                for lo in range(0, b.num_rows, 256):
                    part = b.slice(lo, 256)
                    whole = part["c"].to_pylist()
                    both = matrix.overlaps(part["t"].to_pylist()).astype(np.int64)
                    hit = (n >= 4) & (10 * both >= 8 * n)
                    for i, j in zip(*np.nonzero((both >= n - 2) & ~hit), strict=True):
                        hit[i, j] = texts[j] in whole[i]
                    i, j = np.nonzero(hit)
                    yield pa.RecordBatch.from_arrays([part["key"].take(pa.array(i)), ids.take(pa.array(j)), pa.array(np.ones(len(i), bool))], names=["key", "evidence_id", "hit"])

        own = c.mapInArrow(run, f"key {kinds[0]}, evidence_id {kinds[1]}, hit boolean")
        found = own if found is None else found.unionAll(own)
    return found


@functools.cache
def _dropped() -> dict[int, None]:
    """Blanks and punctuation, all of Unicode's."""
    return {i: None for i in range(sys.maxunicode + 1) if chr(i).isspace() or unicodedata.category(chr(i))[0] in "PZ"}


def bigram_set(text: str | None) -> set[str]:
    """Pairs of neighbouring characters of a text, after NFKC and case folding, without blanks and punctuation; none of null."""
    t = unicodedata.normalize("NFKC", text or "").casefold().translate(_dropped())
    return {t[i : i + 2] for i in range(len(t) - 1)}


def bigram_overlaps(new: DataFrame, old: DataFrame, alike: bool = False) -> DataFrame:
    """Each new text (id, text) against each old one (old_id, text): how many character pairs the new one has (n), the old one
    (m), and both (c); with alike, only where they share one. Old texts are read once against each block of new ones, as a
    product of incidence matrices."""
    kinds = [new.schema["id"].dataType.simpleString(), old.schema["old_id"].dataType.simpleString()]
    found = None
    for block in _blocks(new, "id"):
        held = [sorted(bigram_set(x)) for x in block.column("text").to_pylist()]
        shared = new.sparkSession.sparkContext.broadcast((np.array([len(x) for x in held], np.int64), _Incidence(held)))
        ids = block.column("id").combine_chunks()

        def run(batches: Iterator[pa.RecordBatch], shared=shared, ids=ids) -> Iterator[pa.RecordBatch]:
            n, matrix = shared.value
            for b in batches:
                for lo in range(0, b.num_rows, 256):
                    part = b.slice(lo, 256)
                    grams = [bigram_set(x) for x in part["text"].to_pylist()]
                    m, c = np.array([len(g) for g in grams], np.int64), matrix.overlaps(grams).astype(np.int64)
                    i, j = np.nonzero(c if alike else np.ones_like(c))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(j)), part["old_id"].take(pa.array(i)), pa.array(n[j]), pa.array(m[i]), pa.array(c[i, j])], names=["id", "old_id", "n", "m", "c"])

        own = old.select("old_id", "text").mapInArrow(run, f"id {kinds[0]}, old_id {kinds[1]}, n long, m long, c long")
        found = own if found is None else found.unionAll(own)
    return found


def chunks(text: str, size: int) -> list[str]:
    """Pieces of at most `size` characters that join to the text again: cut after blank lines, else lines, sentences, blanks,
    else anywhere; as few as greedily fit."""
    out, rest = [], text
    while len(rest) > size:
        cut = 0
        for mark in ("\n\n", "\n", ". ", " "):
            at = rest.rfind(mark, 0, size - len(mark) + 1)
            if at > 0:
                cut = at + len(mark)
                break
        out.append(rest[: cut or size])
        rest = rest[cut or size :]
    return [*out, rest] if rest or not out else out


def chunked(df: DataFrame, size: int) -> DataFrame:
    """A row for each chunk of each row's text: all columns of df but text, chunk_no and chunk."""
    own = [c for c in df.columns if c != "text"]
    schema = StructType([*[df.schema[c] for c in own], StructField("chunk_no", LongType()), StructField("chunk", StringType())])

    def run(parts):
        for t in parts:
            made = t.assign(chunk=t["text"].map(lambda x: chunks(x or "", size)))
            made = made.assign(chunk_no=made["chunk"].map(lambda c: list(range(len(c)))))
            yield made.explode(["chunk_no", "chunk"])[[*own, "chunk_no", "chunk"]]

    return df.mapInPandas(run, schema)


def recalled(scored: DataFrame, each: int, by: tuple[str, ...] = ()) -> DataFrame:
    """For each new entry in turn the `each` most alike old ones (by, id, old_id, score) that none before took; ties by id; without
    by, all are one group. Taking depends on what was taken before, so a group's entries are one task: those before
    the n-th took at most `each` * (n - 1), so its first `each` * n are all that it can take from, and only they go there."""
    turn = scored.select(*by, "id").distinct().withColumn("turn", F.row_number().over(Window.partitionBy(*by).orderBy("id")))
    w = Window.partitionBy(*by, "id").orderBy(F.col("score").desc(), "old_id")
    alike = scored.withColumn("place", F.row_number().over(w)).join(turn, [*by, "id"]).where(F.col("place") <= F.col("turn") * each).drop("place", "turn")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in alike.schema if f.name not in ("score",))

    def run(t: pd.DataFrame) -> pd.DataFrame:
        taken, keep = set(), []
        for _, own in t.sort_values(["id", "score", "old_id"], ascending=[True, False, True]).groupby("id", sort=True):
            left = own[~own["old_id"].isin(taken)].head(each)
            taken |= set(left["old_id"])
            keep.append(left)
        return pd.concat(keep).drop(columns="score")

    return alike.groupBy(*by).applyInPandas(run, kinds)
