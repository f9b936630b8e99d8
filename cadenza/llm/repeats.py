"""Substring dedup by seed and extend: words of passages that a document with a smaller doc_id holds too.

1. Seeds. Of each 13 words, the least hash of their 5-word runs is the anchor (winnowing): two documents that share 13 words
   share an anchor there. Buckets ask blocks of hashes which anchors occur in two documents or more (see exchange.py); a
   fifth of the words are anchors.
2. Extension. Around a shared anchor, every 13-word window that it was chosen for is a match extended both ways from the
   seed. Buckets ask for the least doc_id of each such window.
3. Maximal repeats. Windows that an earlier document holds too are merged: a run of them with one earliest holder is a repeat
   that can't be extended with it.

Anchors only select, so they are compared on a part of a 64-bit hash. What removes a word is compared on two independent
hashes of the window, 120 bits or more together. Windows are judged on the input. A passage in a third of all documents costs one entry a bucket.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from ._spark import documents, table, text_bytes
from ._text import Words, sliding_min, windows

U = np.uint64
LAST = np.iinfo(np.int64).max  # stands for a null doc_id: after all others


def _grouped(doc: np.ndarray, *keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct keys (of one or more parts), the least and the largest doc of each, and the index of each entry's key."""
    order = np.lexsort(keys[::-1])
    keys, doc = [k[order] for k in keys], doc[order]
    new = np.zeros(len(doc), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    start, index = np.flatnonzero(new), np.empty(len(doc), np.int64)
    index[order] = np.cumsum(new) - 1
    ends = [f.reduceat(doc, start) if len(start) else doc for f in (np.minimum, np.maximum)]
    return [k[start] for k in keys], *ends, index


class _Bucket:
    """Words, windows and anchors of a bucket's texts, in the order of its rows."""

    def __init__(self, t: pa.Table, length: int, seed: int, keep: np.uint64, keep2: np.uint64 | None = None):
        self.words = Words(X.texts(t), wide=keep2 is not None)
        self.doc = np.array([LAST if d is None else d for d in X.ids(t)], np.int64)
        self.start, self.of = windows(self.words.hashes, self.words, length)
        least = sliding_min(self.words.grams(seed), length - seed + 1)
        self.anchor = least[self.start] & keep if len(self.start) else np.zeros(0, U)
        self.length, self.keep2 = length, keep2

    def anchors(self):
        (once,), *rest = _grouped(self.doc[self.of], self.anchor)
        return once, *rest

    def matches(self, shared: np.ndarray):
        """Windows whose anchor is shared: their indices, and both their hashes grouped. shared: for each distinct anchor."""
        at = np.flatnonzero(shared[self.anchors()[3]]) if len(self.anchor) else np.zeros(0, int)
        start = self.start[at]
        first, second = (self.words.grams(self.length, k)[start] if len(at) else np.zeros(0, U) for k in (False, True))
        return at, _grouped(self.doc[self.of[at]], first & self.keep2, second)


def _shared(index: np.ndarray, starts: np.ndarray, known: list[np.ndarray]) -> np.ndarray:
    """1 for an anchor in more than one bucket, or in two documents of one."""
    if not len(starts):
        return np.zeros(0, np.uint8)
    entries = np.diff(np.append(starts, len(index)))
    return ((entries > 1) | (np.maximum.reduceat(known[0], starts) > 0)).astype(np.uint8)[index]


def _least(index: np.ndarray, starts: np.ndarray, known: list[np.ndarray]) -> np.ndarray:
    return np.minimum.reduceat(known[0], starts)[index] if len(starts) else np.zeros(0, np.int64)


def removed(docs: DataFrame, length: int = 13, seed: int = 5, carry: bool = False) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, n_words, n_removed, kept (the text: itself if nothing is removed,
    else the kept words joined by one space), kept_sha256 (of the kept words so joined) and spans (the maximal repeats by
    their first word: that, the word after the last, and the least doc_id that holds the passage; those of two holders may
    overlap, and all together cover the removed words).

    Words are runs of non-space bytes, unchanged. Null, empty and blank texts have none: their sha256 is that of an empty
    text; kept is null for a null text. Rows with one doc_id are one document to this rule and keep what they share. A null
    doc_id comes after all others. Other columns are ignored, or with carry come along as a struct `row`; an empty table
    gives an empty table.
    """
    row = F.struct(*[docs[c] for c in docs.columns if c != "text"]) if carry else F.lit(None).cast("int")
    docs = documents(docs, row.alias("row"))
    row_type = docs.schema["row"].dataType.simpleString()
    _, size = text_bytes(docs)
    n_buckets, bits = X.shape(size, 16 << 20)
    bits2 = X.shape(size, 8 << 20)[1]
    width = min(7, (64 - bits) // 8)
    keep = U(0xFFFFFFFFFFFFFFFF) << U(64 - bits - 8 * width)
    wide = min(8, (64 - bits2) // 8)
    keep2 = U(0xFFFFFFFFFFFFFFFF) << U(64 - bits2 - 8 * wide)
    dealt = X.buckets(docs, n_buckets)

    def ask(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        once, low, high, _ = _Bucket(t, length, seed, keep).anchors()
        return X.asks(X.asking(once, bits, width, [(low < high).astype(np.uint8)]), key[0].as_py())

    def extend(key: tuple[pa.Scalar, ...], t: pa.Table, got: pa.Table) -> pa.Table:
        _, ((first, second), low, _, _) = _Bucket(t, length, seed, keep, keep2).matches(X.answered(got, "u1"))
        return X.asks(X.asking(first, bits2, wide, [second, low]), key[0].as_py())

    def cover(key: tuple[pa.Scalar, ...], t: pa.Table, got: pa.Table) -> pa.Table:
        b = _Bucket(t, length, seed, keep, keep2)
        step = [got.filter(pc.equal(got.column("step"), i)) for i in (1, 2)]
        at, (_, _, _, index) = b.matches(X.answered(step[0], "u1"))
        low = X.answered(step[1], "i8")[index] if len(at) else np.zeros(0, np.int64)
        earlier = low < b.doc[b.of[at]]
        hit, low = b.start[at[earlier]], low[earlier]
        # runs of neighbouring windows of one text with one earliest holder
        run = np.flatnonzero(np.concatenate([[True], (np.diff(hit) != 1) | (np.diff(low) != 0)])) if len(hit) else np.zeros(0, int)
        begin, end, holder = hit[run], hit[np.append(run[1:], len(hit)) - 1] + length if len(run) else run, low[run]
        mark = np.zeros(len(b.words.hashes) + 1, np.int64)
        np.add.at(mark, begin, 1)
        np.add.at(mark, end, -1)
        gone = np.cumsum(mark[:-1]) > 0
        out, raw = [], t.column("text").to_pylist()
        for i, (doc, lo, n) in enumerate(zip(X.ids(t), b.words.first.tolist(), b.words.counts.tolist(), strict=True)):
            g = gone[lo : lo + n]
            own = slice(*np.searchsorted(begin, [lo, lo + n]))
            spans = np.stack([begin[own] - lo, end[own] - lo, holder[own]], 1).tolist()
            stays = [b.words.data[x:y] for x, y in zip(b.words.begin[lo : lo + n][~g].tolist(), b.words.end[lo : lo + n][~g].tolist(), strict=True)]
            kept = b" ".join(stays)
            out.append((doc, n, int(g.sum()), raw[i] if not g.any() else kept.decode(), hashlib.sha256(kept).hexdigest(), spans))
        names = ("doc_id", "n_words", "n_removed", "kept", "kept_sha256", "spans")
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.list_(pa.int64())))
        return pa.table({c: pa.array([r[i] for r in out], kind) for i, (c, kind) in enumerate(zip(names, kinds, strict=True))} | {"row": t.column("row")})

    texts = dealt.groupBy("bucket")
    first = X.answers(texts.applyInArrow(ask, X.ASK), width, ["u1"], _shared)
    second = X.answers(texts.cogroup(first.groupBy("bucket")).applyInArrow(extend, X.ASK), wide, ["<u8", "i8"], _least, paired=True)
    both = first.withColumn("step", F.lit(1)).unionByName(second.withColumn("step", F.lit(2)))
    return texts.cogroup(both.groupBy("bucket")).applyInArrow(cover, f"doc_id long, n_words long, n_removed long, kept string, kept_sha256 string, spans array<array<long>>, row {row_type}")


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document of `documents`: what its repeats leave of it."""
    return removed(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def without_repeats(docs: DataFrame, length: int = 13) -> DataFrame:
    """docs with the kept text, and n_chars to match where docs has it. A document that loses all its words goes."""
    kept = removed(docs, length, carry=True).where("n_removed < n_words or n_words = 0")
    out = {c: F.col("row")[c] for c in docs.columns if c != "text"} | {"text": F.col("kept")}
    if "n_chars" in out:
        out["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(out["n_chars"])
    return kept.select(*[out[c].alias(c) for c in docs.columns])


OP9_SQL = r"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM t WHERE len(w) >= 13)),
lo AS (SELECT g, min(doc_id) AS lo FROM win GROUP BY g),
cov AS (SELECT DISTINCT doc_id, i + j AS p FROM win JOIN lo USING (g), (SELECT unnest(range(13)) AS j) WHERE lo < doc_id),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM t WHERE len(w) > 0),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS text, count(*) AS n FROM word WHERE NOT EXISTS (SELECT 1 FROM cov c WHERE c.doc_id = word.doc_id AND c.p = word.p) GROUP BY doc_id)
SELECT t.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM t LEFT JOIN kept ON kept.doc_id = t.doc_id
"""
