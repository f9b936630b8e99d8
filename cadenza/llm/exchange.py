"""Which hashes do texts share? A question that buckets of documents put to blocks of hashes.

Documents are dealt into buckets by a hash of the row and of the input partition it comes from, so repetitions of one row
spread too. Each bucket sends every block of the hash space its *distinct*
hashes once, with what it knows of them; the block merges the buckets' lists and answers each bucket in the order it asked.
So a passage that a third of all documents hold costs one entry a bucket, not one a document, in both directions, and no
task gets a key's occurrences together. The exchange of texts is the same plan node at each use, which Spark reuses.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U = np.uint64
BUCKET_BYTES, BUCKET_MOST, MESSAGE = 4 << 20, 64 << 20, 32
ASK = "block int, bucket int, asked binary"
ANSWER = "bucket int, block int, answer binary"


def buckets(docs: DataFrame, n: int) -> DataFrame:
    """docs with its bucket of n, by a hash of id, text and input partition: a row that is repeated all over the table isn't
    gathered, and a lost task deals its rows again as before."""
    return docs.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(n)).cast("int"))


def texts(t: pa.Table) -> list[bytes]:
    return [x or b"" for x in t.column("text").cast(pa.binary()).to_pylist()]


def ids(t: pa.Table) -> list:
    return t.column("doc_id").to_pylist()


def shape(n_bytes: int, per_block: int) -> tuple[int, int]:
    """Buckets, and bits of a block's number, for so many bytes of text: buckets of BUCKET_BYTES and blocks of per_block at
    least. Both grow with the root of the corpus, so that a bucket's message to a block keeps MESSAGE entries or so and messages
    don't outweigh what they carry; buckets up to BUCKET_MOST, what a Python worker can hold, and blocks beyond that."""
    one = min(BUCKET_MOST, max(BUCKET_BYTES, int((12 * MESSAGE * n_bytes) ** 0.5)))
    block = max(per_block, 12 * MESSAGE * n_bytes // one)
    return max(1, -(-n_bytes // one)), min(24, max(0, int(np.ceil(np.log2(max(1, n_bytes / block))))))


def asking(keys: np.ndarray, bits: int, width: int, known: list[np.ndarray]) -> list[tuple[int, bytes]]:
    """What to send of the sorted distinct keys (uint64): for each block its number, and the low `width` bytes of what is
    left of each key, then the arrays in `known` (fixed-width types), one after the other."""
    if not len(keys):
        return []
    of = (keys >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    rest = (keys << U(bits)) >> U(64 - 8 * width)
    cut = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    out = []
    for lo, hi in zip(cut, [*cut[1:], len(keys)], strict=True):
        raw = rest[lo:hi].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
        out.append((int(of[lo]), raw + b"".join(k[lo:hi].tobytes() for k in known)))
    return out


def asks(rows: list[tuple[int, bytes]], bucket: int) -> pa.Table:
    return pa.table({"block": pa.array([b for b, _ in rows], pa.int32()), "bucket": pa.array([bucket] * len(rows), pa.int32()), "asked": pa.array([x for _, x in rows], pa.binary())})


def answers(asked: DataFrame, width: int, kinds: list[str], merge: Callable[[np.ndarray, np.ndarray, list[np.ndarray]], np.ndarray], paired: bool = False) -> DataFrame:
    """Each bucket's answers. merge gets, for a block's entries of all buckets sorted by key, the index of each entry's key
    and where keys start, and the known arrays; it returns one fixed-width value an entry, which goes back in the order asked.
    paired: the first known array is the second half of the key."""
    item = width + sum(np.dtype(k).itemsize for k in kinds)

    def answer(t: pa.Table) -> pa.Table:
        raws, bucket = t.column("asked").to_pylist(), t.column("bucket").to_pylist()
        sizes = [len(r) // item for r in raws]
        keys, known = [], [[] for _ in kinds]
        for r, n in zip(raws, sizes, strict=True):
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :width] = np.frombuffer(r, np.uint8, n * width).reshape(n, width)
            keys.append(wide.view("<u8").reshape(-1))
            at = n * width
            for k, parts in zip(kinds, known, strict=True):
                parts.append(np.frombuffer(r, k, n, at))
                at += n * np.dtype(k).itemsize
        key, known = np.concatenate(keys), [np.concatenate(k) for k in known]
        order = np.lexsort((known[0], key)) if paired else np.argsort(key, kind="stable")
        key, known = key[order], [k[order] for k in known]
        new = key[1:] != key[:-1]
        starts = np.flatnonzero(np.concatenate([[True], new | (known[0][1:] != known[0][:-1]) if paired else new]))
        index = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(key))))
        value = merge(index, starts, known[1:] if paired else known)
        back = np.empty_like(value)
        back[order] = value
        ends = np.cumsum(sizes)
        block = t.column("block")[0].as_py()
        return pa.table({"bucket": pa.array(bucket, pa.int32()), "block": pa.array([block] * len(bucket), pa.int32()), "answer": pa.array([back[e - n : e].tobytes() for e, n in zip(ends, sizes, strict=True)], pa.binary())})

    return asked.groupBy("block").applyInArrow(answer, ANSWER)


def answered(t: pa.Table, kind: str) -> np.ndarray:
    """A bucket's answers, in the order of its sorted keys."""
    rows = sorted(zip(t.column("block").to_pylist(), t.column("answer").to_pylist(), strict=True))
    return np.frombuffer(b"".join(r for _, r in rows), kind)
