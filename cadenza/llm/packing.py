"""Packing token sequences: first-fit decreasing over a tournament tree of bin capacities, in random groups of documents.

Documents are tokenised where they are read and cut into pieces of the full length and a rest; only the pieces' numbers are
shuffled, to groups by a hash of the document and its input partition, so repetitions of one row spread. A group packs for itself, so groups bound both memory and what a lost executor
repeats. The tree holds the room of every open bin with maxima above, so the first bin with enough room is found in
O(log bins), which is exactly first-fit.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import documents, table

LENGTH = 1024
GROUP = 4096
PART = 65_536
PIECES = "doc_id long, row_group long, start long, length long, ids_crc32 long, doc_tokens long"


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Tokens:
    """Token ids of texts as the tokenizers library gives them from a byte-level BPE file. The same vocabulary and pattern
    run in tiktoken, several times as fast, on parts of a text cut before blanks, where the pattern always cuts; texts with a special
    token's string, and parts without a blank for a great length, go to tokenizers, which is loaded when first needed."""

    def __init__(self, path: str):
        import json

        import public_tokenizers
        import tiktoken

        self.path, self._exact = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = tuple(x["content"] for x in spec.get("added_tokens", []))
        table, k = {}, 0
        for b in range(256):  # the printable stand-ins of byte-level vocabularies
            shown = 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255
            table[chr(b if shown else 256 + k)] = b
            k += not shown
        ranks = {bytes(table[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def exact(self, text: str) -> list[int]:
        if self._exact is None:
            from tokenizers import Tokenizer

            self._exact = Tokenizer.from_file(self.path)
        return self._exact.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.exact(text), np.uint32)
        parts = [np.array(self.fast.encode_ordinary(x) if len(x) <= 2 * PART else self.exact(x), np.uint32) for x in cut(text)]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def cut(text: str, size: int = PART) -> Iterator[str]:
    """Parts of `size` characters or more that join to the text again, each but the last as short as can be: a part ends where a
    blank follows something that isn't one."""
    start = 0
    while start < len(text):
        end = min(start + size, len(text))
        while end < len(text):
            end = text.find(" ", end)
            if end < 0:
                end = len(text)
            elif not text[end - 1].isspace():
                break
            else:
                end += 1
        yield text[start:end]
        start = end


class Tree:
    """Rooms of bins, grown as needed; first(need) is the first bin with that much room."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [room] * (2 * self.leaves)

    def take(self, need: int) -> tuple[int, int]:
        """The first bin with room for need, which loses it; its room before. Bins are as many as can be needed."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < need:
                at += 1
        was = room[at]
        room[at] = was - need
        out = at - self.leaves
        while at > 1:
            at //= 2
            top = max(room[2 * at], room[2 * at + 1])
            if room[at] == top:
                break
            room[at] = top
        return out, was


def first_fit(lengths: list[int], room: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length (at most room), placed in the given order."""
    tree, bins, offsets = Tree(len(lengths), room), [], []
    for n in lengths:
        b, was = tree.take(n)
        bins.append(b)
        offsets.append(room - was)
    return bins, offsets


def pieces(docs: DataFrame, path: str, length: int, groups: int, seed: int) -> DataFrame:
    own = documents(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("row_group", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id(), F.lit(seed)), F.lit(groups)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = None
        for batch in batches:
            tokens = tokens or Tokens(path)
            rows = []
            for doc, group, text in zip(batch["doc_id"].to_pylist(), batch["row_group"].to_pylist(), batch["text"], strict=True):
                ids = np.append(tokens.ids(text.as_py()), np.uint32(0)).astype("<u4")
                rows += [(doc, group, s, len(p := ids[s : s + length]), zlib.crc32(p.tobytes()), len(ids)) for s in range(0, len(ids), length)]
            names = ("doc_id", "row_group", "start", "length", "ids_crc32", "doc_tokens")
            yield pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in rows], pa.int64()) for i, c in enumerate(names)})

    return own.mapInArrow(run, PIECES)


def packed(docs: DataFrame, path: str | None = None, length: int = LENGTH, group: int = GROUP, seed: int = 1) -> DataFrame:
    """Pieces of all rows of docs (doc_id, text): doc_id, start, length, ids_crc32 (unsigned, of the ids as little-endian
    32-bit), doc_tokens (with the closing id 0), sequence_id and offset; sequences hold at most `length` tokens.

    A null or empty text is the closing id alone. Longest pieces go first; ties by doc_id, start and checksum. Repeated rows
    are packed once each. Runs over the same input partitions agree. path: the tokenizer's file. Other columns are ignored; an
    empty table gives an empty table.
    """
    groups = max(1, -(-docs.count() // group))
    cut = pieces(docs, path or tokenizer_file(), length, groups, seed)

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = first_fit(t.column("length").to_pylist(), length)
        base = t.column("row_group")[0].as_py() << 36
        out = t.drop_columns(["row_group"]).append_column("sequence_id", pa.array([base + b for b in bins], pa.int64()))
        return out.append_column("offset", pa.array(offsets, pa.int64()))

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return cut.groupBy("row_group").applyInArrow(pack, schema)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    """Every document's pieces and where they lie."""
    return packed(table(spark, sf_dir, "documents"))
