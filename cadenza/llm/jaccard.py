"""N-gram Jaccard join: which documents are near copies, how many each links with, and the classes their links make.

The document by 5-word-shingle incidence matrix is multiplied by its transpose in blocks, and pairs below bounds that follow
from the sets' sizes are discarded or never formed:

1. A bound by size. A document of n shingles that links (Jaccard t or more) lacks at most k = floor((1 - t) n) of them in its
   partner. Buckets ask blocks of the hash space how many documents hold each shingle (see exchange.py). A document with more
   than k shingles of its own alone is out. Documents over 256 shingles send half of the hash space only: the bound is as
   exact there, and most documents exceed it.
2. Prefixes. In one order of all shingles, rarest first, linked documents share one of their first k + 1. Those join the rest
   into candidate groups, a small superset of the answer. Equal sets are one class from here on.
3. Blocked products. Classes of a candidate group are ordered by size; a block of rows is multiplied with the columns whose size
   lets them link, overlap counts accumulate over blocks of shingles, and pairs below the bound for their sizes are dropped.
   Groups of more classes than a block are cut into cells of neighbouring sizes, and each two cells whose sizes are near
   enough meet in a task of their own.

Every link between different texts is found and counted. The count is by nature quadratic in the classes of one candidate
group, which is spread over tasks. Where only the classes of a large group are asked for (links=False), each chunk is multiplied by
itself, then the best-connected class of each component with every chunk, and then only classes outside the group's largest
component: members of one large group of near copies are not multiplied with each other again and again.

Shingles are compared by 64-bit hashes (see _text.py), equal sets by 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import exchange as X
from ._spark import components, documents, saved, table, text_bytes, with_least
from ._text import Words, union_find

U = np.uint64
CELL = 1 << 20
SMALL, SURE = 256, 192  # up to SMALL shingles all are sent; up to SURE every partner has at most SMALL at t >= 0.75
LIGHT, ROWS, COLUMNS = 64, 512, 2048  # pairs a shingle makes one by one; rows and shingles of a dense block


def _tokens(t: pa.Table, kept: int, n: int, half: bool) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """Sets, the part of each that is sent (the `kept` high bits of a hash), all of those once, and in how many rows each is."""
    sets = Words(X.texts(t), lower=True).shingles(n)
    keep = U(0xFFFFFFFFFFFFFFFF) << U(64 - kept)
    sent = [(s if len(s) <= SMALL or not half else s[(s & U(1)) == 0]) & keep for s in sets]
    both = np.sort(np.concatenate([*sent, np.zeros(0, U)]))
    start = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, int)
    return sets, sent, both[start], np.diff(np.append(start, len(both)))


def _counted(index: np.ndarray, starts: np.ndarray, known: list[np.ndarray]) -> np.ndarray:
    total = np.add.reduceat(known[0].astype(np.int64), starts) if len(starts) else starts
    return np.minimum(total, 255).astype(np.uint8)[index]


def _entries(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All elements of the sets, sorted, and the set of each."""
    flat = np.concatenate([*sets, np.zeros(0, U)])
    order = np.argsort(flat, kind="stable")
    return flat[order], np.repeat(np.arange(len(sets)), [len(s) for s in sets])[order]


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each set on the left shares with each on the right: elements of few holders by their pairs, the others by
    dense products of column blocks."""
    (a, of_a), (b, of_b) = _entries(left), _entries(right)
    out = np.zeros(len(left) * len(right), np.float32)
    once = np.intersect1d(a, b)
    at_a, at_b = np.searchsorted(a, once), np.searchsorted(b, once)
    n_a, n_b = np.searchsorted(a, once, "right") - at_a, np.searchsorted(b, once, "right") - at_b
    light = np.flatnonzero(n_a * n_b <= LIGHT)
    if len(light):
        n = n_a[light] * n_b[light]
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        i = of_a[np.repeat(at_a[light], n) + k // np.repeat(n_b[light], n)]
        j = of_b[np.repeat(at_b[light], n) + k % np.repeat(n_b[light], n)]
        out += np.bincount(i * len(right) + j, minlength=len(out)).astype(np.float32)
    out = out.reshape(len(left), len(right))
    heavy = np.flatnonzero(n_a * n_b > LIGHT)

    def dense(at: np.ndarray, n: np.ndarray, of: np.ndarray, size: int) -> np.ndarray:
        m = np.zeros((size, len(at)), np.float32)
        entry = np.repeat(at - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        m[of[entry], np.repeat(np.arange(len(at)), n)] = 1
        return m

    for lo in range(0, len(heavy), COLUMNS):
        h = heavy[lo : lo + COLUMNS]
        out += dense(at_a[h], n_a[h], of_a, len(left)) @ dense(at_b[h], n_b[h], of_b, len(right)).T
    return out


def linked(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of pairs that reach the Jaccard similarity, each pair once, block by block of rows: of a set on the left and one on
    the right, or of two on the left if right is None. Columns whose size rules out a link aren't multiplied."""
    same, right = right is None, left if right is None else right
    sizes = [np.array([len(s) for s in x], np.int64) for x in (left, right)]
    by = [np.argsort(n, kind="stable") for n in sizes]
    n_left, n_right = (n[o] for n, o in zip(sizes, by, strict=True))
    for lo in range(0, len(left), ROWS):
        n = n_left[lo : lo + ROWS]
        first, last = np.searchsorted(n_right, -(-percent * n[0] // 100)), np.searchsorted(n_right, 100 * n[-1] // percent, "right")
        first = max(first, lo if same else 0, np.searchsorted(n_right, 1))
        if first >= last:
            continue
        both = overlaps([left[i] for i in by[0][lo : lo + ROWS]], [right[i] for i in by[1][first:last]])
        i, j = np.nonzero(100 * both.astype(np.int64) >= percent * (n[:, None] + n_right[None, first:last] - both.astype(np.int64)))
        keep = (j + first > i + lo) | (not same)
        yield by[0][i[keep] + lo], by[1][j[keep] + first]


class _Classes:
    """A table's classes: sets, and links and least members as pairs come in. Rows are ordered by (sig, sig2)."""

    def __init__(self, t: pa.Table):
        self.sets = [np.frombuffer(x, "<u8") for x in t.column("shingles").to_pylist()]
        self.copies = t.column("copies").to_numpy()
        self.label, self.links = np.arange(len(self.sets)), np.zeros(len(self.sets), np.int64)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        for x, y in ((i, j), (j, i)):
            self.links += np.bincount(x, weights=self.copies[y], minlength=len(self.links)).astype(np.int64)
        self.label = union_find(len(self.label), self.label[i], self.label[j])[self.label]


CLASS = "sig long, sig2 long, label struct<sig:bigint,sig2:bigint>, links long"
_LABEL = pa.struct([("sig", pa.int64()), ("sig2", pa.int64())])


def _told(t: pa.Table, c: _Classes) -> pa.Table:
    sig, sig2 = (t.column(x).to_numpy() for x in ("sig", "sig2"))
    label = pa.StructArray.from_arrays([pa.array(sig[c.label]), pa.array(sig2[c.label])], fields=list(_LABEL))
    return pa.table({"sig": sig, "sig2": sig2, "label": label, "links": c.links})


def _inside(percent: int):
    """Product of each group (part) in the table with itself: each class with the least one of its component, and the rows that it
    links with outside itself."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("part", "ascending"), ("sig", "ascending"), ("sig2", "ascending")])
        part, c = t.column("part").to_numpy(), _Classes(t)
        cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        for lo, hi in zip(cut, [*cut[1:], len(part)], strict=True):
            for i, j in linked(c.sets[lo:hi], None, percent):
                c.add(i + lo, j + lo)
        return _told(t, c)

    return run


def _cells(percent: int):
    """Product of two cells of a group (first: of the one, else of the other), or of one with itself."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("sig", "ascending"), ("sig2", "ascending")])
        c, first = _Classes(t), t.column("first").to_numpy(zero_copy_only=False)
        a, b = np.flatnonzero(first), np.flatnonzero(~first)
        for i, j in linked([c.sets[k] for k in a], [c.sets[k] for k in b] if len(b) else None, percent):
            c.add(a[i], b[j] if len(b) else a[j])
        return _told(t, c)

    return run


def _whole(big: DataFrame, percent: int, chunk: int) -> DataFrame:
    """The classes of candidate groups over `chunk` (CLASS), all pairs that sizes allow multiplied, cell by cell. A cell is a run
    of neighbouring sizes of `chunk` classes at most, or a part by hash of the classes of one size; its sets are CELL
    shingles at most or one class."""
    step = F.greatest(F.lit(1), F.floor(F.lit(CELL) / F.col("n")))
    sizes = big.groupBy("group", "n").agg(F.count(F.lit(1)).alias("m")).withColumn("room", F.least(F.lit(chunk), step).cast("long"))
    before = Window.partitionBy("group").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns({"band": F.floor(F.coalesce(F.sum(F.col("m") / F.col("room")).over(before), F.lit(0.0))).cast("long"), "parts": F.ceil(F.col("m") / F.col("room")).cast("int")})
    own = F.col("parts") > 1  # cells: (band, size or -1, part or -1)
    cell = F.struct("band", F.when(own, F.col("n")).otherwise(-1).alias("of"), F.when(own, F.pmod(F.xxhash64("sig", "sig2"), F.col("parts"))).otherwise(-1).alias("part"))
    of = big.join(sizes.select("group", "n", "band", "parts"), ["group", "n"]).withColumn("cell", cell)
    of = saved(of.select("group", "cell", "sig", "sig2", "n", "copies", "shingles"))
    cells = of.groupBy("group", "cell").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    other = cells.select("group", F.col("cell").alias("cell2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    near = (100 * F.col("hi") >= percent * F.col("lo2")) & (100 * F.col("hi2") >= percent * F.col("lo"))
    pairs = cells.join(other, "group").where(near & (F.col("cell") <= F.col("cell2"))).select("group", "cell", "cell2")
    one = of.join(pairs, ["group", "cell"]).withColumn("first", F.lit(True))
    two = of.withColumnRenamed("cell", "cell2").join(pairs.where("cell <> cell2"), ["group", "cell2"]).withColumn("first", F.lit(False))
    told = saved(one.unionByName(two).groupBy("group", "cell", "cell2").applyInArrow(_cells(percent), CLASS))
    own = F.struct("sig", "sig2")
    reached = components(told.select(own.alias("a"), F.col("label").alias("b")).distinct())
    counted = told.groupBy("sig", "sig2").agg(F.sum("links").alias("links"))
    return counted.join(reached.withColumnRenamed("node", "label"), own == F.col("label"), "left").select("sig", "sig2", F.coalesce("component", own).alias("label"), "links")


def _across(percent: int):
    """Links between classes of two components in the table, one for each two components at most."""

    def run(t: pa.Table) -> pa.Table:
        c, guest = _Classes(t), t.column("guest").to_numpy(zero_copy_only=False)
        labels = t.column("label").combine_chunks()
        code = {}
        code = np.array([code.setdefault(x, len(code)) for x in zip(labels.field("sig").to_pylist(), labels.field("sig2").to_pylist(), strict=True)], np.int64)
        a, b = np.flatnonzero(guest), np.flatnonzero(~guest)
        found = {}
        for i, j in linked([c.sets[k] for k in a], [c.sets[k] for k in b], percent):
            found |= {(x, y): (int(p), int(q)) for x, y, p, q in zip(code[a[i]].tolist(), code[b[j]].tolist(), a[i], b[j], strict=True) if x != y}
        at = np.array(list(found.values()), np.int64).reshape(-1, 2)
        return pa.table({"a": labels.take(pa.array(at[:, 0])), "b": labels.take(pa.array(at[:, 1]))})

    return run


def _meet(members: DataFrame, guests: DataFrame, chunk: int, percent: int) -> DataFrame:
    """Links between the guests and the members of each group, chunk by chunk."""
    count = guests.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("n_guests"))
    at = lambda n: F.pmod(F.xxhash64("sig", "sig2"), n).cast("int")
    own = ("label", "copies", "shingles")
    left = members.join(count, "group").select("group", at(F.col("n_chunks")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("n_guests") - 1)).alias("j"), *own, F.lit(False).alias("guest"))
    right = guests.join(count, "group").select("group", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("i"), at(F.col("n_guests")).alias("j"), *own, F.lit(True).alias("guest"))
    kind = "struct<sig:bigint,sig2:bigint>"
    return left.unionAll(right).groupBy("group", "i", "j").applyInArrow(_across(percent), f"a {kind}, b {kind}")


def _large(big: DataFrame, percent: int, chunk: int) -> DataFrame:
    """The classes of candidate groups over `chunk` (CLASS), without their links."""
    big = big.withColumn("n_chunks", F.ceil(F.col("size") / chunk).cast("int"))
    parted = big.withColumn("part", F.xxhash64("group", F.pmod(F.xxhash64("sig", "sig2"), F.col("n_chunks"))))
    own = parted.groupBy("part").applyInArrow(_inside(percent), CLASS)
    here = saved(big.join(own, ["sig", "sig2"]).select("group", "sig", "sig2", "label", "links", "n_chunks", "copies", "shingles"))
    for step in ("hubs", "rest"):
        if step == "hubs":
            best = here.groupBy("label").agg(F.max_by(F.struct("sig", "sig2"), F.struct("links", "sig", "sig2")).alias("best"))
            guests = here.join(best.select("best.sig", "best.sig2"), ["sig", "sig2"], "left_semi")
        else:
            most = here.groupBy("group", "label").count().groupBy("group").agg(F.max_by("label", F.struct("count", "label")).alias("most"))
            guests = here.join(most, "group").where("label <> most").drop("most")
        joined = components(_meet(here, guests, chunk, percent)).withColumnRenamed("node", "label")
        here = saved(here.join(joined, "label", "left").withColumn("label", F.coalesce("component", "label")).drop("component"))
    return here.select("sig", "sig2", "label", F.lit(None).cast("long").alias("links"))


def _classified(docs: DataFrame, percent: int, shingle: int, chunk: int, links: bool, half: bool = True, keyed: bool = False) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, text_key if keyed, n_shingles, and sig and sig2 of their class, null for what can't link), and the classes
    (sig, sig2, low, label, copies, n_links)."""
    if not 75 <= percent <= 100:
        raise ValueError("percent must be 75 to 100")
    docs = documents(docs)
    n_rows, size = text_bytes(docs)
    n_buckets, bits = X.shape(size, 6 << 20)
    width = min(6, (61 - bits) // 8)
    dealt = X.buckets(docs, n_buckets)
    schema = "doc_id long, text_key string, n_shingles long, sig long, sig2 long, home int, shingles binary, prefix array<long>, unsure boolean"

    def ask(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        _, _, once, rows = _tokens(t, bits + 8 * width, shingle, half)
        return X.asks(X.asking(once, bits, width, [np.minimum(rows, 255).astype(np.uint8)]), key[0].as_py())

    def read(key: tuple[pa.Scalar, ...], t: pa.Table, got: pa.Table) -> pa.Table:
        """The bucket's rows; the first of each class carries its shingles and prefix, and the bucket's number as their home."""
        sets, sent, once, _ = _tokens(t, bits + 8 * width, shingle, half)
        df = X.answered(got, "u1")
        out, told = [], set()
        for doc, text, s, e in zip(X.ids(t), X.texts(t), sets, sent, strict=True):
            n, code, k, prefix, unsure = len(s), df[np.searchsorted(once, e)], len(s) * (100 - percent) // 100, [], False
            spaces = [(0, e, code)] if n <= SMALL or not half else []  # of all shingles, or of the half that all documents send
            if half and n > SURE:
                in_half = np.ones(len(e), bool) if n > SMALL else (s & U(1)) == 0
                spaces.append((1, e[in_half], code[in_half]))
                unsure = np.count_nonzero(in_half) <= k
            for space, of, own in spaces:
                if np.count_nonzero(own < 2) <= k:
                    first = np.lexsort((of, own))[: k + 1]
                    prefix.append(((of[first][own[first] >= 2] >> U(1)) & ~U(1)) | U(space))
            tokens = np.concatenate([*prefix, np.zeros(0, U)]).view(np.int64)
            stays = n and len(tokens)
            raw = s.astype("<u8").tobytes() if n and len(tokens) else None
            sig = tuple(np.frombuffer(hashlib.blake2b(raw, digest_size=16).digest(), "<i8").tolist()) if raw else (None, None)
            own = (key[0].as_py(), raw, tokens.tolist()) if raw and sig not in told else (None, None, None)
            told.add(sig)
            out.append((doc, hashlib.md5(text).hexdigest() if keyed else None, n, *sig, *own, bool(unsure)))
        names = ("doc_id", "text_key", "n_shingles", "sig", "sig2", "home", "shingles", "prefix", "unsure")
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.bool_())
        return pa.table({c: pa.array([r[i] for r in out], kind) for i, (c, kind) in enumerate(zip(names, kinds, strict=True))})

    asked = dealt.groupBy("bucket").applyInArrow(ask, X.ASK)
    got = X.answers(asked, width, ["u1"], _counted)
    found = saved(dealt.groupBy("bucket").cogroup(got.groupBy("bucket")).applyInArrow(read, schema))
    if half and found.where("unsure").limit(1).count():  # 8 standard deviations off: the whole space decides
        return _classified(docs, percent, shingle, chunk, links, False, keyed)

    classes = saved(found.where("sig is not null").groupBy("sig", "sig2").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("copies"), F.min("home").alias("home"), F.first("prefix", True).alias("prefix")))
    # groups by one half of a class's key: two classes that share it are in one group, which stays a superset
    entry = classes.select(F.explode("prefix").alias("a"), F.col("sig").alias("b"))
    hub = entry.groupBy("a").agg(F.min("b").alias("m"), F.max("b").alias("other"), F.count(F.lit(1)).alias("d")).where("m <> other").drop("other")
    near = components(with_least(entry, hub).select(F.col("b").alias("a"), F.col("m").alias("b")))
    near = near.select(F.col("node").alias("sig"), F.col("component").alias("group"))
    sizes = near.groupBy("group").agg(F.count(F.lit(1)).alias("size"))
    sized = classes.drop("prefix", "low").join(near.join(sizes, "group"), "sig")  # numbers alone; shingles are shuffled for the next join and to their tables
    candidate = found.where("shingles is not null").select("sig", "sig2", "home", F.expr("octet_length(shingles) div 8").alias("n"), "shingles").join(sized, ["sig", "sig2", "home"])
    tables = max(1, size // (16 << 20), min(n_rows // 500, 2000))
    small = candidate.where(F.col("size") <= chunk).withColumn("part", F.col("group")).groupBy(F.pmod(F.xxhash64("group"), F.lit(tables)).alias("t")).applyInArrow(_inside(percent), CLASS)
    if sizes.where(F.col("size") > chunk).limit(1).count():
        small = small.unionByName((_whole if links else _large)(candidate.where(F.col("size") > chunk), percent, chunk))
    own = F.struct("sig", "sig2")
    label = saved(classes.select("sig", "sig2", "low", "copies").join(small, ["sig", "sig2"], "left").select("sig", "sig2", "low", F.coalesce("label", own).alias("label"), "copies", (F.coalesce("links", F.when(F.col("label").isNull() | F.lit(links), 0)) + F.col("copies") - 1).alias("n_links")))
    return found.drop("home", "shingles", "prefix", "unsure"), label


def near_copies(docs: DataFrame, percent: int = 75, shingle: int = 5, chunk: int = 1024, links: bool = True, half: bool = True) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, n_shingles, component_id, the least doc_id it reaches by links, and
    n_links, the other rows that it links with (null in large groups if links is False).

    Words are runs of non-space bytes, A-Z lower-cased. Null, empty and blank texts have no shingles and link with nothing.
    Equal sets link. Repeated rows each return a row, and link. A null doc_id is never a component_id unless its component has no
    other. percent: 75 or more, for the bounds of step 1. Other columns are ignored; an empty table gives an empty table.
    """
    found, label = _classified(docs, percent, shingle, chunk, links, half)
    own = F.struct("sig", "sig2")
    least = label.groupBy(F.col("label").alias("a")).agg(F.min("low").alias("m"), F.count(F.lit(1)).alias("d"))
    of = with_least(label.select(F.col("label").alias("a"), F.struct(own.alias("own"), "n_links", "copies").alias("b")), least)
    of = of.select(F.col("b.own").alias("a"), F.struct(F.col("m").alias("component_id"), "b.n_links").alias("m"), F.col("b.copies").alias("d"))
    some = with_least(found.where("sig is not null").select(own.alias("a"), F.struct("doc_id", "n_shingles").alias("b")), of).select("b.doc_id", "b.n_shingles", "m.component_id", "m.n_links")
    return some.unionByName(found.where("sig is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links")))


def op1_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """Every document of `documents` with its near-copy class and the number of its links."""
    return near_copies(table(spark, sf_dir, "documents"))


def keep_first(docs: DataFrame) -> DataFrame:
    """docs without near copies: of each component one row stays, that of the least (doc_id, checksum of the text), null ids
    last; of rows that are alike in these, one in no order. Texts without words link with nothing and stay, repeated
    ones too. An empty table gives an empty table.

    Rows are told apart by (doc_id, checksum), so two texts under one id are decided apart."""
    found, label = _classified(docs, 75, 5, 1024, links=False, keyed=True)
    key = (F.coalesce("doc_id", F.lit(0)).cast("long").alias("__id"), F.col("doc_id").isNull().alias("__none"))
    rows = found.join(label.select("sig", "sig2", "label"), ["sig", "sig2"]).groupBy("label", *key, "text_key").agg(F.count(F.lit(1)).alias("n"))
    best = rows.groupBy("label").agg(F.min(F.struct("__none", "__id", "text_key", "n")).alias("r")).select("r.__id", "r.__none", "r.text_key", (F.col("r.n") > 1).alias("__again"))
    alone = found.where("sig is null").select(*key, "text_key", F.lit(False).alias("__again")).distinct()
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("__row")
    own = docs.select(whole, F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_key"), F.coalesce(docs["doc_id"].cast("long"), F.lit(0)).alias("__id"), docs["doc_id"].isNull().alias("__none"))
    kept = own.join(best.unionByName(alone), ["__id", "__none", "text_key"])
    return kept.where("not __again").unionByName(kept.where("__again").dropDuplicates(["__id", "__none", "text_key"])).select("__row.*")


OP1_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM t)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS root FROM t UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.root),
k AS (SELECT a, count(*) AS links FROM e GROUP BY a)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(root) AS component_id, coalesce(any_value(links), 0) AS n_links FROM r LEFT JOIN n ON n.doc_id = r.doc_id LEFT JOIN k ON k.a = r.doc_id GROUP BY r.doc_id
"""
