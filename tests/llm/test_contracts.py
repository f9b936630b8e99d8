"""The queries opN_<name> against brute force, on whole small tables and on awkward rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import brute
import pytest
from pyspark.sql import functions as F

from cadenza.llm import fingerprints, jaccard, licenses, mixing, packing, quality, queries, repeats, rules, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_key string, label string, bucket string, size string, part string"


def awkward(n=3):
    """Nulls everywhere, blank and tiny texts, repeated rows, copies, and a long text."""
    rng = random.Random(n)
    word = lambda: "".join(rng.choices("abcdefg", k=4))
    base = [word() for _ in range(400)]
    rows = [(None, None, None, None), (1, None, None, "a"), (2, "", "en", "a"), (3, " \n\t ", "en", None), (4, "one", "en", "a"), (5, "One", "en", "b"), (6, "a b c d", "en", "b"), (7, "a b c d e", "en", "b")]
    rows += [(8, " ".join(base), "en", "a"), (9, " ".join(base), "en", "a"), (9, " ".join(base), "en", "a"), (None, " ".join(base), "en", "b")]
    rows += [(10 + i, " ".join([*base[: 40 * i], word(), *base[40 * i :]]), "en", "c") for i in range(8)]
    rows += [(30 + i, " ".join([*(word() for _ in range(30)), *base[100:160], *(word() for _ in range(40))]), "fr", "c") for i in range(6)]
    rows += [(50, " ".join(base * 60), "en", "a"), (51, "ab " * 3000, "en", "c"), (52, "x" * 50_000, "en", "c"), (53, "é 𝄞   ß　Z", "de", "d"), (53, "é 𝄞   ß　Z tie", "de", "d")]
    return [(d, t, g, s, None if t is None else len(t), "k", "l", "b", "s", "p") for d, t, g, s in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def links_of(df, **how):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["n_links"]) for r in jaccard.near_copies(df, **how).collect())


@pytest.mark.parametrize("table", ["docs", "odd", "none"])
def test_op1(request, table):
    df = request.getfixturevalue(table)
    got = links_of(df)
    assert got == brute.near_copies(pairs(df))


def near_threshold(spark, n=60, words=120):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(words)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(30)}"
        rows.append((i, " ".join(w)))
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("chunk", [4, 1024])
@pytest.mark.parametrize("half", [True, False])
def test_op1_large_groups_in_chunks(spark, chunk, half):
    df = near_threshold(spark)
    got = links_of(df, chunk=chunk, half=half)
    assert got == brute.near_copies(pairs(df))


@pytest.mark.parametrize("cell", [300, 2000])
def test_op1_large_groups_by_classes_alone(spark, cell, monkeypatch):
    df = near_threshold(spark)
    monkeypatch.setattr(jaccard, "CELL", cell)
    want = brute.near_copies(pairs(df))
    assert links_of(df, chunk=4) == want
    assert [r[:3] for r in links_of(df, chunk=4, links=False)] == [r[:3] for r in want]


def test_overlaps(monkeypatch):
    rng = random.Random(4)
    base = rng.sample(range(300), 100)
    sets = [{*base[: rng.randrange(0, 101)], *rng.sample(range(300), rng.randrange(0, 12))} for _ in range(70)]
    arrays = [jaccard.np.array(sorted(x), jaccard.U) for x in sets]
    want = {(i, j) for j in range(70) for i in range(j) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    for light, rows in ((0, 512), (64, 7), (10**9, 7)):
        monkeypatch.setattr(jaccard, "LIGHT", light)
        monkeypatch.setattr(jaccard, "ROWS", rows)
        assert jaccard.overlaps(arrays[:30], arrays[30:]).tolist() == [[len(a & b) for b in sets[30:]] for a in sets[:30]]
        got = [tuple(sorted((int(a), int(b)))) for i, j in jaccard.linked(arrays, None, 75) for a, b in zip(i, j, strict=True)]
        assert sorted(got) == sorted(want) and len(want) > 100
        got = [(int(a), int(b)) for i, j in jaccard.linked(arrays[:30], arrays[30:], 75) for a, b in zip(i, j, strict=True)]
        assert sorted(got) == sorted((i, j - 30) for i, j in want if i < 30 <= j)


def test_op1_sizes_about_the_limits(spark):
    rng, rows = random.Random(7), []
    for i in range(120):
        n = rng.randrange(150, 420)
        w = [f"g{i // 4}w{j}" for j in range(n if i % 4 == 0 else 300)]
        for _ in range(rng.randrange(0, 14)):
            w[rng.randrange(len(w))] = f"x{rng.random()}"
        rows.append((1000 - i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = links_of(df)
    assert got == brute.near_copies(pairs(df))


@pytest.mark.parametrize("table", ["docs", "odd", "none"])
def test_op9(request, table):
    df = request.getfixturevalue(table)
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in repeats.removed(df).collect())
    assert got == brute.repeats(pairs(df))


def test_op9_spans_are_maximal(odd):
    for r in repeats.removed(odd).collect():
        assert len({i for a, b, _ in r["spans"] for i in range(a, b)}) == r["n_removed"]
        assert all(b - a >= 13 and d < (r["doc_id"] or 1 << 62) for a, b, d in r["spans"]) and r["spans"] == sorted(r["spans"], key=lambda x: x[0])
        assert all(x[1] - y[0] < 13 for x, y in zip(r["spans"], r["spans"][1:], strict=False) if x[2] == y[2])


def test_op9_spans_of_two_holders_stay_apart(spark):
    a, b = [f"a{i}" for i in range(20)], [f"b{i}" for i in range(20)]
    df = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(a[:15] + b[:15])), (4, " ".join(a + ["x"] + a[3:18]))], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in repeats.removed(df).collect()}
    assert got == {1: [], 2: [], 3: [[0, 15, 1], [15, 30, 2]], 4: [[0, 20, 1], [21, 36, 1]]}


def thue_morse(n, a, b):
    return "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))


@pytest.mark.parametrize("n", [8, 16, 64, 1024, 4096])
def test_words_of_two_letters_that_cancel_out(spark, n):
    """Thue-Morse words and their complements have equal sums under any base modulo a power of two."""
    x, y = thue_morse(n, "a", "b"), thue_morse(n, "b", "a")
    rows = [(1, x), (2, y), (3, " ".join(["w"] * 12 + [x])), (4, " ".join(["w"] * 12 + [y])), (5, " ".join(["v"] * 12 + [x])), (6, " ".join(["v"] * 12 + [x]))]
    rows += [(7, thue_morse(n, "a ", "b ")), (8, thue_morse(n, "b ", "a "))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert links_of(df) == brute.near_copies(rows)
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in repeats.removed(df).collect()) == brute.repeats(rows)


def test_repeated_rows_spread(spark):
    """A row that is repeated in every partition isn't gathered in one bucket or group."""
    from cadenza.llm import exchange

    df = spark.range(4000).repartition(40).select(F.lit(1).alias("doc_id"), F.lit("a b c").alias("text"))
    assert exchange.buckets(df, 40).groupBy("bucket").count().agg(F.max("count")).first()[0] < 1000


@pytest.mark.parametrize("table", ["docs", "odd", "none"])
def test_op7(request, table):
    df = request.getfixturevalue(table)
    got = sorted((str(r[0]), *r[1:]) for r in rules.ledger(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    assert got == sorted((str(d), *brute.rules(t)) for d, t in pairs(df))


def test_op7_policies_and_ablations(docs):
    led = rules.ledger(docs).cache()
    rows = [(r["failed_bits"], r["kept"]) for r in led.select("failed_bits", rules.passes(rules.STRICT).alias("kept")).collect()]
    assert all(kept == (bits == 0) for bits, kept in rows)
    for r in rules.ablations(led).collect():
        bit = next(1 << x.bit for x in rules.RULES if x.name == r["rule"])
        assert (r["n_failed"], r["n_only"]) == (sum(bool(b & bit) for b, _ in rows), sum(b == bit for b, _ in rows))
    led.unpersist()


def test_op7_spares_good_documents(spark, sf):
    out = queries.QUERIES["op7_quality_rules"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    good = out.where("quality = 1 and not base_failed")
    assert good.where("not kept").count() <= 0.02 * good.count()


@pytest.mark.parametrize("table", ["docs", "odd", "none"])
def test_op8(request, table):
    df = request.getfixturevalue(table)
    rows = sharding.sharded(df).collect()
    want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in pairs(df))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if rows:
        counts = [len(slots[i]) for i in range(40)]
        assert max(counts) - min(counts) <= 1


@pytest.mark.parametrize("n", [1, 2, 3, 7, 40, 41, 1000, 1023, 5000])
def test_op8_permutes(spark, n):
    got = [r[0] for r in spark.range(n).select(sharding.permuted(F.col("id"), n, 9)).collect()]
    assert sorted(got) == list(range(n)) and (n < 40 or got != sorted(got))


def fingerprint_rows(df, k=256):
    near = fingerprints.with_next(fingerprints.documents(df), target=1 << 14)
    return near.withColumns({"own": fingerprints.sketch("text", k), "next": fingerprints.sketch("next_text", k)})


@pytest.mark.parametrize("table", ["docs", "odd", "none"])
def test_op3_next(request, table):
    df = request.getfixturevalue(table)
    rows = sorted(((d is not None, d or 0, t or "") for d, t in pairs(df)), reverse=True)
    want = Counter((d if some else None, t, rows[(i + 1) % len(rows)][2]) for i, (some, d, t) in enumerate(rows))
    assert Counter((r["doc_id"], r["text"], r["next_text"]) for r in fingerprint_rows(df).collect()) == want


def test_op3_likeness(spark, sf):
    rows = {r["doc_id"]: r for r in queries.QUERIES["op3_fingerprints"](spark, sf).collect()}
    texts = dict(pairs(spark.read.parquet(f"{sf}/documents.parquet")))
    order = sorted(texts, reverse=True)
    off = []
    for d, after in zip(order, [*order[1:], order[0]], strict=True):
        t, m = texts[d], len(texts[d]) // 3
        edited = t[: len(t) - m] + texts[after][:m]
        assert rows[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and rows[d]["n_chars"] == len(t)
        a, b, c = brute.shingles(t), brute.shingles(edited), brute.shingles(texts[after])
        off += [abs(rows[d]["near_edited"] - (len(a & b) / len(a | b) if a | b else 1)), abs(rows[d]["near_next"] - (len(a & c) / len(a | c) if a | c else 1))]
    assert max(off) < 0.15 and sum(off) / len(off) < 0.02


def test_op3_sketches_merge(spark):
    rng = random.Random(1)
    parts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(900)) for _ in range(3)]
    df = spark.createDataFrame([(1, p) for p in parts] + [(2, None), (2, ""), (3, "a b")], "g int, text string").withColumn("s", fingerprints.sketch("text"))
    one = {r["g"]: r["s"] for r in fingerprints.merge_groups(df, ["g"], "s").collect()}
    by = [r["s"] for r in df.where("g = 1").collect()]
    assert one[1] == sorted(set().union(*by))[:256] and len(one[3]) == 1 and 2 not in one
    est = df.where("g = 1").select(fingerprints.distinct_shingles(F.col("s")), fingerprints.containment(F.col("s"), F.col("s"))).collect()
    assert all(abs(r[0] - 896) < 180 and r[1] == 1 for r in est)
    back = df.select("s", fingerprints.from_text(fingerprints.as_text(F.col("s"))).alias("b")).collect()
    assert all(r["s"] == r["b"] for r in back)


@pytest.mark.parametrize("table", ["docs", "odd", "none"])
def test_op2(request, table):
    df = request.getfixturevalue(table)
    rows = mixing.taken(df).collect()
    again = mixing.taken(df.repartition(5)).collect()
    key = lambda x: sorted((str(r["doc_id"]), r["size"], r["taken"], round(r["target"], 6)) for r in x)
    assert key(rows) == key(again) and len(rows) == df.count()
    by = defaultdict(list)
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by[r["source"]].append(r)
    size = {s: sum(r["size"] for r in x) for s, x in by.items()}
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, goal, open_ = 1.5 * sum(size.values()), {}, set(size)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * size[s]}
        for s in over or open_:
            goal[s] = 2.0 * size[s] if over else level * weight[s]
        left -= sum(goal[s] for s in over)
        open_ -= over or open_
    for s, x in by.items():
        assert all(r["source_size"] == size[s] and abs(r["target"] - goal[s]) < 1e-6 * max(1, goal[s]) for r in x)
        assert abs(sum(r["taken"] for r in x) - goal[s]) <= 2


def test_op2_tree_and_chances(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 9 + 1).cast("int")).alias("text"), F.lit("a").alias("source"))
    old, mixing.FANIN = mixing.FANIN, 8
    try:
        runs = [mixing.taken(df, seed=s).select("doc_id", "size", "taken", "target").collect() for s in range(2)]
    finally:
        mixing.FANIN = old
    for rows in runs:
        assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= 1 and sum(r["taken"] % r["size"] > 0 for r in rows) <= 1
    assert sum(a["taken"] != b["taken"] for a, b in zip(*[sorted(r, key=lambda x: x["doc_id"]) for r in runs], strict=True)) > 500


def test_op2_repeated_rows(spark, monkeypatch):
    """A row that is two thirds of all: drawn for together, in pieces, each within its bound, and the mix is what was taken."""
    monkeypatch.setattr(mixing, "SAME", 7)
    df = spark.range(300).repartition(9).select(F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 > 0, "a b c").otherwise(F.concat(F.lit("x y "), "id")).alias("text"), F.when(F.col("id") % 2 == 0, "s").alias("source"), F.col("id").alias("n"))
    rows = mixing.taken(df).collect()
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in rows) == Counter((r["doc_id"], r["source"], 3) for r in df.collect())
    for s in ("s", None):
        own = [r for r in rows if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1 and all(0 <= r["taken"] <= 6 for r in own) and own[0]["source_size"] == 450
        got = [t for d, t in [(r["source"], r["text"]) for r in mixing.mixed(df).collect()] if d == s]
        assert sum(len(brute.words(t)) for t in got) == sum(r["taken"] for r in own)


def test_op3_a_hot_id_fills_several_ranges(spark):
    rows = [(5 if i % 3 else i, f"text {i % 7 if i % 2 else i} " * 40) for i in range(300)] + [(None, f"none {i}" * 40) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = [(r["doc_id"], r["text"], r["next_text"]) for r in fingerprints.with_next(df, target=4000).collect()]
    assert Counter(g[:2] for g in got) == Counter(rows) and Counter(g[2] for g in got) == Counter(t for _, t in rows)
    single = sorted((d, t) for d, t in rows if d not in (5, None))
    follows = {a: b for a, b in zip(single[1:], single, strict=False)}
    assert all(n == follows[d, t][1] for d, t, n in got if d not in (5, None, 0, 6))  # 6 is before 5, and 0 before null


def test_op7_own_rules(odd):
    own = (rules.Rule(5, "long", "n_words > 5"), rules.Rule(6, "dull", "n_shouted = 0"))
    led = rules.ledger(odd, own)
    kept = led.where(rules.passes(rules.Policy("1", ("long",)), own)).count()
    assert kept == sum(len(brute.words(t)) <= 5 for _, t in pairs(odd))
    told = {r["rule"]: r["n_failed"] for r in rules.ablations(led, rules.Policy("1", ("long", "dull")), own).collect()}
    assert told["long"] == odd.count() - kept


def test_op2_mix_is_what_was_taken(odd, docs):
    for df in (docs, odd):
        want = sum(r["taken"] for r in mixing.taken(df).collect())
        got = mixing.mixed(df)
        assert got.columns == df.columns and sum(len(brute.words(t)) for _, t in pairs(got)) == want


@pytest.mark.parametrize("table", ["docs", "odd", "none"])
def test_op4(request, table):
    from tokenizers import Tokenizer

    df = request.getfixturevalue(table)
    t = Tokenizer.from_file(packing.tokenizer_file())
    want = Counter()
    for d, x in pairs(df):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        for s in range(0, len(ids), 1024):
            raw = b"".join(i.to_bytes(4, "little") for i in ids[s : s + 1024])
            want[d, s, len(ids[s : s + 1024]), zlib.crc32(raw), len(ids)] += 1
    rows = packing.packed(df).collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in by.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= 1024
    if len(rows) > 100:
        assert sum(r["length"] for r in rows) > 0.95 * 1024 * len(by)


def test_op4_special_strings():
    from tokenizers import Tokenizer

    t, mine = Tokenizer.from_file(packing.tokenizer_file()), packing.Tokens(packing.tokenizer_file())
    for x in ("", "a<|endoftext|>b", "naïve  𝄞\n\n\tx" * 50, "x" * 5000, "  " * 3000, "Δ'll we've 123 " * 20):
        assert mine.ids(x).tolist() == t.encode(x, add_special_tokens=False).ids


def test_op4_long_texts_are_cut_where_tokens_end(monkeypatch):
    from tokenizers import Tokenizer

    t, mine, rng = Tokenizer.from_file(packing.tokenizer_file()), packing.Tokens(packing.tokenizer_file()), random.Random(8)
    pieces = [" ", "  ", "\n", " \n ", "a", "word", "'s", "'ll", "12", "!?", "é", "𝄞", "\t", "\u3000", "\xa0", "...", "x" * 30, "Ünï"]
    for size in (1, 5, 40):
        monkeypatch.setattr(packing, "PART", size)
        for _ in range(150):
            x = "".join(rng.choices(pieces, k=rng.randrange(0, 120)))
            parts = list(packing.cut(x, size))
            assert "".join(parts) == x and all(len(p) >= size for p in parts[:-1])
            assert [i for p in parts for i in t.encode(p, add_special_tokens=False).ids] == t.encode(x, add_special_tokens=False).ids
    monkeypatch.undo()
    for x in ("word and " * 40_000, "x" * 300_000, ("y" * 150_000 + " z ") * 2):
        assert mine.ids(x).tolist() == t.encode(x, add_special_tokens=False).ids


def test_op4_first_fit():
    rng = random.Random(2)
    lengths = sorted((rng.randrange(1, 101) for _ in range(500)), reverse=True)
    got, offsets = packing.first_fit(lengths, 100)
    room, want, at = [], [], []
    for n in lengths:
        b = next((i for i, r in enumerate(room) if r >= n), len(room))
        room += [100] * (b == len(room))
        want.append(b)
        at.append(100 - room[b])
        room[b] -= n
    assert got == want and offsets == at


def test_op6(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.QUERIES["op6_quality_classifier"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    right = sum(r["predicted"] == r["quality"] for r in rows)
    bad = [r["score"] for r in rows if r["quality"] == 0]
    good = [r["score"] for r in rows if r["quality"] == 1]
    auc = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    assert right > 0.95 * len(rows) and auc > 0.97


def small_corpus(spark, n=400, part=0.5, seed=6):
    """Two kinds of text that share most words; some of either kind look like the other."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        y = int(rng.random() < part)
        own = [f"{'good' if (rng.random() < 0.7) == bool(y) else 'bad'}{rng.randrange(40)}" for _ in range(rng.randrange(1, 8))]
        w = own + [f"w{rng.randrange(200)}" for _ in range(rng.randrange(0, 30))]
        rng.shuffle(w)
        rows.append((i, " ".join(w), y))
    return rows, spark.createDataFrame(rows, "doc_id long, text string, label int")


def test_op6_against_plain_naive_bayes_support_vectors(spark):
    """Ratios over words and pairs counted one by one, and the optimum of the hinge loss."""
    np = quality.np
    rows, df = small_corpus(spark)
    held, n = quality.gathered(quality.counts(df, 16), 16)
    assert n.tolist() == [sum(y == k for _, _, y in rows) for k in (0, 1)]
    fs = quality.features([t.encode() for _, t, _ in rows], 16)
    want = [Counter(), Counter()]
    for f, (_, _, y) in zip(fs, rows, strict=True):
        want[y].update(f.tolist())
    assert all({i: int(v) for i, v in enumerate(held[k]) if v} == dict(want[k]) for k in (0, 1))
    total = [sum(c.values()) + (1 << 16) for c in want]
    r = quality.ratios(held)
    for i in list(want[0])[:300]:
        assert abs(r[i] - (np.log((want[1][i] + 1) / total[1]) - np.log((want[0][i] + 1) / total[0]))) < 1e-5
    # the gap between primal and dual objective of the hinge loss closes
    y = np.array([2 * v - 1 for _, _, v in rows])
    x = [r[f] / np.sqrt((r[f] ** 2).sum()) for f in fs]
    most = 0.1 * np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
    def primal(w, bias):
        loss = np.array([max(0.0, 1 - t * (float(w[f] @ v) + bias)) for f, v, t in zip(fs, x, y, strict=True)])
        return 0.5 * (w @ w + bias * bias) + most @ loss
    short, long = (primal(*quality.descend(fs, y, r, epochs=e)) for e in (12, 300))
    assert long <= short < 1.01 * long
    rng = np.random.default_rng(1)
    w, bias = quality.descend(fs, y, r, epochs=300)
    assert all(primal(w + 0.01 * rng.normal(size=len(w)) * (w != 0), bias) >= long * (1 - 1e-6) for _ in range(20))


def test_op6_scores_are_chances(spark):
    """On rows of the same kind, unseen: mean score and share of label 1 agree in each fifth, where classes are uneven too, and a
    sample of it that is even."""
    for part in (0.5, 0.1):
        _, df = small_corpus(spark, 4000, part)
        seen, unseen = df.where("doc_id % 2 = 0"), df.where("doc_id % 2 = 1")
        for sample in (3000, 500):
            model = quality.trained(seen, seen, sample=sample)
            rows = sorted((r["score"], r["label"]) for r in quality.scored(unseen, model).join(unseen.select("doc_id", "label"), "doc_id").collect())
            fifths = [rows[i * 400 : (i + 1) * 400] for i in range(5)]
            assert all(abs(sum(a for a, _ in x) - sum(b for _, b in x)) / 400 < 0.06 for x in fifths), (part, sample)
            base = sum(b for _, b in rows) / 2000
            assert sum((a - b) ** 2 for a, b in rows) / 2000 < 0.95 * base * (1 - base)


def test_op6_odd_labels(spark):
    """Labels other than 0 and 1 are left out, the least label of an id counts, and repeated ids are one of the sample."""
    rows, df = small_corpus(spark, 200)
    labels = df.select("doc_id", "label")
    odd = labels.unionAll(labels.where("label = 0").withColumn("label", F.lit(1))).unionAll(spark.createDataFrame([(1000, 2), (1001, -1), (None, 1), (5000, 1)], "doc_id long, label int"))
    more = df.unionAll(spark.createDataFrame([(1000, "x", 1), (1001, "y", 0)], df.schema))
    a, b = quality.trained(df, labels), quality.trained(more.repartition(7), odd)
    assert (a.ratio == b.ratio).all() and (a.weights == b.weights).all() and a.offset == b.offset
    hot = df.unionAll(df.where("doc_id = 3").withColumn("text", F.explode(F.transform(F.sequence(F.lit(1), F.lit(500)), lambda i: F.concat(F.lit("again "), i)))))
    c, d = quality.trained(hot, labels), quality.trained(hot.repartition(5), labels)
    assert (c.weights == d.weights).all() and (c.ratio == d.ratio).all()


def test_op6_awkward(odd, none, monkeypatch):
    labels = odd.select("doc_id", F.when(F.length("text") > 100, 1).otherwise(0).alias("label")).distinct()
    model = quality.trained(odd, labels)
    monkeypatch.setattr(quality, "FEW", 3)
    again = quality.trained(odd, labels)
    assert (again.ratio == model.ratio).all() and (again.weights == model.weights).all()
    assert quality.scored(odd, model).count() == odd.count() and quality.scored(none, model).count() == 0
    flat = quality.trained(odd, labels.where("label = 1"))
    assert all(r["score"] > 0.99 for r in quality.scored(odd, flat).collect())
    for docs, rows in ((none, labels), (odd, labels.limit(0)), (odd, labels.withColumn("label", F.lit(None)))):
        assert all(abs(r["score"] - 0.5) < 1e-6 for r in quality.scored(odd, quality.trained(docs, rows)).collect())


def test_op10(spark, odd, none, docs):
    text = "Intro line\nReleased under the MIT License.\nmore"
    grant = licenses.SENTENCES["mit.grant"].replace(" of ", "\nof ") + ":\n\n" + licenses.SENTENCES["mit.condition"] + "."
    bsd = ". ".join(licenses.SENTENCES[f"bsd.{k}"] for k in ("redistribution", "source", "binary", "endorse")) + "."
    mixed = ". ".join(licenses.SENTENCES[f"bsd.{k}"] for k in ("binary", "source", "redistribution"))
    gpl = licenses.SENTENCES["gpl.free"] + ".\n" + licenses.SENTENCES["gpl.hope"] + "; without even the implied warranty.\n"
    df = spark.createDataFrame([(1, text), (2, grant), (3, bsd), (4, mixed), (5, None), (6, "licence of no kind"), (7, gpl), (8, text + "\n" + "Licensed under CC BY-NC 4.0.")], "doc_id long, text string")
    got = {r["doc_id"]: r["licenses"] for r in licenses.scanned(df).collect()}
    assert got[1] == ["MIT"] and got[2] == ["MIT"] and got[3] == ["BSD-3-Clause"] and got[4] == [] and got[5] == [] and got[6] == []
    assert got[7] == ["GPL-3.0-or-later"]
    assert got[8] == ["MIT", "CC-BY-NC-4.0"]
    assert licenses.scanned(odd).count() == odd.count() and licenses.scanned(none).count() == 0
    planted = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT"}
    for r in licenses.scanned(docs).collect():
        assert set(r["licenses"]) == {v for k, v in planted.items() if k in r["text"]}


def test_buckets_and_blocks_grow_with_the_corpus():
    from cadenza.llm import exchange

    assert exchange.shape(0, 6 << 20) == (1, 0)
    for size in (10**6, 10**9, 10**11, 10**13, 10**14):
        buckets, bits = exchange.shape(size, 6 << 20)
        assert size / buckets <= exchange.BUCKET_MOST and (size < 10**11 or size / 12 / buckets / 2**bits > 8)
    assert exchange.shape(840 << 20, 6 << 20) == (210, 8)


def test_op1_and_op9_in_many_buckets(docs, monkeypatch):
    from cadenza.llm import exchange

    monkeypatch.setattr(exchange, "BUCKET_BYTES", 20_000)
    monkeypatch.setattr(exchange, "BUCKET_MOST", 20_000)
    monkeypatch.setattr(exchange, "MESSAGE", 1)
    monkeypatch.setattr(exchange, "shape", lambda n, per, f=exchange.shape: f(n, 9_000))
    assert exchange.shape(500_000, 0)[0] > 20 and exchange.shape(500_000, 0)[1] > 3
    got = links_of(docs)
    assert got == brute.near_copies(pairs(docs))
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in repeats.removed(docs).collect())
    assert got == brute.repeats(pairs(docs))
