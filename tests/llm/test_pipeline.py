"""Each stage of the pipeline against brute force on what it was given."""

import hashlib
from collections import Counter, defaultdict

import brute
import corpus_pipeline
import pytest
from test_contracts import SCHEMA, awkward

from cadenza.llm import jaccard, mixing, rules


def rows(df):
    return [r.asDict() for r in df.collect()]


def run(spark, tmp_path_factory, docs):
    folder = tmp_path_factory.mktemp("stages")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, tables[-1], "").write.parquet(f"{folder}/{name}")
        tables.append(spark.read.parquet(f"{folder}/{name}"))
    return tables


@pytest.fixture(scope="module", params=["sf", "odd", "none"])
def tables(request, spark, sf, tmp_path_factory):
    if request.param == "sf":
        docs = spark.read.parquet(f"{sf}/documents.parquet")
    else:
        docs = spark.createDataFrame(awkward() if request.param == "odd" else [], SCHEMA)
    return run(spark, tmp_path_factory, docs)


def test_columns_stay(tables):
    assert all(t.columns == tables[0].columns for t in tables[:-1])


def test_quality_rules(tables):
    def passes(text):
        n, chars, symbols, dup, rep = brute.rules(text)
        w, lines = brute.words(text), [x for x in (text or "").split("\n") if brute.words(x)]
        stutter = sum(a == b for a, b in zip(w, w[1:], strict=False))
        return not (n < 20 or 100 * rep > 30 * n or 100 * symbols > 20 * n or (len(lines) >= 4 and 100 * dup > 40 * len(lines)) or not 2 * n <= chars <= 20 * n or 100 * (text or "").count("!") > 30 * n or 100 * stutter > 30 * n)

    want = Counter(str(r) for r in rows(tables[0]) if passes(r["text"]))
    assert Counter(str(r) for r in rows(tables[1])) == want


def firsts(rows):
    """Of (doc_id, text) rows those that stay, each as often as it does."""
    of = {i: c for i, n, c, _ in brute.near_copies([(i, t) for i, (_, t) in enumerate(rows)])}
    groups = defaultdict(list)
    for i, (d, t) in enumerate(rows):
        groups[of[str(i)]].append((d is None, d or 0, hashlib.md5((t or "").encode()).hexdigest(), i))
    return Counter(rows[min(g)[3]] for g in groups.values())


def test_near_copies(tables):
    before, after = rows(tables[1]), rows(tables[2])
    assert Counter((r["doc_id"], r["text"]) for r in after) == firsts([(r["doc_id"], r["text"]) for r in before])


def test_near_copies_of_odd_rows(spark):
    """Two texts under one id, ids that are null, rows without words, and repeated rows."""
    words = [f"w{i}" for i in range(60)]
    near, other = " ".join(words), " ".join(f"x{i}" for i in range(60))
    data = [(3, near), (5, near + " a"), (5, other), (None, near + " b"), (None, other + " c"), (None, "z"), (7, other), (7, other), (8, ""), (8, ""), (9, None), (None, None)]
    df = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(data)], "doc_id long, text string, n int, label string").repartition(4)
    got = jaccard.keep_first(df)
    assert got.columns == df.columns and Counter((r["doc_id"], r["text"]) for r in rows(got)) == firsts(data)



def test_a_large_group_takes_few_jobs(spark):
    """The links of a group over a block of classes were joined by rounds, as those of the groups themselves: over 140 jobs, whose
    stages and plans take the driver's memory."""
    near = [f"w{i}" for i in range(100)]
    data = [(i, " ".join([*near[: i % 100], f"x{i}", *near[i % 100 + 1 :]])) for i in range(1100)] + [(2000, "other")]
    sc = spark.sparkContext
    sc.setJobGroup("large", "")
    try:
        got = jaccard.keep_first(spark.createDataFrame(data, "doc_id long, text string")).collect()
        assert sorted(r["doc_id"] for r in got) == [0, 2000]
        assert len(sc.statusTracker().getJobIdsForGroup("large")) <= 110
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_repeats(tables):
    before, after = rows(tables[2]), rows(tables[3])
    kept = Counter()
    want = brute.repeats([(r["doc_id"], r["text"]) for r in before])
    whole = {}
    for d, n, gone, digest in want:
        if gone < n or n == 0:
            kept[d, n - gone] += 1
        whole[d, digest] = gone
    assert Counter((str(r["doc_id"]), len(brute.words(r["text"]))) for r in after) == kept
    assert all(r["n_chars"] == len(r["text"]) for r in after if r["text"] is not None)


def test_mix(tables):
    before, after = tables[3], rows(tables[4])
    want = Counter()
    for r in mixing.taken(before).collect():
        want[r["doc_id"]] += r["taken"]
    got = Counter()
    for r in after:
        got[r["doc_id"]] += len(brute.words(r["text"]))
    assert +got == +want


def test_packing(tables):
    from tokenizers import Tokenizer

    from cadenza.llm import packing

    t = Tokenizer.from_file(packing.tokenizer_file())
    want = Counter()
    for r in rows(tables[4]):
        n = len(t.encode(r["text"] or "", add_special_tokens=False).ids) + 1
        want.update((r["doc_id"], s, min(1024, n - s)) for s in range(0, n, 1024))
    assert Counter((r["doc_id"], r["start"], r["length"]) for r in rows(tables[5])) == want


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 50


def test_stages_are_rules_joins_repeats_mix_packing():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard", "substring_dedup", "mix_sources", "packing"]
    assert rules.STRICT.mask == (1 << len(rules.RULES)) - 1
