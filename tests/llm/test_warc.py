"""The derivative builder: links, digests, texts, and round trips through files."""

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from cadenza.llm import queries, warc

SCHEMA = "page_id long, url string, html string, type string, block string, headers string"


@pytest.fixture(scope="module")
def pages(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    html = '<html lang="de"><head><title>A &amp; B</title><style>p{}</style></head><body><p>One<br>two <b>three</b></p><script>var x="</p>";</script><!-- gone -->&copy; 2 &lt;3</body></html>'
    rows = [(1, "http://a", html), (1, "http://a", html), (2, None, None), (None, "http://b", ""), (3, "http://c", "plain\nWARC/1.1\r\nWARC-Type: response\r\n\r\nfake"), (4, "http://d", "<p>" + "x " * 200_000)]
    return spark.createDataFrame([(*r, "t", "b", "h") for r in rows], SCHEMA)


def sha1(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


@pytest.mark.parametrize("table", ["pages", "odd"])
def test_derivatives_link_and_digest(request, table):
    df = request.getfixturevalue(table)
    responses = {r["record_id"]: r for r in warc.responses(df).collect()}
    out = warc.derived(warc.responses(df)).collect()
    assert len(out) == 2 * df.count() and {r["type"] for r in out} == {"metadata", "conversion"}
    for r in out:
        source = responses[r["refers_to"]]
        head = {h["name"]: h["value"] for h in r["headers"]}
        assert head["WARC-Refers-To"] == source["record_id"] and head["WARC-Target-URI"] == source["target_uri"] and head["WARC-Date"] == source["date"]
        body = source["block"].split(b"\r\n\r\n", 1)[1]
        assert r["payload_digest"] == head["WARC-Payload-Digest"] == sha1(body) == source["payload_digest"]
        assert r["block_digest"] == sha1(r["block"]) and int(head["Content-Length"]) == len(r["block"])
        if r["type"] == "metadata":
            assert b"payload-digest-agrees: true" in r["block"] and b"http-content-type: text/html; charset=utf-8" in r["block"]


def test_plain_text():
    """A hidden element is a blank; other tags vanish."""
    page = '<html><head><title>T</title></head><body><p>One<br>two <b>three</b></p><script>var x="</p>";</script><!-- gone --><td>&copy; 2 &lt;3</td><style>a</style>tail'
    assert warc.plain_text(page) == "One\ntwo three\n© 2 <3 tail"
    assert warc.plain_text("") == "" and warc.plain_text("a < b") == "a < b"


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_files_round_trip(spark, odd, tmp_path, compression):
    records = warc.responses(odd).unionByName(warc.derived(warc.responses(odd))).repartition(2)
    path = str(tmp_path / compression)
    warc.write_records(records, path, compression)
    back = warc.read_records(spark, path + "/part-*")
    key = lambda df: sorted((r["record_id"], r["type"], r["refers_to"] or "", bytes(r["block"]), [tuple(h) for h in r["headers"]]) for r in df.collect())
    assert key(back) == key(records)
    again = warc.derived(back)
    assert key(again) == key(warc.derived(warc.responses(odd)))


def test_a_false_digest_is_told(spark, odd):
    wrong = warc.responses(odd.limit(1)).withColumn("payload_digest", F.lit("sha1:NONE"))
    meta = warc.derived(wrong).where("type = 'metadata'").first()
    assert b"payload-digest-agrees: false" in meta["block"] and meta["payload_digest"] != "sha1:NONE"


def test_query_and_empty(spark, sf, pages):
    assert queries.QUERIES["op5_warc"](spark, sf).count() == 2 * pages.count()
    assert warc.derived(warc.responses(pages.limit(0))).count() == 0
    assert warc.derived(warc.derived(warc.responses(pages))).count() == 0
