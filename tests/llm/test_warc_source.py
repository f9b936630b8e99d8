"""What derived records keep of their response, and pages whose head has no end tag."""

import gzip
import hashlib
import time
import zlib

from pyspark.sql import functions as F

from cadenza.llm import warc


def test_a_head_without_end():
    assert warc.plain_text("<html><head><title>x</title><body><p>Hello <b>you</b></body></html>") == "Hello you"
    assert warc.plain_text('<head><meta charset=utf-8><script>a("<p>no</p><body>")</script><!-- <p> --><p>Hello') == "Hello"
    assert warc.plain_text("<head><title>x</title>Bare text") == "Bare text"
    assert warc.plain_text("<head><title>x</title><style>p{}</style></head><header>Top</header>") == "Top"
    assert warc.plain_text("<script>'<head>'</script><p>One</p><head><link rel=a>") == "One"


def test_source_headers_and_digest_come_along(spark):
    page = spark.createDataFrame([(1, "http://a", '<html lang="de"><p>Text')], "page_id long, url string, html string")
    body = b'<html lang="de"><p>Text'
    more = [("WARC-IP-Address", "192.0.2.1"), ("WARC-Warcinfo-ID", "<urn:uuid:1>"), ("WARC-Truncated", "length"), ("WARC-Concurrent-To", "<urn:a>"), ("WARC-Concurrent-To", "<urn:b>"), ("WARC-Identified-Content-Language", "fr")]
    extra = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(v).alias("value")) for n, v in more])
    for claim, agrees in (("sha256:" + hashlib.sha256(body).hexdigest(), "true"), ("sha1:NONE", "false"), ("odd:1", "unknown")):
        rows = warc.derived(warc.responses(page).withColumn("headers", F.concat("headers", extra)).withColumn("payload_digest", F.lit(claim))).collect()
        assert {r["type"] for r in rows} == {"metadata", "conversion"}
        for r in rows:
            head = [(h["name"], h["value"]) for h in r["headers"]]
            assert [h for h in head if h in more] == more and ("WARC-Source-Payload-Digest", claim) in head
            assert len([n for n, _ in head if n in ("WARC-Type", "Content-Length", "WARC-Payload-Digest", "WARC-Identified-Content-Language")]) == 4
            if r["type"] == "metadata":
                assert f"payload-digest-agrees: {agrees}\r\n".encode() in r["block"] and f"payload-digest-claimed: {claim}".encode() in r["block"]


def test_pages_as_the_standard_reads_them():
    read = {
        '<p title="a > b">hello': "hello", "a < b": "a < b", "x <y cut off": "x", "<a b'c>t</a>": "t", "<!--> t": "t", "a<!-- b": "a", "</ x>y": "y", "<?php x ?>z": "z", "<p>a</p >b<br/>c": "a\nb\nc", "a<": "a<",
        "<script>a<b</script >x": "x", "<script></scripted>a</script>b": "b", "<head> text <p>x": "text\nx", "<td>a</td><td>b": "ab", "<p a=\"<p>\">1<p a='>'>2": "1\n2", "&lt;p&gt;": "<p>",
    }
    assert {k: warc.plain_text(k) for k in read} == read
    assert warc.parsed('<html data-x="1" lang=en-GB><head><title> A &amp;\n B</title></head>c<title>d</title>') == ("c\nd", "A & B", "en-GB")


def test_hostile_pages_take_linear_time():
    for x in ("<a ", '<a x="', '<a x=">" ', "<title>", "<!--", "<script", "<head>", "<", "&", "</", "<a ='\"", "<head><x ", "<!", "<p>&#x", "<title></titl"):
        began = time.perf_counter()
        warc.parsed("<html>" + x * 80_000)
        assert time.perf_counter() - began < 1


def response(rid, body, kind="text/html; charset=utf-8"):
    block = f"HTTP/1.1 200 OK\r\nContent-Type: {kind}\r\nX-A: b\nc\r\n\r\n".encode() + body
    return warc._record("response", "http://a", warc.DATE, block, "application/http;msgtype=response", rid, payload=warc.digest(body))


def test_charsets(spark):
    cases = {"undefined": b"caf\xc3\xa9", "idna": b"a", "utf-8": b"caf\xc3\xa9", "latin-1": b"caf\xe9", "nonsense": b"caf\xc3\xa9", "base64": b"a", "unicode_escape": b"\\ud800 a", "utf-7": b"+2AA- a", "utf-16": "é".encode("utf-16"), "a" * 500: b"x", "punycode": b"a-"}
    rows = [response(k, b"<p>" * (k != "utf-16") + v, f"text/html; charset={k}") for k, v in cases.items()]
    got = {r["refers_to"]: r["block"].decode() for r in warc.derived(spark.createDataFrame(rows, warc.RECORD)).collect() if r["type"] == "conversion"}
    assert len(got) == len(cases) and all(got[k] == "café" for k in ("undefined", "utf-8", "latin-1", "nonsense")) and got["utf-16"] == "é"


def test_lines_in_header_values_make_no_lines(spark):
    meta = warc.derived(spark.createDataFrame([response("x", b"a")], warc.RECORD)).where("type = 'metadata'").first()
    assert b"http-x-a: b c\r\n" in meta["block"]


def test_one_member_a_record_and_streams(spark, tmp_path):
    """Any bytes in blocks, blocks that look like records, blocks over 16 MB, several files, and pieces of members."""
    bodies = [b"\xff\x00\xfe", b"WARC/1.1\r\nWARC-Type: response\r\n\r\nfake", b"", b"z" * ((1 << 24) + 5), b"WARC/1.WARC/1.", b"end\r\n\r\n"] + [b"page %d" % i for i in range(50)]
    df = spark.createDataFrame([response(f"<{i}>", b) for i, b in enumerate(bodies)], warc.RECORD).repartition(3)
    want = sorted((r["record_id"], bytes(r["block"]), tuple(map(tuple, r["headers"]))) for r in df.collect())
    told = lambda x: sorted((r["record_id"], bytes(r["block"]), tuple(map(tuple, r["headers"]))) for r in x.collect())
    for compression in ("gzip", "none"):
        folder = tmp_path / compression
        warc.write_records(df, str(folder), compression)
        assert told(warc.read_records(spark, f"{folder}/part-*")) == want
        if compression == "gzip":
            files = sorted(folder.glob("part-*"))
            for f in files:
                raw, n, z = f.read_bytes(), 0, None
                while raw:
                    z = zlib.decompressobj(wbits=31)
                    start = z.decompress(raw)
                    raw, n = z.unused_data, n + 1
                    assert start[:8] == b"WARC/1.1" or len(start) < 1000
                f.rename(f.with_suffix(".warc.gz"))
            assert told(warc.stream_records(spark, f"{folder}/part-*.warc.gz")) == want
    assert warc.read_records(spark, f"{tmp_path}/none/_SUCCESS").count() == 0


def test_files_cut_off_give_what_there_is():
    whole = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
    rows = lambda raw, n: list(warc.parse(raw[i : i + n] for i in range(0, len(raw), n)))
    for n in (1, 3, 1000):
        assert [r["block"] for r in rows(whole * 3, n)] == [b"abcde"] * 3
        assert [r["block"] for r in rows(whole + whole[:-6], n)] == [b"abcde", b"abc"]
        assert [r["block"] for r in rows(whole + whole[:20], n)] == [b"abcde"] and rows(b"", n) == [] and rows(b"none", n) == []
        assert [r["block"] for r in rows(whole.replace(b": 5", b": many") + whole, n)] == [b"", b"abcde"]
    packed = gzip.compress(whole) + bytes(3) + gzip.compress(whole)
    assert [r["block"] for r in warc.parse(warc._inflated(packed, 7))] == [b"abcde"] * 2
    assert [r["block"] for r in warc.parse(warc._inflated(packed[:-20], 7))][:1] == [b"abcde"]
