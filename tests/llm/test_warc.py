import gzip
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from sparkann.llm import warc
from sparkann.llm.common import scratch_path

BIG = "é\r\n\r\nWARC/1.1\r\nx" * 20
ROWS = [(4, "http://a/", BIG), (2, "http://b/", BIG), (2, "http://b/", BIG), (None, None, BIG), (7, "u\r\nX-Evil: 1", "small"), (8, "v", "small"), (9, "w", None), (10, "w", ""), (11, "z", "y" * 99), (12, "z", "y" * 99), (13, "z", "y" * 100), (14, "z", "y" * 100), (15, "q", "long" * 300_000)]
ROWS += [(None, "n", "nobody " * 30), (None, None, "nobody " * 30)]


def frame(spark):
    return spark.createDataFrame([(i, u, h, "s", 1) for i, u, h in ROWS], "page_id long, url string, html string, record_type string, offset int")


def brute(rows):
    want, first = [], {}
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        body = (h or "").encode()
        d = hashlib.sha256(body).hexdigest()
        again = len(body) >= 100 and d in first
        want.append((i, len(body), d, "revisit" if again else "response", first.get(d) if again else None))
        first.setdefault(d, i)
    return sorted(want, key=repr)


@pytest.mark.parametrize("limit, file_bytes", [(500_000, 32 << 20), (1, 300)])
def test_round_trip(spark, monkeypatch, limit, file_bytes):
    monkeypatch.setattr(warc, "MAX_BROADCAST_REVISITS", limit)
    monkeypatch.setattr(warc, "FILE_BYTES", file_bytes)
    got = [tuple(r) for r in warc.archive_round_trip(frame(spark), scratch_path(spark, "w")).collect()]
    assert sorted(got, key=repr) == brute(ROWS)


def test_many_records_of_one_payload(spark):
    rows = [(i, f"http://h/{i}", "the same page again " * 9 if i % 3 else f"a page of its own: {i} " * 9) for i in range(6000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    assert sorted((tuple(r) for r in warc.archive_round_trip(df, scratch_path(spark, "w")).collect()), key=repr) == brute(rows)


def test_payloads_are_never_exchanged(spark, monkeypatch):
    """However many revisits there are, and with Spark's own broadcasts off."""
    monkeypatch.setattr(warc, "MAX_BROADCAST_REVISITS", 1)
    plans = []
    plain = warc._write
    monkeypatch.setattr(warc, "_write", lambda df, path: (plans.append(df._jdf.queryExecution().executedPlan().toString()), plain(df, path)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert warc.archive_round_trip(frame(spark), scratch_path(spark, "w")).count() == len(ROWS)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(plans) > 3 and all("BroadcastHashJoin" in p and "SortMergeJoin" not in p for p in plans[1:])
    for p in plans:
        assert not [x for x in p.split("\n") if "Exchange" in x and "content" in x]


def files(spark, path):
    return [bytes(r.content) for r in spark.read.format("binaryFile").load(path).select("content").collect()]


def test_archives_are_whole_and_payloads_come_back(spark):
    at = scratch_path(spark, "w")
    warc.archive_round_trip(frame(spark), at).count()
    raw = warc.read_archive(spark, f"{at}/raw", payloads=True).collect()
    assert sorted((r.id or "", bytes(r.payload)) for r in raw) == sorted((str(i or ""), (h or "").encode()) for i, _, h in ROWS)
    assert {r.uri for r in raw if r.id == "7"} == {"u X-Evil: 1"}
    assert len({r.record_id for r in raw}) == len(ROWS) and all(r.date.endswith("Z") for r in raw)
    slim = warc.read_archive(spark, f"{at}/deduplicated", payloads=True)
    assert slim.where("record_type = 'revisit'").count() == 5 and slim.where("record_type = 'revisit' and payload is not null").count() == 0
    assert slim.where("refers_to is not null").join(slim.select(F.col("record_id").alias("refers_to")), "refers_to").count() == 5


def test_every_record_is_a_member_that_its_offset_leads_to(spark):
    at = scratch_path(spark, "w")
    warc.archive_pages(frame(spark).coalesce(1), at, "page_id", "url", "html")
    content = next(c for c in files(spark, at) if c)
    seen = list(warc.parse(content))
    assert len(seen) == len(ROWS) and len({o for o, _, _ in seen}) == len(ROWS)
    for offset, headers, block in seen:
        one = zlib.decompressobj(31).decompress(content[offset:])
        assert one.startswith(b"WARC/1.1\r\n") and one.endswith(block + b"\r\n\r\n")
        names = [n for n, _ in headers]
        assert len(names) == len(set(names)) and {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= set(names)
    assert gzip.decompress(content).count(b"WARC-Record-ID: ") == len(ROWS)


def test_an_archive_from_elsewhere_keeps_what_it_says(spark):
    def record(kind, uri, block, *more):
        head = [f"WARC-Type: {kind}", f"WARC-Target-URI: {uri}", f"Content-Length: {len(block)}", *more]
        return ("WARC/1.0\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"

    http = b"HTTP/1.1 404 Gone\r\nX-Cache: hit\r\nSet-Cookie: a=b\r\n\r\n"
    ask = "Content-Type: application/http; msgtype=response"
    body = b"<p>not here</p>" * 20
    whole = record("warcinfo", "", b"software: x\r\n", "Content-Type: application/warc-fields", "WARC-Record-ID: <urn:a>", "WARC-Date: 2001-01-01T00:00:00Z")
    whole += record("response", "http://h/1", http + body, ask, "WARC-Record-ID: <urn:b>", "WARC-Date: 2001-01-01T00:00:01Z", "X-Folded: one\r\n two", "WARC-Payload-Digest: sha1:ABC")
    whole += record("response", "http://h/2", http + body, ask, "WARC-Record-ID: <urn:c>", "WARC-Date: 2001-01-01T00:00:02Z")
    whole += record("request", "http://h/2", b"GET / HTTP/1.1\r\n\r\n", "Content-Type: application/http; msgtype=request")
    whole += record("revisit", "http://h/3", http, ask, "WARC-Record-ID: <urn:d>", "WARC-Date: 2001-01-01T00:00:03Z", "WARC-Payload-Digest: sha1:ABC")
    for packed in (whole, gzip.compress(whole), b"".join(map(gzip.compress, (whole[:50], whole[50:]))) + warc._END):
        at = scratch_path(spark, "w")
        spark.createDataFrame([(bytearray(packed),)], "content binary").select(F.col("content").cast("string")).write.option("encoding", "ISO-8859-1").option("lineSep", "\0").text(f"{at}/0")
        kept = [c[:-1] for c in files(spark, f"{at}/0") if c]
        assert kept == [packed]
        warc._write(spark.createDataFrame([(bytearray(packed),)], "content binary") if packed[:1] == b"\x1f" else spark.createDataFrame([(bytearray(gzip.compress(packed)),)], "content binary"), f"{at}/in")
        headers = warc.read_archive(spark, f"{at}/in").withColumn("rank", F.lit(None).cast("long"))
        assert [r.record_type for r in headers.orderBy("record").collect()] == ["warcinfo", "response", "response", "request", "revisit"]
        warc.deduplicate_archive(spark, f"{at}/in", f"{at}/out", warc.resolve(headers))
        out = [(dict(h), b) for c in files(spark, f"{at}/out") if c for _, h, b in warc.parse(c)]
        assert [h["WARC-Type"] for h, _ in out] == ["warcinfo", "response", "revisit", "request", "revisit"]
        assert out[0][1] == b"software: x\r\n" and out[1][1] == http + body and out[1][0]["X-Folded"] == "one two"
        assert out[2][1] == http and out[2][0]["WARC-Date"] == "2001-01-01T00:00:02Z" and out[2][0]["WARC-Record-ID"] == "<urn:c>"
        for k in (2, 4):
            assert (out[k][0]["WARC-Refers-To"], out[k][0]["WARC-Refers-To-Target-URI"], out[k][0]["WARC-Refers-To-Date"]) == ("<urn:b>", "http://h/1", "2001-01-01T00:00:01Z")
        assert out[3][1] == b"GET / HTTP/1.1\r\n\r\n" and out[3][0]["WARC-Record-ID"].startswith("<urn:uuid:") and out[3][0]["WARC-Date"]


def test_records_that_stay_are_the_same_members(spark):
    at = scratch_path(spark, "w")
    warc.archive_round_trip(frame(spark).coalesce(1), at).count()
    members = lambda p: {h[1][1]: raw for c in files(spark, f"{at}/{p}") if c for raw, h, _ in warc._whole(c)}
    raw, slim = members("raw"), members("deduplicated")
    assert len(raw) == len(slim) == len(ROWS) and sum(raw[k] == slim.get(k) for k in raw) == len(ROWS) - 5


def test_members_and_records_that_do_not_fit():
    one, two = warc.member([("A", "b")], b"x" * 70_000), warc.member([("C", "d")], b"")
    plain = [gzip.decompress(x) for x in (one, two)]
    assert [r for r, _, _ in warc._whole(one + two + warc._END)] == [one, two]
    assert [(r, b) for r, _, b in warc._whole(gzip.compress(plain[0] + plain[1]))] == [(None, b"x" * 70_000), (None, b"")]
    cut = one + gzip.compress(plain[1][:9]) + gzip.compress(plain[1][9:] + plain[0])
    assert [(r, b) for r, _, b in warc._whole(cut)] == [(one, b"x" * 70_000), (None, b""), (None, b"x" * 70_000)]
    assert [r for r, _, _ in warc._whole(plain[1] * 2)] == [None, None]


def test_archive_of_an_archive_keeps_revisits(spark):
    at = scratch_path(spark, "w")
    warc.archive_round_trip(frame(spark), at).count()
    none = spark.createDataFrame([], "file string, record long, to struct<record_id: string, uri: string, date: string>")
    warc.deduplicate_archive(spark, f"{at}/deduplicated", f"{at}/again", none)
    key = lambda p: sorted((r.record_id, r.record_type, r.refers_to or "", r.payload_digest, r.date) for r in warc.read_archive(spark, f"{at}/{p}").collect())
    assert key("again") == key("deduplicated")


def test_records_of_any_kind(spark):
    at = scratch_path(spark, "w")
    rows = [([("WARC-Type", "resource"), ("WARC-Target-URI", None)], bytearray(b"ab")), ([("WARC-Type", "metadata")], None)]
    warc.write_archive(spark.createDataFrame(rows, "headers array<struct<name: string, value: string>>, block binary"), at)
    got = warc.read_archive(spark, at, payloads=True).collect()
    assert sorted((r.record_type, bytes(r.payload), r.uri) for r in got) == [("metadata", b"", None), ("resource", b"ab", None)]


def test_empty_table_and_malformed_archives(spark):
    assert warc.archive_round_trip(frame(spark).limit(0), scratch_path(spark, "w")).count() == 0
    good = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    assert [(o, b) for o, _, b in warc.parse(good * 2)] == [(0, b"ab"), (len(good), b"ab")]
    large = good.replace(b": 2", b": 300000").replace(b"ab", b"xy" * 150_000)
    assert [len(b) for _, _, b in warc.parse(gzip.compress(large + good) + gzip.compress(large))] == [300_000, 2, 300_000]
    for bad in (b"nonsense", good[:-3], good.replace(b": 2", b": 9"), b"WARC/1.1\r\nno colon\r\n\r\n", gzip.compress(good)[:-9], gzip.compress(good) + b"\x1f\x8bxx"):
        with pytest.raises(ValueError):
            list(warc.parse(bad))
