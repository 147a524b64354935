import gzip
from datetime import UTC, datetime, timedelta

from tests.compare import duck_rows, spark_rows

from wirelattice.llm import warc

T = datetime(2024, 1, 1, tzinfo=UTC)


def rec(kind, name, url, seconds, headers, body=b"", digest="d"):
    return warc.record(kind, name, url, T + timedelta(seconds=seconds), "200 OK" if kind == "response" else "304 Not Modified", headers, body, digest)


def resolved(spark, records):
    df = spark.createDataFrame([(bytearray(r),) for r in records], "record binary")
    return {r["record_id"]: r for r in warc.resolve(warc.read_records(df, "record")).collect()}


def test_query_against_its_sql(spark, sf_dir):
    assert spark_rows(warc.op10_warc(spark, sf_dir)) == duck_rows(warc.OP10_SQL, sf_dir)


def test_as_of_and_validators(spark):
    u, day = "http://WWW.a.org:80/x/?b=2&a=1&utm_source=z#f", 86_400
    got = resolved(spark, [
        rec("response", "r1", u, 0, [("ETag", '"1"'), ("Server", "s"), ("Cache-Control", "old")], b"one"),
        rec("response", "r2", "https://a.org/x?a=1&b=2", 10, [("ETag", '"2"'), ("Content-Type", "t")], b"two!"),
        rec("revisit", "v0", u, 0, [("ETag", '"1"')]),
        rec("revisit", "v1", u, 5, [("ETag", 'W/"1"'), ("Cache-Control", "new"), ("Server", "other"), ("Content-Length", "0")]),
        rec("revisit", "v2", u, 10, [("ETag", '"1"')]),
        rec("revisit", "v3", u, 11, [("ETag", '"2"')]),
        rec("revisit", "v4", u, 40 * day, [("ETag", '"2"')]),
        rec("revisit", "v5", u, 41 * day, [("ETag", '"9"')]),
        rec("revisit", "v6", "http://b.org/", 41 * day, [("ETag", '"9"')]),
        rec("revisit", "v7", u, 42 * day, [], digest="d"),
    ])
    status = {k: (v["status"], v["refers_to"]) for k, v in got.items()}
    assert status == {
        "r1": ("full", None), "r2": ("full", None), "v0": ("no_earlier_response", None), "v1": ("resolved", "r1"), "v2": ("resolved", "r1"), "v3": ("resolved", "r2"), "v4": ("resolved", "r2"),
        "v5": ("validator_mismatch", None), "v6": ("no_earlier_response", None), "v7": ("resolved", "r2"),
    }
    assert got["v1"]["headers"] == 'cache-control: new\netag: W/"1"\nserver: s' and got["v1"]["body_bytes"] == 3
    assert {v["canonical_url"] for k, v in got.items() if k != "v6"} == {"a.org/x?a=1&b=2"}


def test_files_and_malformed_bytes(spark, tmp_path):
    one, two = rec("response", "a", "http://a.org/", 0, [], b"x\r\n\r\ny"), rec("response", "b", None, 1, [], b"")
    (tmp_path / "f.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two))
    (tmp_path / "g.warc").write_bytes(one + two + b"junk")
    rows = warc.read_warc(spark, str(tmp_path)).collect()
    assert sorted(str(r["record_id"]) for r in rows) == ["None", "a", "a", "b", "b"]
    assert {bytes(r["body"]) for r in rows if r["record_id"] == "a"} == {b"x\r\n\r\ny"}


def test_edge_cases(spark):
    pages = spark.createDataFrame([(1, None, None, "c"), (2, "", "", "c"), (None, "http://x.org", "h", "c"), (3, "http://x.org/", "z" * 300_000, "c"), (3, "http://x.org/", "z" * 300_000, "c")], "page_id long, url string, html string, record string")
    got = warc.resolve(warc.read_records(warc.recrawl(pages), "record"))
    assert got.count() == 10 and got.where("record_id = 'urn:capture:1:2'").first()["status"] == "no_earlier_response"
    assert warc.resolve(warc.read_records(warc.recrawl(pages.limit(0)), "record")).count() == 0


def _one(i, kind="response", at=0, url="http://a.b/c", digest="d"):
    date = datetime(2024, 1, 1, tzinfo=UTC) + timedelta(seconds=at)
    return warc.record(kind, f"urn:{i}", url, date, "200 OK" if kind == "response" else "304 Not Modified", [("ETag", '"e"')], b"body", digest)


def test_reading_goes_on_after_a_bad_record_and_a_truncated_file():
    good = [_one(i) for i in range(4)]
    got = [r and r[0] for r in warc.parse(good[0] + b"WARC/1.1\r\nWARC-Type: response\r\n\r\nlost\r\n\r\n" + good[1] + good[2])]
    assert got == ["urn:0", None, "urn:1", "urn:2"]
    members = gzip.compress(good[0]) + gzip.compress(good[1])
    assert [r and r[0] for r in warc.parse(members)] == ["urn:0", "urn:1"]
    cut = [r and r[0] for r in warc.parse(members[:-9])]
    assert cut[0] is None and "urn:0" in cut
    assert next(warc.parse(good[0].replace(b"00:00:00Z", b"00:00:00.123456Z")))[3] == datetime(2024, 1, 1, tzinfo=UTC)


def test_hot_urls_nulls_and_profiles(spark):
    data = [_one(i, at=i % 7) for i in range(40)] + [_one(100, "revisit", 3), _one(101, "revisit", 90_000), _one(102, url=None), _one(103, "revisit", 0)]
    data.append(_one(104, "revisit", 50, digest="other").replace(b"server-not-modified", b"identical-payload-digest"))
    data.append(_one(105, "revisit", 50).replace(b"server-not-modified", b"identical-payload-digest"))
    rows = spark.createDataFrame([(bytearray(d),) for d in data], "record binary")
    got = {r["record_id"]: r for r in warc.resolve(warc.read_records(rows, "record")).collect()}
    assert len(got) == len(data)
    assert got["urn:100"]["refers_to"] == "urn:9" and got["urn:101"]["refers_to"] == "urn:6"
    assert got["urn:103"]["status"] == "no_earlier_response" and got["urn:102"]["status"] == "full"
    assert got["urn:104"]["status"] == "validator_mismatch" and got["urn:105"]["status"] == "resolved"
