"""WARC records and not-modified revisits.

Records are written and parsed in WARC/1.1 form. A ``revisit`` record of the server-not-modified profile has no payload: it takes the one of
the latest earlier full response of the same canonical URL. That is an as-of join in two levels, so that a URL with any share of the rows
never meets in one task: responses are reduced to the latest of each (URL, second), with map-side combine; a window over the seconds of a (URL, day),
86,400 rows at most, finds an earlier one of the same day; one summary row per (URL, day) carries the last response over to later days. A revisit resolves only if its validators fit the response: equal ETags (weak ones by their value), else equal
Last-Modified, else equal payload digests. The headers of the 304 that a cache may update are merged into the stored ones.

A revisit of the identical-payload-digest profile is no 304: it resolves by equal digests alone and keeps its own headers.

Edge cases: null URLs and dates never resolve and take no part in the join; fractions of a second are cut; null bodies count as empty; a response at the very second of a revisit is not earlier; among responses of one second the
larger record id is the latest; repeated rows resolve alike; a malformed stretch gives a row with null type and reading goes on at the
next record; so does a truncated gzip file after what could be opened; empty tables give empty results;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wirelattice.sources.staging import deploy, materialise

#: Query parameters that do not name a resource; headers of a 304 that replace stored ones (fixed values).
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "gclid", "fbclid")
PERMITTED = ("age", "cache-control", "date", "etag", "expires", "last-modified", "vary")
#: Width of the as-of join's inner level, in seconds.
DAY = 86_400

PARSED = "record_id string, warc_type string, url string, date timestamp, profile string, payload_digest string, headers map<string,string>, body binary"


def canonical_url(url: Column) -> Column:
    """Host (lower case, without www and default ports), path without trailing slashes, remaining parameters in order."""
    bare = F.regexp_replace(F.trim(url), r"#[\s\S]*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1)), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), r"/+$", "")
    kept = F.filter(F.split(F.regexp_extract(bare, r"\?([\s\S]*)$", 1), "&"), lambda p: (p != "") & ~F.split(p, "=")[0].isin(*TRACKING))
    query = F.array_join(F.sort_array(kept), "&")
    return F.concat(F.regexp_replace(host, r"^www\.", ""), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def record(kind: str, identity: str, url: str | None, date: datetime, status: str, headers: list[tuple[str, str]], body: bytes, digest: str) -> bytes:
    """The bytes of a response or revisit record."""
    http = f"HTTP/1.1 {status}\r\n".encode() + b"".join(f"{k}: {v}\r\n".encode() for k, v in headers) + b"\r\n" + body
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{identity}>"), ("WARC-Target-URI", url or ""), ("WARC-Date", date.strftime("%Y-%m-%dT%H:%M:%SZ")), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if kind == "revisit":
        fields.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/server-not-modified"))
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(http)))]
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + b"\r\n" + http + b"\r\n\r\n"


def _fields(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


_FRACTION = re.compile(r"\.[0-9]+Z$")


def opened(data: bytes) -> tuple[bytes, bool]:
    """What the gzip members hold, as far as they can be opened, and whether that was all."""
    out = []
    while data:
        one = zlib.decompressobj(31)
        try:
            out.append(one.decompress(data))
        except zlib.error:
            return b"".join(out), False
        if not one.eof:
            return b"".join(out), False
        data = one.unused_data
    return b"".join(out), True


def parse(data: bytes) -> Iterator[tuple | None]:
    """The records in some bytes (gzip members are opened), each as the columns of PARSED; None for what is no record."""
    if data[:2] == b"\x1f\x8b":
        data, whole = opened(data)
        if not whole:
            yield None
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        head = _fields(data[at:end].split(b"\r\n")[1:]) if data.startswith(b"WARC/", at) and end >= 0 else {}
        size = head.get("content-length", "")
        if not (size.isascii() and size.isdigit()) or end + 4 + int(size) > len(data):
            yield None
            again = data.find(b"\nWARC/", at + 1)
            if again < 0:
                return
            at = again + 1
            continue
        size = int(size)
        block = data[end + 4 : end + 4 + size]
        top, _, body = block.partition(b"\r\n\r\n")
        try:
            date = datetime.strptime(_FRACTION.sub("Z", head.get("warc-date", "")), "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=UTC)
        except ValueError:
            date = None
        yield head.get("warc-record-id", "").strip("<>"), head.get("warc-type"), head.get("warc-target-uri") or None, date, head.get("warc-profile"), head.get("warc-payload-digest"), _fields(top.split(b"\r\n")[1:]), body
        at = end + 4 + size
        while data.startswith(b"\r\n", at):
            at += 2


def read_records(df: DataFrame, column: str) -> DataFrame:
    """One row per record in a binary column (a record, or a whole file as Spark's binaryFile source gives it)."""
    deploy(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.string(), pa.timestamp("us", "UTC"), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
        names = ["record_id", "warc_type", "url", "date", "profile", "payload_digest", "headers", "body"]
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                rows = [r or (None,) * 8 for data in batch.column(0)[low : low + 500].to_pylist() if data is not None for r in parse(data)]
                columns = list(zip(*rows, strict=True)) or [()] * 8
                columns[6] = [None if h is None else list(h.items()) for h in columns[6]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return df.select(column).mapInArrow(run, PARSED)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files, gzipped or not."""
    return read_records(spark.read.format("binaryFile").load(path).select("content"), "content")


def resolve(records: DataFrame) -> DataFrame:
    """Per record: its columns without the body, canonical_url, status, refers_to, body_sha256, body_bytes, merged headers.

    Works on narrow rows: a payload is carried as its digest and size, and can be fetched by ``refers_to``.
    """
    narrow = records.where("warc_type in ('response', 'revisit')").select(
        "record_id", "warc_type", F.date_trunc("second", "date").alias("date"), "headers", "payload_digest", "profile", canonical_url(F.col("url")).alias("canonical_url"),
        F.sha2(F.coalesce("body", F.lit(b"")), 256).alias("sha"), F.length(F.coalesce("body", F.lit(b""))).cast("long").alias("bytes"),
    )
    full = F.col("warc_type") == "response"
    narrow = materialise(narrow.withColumn("day", F.floor(F.unix_seconds("date") / DAY)), "warc-records")
    placed = F.col("date").isNotNull() & F.col("canonical_url").isNotNull()
    kept = F.struct("record_id", "headers", "payload_digest", "sha", "bytes")
    seconds = narrow.where(full & placed).groupBy("canonical_url", "day", "date").agg(F.max_by(kept, "record_id").alias("last"))
    # a revisit's second sees earlier ones only
    asked = narrow.where(~full & placed).select("canonical_url", "day", "date").distinct()
    points = seconds.join(asked.withColumn("asked", F.lit(True)), ["canonical_url", "day", "date"], "full")
    inside = Window.partitionBy("canonical_url", "day").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    same_day = points.withColumn("same_day", F.last("last", ignorenulls=True).over(inside)).where("asked").drop("last", "asked")
    last = seconds.groupBy("canonical_url", "day").agg(F.max_by("last", "date").alias("last"))
    days = asked.select("canonical_url", "day").distinct().join(last, ["canonical_url", "day"], "full")
    before = Window.partitionBy("canonical_url").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("canonical_url", "day", F.last("last", ignorenulls=True).over(before).alias("older")).where("older is not null")
    answer = same_day.join(days, ["canonical_url", "day"], "left")
    answer = answer.select("canonical_url", "date", F.coalesce("same_day", "older").alias("of")).where("of is not null")
    none = narrow.where(full | ~placed).withColumn("of", F.lit(None).cast(answer.schema["of"].dataType))
    of = narrow.where(~full & placed).join(answer, ["canonical_url", "date"], "left").unionByName(none)
    tag = lambda h: F.regexp_replace(h["etag"], "^W/", "")
    mine, theirs = F.col("headers"), F.col("of.headers")
    fits = F.when(mine["etag"].isNotNull() & theirs["etag"].isNotNull(), tag(mine) == tag(theirs)).when(mine["last-modified"].isNotNull() & theirs["last-modified"].isNotNull(), mine["last-modified"] == theirs["last-modified"])
    same = F.col("payload_digest") == F.col("of.payload_digest")
    copy = F.coalesce(F.col("profile").contains("identical-payload-digest"), F.lit(False))
    fits = F.coalesce(F.when(copy, same).otherwise(F.coalesce(fits, same)), F.lit(False))
    status = F.when(full, "full").when(F.col("of").isNull(), "no_earlier_response").when(fits, "resolved").otherwise("validator_mismatch")
    done = of.withColumn("status", status).withColumn("good", F.col("status") == "resolved")
    new = F.map_filter(mine, lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(theirs, lambda k, v: ~F.array_contains(F.map_keys(new), k)), new)
    headers = F.when(F.col("good") & ~copy, merged).otherwise(mine)
    text = F.array_join(F.transform(F.sort_array(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    whole = F.col("good") | full
    return done.select(
        "record_id", "warc_type", "canonical_url", "status", F.when(F.col("good"), F.col("of.record_id")).alias("refers_to"),
        F.when(full, F.col("sha")).when(F.col("good"), F.col("of.sha")).alias("body_sha256"), F.when(whole, F.when(full, F.col("bytes")).otherwise(F.col("of.bytes"))).alias("body_bytes"), text.alias("headers"),
    )


def recrawl(pages: DataFrame) -> DataFrame:
    """An archive of the pages as WARC records (column ``record``), two captures each.

    The first stores the page, page_id seconds into 2024. Thirty days later a recrawl under a variant of the URL is answered 304; each tenth server
    (page_id mod 10 = 3) sends another ETag by then, and pages with page_id mod 10 = 7 are sent without one, with the time of last change only.
    """
    deploy(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = datetime(2024, 1, 1, tzinfo=UTC)
        for batch in batches:
            for low in range(0, batch.num_rows, 250):
                out = []
                for page, url, html in zip(*(batch.column(i)[low : low + 250].to_pylist() for i in range(3)), strict=True):
                    body, page = (html or "").encode("utf-8", "surrogatepass"), 0 if page is None else page
                    digest = hashlib.sha256(body).hexdigest()
                    changed = ("Last-Modified", f"day {page % 365}")
                    valid = [changed] if page % 10 == 7 else [("ETag", f'"{digest[:16]}"'), changed]
                    again = valid if page % 10 != 3 else [("ETag", f'W/"new-{digest[:12]}"'), changed]
                    first = [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(body))), ("Cache-Control", "max-age=60"), *valid]
                    out.append(record("response", f"urn:capture:{page}:1", url, start + timedelta(seconds=page), "200 OK", first, body, digest))
                    variant = None if url is None else url.partition("#")[0] + ("&" if "?" in url.partition("#")[0] else "?") + "utm_campaign=again"
                    later = [("Cache-Control", "max-age=120"), ("Content-Length", "0"), ("Server", "edge"), *again]
                    out.append(record("revisit", f"urn:capture:{page}:2", variant, start + timedelta(days=30, seconds=page), "304 Not Modified", later, b"", digest))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "record binary")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, archived, recrawled, parsed again and resolved."""
    return resolve(read_records(recrawl(spark.read.parquet(f"{sf_dir}/pages.parquet")), "record"))


_LIST = ", ".join(f"'{t}'" for t in TRACKING)
OP10_SQL = f"""
with p as (
  select page_id, url, coalesce(html, '') as html, sha256(coalesce(html, '')) as sha, strlen(coalesce(html, '')) as n,
         regexp_replace(trim(url), '#[\\s\\S]*$', '') as bare from pages),
c as (
  select *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)), ':(80|443)$', ''), '^www\\.', '')
         || regexp_replace(regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '/+$', '') as stem,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '\\?([\\s\\S]*)$', 1), '&'), lambda x: x <> '' and string_split(x, '=')[1] not in ({_LIST}))), '&') as q
  from p),
r as (
  select page_id, sha, n, stem || case when q <> '' then '?' || q else '' end as canonical_url,
         case when page_id % 10 = 7 then null else '"' || sha[1:16] || '"' end as etag,
         case when page_id % 10 = 7 then null when page_id % 10 = 3 then '"new-' || sha[1:12] || '"' else '"' || sha[1:16] || '"' end as again,
         'day ' || (page_id % 365) as changed from c),
best as (
  select b.*, a.page_id as of_id, a.sha as of_sha, a.n as of_n, a.etag as of_etag, a.changed as of_changed
  from r b left join r a on a.canonical_url = b.canonical_url and a.page_id < b.page_id + 2592000
  qualify row_number() over (partition by b.page_id order by a.page_id desc) = 1),
s as (
  select *, case when of_id is null then 'no_earlier_response'
                 when again is not null and of_etag is not null then case when again = of_etag then 'resolved' else 'validator_mismatch' end
                 when changed = of_changed then 'resolved' else 'validator_mismatch' end as status from best)
select 'urn:capture:' || page_id || ':1' as record_id, 'response' as warc_type, canonical_url, 'full' as status, null as refers_to, sha as body_sha256, n as body_bytes,
       'cache-control: max-age=60' || chr(10) || 'content-length: ' || n || chr(10) || 'content-type: text/html; charset=utf-8'
       || case when etag is null then '' else chr(10) || 'etag: ' || etag end || chr(10) || 'last-modified: ' || changed as headers
from r
union all
select 'urn:capture:' || page_id || ':2', 'revisit', canonical_url, status, case when status = 'resolved' then 'urn:capture:' || of_id || ':1' end,
       case when status = 'resolved' then of_sha end, case when status = 'resolved' then of_n end,
       case when status = 'resolved'
            then 'cache-control: max-age=120' || chr(10) || 'content-length: ' || of_n || chr(10) || 'content-type: text/html; charset=utf-8'
                 || case when coalesce(again, of_etag) is null then '' else chr(10) || 'etag: ' || coalesce(again, of_etag) end || chr(10) || 'last-modified: ' || changed
            else 'cache-control: max-age=120' || chr(10) || 'content-length: 0' || case when again is null then '' when page_id % 10 = 3 then chr(10) || 'etag: W/' || again else chr(10) || 'etag: ' || again end
                 || chr(10) || 'last-modified: ' || changed || chr(10) || 'server: edge' end
from s
"""
