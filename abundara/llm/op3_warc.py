"""WARC archives: writing, reading, and assembly of transactions.

Each page becomes a request, a response (or revisit) and a metadata record, tied by WARC-Concurrent-To; records
are gzip members of their own, so any record can be read from its offset. Reading gives a flat table of
records, and `assemble` joins the records of a capture through their concurrent-to identifiers into one
nested row.

Of pages with equal payloads the one with the greatest page_id is the response and the others revisit it. Groups are found
on SHA-256 digests (pre-aggregated, so one payload on a third of all pages is one row per map task and salt);
payloads move once, by digest and salt, so no task has all pages of a group. The SHA-1 of the archive's
headers decides nothing.

Edge cases: null html is an empty payload. Payloads below `least_bytes` are always responses. Rows that repeat
page_id and payload are captures of their own; the first of the greatest page_id is the response. A null page_id is below
all others: such a page revisits one with an id; a payload that only such pages have is a response in each of them. Line breaks,
blanks and controls in a URL are percent-encoded; a null URL is "about:blank". An empty table writes
no archive and gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 20
RECORD = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, fields map<string,string>, payload_digest string, payload_bytes long, payload binary, file string, offset long"


# --- records ---------------------------------------------------------------------


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def safe_url(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "about:blank"


def record(kind: str, record_id: str, block: bytes, content_type: str, **headers: str | None) -> bytes:
    named = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": DATE, "Content-Type": content_type, "Content-Length": str(len(block))}
    named |= {k.replace("_", "-"): v for k, v in headers.items() if v is not None}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in named.items()) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 6, mtime=0)


def capture(record_id: str, page_id: int | None, url: str | None, payload: bytes, refers_to: str | None) -> list[bytes]:
    """The three records of one page."""
    uri, digest = safe_url(url), "sha1:" + sha1_base32(payload)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    http = "application/http; msgtype="
    if refers_to is None:
        main = record("response", record_id, head + payload, http + "response", WARC_Target_URI=uri, WARC_Payload_Digest=digest)
    else:
        main = record("revisit", record_id, head, http + "response", WARC_Target_URI=uri, WARC_Payload_Digest=digest, WARC_Profile=REVISIT_PROFILE, WARC_Refers_To=f"<{refers_to}>")
    host, _, path = uri.partition("://")[2].partition("/")
    request = record("request", record_id + ":request", f"GET /{path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode(), http + "request", WARC_Target_URI=uri, WARC_Concurrent_To=f"<{record_id}>")
    about = record("metadata", record_id + ":metadata", f"page_id: {'' if page_id is None else page_id}\r\n".encode(), "application/warc-fields", WARC_Target_URI=uri, WARC_Concurrent_To=f"<{record_id}>")
    return [request, main, about]


def members(stream):
    """(offset, bytes) of each gzip member; holds one member and one chunk."""
    held, at = b"", 0
    while True:
        if not held:
            held = stream.read(CHUNK)
            if not held:
                return
        inflate, parts, start = zlib.decompressobj(31), [], at
        while not inflate.eof:
            if not held:
                held = stream.read(CHUNK)
                if not held:
                    raise ValueError("an archive ends within a record")
            parts.append(inflate.decompress(held))
            at += len(held) - len(inflate.unused_data)
            held = inflate.unused_data
        yield start, b"".join(parts)


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record."""
    end = data.index(b"\r\n\r\n")
    first, *lines = data[:end].decode("utf-8").split("\r\n")
    if not first.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return headers, data[end + 4 : end + 4 + int(headers["content-length"])]


def described(data: bytes, with_payload: bool) -> dict:
    """A row of RECORD, without its place. Digests of responses are taken from the payload and held against the header."""
    headers, block = parsed(data)
    inner = lambda name: headers[name].strip("<>") if name in headers else None
    row = {"record_id": inner("warc-record-id"), "type": headers["warc-type"], "concurrent_to": inner("warc-concurrent-to"), "refers_to": inner("warc-refers-to"), "target_uri": headers.get("warc-target-uri"), "fields": None, "payload_digest": None, "payload_bytes": None, "payload": None}
    told = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if row["type"] in ("response", "revisit"):
        head, _, payload = block.partition(b"\r\n\r\n")
        if row["type"] == "response":
            row |= {"payload_digest": sha1_base32(payload), "payload_bytes": len(payload), "payload": payload if with_payload else None}
            if row["payload_digest"] != told:
                raise ValueError(f"{row['record_id']}: its payload differs from its digest")
        else:
            length = re.search(rb"(?im)^content-length:\s*(\d+)", head)
            row |= {"payload_digest": told, "payload_bytes": int(length[1]) if length else None}
    elif headers.get("content-type") == "application/warc-fields":
        row["fields"] = [(k.strip(), v.strip()) for k, c, v in (x.partition(":") for x in block.decode("utf-8").split("\r\n")) if c]
    return row


# --- tables ----------------------------------------------------------------------


def with_originals(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, sha, original (the greatest page of those with this payload; null if there is one page alone, or none with an id)."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"sha": F.sha2("payload", 256), "salt": common.salt_of(F.col("page_id"))})
    groups = rows.filter(F.length("payload") >= least_bytes).groupBy("sha").agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n"), common.salt_bits("salt").alias("salts")).filter("n > 1")
    # dealt by hand, so that adaptive execution doesn't part rows that repeat a page
    dealt = rows.repartition(common.shuffle_partitions(pages.sparkSession), "sha", "salt")
    return dealt.join(common.by_salt(groups.drop("n"), "salts", "salt"), ["sha", "salt"], "left").drop("salt")


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> list[str]:
    """One archive per task; their URIs. Expects columns page_id, url, html."""
    system, where = common.file_system(folder)
    system.create_dir(where, recursive=True)
    rows = with_originals(pages, least_bytes).select("page_id", "url", "payload", "sha", "original").sortWithinPartitions("page_id", "sha")

    def write(batches):
        sink, last, nth, n = None, None, 0, 0
        uri = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        files, path = common.file_system(uri)
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, sha, original = (c[i].as_py() for c in batch.columns)
                if sink is None:
                    sink = files.open_output_stream(path, compression=None)
                    sink.write(record("warcinfo", f"urn:uuid:{uuid.uuid4()}", b"format: WARC File Format 1.1\r\n", "application/warc-fields"))
                nth = nth + 1 if (page_id, sha) == last else 0
                last = page_id, sha
                refers_to = None if original is None or (original == page_id and nth == 0) else f"urn:capture:{original}:{sha}:0"
                for x in capture(f"urn:capture:{page_id}:{sha}:{nth}", page_id, url, payload, refers_to):
                    sink.write(x)
                n += 1
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_pydict({"uri": [uri], "captures": [n]})

    return sorted(r.uri for r in rows.mapInArrow(write, "uri string, captures long").collect())


def read_archives(spark: SparkSession, uris: list[str], with_payload: bool = False) -> DataFrame:
    """Flat table of records: RECORD. Payloads only if asked for."""
    if not uris:
        return spark.createDataFrame([], RECORD)
    listed = spark.createDataFrame([(u,) for u in uris], "file string").repartition(len(uris), "file")
    names = [f.split()[0] for f in RECORD.split(", ")]
    types = [pa.string()] * 5 + [pa.map_(pa.string(), pa.string()), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int64()]

    def read(batches):
        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(names, types)], names=names)

        for batch in batches:
            for uri in batch.column(0).to_pylist():
                files, path = common.file_system(uri)
                rows, size = [], 0
                with files.open_input_stream(path, compression=None) as stream:
                    for offset, data in members(stream):
                        rows.append(described(data, with_payload) | {"file": uri, "offset": offset})
                        size += len(data) if with_payload else 1000
                        if size > 8_000_000:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return listed.mapInArrow(read, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, response (or revisit), request, metadata; parts that are missing are null.

    The records of a capture share one identifier, the response's own or what the others are concurrent to, so the
    three-way join is one grouping by it.
    """
    whole = F.struct(*[F.col(c) for c in records.columns if c != "fields"], F.to_json("fields").alias("fields"))
    part = lambda *kinds: F.min(F.when(F.col("type").isin(*kinds), whole))
    keyed = records.filter(F.col("type") != "warcinfo").withColumn("capture_id", F.coalesce("concurrent_to", "record_id"))
    return keyed.groupBy("capture_id").agg(part("response", "revisit").alias("response"), part("request").alias("request"), part("metadata").alias("metadata"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    uris = write_archives(pages, common.new_folder(spark, "warc"))
    page = lambda c: F.regexp_extract(c, r"^urn:capture:(-?\d+):", 1)
    number = pages.schema["page_id"].dataType
    return assemble(read_archives(spark, uris)).select(
        F.expr("nullif(get_json_object(metadata.fields, '$.page_id'), '')").cast(number).alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.when(F.col("response.refers_to").isNotNull(), page(F.col("response.refers_to")).cast(number)).alias("refers_to"),
    )


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, html, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS original FROM p),
g AS (SELECT *, list_transform(range(0, 4), lambda k: ('0x' || substring(hex, 10 * k + 1, 10))::BIGINT) AS words FROM h)
SELECT page_id, octet_length(encode(html)) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((words[i // 8 + 1] >> (35 - 5 * (i % 8))) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> original THEN original END AS refers_to
FROM g
"""
