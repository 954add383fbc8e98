"""WARC archives with a two-level capture index.

Writing: each task writes gzipped records to files of its own in the shared folder and
returns a line per record: reversed-host URL key, file, offset, length. A file only counts
once its task's lines do, so a lost executor leaves at most an unused file behind.

Index: the lines are range-partitioned by key; each range is a shard file of compressed
blocks of ``BLOCK_LINES`` sorted lines. The first level is the sparse directory (first key, offset and
length of each block), the second the blocks.

Reading: keys go to the shard that covers them; there the shard's directory is
binary-searched, one block is read by range and binary-searched, and the record is read by range.
A revisit record says which capture it repeats; its payload is that capture's.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwatch.llm.common import stage, table, text_of
from slotwatch.operators.sizing import join_small
from slotwatch.session import fresh_path

MIN_REVISIT = 1000  # bytes: smaller payloads are always stored
FILE_BYTES = 64 << 20
BLOCK_LINES = 256
DATE = "1970-01-01T00:00:00Z"  # pages carry no capture time
LEVEL = 6
OPEN_FILES = 16


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store and the path inside it for a Spark folder name."""
    uri = uri.replace("s3a://", "s3://", 1)
    return pafs.FileSystem.from_uri(uri)


def url_key(url: Column) -> Column:
    """``https://www.Example.com:80/a?b`` as ``com,example,www)/a?b``; null is the empty URL."""
    rest = F.regexp_replace(text_of(url), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(rest, r"^[^/?#]*", 0), r"^[^@]*@|:[0-9]*$", ""))
    path = F.regexp_replace(rest, r"^[^/?#]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path)


def capture_key(url: Column, page_id: Column) -> Column:
    """URL key and page: white space and control characters in a URL are escaped, so a key is one word."""
    safe = F.regexp_replace(F.regexp_replace(url_key(url), "%", "%25"), r"[\x00-\x20\x7F]", "%20")
    return F.concat(safe, F.lit(" "), F.coalesce(F.lpad(page_id.cast("string"), 20, "0"), F.lit("-")))


def _header_safe(value: str) -> str:
    return "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzipped WARC record; a revisit has the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    body = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_header_safe(url)}",
        "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", LEVEL, mtime=0)


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields in lower case, and the payload."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    body = rest[: int(fields["content-length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


LINES = "key string, page_id bigint, file string, offset bigint, length bigint"


def _write_records(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(folder)
        fs.create_dir(path, recursive=True)
        out = name = None
        lines: list[tuple] = []

        def closed() -> pa.RecordBatch:
            out.close()
            cols = list(zip(*lines)) or [()] * 5
            types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], names=["key", "page_id", "file", "offset", "length"])

        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("key", "page_id", "url", "html", "digest", "refers_to"))):
                key, page_id, url, page, digest, refers_to = (x.as_py() for x in row)
                if out is None:
                    name, lines = f"{uuid.uuid4().hex}.warc.gz", []
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                member = record(page_id, url or "", (page or "").encode(), digest, refers_to)
                lines.append((key, page_id, name, out.tell(), len(member)))
                out.write(member)
                if out.tell() >= FILE_BYTES:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return run


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record for every row of ``pages`` (page_id, url, html); returns the index lines.

    Of rows with equal payloads of ``MIN_REVISIT`` bytes or more, that with the largest page_id is
    stored and the others refer to it; if no page_id of them is set, all are stored.
    """
    page = pages.select("page_id", "url", text_of("html").alias("html"))
    page = page.withColumns(
        {"digest": F.sha1(F.encode("html", "utf-8")), "size": F.octet_length("html"), "key": capture_key(F.col("url"), F.col("page_id"))}
    )
    copies = (
        page.where(F.col("size") >= MIN_REVISIT)
        .groupBy("digest", "size")
        .agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("digest", "size", "kept")
    )
    joined = join_small(page, stage(copies, "warc-copies"), ["digest", "size"], "left")
    refers = F.when(~F.col("kept").eqNullSafe(F.col("page_id")), F.col("kept"))
    rows = joined.select("key", "page_id", "url", "html", "digest", refers.alias("refers_to"))
    return stage(rows.mapInArrow(_write_records(folder), LINES), "warc-lines")


def _write_shard(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(folder)
        fs.create_dir(path, recursive=True)
        out, name, block, first, rows = None, "", [], "", []

        def flush() -> None:
            member = gzip.compress("\n".join(block).encode(), LEVEL, mtime=0)
            rows.append((name, first, out.tell(), len(member)))
            out.write(member)

        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("key", "file", "offset", "length"))):
                key, file, offset, length = (x.as_py() for x in row)
                if out is None:
                    name = f"{uuid.uuid4().hex}.cdx.gz"
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                # Equal keys stay in one block.
                if len(block) >= BLOCK_LINES and not block[-1].startswith(key + " "):
                    flush()
                    block = []
                if not block:
                    first = key
                block.append(f"{key} {file} {offset} {length}")
        if out is not None:
            flush()
            out.close()
            cols = list(zip(*rows))
            types = [pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], names=["shard", "first_key", "offset", "length"])

    return run


def write_index(lines: DataFrame, folder: str) -> DataFrame:
    """Sorted shards of compressed blocks; returns the directory ``[shard, first_key, offset, length]``.

    A very common host is many keys, so it spreads over as many ranges as its size asks for.
    """
    ranged = lines.select("key", "file", "offset", "length").repartitionByRange("key").sortWithinPartitions("key")
    return stage(ranged.mapInArrow(_write_shard(folder), "shard string, first_key string, offset bigint, length bigint"), "warc-directory")


class _Files:
    """Range reads through a few files kept open."""

    def __init__(self, folder: str):
        self.fs, self.path = file_system(folder)
        self.open: OrderedDict[str, pa.NativeFile] = OrderedDict()

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name not in self.open:
            if len(self.open) >= OPEN_FILES:
                self.open.popitem(last=False)[1].close()
            self.open[name] = self.fs.open_input_file(f"{self.path}/{name}")
        self.open.move_to_end(name)
        return self.open[name].read_at(length, offset)

    def close(self) -> None:
        for f in self.open.values():
            f.close()


RECORDS = "key string, page_id bigint, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, stated_digest string"


def _read_shard(archives: str, index: str):
    def run(key, wanted, directory):  # no type hints: Spark would read them
        shards, files = _Files(index), _Files(archives)
        order = sorted(zip(directory.column("first_key").to_pylist(), directory.column("shard").to_pylist(), directory.column("offset").to_pylist(), directory.column("length").to_pylist()))
        firsts = [d[0] for d in order]
        at, lines, keys, rows = -1, [], [], []
        for k, n in sorted(zip(wanted.column("key").to_pylist(), wanted.column("n").to_pylist())):
            i = bisect.bisect_right(firsts, k) - 1
            if i < 0:
                continue
            if i != at:
                _, shard, offset, length = order[i]
                lines = gzip.decompress(shards.read(shard, offset, length)).decode().split("\n")
                keys, at = [line.rsplit(" ", 3)[0] for line in lines], i
            j = bisect.bisect_left(keys, k)
            while j < len(keys) and keys[j] == k:
                _, file, offset, length = lines[j].rsplit(" ", 3)
                fields, payload = parse_record(files.read(file, int(offset), int(length)))
                page = fields["warc-record-id"][len("<urn:page:") : -1]
                refers = fields.get("warc-refers-to", "")[len("<urn:page:") : -1]
                stored = fields["warc-type"] == "response"
                rows.append(
                    (
                        k,
                        int(page) if page else None,
                        fields["warc-type"],
                        int(refers) if refers else None,
                        len(payload) if stored else None,
                        hashlib.sha1(payload).hexdigest() if stored else None,
                        base64.b32decode(fields["warc-payload-digest"][5:]).hex(),
                    )
                )
                j += 1
        shards.close()
        files.close()
        names = [f.split()[0] for f in RECORDS.split(", ")]
        types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        cols = list(zip(*rows)) or [()] * len(names)
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, cols, types)})

    return run


def read_captures(keys: DataFrame, directory: DataFrame, archives: str, index: str) -> DataFrame:
    """Records of the captures named by ``keys`` (key), found through the index alone.

    Keys that the index does not have give no row; repeated keys are looked up once.
    The driver holds one first key per shard, at most one for each range partition.
    """
    shards = directory.groupBy("shard").agg(F.min("first_key").alias("first_key")).collect()
    firsts = sorted((r["first_key"], r["shard"]) for r in shards)
    starts, names = [f for f, _ in firsts], [n for _, n in firsts]

    @F.pandas_udf(T.StringType())
    def shard_of(key):
        return key.map(lambda k: names[bisect.bisect_right(starts, k) - 1] if starts and k >= starts[0] else None)

    wanted = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).withColumn("shard", shard_of("key"))
    return (
        wanted.where("shard is not null")
        .groupBy("shard")
        .cogroup(directory.groupBy("shard"))
        .applyInArrow(_read_shard(archives, index), RECORDS)
    )


def with_payloads(records: DataFrame) -> DataFrame:
    """Size and digest of the full payload, a revisit's from the capture that it refers to."""
    stored = records.where("record_type = 'response'").select(
        F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("stated_digest"), F.col("payload_bytes").alias("_bytes")
    ).distinct()
    direct = records.where("record_type = 'response'")
    # Many revisits may name one capture: they are on the side that a skewed join splits.
    again = records.where("record_type = 'revisit'").join(stored, ["refers_to", "stated_digest"])
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return direct.select(*columns).unionByName(
        again.select(
            "page_id", F.col("_bytes").alias("payload_bytes"), F.col("stated_digest").alias("payload_digest"), "record_type", "refers_to"
        )
    )


def op4_warc_index(spark, sf_dir: str) -> DataFrame:
    """Null html is an empty payload; null urls and page_ids are kept as such; repeated rows are records of their own."""
    pages = table(spark, sf_dir, "pages")
    archives, index = fresh_path(spark, "warc-archives"), fresh_path(spark, "warc-index")
    directory = write_index(write_archives(pages, archives), index)
    keys = pages.select(capture_key(F.col("url"), F.col("page_id")).alias("key"))
    return with_payloads(stage(read_captures(keys, directory, archives, index), "warc-records"))


OP4_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS payload_digest,
         max(page_id) OVER (PARTITION BY b) AS kept FROM p
), r AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM kept THEN kept END AS refers_to FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
FROM r
"""
