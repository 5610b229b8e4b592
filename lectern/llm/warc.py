"""WARC archives of pages, and capture histories merged from their indexes."""

from __future__ import annotations

import base64
import hashlib
import re
import tempfile
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, arrow_batches

DATE = "2000-01-01T00:00:00Z"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
RECORD_END = b"\r\n\r\n"
#: Bytes of a gzip member before compression: below 16 MB the last byte of its length, and so of the member, is zero.
MEMBER_BYTES = (1 << 24) - 1
#: The text sink ends each value with its line separator: here the zero that ends a member.
MEMBER_END = "\0"
#: Payloads beyond this go to files of their own, of about LARGE_FILE bytes or one record.
LARGE, LARGE_FILE = 1 << 18, 1 << 28
RECORDS_PER_FILE = 1000
HEX32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Rows of the repeated-payload table that are broadcast: 48 bytes each, so 10 MB at most.
BROADCAST_ROWS = 200_000

INDEX = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, ts string, run string, offset long"


def digest(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: 40 bits of the hex form are 8 base-32 digits."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), HEX32, BASE32)


def members(record: bytes) -> bytes:
    """A record as gzip: one member, or several where it is longer than MEMBER_BYTES. The last byte is zero."""
    out = []
    for k in range(0, len(record), MEMBER_BYTES):
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        out += [packer.compress(record[k : k + MEMBER_BYTES]), packer.flush()]
    return b"".join(out)


def write_warc(pages: DataFrame, path: str, scratch: Scratch, min_bytes: int = 0, records_per_file: int = RECORDS_PER_FILE, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Writes a record for each row of `pages` to WARC files below `path`, each compressed for itself.

    Of payloads of at least `min_bytes` that are equal (length and SHA-1), the row with the smallest
    page_id is a response and the others are revisits of it, without payload. Payloads are not shuffled
    unless the table of repeated payloads is too large to broadcast; then the join is split by Spark.
    Files are written by Spark's text sink, which commits them in any store: a record is a string of the
    bytes of its gzip member but for the last, a zero, which is the sink's line separator. Its offset in the
    file is so a place from which it can be read alone. A file holds `records_per_file` payloads of up to
    256 KB; longer ones are written beside them, so that a file stays far below 2 GB.
    """
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), body.alias("body"))
    rows = rows.withColumn("bytes", F.octet_length("body").cast("long")).withColumn("digest", digest(F.col("body")))
    groups = rows.groupBy("digest", "bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    groups = scratch.write(groups, "payloads")
    longest = groups.agg(F.max("bytes")).first()[0] or 0
    repeated = groups.where((F.col("n") > 1) & (F.col("bytes") >= min_bytes)).drop("n")
    if repeated.count() <= BROADCAST_ROWS:
        repeated = F.broadcast(repeated)
    known = rows.join(repeated, ["digest", "bytes"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    known = known.withColumn("revisit", revisit)
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    target = F.regexp_replace("url", r"[\r\n]", " ")
    named = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    length = F.when(F.col("revisit"), F.lit(len(HTTP_HEAD))).otherwise(F.col("bytes") + len(HTTP_HEAD))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), named, F.lit(">"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", target),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(
            F.col("revisit"),
            F.concat(
                line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">"))),
            ),
        ).otherwise(F.lit("")),
        line("X-Payload-Length", F.col("bytes").cast("string")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", length.cast("string")),
        F.lit("\r\n" + HTTP_HEAD),
    )
    record = F.concat(head.cast("binary"), F.when(F.col("revisit"), F.lit(b"")).otherwise(F.col("body")), F.lit(RECORD_END))

    def compress(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([members(x.as_buffer().to_pybytes())[:-1] for x in b.column(0)], pa.binary())], names=["value"])

    def write(rows, folder, per_file, batch):
        with arrow_batches(scratch.spark, batch):
            packed = rows.select(record.alias("record")).mapInArrow(compress, "value binary").select(F.col("value").cast("string"))
            packed.write.mode("overwrite").option("lineSep", MEMBER_END).option("maxRecordsPerFile", per_file).text(f"{path}/{folder}")

    write(known.where(F.col("bytes") <= LARGE), "small", records_per_file, 16)
    if longest > LARGE:
        write(known.where(F.col("bytes") > LARGE), "large", max(1, LARGE_FILE // longest), 1)


def url_key(url: str) -> str:
    """Sort key of a URL: host labels reversed, then path and query, lower-cased, without fragment."""
    m = re.match(r"(?s)[^:/?#]*://([^/?#]*)([^#]*)", url)
    if not m:
        return url.lower()
    host = m[1].lower().rsplit("@", 1)[-1].removesuffix(":80").removesuffix(":443")
    return ",".join(reversed(host.split("."))) + ")" + (m[2].lower() or "/")


def records(data: bytes):
    """(offset, headers, block) of each record in a WARC file; offsets are those of the record's gzip member."""
    data, at, held, begun = memoryview(data), 0, b"", 0
    while at < len(data):
        if not held:
            begun = at
        inflate, parts = zlib.decompressobj(31), [held]
        while not inflate.eof:
            if at >= len(data):
                raise ValueError("a WARC file ends inside a record")
            chunk = data[at : at + (1 << 16)]
            parts.append(inflate.decompress(chunk))
            at += len(chunk) - len(inflate.unused_data)
        held = b"".join(parts)
        end = held.find(b"\r\n\r\n")
        if not held.startswith(b"WARC/") or end < 0:
            raise ValueError("not a WARC record")
        lines = held[:end].decode("utf-8", "surrogateescape").split("\r\n")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        size = end + 4 + int(headers["Content-Length"]) + len(RECORD_END)
        if len(held) > size:
            raise ValueError("a gzip member goes on beyond its record")
        if len(held) == size:
            yield begun, headers, held[end + 4 : size - len(RECORD_END)]
            held = b""
    if held:
        raise ValueError("a WARC file ends inside a record")


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """Reads the archives below `path` back: one sorted run of captures (INDEX) for each file.

    A response's payload is hashed and measured again; a difference to its headers is an error.
    """
    names = [x.split()[0] for x in INDEX.split(", ")]
    of = lambda text: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", text)) else None

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = []
                for offset, h, block in records(content.as_py()):
                    payload, n = block.split(b"\r\n\r\n", 1)[1], int(h["X-Payload-Length"])
                    mark = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if h["WARC-Type"] == "response" and (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()) != (n, mark):
                        raise ValueError(f"payload of {h['WARC-Record-ID']} differs from its digest")
                    target = h["WARC-Target-URI"].encode("utf-8", "surrogateescape").decode("utf-8", "replace")
                    rows.append((of(h["WARC-Record-ID"]), n, mark, h["WARC-Type"], of(h.get("WARC-Refers-To", "")), url_key(target), h["WARC-Date"], name, offset))
                rows.sort(key=order)
                if rows:
                    yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)), schema=ARROW)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", "[^/]*$", 0), "content").mapInArrow(run, INDEX)


def order(row) -> tuple:
    """Place of a capture: URL key, time, page, then where it is stored."""
    return (row[5], row[6], row[0] is not None, row[0] or 0, row[7], row[8])


class LoserTree:
    """Merges sorted runs: each step replays one leaf's path, comparing it with the losers kept there."""

    def __init__(self, runs, key):
        self.runs, self.key = [iter(r) for r in runs], key
        self.k = len(self.runs)
        self.heads = [next(r, None) for r in self.runs]
        self.losers = [-1] * self.k
        self.winner = self._build(1) if self.k > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and self.key(x) <= self.key(y)

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        a, b = (a, b) if self._before(a, b) else (b, a)
        self.losers[node] = b
        return a

    def __iter__(self):
        while self.k and (row := self.heads[self.winner]) is not None:
            yield row
            at = self.winner
            self.heads[at] = next(self.runs[at], None)
            node = (at + self.k) // 2
            while node:
                if not self._before(at, self.losers[node]):
                    at, self.losers[node] = self.losers[node], at
                node //= 2
            self.winner = at


#: Rows of a run that are in memory at a time while it is merged, and runs that are merged at a time.
STRIP, FAN_IN = 256, 512
#: Captures of a range, about.
RANGE_ROWS = 1_000_000
ARROW = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (x.split() for x in INDEX.split(", "))])


class Spill:
    """Runs of captures in a file of the task's own, which the system removes with it; a lost task writes its own again."""

    def __init__(self):
        self.file, self.runs, self.strips = tempfile.TemporaryFile(), [], 0  # noqa: SIM115
        self.out = pa.ipc.new_file(self.file, ARROW)

    def put(self, batch: pa.RecordBatch, new_run: bool) -> None:
        """Appends rows in order to the last run, or to a new one."""
        if new_run or not self.runs:
            self.runs.append([])
        for k in range(0, batch.num_rows, STRIP):
            self.out.write_batch(batch.slice(k, STRIP))
            self.runs[-1].append(self.strips)
            self.strips += 1

    def readers(self) -> list:
        """An iterator over the rows of each run, strip by strip."""
        self.out.close()
        self.file.seek(0)
        held = pa.ipc.open_file(self.file)

        def rows(strips):
            for k in strips:
                yield from zip(*(c.to_pylist() for c in held.get_batch(k).columns), strict=True)

        return [rows(strips) for strips in self.runs]


def batched(rows, size: int = 10_000):
    """Arrow batches of the rows of an iterator."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), ARROW, strict=True)], schema=ARROW)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), ARROW, strict=True)], schema=ARROW)


def merged(batches, fan_in: int = FAN_IN):
    """Batches of sorted runs, one run after another, as one sorted stream of batches.

    Rows come in the order in which the runs were written. A row below the one before it starts another run,
    so a run that arrives in parts is merged all the same. Runs wait on disk; in memory are a strip of each of
    the `fan_in` runs that are merged at a time. More runs than that are merged in several passes.
    """
    spill, last = Spill(), None
    for b in batches:
        keys = [order(row) for row in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        cuts = [k for k, key in enumerate(keys) if (last if k == 0 else keys[k - 1]) is None or key < (last if k == 0 else keys[k - 1])]
        for s, e in zip([0, *cuts], [*cuts, len(keys)], strict=True):
            if e > s:
                spill.put(b.slice(s, e - s), s in cuts)
        last = keys[-1] if keys else last
    runs = spill.readers()
    while len(runs) > fan_in:
        spill = Spill()
        for k in range(0, len(runs), fan_in):
            for n, b in enumerate(batched(LoserTree(runs[k : k + fan_in], order))):
                spill.put(b, n == 0)
        runs = spill.readers()
    yield from batched(LoserTree(runs, order))


def merge_captures(index: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Globally ordered captures: partitions follow each other, and inside each the runs are merged.

    Ranges are cut over URL key, time and page, so the captures of one hot URL spread over many; a range
    holds a slice of every run, in order, which a loser tree merges from disk.
    """
    parts = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-index.count() // range_rows))
    ranged = index.repartitionByRange(parts, "url_key", "ts", "page_id", "run", "offset")
    return ranged.mapInArrow(merged, INDEX)


def archive_pages(pages: DataFrame, min_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Archives `pages` (page_id, url, html), reads the archives back and merges their indexes (INDEX).

    Null html is an empty payload; null urls give an empty target; rows that tie for the smallest page_id
    of a payload are all responses; a null page_id stays null and is never referred to; an empty table
    gives an empty result; other columns are not archived. A payload of any length that Spark's cells hold
    is one record, read again whole in a task.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    path = path or scratch.path("archive")
    write_warc(pages, path, scratch, min_bytes)
    return merge_captures(scratch.write(read_captures(spark, path), "runs", batch=1))


def op4_warc(spark, sf_dir: str) -> DataFrame:
    """Every row of pages, as read back from the archives, in order of URL key, time and page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return archive_pages(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT page_id, n, h, array_to_string(list_transform(range(0, 32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  CAST((CAST('0x' || substring(h, CAST((i // 8) * 10 + 1 AS INTEGER), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INTEGER)) & 31 AS INTEGER) + 1, 1)), '') AS digest,
  min(page_id) OVER (PARTITION BY h, n) AS first FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM b
"""
