"""WARC archives: write pages, read records back, and merge their index into capture histories.

Archives are written by Spark's own file writer, one file a task, so that lost tasks leave nothing
behind.  Reading parses records by their Content-Length.  Each reading task sorts the index entries it
met into a run; runs are kept in the shared folder, dealt by ranges of (URL key, time), and in each
range the runs' pieces are merged by a loser tree, which gives one global order.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from typing import Any
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, staged

EPOCH = 1704067200  # where the query's capture times start
#: Bytes of an archive before compression, on average, and index rows of a range.
ARCHIVE_BYTES, RANGE_ROWS = 128 << 20, 100_000


def base32_sha1(payload: Column) -> Column:
    """SHA-1 of binary, in upper-case base32: 160 bits are four groups of eight characters."""
    hexa = F.sha1(payload)
    groups = [F.lpad(F.lower(F.conv(F.substring(hexa, 1 + 10 * i, 10), 16, 32)), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), "0123456789abcdefghijklmnopqrstuv", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", time_col: str | None = None, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write one record a row under path (gzip files; Spark's writer commits them).

    Rows with equal payloads of at least min_bytes: those with the largest id are response records, the
    others revisit records that refer to it.  Payloads are the text in UTF-8, null as empty.  A null url
    becomes urn:x-page:<id>; line ends in urls are dropped.  Without time_col a page's capture time is
    EPOCH plus its id in seconds.  Repeated rows give repeated records.  The largest id of each digest is
    found by an aggregation on digests; the join back may split a hot digest, for which AQE cares.  An
    archive holds as many records as make archive_bytes at their mean size.
    """
    mean = pages.agg(F.avg(F.coalesce(F.octet_length(payload_col), F.lit(0)))).first()[0] or 0.0
    most = max(1, int(archive_bytes / (mean + 500)))  # 500: about what headers take
    t = F.expr(f"timestamp_seconds({EPOCH} + coalesce(pmod(`{id_col}`, 1000000000), 0))") if time_col is None else F.col(time_col)
    page = pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.regexp_replace(F.col(url_col), "[\r\n]", ""), F.concat(F.lit("urn:x-page:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("url"),
        F.coalesce(F.col(payload_col), F.lit("")).alias("payload"),
        F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
    ).withColumn("digest", base32_sha1(F.col("payload").cast("binary")))
    keepers = page.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.max("id").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n")
    known = page.join(keepers, "digest", "left").withColumn("again", F.coalesce(F.col("id") != F.col("keeper"), F.col("keeper").isNotNull()))
    size = F.octet_length("payload").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit("\r\n\r\n"))
    block = F.when(F.col("again"), http).otherwise(F.concat(http, "payload"))
    urn = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(F.col("again"), "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), urn("id"),
        F.lit("\r\nWARC-Date: "), F.col("date"),
        F.lit("\r\nWARC-Target-URI: "), F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(F.col("again"), F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), urn("keeper"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length("block").cast("string"),
        F.lit("\r\n\r\n"), F.col("block"),
    )
    (
        known.withColumn("block", block).select(record.alias("value"))
        .write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", most).text(path)
    )


def records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of each record of an archive, gzipped (in one or more members) or plain.

    Offsets count in the unpacked stream.  Holds one record and one megabyte beyond it.  Raises where a
    record is cut short or malformed.
    """

    def unpacked() -> Iterator[bytes]:
        if data[:2] != b"\x1f\x8b":
            for i in range(0, len(data), 1 << 20):
                yield data[i : i + (1 << 20)]
            return
        z, rest = zlib.decompressobj(31), memoryview(data)
        while len(rest):
            some, rest = rest[: 1 << 18], rest[1 << 18 :]
            while len(some):
                yield z.decompress(some)
                some = z.unused_data
                if z.eof:
                    if not some:
                        z = zlib.decompressobj(31) if len(rest) else z
                        break
                    z = zlib.decompressobj(31)
        if not z.eof:
            raise ValueError("archive cut short")

    buf, start, source = bytearray(), 0, unpacked()

    def upto(n: int) -> bool:
        while len(buf) < n:
            more = next(source, None)
            if more is None:
                return False
            buf.extend(more)
        return True

    while upto(1):
        looked = 0
        while (end := buf.find(b"\r\n\r\n", max(0, looked - 3))) < 0:
            looked = len(buf)
            if not upto(looked + 1):
                raise ValueError("record header cut short")
        first, *lines = bytes(buf[:end]).decode("utf-8").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at {start}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        stop = end + 4 + int(head["content-length"])
        if not upto(stop + 4) or buf[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at {start} is cut short")
        yield start, head, bytes(buf[end + 4 : stop])
        del buf[: stop + 4]
        start += stop + 4


def url_key(url: str) -> str:
    """The key by which captures of one page sort together: host reversed, no scheme, port 80/443 or www., query sorted, no fragment."""
    try:
        u = urlsplit(url.strip())
        host, port = u.hostname or "", u.port
    except ValueError:
        return url.strip().lower()
    if not host:
        return url.strip().lower()
    host = ",".join(reversed(host.removeprefix("www.").split(".")))
    return f"{host}{'' if port in (None, 80, 443) else f':{port}'}){(u.path or '/').lower()}{'?' + '&'.join(sorted(u.query.lower().split('&'))) if u.query else ''}"


class LoserTree:
    """Merges sorted runs of (key, row): each inner node holds the run that lost there, the root's winner comes out next."""

    def __init__(self, runs: list[Iterator[tuple[Any, Any]]]):
        self.runs = runs
        self.k = 1 << max(0, (len(runs) - 1)).bit_length()
        self.heads: list[tuple[Any, Any] | None] = [next(r, None) for r in runs] + [None] * (self.k - len(runs))
        self.loser = [0] * self.k
        winner = [0] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winner[2 * node], winner[2 * node + 1]
            winner[node], self.loser[node] = (a, b) if self.before(a, b) else (b, a)
        self.top = winner[1] if self.k > 1 else 0

    def before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None
        return (x[0], a) <= (y[0], b)

    def __iter__(self) -> Iterator[tuple[Any, Any]]:
        while self.runs and (head := self.heads[self.top]) is not None:
            yield head
            run = self.top
            self.heads[run] = next(self.runs[run], None)
            node = (run + self.k) >> 1
            while node:
                if self.before(self.loser[node], run):
                    run, self.loser[node] = self.loser[node], run
                node >>= 1
            self.top = run


INDEX = "urlkey string, captured_at string, page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, archive string, record_offset long, run string"


def index_entry(path: str, offset: int, head: dict[str, str], block: bytes) -> tuple:
    """The index columns of a record, run aside.  A response's payload is measured and held against its digest."""
    page = lambda urn: int(x) if (x := urn.strip("<>").removeprefix("urn:x-page:")) else None
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    if head["warc-type"] == "response":
        size = len(payload)
        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:  # noqa: S324
            raise ValueError(f"the payload at {offset} of {path} doesn't match its digest")
    else:
        size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    refers = page(head["warc-refers-to"]) if "warc-refers-to" in head else None
    return url_key(head["warc-target-uri"]), head["warc-date"], page(head["warc-record-id"]), head["warc-target-uri"], head["warc-type"], digest, size, refers, path, offset


def _columns(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Index entries of all records under path, one sorted run a batch of archives (column run)."""
    names = [x.split()[0] for x in INDEX.split(", ")]
    kinds = [pa.int64() if x.endswith("long") else pa.string() for x in INDEX.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = [index_entry(file, *r) for r in records(content.as_py())]
                rows.sort(key=lambda r: (r[0], r[1], r[2] or 0, r[9]))
                for i in range(0, len(rows), 20_000):
                    yield _columns([(*r, file) for r in rows[i : i + 20_000]], names, kinds)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, INDEX)


def merge_index(runs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Sorted runs merged into one global order by (URL key, time, page, archive, offset).

    Ranges are cut on the whole key, so a URL with a third of all captures spans several of them, and are
    as many as make RANGE_ROWS rows each.  Spark sorts the rows of each run within a range, spilling where
    it must; the range's runs then meet in a loser tree, which holds that one range.
    """
    spark = runs.sparkSession
    kinds = [pa.int64() if x.endswith("long") else pa.string() for x in INDEX.split(", ")]
    names = [x.split()[0] for x in INDEX.split(", ")]
    order = ("urlkey", "captured_at", "page_id", "archive", "record_offset")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: list[list[tuple]] = []
        key = lambda r: (r[0], r[1], r[2] if r[2] is not None else -(2**63), r[8], r[9])  # noqa: E731  # nulls come first, as in Spark
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not pieces or pieces[-1][-1][10] != r[10]:
                    pieces.append([])
                pieces[-1].append(r)
        out: list[tuple] = []
        for _, r in LoserTree([((key(r), r) for r in rows) for rows in pieces]):
            out.append(r)
            if len(out) == 20_000:
                yield _columns(out, names, kinds)
                out = []
        if out:
            yield _columns(out, names, kinds)

    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // RANGE_ROWS))
    return runs.repartitionByRange(n, *order).sortWithinPartitions("run", *order).mapInArrow(merge, INDEX)


def capture_histories(pages: DataFrame, path: str | None = None, **options: Any) -> DataFrame:
    """Write pages as archives under path, read them back, and return the merged index (see INDEX)."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(pages, path, **options)
    return merge_index(staged(read_index(spark, path), "warc-runs"))
