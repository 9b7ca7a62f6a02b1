"""Data sources of Spark's Python API: members of archives, and pages of cached searches.

Partitions are planned from what the files say: an archive that isn't compressed is cut at its members, by its
headers alone; a compressed one can only be read from its start, so it is one partition.  Either is read
member by member, whatever its size: what is held is one member that was asked for.  Files are opened by
pyarrow's file systems (local or mounted folders, object stores, HDFS), by the same path on every executor.
"""

from __future__ import annotations

import gzip
import io
import json
import re
import tarfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillstack.operators.numbering import running

#: Bytes of members that one partition of an uncompressed archive reads, or that one batch of rows holds.
PART, BATCH = 64 << 20, 8 << 20
HEADER = 512


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if re.match(r"\w+:/", path) else f"file://{path}")


def listed(path: str) -> list[str]:
    """The file, or the files of the folder, as paths of its file system."""
    fs, p = opened(path)
    info = fs.get_file_info(p)
    if info.type == pafs.FileType.File:
        return [p]
    return sorted(f.path for f in fs.get_file_info(pafs.FileSelector(p, recursive=True)) if f.type == pafs.FileType.File)


@dataclass
class Members(InputPartition):
    archive: str
    #: (name, offset, size) of members, or None: read the archive from its start
    some: list[tuple[str, int, int]] | None


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.pattern = options["path"], re.compile(options.get("pattern", ""), re.IGNORECASE)
        self.files = set(json.loads(options["files"])) if "files" in options else None

    def wanted(self, m: tarfile.TarInfo) -> bool:
        return m.isfile() and bool(self.pattern.search(m.name))

    def partitions(self) -> list[Members]:
        fs, _ = opened(self.path)
        out = []
        for archive in (f for f in listed(self.path) if re.search(r"\.(tar|tar\.gz|tgz)$", f, re.IGNORECASE)):
            if self.files is not None and archive.rsplit("/", 1)[-1] not in self.files:
                continue
            if not archive.lower().endswith(".tar"):
                out.append(Members(archive, None))
                continue
            some, held = [], 0
            with fs.open_input_file(archive) as f, tarfile.open(fileobj=f, mode="r:") as tar:
                while (m := tar.next()) is not None:  # headers only: contents are skipped by seeking
                    tar.members = []
                    if self.wanted(m):
                        some.append((m.name, m.offset_data, m.size))
                        held += m.size + HEADER
                        if held >= PART:
                            out.append(Members(archive, some))
                            some, held = [], 0
            if some:
                out.append(Members(archive, some))
        return out

    def members(self, part: Members) -> Iterator[tuple[str, bytes]]:
        fs, _ = opened(self.path)
        if part.some is not None:
            with fs.open_input_file(part.archive) as f:
                for name, offset, size in part.some:
                    f.seek(offset)
                    yield name, f.read(size)
            return
        with fs.open_input_stream(part.archive, compression=None) as raw, gzip.GzipFile(fileobj=io.BufferedReader(raw)) as f, tarfile.open(fileobj=f, mode="r|") as tar:
            while (m := tar.next()) is not None:
                tar.members = []  # else it keeps a header of every member
                if self.wanted(m):
                    yield m.name, tar.extractfile(m).read()

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, str]] = []
        held = 0
        for name, content in self.members(partition):
            rows.append((name, content.decode("utf-8", "replace")))
            held += len(content)
            if held >= BATCH:
                yield self.batch(partition, rows)
                rows, held = [], 0
        if rows:
            yield self.batch(partition, rows)

    @staticmethod
    def batch(part: Members, rows: list[tuple[str, str]]) -> pa.RecordBatch:
        names, texts = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array([part.archive] * len(rows)), pa.array(names), pa.array(texts)], names=["archive", "path", "text"])


class ArchiveSource(DataSource):
    """Members of .tar, .tar.gz and .tgz archives whose names match `pattern`, as (archive, path, text); `files` lists the archives' names, else all."""

    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return "archive string, path string, text string"

    def reader(self, schema) -> ArchiveReader:  # noqa: ARG002
        return ArchiveReader(self.options)


POSTS = r"(^|/)content/posts/.*\.(md|markdown|html|htm)$"


def posts_of(spark: SparkSession, path: str, longest: int | None = None, files: list[str] | None = None) -> DataFrame:
    """(archive, path, text, _seq) of an archive's posts, or of those of all archives in a folder, numbered in each by path without case (SRC-11)."""
    spark.dataSource.register(ArchiveSource)
    options = {"pattern": POSTS} | ({"files": json.dumps(files)} if files is not None else {})
    found = spark.read.format("archive_members").options(**options).load(path)
    placed = running(found, ["archive"], [F.lower("path"), F.col("path")], {"_n": ("sum", F.lit(1).cast("long"))})
    out = placed.select("archive", "path", "text", (F.col("_n") - 1).cast("int").alias("_seq"))
    return out.where(F.col("_seq") < longest) if longest is not None else out


@dataclass
class Search(InputPartition):
    place: int
    keyword: str


class PageReader(DataSourceReader):
    """One partition a keyword, as a page says whether there is another."""

    def __init__(self, options: dict[str, str]):
        self.path, self.keywords = options["path"], json.loads(options["keywords"])
        self.year, self.per_page, self.most = int(options["startYear"]), int(options["perPage"]), int(options.get("maxPages", 1_000_000))

    def partitions(self) -> list[Search]:
        return [Search(i, k) for i, k in enumerate(self.keywords)]

    def read(self, partition: Search) -> Iterator[tuple]:
        fs, root = opened(self.path)
        slug = re.sub(r"[^a-z0-9]+", "-", partition.keyword.lower()).strip("-") or "keyword"
        for page in range(1, self.most + 1):
            file = f"{root}/{slug}-y{self.year}-n{self.per_page}-p{page}.json"
            if fs.get_file_info(file).type != pafs.FileType.File:
                return  # not fetched yet
            with fs.open_input_stream(file) as f:
                payload = json.loads(f.read())
            results = payload.get("results") or []
            for i, work in enumerate(results):
                yield partition.keyword, partition.place, page, i, json.dumps(work, ensure_ascii=False)
            if not results or page * self.per_page >= int((payload.get("meta") or {}).get("count") or 0):
                return


class PageSource(DataSource):
    """Pages <slug>-y<startYear>-n<perPage>-p<page>.json of searches by keywords, each up to its last page: (keyword, place, page, i, work)."""

    @classmethod
    def name(cls) -> str:
        return "cached_pages"

    def schema(self) -> str:
        return "keyword string, place int, page int, i int, work string"

    def reader(self, schema) -> PageReader:  # noqa: ARG002
        return PageReader(self.options)


def discovered_works(spark: SparkSession, path: str, keywords: list[str], schema: str, start_year: int, per_page: int, max_pages: int | None = None) -> DataFrame:
    """Works of all pages of the keywords' searches, of those with one id the last met (SRC-13, SRC-14).

    Works without an id are left out.  schema: the works' fields, id among them.
    """
    spark.dataSource.register(PageSource)
    options = {"keywords": json.dumps(keywords), "startYear": str(start_year), "perPage": str(per_page)} | ({"maxPages": str(max_pages)} if max_pages else {})
    met = spark.read.format("cached_pages").options(**options).load(path).withColumn("w", F.from_json("work", schema))
    key = F.trim(F.regexp_replace(F.coalesce(F.col("w.id"), F.lit("")), r"\s+", " "))
    last = met.withColumn("key", key).where("key <> ''").groupBy("key").agg(F.max_by("w", F.struct("place", "page", "i")).alias("w"))
    return last.select("w.*")
