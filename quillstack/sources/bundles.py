"""JSON bundles behind a manifest, read strictly or permissively, and written without needless change."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PERSON = "struct<name: string, affiliation: string, github: string, linkedin: string, twitter: string>"
MEETING = "struct<slug: string, name: string, date: string, location: string, canceled: boolean, talkCount: int>"
TALK = f"struct<id: string, meeting: string, meetingName: string, meetingLocation: string, meetingDate: string, category: string, title: string, speakers: array<{PERSON}>, abstract: string, videoUrl: string, videoId: string, slidesUrl: string, projectGithub: string, tags: array<string>>"
PAPER = "struct<id: string, source: string, sourceName: string, title: string, authors: array<struct<name: string, affiliation: string>>, year: string, publication: string, venue: string, type: string, abstract: string, paperUrl: string, sourceUrl: string, openalexId: string, doi: string, tags: array<string>, keywords: array<string>, citationCount: int, contentFormat: string, content: string>"
EVENT_BUNDLE = f"meeting {MEETING}, talks array<{TALK}>, _corrupt_record string"
PAPER_BUNDLE = f"source struct<slug: string, name: string, url: string>, papers array<{PAPER}>, _corrupt_record string"


class ManifestError(ValueError):
    """A manifest that doesn't say what it must."""


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as text, through Spark's file systems."""
    return spark.read.text(path, wholetext=True).first()[0]


def normalize_manifest(payload: object, keys: tuple[str, ...], prefix: str = "") -> tuple[str, list[str]]:
    """(version, files) of a manifest (SRC-02, SRC-05).

    keys: where the list of files may be; entries are names or objects with file or path.  Raises
    ManifestError where it is no object, has no version or files, or names something else than .json.
    """
    if not isinstance(payload, dict):
        raise ManifestError("the manifest is not an object")
    version = str(payload.get("dataVersion") or "").strip()
    if not version:
        raise ManifestError("the manifest has no dataVersion")
    for k in keys:
        entries = payload.get(k)
        if isinstance(entries, list):
            files = [str(e.get("file") or e.get("path") or "") if isinstance(e, dict) else str(e or "") for e in entries]
            files = [f.strip() for f in files if f.strip()]
            if bad := [f for f in files if not f.endswith(".json")]:
                raise ManifestError(f"not JSON: {bad[0]}")
            if files:
                return version, [f if f.startswith(prefix) else prefix + f for f in files]
    raise ManifestError(f"the manifest has none of {', '.join(keys)}")


def load_manifest(spark: SparkSession, candidates: Iterable[str], keys: tuple[str, ...], prefix: str = "") -> tuple[str, list[str], str]:
    """The first manifest that can be read, with its path; the error tells all failures (SRC-07)."""
    failed = []
    for path in candidates:
        try:
            return *normalize_manifest(json.loads(read_text(spark, path)), keys, prefix), path
        except Exception as e:  # noqa: BLE001  # the next candidate may do
            failed.append(f"{path}: {str(e).splitlines()[0][:200]}")
    raise ManifestError("no manifest: " + "; ".join(failed))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_bundles(spark: SparkSession, root: str, files: list[str], schema: str, rows: str, strict: bool = True) -> DataFrame:
    """One row a bundle: _file, _seq (place in the manifest) and the bundle's fields (SRC-01, 03, 04, 06, VAL-04, VAL-09).

    strict: a missing or malformed bundle, or one without its list of rows, fails the read.  Otherwise
    missing files are left out, and malformed ones keep their text in _corrupt_record.
    """
    paths = [f"{root.rstrip('/')}/{f}" for f in files]
    if not strict:
        paths = [p for p in paths if exists(spark, p)]
    if not paths:
        return spark.createDataFrame([], f"{schema}, _file string, _seq int")
    order = F.create_map(*(F.lit(x) for i, f in enumerate(files) for x in (f.rsplit("/", 1)[-1], i)))
    df = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(paths)
    df = df.withColumn("_file", F.element_at(F.split(F.input_file_name(), "/"), -1)).withColumn("_seq", order[F.col("_file")])
    if strict:
        bad = F.col("_corrupt_record").isNotNull() | F.col(rows).isNull()
        df = df.withColumn(rows, F.when(bad, F.raise_error(F.concat(F.lit("malformed bundle: "), F.col("_file"))).cast(df.schema[rows].dataType)).otherwise(F.col(rows)))
    return df


def talks(bundles: DataFrame) -> DataFrame:
    """Talks of all bundles in the manifest's order, with _seq."""
    t = bundles.select("_file", F.col("_seq").alias("_b"), F.posexplode("talks").alias("_i", "t")).select("_file", "_b", "_i", "t.*")
    return t.withColumn("_seq", F.col("_b").cast("long") * 1_000_000 + F.col("_i")).drop("_b", "_i")


def meetings(bundles: DataFrame) -> DataFrame:
    return bundles.where("meeting is not null").select("_file", "_seq", "meeting.*")


def papers(bundles: DataFrame) -> DataFrame:
    """Papers with the bundle's source where they have none of their own (SRC-08)."""
    p = bundles.select("_file", F.col("_seq").alias("_b"), F.col("source").alias("_s"), F.posexplode("papers").alias("_i", "p"))
    p = p.select("_file", "_b", "_i", "_s", "p.*")
    fill = lambda c, k: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.col("_s")[k], F.lit(""))
    p = p.withColumn("source", fill("source", "slug")).withColumn("sourceName", fill("sourceName", "name"))
    return p.withColumn("_seq", F.col("_b").cast("long") * 1_000_000 + F.col("_i")).drop("_b", "_i", "_s")


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """(canonical, alias) of lines `canonical` or `canonical:alias,alias`, # starting comments (SRC-23)."""
    t = spark.read.text(path).select(F.trim("value").alias("v")).where("v <> '' and not startswith(v, '#')")
    name = F.trim(F.element_at(F.split("v", ":"), 1))
    rest = F.filter(F.transform(F.split(F.regexp_replace("v", "^[^:]*:?", ""), ","), lambda x: F.trim(x)), lambda x: x != "")
    return t.select(name.alias("canonical"), F.explode(F.array_distinct(F.concat(F.array(name), rest))).alias("alias"))


def canonical_tags(config: list[str] | None, records: DataFrame, tags: str, order: str) -> list[str]:
    """The vocabulary given, else the records' tags, the first spelling of each, in order (SRC-24)."""
    if config:
        return list(dict.fromkeys(config))
    t = records.select(order, F.posexplode(tags).alias("i", "tag")).withColumn("k", F.regexp_replace(F.lower("tag"), "[^a-z0-9]+", "")).where("k <> ''")
    rows = t.groupBy("k").agg(F.min_by("tag", F.struct(order, "i")).alias("tag"), F.min(F.struct(order, "i")).alias("o")).orderBy("o").collect()  # a vocabulary, not records
    return [r["tag"] for r in rows]


def cached_works(spark: SparkSession, path: str, wanted: DataFrame, schema: str) -> DataFrame:
    """Works of cached responses that are wanted (id), the first file's of each (SRC-13 to SRC-16)."""
    w = spark.read.schema(f"results array<struct<{schema}>>").option("multiLine", True).json(path).select(F.input_file_name().alias("f"), F.posexplode("results").alias("i", "r"))
    w = w.select("f", "i", "r.*").withColumn("id", F.regexp_extract(F.upper(F.element_at(F.split("id", "/"), -1)), r"^(W\d+)$", 1))
    once = w.join(wanted.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min_by(F.struct(*(c for c in w.columns if c not in ("f", "i", "id"))), F.struct("f", "i")).alias("w"))
    return once.select("id", "w.*")


LOG_ENTRY = "struct<kind: string, loggedAt: string, sortHint: string, fingerprint: string, parts: array<string>, title: string, url: string, talkId: string, paperId: string>"


def update_log(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a log (an object with dataVersion, generatedAt and entries, or a folder of such), with logged_at read from loggedAt, null where it is no time (SRC-22).

    A file without a list of entries fails the read.  For the reader's order, newest first and what has no time last, see
    newest_first().
    """
    from quillstack.functions.fields import iso_timestamp

    df = spark.read.schema(f"dataVersion string, generatedAt string, entries array<{LOG_ENTRY}>, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    bad = F.col("_corrupt_record").isNotNull() | F.col("entries").isNull()
    entries = F.when(bad, F.raise_error(F.concat(F.lit("malformed log: "), F.input_file_name())).cast(df.schema["entries"].dataType)).otherwise(F.col("entries"))
    return df.select("dataVersion", F.explode(entries).alias("e")).select("dataVersion", "e.*").withColumn("logged_at", iso_timestamp("loggedAt"))


def newest_first() -> list[F.Column]:
    """The order in which a log is shown (SRT-02, SRC-22)."""
    return [F.desc_nulls_last("logged_at"), F.desc_nulls_last("sortHint"), F.desc_nulls_last("title"), F.col("fingerprint")]


def tag_vocabulary(records: DataFrame, tags: str, order: str) -> DataFrame:
    """(key, tag, place): canonical_tags() of records as a table, the first spelling of each key, in order (SRC-24)."""
    from quillstack.operators.numbering import numbered

    t = records.select(order, F.posexplode(tags).alias("i", "tag")).withColumn("key", F.regexp_replace(F.lower("tag"), "[^a-z0-9]+", "")).where("key <> ''")
    first = t.groupBy("key").agg(F.min(F.struct(order, "i", "tag")).alias("f"))
    return numbered(first.select("key", "f.*"), [order, "i"]).select("key", "tag", "place")


def batch_key(ids: F.Column) -> F.Column:
    """Name of a cached batch: SHA-1 of its sorted ids (SNK-05)."""
    return F.sha1(F.array_join(F.array_sort(ids), "|").cast("binary"))


def save_if_changed(df: DataFrame, path: str, key: list[str] | None = None) -> bool:
    """Publish df as the next version of the table at path unless that has the same rows; tells whether it did (SNK-01, SNK-07)."""
    from .versions import VersionedTable

    return VersionedTable(df.sparkSession, path).publish(df, key)


def updated_manifest(manifest: dict, key: str, files: list[str], version: str, changed: bool, force: bool = False) -> dict:
    """The manifest with its files, newest name first, and a new version only where something changed (SNK-02, INC-11, SET-04)."""
    names = sorted({*manifest.get(key, []), *files}, reverse=True)
    out = {**manifest, key: names}
    if force or changed or names != manifest.get(key):
        out["dataVersion"] = version
    return out
