"""What the operators of this subpackage share: tables, the shared scratch folder, components."""

from __future__ import annotations

import ctypes
import gc
import sys
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import AbstractContextManager, contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.  Only where a session in local mode names none (tests), one under /tmp."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        base = "file:///tmp/quillstack-checkpoints"
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/quillstack/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back, which cuts its lineage.

    The table survives lost executors; it is removed with drop_scratch() or with the folder.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    (df.sortWithinPartitions(*by) if by else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_in_turns(parts: Iterable[DataFrame], label: str) -> DataFrame:
    """As staged(), of the rows of all parts (of one schema), each written before the next is asked for."""
    path = None
    for df in parts:
        path = path or scratch_path(df.sparkSession, label)
        df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def merged(df: DataFrame) -> DataFrame:
    """df for a join by merging, at every size.

    What an explode, a Python function or a compressed file gives is many times what Spark takes it for from its
    input, so that by Spark's own choice it would be broadcast, through the driver, at tens of times the threshold.
    """
    return df.hint("merge")


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """The session's setting within it; what it was comes back after."""
    was = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def shuffles_dropped(spark: SparkSession) -> AbstractContextManager[None]:
    """Within it, shuffle files go when the query that wrote them ends, not when the driver happens to collect its garbage."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Within it, Arrow batches of what is run hold at most so many rows, for long texts beside full heaps; the session's setting comes back after."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    if not 0 < int(was) <= rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, was)


def drop_caches(but: str) -> None:
    """Within a task: give back what other modules of this package keep in this worker, which operators that run one after the other share."""
    kept = [f for name, m in list(sys.modules.items()) if name.startswith(f"{__package__}.") and name != but for f in vars(m).values() if hasattr(f, "cache_clear") and f.cache_info().currsize]
    if not kept:
        return
    for f in kept:
        f.cache_clear()
    gc.collect()
    give_back()


def give_back() -> None:
    """Return what this process has freed to the system; Arrow and glibc keep it otherwise."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def lean(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f for mapInArrow, giving back at the end of a task what it held: workers stay, idle, while the heap beside them fills in later stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def drop_scratch(df: DataFrame) -> None:
    """Remove a table made by staged() that no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        if "/quillstack/" in f:
            p = jvm.org.apache.hadoop.fs.Path(f)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def components(edges: DataFrame, label: str = "cc", max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): rows (id, comp) with comp the least id reachable.

    Large-star / small-star rounds: every round is two grouped aggregations over the edge set, whose
    size never grows past the input's, and the number of rounds is logarithmic in the diameter.
    Nothing is collected but a count and a checksum.  Empty edges give an empty result.
    """
    e = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a <> b")
    cur = staged(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{label}-edges")
    before = None
    for _ in range(max_rounds):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(m, "u")
            .where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        m2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(m2, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p"))
            .select("p.u", "p.v")
            .where("u <> v")
            .distinct()
        )
        nxt = staged(small, f"{label}-round")
        now = nxt.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("s")).first()
        drop_scratch(cur)
        cur = nxt
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return cur.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("id"), "comp").unionByName(
        cur.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct()
    )
