from pyspark.sql import functions as F

from quillstack.llm.common import small_batches, staged


def test_small_batches(spark):
    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    d = spark.range(5000, numPartitions=1)
    with small_batches(spark, 700):
        got = staged(d.mapInArrow(sizes, "n long"), "t-sizes")
    assert spark.conf.get(key) == was
    assert got.agg(F.max("n"), F.sum("n")).first() == (700, 5000)


def test_caches_of_other_modules_go():
    from quillstack.llm import common, minhash, quality

    minhash.draws(), quality.model_code("x")
    common.drop_caches(quality.__name__)
    assert minhash.draws.cache_info().currsize == 0 and quality.model_code.cache_info().currsize == 1


def test_lean_gives_back():
    import numpy as np
    from quillstack.llm.common import lean

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096 / 1e6

    kept = []

    def hold(batches):
        for b in batches:
            some = [np.ones(64 << 10, np.uint8) for _ in range(3000)]
            kept.append(some[-1])  # lies above all that is freed, which glibc by itself keeps then
            yield b

    was = resident()
    assert list(lean(hold)(iter([1, 2]))) == [1, 2]
    assert resident() - was < 100


def test_turns_drop_their_shuffles(spark):
    import os
    import time

    from quillstack.llm.common import shuffles_dropped, staged_in_turns

    top = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    files = lambda: {f for d in top for _, _, names in os.walk(d.getPath()) for f in names if f.startswith("shuffle_") and f.endswith(".data")}
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was, before, left = spark.conf.get(key), files(), []

    def count():
        for _ in range(100):  # files go soon after
            if not files() - before:
                break
            time.sleep(0.1)
        return len(files() - before)

    def parts():
        for i in range(3):
            left.append(count())
            yield spark.range(9000).where(F.col("id") % 3 == i).repartition(5, "id")

    with shuffles_dropped(spark):
        got = staged_in_turns(parts(), "t-turns")
    assert spark.conf.get(key) == was
    assert left == [0, 0, 0] and count() == 0
    assert got.agg(F.count("*"), F.countDistinct("id")).first() == (9000, 9000)
