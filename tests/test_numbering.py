import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from quillstack.operators import numbering


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(3)
    some = [(r.choice([None, 1, 1, 1, 1, 2, 3]), r.randrange(5), r.getrandbits(60), i) for i in range(2000)]
    return spark.createDataFrame(some, "k int, o int, x long, i long").repartition(3).cache()


def test_places_are_those_of_the_order(rows):
    got = sorted(numbering.numbered(rows, ["o"]).collect(), key=lambda r: r.place)
    assert [r.place for r in got] == list(range(1, 2001)) and [r.o for r in got] == sorted(r.o for r in got)


def test_a_tie_of_all_rows_is_dealt_out(spark):
    df = spark.range(0, 10_000, 1, 4).select(F.lit(1).alias("same"), "id")
    placed = numbering.in_order(df, ["same"])
    sizes = [r["count"] for r in placed.groupBy("_part").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 6000
    got = sorted((r.place, r.id) for r in numbering.numbered(df, ["same"]).collect())
    assert got == [(i + 1, i) for i in range(10_000)]  # in order of encounter


def test_running_totals(rows):
    totals = {"n": ("sum", F.lit(1).cast("long")), "p": ("bit_xor", F.col("x")), "m": ("max", F.col("x")), "l": ("min", F.col("x"))}
    got = sorted(numbering.running(rows, ["k"], [F.desc("o")], totals).collect(), key=lambda r: (r.k is not None, r.k or 0, r._part, r._row))
    for _, of_key in groupby(got, key=lambda r: r.k):
        n, p, m, low, last = 0, 0, -1, 1 << 62, 9
        for r in of_key:
            n, p, m, low = n + 1, p ^ r.x, max(m, r.x), min(low, r.x)
            assert (r.n, r.p, r.m, r.l) == (n, p, m, low) and r.o <= last
            last = r.o


def test_empty(rows):
    none = rows.where("false")
    assert numbering.numbered(none, ["o"]).count() == 0 and numbering.running(none, ["k"], ["o"], {"n": ("sum", F.lit(1))}).count() == 0


def test_unique_ids_are_linear_in_a_repeated_base(spark):
    from quillstack.functions.keys import with_unique_ids

    n = 1_000_000
    df = spark.range(n, numPartitions=8).select("id", F.lit("same").alias("base")).unionByName(spark.createDataFrame([(n, "same-3"), (n + 1, "same-5"), (n + 2, "same-5"), (n + 3, "other"), (n + 4, "same-07")], "id long, base string"))
    got = with_unique_ids(df.withColumnRenamed("id", "at"), "base", "at")
    assert got.columns == ["at", "base", "id"]
    kept = {r.at: r.id for r in got.where((F.col("at") < 6) | (F.col("at") >= n - 1)).collect()}
    assert [kept[i] for i in range(6)] == ["same", "same-2", "same-4", "same-6", "same-7", "same-8"] and kept[n - 1] == f"same-{n + 2}"
    assert [kept[n + i] for i in range(5)] == ["same-3", "same-5", "same-5-2", "other", "same-07"]
    assert got.select("id").distinct().count() == n + 5


def test_batches_in_one_and_in_groups(spark):
    from quillstack.operators.records import chunks_of

    df = spark.range(0, 1000, 1, 4).select("id", (F.col("id") % 2).alias("g"))
    assert [r["count"] for r in chunks_of(df, "id", 300).groupBy("batch").count().orderBy("batch").collect()] == [300, 300, 300, 100]
    assert {(r.g, r.batch): r["count"] for r in chunks_of(df, "id", 300, "g").groupBy("g", "batch").count().collect()} == {(0, 0): 300, (0, 1): 200, (1, 0): 300, (1, 1): 200}
