import random
import uuid

import pytest
from pyspark.sql import functions as F

from quillstack.operators import changes
from quillstack.streaming import history

SCHEMA = "id long, d long, slides string, video string, seq long"
WATCHED = {"slides": "slides", "video": "video"}


def snapshots(n_keys=30, n=8):
    r = random.Random(6)
    return [[(k, d, r.choice([None, "", "s"]), r.choice([None, "v"]), i) for i in range(r.choice([1, 1, 2])) for k in range(n_keys) if r.random() < 0.7] for d in range(1, n + 1)]


def told(df):
    return sorted((r.id, r.d, tuple(r.parts), r.fingerprint) for r in df.select("id", "d", "parts", "fingerprint").collect())


@pytest.mark.parametrize("files", [1, 3])
def test_a_restart_in_the_middle_tells_the_same(spark, tmp_path, files):
    root = f"file://{tmp_path}/{uuid.uuid4().hex}"
    some = snapshots()

    def land(days):
        for rows in days:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/in")

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(f"{root}/in")
        history.run_available(history.replay_stream(stream, "id", "d", WATCHED, "talk", "talk", seq="seq"), f"{root}/out", f"{root}/check")

    land(some[:3])
    run()
    first = told(spark.read.parquet(f"{root}/out"))
    land(some[3:])
    run()
    run()  # nothing new: nothing more is told
    whole = spark.createDataFrame([x for rows in some for x in {(r[0], r[1]): r for r in rows}.values()], SCHEMA)
    want = told(changes.replay(whole, "id", "d", WATCHED, "talk", "talk"))
    assert told(spark.read.parquet(f"{root}/out")) == want and set(first) < set(want)


def test_nulls(spark, tmp_path):
    spark.createDataFrame([(None, 1, "s", None, 0), (1, 1, None, None, 0)], SCHEMA).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"file://{tmp_path}/in")
    history.run_available(history.replay_stream(stream, "id", "d", WATCHED, "talk", "talk"), f"file://{tmp_path}/out", f"file://{tmp_path}/check")
    assert told(spark.read.parquet(f"file://{tmp_path}/out")) == [(1, 1, ("talk",), "talk:1:talk")]
    assert spark.conf.get(history.PROVIDER, "") != "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
