"""Connected components of records by their keys."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpointed(spark: SparkSession) -> None:
    """Name the folder for checkpoint(): spark.checkpoint.dir, which a cluster must set."""
    if spark.sparkContext.getCheckpointDir() is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        spark.sparkContext.setCheckpointDir(base or "file:///tmp/quillstack-checkpoints")  # the latter in tests


def key_components(records: DataFrame, id_col: str, keys_col: str, max_rounds: int = 60) -> DataFrame:
    """(id, component): the least id among records connected by shared keys; records without keys stand alone (ER-01, ER-02).

    A key links its records to the least of them, so links are as many as keys of records.  Rounds of large
    and small stars then move every link nearer to its component's least id; their number is logarithmic in
    the longest chain, and no round has more links than the last.  Each is cut with checkpoint() in the
    shared folder, and ends with a count and a checksum, which is all that reaches the driver.
    """
    checkpointed(records.sparkSession)
    pairs = records.select(F.col(id_col).alias("id"), F.explode(keys_col).alias("key")).distinct()
    links = pairs.join(pairs.groupBy("key").agg(F.min("id").alias("v")), "key").where("id <> v").select(F.col("id").alias("u"), "v").distinct().checkpoint()
    seen = None
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: whatever is above a node is linked to the least that it knows
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        up = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and what is below it are linked to the least of these
        low = up.groupBy("u").agg(F.min("v").alias("m"))
        down = up.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        links = down.where("u <> v").distinct().checkpoint()
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    comp = links.groupBy("u").agg(F.min("v").alias("c"))
    ids = records.select(F.col(id_col).alias("id")).distinct()
    return ids.join(comp, ids["id"] == comp["u"], "left").select("id", F.coalesce("c", "id").alias("component"))
