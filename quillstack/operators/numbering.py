"""Places in one order over a whole table, and running totals within keys.

A table is dealt out by ranges of its order and sorted within them, so that every partition knows its rows'
places but for what stands before it; the partitions' sums say that.  Ties and keys that hold much of the
table are dealt out like everything else, as rows that are otherwise equal keep the order of encounter.
Only one row a partition reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import checkpointed

Store = Callable[[DataFrame], DataFrame]
#: How two totals of one kind become one.
JOINED: dict[str, Callable] = {"sum": lambda a, b: a + b, "bit_xor": lambda a, b: a ^ b, "max": max, "min": min}
_ROW = 33  # bits of monotonically_increasing_id that hold the place within a partition


def checkpoint(df: DataFrame) -> DataFrame:
    checkpointed(df.sparkSession)
    return df.checkpoint()


def in_order(df: DataFrame, order: list[str | Column], store: Store = checkpoint, drop: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """df dealt out by ranges of its order and stored, with _part and _row (places of the partition, and within it, from 0).

    Rows that are equal in the order follow each other as they are met.  drop: columns that only the order needs.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*(F.col(c) if isinstance(c, str) else c for c in order), F.col("_tie")]
    dealt = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("_tie", *drop)
    at = F.monotonically_increasing_id()
    placed = dealt.withColumn("_at", at).select("*", F.shiftright("_at", _ROW).cast("int").alias("_part"), F.col("_at").bitwiseAND(F.lit((1 << _ROW) - 1)).alias("_row")).drop("_at")
    return store(placed)


def _by_part(placed: DataFrame, of: dict[int, list], schema: str) -> DataFrame:
    """placed with a few columns looked up by _part; what is broadcast has a row a partition."""
    few = placed.sparkSession.createDataFrame([(p, *v) for p, v in of.items()], f"_part int, {schema}")
    return placed.join(F.broadcast(few), "_part")


def numbered(df: DataFrame, order: list[str | Column], out: str = "place", store: Store = checkpoint) -> DataFrame:
    """df with its rows' places in the order, from 1; one shuffle, and no task sees more than a range."""
    placed = in_order(df, order, store)
    before, offsets = 0, {}
    for r in sorted(placed.groupBy("_part").agg(F.count("*").alias("n")).collect()):
        offsets[r["_part"]] = [before]
        before += r["n"]
    return _by_part(placed, offsets, "_before long").withColumn(out, F.col("_before") + F.col("_row") + 1).drop("_part", "_row", "_before")


def running(
    df: DataFrame, key: list[str], order: list[str | Column], totals: dict[str, tuple[str, Column]], store: Store = checkpoint, drop: tuple[str, ...] = ()
) -> DataFrame:
    """df with running totals within each key, the row itself included, and _part, _row.

    totals: name -> (kind, value); kinds are those of JOINED, values are never null.  The order holds
    within keys.  Keys may be null, and of any size: a key that spans partitions is carried from each to the next.
    """
    values = {f"_v{i}": (name, kind, value) for i, (name, (kind, value)) in enumerate(totals.items())}
    with_values = df.withColumns({v: value for v, (_, _, value) in values.items()})
    placed = in_order(with_values, [*key, *order], store, drop)
    whole = [getattr(F, kind)(v).alias(v) for v, (_, kind, _) in values.items()]
    of_key = placed.groupBy("_part", *key).agg(F.min("_row").alias("_row"), *whole).withColumn("_k", F.struct(*key))
    ends = of_key.groupBy("_part").agg(F.min_by("_k", "_row").alias("first"), F.max_by(F.struct("_k", *values), "_row").alias("last")).collect()  # a row a partition
    carried, held, at = {}, None, [None] * len(values)
    for r in sorted(ends, key=lambda r: r["_part"]):
        met = at if r["first"] == held else [None] * len(values)
        carried[r["_part"]] = [r["first"], *met]
        own = [r["last"][v] for v in values]
        through = met if r["first"] == r["last"]["_k"] else [None] * len(values)
        at = [b if a is None else JOINED[kind](a, b) for a, b, (_, kind, _) in zip(through, own, values.values(), strict=True)]
        held = r["last"]["_k"]
    kinds = dict(placed.dtypes)
    schema = f"_first {of_key.schema['_k'].dataType.simpleString()}, " + ", ".join(f"_c{v} {kinds[v]}" for v in values)
    out = _by_part(placed, carried, schema)
    names = ", ".join(f"`{c}`" for c in ("_part", *key))
    here = F.struct(*key).eqNullSafe(F.col("_first"))
    for v, (name, kind, _) in values.items():
        local = F.expr(f"{kind}(`{v}`) OVER (PARTITION BY {names} ORDER BY _row ROWS UNBOUNDED PRECEDING)").cast(kinds[v])
        out = out.withColumn(name, local)
        both = {"sum": F.col(name) + F.col(f"_c{v}"), "bit_xor": F.col(name).bitwiseXOR(F.col(f"_c{v}")), "max": F.greatest(name, f"_c{v}"), "min": F.least(name, f"_c{v}")}[kind]
        out = out.withColumn(name, F.when(here & F.col(f"_c{v}").isNotNull(), both).otherwise(F.col(name)))
    return out.drop("_first", *values, *(f"_c{v}" for v in values))
