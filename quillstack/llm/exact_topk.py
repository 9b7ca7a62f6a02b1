"""Exact top-k search by inner product through a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance from it.  Within a pivot's cell vectors are
sorted by that distance and cut into blocks of bounded size, each an annulus around the pivot.  A query at
distance d from the pivot is at least max(lo - d, d - hi, 0) from everything in the annulus [lo, hi], by the
triangle inequality, and with the largest norm in the annulus that bounds the inner product from above.
A query visits annuli in the order of their bounds, in rounds of growing width, and stops at the first whose
bound is below its k-th score so far; of those whose bound equals it, only such as hold a smaller id count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.operators import numbering

from .common import drop_scratch, staged

#: A pivot for so many vectors, pivots at most, rows of a block at least, blocks beyond one a cell at most.
A_PIVOT, PIVOTS, BLOCK, BLOCKS = 512, 1024, 1024, 32_768
#: Annuli that a query visits in the first round, and how much wider each later round is.
FIRST, WIDER = 4, 8
#: Requests for one block that one task answers.
REQUESTS = 4096
#: Below this, sums of products of integers are exact in double precision.
EXACT = 2.0**53


def whole(column: pa.Array, dim: int, scale: float) -> np.ndarray:
    """floor(scale * x) of each component, a row a vector."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.floor(flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), dim) * scale)


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, exact; where doubles can't hold them, by Python's integers, held to 64 bits."""
    most = [float(np.abs(x).max(initial=0.0)) for x in (q, c)]
    if most[0] * most[1] * max(1, q.shape[1]) < EXACT:
        return (q @ c.T).astype(np.int64)
    large = np.frompyfunc(int, 1, 1)
    exact = large(q).astype(object).dot(large(c).astype(object).T)
    return np.clip(exact, 1 - 2**63, 2**63 - 1).astype(np.int64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        d = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(d, 0))


def by_dimension(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = np.diff(batch.column(column).offsets.to_numpy())
    for d in np.unique(dims):
        yield int(d), batch if len(np.unique(dims)) == 1 else batch.filter(pa.array(dims == d))


def bounds(q: np.ndarray, pivots: np.ndarray, cell: np.ndarray, lo: np.ndarray, hi: np.ndarray, norm2: np.ndarray) -> np.ndarray:
    """The largest whole inner product that each query can have with a vector of each block; infinite where it can't be said."""
    with np.errstate(all="ignore"):
        q2 = (q * q).sum(axis=1)[:, None]
        d = distances(q, pivots)[:, cell]
        apart = np.maximum(np.maximum(d - hi, lo - d), 0)
        # rounding: squared distances are sums of squares of the norms' size
        apart = np.maximum(apart - 1e-6 * (np.sqrt(q2) + hi + np.sqrt(norm2)), 0)
        most = np.minimum((q2 + norm2 - apart * apart) / 2, np.sqrt(q2 * norm2))
        most = np.floor(most + 1e-9 * np.abs(most) + 1e-6)
    return np.where(np.isfinite(most), most, np.inf)


class Blocks:
    """What is known of the blocks of one dimension; PIVOTS + BLOCKS at most."""

    def __init__(self, pivots: np.ndarray, rows: list):
        self.pivots = pivots
        self.cell, self.part = (np.array([r[k] for r in rows], dtype=np.int64) for k in ("cell", "block"))
        self.lo, self.hi, self.norm2 = (np.array([r[k] for r in rows], dtype=np.float64) for k in ("lo", "hi", "norm2"))
        self.least = np.array([r["least"] for r in rows], dtype=np.int64)

    def wanted(self, q: np.ndarray, score: np.ndarray, last: np.ndarray, start: int, width: int) -> Iterator[np.ndarray]:
        """For each query the blocks at places start to start + width of its order that may hold better than (score, last); score is NaN while there are fewer than k."""
        most = bounds(q, self.pivots, self.cell, self.lo, self.hi, self.norm2)
        for u, s, i in zip(most, score, last, strict=True):
            order = np.lexsort((self.least, -u))[start : start + width]
            yield order if np.isnan(s) else order[(u[order] > s) | ((u[order] == s) & (self.least[order] <= i))]


def _assigned(batches: Iterator[pa.RecordBatch], pivots: dict[int, np.ndarray], scale: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for dim, some in by_dimension(b, 1):
            for at in range(0, some.num_rows, 2048):
                part = some.slice(at, 2048)
                v, p = whole(part.column(1), dim, scale), pivots[dim]
                cell = np.argmin(np.nan_to_num(distances(v, p), nan=np.inf), axis=1)
                with np.errstate(all="ignore"):
                    r, norm2 = np.sqrt(((v - p[cell]) ** 2).sum(axis=1)), (v * v).sum(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(v), dim, np.int32)), pa.array(cell.astype(np.int32)), pa.array(r), pa.array(norm2)], names=["id", "v", "query", "dim", "cell", "r", "norm2"])


def _requested(batches: Iterator[pa.RecordBatch], blocks, scale: float, start: int, width: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for dim, some in by_dimension(b, 2):
            known: Blocks = blocks.value[dim]
            for at in range(0, some.num_rows, 64):
                part = some.slice(at, 64)
                s, last = (part.column(i).to_numpy(zero_copy_only=False).astype(t) for i, t in ((3, np.float64), (4, np.float64)))
                got = list(known.wanted(whole(part.column(2), dim, scale), s, last, start, width))
                place, take = np.concatenate(got).astype(np.int64), np.repeat(np.arange(len(got)), [len(x) for x in got])
                if not len(take):
                    continue
                rows = part.take(pa.array(take))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(take), dim, np.int32)), pa.array(known.cell[place].astype(np.int32)), pa.array(known.part[place]), rows.column(0), rows.column(2), rows.column(3)], names=["dim", "cell", "block", "key", "v", "score"])


def best_of(q: np.ndarray, keys: np.ndarray, least: np.ndarray, c: np.ndarray, order: np.ndarray, own: dict[int, int], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) of each query's k best candidates but itself, none below least; order: places of the candidates by id."""
    s = products(q, c[order])
    ok = np.ones(s.shape, dtype=bool)
    for i, key in enumerate(keys.tolist()):
        if (j := own.get(key)) is not None:
            ok[i, j] = False
    n = min(k + 1, s.shape[1])
    floor = np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n]  # one more than k, as the query's own may be among them
    i, j = np.nonzero(ok & (s >= np.maximum(floor, least)[:, None]))
    sort = np.lexsort((j, -s[i, j], i))
    i, j = i[sort], j[sort]
    nth = np.arange(len(i)) - np.searchsorted(i, i)
    i, j = i[nth < k], j[nth < k]
    return i, order[j], s[i, j]


def _answered(batches: Iterator[pa.RecordBatch], k: int, scale: float) -> Iterator[pa.RecordBatch]:
    """Rows (dim, cell, block, salt, asked, key, id, v, score), of each block its vectors before its requests."""
    at: tuple | None = None
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    ready: tuple | None = None
    for b in batches:
        head = np.array([b.column(i).to_numpy() for i in range(5)]).T
        for lo, hi in zip(cuts := [0, *(np.flatnonzero((np.diff(head, axis=0) != 0).any(axis=1)) + 1).tolist()], [*cuts[1:], b.num_rows], strict=True):
            if lo == hi:
                continue
            part, here = b.slice(lo, hi - lo), tuple(head[lo, :4].tolist())
            if here != at:
                at, held, ready = here, [], None
            v, keys = whole(part.column(7), here[0], scale), part.column(5).to_numpy()
            if not head[lo, 4]:
                held.append((keys, part.column(6).to_numpy(zero_copy_only=False), v))
                continue
            if ready is None:
                own, ids, c = (np.concatenate(x) for x in zip(*held, strict=True))
                order = np.lexsort((own, ids))
                ready = own, ids, c, order, {x: j for j, x in enumerate(own[order].tolist())}
            own, ids, c, order, places = ready
            least = np.nan_to_num(part.column(8).to_numpy(zero_copy_only=False).astype(np.float64), nan=-np.inf)
            for q in range(0, len(v), 256):
                i, j, s = best_of(v[q : q + 256], keys[q : q + 256], least[q : q + 256], c, order, places, k)
                yield pa.RecordBatch.from_arrays([pa.array(keys[q + i]), pa.array(s), pa.array(ids[j]), pa.array(own[j])], names=["key", "score", "id", "other"])


def fitted(vectors: DataFrame, n: int, scale: float) -> dict[int, np.ndarray]:
    """{dimension: pivots}: the vectors with the least hashes, one for A_PIVOT rows of the table, PIVOTS at most."""
    out = {}
    for d in sorted(r["n"] for r in vectors.select(F.size("v").alias("n")).distinct().collect()):
        t = vectors.where(F.size("v") == d).orderBy(F.xxhash64("v", F.lit(23)), "id").limit(max(1, min(PIVOTS, n // A_PIVOT))).select("v").toArrow()
        out[d] = np.unique(whole(t["v"], d, scale), axis=0) if d else np.zeros((1, 0))
    return out


def top_k(vectors: DataFrame, queries: F.Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that `queries` selects the k rows with the largest inner products, ties to the smaller id.

    Components are taken as floor(scale * x), in double precision; scores are exact.  A row is no candidate of
    its own, but rows that repeat its id are.  Vectors take part unless they are null, hold a null, NaN or
    infinite component, or have no id; those of other lengths than a query's are not compared with it.  A query
    with fewer than k candidates gets them all, an empty table none.  The table may have other columns of any
    name.  Scores beyond 64 bits become the nearest that fits.

    The index is fitted on a sample of at most PIVOTS rows a length, and holds every row.  A few numbers for each
    of at most PIVOTS + BLOCKS blocks a length reach the driver and are broadcast; lengths are assumed to be few.
    """
    spark = vectors.sparkSession
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < float("inf")))
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.coalesce(queries, F.lit(False)).alias("query"))
    base = base.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(ok)
    n = base.count()
    pivots = fitted(base, n, scale)
    shared = spark.sparkContext.broadcast(pivots)
    kind = base.schema["v"].dataType.simpleString()
    keyed = base.mapInArrow(lambda it: _assigned(it, shared.value, scale), f"id long, v {kind}, query boolean, dim int, cell int, r double, norm2 double")
    sorted_cells = numbering.running(keyed, ["dim", "cell"], ["r", "id"], {"place": ("sum", F.lit(1).cast("long"))}, store=partial(staged, label="topk-cells"))
    rows = max(BLOCK, math.ceil(n / BLOCKS))
    key = F.shiftleft(F.col("_part").cast("long"), 33).bitwiseOR(F.col("_row"))
    index = staged(sorted_cells.select(key.alias("key"), "id", "v", "query", "dim", "cell", F.floor((F.col("place") - 1) / rows).alias("block"), "r", "norm2"), "topk-index", by=["dim", "cell", "block"])
    told = index.groupBy("dim", "cell", "block").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.max("norm2").alias("norm2"), F.min("id").alias("least")).collect()
    known = {d: Blocks(p, sorted((r for r in told if r["dim"] == d), key=lambda r: (r["cell"], r["block"]))) for d, p in pivots.items()}
    blocks = spark.sparkContext.broadcast(known)

    nothing = F.array().cast("array<struct<score:long,id:long,other:long>>")
    state = staged(index.where("query").select("key", "id", "v", nothing.alias("found")), "topk-state")
    start, width = 0, FIRST
    while start < max((len(b.cell) for b in known.values()), default=0):
        state = _round(state, index, blocks, k, scale, start, width, kind)
        start, width = start + width, width * WIDER
    out = state.select(F.col("id").alias("query_id"), F.posexplode("found").alias("rank", "f"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("f.id").alias("vec_id"), (-F.col("f.score")).alias("score"))


def _round(state: DataFrame, index: DataFrame, blocks, k: int, scale: float, start: int, width: int, kind: str) -> DataFrame:
    """state after each query has visited its next annuli; a table, as is each before it."""
    full = F.when(F.size("found") >= k, F.element_at("found", F.lit(k)))
    open_ = state.select("key", "id", "v", (-full["score"]).alias("score"), full["id"].alias("last"))
    asked = staged(open_.mapInArrow(lambda it: _requested(it, blocks, scale, start, width), f"dim int, cell int, block long, key long, v {kind}, score long"), "topk-asked")
    at = ["dim", "cell", "block"]
    # a block that many ask is answered in several tasks; blocks are of a bounded number, and so is what is broadcast
    shares = asked.groupBy(*at).agg(F.ceil(F.count("*") / REQUESTS).cast("int").alias("shares"))
    some = index.join(F.broadcast(shares), at).select(*at, F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("salt"), F.lit(0).alias("asked"), "key", "id", "v", F.lit(None).cast("long").alias("score"))
    ask = asked.join(F.broadcast(shares), at).select(*at, F.pmod(F.xxhash64("key"), F.col("shares")).cast("int").alias("salt"), F.lit(1).alias("asked"), "key", F.lit(None).cast("long").alias("id"), "v", "score")
    n = int(state.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = some.unionByName(ask).repartition(n, *at, "salt").sortWithinPartitions(*at, "salt", "asked")
    best = met.mapInArrow(lambda it: _answered(it, k, scale), "key long, score long, id long, other long")
    few = best.select("key", F.struct((-F.col("score")).alias("score"), "id", "other").alias("f")).withColumn("nth", F.expr("row_number() OVER (PARTITION BY key ORDER BY f)")).where(F.col("nth") <= k)
    gained = few.groupBy("key").agg(F.collect_list("f").alias("more"))
    merged = F.slice(F.array_sort(F.concat("found", F.coalesce("more", F.array().cast("array<struct<score:long,id:long,other:long>>")))), 1, k)
    out = staged(state.join(gained, "key", "left").select("key", "id", "v", merged.alias("found")), "topk-state")
    drop_scratch(asked)
    drop_scratch(state)
    return out
