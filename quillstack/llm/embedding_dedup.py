"""Embedding near-dedup through a pivot-permutation index.

Each vector is described by its `near` nearest reference vectors (pivots).  An inverted list holds, for
each pivot, the vectors that have it among theirs; two vectors meet in the lists of the pivots they
share, are candidates if they share at least `shared`, and are verified by their cosine in double
precision.  A list works on blocks of bounded size and returns sums and a spanning forest of the links
it found, never the pairs, so its output is linear in its members.

How many pivots and nearest ones are needed depends on the data: where many vectors lie close together,
so do pivots, and two neighbours share few of them.  So both are chosen by the recall measured on a
sample of vectors, dense places apart (see calibrated).
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, staged

#: Share of the links that the index must find in each of STRATA equal parts, by density, of a sample of SAMPLE vectors.
RECALL, SAMPLE, STRATA = 0.95, 2048, 8
#: Multiples of `near` that are tried before the number of pivots is halved.
WIDER = (1, 1.5, 2, 3, 4)
#: Real links looked at for each vector of the sample, and how many a part must have to be judged by them.
PARTNERS, ENOUGH = 8, 20
log = logging.getLogger(__name__)


def usable(vector: str):
    """True where the vector has a direction: not null or empty, all components finite, not all zero."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & ok & F.exists(vector, lambda x: x != 0), F.lit(False))


def units(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    v = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def fit_pivots(vectors: DataFrame, n_pivots: int, seed: int = 17) -> dict[int, np.ndarray]:
    """{dimension: unit vectors}: for each dimension the n_pivots vectors (key, v) with the least hash of key and seed."""
    order = F.xxhash64("key", F.lit(seed))
    dims = [r["n"] for r in vectors.select(F.size("v").alias("n")).distinct().collect()]
    out = {}
    for n in sorted(dims):
        t = vectors.where(F.size("v") == n).orderBy(order, "key").limit(n_pivots).select("v").toArrow()
        out[n] = units(t["v"], n)
    return out


def sampled_links(vectors: DataFrame, sample: dict[int, np.ndarray], least: float) -> dict[int, list[tuple[int, np.ndarray]]]:
    """{dimension: [(place in sample, partners)]}: by brute force over all vectors, up to PARTNERS links of each vector of the sample."""
    shared = vectors.sparkSession.sparkContext.broadcast(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[tuple[int, list[float]]]] = {}
        for b in batches:
            dims = np.diff(b.column(1).offsets.to_numpy())
            for dim in np.unique(dims):
                some = b.filter(pa.array(dims == dim))
                u, key, s = units(some.column(1), int(dim)), some.column(0).to_numpy(), shared.value[int(dim)]
                for lo in range(0, len(s), 256):
                    c = s[lo : lo + 256] @ u.T
                    for i in np.flatnonzero((c >= least).any(axis=1)):
                        j = np.flatnonzero((c[i] >= least) & (c[i] < 1 - 1e-12))
                        j = j[np.argsort(key[j])[:PARTNERS]]
                        at = (int(dim), lo + int(i))
                        held[at] = sorted(held.get(at, []) + [(int(key[x]), u[x].tolist()) for x in j])[:PARTNERS]
        rows = [(d, i, k, v) for (d, i), some in held.items() for k, v in some]
        for lo in range(0, len(rows), 4096):
            d, i, k, v = zip(*rows[lo : lo + 4096], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int32()), pa.array(i, pa.int32()), pa.array(k, pa.int64()), pa.array(v, pa.list_(pa.float64()))], names=["dim", "i", "key", "v"])

    found = vectors.select("key", F.col("v").cast("array<double>").alias("v")).mapInArrow(run, "dim int, i int, key long, v array<double>")
    found = found.groupBy("dim", "i").agg(F.slice(F.sort_array(F.collect_list(F.struct("key", "v"))), 1, PARTNERS).alias("some"))
    out: dict[int, list[tuple[int, np.ndarray]]] = {d: [] for d in sample}
    for r in found.select("dim", "i", "some.v").collect():
        out[r["dim"]].append((r["i"], np.array(r["v"])))
    return out


def width_needed(a: np.ndarray, b: np.ndarray, pivots: np.ndarray, shared: int) -> np.ndarray:
    """For each pair of rows of a and b, how many nearest pivots both need to share `shared`."""
    out = np.empty(len(a), dtype=np.int64)
    for lo in range(0, len(a), 256):
        ranks = [np.argsort(np.argsort(-(x[lo : lo + 256] @ pivots.T), axis=1), axis=1) for x in (a, b)]
        out[lo : lo + 256] = np.partition(np.maximum(*ranks), shared - 1, axis=1)[:, shared - 1] + 1
    return out


def calibrated(vectors: DataFrame, pivots: dict[int, np.ndarray], near: int, shared: int, least: float, target: float = RECALL) -> dict[int, tuple[np.ndarray, int, int, float]]:
    """{dimension: (pivots, near, shared, recall)}: the first choice whose recall is at least target in every part of the sample.

    Links are those of the sample by brute force, and for each vector of it one made up at a cosine of
    `least`, in a random direction.  Where no choice has it, one list holds all vectors, and no link is lost.
    """
    many = {d for d, p in pivots.items() if len(p) >= 2 * near}
    sample = fit_pivots(vectors.where(F.size("v").isin(*many)), SAMPLE, seed=29) if many else {}
    links = sampled_links(vectors.where(F.size("v").isin(*many)), sample, least) if many else {}
    rng = np.random.default_rng(31)
    out = {d: (p[:1], 1, 1, 1.0) for d, p in pivots.items()}
    for dim, s in sample.items():
        e = rng.normal(size=s.shape)
        e -= (e * s).sum(axis=1, keepdims=True) * s
        made = least * s + np.sqrt(1 - least**2) * e / np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-300)
        at = np.array([i for i, v in links[dim] for _ in v], dtype=np.int64)
        p = pivots[dim]
        while len(p) >= 2 * near and out[dim][1] == 1:
            dense = np.partition(-(s @ p.T), near - 1, axis=1)[:, near - 1]
            part = np.empty(len(s), dtype=np.int64)
            part[np.argsort(dense)] = np.arange(len(s)) * STRATA // len(s)
            fake = width_needed(s, made, p, shared)
            real = width_needed(s[at], np.concatenate([v for _, v in links[dim]]), p, shared) if len(at) else at
            needed = [w for q in range(STRATA) for w, few in ((fake[part == q], 1), (real[part[at] == q], ENOUGH)) if len(w) >= few]
            for k in (int(near * m) for m in WIDER):
                recall = min(float((w <= k).mean()) for w in needed)
                log.info("dimension %d, %d pivots, %d nearest, %d shared: recall %.3f in the worst part of the sample", dim, len(p), k, shared, recall)
                if recall >= target and k <= len(p):
                    out[dim] = p, k, shared, recall
                    break
            p = p[: len(p) // 2]
    return out


def nearest_pivots(vectors: DataFrame, pivots: dict[int, tuple[np.ndarray, int]]) -> DataFrame:
    """(key, w, v, dim, pivots): each vector with its nearest pivots, in ascending order of their numbers; pivots: and how many, by dimension."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = np.diff(b.column(2).offsets.to_numpy())
            for dim in np.unique(dims):
                some = b.filter(pa.array(dims == dim))
                u, (p, k) = units(some.column(2), int(dim)), shared.value[int(dim)]
                best = []
                for lo in range(0, len(u), 1024):
                    s = u[lo : lo + 1024] @ p.T
                    best.append(np.sort(np.argpartition(-s, k - 1, axis=1)[:, :k], axis=1))
                ids = np.concatenate(best).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * k), pa.array(ids.ravel()))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), some.column(2), pa.array(np.full(len(ids), dim, dtype=np.int32)), lists], names=["key", "w", "v", "dim", "pivots"])

    return vectors.select("key", "w", F.col("v").cast("array<double>").alias("v")).mapInArrow(run, "key long, w long, v array<double>, dim int, pivots array<int>")


def linked_in_block(u: np.ndarray, perm: np.ndarray, chunk: np.ndarray, a: int, b: int, pivot: int, shared: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of a list's block that are links and belong to this list: the pivot is the least that both share."""
    left, right = np.flatnonzero(chunk == a), np.flatnonzero(chunk == b)
    f = u.astype(np.float32)
    for lo in range(0, len(left), 512):
        rows = left[lo : lo + 512]
        s = f[rows] @ f[right].T
        i, j = np.nonzero(s >= least - 1e-4)
        i, j = rows[i], right[j]
        if a == b:
            once = i < j
            i, j = i[once], j[once]
        for at in range(0, len(i), 8192):
            x, y = i[at : at + 8192], j[at : at + 8192]
            good = np.einsum("ij,ij->i", u[x], u[y]) >= least
            x, y = x[good], y[good]
            both = perm[x][:, :, None] == perm[y][:, None, :]
            mine = both.any(axis=2)
            first = perm[x, mine.argmax(axis=1)]
            keep = (mine.sum(axis=1) >= shared) & (first == pivot)
            if keep.any():
                yield x[keep], y[keep]


def forest(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n nodes the least node that the pairs connect it to."""
    label = np.arange(n)
    if not pairs:
        return label
    x, y = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new[label]]
        if (new == label).all():
            return label
        label = new


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9, near: int = 12, shared: int = 1, list_size: int = 800, max_pivots: int = 8192, block: int = 1024) -> DataFrame:
    """One row per row of vectors: id, n_links, component_id and kept.

    n_links: other rows whose cosine with this one is at least `least`; component_id: the least id that
    links reach; kept: whether that is its own.  Rows without a direction (see usable) have no links, nor
    have vectors of different dimensions with each other.  Equal vectors are one entry of the index with
    a weight.  The pivots are a bounded sample (max_pivots at most, as many as make lists of about
    list_size, and fewer, or more than `near` nearest ones, where the recall asks for it; see calibrated);
    every vector is indexed.  Lists longer than `block` are worked on in pairs of blocks.
    A row without an id has component_id null and is kept.  Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    good = usable("v")
    entries = staged(rows.where(good).groupBy("v").agg(F.min("id").alias("least_id"), F.count("*").alias("w")).select(F.xxhash64("v").alias("key"), "least_id", "w", "v"), "vec-entries")
    n = entries.count()
    n_pivots = int(min(max_pivots, max(16, n * near // list_size)))
    chosen = calibrated(entries, fit_pivots(entries, n_pivots), near, shared, least)
    shares = {d: c[2] for d, c in chosen.items()}
    described = staged(nearest_pivots(entries, {d: c[:2] for d, c in chosen.items()}), "vec-lists")
    posting = described.select("key", "w", "v", "dim", "pivots", F.explode("pivots").alias("p"))
    sizes = {(r["dim"], r["p"]): r["n"] for r in posting.groupBy("dim", "p").agg(F.count("*").alias("n")).where(F.col("n") > block).collect()}
    chunks = F.create_map(*(F.lit(x) for (d, p), k in sizes.items() for x in (f"{d}/{p}", -(-k // block)))) if sizes else F.create_map().cast("map<string,int>")
    posting = posting.withColumn("chunks", F.coalesce(F.element_at(chunks, F.concat_ws("/", "dim", "p")), F.lit(1)))
    posting = posting.withColumn("c", F.pmod(F.xxhash64("key", F.lit(3)), F.col("chunks")).cast("int"))
    posting = posting.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    posting = posting.withColumn("a", F.least("c", "other").cast("int")).withColumn("b", F.greatest("c", "other").cast("int"))

    def join(group: pa.Table) -> pa.Table:
        dim, pivot, a, b = (group.column(c)[0].as_py() for c in ("dim", "p", "a", "b"))
        u = units(group.column("v"), dim)
        perm = group.column("pivots").combine_chunks().flatten().to_numpy().reshape(len(u), -1)
        key, w, c = (group.column(x).to_numpy() for x in ("key", "w", "c"))
        pairs = list(linked_in_block(u, perm, c, a, b, pivot, shares[dim], least))
        links = np.zeros(len(u), dtype=np.int64)
        for x, y in pairs:
            np.add.at(links, x, w[y])
            np.add.at(links, y, w[x])
        root = forest(len(u), pairs)
        some = links > 0
        return pa.table({"key": key[some], "links": links[some], "root": key[root[some]]})

    found = staged(posting.groupBy("dim", "p", "a", "b").applyInArrow(join, "key long, links long, root long"), "vec-links")
    comp = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    index = entries.join(links, "key", "left").join(comp.select(F.col("id").alias("key"), "comp"), "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    index = staged(index, "vec-index")
    least_of = index.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    index = index.join(least_of, "comp").select("v", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), "component_id")
    linked = rows.where(good).join(index, "v").select("id", "n_links", "component_id")
    alone = rows.where(~good).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    component = F.when(F.col("id").isNotNull(), F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
