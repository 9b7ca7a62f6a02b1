"""Repeated passages by bucket-pointer refinement of sparsely sampled suffixes.

A byte goes if a string of `length` bytes covers it that also starts elsewhere.  Every such string
(window) has one anchor, the place of the least hash among its q-grams, and equal windows have equal
anchors at equal offsets.  So suffixes are sampled at anchors, and sorted into buckets by their q-gram;
a bucket of one is finished, and so are its windows.  Anchors whose windows all cover the same bytes are
one group, settled at once; one of them stands for it in what follows.

The open buckets are refined (see refined): every offset of the bytes around their anchors gets the
identifier of its 8-gram, and identifiers of h bytes become those of 2h by sorting on the pair of an
offset's own identifier and that of the offset h later, each round reusing what the last one gave, until
a bucket is single or h reaches the windows' length.  No hash decides there: windows with one identifier
are equal byte by byte.  Buckets too large for a task are split over the cluster first (see
repeated_in_hot_buckets): by the bytes that some neighbouring windows have in common, fewer windows at a
time as long as a bucket is too large, and anchors whose windows are equal by 128-bit hash are one group again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, small_batches, staged

PIECE = 1 << 19  # window starts worked on at a time
BITS = 20  # of a place within a piece and its margin
HOT = 2048  # members from which a bucket is split over the cluster
WIDTHS = (64, 8, 1)  # neighbouring windows that are kept together when a bucket is split, time after time
SALTS = 16
SPACED = re.compile(r"\S+")
BASE = 0x9E3779B97F4A7C15
M31 = np.uint64(31)


@lru_cache(maxsize=1)
def byte_codes() -> np.ndarray:
    return np.random.default_rng(400).integers(0, 2**64, 256, dtype=np.uint64)


@lru_cache(maxsize=4)
def powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, base, dtype=np.uint64), dtype=np.uint64)])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> M31)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> M31)) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> M31)


def digests(data: bytes, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """128-bit hashes of stretches of data, as two columns."""
    d, view = xxhash.xxh3_128_digest, memoryview(data)
    flat = b"".join([d(view[a:b]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)])
    return np.frombuffer(flat, dtype="<i8").reshape(-1, 2)


def refined(data: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """For each offset of data an identifier that another has only if the same `length` bytes follow; -1 where they don't fit.

    ends: for each offset where its stretch of data ends; strings never cross stretches.  Bucket-pointer
    refinement: the first buckets are 8-grams (or `length`, if less), each round sorts what shares a
    bucket on the bucket of the offset h later.  Single buckets are left alone: no later round can change
    who they are equal to.
    """
    n = len(data)
    h = min(8, length)
    gram = np.zeros(n, dtype=np.uint64)
    for k in range(h):
        gram[: n - k] = (gram[: n - k] << np.uint64(8)) | data[k:]
    room = ends - np.arange(n)
    at = np.flatnonzero(room >= h)
    own = np.full(n, -1, dtype=np.int64)
    _, own[at] = np.unique(gram[at], return_inverse=True)
    while h < length:
        step = min(h, length - h)
        size = np.bincount(own[at], minlength=1)
        at = at[room[at] >= h + step]
        single = size[own[at]] == 1
        many = at[~single]
        _, ids = np.unique(own[many] * n + own[many + step], return_inverse=True)
        new = np.full(n, -1, dtype=np.int64)
        new[many] = ids
        new[at[single]] = ids.max(initial=-1) + 1 + np.arange(int(single.sum()))
        own, h = new, h + step
    return own


class Hashes:
    """Hashes of any run of some bytes."""

    def __init__(self, data: np.ndarray):
        self.room = 1 << max(12, int(len(data)).bit_length())
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(byte_codes()[data] * powers(BASE, self.room)[: len(data)], dtype=np.uint64)])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mixed((self.sums[hi] - self.sums[lo]) * powers(pow(BASE, -1, 2**64), self.room)[lo])


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of width values the place of its least (the first of equals, compared by all bits but BITS)."""
    key = (values & ~np.uint64((1 << BITS) - 1)) | np.arange(len(values), dtype=np.uint64)
    n = len(values) - width + 1
    block = np.concatenate([key, np.full(-len(key) % width, 2**64 - 1, dtype=np.uint64)]).reshape(-1, width)
    before = np.minimum.accumulate(block, axis=1).ravel()
    after = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(after[:n], before[width - 1 : width - 1 + n]) & np.uint64((1 << BITS) - 1)).astype(np.int64)


def anchors(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, place, back, forth, bucket, whole, whole2) of every anchor.

    Its windows start from place - back to place - forth; bucket: hash of its q-gram; whole, whole2:
    128-bit hash of all that its windows cover.
    """
    out: list[tuple[np.ndarray, ...]] = []
    pieces: list[tuple[int, int, bytes]] = []

    def flush() -> None:
        if not pieces:
            return
        flat = b"".join(p[2] for p in pieces)
        data = np.frombuffer(flat, dtype=np.uint8)
        sizes = np.array([len(p[2]) for p in pieces])
        ends = np.cumsum(sizes)
        which = np.repeat(np.arange(len(pieces)), sizes)
        h = Hashes(data)
        place = np.arange(len(data) - gram + 1)
        at = least_places(h.of(place, place + gram), length - gram + 1)
        s = np.flatnonzero(np.arange(len(at)) + length <= ends[which[: len(at)]])
        at = at[s]
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        last = np.append(first[1:] - 1, len(s) - 1)
        a, lo, hi = at[first], s[first], s[last]
        w = which[a]
        shift = (np.array([p[1] for p in pieces]) - (ends - sizes))[w]
        out.append((np.array([p[0] for p in pieces])[w], a + shift, a - lo, a - hi, h.of(a, a + gram).view(np.int64), *digests(flat, lo, hi + length).T))
        pieces.clear()

    held = 0
    for i, t in enumerate(texts):
        for lo in range(0, max(0, len(t) - length + 1), PIECE):
            piece = t[lo : lo + PIECE + length - 1]
            if held + len(piece) > PIECE + length:
                flush()
                held = 0
            pieces.append((i, lo, piece))
            held += len(piece)
    flush()
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(7))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(d, h, id, t): a document by its id and a 64-bit hash of its text, which tells rows without an id apart."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("d"), F.xxhash64(t).alias("h"), F.col(id_col).alias("id"), t.cast("binary").alias("t"))


def packed(rows: DataFrame) -> DataFrame:
    """rows with t compressed, as it goes through a shuffle."""
    import zstandard

    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([z.compress(t.as_py()) for t in b.column(3)], pa.binary())], names=["d", "h", "id", "t"])

    return rows.mapInArrow(run, f"d long, h long, id {kind}, t binary")


def unpacked(t: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(t) if t else b""


def runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive numbers."""
    cut = np.flatnonzero(np.diff(starts) != 1) + 1
    return starts[np.concatenate([[0], cut])], starts[np.concatenate([cut - 1, [len(starts) - 1]])]


def _batches_of(rows: Iterable, most: int, size) -> Iterator[list]:
    some, held = [], 0
    for r in rows:
        some.append(r)
        held += size(r)
        if held >= most:
            yield some
            some, held = [], 0
    if some:
        yield some


def anchor_table(rows: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, h = b.column(0).to_numpy(), b.column(1).to_numpy()
            at = 0
            for some in _batches_of((t.as_py() for t in b.column(2)), PIECE, len):
                w, place, back, forth, *hashes = anchors(some, length, gram)
                for lo in range(0, len(w), 200_000):
                    x = slice(lo, lo + 200_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c) for c in (d[at + w[x]], h[at + w[x]], place[x], back[x].astype(np.int16), forth[x].astype(np.int16), *(c[x] for c in hashes))],
                        names=["d", "h", "place", "back", "forth", "bucket", "whole", "whole2"],
                    )
                at += len(some)

    return rows.select("d", "h", "t").mapInArrow(run, "d long, h long, place long, back short, forth short, bucket long, whole long, whole2 long")


def contexts(docs: DataFrame, open_: DataFrame, length: int) -> DataFrame:
    """The bytes that each open anchor's windows cover."""
    lists = open_.groupBy("d", "h").agg(F.collect_list(F.struct("place", "back", "forth", "bucket", "hot", "done")).alias("anchors"))
    # repeated rows of a document have the same text, and one of them is enough
    both = docs.select("d", "h", "t").join(lists, ["d", "h"]).select("d", "h", "t", "anchors").dropDuplicates(["d", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(at, 200) for b in batches for at in range(0, b.num_rows, 200)):
            for d, h, t, some in zip(*(c.to_pylist() for c in b.columns), strict=True):
                t = unpacked(t)
                for lo in range(0, len(some), 20_000):
                    part = some[lo : lo + 20_000]
                    n = len(part)
                    cols = [[x[c] for x in part] for c in ("place", "back", "forth", "bucket", "hot", "done")]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([d] * n), pa.array([h] * n), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int16(), pa.int16(), pa.int64(), pa.bool_(), pa.bool_()), strict=True)), pa.array([t[x["place"] - x["back"] : x["place"] - x["forth"] + length] for x in part], pa.binary())],
                        names=["d", "h", "place", "back", "forth", "bucket", "hot", "done", "text"],
                    )

    return both.mapInArrow(run, "d long, h long, place long, back short, forth short, bucket long, hot boolean, done boolean, text binary")


def repeated_in_buckets(ctx: DataFrame, length: int) -> DataFrame:
    """(d, h, lo, hi) covered by windows that repeat within their bucket."""

    def solve(members: list[tuple]) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(m[-1]) for m in members])
        ends = np.cumsum(sizes)
        member = np.repeat(np.arange(len(members)), sizes)
        own = refined(np.frombuffer(b"".join(m[-1] for m in members), dtype=np.uint8), ends[member], length)
        window = np.flatnonzero(own >= 0)  # the offsets from which `length` bytes fit are the windows
        again = np.bincount(own[window])[own[window]] > 1
        at = window[again & ~np.array([m[6] for m in members])[member[window]]]
        if len(at):
            member = member[at]
            start = at - (ends - sizes)[member] + np.array([m[2] - m[3] for m in members])[member]
            far = start + member * (1 << 40)  # runs end with their member
            first, last = runs(far)
            who = first >> 40
            yield pa.RecordBatch.from_arrays(
                [pa.array([members[i][0] for i in who]), pa.array([members[i][1] for i in who]), pa.array(first & ((1 << 40) - 1)), pa.array((last & ((1 << 40) - 1)) + length)], names=["d", "h", "lo", "hi"]
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if len(held) > 1000 and r[5] != held[-1][5]:
                    yield from solve(held)
                    held = []
                held.append(r)
        if held:
            yield from solve(held)

    n = int(ctx.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = ctx.select("d", "h", "place", "back", "forth", "bucket", "done", "text").repartition(n, "bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(run, "d long, h long, lo long, hi long")


def split(ctx: DataFrame, length: int, gram: int, width: int) -> DataFrame:
    """Anchors with width neighbouring windows each, in buckets by the bytes that these have in common.

    The windows that start p to p + width - 1 bytes before an anchor, p a multiple of width, all hold the
    same stretch around it, so equal ones stay in one bucket, whichever of them an anchor has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(at, 200) for b in batches for at in range(0, b.num_rows, 200)):
            out = []
            for d, h, place, back, forth, done, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for p in range(forth // width * width, back + 1, width):
                    q = min(p + width - 1, length - gram)
                    lo, hi = max(p, forth), min(q, back)
                    windows = text[back - hi : back - lo + length]
                    out.append((d, h, place, hi, lo, xxhash.xxh3_64_intdigest(text[back - p : back - q + length], seed=p), done, *digests(windows, np.zeros(1, np.int64), np.array([len(windows)]))[0].tolist(), windows))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int16(), pa.int16(), pa.uint64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
            cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([c.view(pa.int64()) if c.type == pa.uint64() else c for c in cols], names=["d", "h", "place", "back", "forth", "bucket", "done", "whole", "whole2", "text"])

    rows = ctx.select("d", "h", "place", "back", "forth", "done", "text")
    return rows.mapInArrow(run, "d long, h long, place long, back short, forth short, bucket long, done boolean, whole long, whole2 long, text binary")


def still_open(groups: DataFrame) -> DataFrame:
    """The groups, with hot, of buckets that have several, of which one at least isn't done.  groups: (rep, bucket, done), others stay."""
    buckets = groups.groupBy("bucket").agg(F.count("*").alias("members"), F.bool_and("done").alias("all_done")).where("members > 1 and not all_done").select("bucket", "members")
    # only a bucket's size is wanted of the join, so its members are dealt over SALTS parts
    salted = buckets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    met = groups.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")).join(salted, ["bucket", "salt"])
    return met.withColumn("hot", F.col("members") > HOT).drop("salt", "members")


def windows_of(rows: DataFrame, length: int) -> DataFrame:
    return rows.select("d", "h", (F.col("place") - F.col("back")).alias("lo"), (F.col("place") - F.col("forth") + length).alias("hi"))


def repeated_in_hot_buckets(ctx: DataFrame, length: int, gram: int) -> list[DataFrame]:
    """The same, for buckets too large for a task.

    They are split by bytes that neighbouring windows have in common; anchors whose windows are all equal
    are settled, and one of them stands for them.  What then fits a task is refined there, the rest is
    split by fewer windows, in the end by one: anchors with one window are equal or in other buckets.
    """
    group, out = ["bucket", "back", "forth", "whole", "whole2"], []
    for width in (w for w in WIDTHS if w <= max(1, length - gram)):
        if ctx.isEmpty():
            break
        parts = staged(split(ctx, length, gram, width), "sa-parts")
        groups = parts.groupBy(*group).agg(F.count("*").alias("n"), F.min(F.struct("d", "h", "place")).alias("rep"), F.bool_and("done").alias("done"), F.any_value("text").alias("text"))
        groups = staged(groups, "sa-part-groups")
        out.append(windows_of(parts.where("not done").join(groups.where("n > 1").select(*group), group, "left_semi"), length))
        ctx = still_open(groups.withColumn("done", F.col("done") | (F.col("n") > 1)))
        ctx = staged(ctx.select("rep.*", "back", "forth", "bucket", (F.col("hot") & F.lit(width > 1)).alias("hot"), "done", "text"), "sa-contexts")
        out.append(repeated_in_buckets(ctx.where("not hot"), length))
        ctx = ctx.where("hot")
    return out


def repeated_regions(docs: DataFrame, rows: DataFrame, length: int, gram: int) -> DataFrame:
    """(d, h, lo, hi): stretches of documents to remove; they may overlap.  docs: packed, rows: (d, h, t)."""
    table = staged(anchor_table(rows, length, gram), "sa-anchors")
    met = table.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    shared = staged(table.join(met, "bucket", "left_semi"), "sa-shared")
    drop_scratch(table)
    group = ["bucket", "back", "forth", "whole", "whole2"]
    # one representative of each group, and how many there are
    groups = staged(shared.groupBy(*group).agg(F.count("*").alias("n"), F.min(F.struct("d", "h", "place")).alias("rep")), "sa-groups")
    open_ = still_open(groups.withColumn("done", F.col("n") > 1)).select("rep.*", "back", "forth", "bucket", "hot", "done")
    ctx = staged(contexts(docs, open_, length), "sa-contexts")
    out = windows_of(shared.join(groups.where("n > 1").select(*group), group, "left_semi"), length)
    for more in (repeated_in_buckets(ctx.where("not hot"), length), *repeated_in_hot_buckets(ctx.where("hot"), length, gram)):
        out = out.unionByName(more)
    return out


class WordHashes:
    """64-bit hashes of words as they stand between spaces; a bounded cache keeps them."""

    def __init__(self):
        self.cache: dict[str, int] = {}

    def of(self, text: str) -> np.ndarray:
        words, cache = SPACED.findall(text), self.cache
        if len(cache) > 150_000:
            cache.clear()
        for x in set(words).difference(cache):
            cache[x] = xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))


def rolled(x: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of width numbers."""
    n = len(x) - width + 1
    out = np.zeros(max(0, n), dtype=np.uint64)
    for k in range(width if n > 0 else 0):
        out = out * np.uint64(BASE) + x[k : k + n]
    return mixed(out)


def sampled_runs(texts: list[bytes], hashes: WordHashes, words: int, run: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, hash) of sampled runs of `run` words: of each stretch of `words` words the one of the least hash; some texts at a time."""
    held: list[tuple[int, np.ndarray]] = []
    size = 0
    for i, t in enumerate([*texts, None]):
        if held and (t is None or size > PIECE):
            x = np.concatenate([h for _, h in held])
            ends = np.cumsum([len(h) for _, h in held])
            number, runs, width = np.array([k for k, _ in held]), rolled(x, run), words - run + 1
            for lo in range(0, len(runs), PIECE):  # a long text in pieces that least_places can number
                part = runs[lo : lo + PIECE + width - 1]
                if len(part) < width:
                    break
                at = least_places(part, width)
                place = lo + np.arange(len(at))
                owner = np.searchsorted(ends, place, side="right")
                inside = place + words <= ends[owner]
                at, owner = at[inside], owner[inside]
                new = np.append(True, (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])) if len(at) else inside[:0]
                yield number[owner[new]], part[at[new]]
            held, size = [], 0
        if t:
            h = hashes.of(t.decode("utf-8", "surrogatepass"))
            if len(h) >= words:
                held.append((i, h))
                size += len(h)


def shared_runs(rows: DataFrame, words: int, run: int = 30) -> DataFrame:
    """(d, h, n_shared_runs): how many sampled runs of `run` words of a document another one has as well; documents without any have no row.

    Equal stretches of `words` words have the same run sampled, so every document that shares a stretch
    has one at least.  Rows are (d, h, t).
    """

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            d, h = b.column(0).to_numpy(), b.column(1).to_numpy()
            for text, g in sampled_runs(b.column(2).to_pylist(), hashes, words, run):
                yield pa.RecordBatch.from_arrays([pa.array(d[text]), pa.array(h[text]), pa.array(g.view(np.int64))], names=["d", "h", "g"])

    found = staged(rows.select("d", "h", "t").mapInArrow(sample, "d long, h long, g long"), "sa-runs")
    key = F.struct("d", "h")
    met = found.groupBy("g").agg(F.min(key).alias("a"), F.max(key).alias("b")).where("a <> b").select("g")
    return found.join(met.hint("merge"), "g", "left_semi").groupBy("d", "h").agg(F.count("*").alias("n_shared_runs"))


def merged(lo: list[int], hi: list[int]) -> list[tuple[int, int]]:
    """The maximal stretches that some stretches cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(lo, hi, strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, gram: int = 100, with_text: bool = False, passage_words: int | None = None) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256, spans (kept, the bytes left, if with_text; n_shared_runs, if passage_words), one row per row of docs.

    Texts are bytes of UTF-8 (null: empty).  A byte is removed if a string of `length` bytes covers it
    that starts anywhere else too, in its own document or another row, overlaps included; strings are
    judged on the input and never cross documents.  spans: the maximal removed stretches.  Repeated rows
    are each other's repeats.  Texts shorter than `length` stay whole.  Other columns are not read.
    n_shared_runs: runs of 30 words, sampled so that every stretch of passage_words words has one, that a
    document of another id or text holds too; nothing is removed for these alone.
    """
    if not 0 < gram <= length <= 30_000:
        raise ValueError("gram must be within length, and length within 30,000")
    rows = keyed(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    with small_batches(docs.sparkSession):
        regions = repeated_regions(packed(rows), rows, length, gram)
        shared = shared_runs(rows, passage_words) if passage_words else None
    lists = regions.groupBy("d", "h").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
    if passage_words:
        lists = lists.join(shared, ["d", "h"], "full_outer")
    else:
        lists = lists.withColumn("n_shared_runs", F.lit(0).cast("long"))
    both = packed(rows).join(lists, ["d", "h"], "left").select("id", "t", "lo", "hi", F.coalesce("n_shared_runs", F.lit(0)).alias("n_shared_runs"))
    extra = ", kept binary" if with_text else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            out = []
            for t, lo, hi in zip(*(c.to_pylist() for c in b.columns[1:4]), strict=True):
                t = unpacked(t)
                spans = merged(lo, hi) if lo else []
                ends = [0, *(x for s in spans for x in s), len(t)]
                kept = b"".join(t[ends[i] : ends[i + 1]] for i in range(0, len(ends), 2))
                out.append((len(t), len(t) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [{"lo": x, "hi": y} for x, y in spans], kept if with_text else b""))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            span = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
            arrays = [b.column(0), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), span, pa.binary()), strict=True))]
            names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
            n = 7 if with_text else 6
            yield pa.RecordBatch.from_arrays([*arrays[:n], b.column(4)], names=[*names[:n], "n_shared_runs"])

    got = both.mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<lo: long, hi: long>>{extra}, n_shared_runs long")
    if not passage_words:
        got = got.drop("n_shared_runs")
    return got.withColumnRenamed("id", id_col)
