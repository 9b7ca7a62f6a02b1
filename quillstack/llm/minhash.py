"""Near-duplicate documents by improved consistent weighted sampling.

A document is the weighted set of its five-word shingles, weight = count times inverse document
frequency.  Frequencies are counted over all documents, exactly, for the shingles in at least a SHARE of
the documents; all rarer ones weigh the same, so that weights don't shift with the size of the corpus.
Each of BANDS * ROWS samples agrees between two documents with a chance equal to their weighted Jaccard
similarity; documents that agree on all samples of a band share a bucket.  The members of a bucket meet
in blocks of bounded size, each with its whole text, where all similarities are computed exactly and at
once, as a product of matrices; a block returns a forest of the links found, so what comes out is linear
in what goes in.  Buckets of more than one block meet in three steps (see near_duplicates), so that no
pair of bucket mates of different classes is left uncompared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, drop_caches, drop_scratch, lean, staged

WORDS_IN_SHINGLE = 5
BANDS, ROWS = 12, 3
SAMPLES = BANDS * ROWS
#: Share of the documents from which on a shingle's frequency counts; at most mean shingles a document / SHARE shingles have it.
SHARE = 1 / 500
#: Bits of the number of a cell that shingles are first counted in, cells of a row, and shingles counted at a time.
CELL_BITS, ROW_CELLS, HELD = 21, 1 << 15, 250_000
#: Documents and characters of a block, and columns of its matrix at a time.
BLOCK, BLOCK_CHARS, COLUMNS = 512, 8_000_000, 4096
#: Members of each block's largest class that meet those of other blocks first.
SPOKESMEN = 8
#: Similarities this close below the bound reach it.
ROUNDING = 1e-9
DRAWS = 1 << 16


@lru_cache(maxsize=1)
def word_characters() -> np.ndarray:
    """For each code point whether it is one of words, as \\w of regular expressions has it."""
    out = np.fromiter(map(str.isalnum, map(chr, range(0x110000))), dtype=bool, count=0x110000)
    out[ord("_")] = True
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """x with its bits mixed, in place."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(text: str) -> np.ndarray:
    """One hash for each word, in order: the sum of hashes of its characters, each with its place in the word; no word is kept."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    inside = word_characters()[c]
    start = np.flatnonzero(inside & ~np.append(False, inside[:-1]))
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    c, inside, start = c[start[0] :], inside[start[0] :], start - start[0]
    place = np.arange(len(c)) - np.repeat(start, np.diff(start, append=len(c)))
    x = (place.astype(np.uint64) << np.uint64(21)) + c
    x += np.uint64(1)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x = mixed(x)
    x *= inside
    return mixed(np.add.reduceat(x, start))


class Shingles:
    """Hashes of a text's shingles."""

    def of(self, text: str) -> np.ndarray:
        """One hash for each run of five words, in order; a shorter text is one shingle of all its words."""
        w = word_hashes(text.lower())
        n = max(1, len(w) - WORDS_IN_SHINGLE + 1) if len(w) else 0
        s = np.zeros(n, dtype=np.uint64)
        for k in range(min(WORDS_IN_SHINGLE, len(w))):
            s *= np.uint64(0x9E3779B97F4A7C15)
            s += w[k : k + n]
            s ^= s >> np.uint64(31)
        return s * np.uint64(0xD6E8FEB86659FD93)

    def weighted(self, text: str, idf: Frequencies) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles, ascending, and their weights."""
        s, n = np.unique(self.of(text), return_counts=True)
        return s, n * idf.of(s)

    def layers(self, text: str, idf: Frequencies) -> tuple[np.ndarray, np.ndarray]:
        """The weighted set as a plain one: a shingle that occurs n times as n members of the weight of one."""
        s, n = np.unique(self.of(text), return_counts=True)
        w = idf.of(s)
        if len(s) and n.max() > 1:
            layer = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            return np.repeat(s, n) ^ (layer.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)), np.repeat(w, n)
        return s, w


@lru_cache(maxsize=1)
def shingles() -> Shingles:
    return Shingles()


class Frequencies:
    """Inverse document frequencies: those of frequent shingles, and one for all others."""

    def __init__(self, shingle: np.ndarray, df: np.ndarray, n_docs: int):
        order = np.argsort(shingle)
        self.shingle = shingle[order]
        most = math.log(min(1 / SHARE, max(1.0, (1 + n_docs) / 2))) + 1
        self.idf = np.append(np.minimum(np.log((1 + n_docs) / (1 + df[order])) + 1, most), most)

    def of(self, s: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.shingle, s)
        known = at < len(self.shingle)
        known[known] = self.shingle[at[known]] == s[known]
        return self.idf[np.where(known, at, -1)]


def distinct(s: np.ndarray) -> np.ndarray:
    """As np.unique, which hashes integers and takes several times as long."""
    s = np.sort(s)
    return s[np.append(True, s[1:] != s[:-1])] if len(s) else s


def held_shingles(batches: Iterator[pa.RecordBatch], some: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, int]]:
    """The distinct shingles (of some cells) of each document that has text, those of some documents at a time, and how many documents these are."""
    sh, held, size = shingles(), [], 0
    for b in batches:
        for t in b.column(0).to_pylist():
            if t:
                s = sh.of(t)
                held.append(distinct(s if some is None else s[some[cells_of(s)]]))
                size += len(held[-1])
                if size >= HELD:
                    yield np.concatenate(held), len(held)
                    held, size = [], 0
    if held:
        yield np.concatenate(held), len(held)


def cells_of(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def cell_counts(texts: DataFrame) -> DataFrame:
    """(k, n): the k-th ROW_CELLS cells, and for each of them the documents of its shingles, summed, as bytes; k = -1: all documents."""
    import zstandard

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches(__name__)
        total, docs = np.zeros(1 << CELL_BITS, dtype=np.int32), 0
        for s, k in held_shingles(batches):
            cell, n = np.unique(cells_of(s), return_counts=True)
            total[cell] += n.astype(np.int32)
            docs += k
        z = zstandard.ZstdCompressor(level=1)
        parts = [(-1, np.array([docs], dtype=np.int32)), *((k, part) for k, part in enumerate(total.reshape(-1, ROW_CELLS)) if part.any())] if docs else []
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int64()), pa.array([z.compress(x.tobytes()) for _, x in parts], pa.binary())], names=["k", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, key, total = zstandard.ZstdDecompressor(), None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([total.tobytes()], pa.binary())], names=["k", "n"])

        for b in batches:
            for k, n in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                n = np.frombuffer(z.decompress(n.as_py()), dtype=np.int32).astype(np.int64)
                if k == key:
                    total = total + n
                else:
                    if key is not None:
                        yield done()
                    key, total = k, n
        if key is not None:
            yield done()

    # no number of partitions is given: by size they are few, and so are files, for each of which an executor starts chmod
    return texts.mapInArrow(lean(count), "k long, n binary").repartition("k").sortWithinPartitions("k").mapInArrow(lean(add), "k long, n binary")


def document_frequencies(docs: DataFrame, text_col: str = "text") -> Frequencies:
    """Frequencies over all documents that have text; exact for every shingle that weighs less than the rarest.

    Shingles are first counted in cells by their hash, of a number that doesn't grow; a cell's count is no
    less than that of any shingle in it, so only the shingles of cells that reach the bound can.  These
    are then counted one by one.  Neither depends on how the documents are dealt out.
    """
    texts = docs.select(text_col)
    cells = staged(cell_counts(texts), "mh-cells")
    got = cells.where("k = -1").select("n").first()
    n_docs = int(np.frombuffer(got["n"], dtype=np.int64)[0]) if got else 0
    bound = max(2.0, SHARE * (1 + n_docs))  # of 1 + df: at or under it a shingle weighs as the rarest do

    def above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, n in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(k * ROW_CELLS + np.flatnonzero(1 + np.frombuffer(n.as_py(), dtype=np.int64) > bound))], names=["cell"])

    some = np.zeros(1 << CELL_BITS, dtype=bool)
    some[cells.where("k >= 0").mapInArrow(lean(above), "cell long").toArrow()["cell"].to_numpy()] = True
    drop_scratch(cells)
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(some))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = np.unpackbits(shared.value).astype(bool)
        for s, _ in held_shingles(batches, some):
            s, n = np.unique(s, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(n)], names=["s", "n"])

    counts = texts.mapInArrow(lean(count), "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))
    got = counts.where(1 + F.col("n") > bound).toArrow()  # see SHARE for how many there are
    return Frequencies(got["s"].to_numpy().view(np.uint64), got["n"].to_numpy(), n_docs)


@lru_cache(maxsize=1)
def draws() -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each sample DRAWS triples: r ~ Gamma(2, 1), its share beta ~ U(0, 1), and ln c with c ~ Gamma(2, 1)."""
    r = np.random.default_rng(20)
    return [(r.gamma(2, 1, DRAWS).astype(np.float32) + np.float32(1e-6), r.random(DRAWS).astype(np.float32), np.log(r.gamma(2, 1, DRAWS) + 1e-9).astype(np.float32)) for _ in range(SAMPLES)]


def sample(s: np.ndarray, w: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The samples of many sets, one row each: a hash of the shingle drawn and of its level.

    s, w: the sets' shingles and weights, one set after the other; starts: where each begins.
    """
    lw = np.log(w).astype(np.float32)
    size = np.diff(np.append(starts, len(s)))
    out = np.empty((len(starts), SAMPLES), dtype=np.uint64)
    for h, (r, beta, lc) in enumerate(draws()):
        at = ((s * np.uint64(2 * (h * 0x9E3779B97F4A7C15 % 2**63) + 1)) >> np.uint64(48)).astype(np.int64)
        rr, bb = r[at], beta[at]
        t = np.floor(lw / rr + bb)
        la = lc[at] - rr * (t - bb + 1)
        low = np.minimum.reduceat(la, starts)
        hit = np.flatnonzero(la == np.repeat(low, size))
        owner = np.searchsorted(starts, hit, side="right") - 1
        first = hit[np.append(True, owner[1:] != owner[:-1])]  # ties go to the least shingle
        out[:, h] = s[first] ^ ((t[first].astype(np.int64) + 1000).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    return out


def signatures(docs: DataFrame, idf: Frequencies, id_col: str, text_col: str, batch_words: int = 150_000) -> DataFrame:
    """(id, x, y, n, bands array<long>): x, y, n identify the text; texts without words have no row."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sh, idf = shingles(), shared.value
        for b in batches:
            held: list[tuple[int, np.ndarray, np.ndarray]] = []
            total = 0
            for i, t in enumerate([*b.column(4).to_pylist(), None]):
                if held and (total > batch_words or i == b.num_rows):
                    sets = [h[1] for h in held]
                    starts = np.concatenate([[0], np.cumsum([len(x) for x in sets])[:-1]]).astype(np.int64)
                    sig = sample(np.concatenate(sets), np.concatenate([h[2] for h in held]), starts)
                    bands = sig.reshape(len(sig), BANDS, ROWS)
                    key = np.zeros((len(sig), BANDS), dtype=np.uint64)
                    for k in range(ROWS):
                        key = (key ^ bands[:, :, k]) * np.uint64(0x9FB21C651E98DF25)
                        key ^= key >> np.uint64(28)
                    at = pa.array([h[0] for h in held])
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1, dtype=np.int32) * BANDS), pa.array(key.astype(np.int64).ravel()))
                    yield pa.RecordBatch.from_arrays([*(c.take(at) for c in b.columns[:4]), lists], names=["id", "x", "y", "n", "bands"])
                    held, total = [], 0
                if t:
                    s, w = sh.weighted(t, idf)
                    if len(s):
                        held.append((i, s, w))
                        total += len(s)

    t = F.col(text_col)
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(t).alias("x"), F.xxhash64(t, F.lit(77)).alias("y"), F.length(t).alias("n"), t.alias("t"))
    return rows.mapInArrow(lean(run), "id long, x long, y long, n int, bands array<long>")


def similarity(sh: Shingles, a: str, b: str, idf: Frequencies) -> float:
    """Weighted Jaccard similarity of two texts; 0 if either has no words."""
    (s, v), (t, w) = sh.weighted(a, idf), sh.weighted(b, idf)
    both, i, j = np.intersect1d(s, t, assume_unique=True, return_indices=True)
    low = np.minimum(v[i], w[j]).sum()
    top = v.sum() + w.sum() - low
    return float(low / top) if top else 0.0


def similarities(texts: list[str], idf: Frequencies) -> np.ndarray:
    """Weighted Jaccard similarities of all texts with each other, exactly (the diagonal says nothing)."""
    sets = [shingles().layers(t, idf) for t in texts]
    total = np.array([w.sum() for _, w in sets])
    member, weight = (np.concatenate(x) for x in zip(*sets, strict=True))
    owner = np.repeat(np.arange(len(texts)), [len(s) for s, _ in sets])
    _, column, n = np.unique(member, return_inverse=True, return_counts=True)
    shared = n > 1  # what one text alone has weighs in its total only
    number = np.cumsum(shared) - 1
    some = shared[column]
    owner, column, root = owner[some], number[column[some]], np.sqrt(weight[some])
    order = np.argsort(column, kind="stable")
    owner, column, root = owner[order], column[order], root[order]
    low = np.zeros((len(texts), len(texts)))
    for first in range(0, int(shared.sum()), COLUMNS):
        lo, hi = np.searchsorted(column, [first, first + COLUMNS])
        m = np.zeros((len(texts), min(COLUMNS, int(shared.sum()) - first)))
        m[owner[lo:hi], column[lo:hi] - first] = root[lo:hi]
        low += m @ m.T
    top = total[:, None] + total[None, :] - low
    return np.divide(low, top, out=np.zeros_like(low), where=top > 0)


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what a symmetric relation connects, one less than the members of each component."""
    new, out = np.ones(len(near), dtype=bool), []
    for start in range(len(near)):
        if new[start]:
            new[start] = False
            todo = [start]
            while todo:
                u = todo.pop()
                found = np.flatnonzero(near[u] & new)
                new[found] = False
                out += [(u, v) for v in found.tolist()]
                todo += found.tolist()
    return out


def packed_texts(rows: DataFrame) -> DataFrame:
    """(id, t) with the text compressed, as it goes through shuffles."""
    import zstandard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([z.compress((t or "").encode("utf-8", "surrogatepass")) for t in b.column(1).to_pylist()], pa.binary())], names=["id", "t"])

    return rows.select("id", "t").mapInArrow(lean(run), "id long, t binary")


def linked(blocks: DataFrame, texts: DataFrame, idf: Frequencies, least: float) -> DataFrame:
    """(a, b), distinct: links that connect the members of each block as far as they are similar.

    blocks: (bucket, a, b, id, comp), a block being (bucket, a, b); members of one comp aren't compared.
    """
    shared = blocks.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z, idf = zstandard.ZstdDecompressor(), shared.value

        def done(block: list[tuple]) -> list[tuple[int, int]]:
            ids, comp = [r[3] for r in block], np.array([r[4] for r in block])
            if len(block) < 2 or (comp == comp[0]).all():
                return []
            near = similarities([z.decompress(r[5]).decode("utf-8", "surrogatepass") for r in block], idf) >= least - ROUNDING
            near &= comp[:, None] != comp[None, :]
            return [(min(ids[i], ids[j]), max(ids[i], ids[j])) for i, j in forest(near)]

        def table(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

        key, block, out = None, [], []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r[:3] != key:
                    out += done(block)
                    key, block = r[:3], []
                block.append(r)
            if out:
                yield table(out)
                out = []
        if out := done(block):
            yield table(out)

    n = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # merge joins at every size: what they join grows with the documents, and so must not be broadcast
    rows = blocks.join(texts.hint("merge"), "id").select("bucket", "a", "b", "id", "comp", "t")
    return rows.repartition(n, "bucket", "a", "b").sortWithinPartitions("bucket", "a", "b", "id").mapInArrow(lean(run), "a long, b long").distinct()


def part_of(parts: Column, salt: int = 5) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(salt)), parts).cast("int")


def across(members: DataFrame) -> DataFrame:
    """Blocks in which all members of different classes of a bucket meet.

    The bucket's largest class meets the rest, and the rest itself; so its own members are never sent to
    each other.  members: (bucket, id, n, comp).
    """
    sizes = members.groupBy("bucket", "comp").agg(F.count("*").alias("k"))
    top = sizes.groupBy("bucket").agg(F.max_by("comp", F.struct("k", "comp")).alias("top"), F.count("*").alias("classes")).where("classes > 1")
    rows = members.join(top, "bucket").withColumn("main", F.col("comp") == F.col("top"))
    parts = rows.groupBy("bucket").agg(*(F.greatest(F.lit(1), F.ceil(2 * F.count_if(c) / BLOCK), F.ceil(2 * F.sum(F.when(c, F.col("n"))) / BLOCK_CHARS)).cast("int").alias(x) for x, c in (("mains", F.col("main")), ("rests", ~F.col("main")))))
    rows = rows.join(parts, "bucket").withColumn("p", F.when(F.col("main"), part_of(F.col("mains"), 7)).otherwise(part_of(F.col("rests"), 7)))
    # parts of the largest class are numbered below 0, those of the rest from 0
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    main = rows.where("main").select("bucket", (-1 - F.col("p")).alias("a"), F.explode(upto(F.col("rests"))).alias("b"), "id", "comp")
    rest = rows.where("not main")
    with_main = rest.select("bucket", F.explode(F.transform(upto(F.col("mains")), lambda x: -1 - x)).alias("a"), F.col("p").alias("b"), "id", "comp")
    among = rest.select("bucket", "p", F.explode(upto(F.col("rests"))).alias("o"), "id", "comp").select("bucket", F.least("p", "o").alias("a"), F.greatest("p", "o").alias("b"), "id", "comp")
    return main.unionByName(with_main).unionByName(among)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """(id, class_id, kept), one row per row of docs.

    class_id: the least id of the documents connected with it by links; linked are equal texts and those
    with a weighted Jaccard similarity of at least `least` that share a bucket.  kept: id = class_id.  Null
    texts and texts without words are linked with nothing.  Rows with equal ids are one document.  A row
    without an id has class_id null and is kept.  Other columns are not read.

    Bucket mates are compared in three steps: within blocks of BLOCK, which is all for most buckets;
    between a few members of each block's largest class, which makes a group of copies one class; and
    then all of what is still of different classes, the rest against the largest class and itself.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    idf = document_frequencies(rows, "t")
    sigs = staged(signatures(rows, idf, "id", "t"), "mh-signatures")
    of_text = sigs.groupBy("x", "y", "n").agg(F.min("id").alias("rep"))
    copies = staged(sigs.select("id", "x", "y", "n").join(of_text.hint("merge"), ["x", "y", "n"]).select("id", "rep", "x").distinct(), "mh-copies")
    own = copies.where("id = rep").select("id", "x").hint("merge")
    reps = sigs.join(own, ["id", "x"], "left_semi").dropDuplicates(["id"])
    banded = staged(reps.select("id", "n", F.posexplode("bands").alias("band", "key")), "mh-bands")
    # buckets with the same members in several bands count once
    buckets = banded.groupBy("band", "key").agg(F.count("*").alias("size"), F.sum("n").alias("chars"), F.sum(F.xxhash64("id") % (1 << 50)).alias("s1"), F.sum(F.xxhash64("id", F.lit(1)) % (1 << 50)).alias("s2")).where("size > 1")
    buckets = buckets.groupBy("size", "s1", "s2").agg(F.min(F.struct("band", "key", "chars")).alias("p")).select("p.band", "p.key", F.xxhash64("size", "s1", "s2").alias("bucket"), F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("p.chars") / BLOCK_CHARS)).cast("int").alias("parts"))
    members = staged(banded.join(buckets.hint("merge"), ["band", "key"]).select("bucket", "id", "n", "parts", part_of(F.col("parts")).alias("part")), "mh-members")
    texts = staged(packed_texts(rows.join(members.select("id").distinct().hint("merge"), "id", "left_semi").dropDuplicates(["id"])), "mh-texts")
    good = staged(linked(members.select("bucket", F.col("part").alias("a"), F.col("part").alias("b"), "id", F.col("id").alias("comp")), texts, idf, least), "mh-links")
    large = members.where("parts > 1")
    if not large.isEmpty():
        for turn in range(2):
            comp = staged(components(good), "mh-classes")
            now = large.join(comp.hint("merge"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
            if turn == 0:
                few = now.groupBy("bucket", "part", "comp").agg(F.count("*").alias("k"), *(F.min(F.when(part_of(F.lit(SPOKESMEN), 9) == i, F.col("id"))).alias(f"id{i}") for i in range(SPOKESMEN)))
                few = few.groupBy("bucket", "part").agg(F.max_by(F.struct("comp", *(f"id{i}" for i in range(SPOKESMEN))), F.struct("k", "comp")).alias("c"))
                few = few.select("bucket", "c.comp", F.explode(F.array_compact(F.array(*(F.col(f"c.id{i}") for i in range(SPOKESMEN))))).alias("id"))
                parts = few.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
                few = few.join(parts, "bucket").select("bucket", part_of(F.col("parts"), 11).alias("a"), F.lit(0).alias("b"), "id", "comp")
                good = staged(good.unionByName(linked(few, texts, idf, least)), "mh-links")
            else:
                good = staged(good.unionByName(linked(across(now.select("bucket", "id", "n", "comp")), texts, idf, least)), "mh-links")
    links = copies.select(F.col("id").alias("a"), F.col("rep").alias("b")).where("a <> b")
    final = components(links.unionByName(good))
    out = rows.select("id").join(final, "id", "left").withColumn("class_id", F.coalesce("comp", "id"))
    return out.select(F.col("id").alias(id_col), "class_id", F.coalesce(F.col("id") == F.col("class_id"), F.lit(True)).alias("kept"))
