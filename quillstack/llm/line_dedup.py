"""Line dedup by a deletion-neighbourhood join.

Two lines within one edit share a string that one deletion (or none) makes of each.  Emitting every
deletion of every line is too much, so lines are first sieved by coarser deletions that such lines must
share as well: with one of two halves, then one of 16 equal parts left out.  What passes emits each one-character
deletion as a hashed key together with its place.  Lines equal under the same key and place differ by
one substitution at most, a line equal to another's deletion by one insertion, so the earliest line of a
key is found by an aggregation and no pairs are made.  Hits are verified by edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, merged, staged

BASE = np.uint64(0x9E3779B97F4A7C15)
LAST = 2**63 - 1  # where rows without an id stand in the order


def _powers(n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, BASE), dtype=np.uint64)])


def deletion_keys(line: str) -> tuple[int, np.ndarray]:
    """Hash of the line, and hashes of the line without its i-th character, for each i, in linear time."""
    c = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9)
    c ^= c >> np.uint64(29)
    n, pw = len(c), _powers(len(c))
    terms = c * pw[:n]
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
    # characters after i move one place down, so their sum is taken with powers one lower
    down = c[1:] * pw[: n - 1]
    after = np.concatenate([np.zeros(1, np.uint64), np.cumsum(down, dtype=np.uint64)])
    short = upto[:n] + (after[-1] - after[np.arange(n)])
    sized = lambda sums, k: (sums + np.uint64(k * 0x27D4EB2F165667C5 % 2**64)).astype(np.int64)
    return int(sized(upto[-1:], n)[0]), sized(short, n - 1)


def half_keys(line: Column) -> Column:
    """Hashes of the line with each half left out, for its own length and one less.

    With n the length, halves of n and of n - 1 characters give two beginnings and two ends, of which one
    pair is the same; so three keys are all.
    """
    n, a = F.length(line), F.floor(F.length(line) / 2).cast("int")
    begin = lambda k: F.xxhash64(F.lit(0), F.left(line, k))
    end = lambda k: F.xxhash64(F.lit(1), F.right(line, k))
    return F.array(begin(a), end(n - a), F.when(n % 2 == 0, begin(a - 1)).otherwise(end(a)))


def part_keys(line: Column, parts: int) -> Column:
    """Hashes of the line with each of `parts` equal parts left out, for its own length and one less."""
    n = F.length(line)

    def key(m: Column, j: Column) -> Column:
        return F.xxhash64(m, j, F.left(line, F.floor(j * m / parts).cast("int")), F.right(line, m - F.floor((j + 1) * m / parts).cast("int")))

    return F.transform(F.sequence(F.lit(0), F.lit(2 * parts - 1)), lambda i: key(n - i % 2, F.floor(i / 2).cast("int")))


def shared_only(lines: DataFrame, parts: int) -> DataFrame:
    """h of those lines (h, line; h distinct) that share a key of part_keys with another."""
    keys = lines.select("h", F.explode(part_keys(F.col("line"), parts)).alias("k"))
    met = keys.groupBy("k").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("k")
    return keys.join(merged(met), "k", "left_semi").select("h").distinct()


def document_key(id_col: str, text_col: str) -> tuple[Column, Column]:
    """(d, x): the id, or LAST and a hash of the text, so that rows without an id are as many documents as they have texts."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)), F.when(F.col(id_col).isNull(), F.xxhash64(text_col)).otherwise(F.lit(0).cast("long"))


def line_table(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(d, x, i, line, h): lines of at least min_chars characters once trimmed, with their document and place."""
    d, x = document_key(id_col, text_col)
    lines = docs.select(d.alias("d"), x.alias("x"), F.posexplode(F.split(F.col(text_col), "\n")).alias("i", "line"))
    return lines.select("d", "x", "i", F.trim("line").alias("line")).where(F.length("line") >= min_chars).withColumn("h", F.xxhash64("line"))


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int = 1, min_chars: int = 16, min_equal: int | None = None) -> DataFrame:
    """(d, x, i, h) of every line that has an earlier line within max_edits (0 or 1); d, x: see document_key; h: hash of the line.

    Earlier: a smaller (id, line number); rows without an id come last.  Lines are compared trimmed;
    those of fewer than min_chars characters are never within one edit of others, and of fewer than
    min_equal (min_chars if None) never duplicates.
    """
    if max_edits not in (0, 1):
        raise ValueError("max_edits is 0 or 1")
    lines = line_table(docs, id_col, text_col, min_chars if min_equal is None else min_equal)
    keys = F.when(F.length("line") >= min_chars, half_keys(F.col("line"))) if max_edits else F.lit(None).cast("array<long>")
    places = staged(lines.select("d", "x", "i", "h", keys.alias("keys")), "lines")
    first = places.groupBy("h").agg(F.min(F.struct("d", "i")).alias("p"))
    if max_edits:
        fuzzy = staged(_later_of_near(lines.where(F.length("line") >= min_chars), places), "lines-near")
        first = first.join(fuzzy, "h", "left").withColumn("near", F.coalesce("near", F.lit(False)))
    else:
        first = first.withColumn("near", F.lit(False))
    return places.select("d", "x", "i", "h").join(first, "h").where(F.col("near") | (F.struct("d", "i") != F.col("p"))).select("d", "x", "i", "h")


def _later_of_near(lines: DataFrame, places: DataFrame) -> DataFrame:
    """(h, near = true) of distinct lines whose first place comes after that of another line one edit away."""
    # k before p: the aggregation on keys needs numbers only, and first places are asked of what is left
    coarse = places.where("keys is not null").select("h", F.explode("keys").alias("k"))
    met = coarse.groupBy("k").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("k")
    left = coarse.join(merged(met), "k", "left_semi").select("h").distinct()
    some = places.select("d", "i", "h").join(left, "h", "left_semi").groupBy("h").agg(F.min(F.struct("d", "i")).alias("p")).select("h", "p.d", "p.i")
    texts = staged(lines.select("h", "d", "i", "line").join(some, ["h", "d", "i"], "left_semi").dropDuplicates(["h"]), "lines-texts")
    texts = staged(texts.join(shared_only(texts, 16), "h", "left_semi"), "lines-close")

    def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, i, h = (c.to_pylist() for c in b.columns[:3])
            for di, ii, hi, line in zip(d, i, h, b.column(3).to_pylist(), strict=True):
                whole, short = deletion_keys(line)
                keys, at = np.append(short, whole), np.append(np.arange(len(short), dtype=np.int32), np.int32(-1))
                for lo in range(0, len(keys), 50_000):
                    k = len(keys[lo : lo + 50_000])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[lo : lo + k]), pa.array(at[lo : lo + k]), pa.array(np.full(k, hi)), pa.array(np.full(k, di)), pa.array(np.full(k, ii, dtype=np.int32))], names=["k", "at", "h", "d", "i"]
                    )

    v = texts.select("d", "i", "h", "line").mapInArrow(lean(variants), "k long, at int, h long, d long, i int").withColumn("me", F.struct("d", "i", "h"))
    # of each key and place the earliest line, and of each key the earliest deletion and the line itself
    sub = v.where("at >= 0").groupBy("k", "at").agg(F.min("me").alias("e"), F.max("h").alias("x"), F.min("h").alias("y")).where("x <> y")
    full = v.where("at < 0").groupBy("k").agg(F.min("me").alias("f"))
    cut = v.where("at >= 0").groupBy("k").agg(F.min("me").alias("c"))
    both = full.join(merged(cut), "k")
    hits = (
        v.join(merged(sub), ["k", "at"]).where("me > e").select("h", F.col("e.h").alias("w"))
        .unionByName(both.where("f > c").select(F.col("f.h").alias("h"), F.col("c.h").alias("w")))
        .unionByName(v.where("at >= 0").join(merged(both), "k").where("me > f").select("h", F.col("f.h").alias("w")))
        .distinct()
    )
    t = texts.select("h", "line")
    near = hits.join(merged(t), "h").join(merged(t.select(F.col("h").alias("w"), F.col("line").alias("other"))), "w").where((F.levenshtein("line", "other", 1) >= 0))
    return near.select("h").distinct().withColumn("near", F.lit(True))


def drop_duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int = 1, min_chars: int = 16, min_equal: int | None = None, out_lines: str = "n_lines", out_removed: str = "n_removed") -> DataFrame:
    """docs with the later of duplicate lines (see duplicate_lines) taken out of the text; columns out_lines and out_removed are added.

    What is left is joined by line ends again; a text without duplicates stays as it is, null stays null
    (0 lines).  Rows with equal ids don't count as earlier than each other where line numbers are equal,
    so repeated rows stay.  Other columns are kept; those named like the added ones are replaced.
    """
    gone = duplicate_lines(docs, id_col, text_col, max_edits, min_chars, min_equal).groupBy("d", "x").agg(F.collect_list("i").alias("i"), F.collect_list("h").alias("h"))
    d, x = document_key(id_col, text_col)
    kept = docs.drop(*({out_lines, out_removed} & set(docs.columns)))
    columns = kept.columns
    joined = kept.select(F.struct(*(F.col(c) for c in columns if c != text_col)).alias("rest") if len(columns) > 1 else F.lit(True).alias("rest"), F.col(text_col).alias("t"), d.alias("d"), x.alias("x")).join(gone, ["d", "x"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, removed = b.column(1).to_pylist(), np.zeros(b.num_rows, dtype=np.int64)
            for j, (at, of) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                if at:
                    # a row of the same id may have another text, so the line counts as well as its place
                    out, lines = set(zip(at, of, strict=True)), texts[j].split("\n")
                    places = set(at)
                    left = [line for i, line in enumerate(lines) if i not in places or (i, line_hash(line)) not in out]
                    if len(left) < len(lines):
                        texts[j], removed[j] = "\n".join(left), len(lines) - len(left)
            n = pc.fill_null(pc.add(pc.count_substring(b.column(1), "\n"), 1), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), n, pa.array(removed)], names=["rest", "t", "n", "r"])

    kind = joined.schema["rest"].dataType.simpleString()
    done = joined.select("rest", "t", "i", "h").mapInArrow(lean(run), f"rest {kind}, t string, n long, r long")
    return done.select(*(F.col("t").alias(c) if c == text_col else F.col("rest")[c].alias(c) for c in columns), F.col("n").alias(out_lines), F.col("r").alias(out_removed))


def line_hash(line: str) -> int:
    """As xxhash64 of the trimmed line in Spark."""
    h = xxhash.xxh64_intdigest(line.strip(" ").encode("utf-8", "surrogatepass"), 42)
    return h - (1 << 64) if h >> 63 else h
