"""Cross-tokenizer alignment: how two vocabularies cut the same bytes, and which pairs of tokens belong together.

Side A is a byte-level BPE of the tokenizers package, side B a model of the sentencepiece package.  Both cut
space + text.  Neither has a token that goes on past a character other than white space into a space, so a
text falls apart before such spaces into chunks that both sides encode alone and that share no group of
tokens; a worker encodes and aligns each distinct chunk once and keeps it in a bounded cache.

Linked pairs are dealt out by stripes of B's ids (id modulo the number of stripes), so that a stripe's counts
fit a dense matrix (its B ids by A's vocabulary) of STRIPE_BYTES.  A first pass adds the pairs of each
block of documents up in it with np.add.at.  A second brings every stripe's counts together with the
stripe's links once more, takes row maxima for the best partners, and scores the links where they lie.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch_path, small_batches, staged
from .token_counts import byte_alphabet

#: Bytes of a stripe's matrix; characters and documents of a block; bytes of cached chunks; documents that a task adds up.
STRIPE_BYTES, BLOCK_CHARS, BLOCK_DOCS, CACHE_BYTES, SALT_DOCS = 1 << 25, 2_000_000, 60_000, 64_000_000, 500_000
#: Stripes are joined with their links in so many groups for each SALT_DOCS documents.
GROUPS = 16
#: A chunk ends before a space that follows anything but white space and that isn't trailing.
CHUNK = re.compile(r"(?:\s*+\S++)+?(?:(?= \s*+\S)|\s*+\Z)|\s++\Z")
MARK = "▁"


def vocabulary_sizes(a_path: str, b_path: str) -> tuple[int, int]:
    m = aligner(a_path, b_path)
    return len(m.bytes_a), len(m.bytes_b)


class Aligner:
    """Both vocabularies, and what is known of the chunks met so far."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the threads
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        if not plain or spec["model"].get("type", "BPE") != "BPE" or not all(t["special"] for t in spec["added_tokens"]):
            raise ValueError("side A must be a byte-level BPE without a normaliser or added tokens that are not special")
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.a.no_truncation()
        self.a.no_padding()
        byte_of = {c: i for i, c in enumerate(byte_alphabet())}
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            self.bytes_a[i] = bytes(byte_of[c] for c in piece) if all(c in byte_of for c in piece) else piece.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        if self.b.encode("a  b", out_type=str) != self.b.encode("a", out_type=str) + self.b.encode(" b", out_type=str):
            raise ValueError("side B must keep runs of spaces, and start no token before a space")
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search(rf"[^\s{MARK}]{MARK}", p) for i, p in enumerate(pieces) if not self.b.is_control(i)):
            raise ValueError("side B must have no piece that goes on past a space")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.len_a, self.len_b = (np.array([len(x) for x in side], dtype=np.int64) for side in (self.bytes_a, self.bytes_b))
        wide = max(len(self.bytes_a), len(self.bytes_b))
        self.wide, self.said = wide, [f"{i}{sep}" for sep in ("", ",", "|", ";") for i in range(wide)]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.texts: list[str] = []  # of each chunk its groups
        self.uses = np.zeros(0, dtype=np.int64)  # since the last time that some were forgotten
        self.stats = np.zeros((0, 5), dtype=np.int64)  # n_a, n_b, n_groups, n_links, sound
        self.starts, self.links = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.held = 0

    def forget_rare(self) -> None:
        """Keep the chunks that were met most, as far as they take half of the cache."""
        kept = np.argsort(-self.uses, kind="stable")
        kept = np.sort(kept[: len(kept) // 3][self.uses[kept[: len(kept) // 3]] > 1])
        chunks, texts, stats, starts, links = list(self.known), self.texts, self.stats, self.starts, self.links
        self.forget()
        size = stats[kept, 3]
        if 8 * int(size.sum()) > CACHE_BYTES // 2:
            return
        self.known = {chunks[i]: n for n, i in enumerate(kept.tolist())}
        self.texts, self.stats = [texts[i] for i in kept.tolist()], stats[kept]
        self.starts = np.cumsum(size) - size
        self.links = links[np.repeat(starts[kept] - self.starts, size) + np.arange(int(size.sum()))]
        self.uses = np.zeros(len(kept), dtype=np.int64)
        self.held = 8 * len(self.links) + sum(map(len, self.texts)) + sum(2 * len(c) for c in self.known) + 250 * len(kept)

    @staticmethod
    def _sound(flat: list[int], ids: np.ndarray, n: np.ndarray, table: list[bytes], widths: np.ndarray, raw: list[bytes], size: np.ndarray) -> np.ndarray:
        """Which chunks' tokens join to their bytes."""
        joined = b"".join(map(table.__getitem__, flat))
        ends = np.cumsum(n)
        total = np.concatenate([[0], np.cumsum(widths[ids])])
        if joined == b"".join(raw) and (total[ends] - total[ends - n] == size).all():
            return np.ones(len(raw), dtype=bool)
        return np.array([joined[total[e - k] : total[e]] == r for e, k, r in zip(ends, n, raw, strict=True)], dtype=bool)

    def learn(self, chunks: list[str]) -> None:
        """Encode and align chunks, each of which starts with a space."""
        a = [e.ids for e in self.a.encode_batch_fast(chunks, add_special_tokens=False)]
        b = self.b.encode([c[1:] for c in chunks], num_threads=1)
        raw = [c.encode("utf-8") for c in chunks]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        n_a, n_b = (np.fromiter(map(len, side), np.int64, len(side)) for side in (a, b))
        flat_a, flat_b = (list(chain.from_iterable(side)) for side in (a, b))
        ids_a, ids_b = np.array(flat_a, dtype=np.int64), np.array(flat_b, dtype=np.int64)
        sound = self._sound(flat_a, ids_a, n_a, self.bytes_a, self.len_a, raw, size) & self._sound(flat_b, ids_b, n_b, self.bytes_b, self.len_b, raw, size)
        good = np.flatnonzero(sound)
        if len(good) < len(sound):
            ids_a, ids_b, n_a, n_b = ids_a[np.repeat(sound, n_a)], ids_b[np.repeat(sound, n_b)], n_a[good], n_b[good]
        # chunks lie one after the other, and each ends where tokens of both sides end
        last = np.cumsum(size[good]) - 1  # each chunk's last byte
        in_a, in_b = (np.zeros(int(last[-1]) + 1 if len(last) else 0, dtype=bool) for _ in range(2))
        ends_a, ends_b = np.cumsum(self.len_a[ids_a]) - 1, np.cumsum(self.len_b[ids_b]) - 1
        in_a[ends_a], in_b[ends_b] = True, True
        cut = np.flatnonzero(in_a | in_b)
        # what two cuts enclose belongs to one token of either side: every linked pair once
        token_a, token_b = (np.cumsum(x, dtype=np.int64) - x for x in (in_a, in_b))  # of each byte, the token that it ends or lies in
        links = ids_b[token_b[cut]] * len(self.bytes_a) + ids_a[token_a[cut]]
        before = lambda x: np.cumsum(x, dtype=np.int64)
        both = before(in_a & in_b)
        n_links, n_groups = (np.diff(x[last], prepend=0) for x in (before(in_a | in_b), both))
        said = self._groups(ids_a, ids_b, (both - (in_a & in_b))[ends_a], (both - (in_a & in_b))[ends_b], n_a, n_b)
        stats = np.zeros((len(chunks), 5), dtype=np.int64)
        stats[good] = np.stack([n_a, n_b, n_groups, n_links, np.ones_like(n_a)], axis=1)
        texts = [""] * len(chunks)
        for i, s in zip(good.tolist(), said, strict=True):
            texts[i] = s
        base = len(self.texts)
        self.known.update(zip(chunks, range(base, base + len(chunks)), strict=True))
        self.texts += texts
        self.starts = np.concatenate([self.starts, len(self.links) + np.cumsum(stats[:, 3]) - stats[:, 3]])
        self.stats, self.links = np.concatenate([self.stats, stats]), np.concatenate([self.links, links])
        self.held += 8 * len(links) + sum(map(len, texts)) + 2 * int(size.sum()) + 250 * len(chunks)

    def _groups(self, ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> list[str]:
        """a1,a2|b1;a3|b2 of each chunk."""
        at = np.concatenate([group_a * 2, group_b * 2 + 1])
        order = np.argsort(at, kind="stable")
        ids, at = np.concatenate([ids_a, ids_b])[order], at[order]
        then = np.append(at[1:], -1)
        sep = np.where(then == at, 1, np.where(then == at + 1, np.where(at % 2 == 0, 2, 3), 3))
        ends = np.cumsum(n_a + n_b)
        sep[ends - 1] = 0
        parts = list(map(self.said.__getitem__, (sep * self.wide + ids).tolist()))
        return ["".join(parts[e - n : e]) for e, n in zip(ends.tolist(), (n_a + n_b).tolist(), strict=True)]

    def block(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of each text (n_a, n_b, n_groups, n_links) and the digest of its groups; of all, distinct (document, link) with their counts."""
        if self.held > CACHE_BYTES:
            self.forget_rare()
        split = [CHUNK.findall(f" {t}") if t else [] for t in texts]
        fresh = list(set().union(*split).difference(self.known))
        for i in range(0, len(fresh), 20_000):
            self.learn(fresh[i : i + 20_000])
        get, said = self.known.__getitem__, self.texts.__getitem__
        n = np.array([len(s) for s in split], dtype=np.int64)
        owner = np.repeat(np.arange(len(texts)), n)
        chunk = np.fromiter((get(c) for s in split for c in s), np.int64, int(n.sum()))
        self.uses = np.concatenate([self.uses, np.zeros(len(self.texts) - len(self.uses), dtype=np.int64)]) + np.bincount(chunk, minlength=len(self.texts))
        stats = np.zeros((len(texts), 4), dtype=np.int64)
        np.add.at(stats, owner, self.stats[chunk, :4])
        unsound = np.zeros(len(texts), dtype=bool)
        unsound[owner[self.stats[chunk, 4] == 0]] = True
        stats[unsound] = 0
        ends = np.cumsum(n).tolist()
        digests = [hashlib.sha256(";".join(map(said, chunk[e - k : e].tolist())).encode()).hexdigest() if stats[i, 0] else "" for i, (e, k) in enumerate(zip(ends, n.tolist(), strict=True))]
        keep = ~unsound[owner]
        both, times = np.unique(owner[keep] * max(1, len(self.texts)) + chunk[keep], return_counts=True)
        owner, chunk = np.divmod(both, max(1, len(self.texts)))
        size = self.stats[chunk, 3]
        place = np.repeat(self.starts[chunk] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return stats, digests, np.repeat(owner, size), self.links[place], np.repeat(times, size)


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def striped(owner: np.ndarray, link: np.ndarray, times: np.ndarray, n_docs: int, wide_a: int, wide_b: int, stripes: int) -> Iterator[tuple]:
    """(stripe, pairs, totals, sizes, places, times) as bytes: the distinct pairs of each stripe, how often the block has them, and in which documents how often (255 at most an entry)."""
    if not len(link):
        return
    rows = -(-wide_b // stripes)
    b, a = np.divmod(link, wide_a)
    pair = (b % stripes) * (rows * wide_a) + (b // stripes) * wide_a + a
    key = pair * n_docs + owner
    order = np.argsort(key)
    key, times = key[order], times[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    key, times = key[first], np.add.reduceat(times, first)
    over = (times + 254) // 255
    if (over > 1).any():
        last = np.cumsum(over) - 1
        key, rest = np.repeat(key, over), times - 255 * (over - 1)
        times = np.full(len(key), 255)
        times[last] = rest
    pair, place = np.divmod(key, n_docs)
    first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
    pairs, totals, sizes = pair[first], np.add.reduceat(times, first), np.diff(np.append(first, len(pair)))
    stripe, pairs = np.divmod(pairs, rows * wide_a)
    cut = np.flatnonzero(np.append(True, stripe[1:] != stripe[:-1]))
    places, times = place.astype("<u2"), times.astype("u1")
    pairs, totals, sizes = pairs.astype("<u4"), totals.astype("<u4"), sizes.astype("<u4")
    starts = np.append(first, len(pair))
    for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(stripe)], strict=True):
        s, e = starts[lo], starts[hi]
        yield int(stripe[lo]), pairs[lo:hi].tobytes(), totals[lo:hi].tobytes(), sizes[lo:hi].tobytes(), places[s:e].tobytes(), times[s:e].tobytes()


def _encoded(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str, stripes: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of documents and rows of links (the other kind's columns null), block after block."""
    m = aligner(a_path, b_path)
    wide_a, wide_b = len(m.bytes_a), len(m.bytes_b)
    part, n_blocks = TaskContext.get().partitionId(), 0
    ids: list[pa.Array] = []
    texts: list[str | None] = []
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal ids, texts, held, n_blocks
        block, n_blocks = (part << 24) + n_blocks, n_blocks + 1
        stats, digests, owner, link, times = m.block(texts)
        n = len(texts)
        none = [pa.nulls(n, pa.int32()), *(pa.nulls(n, pa.binary()) for _ in range(5))]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array(np.arange(n), pa.int32()), pa.concat_arrays(ids), *(pa.array(x) for x in stats.T), pa.array(digests), *none], names=names)
        kind = ids[0].type
        ids, texts, held = [], [], 0
        rows = list(striped(owner, link, times, n, wide_a, wide_b, stripes))
        del owner, link, times
        for lo in range(0, len(rows), 64):
            some = list(zip(*rows[lo : lo + 64], strict=True))
            k = len(some[0])
            none = [pa.nulls(k, pa.int32()), pa.nulls(k, kind), *(pa.nulls(k, pa.int64()) for _ in range(4)), pa.nulls(k, pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, block)), *none, pa.array(some[0], pa.int32()), *(pa.array(x, pa.binary()) for x in some[1:])], names=names)

    for b in batches:
        at = 0
        for i, t in enumerate(b.column(1).to_pylist()):
            texts.append(t)
            held += len(t or "")
            if held >= BLOCK_CHARS or len(texts) >= BLOCK_DOCS:
                ids.append(b.column(0).slice(at, i + 1 - at))
                at = i + 1
                yield from flush()
        if at < b.num_rows:
            ids.append(b.column(0).slice(at))
    if texts:
        yield from flush()


def _counted(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    """Rows (stripe, pairs, totals), sorted by stripe, to one row a stripe: its pairs, and how often all blocks have them."""
    matrix, at, met = np.zeros(cells, dtype=np.int64), None, []

    def made() -> pa.RecordBatch:
        pairs = np.unique(np.concatenate(met))
        counts = matrix[pairs]
        matrix[pairs] = 0
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([pairs.astype("<u4").tobytes()], pa.binary()), pa.array([counts.astype("<i8").tobytes()], pa.binary())], names=["stripe", "pairs", "counts"])

    for b in batches:
        for stripe, pairs, totals in zip(*(b.column(i) for i in range(3)), strict=True):
            if stripe.as_py() != at:
                if met:
                    yield made()
                at, met = stripe.as_py(), []
            p = np.frombuffer(pairs.as_buffer(), dtype="<u4")
            np.add.at(matrix, p, np.frombuffer(totals.as_buffer(), dtype="<u4").astype(np.int64))
            met.append(p)
            if sum(map(len, met)) > 4_000_000:
                met = [np.unique(np.concatenate(met))]
    if met:
        yield made()


def _scored(batches: Iterator[pa.RecordBatch], wide_a: int, cells: int) -> Iterator[pa.RecordBatch]:
    """Rows (grp, salt, stripe, block, pairs, counts, sizes, places, times), sorted, a stripe's counts (block null) before its links; to sums for each document."""
    matrix, best, at, stripe = np.zeros(cells, dtype=np.int64), np.zeros(0, dtype=np.int64), None, None
    filled = np.zeros(0, dtype=np.int64)
    sums: dict[int, np.ndarray] = {}

    def made() -> Iterator[pa.RecordBatch]:
        for block, x in sums.items():
            some = np.flatnonzero(x[1])
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array((block << 16) + some), pa.array(x[0, some]), pa.array(x[1, some])], names=["key", "n_best", "count_sum"])
        sums.clear()

    for b in batches:
        grp, salt, stripes, blocks = (b.column(i).to_pylist() for i in range(4))
        for i in range(b.num_rows):
            if (grp[i], salt[i]) != at:
                yield from made()
                at, stripe = (grp[i], salt[i]), None
            pairs = np.frombuffer(b.column(4)[i].as_buffer(), dtype="<u4")
            if blocks[i] is None:
                matrix[filled] = 0
                filled, stripe = pairs, stripes[i]
                np.add.at(matrix, pairs, np.frombuffer(b.column(5)[i].as_buffer(), dtype="<i8"))
                best = matrix.reshape(-1, wide_a).max(axis=1)
                continue
            if stripe != stripes[i]:
                raise RuntimeError("links without their stripe's counts")
            sizes = np.frombuffer(b.column(6)[i].as_buffer(), dtype="<u4")
            places, times = np.frombuffer(b.column(7)[i].as_buffer(), dtype="<u2"), np.frombuffer(b.column(8)[i].as_buffer(), dtype="u1").astype(np.int64)
            count = matrix[pairs]
            top = count == best[pairs // wide_a]
            most = int(places.max()) + 1
            x = sums.get(blocks[i])
            if x is None or x.shape[1] < most:
                wider = np.zeros((2, max(most, 64) if x is None else max(most, 2 * x.shape[1])), dtype=np.int64)
                if x is not None:
                    wider[:, : x.shape[1]] = x
                x = sums[blocks[i]] = wider
            np.add.at(x[0], places, np.where(np.repeat(top, sizes), times, 0))
            np.add.at(x[1], places, np.repeat(count, sizes) * times)
    yield from made()


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A encodes space + text, B the text, to which it adds the space itself, both without special tokens.
    Groups are what lies between byte offsets where tokens of both sides end.  Links are the pairs of an A and a B
    token that overlap; a pair of ids counts as often as such links hold it in all documents.  n_best: links
    whose count is the highest of their B id, ties included; count_sum: the counts of all links, added up.
    groups_sha256: digest of the groups as a1,a2|b1;a3|b2,b3.

    Null and empty texts, and those whose tokens don't join to space + text (texts that hold U+2581), have no
    tokens: zeros, and an empty digest.  Repeated rows and ids are documents of their own and count as such.  Other
    columns are not read; an empty table gives no rows.  Memory: a worker holds a block of documents (one at least, of
    whatever length), a stripe's matrix, and sums of SALT_DOCS documents or so.
    """
    spark = docs.sparkSession
    wide_a, wide_b = vocabulary_sizes(a_path, b_path)
    stripes = max(1, math.ceil(wide_a * wide_b * 8 / STRIPE_BYTES))
    rows = -(-wide_b // stripes)
    cells = rows * wide_a
    kind = docs.schema[id_col].dataType.simpleString()
    columns = {"block": "long", "place": "int", id_col: kind, "n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups_sha256": "string", "stripe": "int"}
    columns |= {c: "binary" for c in ("pairs", "totals", "sizes", "places", "times")}
    names = list(columns)
    path = scratch_path(spark, "alignment")
    with small_batches(spark, 2000):
        made = docs.select(id_col, text_col).mapInArrow(lambda it: _encoded(it, a_path, b_path, stripes, names), ", ".join(f"`{c}` {t}" for c, t in columns.items()))
        made.write.option("compression", "zstd").parquet(path)
    both = spark.read.schema(made.schema).parquet(path)
    documents, links = both.where("place IS NOT NULL"), both.where("stripe IS NOT NULL")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = links.select("stripe", "pairs", "totals").repartition(n, "stripe").sortWithinPartitions("stripe").mapInArrow(lambda it: _counted(it, cells), "stripe int, pairs binary, counts binary")
    counts = staged(counts, "alignment-counts")
    salts = max(1, math.ceil(documents.count() / SALT_DOCS))
    grp = (F.col("stripe") % GROUPS).alias("grp")
    nothing = F.lit(None).cast("binary")
    of_all = counts.select(grp, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "stripe", F.lit(None).cast("long").alias("block"), "pairs", "counts", nothing.alias("sizes"), nothing.alias("places"), nothing.alias("times"))
    of_each = links.select(grp, F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int").alias("salt"), "stripe", "block", "pairs", nothing.alias("counts"), "sizes", "places", "times")
    met = of_all.unionByName(of_each).repartition(max(n, GROUPS * salts), "grp", "salt").sortWithinPartitions("grp", "salt", "stripe", F.asc_nulls_first("block"))
    sums = met.mapInArrow(lambda it: _scored(it, wide_a, cells), "key long, n_best long, count_sum long").groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    key = F.shiftleft("block", 16) + F.col("place")
    out = documents.withColumn("key", key).join(sums.hint("merge"), "key", "left")
    zero = F.lit(0).cast("long")
    return out.select(id_col, "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
