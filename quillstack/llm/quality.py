"""Quality by perplexity: an interpolated modified Kneser-Ney model of words and pairs of words, trained on trusted text.

Counts, discounts, back-off weights and probabilities are aggregations and merge joins keyed by
(language, word) and (language, pair).  In back-off form the log-probability of a text is a sum over its
words and pairs of one value each, 0 for what the model doesn't hold:

    word x:      log p(x) - log p(unknown) + log backoff(x)
    pair (v, w): log(1 + (n - D) / (off(v) * p(w)))       off(v): what was discounted after v

and the number of symbols times log p(unknown).  So each document's perplexity comes of one join of its
words and pairs with the model, by key.  Both sides of it are sharded by key and packed: a document side
row holds the distinct keys of a block of documents that fall into a shard, and in which documents they
occur; the shard answers with one partial sum a document.  Keys are hashes that spread evenly, and a
frequent word is one key of a block, so no shard is hot.  Nothing of the model reaches the driver but a
few numbers a language.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import drop_caches, drop_scratch, lean, shuffles_dropped, small_batches, staged, staged_in_turns

#: Words, each character of scripts without spaces by itself, and runs of signs.
SCRIPTS = "฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿\U00020000-\U0003ffff"
WORD = re.compile(rf"[{SCRIPTS}]|[^\W{SCRIPTS}]+|[^\w\s]+")
#: Stands before the first word and after the last.
EDGE = 1
#: The pooled model, for languages without one of their own; a language's own model is OWN and its name.
POOLED, OWN = "*", "="
#: Languages with models of their own: at most those with most text; the others share the pooled one.
MAX_LANGUAGES = 1000
#: Bits of a key, bytes and documents of a block, model entries a shard.
KEY_BITS, BLOCK_BYTES, BLOCK_DOCS, SHARD = 48, 3_000_000, 60_000, 250_000
#: Models of this many entries and more meet their words, and the documents, in so many turns, of which each has its share of the rows on disk.
TURNS, TURN_ENTRIES = 3, 2_000_000
#: Trusted ids up to this number (8 bytes each) are broadcast; beyond it they are joined by merging.
BROADCAST_IDS = 1_000_000
#: One in so many trusted documents doesn't train, but sets the thresholds.
HELD_OUT = 5
#: Short texts scatter more: quantiles are taken in each of these classes of length (in words).
LENGTHS = (16, 64, 256)


class Words:
    """32-bit hashes of words; a bounded cache keeps them."""

    def __init__(self):
        self.cache: dict[str, int] = {}

    def of(self, text: str) -> np.ndarray:
        """EDGE, then a hash for each word, none of them 0 or EDGE."""
        words = WORD.findall(text)
        if len(self.cache) > 200_000:
            self.cache.clear()
        cache = self.cache
        out = np.empty(len(words) + 1, dtype=np.uint64)
        out[0] = EDGE
        try:
            out[1:] = np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))
        except KeyError:
            for x in set(words).difference(cache):
                cache[x] = max(2, xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) & 0xFFFFFFFF)
            out[1:] = np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))
        return out


def sequence(texts: list[str], words: Words) -> tuple[np.ndarray, np.ndarray]:
    """All texts' symbols, each text led by EDGE and one more at the end; and how many each text has, its EDGE included."""
    parts = [words.of(t) for t in texts]
    return np.concatenate([*parts, np.full(1, EDGE, np.uint64)]), np.array([len(p) for p in parts])


def pairs_of(s: np.ndarray) -> np.ndarray:
    return (s[:-1] << np.uint64(32)) | s[1:]


@lru_cache(maxsize=4096)
def model_code(name: str) -> int:
    return xxhash.xxh3_64_intdigest(name.encode("utf-8", "surrogatepass"))


def keys_of(grams: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """KEY_BITS bits for each word or pair under its model."""
    x = grams ^ codes
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return (x ^ (x >> np.uint64(32))) >> np.uint64(64 - KEY_BITS)


def packed(x: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def unpacked(b: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def blocks(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first, texts) of runs of texts within BLOCK_BYTES and BLOCK_DOCS, null as empty; a longer text is a run by itself.

    Only one run at a time is made strings of.
    """
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    first = held = 0
    for i in range(len(texts) + 1):
        if i > first and (i == len(texts) or held + size[i] > BLOCK_BYTES or i - first >= BLOCK_DOCS):
            yield first, [t or "" for t in texts.slice(first, i - first).to_pylist()]
            first, held = i, 0
        if i < len(texts):
            held += size[i]


def pair_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = 1_500_000) -> DataFrame:
    """(lang, g, n) of all pairs of texts that aren't empty, counted within tasks first, then by key over the cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches(__name__)
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        words, size = Words(), 0

        def merged(parts):
            g = np.concatenate([p[0] for p in parts])
            u, at = np.unique(g, return_inverse=True)
            return u, np.bincount(at, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                g, n = merged(parts)
                for i in range(0, len(g), 200_000):
                    k = len(g[i : i + 200_000])
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * k), pa.array(g[i : i + k].view(np.int64)), pa.array(n[i : i + k])], names=["lang", "g", "n"])
            held.clear()

        for b in batches:
            langs = b.column(0).to_pylist()
            for first, texts in blocks(b.column(1)):
                by: dict[str, list[str]] = {}
                for lang, text in zip(langs[first : first + len(texts)], texts, strict=True):
                    if text:
                        by.setdefault(lang or "", []).append(text)
                for lang, some in by.items():
                    held.setdefault(lang, []).append(np.unique(pairs_of(sequence(some, words)[0]), return_counts=True))
                    size += len(held[lang][-1][0])
                if size > most:
                    yield from flush()
                    size = 0
        yield from flush()

    got = docs.select(lang_col, text_col).mapInArrow(lean(run), "lang string, g long, n long")
    return got.groupBy("lang", "g").agg(F.sum("n").alias("n"))


def of_counts(n: str = "n") -> list[Column]:
    return [F.count_if(F.col(n) == i).alias(f"n{i}") for i in range(1, 5)]


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Of Chen and Goodman; kept within 0.05 and the count, for counts of counts of small or odd corpora."""
    n = (n1, n2, n3, n4)
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    cut = [i + 1 - (i + 2) * y * n[i + 1] / n[i] if n[i] else (i + 1) * 0.5 for i in range(3)]
    return tuple(min(max(c, 0.05), float(i + 1)) for i, c in enumerate(cut))


def discount_of(n: str) -> Column:
    return F.when(F.col(n) == 1, F.col("d1")).when(F.col(n) == 2, F.col("d2")).otherwise(F.col("d3"))


class Model:
    """The words and pairs of every model with their values, packed by shard (the first `bits` of a key), as a DataFrame; and log p(unknown) by model."""

    def __init__(self, parts: DataFrame | None, unknown: dict[str, float], bits: int, turns: int):
        self.parts, self.unknown, self.bits, self.turns = parts, unknown, bits, turns

    def drop(self) -> None:
        if self.parts is not None:
            drop_scratch(self.parts)


def of_shards(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(shard, from, to) of the runs of ascending keys that are of one shard."""
    where = keys >> np.uint64(KEY_BITS - bits)
    first = np.flatnonzero(np.append(True, where[1:] != where[:-1])) if len(keys) else np.zeros(0, np.int64)
    for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(keys)], strict=True):
        yield int(where[lo]), lo, hi


def parts_of_model(values: DataFrame, bits: int) -> DataFrame:
    """(shard, keys, counts): the keys of (l, g, value), packed, and their values as 32-bit floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            keys, values = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(keys)
            keys, values = keys[order], values[order]
            rows = [(sh, packed(np.diff(keys[lo:hi], prepend=np.uint64(0))), values[lo:hi].tobytes()) for sh, lo, hi in of_shards(keys, bits)]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["shard", "keys", "counts"])

        for b in batches:
            codes = np.array([model_code(x) for x in b.column(0).to_pylist()], dtype=np.uint64)
            held.append((keys_of(b.column(1).to_numpy().view(np.uint64), codes), b.column(2).to_numpy().astype("<f4")))
            size += b.num_rows
            if size > 400_000:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return values.select("l", "g", "value").mapInArrow(lean(run), "shard long, keys binary, counts binary")


def turn_of(turns: int, *cols: Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(turns))


def fit(trusted: DataFrame, langs: DataFrame | None = None, text_col: str = "text", lang_col: str = "lang", min_tokens: int = 20_000) -> Model:
    """Train on every text of trusted.

    Languages with at least min_tokens symbols of trusted text have a model of their own (MAX_LANGUAGES at
    most), all text makes the pooled one, which is left out if every language in langs (column lang_col;
    None: any may come) has its own.
    """
    spark = trusted.sparkSession
    pairs = staged(pair_counts(trusted, text_col, lang_col), "kn-pairs")
    own = (
        pairs.groupBy("lang").agg(F.sum("n").alias("tokens"), F.count("*").alias("types"), *of_counts())
        .where(F.col("tokens") >= min_tokens).orderBy(F.desc("tokens"), "lang").limit(MAX_LANGUAGES).collect()
    )
    stats = {OWN + r["lang"]: r for r in own}
    level2 = pairs.where(F.col("lang").isin([r["lang"] for r in own])).select(F.concat(F.lit(OWN), "lang").alias("l"), "g", "n")
    if langs is None or not langs.where(~F.coalesce(lang_col, F.lit("")).isin([r["lang"] for r in own])).isEmpty():
        pooled = staged(pairs.groupBy("g").agg(F.sum("n").alias("n")).select(F.lit(POOLED).alias("l"), "g", "n"), "kn-pooled")
        r = pooled.agg(F.sum("n").alias("tokens"), F.count("*").alias("types"), *of_counts()).first()
        if r["types"]:
            stats[POOLED] = r
        level2 = level2.unionByName(pooled)
    if not stats:
        drop_scratch(pairs)
        return Model(None, {}, 6, 1)
    cuts = spark.createDataFrame([(m, *discounts(*(r[f"n{i}"] for i in range(1, 5)))) for m, r in stats.items()], "l string, d1 double, d2 double, d3 double")
    # cuts and shares have a row a model, MAX_LANGUAGES + 1 at most
    cut = lambda pairs: pairs.join(F.broadcast(cuts), "l").withColumn("d", discount_of("n"))
    rows = cut(level2)
    before, after = F.shiftrightunsigned("g", 32), F.col("g").bitwiseAND(F.lit(0xFFFFFFFF))
    contexts = rows.groupBy("l", before.alias("x")).agg(F.sum("d").alias("off"), F.sum("n").alias("total"))
    ends = rows.groupBy("l", after.alias("x")).agg(F.count("*").alias("n"))
    # every symbol is both followed and preceded by something, so no word is lost by the join
    words = staged(contexts.join(ends.hint("merge"), ["l", "x"]), "kn-words")
    shares, unknown = [], {}
    for r in words.groupBy("l").agg(F.sum("n").alias("total"), F.count("*").alias("types"), *of_counts()).collect():
        d = discounts(*(r[f"n{i}"] for i in range(1, 5)))
        left = (d[0] * r["n1"] + d[1] * r["n2"] + d[2] * (r["types"] - r["n1"] - r["n2"])) / r["total"] / (r["types"] + 1)
        shares.append((r["l"], *d, float(r["total"]), left))
        unknown[r["l"]] = math.log(left)
    table = spark.createDataFrame(shares, "l string, d1 double, d2 double, d3 double, all double, left double")
    p = (F.col("n") - discount_of("n")) / F.col("all") + F.col("left")
    known = words.join(F.broadcast(table), "l").select("l", "x", "off", p.alias("p"), (F.log(p) - F.log("left") + F.log(F.col("off") / F.col("total"))).alias("value"))
    of_word = known.select("l", F.col("x").alias("g"), F.col("value").cast("float").alias("value"))
    # merge joins at every size: words grow with the text, and so must not be broadcast
    first = known.select("l", F.col("x").alias("v"), "off").hint("merge")
    second = known.select("l", F.col("x").alias("w"), "p").hint("merge")
    entries = sum(r["types"] for r in stats.values())  # of pairs; words are fewer
    turns = TURNS if entries >= TURN_ENTRIES else 1
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(6, (4 * n).bit_length() - 1, math.ceil(math.log2(max(1, entries) / SHARD)))

    def values(turn: int) -> DataFrame:
        # discounts are joined once more, after the first join: they need not go through its shuffle
        some = level2.select("l", "g", "n", before.alias("v"), after.alias("w")).where(turn_of(turns, F.col("w")) == turn)
        part = cut(some.join(first, ["l", "v"])).select("l", "g", "w", ((F.col("n") - F.col("d")) / F.col("off")).cast("float").alias("part"))
        of_pair = part.join(second.where(turn_of(turns, F.col("w")) == turn).hint("merge"), ["l", "w"]).select("l", "g", F.log1p(F.col("part") / F.col("p")).cast("float").alias("value"))
        return of_word.where(turn_of(turns, F.col("g")) == turn).unionByName(of_pair)

    parts = staged_in_turns((parts_of_model(values(turn), bits) for turn in range(turns)), "kn-model")
    drop_scratch(pairs)
    drop_scratch(words)
    if POOLED in stats:
        drop_scratch(pooled)
    return Model(parts, unknown, bits, turns)


#: kind 0: a part of the model (keys, values); 1: keys of a block's documents; 2: the documents of a block; 3: their partial sums.
ROW = "shard long, kind int, block long, n_docs int, keys binary, counts binary, docs binary, ids array<{0}>, langs array<string>, models array<string>, sizes array<long>, held array<boolean>"


def perplexities(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, lang, model, perplexity (null: no words, or nothing was trusted), n_coded (words) and held (see HELD_OUT), one row per row of docs."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    schema = ROW.format(kind)
    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits, unknown = model.bits, model.unknown  # what tasks are sent must not hold the model's DataFrames

    def table(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in arrow], schema=arrow)

    def parts_of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches(__name__)
        made, words = 0, Words()
        for b in batches:
            ids, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, texts in blocks(b.column(2)):
                hi = lo + len(texts)
                # the same rows get the same number if the task runs again
                block, made = TaskContext.get().partitionId() * 2**31 + made, made + 1
                models = [model_of(x, unknown) for x in langs[lo:hi]]
                s, sizes = sequence(texts, words)
                owner = np.repeat(np.arange(hi - lo), sizes)
                codes = np.array([model_code(x) for x in models], dtype=np.uint64)[owner]
                both = np.empty(2 * len(owner), dtype=np.uint64)
                both[: len(owner)], both[len(owner) :] = keys_of(pairs_of(s), codes), keys_of(s[:-1], codes)
                both <<= np.uint64(64 - KEY_BITS)
                both[: len(owner)] |= owner.astype(np.uint64)
                both[len(owner) :] |= owner.astype(np.uint64)
                del s, codes, owner
                both.sort()
                keys, at = both >> np.uint64(64 - KEY_BITS), both & np.uint64(2 ** (64 - KEY_BITS) - 1)
                new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                ends = np.append(new, len(keys))
                step = np.diff(at, prepend=np.uint64(0))
                step[new] = at[new]
                keys, counts = keys[new], np.diff(ends)
                yield table(
                    [
                        {"shard": sh, "kind": 1, "block": block, "n_docs": hi - lo, "keys": packed(np.diff(keys[x:y], prepend=np.uint64(0))), "counts": packed(counts[x:y]), "docs": packed(step[ends[x] : ends[y]])}
                        for sh, x, y in of_shards(keys, bits)
                    ]
                )
                yield table(
                    [
                        {"shard": block % (1 << bits), "kind": 2, "block": block, "n_docs": hi - lo, "ids": ids[lo:hi], "langs": langs[lo:hi], "models": models, "sizes": (sizes - 1).tolist(), "held": [is_held_out(t) for t in texts]}
                    ]
                )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts = None, []
        known = worth = None
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["shard"] != shard:
                    shard, parts, known = r["shard"], [], None
                if r["kind"] == 0:
                    parts.append((np.cumsum(unpacked(r["keys"]), dtype=np.uint64), np.frombuffer(r["counts"], dtype="<f4")))
                elif r["kind"] == 2:
                    out.append(r)
                else:
                    if known is None:
                        parts.append((np.full(1, 2**64 - 1, np.uint64), np.zeros(1, "<f4")))
                        known, worth = (np.concatenate(x) for x in zip(*parts, strict=True))
                        order = np.argsort(known, kind="stable")
                        known, worth = known[order], worth[order].astype(float)
                    asked = np.cumsum(unpacked(r["keys"]), dtype=np.uint64)
                    at = np.searchsorted(known, asked)
                    value = np.where(known[at] == asked, worth[at], 0.0)
                    counts, run = unpacked(r["counts"]).astype(np.int64), np.cumsum(unpacked(r["docs"]).astype(np.int64))
                    first = np.cumsum(counts) - counts
                    before = np.where(first > 0, run[first - 1], 0)  # steps start anew at each key
                    place = run - np.repeat(before, counts)
                    out.append({"shard": shard, "kind": 3, "block": r["block"], "n_docs": r["n_docs"], "keys": np.bincount(place, np.repeat(value, counts), r["n_docs"]).astype("<f4").tobytes()})
            if out:
                yield table(out)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: dict | None = None
        total = np.zeros(0)

        def done() -> pa.RecordBatch:
            out = []
            for z, m, size in zip(total.tolist(), head["models"], head["sizes"], strict=True):
                base = unknown.get(m)
                out.append(math.exp(min(700.0, -z / (size + 1) - base)) if size and base is not None else None)
            types = (arrow.field("ids").type.value_type, pa.string(), pa.string(), pa.float64(), pa.int64(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((head["ids"], head["langs"], head["models"], out, head["sizes"], head["held"]), types, strict=True)], names=["i", "l", "model", "perplexity", "n_coded", "held"])

        for b in batches:
            for r in b.to_pylist():
                if r["kind"] == 2:
                    if head:
                        yield done()
                    head, total = r, np.zeros(r["n_docs"])
                else:
                    total += np.frombuffer(r["keys"], dtype="<f4")
        if head:
            yield done()

    parts = docs.select(F.col(id_col), F.col(lang_col), F.col(text_col)).mapInArrow(lean(parts_of_docs), schema)
    if model.parts is not None:
        parts = parts.unionByName(model.parts.select("shard", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("block"), "keys", "counts"), allowMissingColumns=True)
    sums = parts.repartition(n, "shard").sortWithinPartitions("shard", "kind").mapInArrow(lean(answer), schema)
    got = sums.repartition(n, "block").sortWithinPartitions("block", "kind").mapInArrow(lean(summed), f"i {kind}, l string, model string, perplexity double, n_coded long, held boolean")
    return got.withColumnsRenamed({"i": id_col, "l": lang_col})


def model_of(lang: str | None, models: dict[str, float]) -> str:
    own = OWN + (lang or "")
    return own if own in models else POOLED


def is_held_out(text: str) -> bool:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % HELD_OUT == 0


def thresholds(scored: DataFrame, quantile: float, margin: float, least: int) -> dict[tuple[str | None, int], float]:
    """By (model, class of length): margin times that quantile of the documents' perplexities.

    One for each model and class of length that has at least `least` of them, one for each model (class
    -1), and one over all (None, -1): (MAX_LANGUAGES + 1) * (len(LENGTHS) + 2) + 1 numbers at most.
    Fewer documents than the quantile asks for (1 / (1 - quantile)) can't show it: there the threshold is
    no lower than the same quantile of a log-normal of their mean and deviation.
    """
    seen = F.percentile_approx("perplexity", F.lit(quantile), F.lit(10_000))
    tail = F.exp(F.avg(F.log("perplexity")) + NormalDist().inv_cdf(quantile) * F.stddev_pop(F.log("perplexity")))
    q = F.when(F.count("*") * (1 - quantile) < 1, F.greatest(seen, tail)).otherwise(seen) * margin
    known = scored.where("perplexity is not null")
    rows = known.rollup("model", "size_class").agg(q.alias("threshold"), F.count("*").alias("n"), F.grouping_id().alias("level"))
    return {(r["model"], r["size_class"] if r["level"] == 0 else -1): r["threshold"] for r in rows.collect() if r["threshold"] is not None and (r["level"] or r["n"] >= least)}


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = 0.998, margin: float = 1.03, min_tokens: int = 20_000, least: int = 200) -> DataFrame:
    """id, lang, perplexity, threshold and accepted (perplexity at most threshold), one row per row of docs.

    labels: (id, quality); rows of quality 1 name the trusted documents.  All of them are read: one in
    HELD_OUT (by its text) sets the thresholds (that quantile of their perplexities by language and class
    of length, times margin; see thresholds), the others train.  Texts without words have no perplexity
    and are accepted, as is everything when nothing is trusted; a language with little trusted text goes
    by the pooled model and, where nobody set one, by the threshold of all.  Labels that repeat or
    contradict each other: a document is trusted if any of its labels says so.  Repeated rows stay as
    they are; a row without an id is never trusted; other columns are not read.
    """
    ids = labels.where("quality = 1").select(F.col(id_col)).where(F.col(id_col).isNotNull()).distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("merge")
    held = F.coalesce(F.crc32(F.col(text_col).cast("binary")) % HELD_OUT == 0, F.lit(False))
    size_class = sum((F.col("n_coded") >= n).cast("int") for n in LENGTHS)
    with small_batches(docs.sparkSession), shuffles_dropped(docs.sparkSession):
        model = fit(docs.where(~held).select(id_col, lang_col, text_col).join(ids, id_col, "left_semi"), docs, text_col, lang_col, min_tokens)
        turn = turn_of(model.turns, F.col(text_col), F.col(id_col))  # by its values, so that rows stay in their turn if a task runs again
        scored = staged_in_turns((perplexities(docs.where(turn == i) if model.turns > 1 else docs, model, id_col, text_col, lang_col).withColumn("size_class", size_class) for i in range(model.turns)), "kn-scores")
    model.drop()
    trusted = scored.join(ids, id_col, "left_semi")
    limit = thresholds(trusted.where("held"), quantile, margin, least) or thresholds(trusted, quantile, margin, least)
    of = F.create_map(*(F.lit(x) for (m, c), t in limit.items() for x in (f"{c}/{m or ''}", t))) if limit else F.create_map(F.lit(""), F.lit(0.0))
    at = lambda c, m: F.element_at(of, F.concat_ws("/", c.cast("string"), m))
    threshold = F.coalesce(at(F.col("size_class"), F.col("model")), at(F.lit(-1), F.col("model")), at(F.lit(-1), F.lit("")))
    return scored.select(id_col, lang_col, "perplexity", threshold.alias("threshold"), F.coalesce(F.col("perplexity") <= threshold, F.lit(True)).alias("accepted"))
