"""Benchmark decontamination by CGK embedding.

Texts are strings over words.  A random walk over a string (Chakraborty, Goldenberg, Koucký) repeats or
passes each symbol by coin flips that depend on step and symbol only, so that strings at a small edit
distance give sequences at a small Hamming distance, and a few sampled positions of the sequences agree
with a fair chance.  Walks start at every word of every document, as wide as the items; how many walks
are needed for the target recall is measured on edited copies of the items themselves.  Before the
walks, a window must hold as many words of the items' vocabulary as any match within the bound must.
What agrees is verified by the exact edit distance.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

#: Words, and each character of scripts that are written without spaces.
SCRIPTS = "฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿\U00020000-\U0003ffff"
WORD = re.compile(rf"[{SCRIPTS}]|[^\W{SCRIPTS}]+")
TUPLES = 8  # samples taken of each walk
POSITIONS = 3  # positions in a sample


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def coin(symbols: np.ndarray, step: int, walk: int) -> np.ndarray:
    """0 or 1 for each symbol, by symbol, step and walk."""
    seed = (step * 0x9E3779B97F4A7C15 + walk * 0xC2B2AE3D27D4EB4F + 0x165667B19E3779F9) % 2**64 | 1
    h = (symbols.astype(np.uint64) + np.uint64(seed >> 7)) * np.uint64(seed)
    return ((h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(63)).astype(np.int64)


@dataclass
class LengthClass:
    """Items of similar length: least and most words, most edits, vocabulary (as a mask), and the items."""

    lo: int
    hi: int
    edits: int
    items: list[int]
    mask: np.ndarray
    walks: int = 0
    recall: float = 0.0  # measured on edited copies
    exhaustive: bool = False  # every window that passes the vocabulary is verified
    keys: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)  # by sample: sorted keys and their items

    @property
    def steps(self) -> int:
        return max(POSITIONS, int(1.7 * self.lo))


class ItemIndex:
    """The items' words, length classes and sampled walks."""

    def __init__(self, items: list[tuple[int | None, str | None]], similarity: float, recall: float, min_words: int, max_walks: int):
        split = [(i, words_of(t)) for i, t in items if t]
        split = [(i, w) for i, w in split if len(w) >= min_words]
        self.ids = [i for i, _ in split]
        self.vocab = {w: k + 1 for k, w in enumerate(sorted({x for _, ws in split for x in ws}))}
        self.words = [np.array([self.vocab[x] for x in ws], dtype=np.int32) for _, ws in split]
        self.edits = [int((1 - similarity) * len(w) + 1e-9) for w in self.words]
        self.classes: list[LengthClass] = []
        order = sorted(range(len(split)), key=lambda k: len(self.words[k]))
        while order:
            lo = len(self.words[order[0]])
            some = [k for k in order if len(self.words[k]) <= lo * 1.2]
            order = order[len(some) :]
            mask = np.zeros(len(self.vocab) + 1, dtype=bool)
            for k in some:
                mask[self.words[k]] = True
            c = LengthClass(lo, max(len(self.words[k]) for k in some), max(self.edits[k] for k in some), some, mask)
            self._calibrate(c, recall, max_walks)
            self.classes.append(c)

    def _samples(self, c: LengthClass, walk: int) -> np.ndarray:
        return np.sort(np.array([np.random.default_rng([walk, t, c.lo]).choice(c.steps, POSITIONS, replace=False) for t in range(TUPLES)]), axis=1)

    def walk_keys(self, c: LengthClass, walk: int, words: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
        """Keys of each sample of one walk from each of starts.  words must go on past every walk (by zeros)."""
        at = self._samples(c, walk)
        keys = [np.full(len(starts), t + 1, dtype=np.uint64) for t in range(TUPLES)]
        p = starts.copy()
        for step in range(int(at.max()) + 1):
            s = words[p]
            for t in np.flatnonzero((at == step).any(axis=1)):
                keys[t] = (keys[t] ^ s.astype(np.uint64)) * np.uint64(0x9FB21C651E98DF25)
                keys[t] ^= keys[t] >> np.uint64(29)
            p += coin(s, step, walk)
        yield from keys

    def _calibrate(self, c: LengthClass, recall: float, max_walks: int) -> None:
        """Add walks until edited copies of the class's items (as many edits as allowed) are found again often enough."""
        r = np.random.default_rng(c.lo)
        copies, owner = [], []
        for k in [c.items[i] for i in r.permutation(len(c.items))[:40]]:
            for _ in range(10):
                w = self.words[k].tolist()
                for _ in range(self.edits[k]):
                    i, what = int(r.integers(len(w))), r.integers(4)
                    w[i : i + 1] = [] if what == 0 else [0, w[i]] if what == 1 else [0]
                copies.append(np.array([*w, *[0] * c.steps], dtype=np.int32))
                owner.append(k)
        starts = np.concatenate([[0], np.cumsum([len(x) for x in copies])[:-1]]).astype(np.int64)
        flat, owner = np.concatenate(copies), np.array(owner)
        items = np.concatenate([np.concatenate([self.words[k], np.zeros(c.steps, np.int32)]) for k in c.items])
        at = np.concatenate([[0], np.cumsum([len(self.words[k]) + c.steps for k in c.items])[:-1]]).astype(np.int64)
        found = np.zeros(len(copies), dtype=bool)
        while c.walks < max_walks:
            for own, other in zip(self.walk_keys(c, c.walks, items, at), self.walk_keys(c, c.walks, flat, starts), strict=True):
                order = np.argsort(own, kind="stable")
                c.keys.append((own[order], np.array(c.items)[order]))
                mine = dict(zip(c.items, own.tolist(), strict=True))
                found |= other == np.array([mine[k] for k in owner.tolist()], dtype=np.uint64)
            c.walks += 1
            c.recall = float(found.mean())
            if c.recall >= recall:
                return
        # walks alone don't find enough: leave them out and verify whatever may match
        c.exhaustive, c.keys, c.recall = True, [], 1.0

    def candidates(self, words: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(item, starts of windows) to verify.  ends: for each word the end of its document; words goes on by zeros."""
        n = len(ends)
        for c in self.classes:
            known = np.concatenate([[0], np.cumsum(c.mask[words[:n]])])
            stop = np.minimum(np.arange(n) + c.lo, ends)
            starts = np.flatnonzero(known[stop] - known[:-1] >= c.lo - c.edits)
            if c.exhaustive:
                for k in c.items:
                    yield k, starts
                continue
            for lo in range(0, len(starts), 200_000):
                some = starts[lo : lo + 200_000]
                hits: list[tuple[np.ndarray, np.ndarray]] = []
                for walk in range(c.walks):
                    for (keys, items), got in zip(c.keys[walk * TUPLES : (walk + 1) * TUPLES], self.walk_keys(c, walk, words, some), strict=True):
                        first, last = np.searchsorted(keys, got, "left"), np.searchsorted(keys, got, "right")
                        while (on := first < last).any():
                            hits.append((items[first[on]], some[on]))
                            first = first + 1
                            first[~on] = last[~on]
                if hits:
                    item, at = (np.concatenate(x) for x in zip(*hits, strict=True))
                    both = np.unique(item.astype(np.int64) * (n + 1) + at)
                    for k in np.unique(both // (n + 1)).tolist():
                        yield k, both[both // (n + 1) == k] % (n + 1)

    def verify(self, k: int, words: np.ndarray, starts: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Least edit distance of the item to any run of words near each start, inside the document; BIG where it must exceed the bound."""
        item, most = self.words[k], self.edits[k]
        n = len(item)
        inside = starts[:, None] + np.arange(n)
        w = np.where(inside < ends[starts][:, None], words[inside], 0)
        best = np.full(len(starts), 1 << 30)
        some = np.flatnonzero(np.isin(w, item).sum(axis=1) >= n - most)
        for lo in range(0, len(some), 4096):
            s = starts[some[lo : lo + 4096]]
            place = s[:, None] - most + np.arange(n + 2 * most)
            ok = (place >= begins[s][:, None]) & (place < ends[s][:, None])
            text = np.where(ok, words[np.clip(place, 0, len(words) - 1)], -1)
            d = np.zeros((len(s), text.shape[1] + 1), dtype=np.int32)
            ramp = np.arange(d.shape[1], dtype=np.int32)
            for x in item:
                t = d + 1
                t[:, 1:] = np.minimum(t[:, 1:], d[:, :-1] + (text != x))
                d = np.minimum.accumulate(t - ramp, axis=1) + ramp
            best[some[lo : lo + 4096]] = d.min(axis=1)
        return best

    def search(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """(text, item, edits) of every match found in some texts."""
        get = self.vocab.get
        split = [[get(w, 0) for w in words_of(t)] for t in texts]
        sizes = np.array([len(x) for x in split], dtype=np.int64)
        n = int(sizes.sum())
        if not n or not self.classes:
            return []
        pad = np.zeros(2 * max(max(c.steps, c.hi) for c in self.classes) + 1, dtype=np.int32)
        words = np.concatenate([np.fromiter((x for s in split for x in s), dtype=np.int32, count=n), pad])
        stop = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(texts)), sizes)
        ends, begins = stop[owner], (stop - sizes)[owner]
        found: dict[tuple[int, int], int] = {}
        for k, starts in self.candidates(words, ends):
            edits = self.verify(k, words, starts, begins, ends)
            for s, e in zip(starts[edits <= self.edits[k]].tolist(), edits[edits <= self.edits[k]].tolist(), strict=True):
                key = int(owner[s]), k
                found[key] = min(e, found.get(key, e))
        return [(t, k, e) for (t, k), e in found.items()]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = 0.8, recall: float = 0.97, min_words: int = 5, items_per_pass: int = 5000, max_walks: int = 40, batch_words: int = 300_000) -> DataFrame:
    """(id, item, n_words, edits): the pairs of a document and an item that it contains.

    A document contains an item of n words if a run of its words is within (1 - similarity) * n edits (of
    words, in lower case, punctuation aside) of the item's; edits is the least found.  Matches within the
    bound are found with a chance of `recall` at least even at the bound, exact ones always.  Items of
    a length for which max_walks walks don't reach that are looked for without walks, in every window that
    holds enough of their words.  Items of
    fewer than min_words words, and null and empty texts on either side, match nothing.  Items are sent
    to the documents items_per_pass at a time.  Repeated rows give repeated pairs; other columns are not
    read.
    """
    passes = -(-benchmark.count() // items_per_pass) or 1
    block = F.pmod(F.xxhash64(item_col, item_text_col), F.lit(passes))
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    out = None
    for turn in range(passes):
        rows = benchmark.select(F.col(item_col), F.col(item_text_col)).where(block == turn).orderBy(item_col, item_text_col).collect()
        shared = docs.sparkSession.sparkContext.broadcast(ItemIndex([(r[0], r[1]) for r in rows], similarity, recall, min_words, max_walks))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in batches:
                held: list[int] = []
                size, texts = 0, b.column(1).to_pylist()
                for i in range(len(texts) + 1):
                    if held and (size > batch_words * 6 or i == len(texts)):
                        if found := index.search([texts[j] for j in held]):
                            at = pa.array([held[t] for t, _, _ in found])
                            yield pa.RecordBatch.from_arrays(
                                [b.column(0).take(at), pa.array([index.ids[k] for _, k, _ in found], item_type), pa.array([len(index.words[k]) for _, k, _ in found], pa.int64()), pa.array([e for *_, e in found], pa.int64())],
                                names=["id", "item", "n_words", "edits"],
                            )
                        held, size = [], 0
                    if i < len(texts) and texts[i]:
                        held.append(i)
                        size += len(texts[i])

        from pyspark.sql.pandas.types import to_arrow_type

        item_type = to_arrow_type(benchmark.schema[item_col].dataType)
        got = docs.select(id_col, text_col).mapInArrow(lean(run), f"id {kind}, item {item_kind}, n_words long, edits long")
        out = got if out is None else out.unionByName(got)
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "n_words", "edits")
