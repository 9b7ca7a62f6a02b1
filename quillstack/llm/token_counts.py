"""Token counts by rank-synchronous array merging.

A batch's distinct pre-tokens are held as one ragged numpy array of symbol ids (all symbols in one flat
array, the owning sequence of each beside it).  In every round each sequence applies its own
lowest-ranked pair, all sequences at once; a sequence without a ranked pair is done, and the symbols it
has left are its token count.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Code points of Unicode's White_Space, which the vocabulary's regular expressions mean by \s.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next from 256 on."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in keep else next(rest)) for b in range(256)]


class RankedMerges:
    """Vocabulary and merge ranks of a byte-level BPE with word ends, from a tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.size = max(vocab.values()) + 1
        chars = byte_alphabet()
        self.inner = np.array([vocab[c] for c in chars], dtype=np.int64)
        self.last = np.array([vocab[c + end] for c in chars], dtype=np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], dtype=np.int64)
        made = np.array([vocab[a.removesuffix(end) + b if end and a.endswith(end) else a + b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"])) if spec["added_tokens"] else None
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.word = regex.compile(split.replace("\\s", SPACE))
        self.space = regex.compile(f"[{SPACE}]+")
        self.cache: dict[str, int] = {}

    def pretokens(self, text: str) -> list[str]:
        # one lower-case letter for each sigma: the tokenizers package lowers character by character
        t = unicodedata.normalize("NFC", text)
        return self.word.findall(self.space.sub(" ", t).replace("Σ", "σ").lower())

    def count_sequences(self, words: list[str]) -> np.ndarray:
        """Symbols left of each word once no ranked pair is left in it."""
        raw = [w.encode("utf-8") for w in words]
        lens = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        result = np.zeros(len(raw), dtype=np.int64)
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        owner = np.repeat(np.arange(len(raw)), lens)
        sym = self.inner[data]
        ends = np.cumsum(lens) - 1
        sym[ends[lens > 0]] = self.last[data[ends[lens > 0]]]
        none = np.int64(len(self.keys))
        while len(sym):
            same = owner[1:] == owner[:-1]
            key = sym[:-1] * self.size + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(same & (self.keys[at] == key), self.ranks[at], none)
            rank = np.append(rank, none)  # the last symbol starts no pair
            starts = np.flatnonzero(np.append(True, ~same))
            best = np.minimum.reduceat(rank, starts)
            size = np.diff(np.append(starts, len(sym)))
            done = best == none
            result[owner[starts[done]]] = size[done]
            best_of = np.repeat(best, size)
            hit = (rank == best_of) & (best_of != none)
            # of pairs that overlap (a a a), every second one counts, from the left
            idx = np.flatnonzero(hit)
            if len(idx):
                new_run = np.append(True, (np.diff(idx) != 1) | (owner[idx[1:]] != owner[idx[:-1]]))
                first = np.maximum.accumulate(np.where(new_run, np.arange(len(idx)), 0))
                idx = idx[(np.arange(len(idx)) - first) % 2 == 0]
            sym[idx] = self.made[rank[idx]]
            keep = np.repeat(~done, size)
            keep[idx + 1] = False
            sym, owner = sym[keep], owner[keep]
        return result

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text.  Pre-tokens are counted once a batch; a bounded cache carries them over."""
        if len(self.cache) > 400_000:
            self.cache.clear()
        parts = []
        for t in texts:
            pieces = self.special.split(t) if self.special and "<|" in t else [t]
            parts.append((len(pieces) - 1, [w for p in pieces for w in self.pretokens(p)]))
        fresh = list(set().union(*(p[1] for p in parts)).difference(self.cache))
        for i in range(0, len(fresh), 60_000):
            some = fresh[i : i + 60_000]
            self.cache.update(zip(some, self.count_sequences(some).tolist(), strict=True))
        get = self.cache.__getitem__
        return [n + sum(map(get, words)) for n, words in parts]


@lru_cache(maxsize=2)
def merges(path: str) -> RankedMerges:
    return RankedMerges(path)


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, batch_chars: int = 2_000_000) -> DataFrame:
    """One row per row of docs: the id, n_bytes (UTF-8), n_tokens, and over_limit (n_tokens > limit).

    path: a tokenizers JSON file that is installed at the same place on every executor.  Counts equal
    those of the tokenizers package without added special tokens; the vocabulary's special strings inside a text count as one
    token each, as by its default.  No shuffle; a worker holds one Arrow batch, works on batch_chars
    characters at a time, and keeps a bounded cache.  Null and empty texts have 0 bytes and tokens;
    repeated rows and ids stay as they are; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = merges(path)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n_tokens: list[int] = []
            some, held = [], 0
            for t in texts:
                some.append(t)
                held += len(t)
                if held >= batch_chars:
                    n_tokens += model.counts(some)
                    some, held = [], 0
            n_tokens += model.counts(some) if some else []
            n = np.array(n_tokens, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()), pa.array(n), pa.array(n > limit)],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
