"""SentencePiece encoding and decoding with the tokenizers package as backend.

The model's protobuf is parsed here, field by field; from it come the normaliser, the metaspace marker,
the unigram scores or (for a BPE model) the merges in order of score, and the byte fallback.  Since no
piece holds the marker after another character, a text falls apart before each run of markers into
words that are encoded alone: each batch's new words go through encode_batch_fast, in a task on one thread
unless TOKENIZERS_PARALLELISM says otherwise, and are kept in a bounded cache.  Parity: every new word's
ids are held against those of the sentencepiece package, and their bytes against the word's own.
"""

from __future__ import annotations

import gc
import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer, decoders, models, normalizers

from .common import drop_caches, lean

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
KEPT = 100_000  # words kept; those of the turn before are kept as well


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message; messages, strings and floats as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            if b < 128:
                return n
            shift += 7

    while at < len(data):
        tag = varint()
        if (kind := tag & 7) == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, data[at : at + size]
        at += size


class PieceModel:
    """A SentencePiece model (BPE or unigram), rebuilt from its file."""

    def __init__(self, path: str, parity: bool = True):
        with open(path, "rb") as f:
            raw = f.read()
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict[int, int | bytes] = {}
        norm: dict[int, int | bytes] = {}
        for n, v in fields(raw):
            if n == 1:
                p = dict(fields(v))
                self.pieces.append((p.get(1, b"").decode("utf-8"), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
            elif n == 2:
                trainer = dict(fields(v))
            elif n == 3:
                norm = dict(fields(v))
        self.kind, self.byte_fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
        self.prefix, self.squeeze = bool(norm.get(3, 1)), bool(norm.get(4, 1))
        self.charsmap = norm.get(2, b"")
        if trainer.get(24, 0) or not norm.get(5, 1):
            raise ValueError("markers at word ends, and models without markers, are not supported")
        if any(k == USER for *_, k in self.pieces):
            raise ValueError("models with user-defined pieces are not supported")
        if any(re.search(f"[^{MARK}]{MARK}", p) for p, _, k in self.pieces if k == NORMAL):
            raise ValueError("pieces that go on past a space are not supported")
        self.unk = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)
        self.ids = {p: i for i, (p, _, k) in enumerate(self.pieces)}
        self.backend = self._backend()
        self.normaliser = normalizers.Precompiled(self.charsmap) if self.charsmap else None
        self.bytes = [self._bytes(i) for i in range(len(self.pieces))]
        self.sizes = np.array([len(x) for x in self.bytes])
        self.words = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.odd: set[str] = set()  # words without parity, of those in the caches
        self.torn: set[str] = set()  # likewise words that their ids don't give back
        self.peer = None
        if parity:
            import sentencepiece

            self.peer = sentencepiece.SentencePieceProcessor(model_file=path)

    def _backend(self) -> Tokenizer:
        if self.kind == UNIGRAM:
            low = min(s for _, s, k in self.pieces if k == NORMAL)
            # pieces that text must not match get a score that no path can prefer
            vocab = [(p, s if k in (NORMAL, BYTE) else low - 1e6 if k != UNKNOWN else low - 10) for p, s, k in self.pieces]
            t = Tokenizer(models.Unigram(vocab, unk_id=self.unk, byte_fallback=self.byte_fallback))
        elif self.kind == BPE:
            usable = {p: s for p, s, k in self.pieces if k == NORMAL}
            merges = []
            for i, (p, s, k) in enumerate(self.pieces):
                if k == NORMAL and len(p) > 1:
                    for cut in range(1, len(p)):
                        if p[:cut] in usable and p[cut:] in usable:
                            merges.append((-s, i, self.ids[p[:cut]], self.ids[p[cut:]], p[:cut], p[cut:]))
            merges.sort()
            t = Tokenizer(
                models.BPE(vocab=dict(self.ids), merges=[(m[4], m[5]) for m in merges], unk_token=self.pieces[self.unk][0], fuse_unk=True, byte_fallback=self.byte_fallback)
            )
        else:
            raise ValueError(f"model type {self.kind} is not supported")
        t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
        return t

    def _bytes(self, i: int) -> bytes:
        p, _, k = self.pieces[i]
        if k == BYTE:
            return bytes([int(p[3:5], 16)])
        if k == UNKNOWN:
            return " ⁇ ".encode()
        return b"" if k == CONTROL else p.replace(MARK, " ").encode("utf-8")

    def marked(self, text: str) -> str:
        """The text as the model sees it: normalised, spaces as markers, a marker before it."""
        if self.normaliser:
            text = self.normaliser.normalize_str(text)
        if self.squeeze:
            text = re.sub(" +", " ", text.replace(MARK, " ")).strip(" ")
        return (MARK if self.prefix and text else "") + text.replace(" ", MARK)

    def learn(self, words: list[str]) -> None:
        """Encode words not met before, as one batch, and note those that sentencepiece encodes otherwise, and those that their ids don't give back."""
        collects = gc.isenabled()
        gc.disable()  # the many lists below are no garbage yet
        try:
            self._learn(words)
        finally:
            if collects:
                gc.enable()

    def _learn(self, words: list[str]) -> None:
        ids = [e.ids for e in self.backend.encode_batch_fast(words, add_special_tokens=False)]
        if self.peer and self.prefix:
            other = self.peer.encode([w[1:].replace(MARK, " ") if w[0] == MARK else w for w in words], num_threads=1)
            if ids != other:
                for w, x, y in zip(words, ids, other, strict=True):
                    if x != y and w[0] == MARK and w[1:] and not (self.squeeze and w[1] == MARK):
                        self.odd.add(w)
        flat = list(chain.from_iterable(ids))
        ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
        text = np.append(0, np.cumsum(self.sizes[flat]))[ends]  # where the bytes of each word end
        wanted = [w.replace(MARK, " ").encode("utf-8") for w in words]
        if b"".join(map(self.bytes.__getitem__, flat)) != b"".join(wanted) or (text != np.cumsum(np.fromiter(map(len, wanted), np.int64, len(words)))).any():
            self.torn.update(w for w, x, t in zip(words, ids, wanted, strict=True) if b"".join(map(self.bytes.__getitem__, x)) != t)
        raw, ends = np.array(flat, dtype="<i4").tobytes(), (4 * ends).tolist()
        self.cache.update(zip(words, map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[int]]:
        """The ids of each text, as the bytes of 32-bit integers, and how many of its distinct words have no parity."""
        return self.checked(texts)[:2]

    def checked(self, texts: list[str]) -> tuple[list[bytes], list[int], list[bool]]:
        """As encode(), and whether decoding the ids gives each text back.

        A text's ids are those of its words one after the other, so their bytes are the text's where each
        word's are the word's, which is looked at as it is learned; a text with other words is decoded.
        """
        if len(self.cache) > KEPT:  # the words met since the last change stay one turn longer
            self.older, self.cache = self.cache, {}
            self.odd &= self.older.keys()
            self.torn &= self.older.keys()
        split = [self.words.findall(self.marked(t)) for t in texts]
        fresh = set().union(*split).difference(self.cache)
        known = fresh & self.older.keys()
        self.cache.update((w, self.older[w]) for w in known)
        some = list(fresh - known)
        for i in range(0, len(some), 20_000):
            self.learn(some[i : i + 20_000])
        get = self.cache.__getitem__
        raw = [b"".join(map(get, words)) for words in split]
        same = [not self.torn or self.torn.isdisjoint(words) or self.gives_back(t, r) for t, words, r in zip(texts, split, raw, strict=True)]
        return raw, [len(self.odd.intersection(words)) if self.odd else 0 for words in split], same

    def gives_back(self, text: str, raw: bytes) -> bool:
        want = self.marked(text).replace(MARK, " ")
        return self.decode(np.frombuffer(raw, dtype="<i4").tolist()) == (want[1:] if self.prefix else want)

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD, ids outside the vocabulary raise."""
        text = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def _pieces_of(batch: list[str], most: int) -> Iterator[list[str]]:
    some: list[str] = []
    held = 0
    for t in batch:
        some.append(t)
        held += len(t)
        if held >= most:
            yield some
            some, held = [], 0
    if some:
        yield some


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", batch_chars: int = 2_000_000) -> DataFrame:
    """One row per row of docs: the id, ids array<int>, n_tokens, round_trip, and parity_misses.

    round_trip: decoding the ids gives the text back (as normalised by the model; byte fallback makes
    this true of every text), see PieceModel.checked.  No begin or end pieces.  Null and empty texts have no ids and round_trip
    true.  parity_misses: how many distinct words of the text sentencepiece encodes otherwise (the ids are
    the backend's all the same; 0 where all agree).  No shuffle; repeated rows stay; other columns are not
    read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches(__name__)
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks fill the cores already
        m = model(path)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            at = 0
            for some in _pieces_of(texts, batch_chars):
                raw, misses, same = m.checked(some)
                sizes = np.fromiter((len(r) // 4 for r in raw), np.int64, len(raw))
                flat = np.frombuffer(b"".join(raw), dtype="<i4")
                ends = np.concatenate([[0], np.cumsum(sizes)])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(some)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat)), pa.array(sizes), pa.array(same, pa.bool_()), pa.array(misses, pa.int32())],
                    names=[id_col, "ids", "n_tokens", "round_trip", "parity_misses"],
                )
                at += len(some)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(lean(run), f"`{id_col}` {kind}, ids array<int>, n_tokens long, round_trip boolean, parity_misses int")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row: the id and the text of its ids.  Null ids give a null text, empty ones an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if i is None else m.decode(i) for i in b.column(1).to_pylist()], pa.string())], names=[id_col, "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(lean(run), f"`{id_col}` {kind}, text string")
