"""Toxicity of restored texts.

Disguised words (leetspeak, letters set apart, repeated letters) are read as the output of a noisy
channel: a lattice holds, for each character, what it may stand for, and the Viterbi path under a
character model of the whole corpus is the restored text.  A logistic model over words and word
beginnings, of the text as it stands and as restored, gives the score.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

LETTERS = "abcdefghijklmnopqrstuvwxyzàáâäçèéêëíîïñóôöùúûüß"
GAP = len(LETTERS)  # anything but a letter
A = GAP + 1
#: What a character may stand for besides itself.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i", "§": "s"}
SEPARATORS = " .-_*~"
_LEET = re.escape("".join(LEET))
#: A run without spaces that holds a leet character; it is read from its start only, so that long runs take linear time.
SWAPPED_IN = re.compile(rf"(?<!\S)[^\s{_LEET}]*[{_LEET}]\S*")
PUNCTUATION = "!?.,;:)]\"'"
#: Three single letters or more, set apart by one or two separators.
SET_APART_LETTERS = re.compile(rf"(?<![\w{_LEET}])(?:[^\W_]|[{_LEET}])(?:[ .\-_*~]{{1,2}}(?:[^\W_]|[{_LEET}])){{2,}}(?![\w{_LEET}])")
LETTER = re.compile(r"[^\W\d_]")
LEET_CHAR = re.compile(rf"[{_LEET}]")
TRIPLE = re.compile(r"([^\W\d_])\1\1")
WORD = re.compile(r"[^\W\d_]+")
STEP = 64  # characters after which the likeliest path so far is settled
#: Log-probabilities of the channel: a letter as itself, as a leet character, a separator put in, one letter of a run put in.
SAME, SWAPPED, SET_APART, AGAIN = math.log(0.9), math.log(0.06), math.log(0.03), math.log(0.05)


def codes(text: str) -> np.ndarray:
    t = np.full(0x250, GAP, dtype=np.int64)
    for i, c in enumerate(LETTERS):
        t[ord(c)] = i
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return t[np.minimum(cp, 0x24F)]


class Letters:
    """Trigram model of letters and gaps: interpolated, from counts of all texts."""

    def __init__(self, counts: np.ndarray):
        c3 = counts.reshape(A, A, A).astype(np.float64)
        p1 = (c3.sum(axis=(0, 1)) + 1) / (c3.sum() + A)
        c2 = c3.sum(axis=0)
        p2 = (c2 + 10 * p1) / (c2.sum(axis=1, keepdims=True) + 10)
        self.log = np.log((c3 + 10 * p2) / (c3.sum(axis=2, keepdims=True) + 10)).tolist()
        self.code = {c: i for i, c in enumerate(LETTERS)}

    def restore(self, seen: str) -> str:
        """The likeliest text behind a lower-case stretch."""
        code, log = self.code, self.log
        paths: dict[tuple[int, int], tuple[float, str]] = {(GAP, GAP): (0.0, "")}
        before, settled = "", []
        for n, ch in enumerate(seen, 1):
            if n % STEP == 0:  # paths stay short, whatever the stretch; the state goes on
                state, (_, text) = max(paths.items(), key=lambda p: p[1])
                settled.append(text)
                paths = {state: (0.0, "")}
            # (log-probability in the channel, character restored or none)
            options = [(SAME, ch)]
            options += [(SWAPPED, x) for x in LEET.get(ch, "")]
            if ch in SEPARATORS:
                options.append((SET_APART, ""))
            if ch == before:
                options.append((AGAIN, ""))
            new: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (value, text) in paths.items():
                row = log[a][b]
                for p, x in options:
                    if x:
                        k = code.get(x, GAP)
                        state, v = (b, k), value + p + row[k]
                        # a gap that stands where a leet character could be a letter says little for a gap
                        s = text + x
                    else:
                        state, v, s = (a, b), value + p, text
                    if state not in new or v > new[state][0]:
                        new[state] = v, s
            paths = new
            before = ch
        settled.append(max((v + log[a][b][GAP], s) for (a, b), (v, s) in paths.items())[1])
        return "".join(settled)


def letter_counts(docs: DataFrame, text_col: str) -> np.ndarray:
    """Counts of letter trigrams over all texts, in tasks first; the driver gets the table of A**3 counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(A**3, dtype=np.int64)
        for b in batches:
            some, held = [], 0
            for t in [*b.column(0).to_pylist(), None]:
                if t is not None:
                    some.append(t)
                    held += len(t)
                if some and (t is None or held > 2_000_000):
                    c = codes("  " + "  ".join(some).lower() + " ")
                    n += np.bincount((c[:-2] * A + c[1:-1]) * A + c[2:], minlength=A**3)
                    some, held = [], 0
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["g", "n"])

    got = docs.select(F.coalesce(text_col, F.lit("")).alias("t")).mapInArrow(run, "g int, n long").groupBy("g").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(A**3, dtype=np.int64)
    counts[got["g"].to_numpy()] = got["n"].to_numpy()
    return counts


def without_ending(s: str) -> str:
    """s without signs at its end that aren't disguise: punctuation, and a sign three times or more."""
    while True:
        t = s.rstrip(PUNCTUATION)
        if t and not t[-1].isalnum() and t.endswith(t[-1] * 3):
            t = t.rstrip(t[-1])
        if t == s:
            return s
        s = t


def disguised(low: str, words: set[str]) -> Iterator[str]:
    """Stretches of a lower-case text that may be disguised words, and those of its words that repeat a letter; in linear time."""
    for m in SWAPPED_IN.finditer(low):
        s = without_ending(m.group())
        if LETTER.search(s) and LEET_CHAR.search(s):
            yield s
    for m in SET_APART_LETTERS.finditer(low):
        yield m.group()
    yield from (w for w in words if TRIPLE.search(w))


class Reader:
    """Words of a text, restored ones included; keeps what it has restored, within bounds."""

    def __init__(self, counts: np.ndarray):
        self.letters = Letters(counts)
        self.cache: dict[str, tuple[str, ...]] = {}

    def words(self, text: str) -> set[str]:
        low = text.lower()
        words = set(WORD.findall(low))
        out = set(words)
        for s in disguised(low, words):
            if s not in self.cache:
                if len(self.cache) > 200_000:
                    self.cache.clear()
                restored = self.letters.restore(s)
                self.cache[s] = (*WORD.findall(restored), *WORD.findall(restored.replace(" ", "")))
            out.update(self.cache[s])
        return out

    def features(self, text: str) -> set[str]:
        """Words, and their first four and five letters."""
        w = self.words(text)
        return w | {x[:4] + "-" for x in w if len(x) > 4} | {x[:5] + "-" for x in w if len(x) > 5}


_READERS: dict[str, Reader] = {}


def reader(token: str, counts: np.ndarray) -> Reader:
    if token not in _READERS:
        _READERS.clear()
        _READERS[token] = Reader(counts)
    return _READERS[token]


def logistic(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, n_features: int, l2: float = 0.05, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Bias and weights of a regularised logistic model over binary features, by Adam on all rows."""
    w, bias = np.zeros(n_features), 0.0
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    n = max(1, len(y))
    for t in range(1, rounds + 1):
        z = bias + np.bincount(rows, weights=w[cols], minlength=len(y))
        err = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        grad = np.append(np.bincount(cols, weights=err[rows], minlength=n_features) + l2 * w, err.sum()) / n
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return float(bias), w


def held_out(id_col: str):
    """Whether a row is kept from training: crc32 of its id as text leaves 0 when divided by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, counts: np.ndarray, token: str, id_col: str, text_col: str, max_rows: int, max_features: int) -> tuple[float, dict[str, float]]:
    """Bias and weights by feature, from at most max_rows labelled rows (those with the least hash of id) that aren't held out."""
    sample = (
        labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.max("toxic").alias("y"))
        .orderBy(F.xxhash64(id_col, F.lit(6)), id_col).limit(max_rows)
    )
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = reader(token, shared.value)
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                some = b.slice(lo, 200)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array([sorted(r.features(t)) for t in some.column(2).to_pylist()], pa.list_(pa.string()))], names=["h", "y", "f"])

    rows = docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("t")).join(F.broadcast(sample), id_col)  # max_rows bounds what is broadcast
    unique = rows.groupBy(F.xxhash64("t").alias("h")).agg(F.max("y").alias("y"), F.first("t").alias("t"))
    seen = staged(unique.select("h", F.col("y").cast("int").alias("y"), "t").mapInArrow(run, "h long, y int, f array<string>"), "tox-rows")
    size = seen.agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") != 1).alias("n")).first()
    if not size["p"] or not size["n"]:
        return (math.log((size["p"] + 1) / (size["n"] + 1)), {})
    single = seen.select("h", "y", F.explode("f").alias("f"))
    odds = F.log(((F.col("p") + 0.5) / (size["p"] + 1)) / ((F.col("n") + 0.5) / (size["n"] + 1)))
    doubt = 1.0 * F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("n") + 0.5))
    best = (
        single.groupBy("f").agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") != 1).alias("n")).where("p >= 5")
        .select("f", (odds - doubt).alias("o")).where("o > 1").orderBy(F.desc("o"), "f").limit(max_features)
    )
    features = [r["f"] for r in best.collect()]
    number = {f: i for i, f in enumerate(features)}
    active = single.join(F.broadcast(best.select("f")), "f").groupBy("h").agg(F.collect_list("f").alias("f"))
    data = seen.select("h", "y").join(active, "h", "left").select("y", "f").collect()
    cols = [[number[f] for f in r["f"] or [] if f in number] for r in data]
    owner = np.repeat(np.arange(len(cols)), [len(c) for c in cols])
    bias, w = logistic(owner, np.array([x for c in cols for x in c], dtype=np.int64), np.array([float(r["y"] == 1) for r in data]), len(features))
    return bias, {f: float(x) for f, x in zip(features, w, strict=True) if abs(x) > 1e-3}


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 20_000, max_features: int = 4096) -> DataFrame:
    """One row per row of docs: id, held_out, score (0 to 1; higher: likelier toxic) and predicted (score >= 0.5).

    labels: (id, toxic); rows held out (see held_out) are never learned from, of the rest at most
    max_rows.  A document is toxic if any of its labels says so.  Only the text is read for a score; null
    and empty texts get the model's bias.  Without labels of both kinds every score is the base rate.
    Repeated rows stay; a row without an id is not held out.
    """
    counts = letter_counts(docs, text_col)
    token = uuid.uuid4().hex
    bias, weights = train(docs, labels, counts, token, id_col, text_col, max_rows, max_features)
    shared = docs.sparkSession.sparkContext.broadcast((counts, bias, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, bias, weights = shared.value
        r, get = reader(token, counts), weights.get
        for b in batches:
            out = []
            for t in b.column(2).to_pylist():
                z = bias + sum(get(f, 0.0) for f in r.features(t) if f in weights) if t else bias
                out.append(1 / (1 + math.exp(-max(-40.0, min(40.0, z)))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.float64()), pa.array([int(x >= 0.5) for x in out], pa.int32())], names=[id_col, "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0
