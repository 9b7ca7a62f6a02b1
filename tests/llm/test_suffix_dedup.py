import hashlib
import random
from collections import Counter

import numpy as np
import pytest

import quillstack.llm.suffix_dedup as sd
from quillstack.llm.suffix_dedup import anchors, refined, remove_repeats


def brute(texts, length):
    n = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if n[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out.append((len(t), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=80, size=400):
    r = random.Random(seed)
    prose = lambda k: "".join(r.choice("abcé ") for _ in range(k))
    parts = [prose(r.randint(20, 120)) for _ in range(12)]
    out = []
    for _ in range(n):
        t = "".join(r.choice(parts) if r.random() < 0.4 else prose(r.randint(0, 60)) for _ in range(r.randint(0, size // 60)))
        out.append(t[: r.randint(0, len(t))] if r.random() < 0.3 else t)
    return out


@pytest.mark.parametrize(("length", "gram", "hot", "piece"), [(40, 10, 4096, 1 << 21), (40, 10, 3, 1 << 21), (30, 30, 4096, 100)])
def test_equals_brute_force(spark, monkeypatch, length, gram, hot, piece):
    monkeypatch.setattr(sd, "HOT", hot)
    texts = corpus(length + hot, size=300)
    texts += ["", None, "x" * 500, "ab" * 100, texts[0], "é" * 60, "short"]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 1), (None, texts[4], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(df, length=length, gram=gram).collect())
    want = brute([(t or "").encode() for _, t, _ in rows], length)
    assert got == sorted((str(r[0]), *w) for r, w in zip(rows, want, strict=True))
    assert sum(w[1] for w in want) > 1000


def test_hot_buckets_are_split_not_spelled_out(spark, monkeypatch):
    """Near copies: few rows for each anchor, not one for each of up to 301 windows."""
    made, staged = {}, sd.staged

    def counted(df, label, by=None):
        out = staged(df, label, by)
        made[label] = made.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(sd, "staged", counted)
    monkeypatch.setattr(sd, "HOT", 16)
    r = random.Random(9)
    base = "".join(r.choice("abcdefgh ") for _ in range(1200))
    texts = ["".join(r.choice("XYZ") if i in cut else c for i, c in enumerate(base)) for cut in ({r.randrange(1200) for _ in range(k % 4)} for k in range(120))]
    texts += [t[r.randrange(300) : r.randrange(800, 1200)] for t in texts[:40]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in remove_repeats(df).collect())
    want = brute([t.encode() for t in texts], 400)
    assert got == [(i, *w) for i, w in enumerate(want)]
    assert 0 < sum(w[1] for w in want) < sum(w[0] for w in want)
    assert max(made.values()) < 16 * made["sa-groups"]


def test_anchors_cover_each_window_once(monkeypatch):
    monkeypatch.setattr(sd, "PIECE", 64)
    texts = [t.encode() for t in corpus(1)]
    w, place, back, forth, *_ = anchors(texts, 40, 10)
    starts = Counter((int(i), s) for i, p, b, f in zip(w, place, back, forth, strict=True) for s in range(p - b, p - f + 1))
    assert set(starts) == {(i, s) for i, t in enumerate(texts) for s in range(len(t) - 39)} and set(starts.values()) == {1}


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = remove_repeats(spark.createDataFrame([(1, None)], "doc_id long, text string"), with_text=True).collect()[0]
    assert (one.n_bytes, one.n_removed, one.n_spans, one.kept) == (0, 0, 0, b"")


@pytest.mark.parametrize("length", [3, 8, 11, 16, 40])
def test_refined_tells_strings_apart_exactly(length):
    stretches = [t.encode() for t in corpus(length, n=30)] + [b"", b"a" * 100, b"ab" * 50, b"x"]
    ends = np.repeat(np.cumsum([len(x) for x in stretches]), [len(x) for x in stretches])
    data = b"".join(stretches)
    got = refined(np.frombuffer(data, dtype=np.uint8), ends, length)
    seen = {}
    for i, e in enumerate(ends.tolist()):
        assert (got[i] >= 0) == (i + length <= e)
        if got[i] >= 0:
            assert seen.setdefault(int(got[i]), data[i : i + length]) == data[i : i + length]
    assert len(seen) == len(set(seen.values()))


def test_rows_without_an_id(spark):
    r = random.Random(4)
    prose = lambda k: "".join(r.choice("abcde ") for _ in range(k))
    shared = [prose(60) for _ in range(300)]
    rows = [(None, (prose(r.randint(0, 20)) + r.choice(shared) + prose(5)) if i % 3 else prose(50)) for i in range(10_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in remove_repeats(df, length=40, gram=20).collect())
    assert got == Counter(brute([t.encode() for _, t in rows], 40))


@pytest.mark.parametrize("piece", [1 << 19, 90])
def test_shared_runs(spark, monkeypatch, piece):
    """Every document that shares 51 words with another has a run in common, and no run of 30 words is counted that no other has."""
    monkeypatch.setattr(sd, "PIECE", piece)
    r = random.Random(6)
    prose = lambda k: " ".join("".join(r.choice("abcdeé") for _ in range(3)) for _ in range(k))
    shared = [prose(k) for k in (20, 35, 51, 55, 70, 200)]
    rows = [(i if i % 7 else None, "  ".join([prose(r.randint(0, 60)), r.choice(shared) if i % 3 == 0 else "", prose(r.randint(0, 60)) + "\n"])) for i in range(150)]
    rows += [(500, None), (501, ""), (502, rows[1][1]), (3, rows[3][1]), (503, prose(400) + " " + shared[3])]
    got = Counter((str(x.doc_id), x.n_bytes, x.n_shared_runs > 0) for x in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), passage_words=51).collect())

    def runs(k):
        where = {}
        for d, t in rows:
            w = (t or "").split()
            for i in range(len(w) - k + 1):
                where.setdefault(tuple(w[i : i + k]), set()).add((d, t))
        return [any(len(where[tuple(w[i : i + k])]) > 1 for i in range(len(w) - k + 1)) for _, t in rows for w in [(t or "").split()]]

    must, may = runs(51), runs(30)
    for (d, t), a, b in zip(rows, must, may, strict=True):
        key = str(d), len((t or "").encode())
        assert not a or got[(*key, True)]
        assert b or got[(*key, False)]
    assert sum(must) > 20 and sum(b and not a for a, b in zip(must, may, strict=True)) > 3
