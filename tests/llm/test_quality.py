import math
import random
from collections import Counter, defaultdict

import pytest

import quillstack.llm.quality as quality
from quillstack.llm.quality import classify, discounts, fit, is_held_out, packed, perplexities, unpacked

R = random.Random(5)
WORDS = ["".join(R.choice("aeioustrn") for _ in range(R.randint(2, 7))) for _ in range(80)]


def prose(n, r=R):
    return " ".join(r.choice(WORDS) for _ in range(n)).capitalize() + "."


def brute(trusted, texts):
    """Interpolated modified Kneser-Ney of words and pairs, by dictionaries; trusted and texts of one model."""
    seq = lambda t: ["<e>", *quality.WORD.findall(t), "<e>"]
    pairs = Counter(p for t in trusted if t for s in [seq(t)] for p in zip(s, s[1:], strict=False))
    ends = Counter(w for _, w in pairs)
    cuts = lambda c: (0.0, *discounts(*(sum(1 for n in c.values() if n == i) for i in range(1, 5))))
    d2, d1 = cuts(pairs), cuts(ends)
    total, off = defaultdict(int), defaultdict(float)
    for (v, _), n in pairs.items():
        total[v] += n
        off[v] += d2[min(n, 3)]
    every = sum(ends.values())
    unknown = sum(d1[min(n, 3)] for n in ends.values()) / every / (len(ends) + 1)

    def p(v, w):
        n = ends[w]
        low = (n - d1[min(n, 3)]) / every + unknown
        if v not in total:
            return low
        n = pairs[v, w]
        return ((n - d2[min(n, 3)]) + off[v] * low) / total[v]

    out = []
    for t in texts:
        s = seq(t)
        out.append(math.exp(-sum(math.log(p(v, w)) for v, w in zip(s, s[1:], strict=False)) / (len(s) - 1)) if len(s) > 2 else None)
    return out


def scores(spark, trusted, texts, langs=None, **options):
    model = fit(spark.createDataFrame(trusted, "text string, lang string"), langs, **options)
    d = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    return [r.perplexity for r in perplexities(d, model).orderBy("doc_id").collect()]


def close(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g is w is None or g == pytest.approx(w, rel=1e-4)


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, small):
    if small:  # many blocks, and counts flushed in between
        monkeypatch.setattr(quality, "BLOCK_BYTES", 60)
    trusted = [prose(30) for _ in range(20)] + ["Été à la mer\nété\n", "x", "漢字かな交じり文 и текст", "漢字 и текст и слова", "", prose(30)]
    texts = [prose(10), "zzz qqq!!", "to to to to", "été", "", "漢字 ABC 12 текст", "и текст", None, "..."]
    close(scores(spark, [(t, "en") for t in trusted], [(t, "en") for t in texts], min_tokens=1), brute(trusted, [t or "" for t in texts]))


def test_many_languages(spark):
    r = random.Random(8)
    trusted = {f"l{i}": [prose(r.randint(5, 25), r) for _ in range(3)] for i in range(100)} | {"*": [prose(9, r)] * 2, "a/b": [prose(12, r)], "": [prose(7, r)]}
    rows = [(t, lang) for lang, ts in trusted.items() for t in ts]
    texts = [(prose(8, r), lang) for lang in trusted for _ in range(2)] + [(prose(8, r), "unheard of")]
    want = [brute(trusted[lang], [t])[0] for t, lang in texts[:-1]] + brute([t for t, _ in rows], [texts[-1][0]])
    close(scores(spark, rows, texts, min_tokens=1), want)
    # languages with too little text share the pooled model
    close(scores(spark, rows, texts[:6], min_tokens=10_000_000), brute([t for t, _ in rows], [t for t, _ in texts[:6]]))


def test_packed():
    import numpy as np

    for x in (np.zeros(0, np.uint64), np.array([0, 2**48 - 1, 7], np.uint64), np.arange(1000, dtype=np.uint64)):
        assert (unpacked(packed(x)) == x).all()


def test_classify(spark):
    docs = [(i, prose(60), "en", 0) for i in range(300)] + [(1000, "### $$$ %%% &&& " * 30, "en", 0), (1001, "WORD!! WORD!! OTHER!! " * 30, "xx", 0), (1002, None, "en", 0), (1003, "", None, 0), (1004, prose(60), None, 0), (5, prose(60), "en", 1), (None, prose(40), "en", 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, accepted int")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)] + [(3, 0, 0), (3, 1, 1), (1000, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = classify(d, labels, min_tokens=1_000).collect()
    assert len(got) == len(docs)
    bad = {r.doc_id for r in got if not r.accepted}
    assert {1000, 1001} <= bad and len(bad) <= 6 and not bad & {1002, 1003, 1004}
    nothing = classify(d, labels.where("false")).collect()
    assert len(nothing) == len(docs) and all(r.accepted and r.perplexity is None for r in nothing)
    assert classify(d.where("false"), labels).count() == 0


def test_documents_that_set_thresholds_do_not_train(spark, monkeypatch):
    docs = spark.createDataFrame([(i, prose(20), "en") for i in range(60)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, quality int")
    texts = [r.text for r in docs.collect()]
    got = {r.doc_id: r.perplexity for r in classify(docs, labels, min_tokens=1).collect()}
    close([got[i] for i in range(60)], brute([t for t in texts if not is_held_out(t)], texts))
    monkeypatch.setattr(quality, "BROADCAST_IDS", 0)  # ids joined by merging
    assert {r.doc_id: pytest.approx(r.perplexity, rel=1e-6) for r in classify(docs, labels, min_tokens=1).collect()} == got


def test_turns_change_nothing(spark, monkeypatch):
    docs = [(i, prose(60), "en") for i in range(300)] + [(1000, "### $$$ %%% &&& " * 30, "en"), (1001, "", "xx"), (1002, None, "en"), (1003, prose(60), None), (None, prose(40), "en"), (None, None, None)]
    d = spark.createDataFrame(docs + docs[:40], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(200)], "doc_id long, quality int")
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.lang or "", r.perplexity or 0)
    one = sorted(classify(d, labels, min_tokens=1_000).collect(), key=key)
    turns, models = [], quality.perplexities
    monkeypatch.setattr(quality, "TURN_ENTRIES", 1)
    monkeypatch.setattr(quality, "perplexities", lambda docs, *a: turns.append(docs) or models(docs, *a))
    more = sorted(classify(d, labels, min_tokens=1_000).collect(), key=key)
    assert len(turns) == quality.TURNS and len(more) == len(one) == d.count()
    for a, b in zip(one, more, strict=True):
        assert (a.doc_id, a.lang, a.accepted) == (b.doc_id, b.lang, b.accepted)
        assert b.perplexity == (None if a.perplexity is None else pytest.approx(a.perplexity, rel=1e-5))
