import random
import time
from itertools import product

import numpy as np
import pytest

from quillstack.llm.toxicity import A, AGAIN, GAP, LEET, LETTERS, SAME, SEPARATORS, SET_APART, SWAPPED, Letters, Reader, codes, disguised, is_held_out, letter_counts, logistic, score

R = random.Random(8)
WORDS = ["".join(R.choice(["ba", "to", "ri", "ne", "sul", "ma", "ko"]) for _ in range(R.randint(1, 4))) for _ in range(150)]
BAD = ["grumbo", "slikta", "vornit"]
CORPUS = [" ".join(R.choice(WORDS + BAD) for _ in range(60)) for _ in range(80)]


def counts(texts):
    n = np.zeros(A**3, dtype=np.int64)
    for t in texts:
        c = codes(f"  {t.lower()}  ")
        np.add.at(n, (c[:-2] * A + c[1:-1]) * A + c[2:], 1)
    return n


def brute(letters, seen):
    """The likeliest restoration by trying all."""
    best = None
    options = []
    for i, ch in enumerate(seen):
        o = [(SAME, ch)] + [(SWAPPED, x) for x in LEET.get(ch, "")]
        o += [(SET_APART, "")] if ch in SEPARATORS else []
        o += [(AGAIN, "")] if i and seen[i - 1] == ch else []
        options.append(o)
    for pick in product(*options):
        s = "".join(x for _, x in pick)
        k = [GAP, GAP, *(letters.code.get(x, GAP) for x in s), GAP]
        v = sum(p for p, _ in pick) + sum(letters.log[k[i]][k[i + 1]][k[i + 2]] for i in range(len(k) - 2))
        if best is None or v > best[0]:
            best = v, s
    return best


def test_viterbi_equals_brute_force():
    m = Letters(counts(CORPUS))
    for seen in ("gr0mb0", "s l i k t a", "v0rn1t", "5likta", "gruumbo", "a.b", "1l!", ""):
        got, (_, s) = m.restore(seen), brute(m, seen)
        assert got == s


def test_restores_and_spares():
    r = Reader(counts(CORPUS))
    for seen, word in (("gr6mb0", None), ("s1ikta", "slikta"), ("v0rn1t", "vornit"), ("v o r n i t", "vornit"), ("s-l-i-k-t-a", "slikta"), ("vorrrrnit", "vornit"), ("$likta", "slikta")):
        assert word is None or word in r.words(f"Bato {seen.upper()} rine"), seen
    for seen in ("grumb0", "v o r", "gr..umbo"):
        r.words(seen)
    assert list(disguised("hat3 idio7!! a$$ wow$$$ nice!!! s t u 2024 3:45", set())) == ["hat3", "idio7", "a$$", "s t u"]
    assert list(disguised("s  l  a p", set())) == ["s  l  a p"] and list(disguised("", {"loook", "look"})) == ["loook"]
    plain = "plain words, 12 of them! at 3:45 (see a b)"
    assert not list(disguised(plain, set(plain.split())))
    assert len(LETTERS) + 1 == A


def test_a_long_stretch_is_settled_as_it_goes():
    m = Letters(counts(CORPUS))
    words = [w for w in WORDS if "o" in w][:30]
    assert m.restore("".join(words).replace("o", "0")).count("o") > 0.9 * sum(w.count("o") for w in words)


@pytest.mark.parametrize("unit", ["1", "a", "ab", "!", "! ", "a ", "$", ". ", "a." * 2])
def test_a_megabyte_in_a_second(unit):
    text = unit * (1_000_000 // len(unit))
    began = time.perf_counter()
    found = list(disguised(text, {text[:1000]}))
    assert time.perf_counter() - began < 1.5 and len(found) <= 1 + len(text)


def test_logistic_separates():
    bias, w = logistic(np.array([0, 1, 2]), np.array([0, 0, 1]), np.array([1.0, 1, 0, 0, 0]), 2)
    assert w[0] > 1 > w[1] and bias < 0


def test_held_out_accuracy(spark):
    r = random.Random(3)
    docs, labels = [], []
    for i in range(900):
        w = [r.choice(WORDS) for _ in range(r.randint(5, 80))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2):
                b = r.choice(BAD)
                w.insert(r.randrange(len(w)), r.choice([b, b, b.upper(), " ".join(b), b.replace("o", "0").replace("i", "1"), b[:2] + b[1] * 3 + b[2:]]))
        docs.append((i, " ".join(w), "score"))
        labels.append((i, int(toxic)))
    docs += [(1000, None, ""), (1001, "", ""), (None, "bato", ""), (5, docs[5][1], ""), (1002, "grumbo " * 30000, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string, score string")
    lb = spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int")
    assert int(letter_counts(df, "text").sum()) > 0
    got = score(df, lb).collect()
    assert len(got) == len(docs) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in got)
    assert all(x.held_out == is_held_out(x.doc_id) for x in got if x.doc_id is not None)
    truth = dict(labels)
    out = [(x.predicted, truth[x.doc_id]) for x in got if x.held_out and x.doc_id in truth]
    assert len(out) > 100 and sum(p == y for p, y in out) >= 0.97 * len(out)
    assert next(x.predicted for x in got if x.doc_id == 1002) == 1
    assert next(x.predicted for x in got if x.doc_id == 1000) == 0


@pytest.mark.parametrize("labelled", [True, False])
def test_empty(spark, labelled):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    lb = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert len(score(df, lb.where("true" if labelled else "false")).collect()) == 1
    assert score(df.where("false"), lb).count() == 0
