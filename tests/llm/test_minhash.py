import random
import re
import tracemalloc
from collections import Counter

import numpy as np

import quillstack.llm.minhash as mh
from quillstack.llm.minhash import SAMPLES, Frequencies, Shingles, document_frequencies, forest, near_duplicates, sample, similarities, similarity

R = random.Random(11)
WORDS = ["w" + "".join(R.choice("abcdefgh") for _ in range(R.randint(1, 6))) for _ in range(400)]


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def edited(r, text, k):
    w = text.split()
    for _ in range(k):
        w[r.randrange(len(w))] = r.choice(WORDS)
    return " ".join(w)


def brute(rows, idf, least=0.8):
    sh, low = Shingles(), {}
    ids = [i for i, t in rows if i is not None]
    texts = dict((i, t) for i, t in rows if i is not None)
    near = {i: [j for j in ids if j != i and sh.of(texts[i] or "").size and (texts[i] == texts[j] or similarity(sh, texts[i] or "", texts[j] or "", idf) >= least)] for i in ids}
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        low[i] = min(seen)
    return low


def some_frequencies(s):
    """Every other of some shingles is frequent."""
    s = np.unique(s)[::2]
    return Frequencies(s, np.arange(len(s)) * 9000 // len(s) + 20, 10_000)


def test_sampling_estimates_similarity():
    r, sh = random.Random(1), Shingles()
    a = prose(r, 400)
    idf = some_frequencies(sh.of(a))
    for k in (2, 8, 20):
        b = edited(r, a, k)
        true = similarity(sh, a, b, idf)
        (s, v), (t, w) = sh.weighted(a, idf), sh.weighted(b, idf)
        got = sample(np.concatenate([s, t]), np.concatenate([v, w]), np.array([0, len(s)]))
        assert got.shape == (2, SAMPLES)
        assert abs((got[0] == got[1]).mean() - true) < 0.27
    assert similarity(sh, a, a, idf) == 1 and similarity(sh, a, "", idf) == 0


def test_words_are_hashed_and_none_is_kept():
    words = re.findall(r"\w+", (text := "Ab_1, ab_1  é漢字 x🙂y\n_ a ba ab ٣").lower())
    got = mh.word_hashes(text.lower()).tolist()
    assert len(got) == len(words) and len(set(got)) == len(set(words)) and all((g == h) == (v == w) for g, v in zip(got, words) for h, w in zip(got, words))
    assert not len(Shingles().of("")) and not len(Shingles().of(" !?")) and len(Shingles().of("one")) == 1
    sh = Shingles()
    sh.of("warm up")
    tracemalloc.start()
    try:
        for k in range(30):
            sh.of(" ".join(f"w{k}x{i}" for i in range(5000)))
        assert tracemalloc.get_traced_memory()[0] < 2e6
    finally:
        tracemalloc.stop()


def test_cells_take_few_files(spark, monkeypatch):
    """Executors start a chmod for each file they write, which for a moment counts with all memory of the one that starts it."""
    files = []

    def staged(df, label):
        out = was(df, label)
        files.append((label, len(out.inputFiles())))
        return out

    was = mh.staged
    monkeypatch.setattr(mh, "staged", staged)
    r = random.Random(5)
    df = spark.createDataFrame([(prose(r, 30),) for _ in range(400)], "text string")
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        document_frequencies(df)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    assert [label for label, _ in files] == ["mh-cells"] and files[0][1] <= 4


def test_forest():
    near = np.zeros((6, 6), bool)
    for i, j in ((0, 1), (1, 2), (3, 4), (0, 2)):
        near[i, j] = near[j, i] = True
    got = forest(near)
    assert len(got) == 3 and {frozenset(e) for e in got} <= {frozenset(e) for e in ((0, 1), (1, 2), (3, 4), (0, 2))}


def test_all_similarities_at_once(monkeypatch):
    monkeypatch.setattr(mh, "COLUMNS", 50)
    r, sh = random.Random(3), Shingles()
    base = [prose(r, n) for n in (30, 300)]
    texts = [edited(r, b, k) for b in base for k in (0, 1, 3, 9, 40, 90)] + [base[0] * 3, "again " * 4000, "again " * 3000 + "end", "one two", "!!", ""]
    idf = some_frequencies(np.concatenate([sh.of(t) for t in texts]))
    got = similarities(texts, idf)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert i == j or abs(got[i, j] - similarity(sh, a, b, idf)) < 1e-12


def test_frequencies_are_exact_in_one_unit_and_capped(spark):
    r = random.Random(4)
    hot = prose(r, 6)
    rows = [(i, (hot + " " if i % 3 else "") + prose(r, 20)) for i in range(3000)] + [(9999, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    idf, sh = document_frequencies(df), Shingles()
    assert np.allclose(idf.of(sh.of(hot)), np.log(3001 / 2001) + 1)
    assert np.allclose(idf.of(sh.of(rows[5][1])[-3:]), np.log(1 / mh.SHARE) + 1)


def test_frequencies_are_exact_however_documents_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(mh, "SHARE", 1 / 20)
    r, sh = random.Random(6), Shingles()
    hot = [prose(r, 6) for _ in range(4)]
    # each of hot stands in 20 of 200 documents and more: once in each of 20 parts, or all in few of them
    texts = [[hot[0] + " " + prose(r, 9) if k == 0 else hot[1] + " " + prose(r, 9) if p < 4 else hot[2 + k % 2] + " " + prose(r, 9) if p % 3 else prose(r, 9) for k in range(10)] for p in range(20)]
    df = spark.createDataFrame([], "text string")
    for part in texts:
        df = df.unionByName(spark.createDataFrame([(t,) for t in [*part, None, ""]], "text string").coalesce(1))
    counts = Counter(s for part in texts for t in part for s in np.unique(sh.of(t)).tolist())
    s = np.array(list(counts), dtype=np.uint64)
    want = np.minimum(np.log(201 / (1 + np.array(list(counts.values())))) + 1, np.log(20) + 1)
    assert np.allclose(document_frequencies(df).of(s), want)
    assert np.allclose(document_frequencies(df.coalesce(1)).of(s), want)
    assert len(document_frequencies(df).shingle) == sum(1 + n > 201 / 20 for n in counts.values()) >= 8


def test_equals_brute_force(spark):
    r = random.Random(7)
    base = [prose(r, r.randint(40, 120)) for _ in range(12)]
    rows = []
    for b in base:
        rows += [edited(r, b, r.choice([0, 0, 1, 1, 2, 3])) for _ in range(8)]
    rows = list(enumerate(rows)) + [(500, None), (501, ""), (502, "!!"), (503, "!!"), (504, "one two"), (505, "One, two"), (506, prose(r, 20000))]
    rows += [(507, rows[-1][1] + " end")]
    df = spark.createDataFrame([*[(i, t, "x") for i, t in rows], (None, base[0], "x")], "doc_id long, text string, class_id string")
    idf = document_frequencies(df)
    got = near_duplicates(df).collect()
    want = brute(rows, idf)
    assert len(got) == len(rows) + 1
    assert {x.doc_id: x.class_id for x in got if x.doc_id is not None} == want
    assert all(x.kept == (x.doc_id == x.class_id) or x.doc_id is None for x in got)
    assert len(set(want.values())) < len(rows) - 20


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    two = near_duplicates(spark.createDataFrame([(1, None), (1, None)], "doc_id long, text string")).collect()
    assert [x.class_id for x in two] == [1, 1]


def test_many_blocks(spark, monkeypatch):
    """Groups larger than a block, whose members meet in several blocks."""
    monkeypatch.setattr(mh, "BLOCK", 8)
    r = random.Random(12)
    base = prose(r, 150)
    rows = [(i, edited(r, base, r.choice([1, 2, 3]))) for i in range(60)] + [(100 + i, edited(r, base, 9)) for i in range(10)]
    far = edited(r, base, 8)  # a second group in the same buckets
    rows += [(200 + i, edited(r, far, r.choice([0, 1, 2]))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    idf = document_frequencies(df)
    assert {x.doc_id: x.class_id for x in near_duplicates(df).collect()} == brute(rows, idf)


def test_repetitive_texts(spark):
    """Most of the weight lies in a few shingles: one repeated line, around which the rest differs."""
    r = random.Random(21)
    rows = []
    for g in range(6):
        line = prose(r, 30) + " "
        rows += [(10 * g + k, line * 60 + prose(r, 90)) for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    idf = document_frequencies(df)
    want = brute(rows, idf)
    assert len(set(want.values())) == 6
    assert {x.doc_id: x.class_id for x in near_duplicates(df).collect()} == want


def test_common_boilerplate_around_a_rare_body(spark):
    r = random.Random(22)
    hot = [prose(r, 84) for _ in range(2)]  # in nearly all documents
    rows = [(i, " ".join(hot)) for i in range(3000)]
    rows += [(5000 + 10 * g + k, f"{b} {hot[k]}") for g, b in enumerate(prose(r, 135) for _ in range(5)) for k in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    idf = document_frequencies(df)
    sh = Shingles()
    pairs = [(rows[-2 * g - 2][1], rows[-2 * g - 1][1]) for g in range(5)]
    assert all(similarity(sh, a, b, idf) >= 0.8 for a, b in pairs)
    got = {x.doc_id: x.class_id for x in near_duplicates(df).collect()}
    assert all(got[5001 + 10 * g] == 5000 + 10 * g for g in range(5))
