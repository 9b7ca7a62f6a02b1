import random

from quillstack.llm.decontamination import ItemIndex, contaminated, words_of

R = random.Random(4)
COMMON = ["the", "of", "and", "in", "to", "a"]
WORDS = ["".join(R.choice("abcdefghij") for _ in range(R.randint(3, 7))) for _ in range(600)]


def prose(r, n):
    return [r.choice(COMMON) if r.random() < 0.5 else r.choice(WORDS) for _ in range(n)]


def edit(r, w, k):
    w = list(w)
    for _ in range(k):
        i = r.randrange(len(w))
        w[i : i + 1] = r.choice([[], [r.choice(WORDS)], [r.choice(WORDS), w[i]]])
    return w


def least_edits(item, text):
    d = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(d[j - 1] + (x != y), d[j] + 1, new[j - 1] + 1))
        d = new
    return min(d)


def test_recall_against_brute_force(spark):
    r = random.Random(9)
    items = [(i, " ".join(prose(r, r.randint(15, 60)))) for i in range(25)] + [(100, "too short"), (101, None), (102, "")]
    docs = []
    for i in range(250):
        w = prose(r, r.randint(0, 120))
        if i % 2:
            k, t = items[r.randrange(25)]
            w[len(w) // 2 : len(w) // 2] = edit(r, t.split(), r.choice([0, 0, 1, 2, 4, 6, 8, 10]))
        docs.append((i, " ".join(w).capitalize()))
    docs += [(900, None), (901, ""), (902, items[3][1].upper().replace(" ", ",\n")), (None, items[4][1]), (903, "x " * 20000 + items[5][1])]
    want = {}
    for d, t in docs:
        w = words_of(t or "")
        for i, x in items:
            y = words_of(x or "")
            if len(y) >= 5 and (e := least_edits(y, w)) <= int(0.2 * len(y) + 1e-9):
                want[d, i] = e
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, edits int")
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    for per in (5000, 10):
        got = {(x.doc_id, x.item_id): x.edits for x in contaminated(df, bench, items_per_pass=per).collect()}
        assert set(got) <= set(want)
        assert all(got[p] >= want[p] for p in got)
        assert {p for p in want if want[p] <= 1} <= set(got)
        assert len(got) >= 0.93 * len(want) > 50
        assert sum(got[p] == want[p] for p in got) >= 0.95 * len(got)


def test_empty(spark):
    d = spark.createDataFrame([(1, "one two three four five six")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "one two three four five six"), (2, "ONE, two three four five six"), (2, "ONE, two three four five six")], "item_id long, text string")
    assert contaminated(d.where("false"), b).count() == 0 and contaminated(d, b.where("false")).count() == 0
    assert sorted((x.item_id, x.edits) for x in contaminated(d.union(d), b).collect()) == [(1, 0)] * 2 + [(2, 0)] * 4


def test_items_below_the_length_are_not_indexed():
    assert not ItemIndex([(1, "a b c d")], 0.8, 0.9, 5, 4).classes


def test_too_few_walks_and_text_without_spaces(spark):
    """Where the walks allowed don't find enough, every window that may match is verified; characters of scripts without spaces are words."""
    r = random.Random(2)
    items = [(i, " ".join(prose(r, 20))) for i in range(6)] + [(50, "今日は天気がいいので散歩に行きましょう")]
    docs = [(i, " ".join(prose(r, 30) + edit(r, items[i % 6][1].split(), 4) + prose(r, 10))) for i in range(30)] + [(90, "昨日。今日は天気が悪いので散歩に行きましょう。"), (91, "これは何も関係のない文章ですよね本当に")]
    index = ItemIndex(items, 0.8, 1.1, 5, 1)
    assert index.classes and all(c.exhaustive for c in index.classes)
    want = {(d, i) for d, t in docs for i, x in items if least_edits(words_of(x), words_of(t)) <= int(0.2 * len(words_of(x)) + 1e-9)}
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), recall=1.1, max_walks=1).collect()
    assert {(x.doc_id, x.item_id) for x in got} == want and (90, 50) in want and len(want) > 30
