import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstack.llm.line_dedup import deletion_keys, drop_duplicate_lines


def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :]


def brute(rows, max_edits=1, min_chars=16):
    """[(id, text)] -> texts after, in order."""
    lines = [((d if d is not None else 2**63 - 1, i), x.strip(" ")) for d, t in rows if t is not None for i, x in enumerate(t.split("\n"))]
    out = []
    for d, t in rows:
        if t is None:
            out.append(None)
            continue
        kept = []
        for i, x in enumerate(t.split("\n")):
            me, y = ((d if d is not None else 2**63 - 1), i), x.strip(" ")
            gone = len(y) >= min_chars and any(p < me and len(o) >= min_chars and (o == y or (max_edits and near(o, y))) for p, o in lines)
            if not gone:
                kept.append(x)
        out.append("\n".join(kept))
    return out


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="abé🙂", min_size=1, max_size=12))
def test_keys(line):
    whole, short = deletion_keys(line)
    assert len(short) == len(line)
    for i in range(len(line)):
        rest = line[:i] + line[i + 1 :]
        if rest:
            assert deletion_keys(rest)[0] == short[i]
    assert whole not in set(short.tolist())


def corpus(seed):
    r = random.Random(seed)
    base = ["".join(r.choice("abc d") for _ in range(r.randint(14, 40))) for _ in range(25)]

    def edit(x):
        i = r.randrange(len(x))
        return r.choice([x, x[:i] + x[i + 1 :], x[:i] + r.choice("abé") + x[i:], x[:i] + r.choice("abé") + x[i + 1 :]])

    rows = [(d, "\n".join(edit(edit(r.choice(base))) if r.random() < 0.7 else "short" for _ in range(r.randint(0, 6)))) for d in range(60)]
    rows += [(70, None), (71, ""), (None, base[0] + "\n" + base[1]), (None, base[0]), (5, rows[5][1]), (72, "\n\n  " + base[2] + " \n"), (73, "x" * 30000 + "y\n" + "x" * 30000), (74, "x" * 30000)]
    return rows


@pytest.mark.parametrize("max_edits", [0, 1])
def test_equals_brute_force(spark, max_edits):
    rows = corpus(max_edits)
    d = spark.createDataFrame([(i, t, "c", n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n_lines string, n int")
    got = [r.text for r in drop_duplicate_lines(d, max_edits=max_edits).orderBy("n").collect()]
    assert got == brute(rows, max_edits)
    assert got != [t for _, t in rows]


def test_counts_and_empty(spark):
    line = "the same line again and again"
    d = spark.createDataFrame([(1, f"{line}\n{line}\nother"), (2, f"{line}!"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in drop_duplicate_lines(d).collect()}
    assert got == {1: (3, 1, f"{line}\nother"), 2: (1, 1, ""), 3: (0, 0, None)}
    assert drop_duplicate_lines(d.where("false")).count() == 0


def test_short_lines(spark):
    """In the registered query and the pipeline equal lines of any length go, empty ones stay, and short ones aren't matched by an edit."""
    import corpus_pipeline
    from quillstack.llm import queries

    rows = [(1, "Les.\n\nAnd so."), (2, "Les.\n\nAnd sp.\n x "), (3, "x\n  \nLes. "), (4, "Les.")]
    d = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = {1: "Les.\n\nAnd so.", 2: "\nAnd sp.\n x ", 3: "  ", 4: ""}
    with pytest.MonkeyPatch.context() as m:
        m.setattr(queries, "table", lambda *_: d)
        assert {r.doc_id: r.text for r in queries.op7_line_dedup(spark, "").collect()} == want
    assert {r.doc_id: r.text for r in corpus_pipeline.line_stage(spark, d, "").collect()} == {1: want[1], 2: want[2]}


def test_no_deletions_are_broadcast(spark, monkeypatch):
    """By Spark's own choice: it takes what explodes and Python functions give for little more than their input."""
    from quillstack.llm import line_dedup

    plans = {}
    plan_of = lambda d: d._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(line_dedup, "staged", lambda d, label, _f=line_dedup.staged: plans.update({label: plan_of(d)}) or _f(d, label))
    d = spark.createDataFrame([(i, t) for i, t in corpus(3) if i is not None], "doc_id long, text string")
    plans[""] = plan_of(drop_duplicate_lines(d))
    assert "Broadcast" not in plans["lines-near"] and plans["lines-near"].count("SortMergeJoin") >= 5
    assert all("SortMergeJoin [k" in plans[x] for x in ("lines-texts", "lines-close")) and not any("BroadcastHashJoin [k" in p for p in plans.values())
