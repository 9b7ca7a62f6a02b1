import random

import pytest
from pyspark.sql import functions as F

from quillstack.operators import related

SCHEMA = "id long, g string, y int, t string, ls array<string>"


def brute(rows, per_group=4, total=6):
    out = []
    for i, g, _, _, ls in rows:
        first = sorted(o[0] for o in rows if o[0] != i and g is not None and o[1] == g)[:per_group]
        mine = {x for x in ls or [] if x is not None}
        rest = sorted((-len(mine & {x for x in o[4] or [] if x is not None}), -(o[2] or 0), o[3] or "", o[0]) for o in rows if o[0] != i and o[0] not in first and mine & set(o[4] or []))
        out += [(i, o, n + 1) for n, o in enumerate([*first, *(r[3] for r in rest)][:total])]
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r) for r in related.by_labels(df, "id", F.col("ls"), "g", F.col("y"), "t").collect())


def made(seed, n, labels, most):
    r = random.Random(seed)
    some = [f"l{min(int(r.expovariate(0.3)), labels)}" for _ in range(10 * labels)]
    return [(i, r.choice([None, "a", "b", *map(str, range(n // 5))]), r.choice([None, 2000, 2001]), r.choice([None, "", "x", f"t{i}"]), r.choice([None, []] + [[r.choice([*some, None]) for _ in range(r.randint(1, most))]] * 8)) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_narrow(spark, seed):
    rows = made(seed, 150, 12, 5) + [(1000 + i, "copies", 1999, "same", ["hot", "hotter"]) for i in range(80)]
    assert run(spark, rows) == brute(rows)


def test_wide(spark, monkeypatch):
    monkeypatch.setattr(related, "NARROW", 3)
    monkeypatch.setattr(related, "PART", 7)
    rows = made(5, 150, 12, 9) + [(1000 + i, None, 1999, "same", ["l0", "l1", "l2", "l3"]) for i in range(40)]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, [(1, "g", 1, "t", ["a"])]) == []
