import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstack.llm import exact_topk
from quillstack.llm.exact_topk import bounds, products, top_k

SCHEMA = "vec_id long, embedding array<double>, score string"


def brute(rows, k=5, every=50):
    """Rows (id, vector), by Python's integers."""
    some = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(some):
        if i % every == 0:
            best = sorted((-sum(x * y for x, y in zip(q, c, strict=True)), j) for b, (j, c) in enumerate(some) if a != b and len(c) == len(q))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], SCHEMA)
    out = top_k(df, F.col("vec_id") % 50 == 0, **kw)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(tuple(r) for r in out.collect())


def vector(rng, dim=6, at=0.0):
    return (rng.normal(size=dim) + at).tolist()


def test_clusters_ties_and_copies(spark, monkeypatch):
    for name, n in (("A_PIVOT", 40), ("BLOCK", 16), ("FIRST", 1), ("WIDER", 2), ("REQUESTS", 3)):
        monkeypatch.setattr(exact_topk, name, n)
    rng = np.random.default_rng(1)
    rows = [(i, vector(rng, at=5 * (i % 4))) for i in range(400)]
    same = vector(rng, at=3)
    rows += [(i, same) for i in range(400, 600)]  # a third of all are copies, queries among them
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, vector(rng)) for i in range(0, 200, 10)]
    rows += [(1, None), (2, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (3, [float("nan")] * 6), (4, [float("inf")] * 6), (None, vector(rng)), (50, None), (7, [0.0] * 6), (100, [1.0, 2.0]), (9, [3.0, 4.0]), (150, []), (11, [])]
    rows += [(0, rows[0][1]), (0, rows[0][1]), (-50, vector(rng))]
    assert run(spark, rows) == brute(rows)


def test_large_values(spark):
    rows = [(0, [1e12, -1e12, 3.0]), (1, [1e3, 1.0, 1.0]), (2, [-1e3, 1.0, 1.0]), (3, [1e12, 2e3, 5.0]), (50, [1e200, 0.0, 0.0])]
    top = 2**63 - 1
    clipped = [(a, n, b, max(-top, min(top, s))) for a, n, b, s in brute(rows)]
    got = run(spark, rows)
    assert {(a, b, s) for a, _, b, s in got} == {(a, b, s) for a, _, b, s in clipped}


def test_empty_and_few(spark):
    assert run(spark, []) == []
    assert run(spark, [(50, [1.0])]) == []
    assert run(spark, [(50, [1.0]), (51, [2.0])]) == [(50, 1, 51, 256 * 512)]


@pytest.mark.parametrize("seed", range(4))
def test_bounds_hold(seed):
    rng = np.random.default_rng(seed)
    c, p, q = (np.floor(256 * rng.normal(size=(n, 8)) * 10.0**seed) for n in (50, 3, 20))
    cell = rng.integers(0, 3, 50)
    r = np.sqrt(((c - p[cell]) ** 2).sum(axis=1))
    assert (bounds(q, p, cell, r, r, (c * c).sum(axis=1)) >= products(q, c)).all()
