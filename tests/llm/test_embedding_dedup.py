import numpy as np

from quillstack.llm.embedding_dedup import forest, near_duplicates
from quillstack.llm.queries import ORACLE_SQL, op4_embedding_dedup


def brute(rows, least=0.9):
    """[(id, vector)] -> {id: (links, component)}, ids distinct."""
    good = {i: np.array(v, float) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = list(good)
    near = {i: {j for j in ids if i != j and len(good[i]) == len(good[j]) and good[i] @ good[j] / np.linalg.norm(good[i]) / np.linalg.norm(good[j]) >= least} for i in ids}
    out = {}
    for i, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = (len(near.get(i, ())), min(seen))
    return out


def clusters(seed, n=400, dim=24):
    r = np.random.default_rng(seed)
    base = r.normal(size=(60, dim))
    v = base[np.minimum(r.geometric(0.1, n), 59)] + r.normal(size=(n, dim)) * r.choice([0.05, 0.25, 0.4], (n, 1))
    return [(int(i) + 5, x.astype(np.float32).tolist()) for i, x in enumerate(v)]


def test_equals_brute_force(spark):
    rows = clusters(2)
    rows += [(1000, None), (1001, []), (1002, [0.0] * 24), (1003, [float("nan")] + [1.0] * 23), (1004, [None] + [1.0] * 23), (1005, [float("inf")] * 24), (1006, rows[0][1]), (1007, rows[0][1]), (2, rows[3][1]), (1008, [1.0, 2.0]), (1009, [2.0, 4.0])]
    d = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<float>, label int, n_links int")
    for block in (1024, 16):
        got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(d, list_size=60, block=block).collect()}
        want = brute(rows)
        links = sum(x[0] for x in want.values())
        assert len(got) == len(rows) and all(got[i][0] <= want[i][0] for i in got)
        assert sum(x[0] for x in got.values()) >= 0.995 * links > 0
        assert sum(got[i] == want[i] for i in got) >= 0.98 * len(rows)


def test_edges(spark):
    one = "vec_id long, embedding array<float>"
    assert near_duplicates(spark.createDataFrame([], one)).count() == 0
    assert [tuple(r) for r in near_duplicates(spark.createDataFrame([(7, [1.0, 0.0])], one)).collect()] == [(7, 0, 7, True)]
    assert [tuple(r) for r in near_duplicates(spark.createDataFrame([(7, None)], one)).collect()] == [(7, 0, 7, True)]
    again = sorted(tuple(r) for r in near_duplicates(spark.createDataFrame([(7, [1.0, 0.0]), (7, [1.0, 0.0]), (9, [1e30, 1e20])], one)).collect())
    assert again == [(7, 2, 7, True), (7, 2, 7, True), (9, 2, 7, False)]
    assert near_duplicates(spark.createDataFrame([(None, [1.0, 0.0]), (None, [1.0, 0.0])], one)).collect()[0].kept


def test_forest():
    assert forest(6, [(np.array([5, 4, 1]), np.array([4, 3, 2]))]).tolist() == [0, 1, 1, 3, 3, 3]


def test_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.sql(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    assert sorted(tuple(r) for r in op4_embedding_dedup(spark, sf).collect()) == sorted(c.sql(ORACLE_SQL["op4_embedding_dedup"]).fetchall())


def test_dense_group(spark):
    """A third of the vectors lie around one direction, so that neighbours share few of their nearest pivots."""
    r = np.random.default_rng(8)
    dim, n = 64, 3000

    def unit(x):
        return x / np.linalg.norm(x, axis=-1, keepdims=True)

    v = unit(np.sqrt(0.8) * unit(r.normal(size=dim)) + np.sqrt(0.2) * unit(r.normal(size=(n, dim))))
    e = r.normal(size=(n, dim))
    e = unit(e - (e * v).sum(axis=1, keepdims=True) * v)
    u = np.concatenate([v, 0.905 * v + np.sqrt(1 - 0.905**2) * e, unit(r.normal(size=(2 * n, dim)))])
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(u)], "vec_id long, embedding array<double>")
    got = {x.vec_id: x.n_links for x in near_duplicates(d, list_size=60).collect()}
    s = u[: 2 * n] @ u[: 2 * n].T
    want = (s >= 0.9).sum(axis=1) - 1
    assert all(got[i] <= want[i] for i in range(2 * n))
    assert sum(got[i] for i in range(2 * n)) >= 0.95 * want.sum() > 0
