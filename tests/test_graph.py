"""Components by keys against union-find: chains, random graphs, records without keys, repeated records."""

import random

from quillstack.operators.graph import key_components


def by_union(rows):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, keys in rows:
        find(("id", i))
        for k in keys or []:
            parent[find(("key", k))] = find(("id", i))
    least = {}
    for i, _ in rows:
        root = find(("id", i))
        least[root] = min(i, least.get(root, i))
    return {i: least[find(("id", i))] for i, _ in rows}


def test_equals_union_find(spark):
    r = random.Random(3)
    rows = [(i, [f"k{i}", f"k{i + 1}"]) for i in range(60)] + [(i, [f"r{r.randrange(60)}" for _ in range(r.randrange(3))]) for i in range(100, 180)]
    rows += [(500, []), (500, ["z"]), (501, None), (502, ["z"])]
    got = key_components(spark.createDataFrame(rows, "i int, ks array<string>"), "i", "ks").collect()
    assert len(got) == len({i for i, _ in rows})
    assert {x.id: x.component for x in got} == by_union(rows)
    assert key_components(spark.createDataFrame([], "i int, ks array<string>"), "i", "ks").count() == 0
