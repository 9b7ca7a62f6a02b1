import random

import pytest

from quillstack.operators import people

SCHEMA = "key string, name string, names map<string,bigint>, affiliations map<string,bigint>, talk_names map<string,bigint>, paper_names map<string,bigint>, talk_count long, paper_count long, citation_count long"


def signature(name):
    t = [x for x in name.lower().replace(".", " ").split() if x]
    return (f"{t[0]}|{t[-1]}", "".join(t), "".join(x[0] for x in t[1:-1])) if t else ("", "", "")


def chosen(names):
    import re

    score = lambda n: names[n] * 100 - 2 * len(signature(n)[2]) - (0.8 if re.search(r"\b[A-Z]\.?(\s|$)", n) else 0) - 0.02 * max(0, len(n) - 40)
    return min(names, key=lambda n: (-score(n), n)) if names else ""


def greedy(buckets):
    """Every pair, from the start again after each merge."""
    blocks = {}
    for b in buckets:
        blocks.setdefault(signature(b[1])[0], []).append({"keys": [b[0]], "names": dict(b[2]), "affs": {a.lower().replace(" ", "") for a in b[3] or {}}})
    out = []
    for group in blocks.values():
        again = True
        while again:
            again = False
            for i in range(len(group)):
                for j in range(i + 1, len(group)):
                    a, b = group[i], group[j]
                    x, y = signature(chosen(a["names"])), signature(chosen(b["names"]))
                    near = x[0] and x[0] == y[0] and (x[1] == y[1] or x[2].startswith(y[2]) or y[2].startswith(x[2]))
                    if near and (a["affs"] & b["affs"] if a["affs"] and b["affs"] else bool(a["affs"]) != bool(b["affs"])):
                        a["keys"] += b["keys"]
                        for n, c in b["names"].items():
                            a["names"][n] = a["names"].get(n, 0) + c
                        a["affs"] |= b["affs"]
                        del group[j]
                        again = True
                        break
                if again:
                    break
        out += [(k, g["keys"][0]) for g in group for k in g["keys"]]
    return sorted(out)


def made(seed, n=120):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        first, last = r.choice(["Ann", "Bob"]), r.choice(["Ox", "Yak"])
        middle = lambda: r.choice(["", "", " Q.", " Q. R.", " Quill", " S.", " Q. Rowan"])
        name = f"{first}{middle()} {last}"
        names = {name: r.randint(1, 3)} | ({f"{first}{middle()} {last}": r.randint(1, 3)} if r.random() < 0.4 else {})
        affs = {f"Place {r.randrange(12)}": 1 for _ in range(r.choice([0, 1, 1, 2]) if seed % 2 else r.choice([1, 1, 2]))}
        rows.append((f"k{i:04d}", name, names, affs, {name: 1}, {}, r.randrange(3), r.randrange(3), r.randrange(9)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_equals_the_greedy_loop(spark, seed):
    rows = made(seed)
    got = sorted(tuple(r) for r in people.classes(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect())
    assert got == greedy(rows) and len({m for _, m in got}) < len(rows)


def test_counts_and_spellings_are_added_up(spark):
    rows = [("a", "Ann Q. Ox", {"Ann Q. Ox": 2}, {"Univ. of X": 1}, {"Ann Q. Ox": 2}, {}, 2, 0, 0), ("b", "Ann Ox", {"Ann Ox": 1, "Ann Q. Ox": 1}, {"University of X": 2}, {}, {"Ann Ox": 1}, 0, 2, 7), ("c", "", {}, None, {}, {}, 1, 0, 0), ("d", "Bo Ox", {"Bo Ox": 1}, {}, {}, {}, 1, 0, 0)]
    got = {r.merged_key: r for r in people.merged(spark.createDataFrame(rows, SCHEMA)).collect()}
    a = got["a"]
    assert set(got) == {"a", "c", "d"} and a["keys"] == ["a", "b"] and a.names == {"Ann Q. Ox": 3, "Ann Ox": 1} and a.affiliations == {"Univ. of X": 1, "University of X": 2}
    assert (a.name, a.talk_name, a.paper_name, a.talk_count, a.paper_count, a.citation_count, a.total_count) == ("Ann Q. Ox", "Ann Q. Ox", "Ann Ox", 2, 2, 7, 4)
    assert got["c"].name == "" and got["d"].talk_name == "Bo Ox"


def test_empty(spark):
    assert people.merged(spark.createDataFrame([], SCHEMA)).count() == 0
