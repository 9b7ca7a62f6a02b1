import hashlib
import random
import zlib
from collections import defaultdict

from quillstack.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def brute(rows, heads=True):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if heads else 0
        built[c] = (own.get(c - int(f"{abs(c) % 100}") * (1 if c >= 0 else -1), [])[:h] + v[h:]) if heads else v
    members = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    kids = defaultdict(list)
    for n in members:
        if n:
            kids[n[:-1]].append(n)
    out = []

    totals = {}
    for n in sorted(members, key=len, reverse=True):
        below = [totals[k] for k in kids[n]]
        own_saved = (len(members[n]) - 1) * len(n[-1][1]) if n else 0
        totals[n] = (sum(b[0] for b in below) or (not below), own_saved + sum(b[1] for b in below))
    for n, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(n))))
        out.append((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids[n]), int(totals[n][0]), totals[n][1], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, heads=True):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in pt.prefix_trie(df, pt.with_shared_heads if heads else pt.as_they_are).collect()), key=str)


def test_random_trie_with_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(pt, "PIECE", 3)
    r = random.Random(4)
    rows = []
    for c in [*range(0, 8), *range(100, 160), 205, 301, 302, -5, -103]:
        for t in range(r.choice([0, 1, 2, 4, 7])):
            rows.append((c, r.choice([t, t, t, None]), r.choice(["user", "user", None]), r.choice(["a", "a", "é🙂", None, "", "long " * 50])))
    rows += [(None, 1, "user", "lost"), (101, 0, "user", "a"), (101, 0, "user", "a")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, heads=False) == brute(rows, heads=False)


def test_caterpillar_long_and_copied(spark):
    # conversation k leaves the common way at depth k; one is long; a third are copies; each by its own rules
    rows = [(k, d, "u", f"way {d}") for k in range(1, 40) for d in range(k)] + [(k, k, "u", f"end {k}") for k in range(1, 40)]
    rows += [(1000, d, "u", f"long {d % 7}") for d in range(900)] + [(c, d, "u", "same") for c in range(2000, 2100) for d in range(3)]
    assert run(spark, rows, heads=False) == brute(rows, heads=False)


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, [(None, 1, "u", "x")]) == []
    assert run(spark, [(5, 1, "u", "x" * 2_000_000)]) == brute([(5, 1, "u", "x" * 2_000_000)])


def test_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert run(spark, rows) == brute(rows)
