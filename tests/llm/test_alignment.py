import hashlib
from bisect import bisect_left
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quillstack.llm import alignment
from quillstack.llm.token_counts import byte_alphabet

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "", None, " ", "  ", "   \n ", "a", "a ", "a  ", " a", "Hello, world!  It's 1234 o'clock\n\tdon't we'll", "line one\n  line two \n\n   line three\n", "x  y　 z \x1c w\x85 v",
    "<|endoftext|> and <s> </s> <0x41> <unk>", "has ▁ mark", "▁", "ΣΑΣ İstanbul É Straße 漢字かな 🙂🙂🙂🏽", "th " * 400, "w" * 3000, "the the the the " * 700, "\x00 \x01 null", "é ﬁ ½", "tab\tand \t tab",
    "Étion dans, çouelle un éonierç le ch trement.\nAipa éeaument", "long " * 5 + "\n" * 40 + " end" + " " * 40,
]


def brute(texts):
    """Token by token over whole texts, by both packages."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    byte_of = {c: i for i, c in enumerate(byte_alphabet())}
    told = []
    for t in texts:
        if not t:
            told.append(([], [], []))
            continue
        ids_a, ids_b = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        raw_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
        raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        whole = (" " + t).encode()
        if b"".join(raw_a) != whole or b"".join(raw_b) != whole:
            told.append(([], [], []))
            continue
        spans = []
        for ids, raw in ((ids_a, raw_a), (ids_b, raw_b)):
            at, out = 0, []
            for i, r in zip(ids, raw, strict=True):
                out.append((at, at + len(r), i))
                at += len(r)
            spans.append(out)
        links, j = [], 0
        for lo, hi, i in spans[0]:
            while j and spans[1][j - 1][1] > lo:
                j -= 1
            while j < len(spans[1]) and spans[1][j][0] < hi:
                if spans[1][j][1] > lo:
                    links.append((i, spans[1][j][2]))
                j += 1
        both = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        sides = []
        for side in spans:
            of = defaultdict(list)
            for _, e, i in side:
                of[bisect_left(both, e)].append(str(i))
            sides.append(of)
        groups = ["|".join(",".join(of[g]) for of in sides) for g in range(len(both))]
        told.append((spans, links, groups))
    count = Counter(x for _, links, _ in told for x in links)
    best = defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    out = []
    for spans, links, groups in told:
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if spans else ""
        out.append((len(spans[0]) if spans else 0, len(spans[1]) if spans else 0, len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), sha))
    return out


def run(df):
    cols = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    out = alignment.align(df, A, B)
    assert out.columns == ["doc_id", *cols]
    return sorted((str(r.doc_id), *(r[c] for c in cols)) for r in out.collect())


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, small):
    if small:
        for name, n in (("STRIPE_BYTES", 1 << 20), ("BLOCK_CHARS", 40), ("CACHE_BYTES", 2000), ("SALT_DOCS", 5), ("GROUPS", 3)):
            monkeypatch.setattr(alignment, name, n)
    texts = TEXTS + TEXTS[5:12] if not small else TEXTS[:16] + ["the the the the " * 100] * 3
    rows = [(i if i % 7 else None, t, "clash") for i, t in enumerate(texts)]
    got = run(spark.createDataFrame(rows, "doc_id long, text string, n_a string").repartition(2))
    assert got == sorted((str(i), *x) for (i, _, _), x in zip(rows, brute(texts), strict=True))


def test_table_and_text_ids(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = run(spark.createDataFrame([(f"d{r.doc_id}", r.text) for r in rows], "doc_id string, text string"))
    assert got == sorted((f"d{r.doc_id}", *x) for r, x in zip(rows, brute([r.text for r in rows]), strict=True))


def test_empty_and_long(spark):
    assert run(spark.createDataFrame([], "doc_id long, text string")) == []
    long = ["word " * 250_000, "x" * 1_000_000]
    got = run(spark.createDataFrame(list(enumerate(long)), "doc_id long, text string"))
    assert got == sorted((str(i), *x) for i, x in enumerate(brute(long)))
