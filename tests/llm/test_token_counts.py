import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillstack.llm.token_counts import RankedMerges, count_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "", " ", "Hello, world!  It's 1234 o'clock\n\tdon't we'll", "aaaaaaaaaaaaaaaaaaaaa", "a<|endoftext|>b <|startoftext|>", "<|endoftext|",
    "ΣΑΣ ΟΔΟΣ İstanbul É é Straße 漢字かな 🙂🙂🙂 \x1c\x1d x\x85y　z", "th " * 3000, "x" * 5000, "___ -- ''s ''t 's", "Éauxré ouauxle çre", "\x00\x01", "ﬁ ½ ²",
]


def test_equals_tokenizers():
    lib, own = Tokenizer.from_file(PATH), RankedMerges(PATH)
    assert own.counts(TEXTS) == [len(lib.encode(t, add_special_tokens=False).ids) for t in TEXTS]


def test_frame(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(0, "", "dup"), (None, None, None)]
    out = count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), PATH, limit=100).collect()
    lib = Tokenizer.from_file(PATH)
    assert len(out) == len(rows)
    want = sorted((str(i), len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in out) == want
    assert all(r.over_limit == (r.n_tokens > 100) for r in out)


def test_empty(spark):
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_table(spark, sf):
    lib = Tokenizer.from_file(PATH)
    d = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in count_tokens(d, PATH).collect()}
    want = {r.doc_id: len(lib.encode(r.text or "", add_special_tokens=False).ids) for r in d.collect()}
    assert got == want
