"""The pipeline's stages on a small fixture, each held against what a plain reading of it gives."""

import random

import pytest

import corpus_pipeline
from quillstack.llm import queries

R = random.Random(21)
WORDS = ["".join(R.choice(["ba", "to", "ri", "ne", "sul", "ma", "ko", "len"]) for _ in range(R.randint(1, 4))) for _ in range(300)]


def sentence(n):
    return " ".join(R.choice(WORDS) for _ in range(n)).capitalize() + "."


OWN = sentence(14) + " " + sentence(9)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("sf"))
    docs = [(i, "\n".join(" ".join(sentence(R.randint(6, 15)) for _ in range(R.randint(1, 3))) for _ in range(6)), "en") for i in range(260)]
    item = " ".join(R.choice(WORDS) for _ in range(30))
    words = docs[10][1].split(" ")
    docs += [
        (500, "### $$$ %%% &&& " * 40, "en"),  # junk
        (501, docs[3][1], "en"),  # a copy: all its lines came before
        (502, OWN + "\n" + docs[4][1].split("\n")[0], "en"),
        (503, " ".join([*words[:40], "sulsul", *words[41:]]).replace("\n", " "), "en"),
        (504, " ".join(sentence(R.randint(6, 15)) for _ in range(6)) + " " + item + ". " + " ".join(sentence(R.randint(6, 15)) for _ in range(6)), "en"),  # holds the benchmark item
        (505, None, "en"), (506, "", None), (None, sentence(40), "en"),
    ]
    flat = " ".join(docs[20][1].split())
    docs += [(600, flat, "en"), (601, flat + " " + docs[20][1].split(" ")[0].lower(), "en")]  # near copies on one line each
    rows = [(i, t, lang, "src", len(t) if t is not None else None) for i, t, lang in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(150)] + [(500, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    return sf


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, corpus)
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS, name
        rows = docs.collect()
        kept[name] = {r.doc_id: r for r in rows}
        docs = spark.createDataFrame(rows, docs.schema)
    assert 500 not in kept["quality"]
    assert {501, 502, 503, 504, 505, 506, None, 600, 601} <= set(kept["quality"])
    assert len(kept["quality"]) >= 265
    lines = kept["line_dedup"]
    assert 501 not in lines and lines[502].text == OWN and lines[502].n_chars == len(OWN)
    assert {505, 506, None} <= set(lines) and lines[505].text is None
    # 20, 600 and 601 hold the same words: the least id stays
    assert {20, 600, 601} & set(kept["near_dedup"]) == {20}
    assert 504 in kept["near_dedup"] and 504 not in kept["decontamination"]
    assert set(kept["decontamination"]) == set(kept["near_dedup"]) - {504}


def test_run_encodes_what_is_left(spark, corpus):
    import sentencepiece
    import public_tokenizers

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, corpus).collect()}
    assert 500 not in got and 504 not in got and all(r.round_trip for r in got.values())
    first = spark.read.parquet(f"{corpus}/documents.parquet").where("doc_id = 0").first()
    assert got[0].ids == lib.encode(first.text)


def test_registered():
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries()
    assert len([q for q in queries.QUERIES if q.startswith("op")]) == 13
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_near_duplicates_weigh_common_words_however_documents_are_dealt(spark):
    """A line that all documents share makes no near duplicates of them, though no part has two of them."""
    r = random.Random(5)
    common = sentence(80)
    rows = [(i, common + " " + " ".join(r.choice(WORDS) for _ in range(4)), "en", "src", 0) for i in range(60)]
    for parts in (60, 1):
        docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), "doc_id long, text string, lang string, source string, n_chars long")
        assert corpus_pipeline.near_duplicate_stage(spark, docs, "").count() == 60


def test_no_stage_broadcasts_keys_of_its_documents(spark, monkeypatch):
    """By Spark's own choice, which goes by compressed files and by what explodes and Python functions read."""
    import corpus_pipeline
    from quillstack.llm import line_dedup, minhash

    plans = {}
    for m in (line_dedup, minhash):
        monkeypatch.setattr(m, "staged", lambda d, label, *a, _f=m.staged: plans.update({label: d._jdf.queryExecution().executedPlan().toString()}) or _f(d, label, *a))
    d = spark.createDataFrame([(i, f"some words of a line that is long enough {i % 7}\nand another {i % 5}", "en", "web", 60) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    corpus_pipeline.line_stage(spark, d, "")
    corpus_pipeline.near_duplicate_stage(spark, d, "")
    assert all("SortMergeJoin" in plans[x] and "Broadcast" not in plans[x] for x in ("lines-near", "mh-copies"))
