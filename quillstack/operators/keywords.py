"""Keyword mining: tags and aliases by rules, phrases by n-grams."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstack.functions.fields import distinct_ignoring_case
from quillstack.functions.keys import alnum_key
from quillstack.functions.text import blank, collapse_ws, keyword_tokens, mining_fragment

from .numbering import numbered

# Weights of a phrase by its place and length.
TITLE_WEIGHT, TITLE_STEP, ABSTRACT_WEIGHT, ABSTRACT_STEP, BOTH_BONUS, TITLE_BONUS = 0.55, 0.25, 1.25, 0.55, 1.35, 0.5
MINED, STORED, LONGEST, TITLE_LETTERS = 14, 24, 64, 11
#: Tokens that are counted at once, unless a row has more.
SLICE = 1_000_000


@dataclass(frozen=True)
class Lexicon:
    """The word lists that mining goes by; all of them are parameters."""

    stop: frozenset[str] = frozenset("a an and are as at be been being but by can during for from has have in into is it its more not of on or our over such that the their these this those to under using via was we were which while with without".split())
    noise: frozenset[str] = frozenset("abstract approach available based different existing first however many method methods new paper papers present presented problem proposed result results show shows study system technique techniques used use work".split())
    edges: frozenset[str] = frozenset("based new using novel several various".split())
    technical: frozenset[str] = frozenset("abi api cpu gpu jit ssa simd ir".split())
    unigram_noise: frozenset[str] = frozenset("application code compiler data language performance program programs software systems".split())
    #: Words that end like a verb and are kept as single words all the same.
    kept_endings: frozenset[str] = frozenset("fuzzing offloading".split())
    technical_suffixes: tuple[str, ...] = ("ization", "compiler", "optimizer", "analysis", "vectorizer", "former")
    formats: dict[str, str] = field(default_factory=lambda: {"abi": "ABI", "api": "API", "cpu": "CPU", "gpu": "GPU", "jit": "JIT", "ssa": "SSA", "simd": "SIMD", "ir": "IR"})


def rule_labels(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Labels of the rules (label, pattern) that match, in order, once each (KWX-01, 02, 03, 11).

    Patterns are bounded by ASCII letters and digits only.
    """
    hits = F.array_compact(F.array(*(F.when(blank(text).rlike(f"(?i)(?<![A-Za-z0-9_])(?:{p})(?![A-Za-z0-9_])"), F.lit(k)) for k, p in rules)))
    return F.array_distinct(hits)


def is_candidate(t: Column, lex: Lexicon) -> Column:
    """Whether a token may be part of a phrase: no stop word, number or year, and of three letters and digits unless it has a form of its own (KWX-05)."""
    bare = F.regexp_replace(t, "[^a-z0-9]+", "")
    short = (F.length(bare) <= 2) & ~t.isin(*lex.formats)
    return ~t.isin(*lex.stop, *lex.noise) & ~t.rlike(r"^\d+[+]?$") & ~bare.rlike(r"^\d*$") & ~short


def is_technical(t: Column, lex: Lexicon) -> Column:
    """Whether a single word says something by itself: listed, letters and digits mixed, hyphenated, or of a technical ending (KWX-06)."""
    listed = t.isin(*lex.formats, *lex.technical)
    shaped = t.rlike(r"[a-z]\d|\d[a-z]") | (F.contains(t, F.lit("-")) & (F.length(t) >= 6))
    ending = t.rlike("(?:" + "|".join(lex.technical_suffixes) + ")$")
    return listed | shaped | ending


def is_low_signal(tokens: Column, lex: Lexicon) -> Column:
    """Of phrases of one to three words: short single words, a word that repeats, and edges that say nothing (KWX-07)."""
    first, last = F.element_at(tokens, 1), F.element_at(tokens, -1)
    second, third = F.try_element_at(tokens, F.lit(2)), F.try_element_at(tokens, F.lit(3))
    short = (F.size(tokens) == 1) & (F.length(first) <= 3) & ~first.isin(*lex.formats)
    same = lambda x, y: F.coalesce(x == y, F.lit(False))
    return short | same(first, second) | same(second, third) | same(first, third) | first.isin(*lex.edges) | last.isin(*lex.edges)


def format_phrase(phrase: Column, lex: Lexicon) -> Column:
    """KWX-08."""
    table = F.create_map(*(F.lit(x) for kv in lex.formats.items() for x in kv))
    return F.array_join(F.transform(F.split(phrase, " "), lambda t: F.coalesce(F.try_element_at(table, t), F.when(t == "c++", F.lit("C++")), F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 1000)))), " ")


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, where it comes in fewer: for a few files that cost far more to work on than to send."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def phrase_counts(lex: Lexicon, met_only: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow, of rows (id, title tokens, abstract tokens): (id, phrase, n, title_hits, abstract_hits) of each row.

    Tokens are numbers while they are counted, SLICE of them at a time; words are put together for what is returned.
    met_only: only what met() lets pass, for rows that are all there is of their id.
    """

    def may_be(t: str) -> bool:  # as is_candidate()
        bare = re.sub("[^a-z0-9]+", "", t)
        return t not in lex.stop and t not in lex.noise and not re.fullmatch(r"[0-9]+[+]?", t) and not re.fullmatch("[0-9]*", bare) and (len(bare) > 2 or t in lex.formats)

    def counted(ids: pa.Array, titles: pa.Array, abstracts: pa.Array) -> Iterator[pa.RecordBatch]:
        parts = (titles, 1), (abstracts, 0)
        rows = [np.repeat(np.arange(len(ids)), pc.list_value_length(x).to_numpy(zero_copy_only=False)) for x, _ in parts]
        in_title, row = np.concatenate([np.full(len(r), k) for r, (_, k) in zip(rows, parts, strict=True)]), np.concatenate(rows)
        tokens = pa.concat_arrays([x.flatten() for x, _ in parts]).dictionary_encode()
        words, code = tokens.dictionary, tokens.indices.to_numpy().astype(np.int64)
        good = np.array([may_be(w) for w in words.to_pylist()], dtype=bool)[code]
        size = pc.binary_length(words).to_numpy().astype(np.int64)  # tokens are ASCII
        at, group = np.flatnonzero(good), row
        for n in (1, 2, 3):
            if n > 1:
                at = at[at + n - 1 < len(code)]
                end = at + n - 1
                at = at[good[end] & (row[end] == row[at]) & (in_title[end] == in_title[at])]
            # the phrase's number: that of the phrase without its last word (at first, the row's) with the last word
            _, first, which = np.unique(group[at] * len(words) + code[at + n - 1], return_index=True, return_inverse=True)
            group = np.zeros(len(code), dtype=np.int64)
            group[at] = which
            title_hits = np.bincount(which, in_title[at], len(first)).astype(np.int64)
            abstract_hits = np.bincount(which, minlength=len(first)) - title_hits
            start = at[first]
            letters = sum(size[code[start + k]] for k in range(n))
            keep = letters + n - 1 <= LONGEST
            if met_only:
                keep &= np.where(title_hits > 0, (abstract_hits > 0) | (letters >= TITLE_LETTERS), abstract_hits >= 2)
            start = start[keep]
            phrase = pc.binary_join_element_wise(*(words.take(pa.array(code[start + k])) for k in range(n)), " ")
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row[start])), phrase, pa.array(np.full(len(start), n, dtype=np.int32)), pa.array(title_hits[keep]), pa.array(abstract_hits[keep])], names=["id", "phrase", "n", "title_hits", "abstract_hits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            upto = np.cumsum(sum(pc.list_value_length(b.column(k)).to_numpy(zero_copy_only=False) for k in (1, 2)))
            lo = 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + SLICE, "right")))
                yield from counted(*(c.slice(lo, hi - lo) for c in b.columns))
                lo = hi

    return run


def phrase_scores(df: DataFrame, id_col: str, title: str, abstract: str, lex: Lexicon | None = None, met_only: bool = False) -> DataFrame:
    """(id, phrase, n, title_hits, abstract_hits, score) of all candidate phrases of one to three words (AGG-16, KWX-04).

    Phrases are counted row by row.  Those of rows that share an id, or have none, are then added up; all others are
    final, and don't go through a shuffle.  met_only: phrases that mined_phrases() drops for being met too seldom may
    be left out.
    """
    lex = lex or Lexicon()
    df = df.select(F.col(id_col).alias("id"), F.col(title).alias("t"), F.col(abstract).alias("a"))
    known, kind = df.where("id IS NOT NULL"), df.schema["id"].dataType.simpleString()
    again = known.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").select("id")

    def counts(rows: DataFrame, met_only: bool) -> DataFrame:
        tokens = rows.select("id", *(keyword_tokens(mining_fragment(c)).alias(c) for c in ("t", "a")))
        return tokens.mapInArrow(phrase_counts(lex, met_only), f"id {kind}, phrase string, n int, title_hits long, abstract_hits long")

    shared = counts(known.join(again, "id", "left_semi").unionByName(spread(df.where("id IS NULL"))), False)
    shared = shared.groupBy("id", "phrase", "n").agg(F.sum("title_hits").alias("title_hits"), F.sum("abstract_hits").alias("abstract_hits"))
    g = counts(spread(known.join(again, "id", "left_anti")), met_only).unionByName(shared)
    bonus = F.when((F.col("title_hits") > 0) & (F.col("abstract_hits") > 0), BOTH_BONUS).when(F.col("title_hits") > 0, TITLE_BONUS).otherwise(0.0)
    score = F.col("title_hits") * (TITLE_WEIGHT + TITLE_STEP * (F.col("n") - 1)) + F.col("abstract_hits") * (ABSTRACT_WEIGHT + ABSTRACT_STEP * (F.col("n") - 1)) + bonus
    return g.withColumn("score", F.round(score, 6))


def met(p: Column) -> Column:
    """Whether a phrase is met often enough: outside the title twice; of the title alone it must be of TITLE_LETTERS letters."""
    in_title, letters = F.col("title_hits") > 0, F.length(F.replace(p, F.lit(" "), F.lit("")))
    return F.when(in_title, (F.col("abstract_hits") > 0) | (letters >= TITLE_LETTERS)).otherwise(F.col("abstract_hits") >= 2)


def mined_phrases(scores: DataFrame, lex: Lexicon | None = None) -> DataFrame:
    """Of phrase_scores() those that may be keywords (KWX-04).

    Outside the title a phrase must be met twice; of the title alone it must be of 11 letters.  Single
    words must be technical, or be met twice in the abstract, three times in all, and have six letters,
    and not end like a verb or adverb.
    """
    lex = lex or Lexicon()
    p, twice = F.col("phrase"), F.col("abstract_hits") >= 2
    plain = twice & (F.col("title_hits") + F.col("abstract_hits") >= 3) & (F.length(p) >= 6)
    single = ~p.isin(*lex.unigram_noise) & (~p.rlike("(ly|ed|ing)$") | p.isin(*lex.kept_endings)) & (is_technical(p, lex) | plain)
    # most phrases are met once: they go before anything else is looked at
    return scores.where(met(p)).where(~p.isin(*lex.noise) & ~is_low_signal(F.split(p, " "), lex) & ((F.col("n") > 1) | single))


def mined_keywords(df: DataFrame, id_col: str, title: str, abstract: str, lex: Lexicon | None = None, limit: int = MINED) -> DataFrame:
    """(id, keywords): the best phrases; one that lies in another taken before is passed over, one that holds another takes its place (KWX-04, LIM-02)."""
    lex = lex or Lexicon()
    s = mined_phrases(phrase_scores(df, id_col, title, abstract, lex, met_only=True), lex)
    # a document's own phrases, as many as it has
    lists = s.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("phrase")))).alias("ranked"))
    phrases = F.transform("ranked", lambda x: F.struct(format_phrase(x["phrase"], lex).alias("phrase"), alnum_key(format_phrase(x["phrase"], lex)).alias("key")))

    def take(acc: Column, p: Column) -> Column:
        at = F.array_max(F.transform(acc, lambda x, i: F.when(F.contains(p["key"], x["key"]), i).otherwise(F.lit(-1))))
        there = F.coalesce(at, F.lit(-1))
        done = (F.size(acc) >= limit) | (p["key"] == "") | F.exists(acc, lambda x: F.contains(x["key"], p["key"]))
        return F.when(done, acc).when(there >= 0, F.transform(acc, lambda x, i: F.when(i == there, p).otherwise(x))).otherwise(F.concat(acc, F.array(p)))

    taken = F.aggregate(phrases, F.array().cast("array<struct<phrase:string,key:string>>"), take)
    return lists.select("id", F.transform(taken, lambda x: x["phrase"]).alias("keywords"))


def key_topics(values: Column, text: Column, rules: list[tuple[str, str]], aliases: dict[str, str], limit: int | None = None) -> Column:
    """Canonical topics of an item: of its tags and keywords, then of the rules that its text matches, once each (KWX-12, LIM-02)."""
    from quillstack.functions.keys import canonical_topic

    named = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.coalesce(canonical_topic(v, aliases), F.trim(v)))
    out = distinct_ignoring_case(F.concat(named, rule_labels(text, rules)), alnum_key)
    return F.slice(out, 1, limit) if limit else out


def talk_text(title: Column, abstract: Column) -> Column:
    return F.concat_ws(" ", F.trim(blank(title)), F.trim(blank(abstract)))


def paper_text(title: Column, abstract: Column, publication: Column, venue: Column) -> Column:
    return F.array_join(F.filter(F.array(*(F.trim(blank(c)) for c in (title, abstract, publication, venue))), lambda x: x != ""), " ")


def combined_keywords(tags: Column, aliases: Column, mined: Column, limit: int = MINED) -> Column:
    """Tags, alias labels and mined phrases; what a key taken before holds is passed over (KWX-09)."""
    every = distinct_ignoring_case(F.concat(*(F.coalesce(x, F.array().cast("array<string>")) for x in (tags, aliases, mined))))
    taken = F.aggregate(
        every, F.array().cast("array<string>"),
        lambda acc, p: F.when((F.size(acc) >= limit) | (alnum_key(p) == "") | F.exists(acc, lambda k: F.contains(alnum_key(k), alnum_key(p))), acc).otherwise(F.concat(acc, F.array(p))),
    )
    return taken


def stored_keywords(existing: Column, extracted: Column, tags: Column, keep_existing: bool = True, limit: int = STORED) -> Column:
    """KWX-10."""
    parts = [existing] if keep_existing else []
    return F.slice(distinct_ignoring_case(F.concat(*(F.coalesce(x, F.array().cast("array<string>")) for x in (*parts, extracted, tags)))), 1, limit)


def discovery_terms(base: list[str], subjects: DataFrame, subject: str, prefix: str) -> DataFrame:
    """discovery_queries() of a table of subjects: (query, place); of equal ones the first, base ones before subjects in alphabetical order (KWX-13)."""
    given = subjects.sparkSession.createDataFrame([(i, q) for i, q in enumerate(base)], "i int, q string")
    each = given.select(F.lit(0).alias("kind"), "i", "q").unionByName(subjects.select(F.lit(1).alias("kind"), F.lit(0).alias("i"), F.concat_ws(" ", F.lit(prefix), F.col(subject)).alias("q")))
    clean = each.withColumn("q", collapse_ws("q")).where("q <> ''")
    once = clean.groupBy(F.lower("q").alias("k")).agg(F.min(F.struct("kind", "i", "q")).alias("f"))
    return numbered(once.select("f.*"), ["kind", "i", "q"]).select(F.col("q").alias("query"), "place")


def discovery_queries(base: list[str], subjects: list[str], prefix: str) -> list[str]:
    """Search words: the base ones and a prefix with each subject, once each (KWX-13)."""
    out: dict[str, str] = {}
    for q in [*base, *(f"{prefix} {s}" for s in subjects)]:
        q = " ".join(q.split())
        if q:
            out.setdefault(q.lower(), q)
    return list(out.values())
