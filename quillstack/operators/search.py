"""Ranked search: exact scores, a fuzzy fallback, filters and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstack.functions.fields import is_subsequence
from quillstack.functions.text import blank, query_tokens, unique_tokens

# What a hit in a field counts; a hit at the start of a title counts twice.
TALK_WEIGHTS = {"title": 50, "speakers": 30, "tags": 15, "abstract": 10, "meeting": 5, "category": 5}
PAPER_WEIGHTS = {"title": 50, "authors": 34, "tags": 20, "keywords": 16, "abstract": 12, "publication": 10, "venue": 8, "type": 6, "year": 6}
ALL_WORK_WEIGHTS = {k: v for k, v in PAPER_WEIGHTS.items() if k != "type"}
TALK_EPOCH, PAPER_EPOCH = 2007, 2002
FUZZY_BONUS = {"title": 3, "speakers": 2, "authors": 2, "tags": 2, "keywords": 2, "publication": 1, "meeting": 0, "venue": 0}


def token_score(token: str, fields: dict[str, Column | str], weights: dict[str, int]) -> Column:
    """What one token scores over all fields."""
    out = F.lit(0)
    for name, c in fields.items():
        at = F.instr(F.lower(blank(c)), token)
        w = weights[name]
        out = out + (F.when(at == 1, 2 * w).when(at > 0, w).otherwise(0) if name == "title" else F.when(at > 0, w).otherwise(0))
    return out


def exact_score(tokens: list[str], fields: dict[str, Column | str], weights: dict[str, int], year: Column | None = None, epoch: int = TALK_EPOCH, per_year: float = 0.1) -> Column:
    """Sum over tokens, 0 unless each one hits; newer works get a little more (RNK-01, 03, 04, 05)."""
    if not tokens:
        return F.lit(0.0)
    each = [token_score(t, fields, weights) for t in tokens]
    every = each[0] > 0
    for e in each[1:]:
        every = every & (e > 0)
    recent = (F.coalesce(year, F.lit(epoch)) - epoch) * per_year if year is not None else F.lit(0.0)
    return F.when(every, sum(each[1:], each[0]) + recent).otherwise(F.lit(0.0)).cast("double")


def fuzzy_word_score(token: str, word: Column) -> Column:
    """How well a word stands for a token (RNK-06)."""
    best = F.when(word == token, 20)
    others = [F.when(word.startswith(token), 16).otherwise(0), F.when(F.contains(word, F.lit(token)), 14).otherwise(0)]
    if len(token) >= 3:
        others.append(F.when(is_subsequence(token, word), 11).otherwise(0))
    if len(token) >= 4:
        most = 2 if len(token) >= 7 else 1
        d = F.levenshtein(word, F.lit(token), most)
        others.append(F.when(d == 1, 10).when(d > 1, 8).otherwise(0))
    return best.otherwise(F.greatest(*others))


def fuzzy_token_score(token: str, words: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(words, lambda w: fuzzy_word_score(token, w))), F.lit(0))


def fuzzy_score(tokens: list[str], fields: dict[str, Column | str], bonus: dict[str, int] = FUZZY_BONUS) -> Column:
    """Sum over tokens of the best field, 0 unless each token has one (RNK-07, 08)."""
    if not tokens:
        return F.lit(0)
    words = {n: unique_tokens(c) for n, c in fields.items()}
    each = []
    for t in tokens:
        scores = [F.when(s > 0, s + bonus.get(n, 0)).otherwise(0) for n, s in ((n, fuzzy_token_score(t, w)) for n, w in words.items())]
        each.append(F.greatest(*scores) if len(scores) > 1 else scores[0])
    every = each[0] > 0
    for e in each[1:]:
        every = every & (e > 0)
    return F.when(every, sum(each[1:], each[0])).otherwise(0)


def search(df: DataFrame, query: str, fields: dict[str, Column | str], weights: dict[str, int], year: Column | None = None, epoch: int = TALK_EPOCH) -> DataFrame:
    """df's matches with score and mode: exact ones, or fuzzy ones if no row matches exactly (RNK-02, 09, 10).

    Whether any row matches exactly is an aggregate of one row, over a scan of its own.
    """
    tokens = query_tokens(query)
    if not tokens:
        return df.withColumn("score", F.lit(0.0)).withColumn("mode", F.lit("browse"))
    exact = df.withColumn("score", exact_score(tokens, fields, weights, year, epoch))
    any_exact = exact.agg(F.coalesce(F.max(F.col("score") > 0), F.lit(False)).alias("__any"))  # one row
    fuzzy = fuzzy_score(tokens, {k: v for k, v in fields.items() if k in FUZZY_BONUS}).cast("double")
    out = exact.crossJoin(F.broadcast(any_exact))
    # a conditional is lazy: fuzzy scores are made only where no row matches exactly
    out = out.withColumn("score", F.when(F.col("__any"), F.col("score")).otherwise(fuzzy)).withColumn("mode", F.when(F.col("__any"), "exact").otherwise("fuzzy"))
    return out.where("score > 0").drop("__any")


def page(df: DataFrame, order: list[Column], first: int = 60, more: int = 40, number: int = 0) -> DataFrame:
    """The first rows in an order, or a later page of them (LIM-01)."""
    return df.orderBy(*order).limit(first) if number == 0 else df.orderBy(*order).offset(first + (number - 1) * more).limit(more)


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """WIN-01, WIN-05."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("__r") <= k).drop("__r")


def title_match(title: Column, year: Column, want_title: Column, want_year: Column) -> Column:
    """RNK-14: how well a catalogue's answer fits a title and year; 40 or more is accepted."""
    from quillstack.functions.keys import title_key

    a, b = title_key(title), title_key(want_title)
    t = F.when(a == b, 100).when(F.contains(a, b), 40).when(F.contains(b, a), 20).otherwise(0)
    gap = F.abs(year - want_year)
    return t + F.coalesce(F.when(gap == 0, 20).when(gap == 1, 10), F.lit(0))


def name_match(target: Column, candidate: Column) -> Column:
    """RNK-15: quality of a name by the tokens that both have."""
    from quillstack.functions.keys import name_tokens

    a, b = F.array_distinct(name_tokens(target)), F.array_distinct(name_tokens(candidate))
    both = F.size(F.array_intersect(a, b))
    return F.when(F.array_join(name_tokens(target), " ") == F.array_join(name_tokens(candidate), " "), 100).when((both == F.size(a)) & (both == F.size(b)), 95).when((both == F.size(a)) & (both > 0), 70).when((both == F.size(b)) & (both > 0), 45).when(both > 0, 25).otherwise(0)


# What a candidate's label and noise in its text count, and labels and texts that are meant.
LABEL_BONUSES = ((0.2, r"lang=en|:en$|\|en$"), (0.15, "english"), (0.08, r"citation_|dc\.|dcterms\.|ldjson|script:translated|script:english"), (0.02, "og:|twitter:|html:title"))
NOISE, NOISE_MARKERS = 0.4, "all rights reserved|cookie|javascript is disabled|subscribe|sign in|log in|privacy policy"


def english_candidate_score(label: Column, value: Column) -> Column:
    """Share of English, a little for length, for each thing that the label says, less for noise; 0 without text (HTM-03, RNK-11)."""
    from quillstack.functions.text import collapse_ws, english_ratio, strip_markup

    low, clean = F.lower(collapse_ws(label)), strip_markup(value)
    bonus = sum((F.when(low.rlike(pattern), worth).otherwise(0.0) for worth, pattern in LABEL_BONUSES), F.lit(0.0))
    noise = F.when(F.lower(clean).rlike(NOISE_MARKERS), NOISE).otherwise(0.0)
    return F.when(clean == "", F.lit(0.0)).otherwise(english_ratio(value) + F.least(F.length(clean) / 400, F.lit(0.2)) + bonus - noise)


def match_count(df: DataFrame, query: str, fields: dict[str, Column | str], weights: dict[str, int]) -> DataFrame:
    """(n, mode): how many rows a query would find, exactly or, if none, fuzzily; what routes a query to another corpus (AGG-10)."""
    tokens = query_tokens(query)
    if not tokens:
        return df.sparkSession.createDataFrame([(0, "browse")], "n long, mode string")
    scored = df.select((exact_score(tokens, fields, weights) > 0).alias("e"), (fuzzy_score(tokens, {k: v for k, v in fields.items() if k in FUZZY_BONUS}) > 0).alias("f"))
    n = scored.agg(F.count_if("e").alias("e"), F.count_if("f").alias("f"))
    return n.select(F.when(F.col("e") > 0, F.col("e")).otherwise(F.col("f")).alias("n"), F.when(F.col("e") > 0, F.lit("exact")).otherwise(F.lit("fuzzy")).alias("mode"))


def by_id(df: DataFrame, id_col: str, value) -> DataFrame:
    """The row of an id, for its detail page (JON-14); the filter reaches the scan."""
    return df.where(F.col(id_col) == F.lit(value)).limit(1)


TALK_ORDERS = ("newest", "oldest", "title")


def talk_order(mode: str, meeting: str, title: str, id_col: str, locale: str | None = "UNICODE") -> list[Column]:
    """Sort keys of talks, newest if the mode is none of TALK_ORDERS (SRT-03, SRT-04, SRT-07); locale None compares by code point."""
    key = lambda c: F.collate(blank(c), locale) if locale else blank(c)
    m, rest = key(meeting), [key(title), key(id_col)]
    return {"oldest": [m.asc(), *rest], "title": [rest[0], m.desc(), rest[1]]}.get(mode, [m.desc(), *rest])


def paper_order(year: str, title: str, id_col: str) -> list[Column]:
    """Sort keys of stored papers: year, title, id, all descending; a year that isn't one counts as 0000 (SRT-01)."""
    from quillstack.functions.text import collapse_ws

    y = collapse_ws(F.col(year).cast("string"))
    return [F.when(y.rlike(r"^\d{4}$"), y).otherwise(F.lit("0000")).desc(), F.lower(collapse_ws(title)).desc(), collapse_ws(F.col(id_col).cast("string")).desc()]
