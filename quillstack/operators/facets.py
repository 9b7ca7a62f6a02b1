"""Facets, counts, autocomplete and people lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.functions.keys import category_order
from quillstack.functions.text import blank, query_tokens

from .search import top_per_group


def value_counts(df: DataFrame, label: Column, name: str = "label") -> DataFrame:
    """Trimmed labels and their counts, blanks aside (AGG-04)."""
    return df.select(F.trim(blank(label)).alias(name)).where(F.col(name) != "").groupBy(name).agg(F.count("*").alias("n"))


def topic_facet(df: DataFrame, topics: str, per_item: int = 12, longest: int | None = 48, least: int = 2, top: int = 220, cut: str = "count") -> DataFrame:
    """Topics with counts: the first per_item of each item, `least` items at least.

    cut="count" keeps the most frequent (AGG-01), cut="alpha" the first by alphabet (AGG-02).
    """
    t = df.select(F.explode(F.slice(topics, 1, per_item)).alias("topic")).where(F.col("topic") != "")
    if longest:
        t = t.where(F.length("topic") <= longest)
    n = t.groupBy("topic").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return n.orderBy(F.desc("n"), "topic").limit(top) if cut == "count" else n.orderBy("topic").limit(top)


def facet_sets(df: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value, n) for several columns, by grouping sets in one scan (AGG-01, AGG-02)."""
    sets = ", ".join(f"({c})" for c in columns)
    picked = df.select(*columns)
    facet = "coalesce(" + ", ".join(f"CASE WHEN grouping({c}) = 0 THEN '{c}' END" for c in columns) + ") AS facet"
    value = "coalesce(" + ", ".join(f"CASE WHEN grouping({c}) = 0 THEN cast({c} AS string) END" for c in columns) + ") AS value"
    return picked.sparkSession.sql(f"SELECT {facet}, {value}, count(*) AS n FROM {{d}} GROUP BY GROUPING SETS ({sets})", d=picked)


def category_facet(df: DataFrame, column: str) -> DataFrame:
    """Counts in the fixed order of categories (AGG-03)."""
    n = df.groupBy(column).agg(F.count("*").alias("n"))
    return n.withColumn("rank", category_order(F.col(column)).cast("int")).orderBy("rank", column)


def group_stats(groups: DataFrame, members: DataFrame, key: str, flags: dict[str, Column]) -> DataFrame:
    """groups with the count of their members, and of those with each flag, 0 where there are none (JON-11, AGG-06)."""
    n = members.groupBy(key).agg(F.count("*").alias("members"), *(F.count_if(c).alias(k) for k, c in flags.items()))
    joined = groups.join(n, key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("members", *flags)})


def two_sided_counts(left: DataFrame, right: DataFrame, label: str) -> DataFrame:
    """(label, left_n, right_n, total) over the labels of both (JON-12)."""
    a = left.groupBy(label).agg(F.count("*").alias("left_n"))
    b = right.groupBy(label).agg(F.count("*").alias("right_n"))
    j = a.join(b, label, "full_outer").withColumns({"left_n": F.coalesce("left_n", F.lit(0)), "right_n": F.coalesce("right_n", F.lit(0))})
    return j.withColumn("total", F.col("left_n") + F.col("right_n"))


def autocomplete(entries: DataFrame, query: str, per_kind: dict[str, int]) -> DataFrame:
    """Top entries (kind, label, n) of each kind whose label holds the query: earlier hits, then counts, then alphabet (AGG-05, WIN-05)."""
    q = " ".join(query_tokens(query, 1))
    hits = entries.withColumn("at", F.instr(F.lower("label"), q)).where("at > 0")
    ranked = top_per_group(hits, ["kind"], [F.col("at") > 1, F.desc("n"), F.col("label")], max(per_kind.values(), default=0))
    cap = F.create_map(*(F.lit(x) for kv in per_kind.items() for x in kv))
    from pyspark.sql import Window

    w = Window.partitionBy("kind").orderBy(F.col("at") > 1, F.desc("n"), "label")
    return ranked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.coalesce(F.try_element_at(cap, "kind"), F.lit(0))).select("kind", "label", "n", "rank")


def first_labels(df: DataFrame, key: Column, label: str, order: str) -> DataFrame:
    """The first label of each key (AGG-14, AGG-15, ER-11)."""
    return df.withColumn("key", key).where("key <> ''").groupBy("key").agg(F.min_by(label, order).alias("label"))


def filter_people(df: DataFrame, tokens: list[str], blob: str, talks: bool = False, papers: bool = False, merged: bool = False) -> DataFrame:
    """FLT-03."""
    out = df
    for t in tokens:
        out = out.where(F.contains(F.lower(F.col(blob)), F.lit(t)))
    if talks:
        out = out.where("talk_count > 0")
    if papers:
        out = out.where("paper_count > 0")
    return out.where(F.size("names") > 1) if merged else out


def sort_people(df: DataFrame, mode: str = "works") -> DataFrame:
    """SRT-06."""
    name = F.lower("name")
    orders = {"works": [F.desc("total_count"), name], "citations": [F.desc("citation_count"), name], "alpha": [name], "alpha-desc": [name.desc()]}
    return df.orderBy(*orders[mode])


def matches_terms(text_key: Column, terms: list[str]) -> Column:
    """FLT-07, FLT-08: single words as whole tokens, longer terms anywhere in a key."""
    tests = [F.contains(text_key, F.lit(t)) if " " in t else F.contains(F.concat(F.lit(" "), text_key, F.lit(" ")), F.lit(f" {t} ")) for t in terms]
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def matched_labels(text_key: Column, aliases: dict[str, list[str]]) -> Column:
    """FLT-09: labels with an alias in the key, sorted."""
    return F.array_compact(F.array(*(F.when(matches_terms(text_key, a), F.lit(k)) for k, a in sorted(aliases.items()))))


# Types of posts, and of works from outside that are wanted.
POST_TYPES = ("blog-post", "blog", "news-post")


def is_post(source: Column | str, kind: Column | str, blog_source: str) -> Column:
    """FLT-05."""
    return (F.lower(F.trim(blank(source))) == blog_source) | F.lower(F.trim(blank(kind))).isin("blog-post", "blog")


def research_like(source: Column | str, kind: Column | str, blog_source: str) -> Column:
    """FLT-10: anything but posts and news."""
    return (F.lower(F.trim(blank(source))) != blog_source) & ~F.lower(F.trim(blank(kind))).isin(*POST_TYPES)


def allowed_type(kind: Column | str, allowed: list[str]) -> Column:
    """FLT-11: one of the allowed types, or none given."""
    k = F.lower(F.trim(blank(kind)))
    return (k == "") | k.isin(*allowed)


def canceled_meeting(flag: Column, location: Column | str) -> Column:
    return F.coalesce(flag, F.lit(False)) | F.lower(blank(location)).rlike("cancell?ed")


def named_meeting(flag: Column, location: Column | str, name: Column | str, series: str) -> Column:
    """FLT-06: held, and of a series by its name."""
    return ~canceled_meeting(flag, location) & F.contains(F.lower(blank(name)), F.lit(series.lower()))


def card_disabled(flag: Column, location: Column | str, talks: Column, slides: Column) -> Column:
    """FLT-18: canceled, or nothing to show."""
    return canceled_meeting(flag, location) | ((F.coalesce(talks, F.lit(0)) == 0) & (F.coalesce(slides, F.lit(0)) == 0))


def matches_entity(kind: str, value: str, people: Column, topics: Column) -> Column:
    """FLT-12: whether an item is of a person, or has a topic, by which all works are listed."""
    from quillstack.functions.keys import person_signature, same_person

    if kind == "speaker":
        target = person_signature(F.lit(value))
        return F.exists(F.coalesce(people, F.array().cast("array<string>")), lambda p: same_person(person_signature(p), target))
    wanted = " ".join(value.lower().split())
    return F.exists(F.coalesce(topics, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)) == wanted)
