"""Entity resolution of records and people, enrichment, related items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstack.functions.fields import distinct_ignoring_case
from quillstack.functions.keys import normalize_affiliation, person_key
from quillstack.functions.text import blank, collapse_ws

from .graph import key_components
from .numbering import numbered, running


def record_quality(priority: Column, work: Column, doi: Column, abstract: Column, title: Column, authors: Column, citations: Column, labels: Column) -> Column:
    """RNK-12: compared from left to right."""
    has = lambda c: (F.trim(blank(c)) != "").cast("int")
    return F.struct(priority.alias("a"), has(work).alias("b"), has(doi).alias("c"), F.length(blank(abstract)).alias("d"), F.length(blank(title)).alias("e"), F.coalesce(F.size(authors), F.lit(0)).alias("f"), F.coalesce(citations, F.lit(0)).alias("g"), F.coalesce(F.size(labels), F.lit(0)).alias("h"))


def author_list_quality(authors: Column) -> Column:
    """How good a list of author names is, compared from left to right: names, long ones, fewer single letters (RNK-13)."""
    names = F.filter(F.transform(F.coalesce(authors, F.array().cast("array<string>")), lambda a: collapse_ws(a)), lambda a: a != "")
    count = lambda test: F.size(F.filter(names, test))
    return F.struct(F.size(names).alias("names"), count(lambda a: F.length(a) >= 6).alias("long"), (-count(lambda a: a.rlike(r"^[A-Za-z]\.?$"))).alias("initials"))


def negated(quality: Column, names: tuple[str, ...] = ("names", "long", "initials")) -> Column:
    """A struct of numbers that sorts the other way."""
    return F.struct(*((-quality[n]).alias(n) for n in names))


def best_authors(authors: str, order: Column, lead: Column) -> Column:
    """The author list of a group's records that the others, merged in order after the leader's, don't better: the first of the best; empty ones never lead (ER-04)."""
    some = F.size(F.coalesce(authors, F.array().cast("array<string>"))) > 0
    best = F.min_by(authors, F.when(some, F.struct(negated(author_list_quality(F.col(authors))).alias("q"), order.alias("o"))))
    of_lead = F.min_by(authors, lead)
    return F.when(author_list_quality(of_lead).eqNullSafe(author_list_quality(best)) & (F.size(of_lead) > 0), of_lead).otherwise(best)


def first_filled(c: str, order: Column, lead: Column) -> Column:
    """The leader's value unless it is blank, else the first of a group's values, in an order, that isn't: what filling empty fields in that order leads to (ER-03)."""
    filled = lambda x: F.trim(blank(x)) != ""
    of_lead = F.min_by(c, lead)
    return F.when(filled(of_lead), of_lead).otherwise(F.min_by(c, F.when(filled(c), order))).alias(c)


def merge_duplicates(records: DataFrame, id_col: str, keys_col: str, order_col: str, quality: Column, scalars: list[str], arrays: list[str], counts: list[str], authors: str | None = None) -> DataFrame:
    """One record for each class of records that share keys (ER-01, ER-03, ER-04).

    The best record leads (of equals the first), the others follow in order; blanks are filled from the first that has
    a value, arrays are joined without repeats, counts are the largest, authors are the best list.  All of it is one
    aggregation, partial before the shuffle, so a class of any size is met in parts; only arrays hold more than one
    value of a class.  quality: a struct of numbers, as of record_quality().
    """
    classes = key_components(records, id_col, keys_col)
    rows = records.join(classes, records[id_col] == classes["id"]).drop(classes["id"]).withColumn("__q", quality)
    order = F.col(order_col)
    lead = F.struct(negated(F.col("__q"), tuple(rows.schema["__q"].dataType.names)).alias("q"), order.alias("o"))
    aggs = [first_filled(c, order, lead) for c in scalars] + ([best_authors(authors, order, lead).alias(authors)] if authors else [])
    none = lambda a: F.coalesce(F.min_by(a, lead), F.array().cast(rows.schema[a].dataType))
    aggs += [distinct_ignoring_case(F.concat(none(a), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.coalesce(F.col(a), F.array().cast(rows.schema[a].dataType)).alias("v")))), lambda x: x["v"])))).alias(a) for a in arrays]
    aggs += [F.max(c).alias(c) for c in counts]
    return rows.groupBy("component").agg(F.count("*").alias("members"), F.min_by(id_col, lead).alias("best_id"), *aggs)


def people(entries: DataFrame, name: str, affiliation: str, work_id: str, kind: str, citations: str) -> DataFrame:
    """People by name key: counts of talks and papers, citations, spellings and affiliations by frequency (ER-05, AGG-09, JON-13)."""
    e = entries.select(person_key(name).alias("key"), F.col(name).alias("name"), normalize_affiliation(affiliation).alias("aff"), F.col(work_id).alias("work"), F.col(kind).alias("kind"), F.col(citations).alias("cites")).where("key <> ''")
    once = e.dropDuplicates(["key", "work", "kind"])
    totals = once.groupBy("key").agg(F.count_if(F.col("kind") == "talk").alias("talk_count"), F.count_if(F.col("kind") == "paper").alias("paper_count"), F.sum(F.when(F.col("kind") == "paper", F.col("cites")).otherwise(0)).alias("citation_count"))
    names = e.groupBy("key", "name").count().groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "count")))).alias("names"))
    affs = e.where("aff <> ''").groupBy("key", "aff").count().groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("aff", "count")))).alias("affiliations"))
    return totals.join(names, "key").join(affs, "key", "left").withColumn("total_count", F.col("talk_count") + F.col("paper_count"))


def display_label(counts: DataFrame, group: str, label: str, count: str) -> DataFrame:
    """The best spelling of each group: by count, few middle names and initials, short, then by alphabet (RNK-17, ER-12)."""
    t = F.size(F.split(F.trim(label), r"\s+"))
    score = F.col(count) * 100 - 2 * F.greatest(t - 2, F.lit(0)) - F.when(F.col(label).rlike(r"\b[A-Za-z]\.?\s"), 0.8).otherwise(0.0) - 0.02 * F.greatest(F.length(label) - 40, F.lit(0))
    w = Window.partitionBy(group).orderBy(F.desc("__s"), label)
    return counts.withColumn("__s", score).withColumn("__r", F.row_number().over(w)).where("__r = 1").select(group, label)


def variant_names(counts: DataFrame, group: str, name: str, count: str) -> DataFrame:
    """(group, names): a person's spellings by count and alphabet, the first of each name key (ER-08)."""
    keyed = counts.select(group, F.col(name).alias("name"), F.col(count).alias("n"), person_key(name).alias("key")).where("key <> ''")
    once = keyed.groupBy(group, "key").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("name").alias("name"))).alias("v"))
    return once.groupBy(group).agg(F.transform(F.array_sort(F.collect_list("v")), lambda v: v["name"]).alias("names"))


def matched_seeds(works: DataFrame, id_col: str, authors: str, seeds: DataFrame, key: str, label: str) -> DataFrame:
    """(id, matched): works of at least one seed author, with the seeds' names, sorted, once each (JON-05).

    seeds: (key, label), keys of person names as authors have them under title_key().
    """
    from quillstack.functions.keys import title_key

    a = works.select(F.col(id_col).alias("id"), F.explode(authors).alias("a")).select("id", title_key("a").alias("k")).where("k <> ''")
    return a.join(seeds.select(F.col(key).alias("k"), F.col(label).alias("label")), "k").groupBy("id").agg(F.array_sort(F.collect_set("label")).alias("matched"))


# What stands for no value in the metadata of meetings.
NO_VALUE_KEYS = ("tbd", "tba", "tbc", "na", "none", "unknown", "null")


def meaningful(c: Column | str) -> Column:
    """Whether metadata says anything (FLT-14)."""
    from quillstack.functions.keys import alnum_key

    k = alnum_key(c)
    return (k != "") & ~k.isin(*NO_VALUE_KEYS)


def preferred_value(*values: Column) -> Column:
    """The first value that says anything, else the first that isn't blank, else empty (ER-10)."""
    return F.coalesce(*(F.when(meaningful(v), collapse_ws(v)) for v in values), *(F.nullif(collapse_ws(v), F.lit("")) for v in values), F.lit(""))


def promoted_hint(current: Column, upstream: Column, hint: Column) -> Column:
    """A hint in place of a value that was merely taken over from upstream (JON-18)."""
    from quillstack.functions.keys import alnum_key

    a, b, h = alnum_key(current), alnum_key(upstream), alnum_key(hint)
    return F.when((a != "") & (b != "") & (h != "") & (a == b) & (a != h), collapse_ws(hint)).otherwise(current)


def merged_meetings(existing: DataFrame, remote: DataFrame, hints: DataFrame) -> DataFrame:
    """(slug, name, date, location): curated values before remote ones, hints in place of what was taken over from remote; none is deleted (INC-10, ER-10).

    existing, remote: (slug, name, date, location); hints: (slug, date, location).
    """
    named = lambda d, p, cs: d.select("slug", *(F.col(c).alias(f"{p}_{c}") for c in cs))
    fields = ("name", "date", "location")
    j = named(existing, "e", fields).join(named(remote, "r", fields), "slug", "full_outer").join(named(hints, "h", fields[1:]), "slug", "left")
    value = lambda c: promoted_hint(preferred_value(F.col(f"e_{c}"), F.col(f"h_{c}"), F.col(f"r_{c}")), F.col(f"r_{c}"), F.col(f"h_{c}"))
    return j.select("slug", preferred_value(F.col("e_name"), F.col("r_name"), F.col("slug")).alias("name"), value("date").alias("date"), value("location").alias("location"))


def upserted_talks(existing: DataFrame, remote: DataFrame, curated: list[str], refreshed: list[str], full_key: str, title_key: str, order: str, id_col: str) -> DataFrame:
    """Existing talks, curated fields filled only where they are blank and links taken from remote, and remote ones that match none, with id null (INC-10, JON-04).

    A remote talk matches by its full key, else by a title that one existing talk alone has.
    """
    match = match_remote(remote, existing, full_key, title_key, order, id_col)
    r = remote.select(F.col(order).alias("__seq"), *(F.col(c).alias(f"__{c}") for c in (*curated, *refreshed))).join(match.select(F.col(order).alias("__seq"), F.col("id").alias("__id"), "how"), "__seq")
    fill = lambda c: F.nullif(F.trim(blank(f"__{c}")), F.lit(""))
    # of several remote talks for one the first that says anything fills a field, the last refreshes a link
    hits = r.where("how <> 'insert'").groupBy("__id").agg(*(F.min_by(fill(c), F.when(fill(c).isNotNull(), F.col("__seq"))).alias(f"__{c}") for c in curated), *(F.max_by(fill(c), F.when(fill(c).isNotNull(), F.col("__seq"))).alias(f"__{c}") for c in refreshed))
    kept = existing.join(hits, existing[id_col] == hits["__id"], "left").select(F.col(id_col), *(F.when(F.trim(blank(c)) != "", F.col(c)).otherwise(F.coalesce(F.col(f"__{c}"), F.col(c))).alias(c) for c in curated), *(F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) for c in refreshed))
    new = r.where("how = 'insert'").select(F.lit(None).cast(existing.schema[id_col].dataType).alias(id_col), *(F.col(f"__{c}").alias(c) for c in (*curated, *refreshed)))
    return kept.unionByName(new)


def merge_name_variants(buckets: DataFrame) -> DataFrame:
    """(key, merged_key) of buckets (key, name, affiliations), and names with their counts if they have any besides the one: see people.classes (ER-06)."""
    from . import people as merging

    once = F.create_map(blank("name"), F.lit(1).cast("long"))
    return merging.classes(buckets if "names" in buckets.columns else buckets.withColumn("names", once))


def enrich(left: DataFrame, right: DataFrame, on: list[str], fills: dict[str, str]) -> DataFrame:
    """left with columns overwritten by right's where those aren't blank (JON-01, 03, 07)."""
    r = right.select(*on, *(F.col(v).alias(f"__{k}") for k, v in fills.items()))
    joined = left.join(r, on, "left")
    kinds = dict(left.dtypes)
    for k in fills:
        new = F.nullif(F.trim(F.col(f"__{k}")), F.lit("")) if kinds.get(k) == "string" else F.col(f"__{k}")
        joined = joined.withColumn(k, F.coalesce(new, F.col(k)) if k in left.columns else new)
    return joined.drop(*(f"__{k}" for k in fills))


def without_known(new: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that no known row matches by any of several keys; blank keys match nothing (JON-06)."""
    for k in keys:
        new = new.join(known.select(F.col(k)).where(F.trim(blank(k)) != "").distinct(), k, "left_anti")
    return new


def match_remote(remote: DataFrame, existing: DataFrame, full_key: str, title_key: str, order: str, id_col: str) -> DataFrame:
    """(order, id, how) for each remote row: the existing one with its full key, else the only one with its title, else none (JON-04, JON-18)."""
    by_full = existing.groupBy(full_key).agg(F.min_by(id_col, order).alias("__full"))
    by_title = existing.groupBy(title_key).agg(F.min(id_col).alias("__title"), F.count("*").alias("__n")).where("__n = 1").drop("__n")
    j = remote.join(by_full, full_key, "left").join(by_title, title_key, "left")
    return j.select(order, F.coalesce("__full", "__title").alias("id"), F.when(F.col("__full").isNotNull(), "full").when(F.col("__title").isNotNull(), "title").otherwise("insert").alias("how"))


def match_authors(paper: DataFrame, work: DataFrame) -> DataFrame:
    """(paper, pos, affiliation): a paper's authors and a work's, each side used once: by name key, then signature, then place (JON-02).

    paper, work: (paper, pos, name, key, signature, last[, affiliation]).
    """
    out, p, w = None, paper, work.withColumnRenamed("pos", "wpos").withColumnRenamed("last", "wlast")
    for k in ("key", "signature"):
        ones = lambda d, k=k: d.withColumn("__n", F.count("*").over(Window.partitionBy("paper", k))).where("__n = 1").drop("__n")
        hit = ones(p).select("paper", k, "pos").join(ones(w).select("paper", k, "wpos", "affiliation"), ["paper", k])
        out = hit.select("paper", "pos", "affiliation") if out is None else out.unionByName(hit.select("paper", "pos", "affiliation"))
        p, w = p.join(hit.select("paper", "pos"), ["paper", "pos"], "left_anti"), w.join(hit.select("paper", "wpos"), ["paper", "wpos"], "left_anti")
    same = paper.groupBy("paper").agg(F.count("*").alias("a")).join(work.groupBy("paper").agg(F.count("*").alias("b")), "paper").where("a = b").select("paper")
    by_place = p.join(same, "paper", "left_semi").join(w.select("paper", F.col("wpos").alias("pos"), "wlast", "affiliation"), ["paper", "pos"])
    fits = (F.col("last") == F.col("wlast")) | F.col("last").endswith(F.col("wlast")) | F.col("wlast").endswith(F.col("last"))
    return out.unionByName(by_place.where(fits).select("paper", "pos", "affiliation"))


def chunks_of(df: DataFrame, order: str, size: int, group: str | None = None) -> DataFrame:
    """Rows numbered into batches of a size, within each group (ARR-07)."""
    placed = running(df, [group], [order], {"__n": ("sum", F.lit(1).cast("long"))}).drop("_part", "_row") if group else numbered(df, [order], "__n")
    return placed.withColumn("batch", F.floor((F.col("__n") - 1) / size).cast("int")).drop("__n")
