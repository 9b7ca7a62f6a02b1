"""Merging people whose names and affiliations agree, in order, as each merge widens what the next is compared with."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.functions.keys import affiliation_key, person_signature
from quillstack.functions.text import blank

from .graph import key_components
from .numbering import checkpoint

COUNTS = "map<string,bigint>"
MAPS, SUMS = ("names", "affiliations", "talk_names", "paper_names"), ("talk_count", "paper_count", "citation_count")


def name_penalty(name: Column, initials: Column) -> Column:
    """What a spelling loses: for middle names, for initials, for length (RNK-17)."""
    return 2.0 * F.length(initials) + F.when(name.rlike(r"\b[A-Z]\.?(\s|$)"), 0.8).otherwise(0.0) + 0.02 * F.greatest(F.length(name) - 40, F.lit(0))


class Bucket:
    """One person so far: counted spellings, keys of affiliations, and which buckets are in it."""

    def __init__(self, row):
        self.keys = [row.key]
        self.names = {n["name"]: n["count"] for n in row.spellings}
        self.about = {n["name"]: (n["base_key"], n["exact_key"], n["initials"], n["penalty"]) for n in row.spellings}
        self.affs = set(row.affs)
        self.choose()

    def choose(self) -> None:
        best = min(((-(c * 100 - self.about[n][3]), n) for n, c in self.names.items()), default=(0, ""))[1]
        self.name = best
        self.base, self.exact, self.initials, _ = self.about.get(best, ("", "", "", 0))

    def agrees(self, other: Bucket) -> bool:
        if not self.base or self.base != other.base:
            return False
        a, b = self.initials, other.initials
        if self.exact != other.exact and not (a.startswith(b) or b.startswith(a)):
            return False
        return not self.affs.isdisjoint(other.affs) if self.affs and other.affs else bool(self.affs) != bool(other.affs)

    def take(self, other: Bucket) -> None:
        self.keys += other.keys
        for n, c in other.names.items():
            self.names[n] = self.names.get(n, 0) + c
        self.about |= other.about
        self.affs |= other.affs
        self.choose()


def merged_in_order(group: list[Bucket]) -> list[Bucket]:
    """The first pair that agrees is merged into its first, again and again from the start.

    Only the pairs of the bucket that has grown can have changed: so it is compared with those before it, the first
    of which takes it in, and then with those after it.
    """
    i = 0
    while i < len(group):
        j = next((j for j in range(i + 1, len(group)) if group[i].agrees(group[j])), None)
        if j is None:
            i += 1
            continue
        group[i].take(group.pop(j))
        while (k := next((k for k in range(i) if group[k].agrees(group[i])), None)) is not None:
            group[k].take(group.pop(i))
            i = k
    return group


def classes(buckets: DataFrame, order: str = "key") -> DataFrame:
    """(key, merged_key): of each bucket (key, name, names, affiliations) the first of those that it is merged with (ER-06).

    Buckets of one first and last name are merged where their chosen spellings' middle initials agree and they share an
    affiliation, or just one of them has any.  Only buckets that affiliations connect, or that lie beside one without any,
    can meet: these are found by joins, and each such part, not each name, is worked on in order by itself.
    Keys are unique.
    """
    none = F.create_map().cast(COUNTS)
    spelling = lambda n, c: F.struct(n.alias("name"), c.alias("count"), person_signature(n).alias("s"))
    told = lambda x: F.struct(x["name"].alias("name"), x["count"].alias("count"), x["s"]["base_key"].alias("base_key"), x["s"]["exact_key"].alias("exact_key"), x["s"]["initials"].alias("initials"), name_penalty(x["name"], x["s"]["initials"]).alias("penalty"))
    spellings = F.transform(F.map_entries(F.coalesce("names", none)), lambda e: told(spelling(e["key"], e["value"])))
    affs = F.array_distinct(F.filter(F.transform(F.map_keys(F.coalesce("affiliations", none)), lambda a: affiliation_key(a)), lambda a: a != ""))
    rows = buckets.select("key", F.col(order).alias("at"), person_signature("name")["base_key"].alias("base"), spellings.alias("spellings"), affs.alias("affs")).where(F.trim(blank("key")) != "")
    rows = checkpoint(rows)
    open_bases = rows.where(F.size("affs") == 0).select("base").distinct().withColumn("open", F.lit(True))
    within = F.when(F.col("open"), F.array(F.concat_ws("\x1f", F.col("base"), F.lit("*")))).otherwise(F.transform("affs", lambda a: F.concat_ws("\x1f", F.col("base"), a)))
    linked = rows.join(open_bases, "base", "left").select("key", within.alias("keys")).where(F.size("keys") > 0)
    parts = key_components(linked, "key", "keys")
    sized = parts.join(parts.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "component")  # the others are alone
    several = rows.join(sized.withColumnRenamed("id", "key"), "key")

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        done = merged_in_order([Bucket(r) for r in pdf.sort_values("at", kind="stable").itertuples(index=False, name="Row")])
        return pd.DataFrame([(k, b.keys[0]) for b in done for k in b.keys], columns=["key", "merged_key"])

    met = several.groupBy("component").applyInPandas(part, "key string, merged_key string")
    return rows.select("key").join(met, "key", "left").select("key", F.coalesce("merged_key", "key").alias("merged_key"))


def merged(buckets: DataFrame, order: str = "key") -> DataFrame:
    """One row a person of buckets (key, name, names, affiliations, talk_names, paper_names, talk_count, paper_count, citation_count): counts and frequencies added up, and the spellings chosen anew (ER-06, ER-07).

    Sums and frequencies are aggregations, partial before the shuffle.
    """
    of = classes(buckets, order)
    rows = buckets.join(of, "key")
    out = rows.groupBy("merged_key").agg(F.array_sort(F.collect_set("key")).alias("keys"), *(F.sum(c).alias(c) for c in SUMS))
    for m in MAPS:
        each = rows.select("merged_key", F.explode(m).alias("k", "n")).groupBy("merged_key", "k").agg(F.sum("n").alias("n"))
        more = [F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(m)]
        if m != "affiliations":
            score = F.col("n") * 100 - name_penalty(F.col("k"), person_signature("k")["initials"])
            more.append(F.min_by("k", F.struct((-score).alias("s"), "k")).alias(f"best_{m}"))
        out = out.join(each.groupBy("merged_key").agg(*more), "merged_key", "left")
    best = F.coalesce("best_names", F.lit(""))
    return out.select("merged_key", "keys", *SUMS, (F.col("talk_count") + F.col("paper_count")).alias("total_count"), best.alias("name"), F.coalesce("best_talk_names", best).alias("talk_name"), F.coalesce("best_paper_names", best).alias("paper_name"), *MAPS)
