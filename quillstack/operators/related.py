"""Related items: the best few of the same group, then those with the most labels in common.

Items are ranked by labels in common, then by an order of their own (newest first), so of all items that
share just one set of labels with another only the first few in that order can be among its best.  A
posting list is kept for each set of labels that an item holds (of its subsets, not of its labels alone), and
of each list only so many entries as can matter: a label that most items have has a list as short as any other.
An item's best are among the lists of its own subsets.  Lists are cut before they are shuffled.

Items with more than NARROW labels would have too many subsets.  They and the others meet through single labels
instead, of each item only as many, the rarest first, as must hold a common one (prefix filtering); lists of
labels that many items have are dealt out in parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labels of an item whose subsets are listed (1023 at most); postings of one part of a wide item's list.
NARROW, PART = 10, 10_000


def subsets(labels: str) -> Column:
    """All subsets of an array but the empty one."""
    masks = F.sequence(F.lit(1), F.expr(f"shiftleft(1, size(`{labels}`)) - 1"))
    return F.transform(masks, lambda m: F.filter(labels, lambda _, i: F.getbit(m, i) == 1))


def key_of(labels: Column) -> Column:
    return F.unhex(F.md5(F.array_join(labels, "\x1f")))


def first_of(df: DataFrame, key: str, order: list[Column], k: int, entry: Column, name: str) -> DataFrame:
    """(key, name): of each key the first k entries in an order; no more than k of a key leave a task."""
    by = ", ".join(f"__o{i}" for i in range(len(order)))
    ranked = df.withColumns({f"__o{i}": c for i, c in enumerate(order)}).select(key, entry.alias("__e"), F.expr(f"row_number() OVER (PARTITION BY `{key}` ORDER BY {by})").alias("__n")).where(F.col("__n") <= k)
    return ranked.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", "__e"))), lambda x: x["__e"]).alias(name))


def by_labels(items: DataFrame, id_col: str, labels: Column, group: str, year: Column, title: str, per_group: int = 4, total: int = 6) -> DataFrame:
    """(id, other, rank): up to per_group of the same group in the order of ids, then by labels in common, newest first, by title and id, up to total (JON-15, JON-16).

    Ids are unique.  Labels that are null or repeat count once or not at all; items without labels have relatives of
    their group only, those with a null group none of it.  A null year is the oldest, a null title the first.
    """
    base = items.select(F.col(id_col).alias("id"), F.col(group).alias("g"), F.coalesce(year, F.lit(0)).alias("y"), F.coalesce(title, F.lit("")).alias("t"), F.array_sort(F.array_distinct(F.array_compact(labels))).alias("ls"))
    spare = total + per_group + 1  # itself and those of its group may be among the best
    order = [-F.col("y"), F.col("t"), F.col("id")]
    entry = F.struct(F.col("id").alias("other"), (-F.col("y")).alias("y"), "t", "ls")
    mates = first_of(base.where("g IS NOT NULL"), "g", [F.col("id")], per_group + 1, F.col("id"), "mates")

    narrow = base.where(F.size("ls").between(1, NARROW))
    lists = first_of(narrow.select("*", F.explode(subsets("ls")).alias("s")).withColumn("k", key_of(F.col("s"))), "k", order, spare, entry, "some")
    sets = base.select("ls").where(F.size("ls") > 0).distinct()  # what is related depends on labels alone, but for the item itself
    asked = sets.where(F.size("ls") <= NARROW).select("ls", F.explode(subsets("ls")).alias("s")).select("ls", key_of(F.col("s")).alias("k"))
    found = asked.join(lists, "k").select("ls", F.explode("some").alias("e"))
    if not base.where(F.size("ls") > NARROW).isEmpty():
        found = found.unionByName(through_labels(base, sets, entry, order, spare))
    common = F.size(F.array_intersect("ls", F.col("e.ls")))
    pairs = found.select("ls", F.struct((-common).alias("n"), F.col("e.y").alias("y"), F.col("e.t").alias("t"), F.col("e.other").alias("other")).alias("e")).distinct()
    best = first_of(pairs.withColumn("k", key_of(F.col("ls"))), "k", [F.col("e")], spare, F.col("e.other"), "best")

    none = F.array().cast(f"array<{base.schema['id'].dataType.simpleString()}>")
    own = base.select("id", "g", key_of(F.col("ls")).alias("k")).join(mates, "g", "left").join(best, "k", "left")
    first = F.slice(F.array_remove(F.coalesce("mates", none), F.col("id")), 1, per_group)
    rest = F.array_except(F.array_remove(F.coalesce("best", none), F.col("id")), F.col("first"))
    ranked = own.withColumn("first", first).select("id", F.slice(F.concat("first", rest), 1, total).alias("others"))
    return ranked.select("id", F.posexplode("others").alias("rank", "other")).select("id", "other", (F.col("rank") + 1).alias("rank"))


def through_labels(base: DataFrame, sets: DataFrame, entry: Column, order: list[Column], spare: int) -> DataFrame:
    """(ls, e) of sets and items of which either has more than NARROW labels: all that can be among the sets' best.

    The first entries of each label's list hold whatever has one label in common and can matter; they also say how many
    the last of a set's best has at least.  What has so many (two or more) holds one of the set's other labels, the
    rarest: only their lists are met in full.
    """
    is_wide = F.size("ls") > NARROW
    each = base.select("*", F.explode("ls").alias("l"), is_wide.alias("w"))
    often = each.groupBy("l").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / PART).cast("int"))
    asked = sets.select("ls", is_wide.alias("pw"), F.explode("ls").alias("l"))
    heads = first_of(each, "l", order, spare, entry, "some")
    first = asked.join(heads, "l").select("ls", F.explode("some").alias("e")).distinct()
    common = F.size(F.array_intersect("ls", F.col("e.ls")))
    nth = F.expr("row_number() OVER (PARTITION BY ls ORDER BY common DESC)")
    least = first.withColumn("common", common).select("ls", "common", nth.alias("nth")).where(F.col("nth") == spare).select("ls", "common")
    probes = asked.join(often, "l").groupBy("ls", "pw").agg(F.array_sort(F.collect_list(F.struct("n", "l", "parts"))).alias("by")).join(least, "ls", "left")
    need = F.greatest(F.lit(2), F.coalesce("common", F.lit(0)))
    probes = probes.select("ls", "pw", need.alias("need"), F.explode(F.slice("by", F.lit(1), F.greatest(F.lit(0), F.size("by") - need + 1))).alias("b"))
    probes = probes.select("ls", "pw", "need", F.col("b.l").alias("l"), F.explode(F.sequence(F.lit(0), F.col("b.parts") - 1)).alias("part"))
    postings = each.join(often, "l").select("l", "w", entry.alias("e"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    met = probes.join(postings, ["l", "part"]).where((F.col("pw") | F.col("w")) & (common >= F.col("need")))
    return first.unionByName(met.select("ls", "e")).distinct()
