"""Snapshots, what changed between them, and the log of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstack.functions.text import blank


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key (INC-03)."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("__r = 1").drop("__r")


def filled(c: Column | str) -> Column:
    """FLT-15."""
    return F.trim(blank(c)) != ""


def diff(current: DataFrame, previous: DataFrame, key: str, watched: dict[str, str], new_part: str, kind: str) -> DataFrame:
    """(key, parts, fingerprint) of rows that are new, or whose watched columns went from blank to filled (INC-01, 02, 04, JON-08, 09).

    One entry a row, its parts in the order of `watched` after new_part; a row without news has none.
    """
    prev = previous.select(F.col(key), F.lit(True).alias("__was"), *(filled(c).alias(f"__{p}") for p, c in watched.items()))
    j = current.join(prev, key, "left")
    new = F.col("__was").isNull()
    parts = F.array_compact(F.array(F.when(new, F.lit(new_part)), *(F.when(filled(c) & ~F.coalesce(F.col(f"__{p}"), F.lit(False)), F.lit(p)) for p, c in watched.items())))
    out = j.select(key, parts.alias("parts")).where(F.size("parts") > 0)
    return out.withColumn("fingerprint", F.concat_ws(":", F.lit(kind), F.col(key).cast("string"), F.array_join("parts", "+")))


def append_log(log: DataFrame | None, entries: DataFrame, order: list[Column]) -> DataFrame:
    """The log with the entries that it doesn't hold, the first of equal fingerprints (INC-08, SNK-03, JON-10)."""
    w = Window.partitionBy("fingerprint").orderBy(*order)
    once = entries.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    if log is None:
        return once
    return log.unionByName(once.join(log.select("fingerprint"), "fingerprint", "left_anti"), allowMissingColumns=True)


def sort_log(log: DataFrame) -> DataFrame:
    """SRT-02."""
    return log.orderBy(F.desc("logged_at"), F.desc("sort_hint"), F.desc("title"))


def replay(snapshots: DataFrame, key: str, ordinal: str, watched: dict[str, str], new_part: str, kind: str) -> DataFrame:
    """diff() of each snapshot against the one before, in one pass over all (INC-06, INC-07).

    A row is compared with its key's row in the snapshot just before, if it was there.
    """
    w = Window.partitionBy(key).orderBy(ordinal)
    prev = F.lag(ordinal).over(w) == F.col(ordinal) - 1
    before = {p: F.coalesce(F.lag(filled(c)).over(w) & prev, F.lit(False)) for p, c in watched.items()}
    rows = snapshots.withColumns({"__new": ~F.coalesce(prev, F.lit(False)), **{f"__{p}": b for p, b in before.items()}})
    parts = F.array_compact(F.array(F.when(F.col("__new"), F.lit(new_part)), *(F.when(filled(c) & ~F.col(f"__{p}"), F.lit(p)) for p, c in watched.items())))
    out = rows.select(key, ordinal, parts.alias("parts")).where(F.size("parts") > 0)
    return out.withColumn("fingerprint", F.concat_ws(":", F.lit(kind), F.col(key).cast("string"), F.array_join("parts", "+")))


def changed_files(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(path, change) of files (path, content) that were added, removed or altered (SRC-21)."""
    a = current.select("path", F.sha2("content", 256).alias("now"))
    b = previous.select("path", F.sha2("content", 256).alias("was"))
    j = a.join(b, "path", "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "modified")
    return j.select("path", change.alias("change")).where("change is not null")


def needs_probe(cache_status: Column, cache_source: Column, source: Column, cached_at: Column, cached_text: Column, days: int, now: Column) -> Column:
    """INC-09, FLT-13: a hit when its source changed, a miss when its source changed or it is old, no entry without text."""
    moved = F.coalesce(cache_source, F.lit("")) != F.coalesce(source, F.lit(""))
    old = F.coalesce(cached_at < now - F.expr(f"interval {days} days"), F.lit(True))
    return F.when(cache_status == "hit", moved).when(cache_status == "miss", moved | old).otherwise(~filled(cached_text))


def within_budget(probes: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first `most` rows that ask for a probe, the others are skipped in this run (WIN-04)."""
    return probes.orderBy(*order).limit(most)


def backfill_statistics(papers: DataFrame, work: Column, loaded: Column, before: Column, after: Column) -> DataFrame:
    """One row: papers, those with a work's id, with the work at hand, and changed by it (AGG-11)."""
    has = filled(work)
    return papers.agg(F.count("*").alias("papers_total"), F.count_if(has).alias("papers_with_work_id"), F.count_if(has & loaded).alias("papers_with_work_loaded"), F.count_if(has & loaded & ~before.eqNullSafe(after)).alias("papers_changed"))


def enrichment_totals(papers: DataFrame, tags: str, keywords: str, old_tags: str, old_keywords: str) -> DataFrame:
    """One row: papers, those changed, with tags, with keywords (AGG-12)."""
    some = lambda c: F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) > 0
    changed = ~(F.col(tags).eqNullSafe(F.col(old_tags)) & F.col(keywords).eqNullSafe(F.col(old_keywords)))
    return papers.agg(F.count("*").alias("papers"), F.count_if(changed).alias("changed"), F.count_if(some(tags)).alias("with_tags"), F.count_if(some(keywords)).alias("with_keywords"))


def event_json_path(path: Column | str, folder: str) -> Column:
    """FLT-16: a bundle of events in their folder, not their index."""
    p = blank(path)
    return p.startswith(f"{folder.rstrip('/')}/") & p.endswith(".json") & ~p.endswith("index.json")


def paper_json_path(path: Column | str, folder: str) -> Column:
    """FLT-16: a bundle of papers in their folder, not its index."""
    p, at = blank(path), folder.rstrip("/")
    return p.startswith(f"{at}/") & p.endswith(".json") & (p != f"{at}/index.json")
