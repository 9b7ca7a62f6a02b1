"""What a page of results is asked for, as a value; changes to it are pure functions."""

from __future__ import annotations

from dataclasses import dataclass, replace
from urllib.parse import parse_qsl, urlencode

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _key(value: str) -> str:
    return "".join(c for c in value.lower() if c.isalnum() or c == "+")


@dataclass(frozen=True)
class SearchSpec:
    """Query, filters and order (RTE-01, RTE-02)."""

    query: str = ""
    person: str = ""
    topics: tuple[str, ...] = ()
    years: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    meeting: str = ""
    has_video: bool = False
    has_slides: bool = False
    sort: str = "relevance"
    years_touched: bool = False

    @classmethod
    def parse(cls, query_string: str) -> SearchSpec:
        """From an address; of equal names the last counts, lists are separated by commas, older names are understood."""
        p = dict(parse_qsl(query_string.lstrip("?"), keep_blank_values=True))
        some = lambda *names: next((p[n].strip() for n in names if p.get(n, "").strip()), "")
        many = lambda *names: tuple(dict.fromkeys(x.strip() for x in some(*names).split(",") if x.strip()))
        return cls(some("q", "query"), some("speaker", "author", "person"), many("topics", "topic", "tag"), many("years", "year"), many("categories", "category"), some("meeting"), some("video") == "1", some("slides") == "1", some("sort") or "relevance")

    def to_query_string(self) -> str:
        pairs = [("q", self.query), ("speaker", self.person), ("topics", ",".join(self.topics)), ("years", ",".join(self.years)), ("categories", ",".join(self.categories)), ("meeting", self.meeting), ("video", "1" * self.has_video), ("slides", "1" * self.has_slides), ("sort", "" if self.sort == "relevance" else self.sort)]
        return urlencode([(k, v) for k, v in pairs if v])

    def add_topic(self, topic: str) -> SearchSpec:
        """RTE-09."""
        return self if _key(topic) in map(_key, self.topics) or not topic.strip() else replace(self, topics=(*self.topics, topic.strip()))

    def remove_topic(self, topic: str) -> SearchSpec:
        """A query that is the topic goes with it (RTE-09)."""
        return replace(self, topics=tuple(x for x in self.topics if _key(x) != _key(topic)), query="" if _key(self.query) == _key(topic) else self.query)

    def toggle_topic(self, topic: str) -> SearchSpec:
        return self.remove_topic(topic) if _key(topic) in map(_key, self.topics) else self.add_topic(topic)

    def with_years(self, years: tuple[str, ...]) -> SearchSpec:
        """A meeting of a year that isn't chosen any more goes (RTE-10, FLT-17)."""
        keep = not years or not self.meeting or self.meeting[:4] in years
        return replace(self, years=years, years_touched=True, meeting=self.meeting if keep else "")

    def with_meeting(self, slug: str) -> SearchSpec:
        """Years go too, unless the user chose them (RTE-10)."""
        return replace(self, meeting=slug, years=self.years if self.years_touched else ())

    def selected(self, kind: str, value: str) -> SearchSpec:
        """After a choice among completions (RTE-11)."""
        return {"topic": replace(self, query=value, topics=(value,)), "person": replace(self, query=value, person=value)}.get(kind, replace(self, query=value))

    def cross_selection(self) -> tuple[str, str] | None:
        """RTE-12: the person or topic that another corpus can be asked for."""
        if self.person:
            return "person", self.person
        if len(self.topics) == 1 and _key(self.topics[0]) == _key(self.query):
            return "topic", self.topics[0]
        return None

    def active_filters(self, papers: bool = False) -> int:
        """RTE-13: on papers a query that is an active topic doesn't count."""
        query = bool(self.query) and not (papers and _key(self.query) in map(_key, self.topics))
        return query + bool(self.person) + len(self.topics) + len(self.years) + len(self.categories) + bool(self.meeting) + self.has_video + self.has_slides


def initial_query(query_string: str) -> tuple[str, str]:
    """(mode, query) of the page on all works: a search, or the works of a person or topic (RTE-03, RTE-06)."""
    p = dict(parse_qsl(query_string.lstrip("?")))
    if p.get("mode") == "search" and p.get("q", "").strip():
        return "search", p["q"].strip()
    for name in ("q", "value", "speaker"):
        if p.get(name, "").strip():
            return "entity" if name != "q" else "search", p[name].strip()
    first = next((x.strip() for x in p.get("tag", p.get("tags", "")).split(",") if x.strip()), "")
    return ("entity", first) if first else ("browse", "")


def exact_entry(entries: DataFrame, value: str) -> DataFrame:
    """RTE-07, RTE-08: entries whose label is the value, case and spaces aside."""
    return entries.where(F.lower(F.trim("label")) == value.strip().lower())


def routes_to_all(entries: DataFrame, query: str, local: str, n_local: int, n_other: int) -> bool:
    """RTE-04: whether a query is better asked of all works: it names what only another corpus (entries: corpus, label) has, or finds nothing here but something there."""
    named = {r["corpus"] for r in exact_entry(entries, query).select("corpus").distinct().collect()}  # corpora, a handful
    return (bool(named) and local not in named) or (n_local == 0 and n_other > 0)


def label_key(c: str) -> F.Column:
    """How labels and queries are compared: case, spaces and signs aside."""
    return F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), "[^a-z0-9+]+", "")


def resolved_topics(queries: DataFrame, query: str, topics: DataFrame, label: str) -> DataFrame:
    """queries with `topic`: the vocabulary's spelling of the topic that a free query is, else null (RTE-08); of several spellings the first by alphabet."""
    known = topics.select(label_key(label).alias("__k"), F.col(label).alias("topic")).where("__k <> ''").groupBy("__k").agg(F.min("topic").alias("topic"))
    return queries.withColumn("__k", label_key(query)).join(known, "__k", "left").drop("__k")


def routed(queries: DataFrame, query: str, entries: DataFrame, local: str, n_local: str, n_other: str) -> DataFrame:
    """queries with `to_all`: routes_to_all() of each, by a join with the entries (corpus, label) (RTE-04)."""
    key = lambda c: F.lower(F.trim(c))
    named = entries.groupBy(key("label").alias("__k")).agg(F.max((F.col("corpus") == local).cast("int")).alias("__here"))
    j = queries.withColumn("__k", key(query)).join(named, "__k", "left")
    return j.withColumn("to_all", (F.coalesce(F.col("__here") == 0, F.lit(False))) | ((F.col(n_local) == 0) & (F.col(n_other) > 0))).drop("__k", "__here")


def apply(df: DataFrame, spec: SearchSpec, people: str, topics: str, year: str, category: str, meeting: str, video: str, slides: str) -> DataFrame:
    """df filtered by a spec's facets, in one chain that reaches the scan where it can (FLT-01, FLT-02)."""
    from quillstack.functions.keys import person_signature, same_person
    from quillstack.functions.text import blank

    out = df
    if spec.years:
        out = out.where(F.col(year).isin(*spec.years))
    if spec.categories:
        out = out.where(F.col(category).isin(*spec.categories))
    if spec.meeting:
        out = out.where(F.col(meeting) == spec.meeting)
    if spec.has_video:
        out = out.where(F.trim(blank(video)) != "")
    if spec.has_slides:
        out = out.where(F.trim(blank(slides)) != "")
    if spec.topics:
        wanted = [_key(x) for x in spec.topics]
        out = out.where(F.exists(topics, lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9+]+", "").isin(*wanted)))
    if spec.person:
        target = person_signature(F.lit(spec.person))
        out = out.where(F.exists(people, lambda p: same_person(person_signature(p), target)))
    return out
