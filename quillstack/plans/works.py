"""Registered queries of ranking, filters, orders, merging and run statistics."""

from __future__ import annotations

from urllib.parse import urlencode

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.functions import keys as ky
from quillstack.operators import changes, documents, facets, keywords, records, search
from quillstack.operators.numbering import numbered

from .registry import ORACLE_SQL, query, t
from .spec import SearchSpec, apply, initial_query, resolved_topics, routed
from .texts import say

# --- ranking ---------------------------------------------------------------------------------------------


def _hit(field: str, token: str, worth: int) -> str:
    return f"CASE WHEN strpos(lower({field}), '{token}') > 0 THEN {worth} ELSE 0 END"


def _title(field: str, token: str, worth: int) -> str:
    return f"CASE strpos(lower({field}), '{token}') WHEN 0 THEN 0 WHEN 1 THEN {2 * worth} ELSE {worth} END"


def _sum(tokens: tuple[str, ...], parts: list[tuple[str, int]]) -> list[str]:
    return ["(" + " + ".join(_title(f, k, w) if i == 0 else _hit(f, k, w) for i, (f, w) in enumerate(parts)) + ")" for k in tokens]


TOKENS = ("widget", "o")
PAPER = [("p_name", 50), ("p_brand", 34), ("p_type", 20), ("p_type", 16), ("p_name", 12), ("p_brand", 10), ("p_type", 8), ("p_type", 6), ("p_size::VARCHAR", 6)]
ALL_WORKS = [p for i, p in enumerate(PAPER) if i != 7]
COUNTED = [("p_name", 50), ("p_brand", 34), ("p_type", 20), ("p_name", 12), ("p_brand", 10), ("p_type", 8), ("p_type", 6), ("p_size::VARCHAR", 6)]
FIELDS = {"title": "p_name", "authors": "p_brand", "tags": "p_type", "keywords": "p_type", "abstract": "p_name", "publication": "p_brand", "venue": "p_type", "type": "p_type", "year": "p_size"}


def _fields(*but: str) -> dict:
    return {k: F.col("p_size").cast("string") if k == "year" else F.col(v) for k, v in FIELDS.items() if k not in but}


def _ranked(parts: list[tuple[str, int]], recent: str) -> str:
    a, b = _sum(TOKENS, parts)
    return f"CASE WHEN {a} > 0 AND {b} > 0 THEN {a} + {b} + {recent} ELSE 0 END"


@query(f"""
    SELECT p_partkey, round({_ranked(PAPER, "(2000 + p_size - 2002) * 0.1")}, 6)::DOUBLE AS papers, round({_ranked(ALL_WORKS, "(2000 + p_size - 2002) * 0.01")}, 6)::DOUBLE AS all_works, ({_ranked(COUNTED, "0")})::DOUBLE AS counted FROM part
""")
def paper_scores(spark: SparkSession, sf: str) -> DataFrame:
    """RNK-03, RNK-04, RNK-05."""
    year, tokens = F.col("p_size") + 2000, list(TOKENS)
    papers = search.exact_score(tokens, _fields(), search.PAPER_WEIGHTS, year, search.PAPER_EPOCH)
    all_works = search.exact_score(tokens, _fields("type"), search.ALL_WORK_WEIGHTS, year, search.PAPER_EPOCH, 0.01)
    counted = search.exact_score(tokens, _fields("keywords"), search.PAPER_WEIGHTS)
    return t(spark, sf, "part").select("p_partkey", F.round(papers, 6).alias("papers"), F.round(all_works, 6).alias("all_works"), counted.alias("counted"))


@query("""
    SELECT p_partkey, ((14 + CASE WHEN split_part(p_name, ' ', 2) = 'widget' THEN 0 ELSE NULL END) + 18)::DOUBLE AS score, 'fuzzy' AS mode FROM part WHERE p_name LIKE '% widget' AND p_type = 'PROMO'
""")
def fuzzy_papers(spark: SparkSession, sf: str) -> DataFrame:
    """RNK-08, RNK-09, RNK-10, TXT-13: "widgt" is a subsequence of the title's word (11 + 3), "prom" begins the type (16 + 2)."""
    return search.search(t(spark, sf, "part"), "widgt PROM", {"title": F.col("p_name"), "tags": F.col("p_type"), "publication": F.col("p_brand")}, search.PAPER_WEIGHTS).select("p_partkey", "score", "mode")


@query("""
    SELECT 'exact' AS mode, count(*) AS n FROM part WHERE p_name LIKE '%cold widget%' AND lower(p_brand) LIKE '%brand%' UNION ALL SELECT 'fuzzy', count(*) FROM part WHERE p_name LIKE '% widget' UNION ALL SELECT 'browse', 0
""")
def match_counts(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-10, TXT-13: a quoted phrase with a word, a misspelt word, and nothing asked."""
    p, fields = t(spark, sf, "part"), {"title": F.col("p_name"), "publication": F.col("p_brand")}
    out = [search.match_count(p, q, fields, search.PAPER_WEIGHTS) for q in ('"Cold Widget" brand', "widgt", " ")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 100 WHEN 1 THEN 95 WHEN 2 THEN 70 WHEN 3 THEN 45 ELSE 25 END AS quality FROM customer")
def name_qualities(spark: SparkSession, sf: str) -> DataFrame:
    """RNK-15: equal names, the same tokens in another order, all of the wanted ones, all of the found ones, some."""
    k = F.col("c_custkey") % 5
    found = F.when(k == 0, say("ann n{c_custkey}")).when(k == 1, say("N{c_custkey}, Ann")).when(k == 2, say("Ann Bo N{c_custkey}")).when(k == 3, F.lit("Ann")).otherwise(F.lit("Ann Other"))
    return t(spark, sf, "customer").select("c_custkey", search.name_match(say("Ann N{c_custkey}"), F.regexp_replace(found, ",", "")).cast("int").alias("quality"))


# --- filters and orders ------------------------------------------------------------------------------------


@query("""
    SELECT p_partkey FROM part WHERE p_type IN ('PROMO', 'ECONOMY') AND p_size BETWEEN 5 AND 44 AND p_partkey % 2 = 0 AND split_part(p_name, ' ', 2) IN ('widget', 'bolt') AND p_brand = 'Brand#19'
""")
def filtered_talks(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-01, FLT-02, RTE-01: years, categories, slides, topics (any of them) and a person, from an address."""
    spec = SearchSpec.parse("?topics=Widget,bolt&years=" + ",".join(map(str, range(5, 45))) + "&categories=PROMO,ECONOMY&slides=1&speaker=brand%2019")
    p = t(spark, sf, "part").withColumns({"people": F.array(F.lit("X Y"), F.replace("p_brand", F.lit("#"), F.lit(" "))), "topics": F.split("p_name", " "), "year": F.col("p_size").cast("string"), "slides": F.when(F.col("p_partkey") % 2 == 0, F.lit("s")).otherwise(F.lit(" ")), "video": F.lit("")})
    return apply(p, spec, "people", "topics", "year", "p_type", "p_brand", "video", "slides").select("p_partkey")


@query("""
    SELECT p_brand AS name, count(*) AS total_count, sum(p_size)::BIGINT AS citation_count FROM part WHERE p_brand LIKE '%1%' AND p_brand LIKE '%brand%' OR p_brand LIKE 'Brand#1%' GROUP BY 1 HAVING count(*) FILTER (p_partkey % 2 = 0) > 0 AND count(*) FILTER (p_partkey % 2 = 1) > 0
        AND count(DISTINCT p_type) > 1 ORDER BY citation_count DESC, lower(p_brand) LIMIT 5
""")
def people_listed(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-03, SRT-06: people with talks, papers and several spellings whose names hold all tokens, by citations."""
    p = t(spark, sf, "part").groupBy(F.col("p_brand").alias("name")).agg(F.count_if(F.col("p_partkey") % 2 == 0).alias("talk_count"), F.count_if(F.col("p_partkey") % 2 == 1).alias("paper_count"), F.count("*").alias("total_count"), F.sum("p_size").alias("citation_count"), F.collect_set("p_type").alias("names"))
    some = facets.filter_people(p, ["brand#1", "1"], "name", talks=True, papers=True, merged=True)
    return facets.sort_people(some, "citations").limit(5).select("name", "total_count", "citation_count")


def _order(by: str) -> str:
    return f"(SELECT p_partkey, row_number() OVER (ORDER BY {by}) AS r FROM part)"


@query(f"""
    SELECT p_partkey, a.r::INTEGER AS newest, b.r::INTEGER AS oldest, c.r::INTEGER AS title, d.r::INTEGER AS stored FROM {_order("p_brand DESC, p_name, lpad(p_partkey::VARCHAR, 9, '0')")} a JOIN {_order("p_brand, p_name, lpad(p_partkey::VARCHAR, 9, '0')")} b USING (p_partkey)
    JOIN {_order("p_name, p_brand DESC, lpad(p_partkey::VARCHAR, 9, '0')")} c USING (p_partkey) JOIN {_order("CASE WHEN p_size % 2 = 0 THEN 2000 + p_size ELSE 0 END DESC, p_name DESC, lpad(p_partkey::VARCHAR, 9, '0') DESC")} d USING (p_partkey) WHERE least(a.r, b.r, c.r, d.r) <= 50
""")
def item_orders(spark: SparkSession, sf: str) -> DataFrame:
    """SRT-01, SRT-03, SRT-04: the first 50 of each order, with their places in all (a report: the orders number the whole table)."""
    p = t(spark, sf, "part").select("p_partkey", "p_brand", "p_name", F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("id"), F.when(F.col("p_size") % 2 == 0, (F.col("p_size") + 2000).cast("string")).otherwise(F.lit("n/a")).alias("year"))
    orders = {m: search.talk_order(m, "p_brand", "p_name", "id", locale=None) for m in search.TALK_ORDERS} | {"stored": search.paper_order("year", "p_name", "id")}
    for name, keys in orders.items():
        p = numbered(p, keys, name)
    return p.where(F.least(*orders) <= 50).select("p_partkey", *(F.col(o).cast("int").alias(o) for o in orders))


# Words with capitals and accents, in the order of the root locale.
WORDS = ("abend", "Abend", "äbend", "Äbend", "abends", "cote", "Cote", "coté", "côte", "Côte", "côté", "Naive", "naïve", "öl", "Öl", "zebra", "Zebra")


@query(f"""
    WITH w AS (SELECT p_partkey, p_partkey % {len(WORDS)} + 1 AS rank FROM part)
    SELECT p_partkey, (['{"', '".join(WORDS)}'])[rank] AS word, row_number() OVER (ORDER BY rank, p_partkey)::BIGINT AS place FROM w
""")
def locale_order(spark: SparkSession, sf: str) -> DataFrame:
    """SRT-07: all parts under words with capitals and accents, in the order of a locale; the SQL goes by the words' known ranks."""
    word = F.element_at(F.array(*(F.lit(w) for w in WORDS)), (F.col("p_partkey") % len(WORDS) + 1).cast("int"))
    w = t(spark, sf, "part").select("p_partkey", word.alias("word"))
    return numbered(w, [F.collate("word", "UNICODE"), F.col("p_partkey")]).select("p_partkey", "word", "place")


@query("SELECT event_id, event_type FROM events QUALIFY row_number() OVER (ORDER BY ts DESC, user_id DESC, event_type DESC) <= 100")
def log_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """SRT-02, SRC-22, DAT-07: the newest 100 entries of a log, times read from text."""
    from quillstack.functions.fields import iso_timestamp

    e = t(spark, sf, "events").select("event_id", "event_type", iso_timestamp(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("logged_at"), F.col("user_id").alias("sort_hint"), F.col("event_type").alias("title"))
    return changes.sort_log(e).limit(100).select("event_id", "event_type")


@query("""
    WITH p AS (SELECT p_partkey, p_size % 4 AS k FROM part)
    SELECT p_partkey, k < 2 AS post, k NOT IN (0, 1, 2) AS research, k <> 2 AS allowed, k = 3 AS meeting, k IN (0, 1) AS disabled, k = 0 AS event_file, k = 1 AS paper_file FROM p
""")
def small_predicates(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-05, FLT-06, FLT-10, FLT-11, FLT-16, FLT-18."""
    k = F.col("p_size") % 4
    source, kind = F.when(k == 0, F.lit(" Blog ")).otherwise(F.lit("web")), F.when(k == 1, F.lit("blog-post")).when(k == 2, F.lit("News-Post")).otherwise(F.lit(""))
    flag, place = F.when(k == 0, F.lit(True)), F.when(k == 1, F.lit("Town (CANCELLED)")).otherwise(F.lit("Town"))
    name = F.when(k == 2, F.lit("Another Series")).otherwise(say("{p_name} Developers' Meeting"))
    path = F.when(k == 0, say("site/events/{p_size}.json")).when(k == 1, say("papers/{p_size}.json")).when(k == 2, F.lit("site/events/index.json")).otherwise(F.lit("papers/index.json"))
    return t(spark, sf, "part").select(
        "p_partkey", facets.is_post(source, kind, "blog").alias("post"), facets.research_like(source, kind, "blog").alias("research"), facets.allowed_type(kind, ["blog-post"]).alias("allowed"), facets.named_meeting(flag, place, name, "Developers' Meeting").alias("meeting"),
        facets.card_disabled(flag, place, F.when(k == 2, 0).otherwise(1), F.lit(1)).alias("disabled"), changes.event_json_path(path, "site/events").alias("event_file"), changes.paper_json_path(path, "papers").alias("paper_file"),
    )


@query("""
    SELECT p_partkey, split_part(p_brand, '#', 2) = '13' AS speaker, p_name LIKE '% widget' AS topic, p_size % 3 = 0 AS slides, CASE p_size % 3 WHEN 0 THEN p_partkey % 2 = 1 WHEN 1 THEN TRUE ELSE p_partkey % 2 = 0 END AS probe FROM part
""")
def entity_and_probe_tests(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-12, FLT-13, FLT-15, INC-09: a hit whose source moved, an old miss, and no entry with or without a text."""
    k, even = F.col("p_size") % 3, F.col("p_partkey") % 2 == 0
    now = F.lit("2024-01-31").cast("timestamp")
    probe = changes.needs_probe(F.when(k == 0, "hit").when(k == 1, "miss"), F.lit("s1"), F.when((k == 0) & ~even, "s2").otherwise("s1"), F.lit("2023-01-01").cast("timestamp"), F.when(even, F.lit(" ")).otherwise(F.col("p_name")), 30, now)
    people = F.array(F.replace("p_brand", F.lit("#"), F.lit(" ")))
    return t(spark, sf, "part").select("p_partkey", facets.matches_entity("speaker", "BRAND 13", people, F.split("p_name", " ")).alias("speaker"), facets.matches_entity("topic", " Widget ", people, F.split("p_name", " ")).alias("topic"), changes.filled(F.when(k == 0, "x").otherwise(" ")).alias("slides"), probe.alias("probe"))


# --- records and people ----------------------------------------------------------------------------------


@query("""
    WITH p AS (SELECT p_brand AS g, p_partkey AS k, p_size % 4 AS n, p_name FROM part)
    SELECT g AS component, count(*) AS members, min(k) AS best_id, arg_min(CASE n WHEN 0 THEN '' WHEN 1 THEN 'A. Bc' WHEN 2 THEN 'Ann Long|Bo Short' ELSE 'Ann Longer|Bo Shorter' END, CASE WHEN n >= 2 THEN 0 WHEN n = 1 THEN 1 ELSE 2 END * 1000000000 + k) AS authors,
        coalesce(arg_min(p_name, k) FILTER (n = 1), '') AS abstract FROM p GROUP BY 1
""")
def merged_author_lists(spark: SparkSession, sf: str) -> DataFrame:
    """ER-03, ER-04, RNK-12, RNK-13: parts of a brand as one record, led by the first of the best, with the first of the best author lists."""
    n = F.col("p_size") % 4
    authors = F.when(n == 0, F.array().cast("array<string>")).when(n == 1, F.array(F.lit("A. Bc"))).when(n == 2, F.array(F.lit("Ann Long"), F.lit("Bo Short"))).otherwise(F.array(F.lit("Ann Longer"), F.lit("Bo Shorter"), F.lit(" ")))
    p = t(spark, sf, "part").select("p_partkey", F.array("p_brand").alias("keys"), "p_brand", authors.alias("authors"), F.when(n == 1, F.col("p_name")).otherwise(F.lit(" ")).alias("abstract"))
    none = F.lit("")
    q = records.record_quality(F.lit(1), none, none, none, none, F.array(), F.lit(0), F.array())
    m = records.merge_duplicates(p, "p_partkey", "keys", "p_partkey", q, ["abstract", "p_brand"], [], [], authors="authors")
    clean = F.coalesce(F.array_join(F.filter("authors", lambda a: F.trim(a) != ""), "|"), F.lit(""))
    return m.select(F.col("p_brand").alias("component"), "members", "best_id", clean.alias("authors"), F.coalesce("abstract", F.lit("")).alias("abstract"))


@query("""
    WITH n AS (SELECT c_nationkey AS nation, CASE WHEN c_custkey % 3 = 0 THEN upper(c_mktsegment) ELSE lower(c_mktsegment) END AS name, count(*) AS n FROM customer GROUP BY 1, 2),
    f AS (SELECT *, row_number() OVER (PARTITION BY nation, lower(name) ORDER BY n DESC, name) AS r FROM n)
    SELECT nation, string_agg(name, '|' ORDER BY n DESC, name) AS names FROM f WHERE r = 1 GROUP BY 1
""")
def variant_names(spark: SparkSession, sf: str) -> DataFrame:
    """ER-08."""
    name = F.when(F.col("c_custkey") % 3 == 0, F.upper("c_mktsegment")).otherwise(F.lower("c_mktsegment"))
    n = t(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nation"), name.alias("name")).count()
    return records.variant_names(n, "nation", "name", "count").select("nation", F.array_join("names", "|").alias("names"))


@query("""
    SELECT n_nationkey::BIGINT AS nation, v.v AS variant, CASE WHEN v.v IN (0, 1, 2) THEN 0 ELSE 3 END AS merged_with FROM nation, (VALUES (0), (1), (2), (3)) v(v)
""")
def merged_people(spark: SparkSession, sf: str) -> DataFrame:
    """ER-06, ER-07: a full name, one with an initial at the same place, one without a place, and another initial elsewhere."""
    n = t(spark, sf, "nation")
    at = lambda x: F.create_map(F.lit(x), F.lit(1).cast("long"))
    none = F.create_map().cast("map<string,bigint>")
    rows = n.select("n_nationkey", F.explode(F.array(*(F.struct(F.lit(i).alias("v"), name.alias("name"), a.alias("affiliations")) for i, (name, a) in enumerate([(say("Ann N{n_nationkey}"), at("Univ. of X")), (say("Ann Q. N{n_nationkey}"), at("University of X")), (say("Ann Quill N{n_nationkey}"), none), (say("Ann R. N{n_nationkey}"), at("Y"))])))).alias("p")).select("n_nationkey", "p.*")
    keyed = rows.withColumn("key", say("{n_nationkey}/{v}"))
    m = records.merge_name_variants(keyed.select("key", "name", F.create_map("name", F.lit(1).cast("long")).alias("names"), "affiliations"))
    part = lambda c, i: F.split(c, "/")[i]
    return m.select(part("key", 0).cast("long").alias("nation"), part("key", 1).cast("int").alias("variant"), part("merged_key", 1).cast("int").alias("merged_with"))


@query("""
    SELECT o_orderkey AS id, string_agg(DISTINCT 'Seed ' || l_suppkey, '|' ORDER BY 'Seed ' || l_suppkey) AS matched FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_suppkey % 5 = 0 GROUP BY 1
""")
def seed_matches(spark: SparkSession, sf: str) -> DataFrame:
    """JON-05: orders as works, their suppliers as authors, every fifth supplier a seed."""
    works = t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(say("S.{l_suppkey}!")).alias("authors")).join(t(spark, sf, "orders").select(F.col("o_orderkey").alias("id")), "id", "left_semi")
    seeds = t(spark, sf, "supplier").where("s_suppkey % 5 = 0").select(say("s {s_suppkey}").alias("key"), say("Seed {s_suppkey}").alias("label"))
    return records.matched_seeds(works, "id", "authors", seeds, "key", "label").select("id", F.array_join("matched", "|").alias("matched"))


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey = 42")
def one_by_id(spark: SparkSession, sf: str) -> DataFrame:
    """JON-14."""
    return search.by_id(t(spark, sf, "part"), "p_partkey", 42).select("p_partkey", "p_name")


@query("""
    WITH n AS (SELECT n_nationkey::BIGINT AS k, n_name FROM nation)
    SELECT 's' || k AS slug, CASE k % 3 WHEN 0 THEN n_name WHEN 1 THEN 'Remote ' || k ELSE 's' || k END AS name, CASE k % 3 WHEN 0 THEN 'Curated ' || k ELSE 'Hint ' || k END AS date, CASE k % 3 WHEN 0 THEN 'Hint ' || k ELSE 'Place ' || k END AS location FROM n
""")
def merged_meetings(spark: SparkSession, sf: str) -> DataFrame:
    """ER-10, INC-10, JON-18: curated values stay, what says nothing gives way, hints replace what was taken over from remote."""
    n = t(spark, sf, "nation").withColumn("k", F.col("n_nationkey") % 3)
    at = lambda i, c: F.when(F.col("k") == i, c)
    existing = n.where("k < 2").select(say("s{n_nationkey}").alias("slug"), at(0, F.col("n_name")).otherwise(F.lit("TBD")).alias("name"), at(0, say("Curated {n_nationkey}")).otherwise(F.lit("n/a")).alias("date"), at(0, say("Raw {n_nationkey}")).otherwise(say("Place {n_nationkey}")).alias("location"))
    remote = n.select(say("s{n_nationkey}").alias("slug"), at(2, F.lit(" ")).otherwise(say("Remote {n_nationkey}")).alias("name"), say("Raw {n_nationkey}").alias("date"), at(0, say("raw {n_nationkey}")).otherwise(say("Place {n_nationkey}")).alias("location"))
    hints = n.select(say("s{n_nationkey}").alias("slug"), say("Hint {n_nationkey}").alias("date"), at(0, say("Hint {n_nationkey}")).otherwise(F.lit(None)).alias("location"))
    return records.merged_meetings(existing, remote, hints)


@query("""
    WITH a AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'Old' ELSE 'New ' || p_size END AS abstract, CASE WHEN p_partkey % 3 = 2 THEN 'v' ELSE 'w' || p_size END AS video FROM part)
    SELECT id, abstract, video FROM a UNION ALL SELECT NULL, 'New ' || p_size, 'w' || p_size FROM part WHERE p_partkey % 7 = 0
""")
def talks_upserted(spark: SparkSession, sf: str) -> DataFrame:
    """INC-10, JON-04: blank abstracts are filled and links taken over, whole new talks come in, nothing goes."""
    p, k = t(spark, sf, "part"), F.col("p_partkey") % 3
    existing = p.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("seq"), say("{p_name}/{p_partkey}").alias("full"), say("{p_partkey}").alias("title"), F.when(k == 0, "Old").otherwise(" ").alias("abstract"), F.lit("v").alias("video"))
    remote = p.select(F.col("p_partkey").alias("seq"), F.when(k == 1, say("changed/{p_partkey}")).otherwise(say("{p_name}/{p_partkey}")).alias("full"), say("{p_partkey}").alias("title"), say("New {p_size}").alias("abstract"), F.when(k == 2, F.lit("")).otherwise(say("w{p_size}")).alias("video"))
    new = p.where("p_partkey % 7 = 0").select((F.col("p_partkey") + 10_000_000).alias("seq"), say("x/{p_partkey}").alias("full"), say("x{p_partkey}").alias("title"), say("New {p_size}").alias("abstract"), say("w{p_size}").alias("video"))
    return records.upserted_talks(existing, remote.unionByName(new), ["abstract"], ["video"], "full", "title", "seq", "id")


@query("""
    SELECT p_partkey AS paper, v.pos AS pos, v.a AS affiliation FROM part, (VALUES (1, 'by key'), (2, 'by signature'), (3, 'by place')) v(pos, a) WHERE v.pos < 3 OR p_partkey % 2 = 0
""")
def author_match_passes(spark: SparkSession, sf: str) -> DataFrame:
    """JON-02, all three passes: an equal name, an equal last name and initial, and, where both lists are as long, the same place and a fitting last name."""
    p = t(spark, sf, "part").select(F.col("p_partkey").alias("paper"))

    def people(rows: list[tuple[int, str, str, str]]) -> DataFrame:
        return p.select("paper", F.explode(F.array(*(F.struct(F.lit(pos).alias("pos"), F.lit(name).alias("name"), F.lit(last).alias("last"), F.lit(a).alias("affiliation")) for pos, name, last, a in rows))).alias("x")).select("paper", "x.*").withColumn("key", ky.name_key("name")).withColumn("signature", ky.name_signature("name"))

    paper = people([(1, "Ann Doe", "doe", ""), (2, "Bob Roe", "roe", ""), (3, "C. van Poe", "vanpoe", "")]).drop("affiliation")
    work = people([(2, "ann doe", "doe", "by key"), (1, "B. Roe", "roe", "by signature"), (3, "Dora Poe", "poe", "by place"), (4, "Eve Zoe", "zoe", "none")]).where((F.col("pos") < 4) | (F.col("paper") % 2 == 1))
    return records.match_authors(paper, work)


# --- runs -------------------------------------------------------------------------------------------------


@query("""
    SELECT count(*) AS papers_total, count(*) FILTER (p_size % 2 = 0) AS papers_with_work_id, count(*) FILTER (p_size % 6 = 0) AS papers_with_work_loaded, count(*) FILTER (p_size % 12 = 0) AS papers_changed,
        count(*) FILTER (p_size % 5 = 0) AS changed, count(*) AS with_tags, count(*) FILTER (p_size % 5 = 0) AS with_keywords FROM part
""")
def run_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-11, AGG-12."""
    s = F.col("p_size")
    p = t(spark, sf, "part")
    a = changes.backfill_statistics(p, F.when(s % 2 == 0, "W1").otherwise(" "), s % 3 == 0, F.lit("x"), F.when(s % 4 == 0, "y").otherwise("x"))
    none = F.array().cast("array<string>")
    e = p.withColumns({"tags": F.array("p_type"), "old_tags": F.array("p_type"), "keywords": F.when(s % 5 == 0, F.array("p_name")).otherwise(none), "old_keywords": none})
    b = changes.enrichment_totals(e, "tags", "keywords", "old_tags", "old_keywords").drop("papers")
    return a.crossJoin(b)  # one row each


@query("SELECT p_partkey FROM part WHERE p_size % 2 = 0 ORDER BY p_size, p_partkey LIMIT 30")
def probe_budget(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-04: the first 30 records that ask for a probe."""
    return changes.within_budget(t(spark, sf, "part").where("p_size % 2 = 0"), [F.col("p_size"), F.col("p_partkey")], 30).select("p_partkey")


LEXICON = keywords.Lexicon(stop=frozenset(("the", "of", "and", "de", "la")), noise=frozenset(("that",)), edges=frozenset(("with",)), technical=frozenset(("thing",)), unigram_noise=frozenset(("there",)), formats={"ir": "IR", "er": "ER"}, kept_endings=frozenset(("thing",)), technical_suffixes=("tion",))
_OK = r"(x NOT IN ('the', 'of', 'and', 'de', 'la', 'that') AND NOT regexp_matches(x, '^\d+[+]?$') AND NOT regexp_matches(regexp_replace(x, '[^a-z0-9]+', '', 'g'), '^\d*$') AND (length(regexp_replace(x, '[^a-z0-9]+', '', 'g')) > 2 OR x IN ('ir', 'er')))"


def _fragment(x: str) -> str:
    clean = rf"regexp_replace({x}, 'https?://\S+|[\r\n]+', ' ', 'g')"
    for _ in range(2):  # spaces where letters and digits meet signs; twice, as matches share a character
        clean = rf"regexp_replace(regexp_replace({clean}, '([A-Za-z0-9])([^A-Za-z0-9\s])', '\1 \2', 'g'), '([^A-Za-z0-9\s])([A-Za-z0-9])', '\1 \2', 'g')"
    clean = rf"regexp_replace({clean}, '[<>{{}}\[\]()`\x22\x27]', ' ', 'g')"
    return rf"lower(regexp_replace({clean}, '\b(xmlns|mathml|xlink|mml|https?|www|org)\b', ' ', 'gi'))"


@query(rf"""
    WITH d AS (SELECT doc_id, regexp_extract_all({_fragment("split_part(coalesce(text, ''), chr(10), 1)")}, '[a-z0-9][a-z0-9+#-]*') AS tt, regexp_extract_all({_fragment("coalesce(text, '')")}, '[a-z0-9][a-z0-9+#-]*') AS aa FROM documents),
    w AS (SELECT doc_id, 1 AS in_title, tt AS l FROM d UNION ALL SELECT doc_id, 0, aa FROM d),
    g AS (SELECT doc_id, in_title, n.n, unnest(list_transform(range(1, len(l) - n.n + 2), lambda i: l[i:i + n.n - 1])) AS g FROM w, (VALUES (1), (2), (3)) n(n) WHERE len(l) >= n.n),
    c AS (SELECT doc_id, array_to_string(g, ' ') AS phrase, n, g, sum(in_title) AS th, sum(1 - in_title) AS ah FROM g WHERE len(list_filter(g, lambda x: NOT {_OK})) = 0 GROUP BY ALL),
    s AS (SELECT *, th * (0.55 + 0.25 * (n - 1)) + ah * (1.25 + 0.55 * (n - 1)) + CASE WHEN th > 0 AND ah > 0 THEN 1.35 WHEN th > 0 THEN 0.5 ELSE 0 END AS score,
        n > 1 OR g[1] IN ('ir', 'er', 'thing') OR regexp_matches(g[1], '[a-z]\d|\d[a-z]') OR (contains(g[1], '-') AND length(g[1]) >= 6) OR g[1] LIKE '%tion' AS technical FROM c WHERE length(phrase) <= 64)
    SELECT doc_id AS id, phrase, round(score, 4)::DOUBLE AS score FROM s
    WHERE NOT (n = 1 AND length(phrase) <= 3 AND phrase NOT IN ('ir', 'er')) AND NOT (n >= 2 AND g[1] = g[2]) AND NOT (n = 3 AND (g[2] = g[3] OR g[1] = g[3])) AND g[1] <> 'with' AND g[-1] <> 'with'
        AND CASE WHEN th > 0 THEN ah > 0 OR length(replace(phrase, ' ', '')) >= 11 ELSE ah >= 2 END
        AND (n > 1 OR (phrase <> 'there' AND (NOT regexp_matches(phrase, '(ly|ed|ing)$') OR phrase = 'thing') AND (technical OR (ah >= 2 AND th + ah >= 3 AND length(phrase) >= 6))))
""")
def mined_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-16, KWX-04, KWX-05, KWX-06, KWX-07, TXT-16: the phrases of every document that may be keywords, with their scores."""
    d = t(spark, sf, "documents").withColumn("title", F.element_at(F.split(F.coalesce("text", F.lit("")), "\n"), 1))
    return keywords.mined_phrases(keywords.phrase_scores(d, "doc_id", "title", "text", LEXICON, met_only=True), LEXICON).select("id", "phrase", F.round("score", 4).alias("score"))


def _choice_sql() -> str:
    """The choice among mined phrases, one after the other, of each document."""
    key = "regexp_replace(lower({0}), '[^a-z0-9]+', '', 'g')".format
    formats = ", ".join(f"'{k}': '{v}'" for k, v in LEXICON.formats.items())
    word = f"coalesce((MAP {{{formats}}})[w], CASE WHEN w = 'c++' THEN 'C++' END, upper(substr(w, 1, 1)) || substr(w, 2))"
    return f"""
        WITH RECURSIVE m AS ({ORACLE_SQL["mined_phrases"]}),
        f AS (SELECT id, list(array_to_string(list_transform(string_split(phrase, ' '), lambda w: {word}), ' ') ORDER BY score DESC, phrase) AS ranked FROM m GROUP BY id),
        s(id, i, acc) AS (
            SELECT id, 0, []::VARCHAR[] FROM f
            UNION ALL
            SELECT s.id, i + 1, CASE
                WHEN len(acc) >= 14 OR {key("ranked[i + 1]")} = '' OR len(list_filter(acc, lambda x: contains({key("x")}, {key("ranked[i + 1]")}))) > 0 THEN acc
                WHEN len(list_filter(acc, lambda x: contains({key("ranked[i + 1]")}, {key("x")}))) > 0 THEN
                    list_transform(acc, lambda x, j: CASE WHEN j = list_max(list_filter(range(1, len(acc) + 1), lambda n: contains({key("ranked[i + 1]")}, {key("acc[n]")}))) THEN ranked[i + 1] ELSE x END)
                ELSE list_append(acc, ranked[i + 1]) END
            FROM s JOIN f USING (id) WHERE i < len(ranked)
        )
        SELECT s.id, array_to_string(acc, '|') AS keywords FROM s JOIN f USING (id) WHERE i = len(ranked)
    """


@query(_choice_sql())
def mined_keywords(spark: SparkSession, sf: str) -> DataFrame:
    """KWX-04, KWX-08, LIM-02: of every document the phrases chosen among mined_phrases(), each by what was chosen before."""
    d = t(spark, sf, "documents").withColumn("title", F.element_at(F.split(F.coalesce("text", F.lit("")), "\n"), 1))
    return keywords.mined_keywords(d, "doc_id", "title", "text", LEXICON).select("id", F.array_join("keywords", "|").alias("keywords"))


@query("""
    SELECT p_partkey, 'GPU|' || p_name || '|' || p_brand AS combined, p_type || '|' || p_name || CASE WHEN p_partkey % 2 = 0 THEN '|GPU' ELSE '' END AS stored, p_type || CASE WHEN p_name LIKE '% widget' THEN '|Widgets' ELSE '' END || CASE WHEN p_partkey % 2 = 0 THEN '|Graphics' ELSE '' END AS topics FROM part
""")
def keyword_lists(spark: SparkSession, sf: str) -> DataFrame:
    """KWX-09, KWX-10, KWX-12: what a keyword taken before holds is passed over, lists join without repeats, topics come of labels and texts."""
    p, even = t(spark, sf, "part"), F.col("p_partkey") % 2 == 0
    combined = keywords.combined_keywords(F.array(F.lit("GPU")), F.array(F.lit("gpu"), F.col("p_name")), F.array(F.split("p_name", " ")[0], F.col("p_brand"), F.lit("--")))
    stored = keywords.stored_keywords(F.array("p_type"), F.array("p_name", F.lower("p_type")), F.when(even, F.array(F.lit("GPU"))))
    text = keywords.paper_text(F.col("p_name"), F.lit(" "), F.when(even, F.lit("On GPUs")).otherwise(F.lit("")), F.lit(""))
    topics = keywords.key_topics(F.array("p_type"), text, [("Widgets", "widgets?"), ("Graphics", "gpus?")], {})
    return p.select("p_partkey", F.array_join(combined, "|").alias("combined"), F.array_join(stored, "|").alias("stored"), F.array_join(topics, "|").alias("topics"))


@query("""
    WITH q AS (SELECT 0 AS kind, 'compiler' AS q UNION ALL SELECT DISTINCT 1, 'core ' || lower(c_name) FROM customer)
    SELECT q AS query, row_number() OVER (ORDER BY kind, q)::BIGINT AS place FROM q
""")
def discovery_words(spark: SparkSession, sf: str) -> DataFrame:
    """KWX-13: search words from a table of subjects, here all customers' names, some of them twice."""
    names = t(spark, sf, "customer").select(F.explode(F.array(F.lower("c_name"), F.concat(F.lit("  "), F.lower("c_name")), F.when(F.col("c_custkey") % 50 == 0, "compiler"))).alias("s")).where("s IS NOT NULL AND s <> 'compiler'")
    return keywords.discovery_terms(["compiler", "Compiler "], names, "s", "core")


@query("""
    SELECT c_custkey, 'q=' || replace(replace(c_name, ' ', '+'), '#', '%23') || '&topics=a%2Cb' AS address, 'a' AS after_removal, 2 AS filters, CASE WHEN c_custkey % 2 = 0 THEN '2024-03' ELSE '' END AS meeting, 'entity/' || c_name AS entity, 'person/' || c_name AS crossed FROM customer
""")
def search_addresses(spark: SparkSession, sf: str) -> DataFrame:
    """RTE-01, RTE-02, RTE-03, RTE-06, RTE-09 to RTE-13, FLT-17: addresses to specifications and back, one of each customer's name."""
    @F.pandas_udf("address string, after_removal string, filters int, meeting string, entity string, crossed string")
    def told(name: pd.Series, year: pd.Series) -> pd.DataFrame:
        rows = []
        for n, y in zip(name, year, strict=True):
            spec = SearchSpec.parse("?" + urlencode({"query": n, "tag": "a,a", "years": ""})).add_topic("b").add_topic(" A ")
            less = spec.toggle_topic("B")
            kept = SearchSpec.parse("?meeting=2024-03").with_years((y,)).meeting
            rows.append((spec.to_query_string(), ",".join(less.topics), less.active_filters(), kept, "/".join(initial_query("?" + urlencode({"value": n}))), "/".join(spec.selected("person", n).cross_selection() or ())))
        return pd.DataFrame(rows, columns=["address", "after_removal", "filters", "meeting", "entity", "crossed"])

    year = F.when(F.col("c_custkey") % 2 == 0, "2024").otherwise("2023")
    return t(spark, sf, "customer").select("c_custkey", told("c_name", year).alias("s")).select("c_custkey", "s.*")


@query("""
    WITH q AS (SELECT DISTINCT lower(p_brand) AS q FROM part UNION SELECT DISTINCT lower(p_type) FROM part UNION SELECT DISTINCT unnest(string_split(p_name, ' ')) FROM part),
    l AS (SELECT w AS q, count(*) AS n FROM (SELECT unnest(list_distinct(string_split(p_name, ' '))) AS w FROM part) GROUP BY 1),
    o AS (SELECT lower(p_brand) AS q, count(*) AS n FROM part WHERE p_size % 2 = 0 GROUP BY 1),
    e AS (SELECT lower(p_type) AS k, bool_or(p_size > 25) AS here FROM part GROUP BY 1 UNION ALL SELECT DISTINCT lower(p_brand), p_brand = 'Brand#1' FROM part)
    SELECT q.q, coalesce(l.n, 0) AS n_local, coalesce(o.n, 0) AS n_other, coalesce(NOT e.here, FALSE) OR (l.n IS NULL AND o.n IS NOT NULL) AS to_all, t.topic
    FROM q LEFT JOIN l USING (q) LEFT JOIN o USING (q) LEFT JOIN e ON e.k = q.q LEFT JOIN (SELECT DISTINCT lower(p_type) AS k, p_type AS topic FROM part) t ON t.k = q.q
""")
def routed_queries(spark: SparkSession, sf: str) -> DataFrame:
    """RTE-04, RTE-07, RTE-08: for every word, brand and type of the parts whether it is better asked of all works, and which topic it is."""
    p = t(spark, sf, "part")
    word = lambda c: F.explode(F.array_distinct(F.split(c, " "))).alias("q")
    q = p.select(F.lower("p_brand").alias("q")).unionByName(p.select(F.lower("p_type").alias("q"))).unionByName(p.select(word("p_name"))).distinct()
    here = p.select(word("p_name")).groupBy("q").agg(F.count("*").alias("n_local"))
    other = p.where("p_size % 2 = 0").groupBy(F.lower("p_brand").alias("q")).agg(F.count("*").alias("n_other"))
    q = q.join(here, "q", "left").join(other, "q", "left").fillna(0, ["n_local", "n_other"])
    brand = F.when(F.col("p_brand") == "Brand#1", "talks").otherwise("papers")
    entries = p.select(F.when(F.col("p_size") > 25, "talks").otherwise("papers").alias("corpus"), F.concat(F.lit(" "), "p_type").alias("label")).unionByName(p.select(brand.alias("corpus"), F.col("p_brand").alias("label")))
    return resolved_topics(routed(q, "q", entries, "talks", "n_local", "n_other"), "q", p.select(F.col("p_type").alias("label")), "label")


@query("""
    SELECT o_orderkey, concat_ws('; ', CASE WHEN o_orderkey % 3 = 0 THEN 'batch size must be positive' END, CASE WHEN o_orderkey % 4 IN (1, 2) THEN 'repository must be owner/name' END, CASE WHEN o_orderkey % 5 = 4 THEN 'max posts must not be negative' END) AS errors FROM orders
""")
def checked_options(spark: SparkSession, sf: str) -> DataFrame:
    """VAL-10: the options of as many runs as there are orders."""
    k = F.col("o_orderkey")
    repository = F.element_at(F.array(F.lit("owner/name"), F.lit("owner"), F.lit("a/b/c"), F.lit(None).cast("string")), (k % 4 + 1).cast("int"))
    return t(spark, sf, "orders").select("o_orderkey", documents.option_errors((k % 3).cast("int"), repository, (3 - k % 5).cast("int")).alias("errors"))
