"""Registered catalogue queries, each beside the SQL that it must equal.

Tables stand for catalogue entities: documents for papers (title: first line), pages for fetched pages,
conversations for meetings and their talks, benchmark for known records, labels for what enriches them,
events for the stream of changes, customers and suppliers for people, orders for dated and cited works.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstack.functions import fields as fl
from quillstack.functions import keys as ky
from quillstack.functions import text as tx
from quillstack.operators import changes, documents, facets, keywords, pages, records, related, search, text_index
from quillstack.sources.bundles import batch_key

from .registry import ORACLE_SQL, query, scratch, t

def title() -> Column:
    """A document's first line."""
    return F.element_at(F.split(tx.blank("text"), "\n"), 1)


SQL_TITLE = "split_part(coalesce(text, ''), chr(10), 1)"
SQL_SPLIT = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9+#.]+'), lambda x: length(x) >= 2)"
#: (topic, r) of a document's distinct tokens, numbered by first occurrence.
SQL_TOPICS = f"""
    e AS (SELECT doc_id, unnest(l) AS topic, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, {SQL_SPLIT} AS l FROM documents)),
    f AS (SELECT doc_id, topic, min(i) AS i FROM e GROUP BY 1, 2),
    r AS (SELECT topic, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM f)
"""

# --- search ------------------------------------------------------------------------------------


def _fields() -> dict:
    return {"title": title(), "abstract": F.col("text"), "meeting": F.col("source"), "category": F.col("lang")}


@query(f"""
    WITH d AS (SELECT doc_id, lower({SQL_TITLE}) AS title, lower(coalesce(text, '')) AS body, lower(coalesce(source, '')) AS src, lower(coalesce(lang, '')) AS lng FROM documents),
    s AS (SELECT doc_id, {" + ".join(f"(CASE WHEN strpos(title, '{w}') = 1 THEN 100 WHEN strpos(title, '{w}') > 0 THEN 50 ELSE 0 END + CASE WHEN strpos(body, '{w}') > 0 THEN 10 ELSE 0 END + CASE WHEN strpos(src, '{w}') > 0 THEN 5 ELSE 0 END + CASE WHEN strpos(lng, '{w}') > 0 THEN 5 ELSE 0 END)" for w in ("the", "en"))} AS score,
        {" AND ".join(f"(strpos(title, '{w}') > 0 OR strpos(body, '{w}') > 0 OR strpos(src, '{w}') > 0 OR strpos(lng, '{w}') > 0)" for w in ("the", "en"))} AS ok FROM d)
    SELECT doc_id, score::DOUBLE AS score, 'exact' AS mode FROM s WHERE ok ORDER BY score DESC, doc_id LIMIT 60
""")
def search_exact_topk(spark: SparkSession, sf: str) -> DataFrame:
    """RNK-01, RNK-02, RNK-09, LIM-01."""
    hits = search.search(t(spark, sf, "documents"), "the en", _fields(), search.TALK_WEIGHTS)
    return search.page(hits.select("doc_id", "score", "mode"), [F.desc("score"), F.col("doc_id")])


@query(ORACLE_SQL["search_exact_topk"])
def search_indexed_topk(spark: SparkSession, sf: str) -> DataFrame:
    """RNK-01, RNK-02, RNK-09, LIM-01 through a stored index, whose postings of the best blocks are all that the search reads."""
    index = text_index.build(t(spark, sf, "documents"), "doc_id", _fields(), search.TALK_WEIGHTS, scratch(spark))
    return index.search("the en", k=60).withColumnRenamed("id", "doc_id")


def _fuzzy_sql(token: str, field: str, bonus: int) -> str:
    far = 2 if len(token) >= 7 else 1
    return f"""
        SELECT doc_id, max(s) + {bonus} AS s FROM (SELECT doc_id, CASE WHEN w = '{token}' THEN 20 ELSE greatest(CASE WHEN starts_with(w, '{token}') THEN 16 ELSE 0 END, CASE WHEN contains(w, '{token}') THEN 14 ELSE 0 END,
            CASE WHEN regexp_matches(w, '{".*".join(token)}') THEN 11 ELSE 0 END, CASE levenshtein(w, '{token}') WHEN 1 THEN 10 WHEN {far} THEN 8 ELSE 0 END) END AS s FROM (SELECT doc_id, unnest({SQL_SPLIT.replace("text", field)}) AS w FROM d)) WHERE s > 0 GROUP BY doc_id
    """


@query(f"""
    WITH d AS (SELECT doc_id, {SQL_TITLE} AS title, source FROM documents),
    a AS (SELECT doc_id, max(s) AS s FROM ({_fuzzy_sql("ontxhe", "title", 3)} UNION ALL {_fuzzy_sql("ontxhe", "source", 0)}) GROUP BY 1),
    b AS (SELECT doc_id, max(s) AS s FROM ({_fuzzy_sql("tthe", "title", 3)} UNION ALL {_fuzzy_sql("tthe", "source", 0)}) GROUP BY 1)
    SELECT doc_id, (a.s + b.s)::DOUBLE AS score, 'fuzzy' AS mode FROM a JOIN b USING (doc_id)
""")
def search_fuzzy_documents(spark: SparkSession, sf: str) -> DataFrame:
    """RNK-06, RNK-07, RNK-09 over all documents: each distinct word is compared once, and leads to rows by its postings."""
    index = text_index.build(t(spark, sf, "documents"), "doc_id", _fields(), search.TALK_WEIGHTS, scratch(spark))
    return index.search("ontxhe tthe").withColumnRenamed("id", "doc_id")


@query("""
    WITH w AS (SELECT p_partkey, unnest(list_distinct(string_split(lower(p_name), ' '))) AS w FROM part),
    s AS (SELECT p_partkey, CASE WHEN w = 'widgit' THEN 20 ELSE greatest(CASE WHEN levenshtein(w, 'widgit') = 1 THEN 10 ELSE 0 END, CASE WHEN regexp_matches(w, 'w.*i.*d.*g.*i.*t') THEN 11 ELSE 0 END) END AS s FROM w)
    SELECT p_partkey, (max(s) + 3)::DOUBLE AS score, 'fuzzy' AS mode FROM s GROUP BY 1 HAVING max(s) > 0
""")
def search_fuzzy_part(spark: SparkSession, sf: str) -> DataFrame:
    """RNK-06, RNK-07, RNK-09: no exact hit, so the fuzzy scores count."""
    return search.search(t(spark, sf, "part"), "widgit", {"title": F.col("p_name")}, {"title": 50}).select("p_partkey", "score", "mode")


@query("""
    WITH s AS (SELECT o_orderkey, year(o_orderdate) AS y, o_totalprice, o_orderpriority FROM orders WHERE o_orderstatus IN ('F', 'O') AND year(o_orderdate) IN (1996, 1997))
    SELECT o_orderkey, y FROM s ORDER BY y DESC, o_totalprice DESC, o_orderkey LIMIT 40 OFFSET 60
""")
def filtered_second_page(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-01, SRT-05, LIM-01."""
    from .spec import SearchSpec, apply

    o = t(spark, sf, "orders").withColumn("y", F.year("o_orderdate"))
    o = apply(o, SearchSpec.parse("?years=1996,1997&categories=F,O"), "", "", "y", "o_orderstatus", "", "", "")
    return search.page(o, [F.desc("y"), F.desc("o_totalprice"), F.col("o_orderkey")], number=1).select("o_orderkey", "y")


@query("SELECT o_orderkey, year(o_orderdate)::INTEGER AS y FROM orders ORDER BY y DESC, o_totalprice DESC, o_orderkey LIMIT 100")
def year_sorted_topn(spark: SparkSession, sf: str) -> DataFrame:
    """SRT-05."""
    o = t(spark, sf, "orders").withColumn("y", F.year("o_orderdate"))
    return o.orderBy(F.desc("y"), F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "y")


@query("""
    SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS r FROM conversations) WHERE r <= 4
""")
def top_per_meeting(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-01, WIN-05."""
    return search.top_per_group(t(spark, sf, "conversations"), ["conv_id"], [F.desc(F.length("text")), F.col("turn")], 4).select("conv_id", "turn")


@query("""
    WITH k AS (SELECT c_custkey, c_name, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) AS a, c_custkey % 30 AS y FROM customer),
    w AS (SELECT 'customer 000000012' AS b, 12 AS wy)
    SELECT c_custkey, (CASE WHEN a = b THEN 100 WHEN contains(a, b) THEN 40 WHEN contains(b, a) THEN 20 ELSE 0 END + CASE abs(y - wy) WHEN 0 THEN 20 WHEN 1 THEN 10 ELSE 0 END)::INTEGER AS quality FROM k, w
    WHERE CASE WHEN a = b THEN 100 WHEN contains(a, b) THEN 40 WHEN contains(b, a) THEN 20 ELSE 0 END + CASE abs(y - wy) WHEN 0 THEN 20 WHEN 1 THEN 10 ELSE 0 END >= 40
""")
def catalogue_title_match(spark: SparkSession, sf: str) -> DataFrame:
    """RNK-14, RNK-16."""
    q = search.title_match(F.col("c_name"), F.col("c_custkey") % 30, F.lit("Customer 000000012"), F.lit(12))
    return t(spark, sf, "customer").select("c_custkey", q.cast("int").alias("quality")).where("quality >= 40")


# --- facets and counts ---------------------------------------------------------------------------


@query("SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source")
def facet_lang_source(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-01, AGG-02, AGG-04: all facets in one scan."""
    return facets.facet_sets(t(spark, sf, "documents"), ["lang", "source"])


@query(f"""
    WITH {SQL_TOPICS}, n AS (SELECT topic, count(*) AS n FROM r WHERE r <= 12 AND length(topic) <= 48 GROUP BY 1 HAVING count(*) >= 2)
    SELECT topic, n FROM n ORDER BY n DESC, topic LIMIT 220
""")
def facet_topk_terms(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-01, TXT-14."""
    d = t(spark, sf, "documents").select(tx.unique_tokens("text").alias("topics"))
    return facets.topic_facet(d, "topics")


@query(f"""
    WITH {SQL_TOPICS}
    SELECT topic, count(*) AS n FROM r WHERE r <= 8 GROUP BY 1 HAVING count(*) >= 4 ORDER BY topic LIMIT 180
""")
def facet_alphabetical_terms(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-02."""
    d = t(spark, sf, "documents").select(tx.unique_tokens("text").alias("topics"))
    return facets.topic_facet(d, "topics", per_item=8, longest=None, least=4, top=180, cut="alpha")


@query("""
    WITH k AS (SELECT CASE event_type WHEN 'view' THEN 'keynote' WHEN 'click' THEN 'technical-talk' WHEN 'signup' THEN 'bof' ELSE 'other' END AS category FROM events)
    SELECT category, count(*) AS n, CASE category WHEN 'keynote' THEN 1 WHEN 'technical-talk' THEN 2 WHEN 'bof' THEN 8 ELSE 11 END AS rank FROM k GROUP BY 1
""")
def facet_categories(spark: SparkSession, sf: str) -> DataFrame:
    """KEY-21, AGG-03."""
    said = F.create_map(*(F.lit(x) for x in ("view", "Keynotes", "click", "Technical Sessions", "signup", "Birds of a Feather", "error", "???", "purchase", "")))
    return facets.category_facet(t(spark, sf, "events").select(ky.category(said[F.col("event_type")]).alias("category")), "category")


@query("""
    SELECT c.conv_id, count(*) AS members, count(*) FILTER (role = 'user') AS asked, count(*) FILTER (length(trim(coalesce(text, ''))) > 200) AS long FROM conversations c GROUP BY 1
""")
def meeting_stats(spark: SparkSession, sf: str) -> DataFrame:
    """JON-11, AGG-06."""
    c = t(spark, sf, "conversations")
    flags = {"asked": F.col("role") == "user", "long": F.length(F.trim(tx.blank("text"))) > 200}
    return facets.group_stats(c.select("conv_id").distinct(), c, "conv_id", flags)


@query("""
    SELECT year(o_orderdate)::INTEGER AS y, count(*) AS n, list(o_orderkey ORDER BY o_orderkey DESC)[1:5]::VARCHAR AS latest FROM orders GROUP BY 1
""")
def works_by_year(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-07: the largest five keys of each year, kept by rank and not by sorting whole groups."""
    o = t(spark, sf, "orders").select(F.year("o_orderdate").alias("y"), "o_orderkey")
    n = o.groupBy("y").agg(F.count("*").alias("n"))
    top = search.top_per_group(o, ["y"], [F.desc("o_orderkey")], 5).groupBy("y").agg(F.sort_array(F.collect_list("o_orderkey"), asc=False).alias("l"))
    return n.join(top, "y").select("y", "n", F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x.cast("string")), ", "), F.lit("]")).alias("latest"))


@query("""
    SELECT (SELECT count(*) FROM conversations) AS talks, (SELECT count(*) FROM documents) AS papers, (SELECT count(DISTINCT c_name) FROM customer) AS people,
        (SELECT count(DISTINCT conv_id) FROM conversations WHERE role = 'system') AS meetings
""")
def site_stats(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-08."""
    c = t(spark, sf, "conversations").agg(F.count("*").alias("talks"), F.countDistinct(F.when(F.col("role") == "system", F.col("conv_id"))).alias("meetings"))
    d = t(spark, sf, "documents").agg(F.count("*").alias("papers"))
    p = t(spark, sf, "customer").agg(F.countDistinct("c_name").alias("people"))
    return c.crossJoin(d).crossJoin(p).select("talks", "papers", "people", "meetings")  # one row each


@query("""
    SELECT n_name, coalesce(a.n, 0) AS left_n, coalesce(b.n, 0) AS right_n, coalesce(a.n, 0) + coalesce(b.n, 0) AS total FROM nation
    LEFT JOIN (SELECT c_nationkey k, count(*) n FROM customer GROUP BY 1) a ON a.k = n_nationkey LEFT JOIN (SELECT s_nationkey k, count(*) n FROM supplier GROUP BY 1) b ON b.k = n_nationkey
    WHERE coalesce(a.n, b.n) IS NOT NULL
""")
def topic_counts_both_sides(spark: SparkSession, sf: str) -> DataFrame:
    """JON-12."""
    n = t(spark, sf, "nation")
    c = t(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name")
    s = t(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("n_name")
    return facets.two_sided_counts(c, s, "n_name")


@query("""
    WITH e AS (SELECT 'brand' AS kind, p_brand AS label, count(*) AS n FROM part GROUP BY p_brand UNION ALL SELECT 'name', p_name, count(*) FROM part GROUP BY p_name),
    h AS (SELECT *, strpos(lower(label), 'b') AS place FROM e),
    r AS (SELECT kind, label, n, row_number() OVER (PARTITION BY kind ORDER BY place > 1, n DESC, label)::INTEGER AS rank FROM h WHERE place > 0)
    SELECT * FROM r WHERE rank <= CASE kind WHEN 'brand' THEN 6 ELSE 4 END
""")
def autocomplete_top(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-05, WIN-05."""
    p = t(spark, sf, "part")
    e = p.groupBy(F.col("p_brand").alias("label")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("brand"))
    e = e.unionByName(p.groupBy(F.col("p_name").alias("label")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("name")))
    return facets.autocomplete(e, "b", {"brand": 6, "name": 4})


@query("""
    WITH w AS (SELECT c_nationkey AS k, c_mktsegment AS label, count(*) AS n FROM customer GROUP BY 1, 2)
    SELECT k AS nation, label FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, label) AS r FROM w) WHERE r = 1
""")
def people_freq_label(spark: SparkSession, sf: str) -> DataFrame:
    """ER-12, RNK-17: all labels here are one word, so counts and the alphabet decide."""
    n = t(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("label")).count()
    return records.display_label(n, "nation", "label", "count")


@query("""
    WITH e AS (SELECT p_brand AS name, p_partkey AS work, CASE WHEN p_partkey % 2 = 0 THEN 'talk' ELSE 'paper' END AS kind, p_size AS cites FROM part)
    SELECT regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS key, count(*) FILTER (kind = 'talk') AS talk_count, count(*) FILTER (kind = 'paper') AS paper_count,
        coalesce(sum(cites) FILTER (kind = 'paper'), 0)::BIGINT AS citation_count, count(*) AS total_count FROM e GROUP BY 1
""")
def people_index(spark: SparkSession, sf: str) -> DataFrame:
    """ER-05, AGG-09, JON-13, KEY-05."""
    kind = F.when(F.col("p_partkey") % 2 == 0, "talk").otherwise("paper")
    e = t(spark, sf, "part").select(F.col("p_brand").alias("name"), F.lit("").alias("aff"), F.col("p_partkey").alias("work"), kind.alias("kind"), F.col("p_size").alias("cites"))
    return records.people(e, "name", "aff", "work", "kind", "cites").select("key", "talk_count", "paper_count", "citation_count", "total_count")


@query("SELECT conv_id AS key, arg_min(role, turn) AS label FROM conversations GROUP BY 1")
def first_label_per_meeting(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-14, AGG-15, ER-11."""
    out = facets.first_labels(t(spark, sf, "conversations"), F.col("conv_id").cast("string"), "role", "turn")
    return out.select(F.col("key").cast("long").alias("key"), "label")


@query("SELECT DISTINCT o_custkey AS id FROM orders")
def distinct_ids(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-13, SET-01."""
    return t(spark, sf, "orders").select(F.col("o_custkey").alias("id")).distinct()


@query("SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def ids_without_works(spark: SparkSession, sf: str) -> DataFrame:
    """SET-02."""
    return t(spark, sf, "customer").select(F.col("c_custkey").alias("id")).exceptAll(t(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_custkey").distinct())


# --- joins and entity resolution -----------------------------------------------------------------


@query("""
    WITH k AS (SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')) AS key FROM documents)
    SELECT min(doc_id) AS doc_id, count(*) AS members FROM k GROUP BY key
""")
def identity_dedupe_exact(spark: SparkSession, sf: str) -> DataFrame:
    """KEY-03, ER-09."""
    d = t(spark, sf, "documents").select("doc_id", F.sha2(ky.title_key("text"), 256).alias("key"))
    return d.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("members")).select("doc_id", "members")


@query(f"""
    WITH RECURSIVE k AS (
        SELECT doc_id, 'text:' || md5(coalesce(text, '')) AS key FROM documents
        UNION SELECT doc_id, 'title:' || trim(regexp_replace(lower({SQL_TITLE}), '[^a-z0-9]+', ' ', 'g')) FROM documents WHERE length(trim(regexp_replace(lower({SQL_TITLE}), '[^a-z0-9]+', ' ', 'g'))) > 0
    ),
    f AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY key) AS low FROM k),
    e AS (SELECT DISTINCT doc_id AS a, low AS b FROM f WHERE doc_id <> low UNION SELECT DISTINCT low, doc_id FROM f WHERE doc_id <> low),
    r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
    m AS (SELECT a, min(b) AS b FROM r GROUP BY a)
    SELECT d.doc_id AS id, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component FROM documents d LEFT JOIN m ON m.a = d.doc_id
""")
def identity_components(spark: SparkSession, sf: str) -> DataFrame:
    """ER-01, ER-02, JON-17, KEY-13."""
    head = ky.title_key(title())
    keys = F.array_compact(F.array(F.concat(F.lit("text:"), F.md5(tx.blank("text").cast("binary"))), F.when(head != "", F.concat(F.lit("title:"), head))))
    from quillstack.operators.graph import key_components

    return key_components(t(spark, sf, "documents").select("doc_id", keys.alias("keys")), "doc_id", "keys")


@query("""
    WITH r AS (SELECT lang AS component, count(*) AS members FROM documents WHERE lang IS NOT NULL GROUP BY 1),
    q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY length(coalesce(text, '')) DESC, doc_id) AS r FROM documents)
    SELECT r.members, q.doc_id AS best_id, (SELECT max(n_chars) FROM documents d WHERE d.lang = r.component) AS n_chars FROM r JOIN q ON q.lang = r.component AND q.r = 1
""")
def merged_records(spark: SparkSession, sf: str) -> DataFrame:
    """ER-03, RNK-12: records that share a key (here the language) as one."""
    d = t(spark, sf, "documents").where("lang is not null").withColumn("keys", F.array("lang"))
    out = records.merge_duplicates(d, "doc_id", "keys", "doc_id", F.struct(F.length(tx.blank("text"))), ["source"], [], ["n_chars"])
    return out.select("members", "best_id", "n_chars")


@query("""
    SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE trim(coalesce(b.text, '')) <> '' AND b.text = d.text)
""")
def anti_known(spark: SparkSession, sf: str) -> DataFrame:
    """JON-06, JON-08."""
    return records.without_known(t(spark, sf, "documents"), t(spark, sf, "benchmark"), ["text"]).select("doc_id")


@query("SELECT d.doc_id, coalesce(l.quality, 0) AS quality, coalesce(l.toxic, 0) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def enrich_left(spark: SparkSession, sf: str) -> DataFrame:
    """JON-01, JON-03, JON-07."""
    out = records.enrich(t(spark, sf, "documents").select("doc_id"), t(spark, sf, "labels"), ["doc_id"], {"quality": "quality", "toxic": "toxic"})
    return out.select("doc_id", F.coalesce("quality", F.lit(0)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


@query("""
    WITH i AS (SELECT p_partkey AS id, p_brand AS g, p_size AS y, p_name AS t, list_distinct(string_split(p_name, ' ') || [p_brand]) AS ls FROM part),
    l AS (SELECT id, unnest(ls) AS l FROM i),
    s AS (SELECT a.id, b.id AS other, count(*) AS n FROM l a JOIN l b ON a.l = b.l AND a.id <> b.id GROUP BY 1, 2),
    p AS (SELECT s.*, x.g, o.g AS og, o.y AS oy, o.t AS ot FROM s JOIN i x ON x.id = s.id JOIN i o ON o.id = s.other),
    f AS (SELECT *, g = og AND row_number() OVER (PARTITION BY id, g = og ORDER BY other) <= 4 AS first FROM p),
    r AS (SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY first DESC, CASE WHEN first THEN 0 ELSE -n END, CASE WHEN first THEN 0 ELSE -oy END, CASE WHEN first THEN '' ELSE ot END, other)::INTEGER AS rank FROM f)
    SELECT * FROM r WHERE rank <= 6
""")
def related_by_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """JON-15, JON-16 over all parts."""
    p = t(spark, sf, "part")
    labels = F.array_distinct(F.concat(F.split("p_name", " "), F.array("p_brand")))
    return related.by_labels(p, "p_partkey", labels, "p_brand", F.col("p_size"), "p_name")


@query("""
    WITH remote AS (SELECT p_partkey AS seq, p_name || '/' || p_brand || '/' || p_size AS k, p_name || '/' || p_brand AS tk FROM part WHERE p_partkey % 3 = 0),
    old AS (SELECT p_partkey AS id, p_name || '/' || p_brand || '/' || p_size AS k, p_name || '/' || p_brand AS tk FROM part WHERE p_partkey % 3 = 1),
    f AS (SELECT k, min(id) AS id FROM old GROUP BY 1), s AS (SELECT tk, min(id) AS id FROM old GROUP BY 1 HAVING count(*) = 1)
    SELECT seq, coalesce(f.id, s.id) AS id, CASE WHEN f.id IS NOT NULL THEN 'full' WHEN s.id IS NOT NULL THEN 'title' ELSE 'insert' END AS how FROM remote LEFT JOIN f USING (k) LEFT JOIN s USING (tk)
""")
def upsert_match(spark: SparkSession, sf: str) -> DataFrame:
    """JON-04, JON-18, INC-10 (which rows are the remote side and which the known one is the scenario)."""
    p = t(spark, sf, "part").select(F.col("p_partkey").alias("seq"), F.col("p_partkey").alias("id"), F.concat_ws("/", "p_name", "p_brand", "p_size").alias("k"), F.concat_ws("/", "p_name", "p_brand").alias("tk"))
    return records.match_remote(p.where("seq % 3 = 0").drop("id"), p.where("seq % 3 = 1"), "k", "tk", "seq", "id")


@query("SELECT o_orderkey, ((row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) // 40)::INTEGER AS batch FROM orders")
def id_batches(spark: SparkSession, sf: str) -> DataFrame:
    """ARR-07."""
    return records.chunks_of(t(spark, sf, "orders"), "o_orderkey", 40, "o_orderpriority").select("o_orderkey", "batch")


@query("SELECT c_nationkey AS nation, sha1(string_agg(c_custkey::VARCHAR, '|' ORDER BY c_custkey::VARCHAR)) AS key FROM customer GROUP BY 1")
def sha1_batch_key(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-05: batches are bounded by the API's limits, so their ids fit a row."""
    return t(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(batch_key(F.collect_list(F.col("c_custkey").cast("string"))).alias("key"))


# --- change log ------------------------------------------------------------------------------------


@query("""
    WITH c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS slides, o_orderstatus AS video FROM orders),
    p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority END AS slides, CASE WHEN o_orderstatus = 'F' THEN o_orderstatus END AS video FROM orders WHERE o_orderdate < '1998-01-01'),
    j AS (SELECT c.o_orderkey, p.o_orderkey IS NULL AS new, c.slides IS NOT NULL AND p.slides IS NULL AS s, c.video IS NOT NULL AND p.video IS NULL AS v FROM c LEFT JOIN p USING (o_orderkey)),
    x AS (SELECT o_orderkey, concat_ws('+', CASE WHEN new THEN 'talk' END, CASE WHEN s THEN 'slides' END, CASE WHEN v THEN 'video' END) AS parts FROM j)
    SELECT o_orderkey, parts, 'talk:' || o_orderkey || ':' || parts AS fingerprint FROM x WHERE parts <> ''
""")
def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    """INC-01, INC-02, INC-04, INC-05, JON-08, JON-09."""
    o = t(spark, sf, "orders")
    cur = o.select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("slides"), F.col("o_orderstatus").alias("video"))
    old = o.where("o_orderdate < '1998-01-01'").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderpriority")).alias("slides"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderstatus")).alias("video"))
    return changes.diff(cur, old, "o_orderkey", {"slides": "slides", "video": "video"}, "talk", "talk").withColumn("parts", F.array_join("parts", "+"))


@query("""
    WITH e AS (SELECT *, event_type || ':' || user_id AS fingerprint FROM events),
    o AS (SELECT event_id, fingerprint FROM e WHERE ts < '2024-01-10' QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY ts, event_id) = 1),
    n AS (SELECT event_id, fingerprint FROM e WHERE ts >= '2024-01-10' AND fingerprint NOT IN (SELECT fingerprint FROM o) QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY ts, event_id) = 1)
    SELECT * FROM o UNION ALL SELECT * FROM n
""")
def update_log_append(spark: SparkSession, sf: str) -> DataFrame:
    """INC-08, SNK-03, JON-10."""
    e = t(spark, sf, "events").withColumn("fingerprint", F.concat_ws(":", "event_type", "user_id"))
    order = [F.col("ts"), F.col("event_id")]
    log = changes.append_log(None, e.where("ts < '2024-01-10'"), order)
    return changes.append_log(log, e.where("ts >= '2024-01-10'"), order).select("event_id", "fingerprint")


@query("""
    WITH s AS (SELECT user_id, day(ts)::BIGINT AS d, max(CASE WHEN event_type = 'purchase' THEN 'x' END) AS slides FROM events GROUP BY 1, 2),
    l AS (SELECT *, coalesce(lag(d) OVER w = d - 1, false) AS was, lag(slides) OVER w AS before FROM s WINDOW w AS (PARTITION BY user_id ORDER BY d)),
    x AS (SELECT user_id, d, concat_ws('+', CASE WHEN NOT was THEN 'talk' END, CASE WHEN slides IS NOT NULL AND NOT (was AND before IS NOT NULL) THEN 'slides' END) AS parts FROM l)
    SELECT user_id, d, parts FROM x WHERE parts <> ''
""")
def history_replay(spark: SparkSession, sf: str) -> DataFrame:
    """INC-06, INC-07: each day is a snapshot of who was there."""
    s = t(spark, sf, "events").groupBy("user_id", F.dayofmonth("ts").cast("long").alias("d")).agg(F.max(F.when(F.col("event_type") == "purchase", "x")).alias("slides"))
    return changes.replay(s, "user_id", "d", {"slides": "slides"}, "talk", "talk").select("user_id", "d", F.array_join("parts", "+").alias("parts"))


@query(ORACLE_SQL["history_replay"])
def history_stream(spark: SparkSession, sf: str) -> DataFrame:
    """INC-06, INC-03 as a stream: snapshots land eight days at a time, and the stream is started anew for each, its state kept."""
    from quillstack.streaming import history

    root = scratch(spark)
    s = t(spark, sf, "events").groupBy("user_id", F.dayofmonth("ts").cast("long").alias("d")).agg(F.max(F.when(F.col("event_type") == "purchase", "x")).alias("slides"))
    for first in range(1, 32, 8):
        s.where(F.col("d").between(first, first + 7)).write.mode("append").parquet(f"{root}/snapshots")
        stream = spark.readStream.schema(s.schema).parquet(f"{root}/snapshots")
        history.run_available(history.replay_stream(stream, "user_id", "d", {"slides": "slides"}, "talk", "talk"), f"{root}/told", f"{root}/checkpoint")
    told = spark.read.schema("user_id long, d long, parts array<string>").parquet(f"{root}/told")
    return told.select("user_id", "d", F.array_join("parts", "+").alias("parts"))


@query("SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def latest_by_id(spark: SparkSession, sf: str) -> DataFrame:
    """INC-03, AGG-17."""
    return changes.latest(t(spark, sf, "events"), "user_id", "event_id").select("user_id", "event_id")


@query("SELECT 'p' || p_partkey AS path, CASE WHEN p_partkey % 4 = 0 THEN 'added' WHEN p_partkey % 4 = 1 THEN 'removed' ELSE 'modified' END AS change FROM part WHERE p_partkey % 4 < 3")
def changed_files(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-20, SRC-21."""
    p = t(spark, sf, "part").withColumn("path", F.concat(F.lit("p"), "p_partkey"))
    now = p.where("p_partkey % 4 <> 1").select("path", F.col("p_name").cast("binary").alias("content"))
    was = p.where("p_partkey % 4 <> 0").select("path", F.concat("p_name", F.when(F.col("p_partkey") % 4 == 2, "!").otherwise("")).cast("binary").alias("content"))
    return changes.changed_files(now, was)


# --- text, keys and fields --------------------------------------------------------------------------


@query("""
    WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '<[^>]+>', ' ', 'gs') AS t FROM documents), n AS (SELECT doc_id, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS a, length(regexp_replace(t, '[^\\p{L}]', '', 'g')) AS l FROM d)
    SELECT doc_id, round(CASE WHEN l > 0 THEN a / l ELSE 0 END, 6) AS ratio, l > 0 AND a / l < 0.95 AS foreign_text FROM n
""")
def english_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """TXT-09, TXT-10."""
    return t(spark, sf, "documents").select("doc_id", F.round(tx.english_ratio("text"), 6).alias("ratio"), tx.looks_non_english("text", 0.95).alias("foreign_text"))


@query("""
    WITH d AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t FROM documents), w AS (SELECT doc_id, t, string_split(t, ' ') AS w FROM d)
    SELECT doc_id, CASE WHEN t = '' THEN '' WHEN len(w) > 110 THEN regexp_replace(array_to_string(w[1:110], ' '), '[ ,;:.]+$', '') || '...' ELSE t END AS summary FROM w
""")
def abstract_summary(spark: SparkSession, sf: str) -> DataFrame:
    """TXT-06."""
    return t(spark, sf, "documents").select("doc_id", tx.summarize("text").alias("summary"))


@query("""
    WITH d AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t FROM documents)
    SELECT doc_id, CASE WHEN length(t) > 180 THEN rtrim(substr(t, 1, 179)) || '…' ELSE t END AS preview FROM d
""")
def text_preview(spark: SparkSession, sf: str) -> DataFrame:
    """TXT-01, TXT-08."""
    return t(spark, sf, "documents").select("doc_id", tx.truncate("text").alias("preview"))


@query(f"""
    SELECT doc_id, len(list_distinct({SQL_SPLIT})) AS n_tokens, len(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9][a-z0-9+#-]*'), lambda x: true)) AS n_words FROM documents
""")
def token_sets(spark: SparkSession, sf: str) -> DataFrame:
    """TXT-14, TXT-15."""
    return t(spark, sf, "documents").select("doc_id", F.size(tx.unique_tokens("text")).cast("long").alias("n_tokens"), F.size(tx.keyword_tokens("text")).cast("long").alias("n_words"))


@query(f"""
    SELECT doc_id, trim(regexp_replace(lower({SQL_TITLE}), '[^a-z0-9]+', ' ', 'g')) AS title_key, regexp_replace(lower({SQL_TITLE}), '[^a-z0-9]+', '', 'g') AS alnum_key,
        trim(regexp_replace(lower({SQL_TITLE}), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM documents
""")
def record_keys(spark: SparkSession, sf: str) -> DataFrame:
    """KEY-01, KEY-03, KEY-14."""
    return t(spark, sf, "documents").select("doc_id", ky.title_key(title()).alias("title_key"), ky.alnum_key(title()).alias("alnum_key"), ky.slugify(title()).alias("slug"))


@query("""
    SELECT p_partkey, CASE WHEN r = 1 THEN b ELSE b || '-' || r END AS id FROM (SELECT p_partkey, regexp_replace(p_name, ' ', '-', 'g') AS b, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS r FROM part)
""")
def unique_ids(spark: SparkSession, sf: str) -> DataFrame:
    """KEY-15, WIN-03."""
    p = t(spark, sf, "part").select("p_partkey", ky.slugify("p_name").alias("base"))
    return ky.with_unique_ids(p, "base", "p_partkey").select("p_partkey", "id")


@query("""
    SELECT conv_id, turn, conv_id || '-' || lpad((row_number() OVER (PARTITION BY conv_id ORDER BY turn) + coalesce(top, 0))::VARCHAR, 3, '0') AS id
    FROM conversations LEFT JOIN (SELECT conv_id, max(turn) AS top FROM conversations WHERE role = 'user' GROUP BY 1) USING (conv_id) WHERE role <> 'user'
""")
def next_ids(spark: SparkSession, sf: str) -> DataFrame:
    """KEY-16."""
    c = t(spark, sf, "conversations")
    old = c.where("role = 'user'").select("conv_id", F.concat_ws("-", "conv_id", F.lpad(F.col("turn").cast("string"), 3, "0")).alias("id"))
    return ky.next_talk_ids(c.where("role <> 'user'").select("conv_id", "turn"), old, "conv_id", "turn").select("conv_id", "turn", "id")


@query("""
    SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-') || CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%d') ELSE '00' END AS hint, strftime(o_orderdate, '%b') AS month FROM orders
""")
def slug_dates(spark: SparkSession, sf: str) -> DataFrame:
    """DAT-03, DAT-08."""
    slug = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "yyyy-MM"))
    return t(spark, sf, "orders").select("o_orderkey", fl.slug_sort_hint(slug).alias("hint"), fl.month_abbreviation(slug).alias("month"))


@query("""
    SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS start,
        CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 3 = 1 THEN strftime(last_day(o_orderdate), '%Y-%m-%d') END AS stop FROM orders
""")
def meeting_dates(spark: SparkSession, sf: str) -> DataFrame:
    """DAT-01: one day, a range to the end of the month, and a range over two months, which is no date."""
    k, d = F.col("o_orderkey") % 3, F.col("o_orderdate")
    ranged = F.concat(F.date_format(d, "MMM d"), F.lit("th - "), F.dayofmonth(F.last_day(d)).cast("string"), F.lit("th,"), F.date_format(d, " yyyy"))
    said = F.when(k == 0, F.date_format(d, "MMMM d, yyyy")).when(k == 1, ranged).otherwise(F.concat(F.date_format(d, "MMMM d"), F.lit("-May 2, 2020")))
    m = fl.meeting_dates(said)
    return t(spark, sf, "orders").select("o_orderkey", m["start"].cast("string").alias("start"), m["end"].cast("string").alias("stop"))


@query("SELECT event_id, (props->>'k')::INTEGER AS k, CASE WHEN (props->>'k')::INTEGER > 0 THEN (props->>'k')::INTEGER ELSE 0 END AS citations FROM events")
def json_counts(spark: SparkSession, sf: str) -> DataFrame:
    """NUM-01, NUM-02."""
    k = F.get_json_object("props", "$.k")
    return t(spark, sf, "events").select("event_id", fl.parse_int(k).alias("k"), fl.citation_count(F.lit("none"), k).alias("citations"))


@query("SELECT p_partkey, least(levenshtein(p_name, p_type), 9)::INTEGER AS d, least(levenshtein(p_name, substr(p_name, 1, length(p_name) - p_size % 4)), 3)::INTEGER AS cut FROM part")
def bounded_distances(spark: SparkSession, sf: str) -> DataFrame:
    """NUM-03."""
    shorter = F.substr("p_name", F.lit(1), F.length("p_name") - F.col("p_size") % 4)
    return t(spark, sf, "part").select("p_partkey", fl.bounded_levenshtein("p_name", "p_type", 8).cast("int").alias("d"), fl.bounded_levenshtein("p_name", shorter, 2).cast("int").alias("cut"))


@query("""
    WITH d AS (SELECT doc_id, replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS e FROM documents)
    SELECT doc_id, regexp_replace(e, '(the)', '<mark>\\1</mark>', 'gi') AS marked FROM d
""")
def highlighted(spark: SparkSession, sf: str) -> DataFrame:
    """TXT-23, TXT-24."""
    return t(spark, sf, "documents").select("doc_id", tx.highlight("text", ["the"]).alias("marked"))


@query("""
    SELECT l_orderkey AS paper, array_to_string(list_sort(list_distinct(list(l_returnflag))), ',') AS flags FROM lineitem GROUP BY 1
""")
def distinct_labels(spark: SparkSession, sf: str) -> DataFrame:
    """ARR-01, ARR-02, SET-03."""
    l = t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("paper")).agg(F.collect_list("l_returnflag").alias("f"))
    return l.select("paper", F.array_join(F.array_sort(fl.merged_arrays(F.col("f"), F.transform("f", F.lower))), ",").alias("flags"))


# --- pages ---------------------------------------------------------------------------------------------


@query("""
    SELECT regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '^www\\.', '') AS host, count(*) AS n FROM pages GROUP BY 1
""")
def url_host_facets(spark: SparkSession, sf: str) -> DataFrame:
    """URL-05."""
    return t(spark, sf, "pages").groupBy(fl.url_host("url").alias("host")).agg(F.count("*").alias("n"))


@query("""
    WITH u AS (SELECT page_id, regexp_replace(regexp_extract(coalesce(url, ''), '\\?([^#]*)', 1), '#.*$', '') AS q FROM pages)
    SELECT page_id, CASE WHEN regexp_matches(q, '(^|&)page=') THEN regexp_extract(q, '(?:^|&)page=([^&]*)', 1) END AS page FROM u
""")
def url_parameters(spark: SparkSession, sf: str) -> DataFrame:
    """URL-09."""
    q = F.regexp_extract(tx.blank("url"), r"\?([^#]*)", 1)
    return t(spark, sf, "pages").select("page_id", F.try_element_at(fl.query_parameters(q), F.lit("page")).alias("page"))


SQL_TITLE_TAG = "regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1)"


#: The references that occur in the pages.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def _sql_unescape(x: str, times: int = 4) -> str:
    for _ in range(times):
        for entity, ch in ENTITIES:
            x = f"replace({x}, '{entity}', '{chr(39) * 2 if ch == chr(39) else ch}')"
    return x


@query(f"""
    SELECT page_id, trim(regexp_replace(regexp_replace({_sql_unescape(SQL_TITLE_TAG)}, '<[^>]+>', ' ', 'gs'), '\\s+', ' ', 'g')) AS title FROM pages
""")
def html_title_strip(spark: SparkSession, sf: str) -> DataFrame:
    """TXT-02, TXT-03."""
    return t(spark, sf, "pages").select("page_id", pages.page_title("html").alias("title"))


@query(f"""
    WITH x AS (SELECT page_id, regexp_replace(regexp_replace({_sql_unescape("coalesce(html, '')")}, '<script\\b[^>]*>.*?</script\\s*>', ' ', 'gis'), '<style\\b[^>]*>.*?</style\\s*>', ' ', 'gis') AS x FROM pages)
    SELECT page_id, length(trim(regexp_replace(regexp_replace(x, '<[^>]+>', ' ', 'gs'), '\\s+', ' ', 'g'))) AS n_chars FROM x
""")
def html_text_length(spark: SparkSession, sf: str) -> DataFrame:
    """TXT-03 over whole pages."""
    return t(spark, sf, "pages").select("page_id", F.length(tx.strip_markup("html")).cast("long").alias("n_chars"))


@query("""
    WITH l AS (SELECT page_id AS id, unnest(regexp_extract_all(coalesce(html, ''), '(?:src|href)="([^"]*)"', 1)) AS url FROM pages),
    x AS (SELECT id, url FROM l WHERE url <> '' AND NOT regexp_matches(url, '^(?i:[a-z][a-z0-9+.-]*:|//|#|\\?)'))
    SELECT id, url, count(*) AS n FROM x WHERE url NOT IN ('/the', '/of') GROUP BY 1, 2
""")
def html_links_anti(spark: SparkSession, sf: str) -> DataFrame:
    """VAL-08: local references that the listing doesn't have."""
    local = pages.links(t(spark, sf, "pages"), "page_id", "html").where(pages.local_reference(F.col("url")))
    listing = spark.createDataFrame([("/the",), ("/of",)], "name string")
    return documents.dangling(local, "url", listing, "name").groupBy("id", "url").agg(F.count("*").alias("n")).select("id", "url", "n")


@query(f"""
    WITH p AS (SELECT page_id AS id, trim(regexp_replace(regexp_replace({_sql_unescape(SQL_TITLE_TAG)}, '<[^>]+>', ' ', 'gs'), '\\s+', ' ', 'g')) AS value FROM pages)
    SELECT id, value FROM p WHERE length(value) BETWEEN 8 AND 320 AND length(regexp_replace(value, '[^A-Za-z]', '', 'g')) >= 0.6 * length(regexp_replace(value, '[^\\p{{L}}]', '', 'g')) AND regexp_matches(value, '[A-Za-z]')
""")
def html_best_titles(spark: SparkSession, sf: str) -> DataFrame:
    """HTM-01, HTM-03, HTM-04, RNK-11: pages whose only candidate is their title tag."""
    return pages.best_title(pages.meta_candidates(t(spark, sf, "pages"), "page_id", "html"))


# --- keywords, checks, documents ----------------------------------------------------------------------


@query("""
    WITH k AS (SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')) AS k FROM documents)
    SELECT doc_id, array_to_string(list_filter([CASE WHEN contains(' ' || k || ' ', ' and ') OR contains(' ' || k || ' ', ' for ') THEN 'joiner' END, CASE WHEN contains(k, 'of the') THEN 'phrase' END], lambda x: x IS NOT NULL), ',') AS labels FROM k
    WHERE contains(' ' || k || ' ', ' the ') OR contains(k, 'of the')
""")
def matched_labels(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-07, FLT-08, FLT-09."""
    k = ky.title_key("text")
    d = t(spark, sf, "documents").withColumn("k", k).where(facets.matches_terms(F.col("k"), ["the", "of the"]))
    return d.select("doc_id", F.array_join(facets.matched_labels(F.col("k"), {"phrase": ["of the"], "joiner": ["and", "for"]}), ",").alias("labels"))


@query("""
    WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS x FROM documents)
    SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(x, '(^|[^a-z0-9_])th[aeo]t?([^a-z0-9_]|$)') THEN 'determiner' END, CASE WHEN regexp_matches(x, '(^|[^a-z0-9_])(and|und|et)([^a-z0-9_]|$)') THEN 'and' END) AS tags FROM d
""")
def rule_tags(spark: SparkSession, sf: str) -> DataFrame:
    """KWX-01, KWX-02, KWX-03, KWX-11: rules bounded by ASCII letters."""
    tags = keywords.rule_labels(F.col("text"), [("determiner", "th[aeo]t?"), ("and", "and|und|et")])
    return t(spark, sf, "documents").select("doc_id", F.array_join(tags, ",").alias("tags"))


@query("""
    SELECT p_partkey AS id, 'p_name' AS field FROM part WHERE p_size % 3 = 0 UNION ALL SELECT p_partkey, 'p_type' FROM part WHERE p_size % 5 = 0
""")
def missing_fields(spark: SparkSession, sf: str) -> DataFrame:
    """VAL-05, FLT-14: names blanked in every third size, types null in every fifth."""
    s = F.col("p_size")
    p = t(spark, sf, "part").withColumns({"p_name": F.when(s % 3 == 0, F.lit("  ")).otherwise(F.col("p_name")), "p_type": F.when(s % 5 != 0, F.col("p_type"))})
    return documents.violations(p, "p_partkey", ["p_name", "p_brand", "p_type"])


@query(r"""
    SELECT p_partkey, '@article{' || regexp_extract(p_brand, '([0-9]+)$', 1) || p_size || '-' || substr(regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g'), 1, 16) || ',' || chr(10)
        || '  title = {' || p_name || '},' || chr(10) || '  author = {' || p_brand || '},' || chr(10) || '  year = {' || p_size || '},' || chr(10) || '  journal = {' || p_type || '}' || chr(10) || '}' AS bib FROM part
""")
def bibtex_entries(spark: SparkSession, sf: str) -> DataFrame:
    """EXP-01, KEY-25."""
    none = F.lit("")
    bib = documents.bibtex(F.lit("research-paper"), F.array("p_brand"), F.col("p_name"), F.col("p_size").cast("string"), F.col("p_type"), none, none)
    return t(spark, sf, "part").select("p_partkey", bib.alias("bib"))


@query("""
    SELECT p_partkey AS id, '' AS thumbnail, p_name AS preview, p_size::VARCHAR AS label, array_to_string(string_split(p_name, ' ')[1:4], ',') AS topics, 0 AS more, '/site/talk.html?id=' || p_partkey AS url FROM part
""")
def cards(spark: SparkSession, sf: str) -> DataFrame:
    """EXP-05, EXP-07."""
    c = documents.card(t(spark, sf, "part"), "p_partkey", F.lit(""), F.col("p_name"), F.lit(None).cast("string"), F.col("p_size"), F.split("p_name", " "), "/site/")
    return c.withColumn("topics", F.array_join("topics", ","))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def hourly_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The windows of the streaming extension, in batch."""
    from quillstack.streaming.updates import counts_by_window

    return counts_by_window(t(spark, sf, "events"), "ts", "event_type")


FLAGSHIP = search_exact_topk
