"""Registered queries of text, key and field functions.

Parts, customers and orders give the words; each query writes them into the form that a function reads
(a name in brackets, a venue with its volume, a date as people write it) and the SQL says what must come
out of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.functions import fields as fl
from quillstack.functions import keys as ky
from quillstack.functions import text as tx
from quillstack.functions import udfs

from .registry import query, t


def say(form: str) -> Column:
    """Text with columns in braces."""
    import re

    parts = re.split(r"\{(\w+)\}", form)
    return F.concat(*(F.coalesce(F.col(p).cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts) if i % 2 or p))


@query("""
    SELECT p_partkey, p_name || ' ' || p_brand || ' ' || p_type || ' end img' AS plain, p_name || ' ' || p_brand || ' <' || p_type || '>' AS untagged, p_name || chr(10) || p_brand AS body FROM part
""")
def markdown_and_tags(spark: SparkSession, sf: str) -> DataFrame:
    """TXT-04, TXT-05, TXT-07."""
    md = say("# {p_name}\n```\nno\n```\n- *{p_brand}* [{p_type}](http://x) `code`\r\n1. end ![img](u)")
    return t(spark, sf, "part").select("p_partkey", tx.strip_markdown(md).alias("plain"), tx.strip_tags(say("<p>{p_name}<br>{p_brand}</p> &lt;{p_type}&gt;")).alias("untagged"), tx.normalize_body(say("  {p_name}\r\n{p_brand}\r")).alias("body"))


@query("""
    SELECT p_partkey, 'é' || p_name || chr(39) || chr(39) || '&© &nosuch; — <' || p_size || '>' AS once, 'é' || p_name || ' x' AS stripped, 'a & b' AS full_table FROM part
""")
def references_resolved(spark: SparkSession, sf: str) -> DataFrame:
    """TXT-02, TXT-03: named and numbered references, escaped more than once."""
    p = t(spark, sf, "part")
    return p.select("p_partkey", tx.unescape(say("&eacute;{p_name}&#39;&#x27;&amp;amp;&copy; &nosuch; &mdash; &amp;lt;{p_size}&gt;")).alias("once"), tx.strip_markup(say("&amp;eacute;{p_name} &lt;b&gt;x<script>no</script>")).alias("stripped"), udfs.html_unescape(F.lit("a &amp;amp; b")).alias("full_table"))


@query("""
    SELECT doc_id, doc_id % 5 = 0 OR trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9 ]+', ' ', 'g')) = '' AS placeholder,
        CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN lang ELSE 'n/a. ' || lang END AS meta FROM documents
""")
def placeholders(spark: SparkSession, sf: str) -> DataFrame:
    """TXT-11, TXT-25, KEY-02, FLT-14."""
    said = F.when(F.col("doc_id") % 5 == 0, F.lit("<i>No abstract</i> available!")).otherwise(F.col("text"))
    meta = F.when(F.col("doc_id") % 3 == 0, F.lit(" N/A ")).when(F.col("doc_id") % 3 == 1, say(" {lang} ")).otherwise(say("n/a.  {lang}"))
    return t(spark, sf, "documents").select("doc_id", tx.is_placeholder(said, ("no abstract available",)).alias("placeholder"), tx.clean_meta(meta).alias("meta"))


@query("SELECT p_partkey, p_name || ' ' || split_part(p_name, ' ', 1) AS text FROM part")
def inverted_index_text(spark: SparkSession, sf: str) -> DataFrame:
    """TXT-12: places of the words of a name, whose first comes again at the end."""
    w = F.split("p_name", " ")
    n = F.size(w)
    one = F.concat(F.lit('{"'), w[0], F.lit('":[0,'), n.cast("string"), F.lit("]"), F.array_join(F.transform(F.slice(w, F.lit(2), n), lambda x, i: F.concat(F.lit(',"'), x, F.lit('":['), (i + 1).cast("string"), F.lit("]"))), ""), F.lit("}"))
    return t(spark, sf, "part").withColumn("index", one).select("p_partkey", tx.decode_inverted_index("index").alias("text"))


@query("""
    SELECT p_partkey, 'see ' || p_name || ' x86 é' AS fragment, p_name AS title, p_name AS annotated, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS cased,
        CASE p_size % 3 WHEN 0 THEN 'Blog Post' WHEN 1 THEN 'Thesis' ELSE upper(p_type[1]) || lower(p_type[2:]) END AS kind, p_size % 4 < 2 AS low FROM part
""")
def titles_and_fragments(spark: SparkSession, sf: str) -> DataFrame:
    """TXT-15 to TXT-19, TXT-26, TXT-27."""
    kind = F.when(F.col("p_size") % 3 == 0, F.lit("blog-post")).when(F.col("p_size") % 3 == 1, F.lit("PhD-Thesis")).otherwise(F.lower("p_type"))
    abstract = F.when(F.col("p_size") % 4 == 0, say("Cookie policy and terms of use. " + "word " * 30)).when(F.col("p_size") % 4 == 1, say("Cookie policy of {p_name}")).when(F.col("p_size") % 4 == 2, F.lit("Cookie policy " + "word " * 30)).otherwise(F.col("p_name"))
    return t(spark, sf, "part").select(
        "p_partkey", tx.mining_fragment(say("See https://x.y/z?q ({p_name}) www\nx86é")).alias("fragment"), tx.clean_title(say("{p_name}  ▲ Back to Schedule of the day")).alias("title"), tx.strip_title_annotation(say("{p_name} [powered by NICT] 【機械翻訳】")).alias("annotated"),
        tx.title_case_slug(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("cased"), tx.paper_type_label(kind).alias("kind"), tx.low_signal_abstract(abstract, ("cookie policy", "terms of use")).alias("low"),
    )


@query("""
    SELECT p_partkey, 'The talk of ' || p_size AS abstract, '' AS bare, p_name || ' goes on' AS kept FROM part
""")
def abstracts_cleaned(spark: SparkSession, sf: str) -> DataFrame:
    """TXT-20, TXT-21, TXT-22: a leading title, link tags and speakers go, a sentence that begins like the title stays."""
    return t(spark, sf, "part").select("p_partkey", udfs.clean_abstract(say("{p_name} [Video] [Slides] Speakers: {p_brand} (Acme) - The talk of {p_size}"), "p_name", F.array("p_brand")).alias("abstract"), udfs.strip_leading_title(say("{p_name}"), "p_name").alias("bare"), udfs.strip_leading_title(say("{p_name} goes on"), "p_name").alias("kept"))


@query("""
    SELECT p_partkey, 'text:' || p_name || ';bullets:' || p_brand || '|' || p_type || ';numbers:one|two' AS blocks, p_name || chr(10) || 'é"' AS literal, '\\x' AS broken FROM part
""")
def abstract_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """TXT-28, TXT-29."""
    b = tx.paragraphs(say("{p_name}\n\n- {p_brand}\n* {p_type}\n\n\n1. one\n2) two"))
    line = F.array_join(F.transform(b, lambda x: F.concat(x["kind"], F.lit(":"), F.array_join(x["lines"], "|"))), ";")
    return t(spark, sf, "part").select("p_partkey", line.alias("blocks"), tx.decode_json_literal(say('{p_name}\\n\\u00e9\\"')).alias("literal"), tx.decode_json_literal(F.lit("\\x")).alias("broken"))


@query("""
    SELECT p_partkey, p_name AS title, 'a|' || p_brand AS tags, 'Body ' || p_size AS body, p_type AS toml, p_name AS no_matter FROM part
""")
def front_matter_fields(spark: SparkSession, sf: str) -> DataFrame:
    """TXT-30, TXT-31: YAML and TOML, lists in one line and in many."""
    yaml = udfs.front_matter(say("---\ntitle: \"{p_name}\"\ntags:\n  - a\n  - {p_brand}\n---\nBody {p_size}"))
    toml = udfs.front_matter(say("+++\nkinds = [\"{p_type}\"]\n+++\nx"))
    return t(spark, sf, "part").withColumns({"y": yaml, "o": toml, "n": udfs.front_matter(F.col("p_name"))}).select("p_partkey", F.element_at(F.col("y")["meta"]["title"], 1).alias("title"), F.array_join(F.col("y")["meta"]["tags"], "|").alias("tags"), F.col("y")["body"].alias("body"), F.element_at(F.col("o")["meta"]["kinds"], 1).alias("toml"), F.col("n")["body"].alias("no_matter"))


@query("""
    SELECT p_partkey, 'https://www.youtube.com/watch?v=abcdefghijk ![](/' || p_size || '.png) ' AS codes, '<a>' || p_name || '</a>' AS safe, lower(p_brand) || '=http://x/' || p_size AS refs, p_type || '/' || p_name AS args FROM part
""")
def shortcodes_and_markup(spark: SparkSession, sf: str) -> DataFrame:
    """TXT-33, TXT-34, TXT-35, TXT-36."""
    refs = tx.reference_definitions(say("text\n[{p_brand}]: <http://x/{p_size}>\n```\n[no]: y\n```"))
    args = tx.shortcode_args(say('kind="{p_type}" "{p_name}"'))
    return t(spark, sf, "part").select(
        "p_partkey", tx.rewrite_shortcodes(say('{{< youtube abcdefghijk >}} {{< figure src="/{p_size}.png" >}} {{< foo >}}')).alias("codes"),
        tx.sanitize_html(say('<a href="javascript:x" onclick="y">{p_name}</a><script>q</script><iframe src="z"></iframe>')).alias("safe"),
        F.concat_ws("=", refs[0]["label"], refs[0]["url"]).alias("refs"), F.concat_ws("/", args["named"]["kind"], args["positional"][0]).alias("args"),
    )


# --- keys ----------------------------------------------------------------------------------------------


@query("""
    WITH c AS (SELECT c_custkey, replace(lower(c_name), '#', ' ') AS n, lower(c_mktsegment) AS s FROM customer)
    SELECT c_custkey, n || ' x' AS soft, 'jose ' || n AS name_key, 'josefin' || replace(n, ' ', '') AS person, 'universityof' || s AS affiliation, '10.1234/ab' || c_custkey AS doi, 'W' || c_custkey AS work FROM c
""")
def record_key_forms(spark: SparkSession, sf: str) -> DataFrame:
    """KEY-02, KEY-04, KEY-05, KEY-06, KEY-07, KEY-08, KEY-09."""
    return t(spark, sf, "customer").select(
        "c_custkey", ky.soft_key(say("<b>{c_name}</b> &amp; x")).alias("soft"), ky.name_key(say("José {c_name}")).alias("name_key"), ky.person_key(F.replace(say("Josê-Fin {c_name}"), F.lit("#"), F.lit(" "))).alias("person"),
        ky.affiliation_key(say("The Univ. of {c_mktsegment} (USA)")).alias("affiliation"), ky.doi_key(say("https://doi.org/10.1234/AB{c_custkey}).")).alias("doi"), ky.work_id(say("https://api.example.org/w{c_custkey}")).alias("work"),
    )


@query("""
    WITH c AS (SELECT c_custkey, 'n' || c_custkey AS l, c_custkey % 4 AS k FROM customer)
    SELECT c_custkey, 'jane|' || l AS base_key, CASE WHEN k = 0 THEN '' ELSE 'q' END AS initials, l || '|j' AS signature, k <> 3 AS variants, k <> 3 AS same, k < 2 AS last_fits FROM c
""")
def person_signatures(spark: SparkSession, sf: str) -> DataFrame:
    """KEY-10, KEY-11, KEY-12, KEY-26, FLT-04: no middle name, an initial, a full one, and another person's."""
    k = F.col("c_custkey") % 4
    name = F.when(k == 0, say("Jane N{c_custkey}")).otherwise(say("Jane Q. N{c_custkey}"))
    other = F.when(k == 3, say("Jane R. N{c_custkey}")).when(k == 2, say("jane q n{c_custkey}")).otherwise(say("Jane Q N{c_custkey}"))
    a, b = ky.person_signature(name), ky.person_signature(other)
    last = F.when(k == 0, say("n{c_custkey}")).when(k == 1, say("van-n{c_custkey}")).when(k == 2, F.lit("")).otherwise(F.lit("doe"))
    return t(spark, sf, "customer").select("c_custkey", a["base_key"].alias("base_key"), a["initials"].alias("initials"), ky.name_signature(name).alias("signature"), ky.middle_variants(a, b).alias("variants"), ky.same_person(a, b).alias("same"), ky.compatible_last_names(a["last"], last).alias("last_fits"))


@query("""
    SELECT c_custkey, 'N' || c_custkey || ' B' AS name, CASE c_custkey % 4 WHEN 3 THEN '' ELSE c_mktsegment || ' University' END AS place, 'B' || c_custkey || ' Ada' AS shown,
        CASE c_custkey % 4 WHEN 0 THEN 'Institute of ' || c_mktsegment WHEN 3 THEN '' ELSE c_mktsegment || ' University' END AS settled FROM customer
""")
def speakers_split(spark: SparkSession, sf: str) -> DataFrame:
    """KEY-17, KEY-18, KEY-20: the place in brackets, after a dash, after a comma, and none."""
    k = F.col("c_custkey") % 4
    said = F.when(k == 0, say("N{c_custkey} B ({c_mktsegment} University)")).when(k == 1, say("N{c_custkey} B - {c_mktsegment} University")).when(k == 2, say("N{c_custkey} B, {c_mktsegment} University")).otherwise(say("N{c_custkey} B"))
    s = ky.split_speaker(said)
    r = ky.person_record(said, F.when(k == 0, say("Inst. of {c_mktsegment}")).otherwise(F.lit("n/a")))
    return t(spark, sf, "customer").select("c_custkey", s["name"].alias("name"), s["affiliation"].alias("place"), ky.display_name(say(" Ada,  B{c_custkey} ")).alias("shown"), r["affiliation"].alias("settled"))


@query("""
    SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'University of ' || c_mktsegment WHEN 1 THEN c_mktsegment || ' Institute, Department A' WHEN 2 THEN 'A & B' WHEN 3 THEN c_mktsegment || ' Lab' ELSE '' END AS affiliation FROM customer
""")
def affiliations(spark: SparkSession, sf: str) -> DataFrame:
    """KEY-19."""
    k = F.col("c_custkey") % 5
    said = F.when(k == 0, say("Univ. of {c_mktsegment} ( United States )")).when(k == 1, say("{c_mktsegment} Inst , Dept. A ;")).when(k == 2, F.lit("A&B (UK)")).when(k == 3, say("{c_mktsegment}  Lab.")).otherwise(F.lit(" Unknown "))
    return t(spark, sf, "customer").select("c_custkey", ky.normalize_affiliation(said).alias("affiliation"))


@query("""
    SELECT p_partkey, p_size % 3 <> 2 AS student, CASE p_size % 3 WHEN 0 THEN 'technical-talk' WHEN 1 THEN 'keynote' END AS heading, CASE p_size % 3 WHEN 0 THEN 'C++ Libs' END AS topic FROM part
""")
def talk_classes(spark: SparkSession, sf: str) -> DataFrame:
    """KEY-22, KEY-23, KEY-24."""
    k = F.col("p_size") % 3
    title = F.when(k == 0, say("Student Talk: {p_name}")).otherwise(F.col("p_name"))
    slides = F.when(k == 1, say("/{p_partkey}/Student-Talk.pdf")).otherwise(say("/{p_partkey}.pdf"))
    heading = F.when(k == 0, F.lit("Technical  Talks:")).when(k == 1, say("Keynote of {p_name}")).otherwise(F.lit("Lunch"))
    topic = F.when(k == 0, F.lit("c++ libs")).otherwise(F.col("p_name"))
    labels = [("technical talks", "technical-talk"), ("keynote", "keynote")]
    return t(spark, sf, "part").select("p_partkey", ky.student_talk(title, slides).alias("student"), ky.category_from_heading(heading, labels).alias("heading"), ky.canonical_topic(topic, {"c++libs": "C++ Libs"}).alias("topic"))


# --- addresses, dates, numbers -----------------------------------------------------------------------------


@query("""
    WITH c AS (SELECT c_custkey, 'v' || lpad(c_custkey::VARCHAR, 10, '0') AS v, c_custkey % 5 AS k FROM customer)
    SELECT c_custkey, CASE WHEN k < 3 THEN v ELSE '' END AS video, CASE WHEN k < 3 THEN 'Watch' WHEN k = 3 THEN 'Download' ELSE 'Watch on media.example.org' END AS label FROM c
""")
def video_links(spark: SparkSession, sf: str) -> DataFrame:
    """URL-01, URL-05: three forms of one host, a file, another host."""
    k, v = F.col("c_custkey") % 5, F.concat(F.lit("v"), F.lpad(F.col("c_custkey").cast("string"), 10, "0"))
    url = F.when(k == 0, F.concat(F.lit("https://youtu.be/"), v, F.lit("?t=3"))).when(k == 1, F.concat(F.lit("https://www.youtube.com/watch?a=b&v="), v)).when(k == 2, F.concat(F.lit("https://m.youtube.com/embed/"), v)).when(k == 3, say("https://x.org/{c_custkey}.mp4")).otherwise(say("https://media.example.org/{c_custkey}"))
    return t(spark, sf, "customer").select("c_custkey", fl.youtube_id(url).alias("video"), fl.video_link_label(url).alias("label"))


@query("""
    SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'https://x.org/m/2024/' || p_size || '.html' WHEN 1 THEN 'https://x.org/' || p_size ELSE 'http://y.org/' || p_size END AS full_url,
        CASE p_size % 2 WHEN 0 THEN 'http://a/' || p_size || '.PDF?x' ELSE 'http://a/page' END AS best, CASE WHEN p_size % 2 = 0 THEN 'https://x/' || p_size || '.pdf' ELSE 'https://x/' || p_size || '-final.pdf' END AS pdf,
        CASE WHEN p_size % 2 = 0 THEN 200 ELSE 140 END AS score FROM part
""")
def picked_addresses(spark: SparkSession, sf: str) -> DataFrame:
    """URL-02, URL-03, URL-04, RNK-18."""
    k, even = F.col("p_size") % 3, F.col("p_size") % 2 == 0
    href = F.when(k == 0, say("{p_size}.html")).when(k == 1, say("/{p_size}")).otherwise(say("http://y.org/{p_size}"))
    links = F.array(F.lit("https://x/supplement.pdf"), say("https://x/{p_size}-slides.pdf"), F.when(even, say("https://x/{p_size}.pdf")).otherwise(say("https://x/{p_size}-final.pdf")), say("https://x/{p_size}.html"))
    best = fl.primary_pdf(links, F.col("p_size").cast("string"))
    return t(spark, sf, "part").select("p_partkey", fl.absolute_url(F.lit("https://x.org/m/2024/"), href).alias("full_url"), fl.pick_paper_url(F.array(F.lit(" "), F.lit("http://a/page"), F.when(even, say("http://a/{p_size}.PDF?x")).otherwise(F.lit(None)))).alias("best"), best.alias("pdf"), fl.pdf_score(best, F.col("p_size").cast("string"))["score"].cast("int").alias("score"))


@query("""
    SELECT p_partkey, 'https://s.org/talk.html?id=' || replace(replace(p_brand, '#', '%23'), ' ', '%20') AS detail, CASE WHEN p_size % 2 = 0 THEN 'https://s.org/x/' || p_size ELSE 'http://y/' || p_size END AS internal,
        CASE WHEN p_size % 3 = 0 THEN '' ELSE '/a/' || p_size END AS safe, CASE p_size % 3 WHEN 0 THEN 'https://b.org/a/' || p_size WHEN 1 THEN 'https://b.org/alias' ELSE 'https://b.org/posts/' || p_size || '/' END AS post FROM part
""")
def site_addresses(spark: SparkSession, sf: str) -> DataFrame:
    """URL-06, URL-07, URL-08, URL-10, EXP-05."""
    k, none = F.col("p_size") % 3, F.array().cast("array<string>")
    safe = F.when(k == 0, say(" JavaScript:alert({p_size})")).otherwise(say("/a/{p_size}"))
    post = fl.blog_url("https://b.org/", F.when(k == 0, say("/a/{p_size}")).otherwise(F.lit("")), F.when(k == 1, F.array(F.lit("alias"))).otherwise(none), F.col("p_size").cast("string"))
    inside = F.when(F.col("p_size") % 2 == 0, say("/library/x/{p_size}")).otherwise(say("http://y/{p_size}"))
    return t(spark, sf, "part").select("p_partkey", fl.detail_url(F.lit("https://s.org/"), "talk.html", "p_brand").alias("detail"), fl.internal_url(inside, "https://s.org", "library").alias("internal"), fl.safe_url(safe).alias("safe"), post.alias("post"))


@query("""
    WITH o AS (SELECT o_orderkey, o_orderdate AS d, o_orderkey % 3 AS k FROM orders)
    SELECT o_orderkey, CASE WHEN k = 2 THEN 'Spring ' || year(d) ELSE strftime(d, '%B ') || day(d) || ', ' || year(d) END AS label, strftime(d, '%Y-%m-') || CASE WHEN k = 1 THEN '01' ELSE strftime(d, '%d') END AS post,
        CASE WHEN k <> 2 THEN strftime(d, '%Y-%m-%d') || ' 10:00:00' END AS at_utc, d < TIMESTAMP '1998-01-01' - INTERVAL 30 DAY OR k = 2 AS stale FROM o
""")
def date_forms(spark: SparkSession, sf: str) -> DataFrame:
    """DAT-02, DAT-04, DAT-05, DAT-06."""
    k, d = F.col("o_orderkey") % 3, F.col("o_orderdate")
    said = F.when(k == 2, F.concat(F.lit("Spring "), F.year(d).cast("string"))).otherwise(F.concat(F.date_format(d, "MMM d"), F.lit("th,  "), F.year(d).cast("string")))
    meta = F.when(k == 0, F.date_format(d, "yyyy-MM-dd'T'00:00:00")).otherwise(F.lit("soon"))
    name = F.when(k == 1, F.concat(F.date_format(d, "yyyy-MM"), F.lit("-post.md"))).otherwise(F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("-post.md")))
    stamp = F.when(k == 0, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T12:00:00+02:00"))).when(k == 1, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T10:00:00"))).otherwise(F.lit("when?"))
    day = F.when(k == 2, F.lit("when?")).otherwise(F.date_format(d, "yyyy-MM-dd"))
    return t(spark, sf, "orders").select("o_orderkey", fl.meeting_date_label(said).alias("label"), fl.post_date(meta, name).alias("post"), F.date_format(fl.iso_timestamp(stamp), "yyyy-MM-dd HH:mm:ss").alias("at_utc"), fl.older_than(day, 30, F.lit("1998-01-01").cast("timestamp")).alias("stale"))


@query("""
    SELECT o_orderkey, regexp_matches(lower(o_orderpriority), 'm.*d.*u') AS has_mdu, format('{:,}', o_orderkey) AS shown,
        'a|B' || o_orderkey AS csv, 'slides,video' AS parts, 'Ann ' || o_orderkey || '|Bo|Cy' AS authors FROM orders
""")
def numbers_and_lists(spark: SparkSession, sf: str) -> DataFrame:
    """NUM-04, NUM-05, ARR-03, ARR-04, ARR-05."""
    o = t(spark, sf, "orders")
    return o.select(
        "o_orderkey", fl.is_subsequence("mdu", F.lower("o_orderpriority")).alias("has_mdu"), fl.format_count(F.col("o_orderkey").cast("string")).alias("shown"), F.array_join(fl.csv_values(say(" a ,, B{o_orderkey} ,")), "|").alias("csv"),
        F.array_join(fl.ordered_parts(F.array(F.lit(" Video"), F.lit("SLIDES"), F.lit("x"))), ",").alias("parts"), F.array_join(fl.author_list(say("Ann {o_orderkey}; Bo and  Cy, bo")), "|").alias("authors"),
    )


@query("""
    SELECT o_orderkey AS paper, count(*)::BIGINT AS authors, min('C' || l_suppkey || '/' || CASE WHEN l_suppkey % 2 = 0 THEN 'U' || l_suppkey ELSE '' END) AS first_author FROM orders JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) ON l_orderkey = o_orderkey GROUP BY 1
""")
def authors_of_works(spark: SparkSession, sf: str) -> DataFrame:
    """ARR-06: nested authorships, the first institution that says anything, one entry a name."""
    blank_place, place = F.struct(F.lit(" ").alias("display_name")), F.struct(F.when(F.col("l_suppkey") % 2 == 0, say("U{l_suppkey}")).otherwise(F.lit("")).alias("display_name"))
    one = F.struct(F.struct(say("C{l_suppkey}").alias("display_name")).alias("author"), F.array(blank_place, place).alias("institutions"))
    a = t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("paper")).agg(F.collect_list(one).alias("a")).withColumn("p", fl.work_authors(F.col("a")))
    first = F.array_min(F.transform("p", lambda x: F.concat_ws("/", x["name"], x["affiliation"])))
    return a.select("paper", F.size("p").cast("long").alias("authors"), first.alias("first_author"))


@query("""
    WITH p AS (SELECT *, p_size % 3 AS k FROM part)
    SELECT p_partkey, p_brand || ' | Vol. ' || p_size || CASE WHEN k = 0 THEN ' (Issue 2)' ELSE '' END AS venue, p_size || '/' || CASE WHEN k = 0 THEN '2' ELSE '' END AS vi, p_name || ' | Vol. ' || p_size || ' (Issue 3) | ' || p_type AS rebuilt,
        CASE k WHEN 0 THEN p_name WHEN 1 THEN p_brand ELSE '' END AS publication FROM p
""")
def venues(spark: SparkSession, sf: str) -> DataFrame:
    """JSN-01, JSN-02, JSN-03."""
    k = F.col("p_size") % 3
    made = fl.publication_and_venue("p_brand", F.col("p_size").cast("string"), F.when(k == 0, F.lit("2")).otherwise(F.lit("none")))
    vi = fl.volume_and_issue(made["venue"])
    return t(spark, sf, "part").select("p_partkey", made["venue"].alias("venue"), F.concat_ws("/", vi["volume"], vi["issue"]).alias("vi"), fl.rebuild_venue("p_name", say("{p_name} |vol. {p_size} (issue 3) | | {p_type}|{p_type}")).alias("rebuilt"), fl.derive_publication(F.when(k == 0, F.col("p_name")).otherwise(F.lit(" ")), F.when(k == 1, say(" {p_brand} | x")).otherwise(say("Vol. {p_size}"))).alias("publication"))


@query("""
    SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'thesis' WHEN 1 THEN lower(p_type) ELSE 'research-paper' END AS kind, CASE p_size % 3 WHEN 0 THEN replace(lower(p_brand), '#', '-') WHEN 1 THEN 'bundle' ELSE 'unknown' END AS source,
        CASE WHEN p_size % 2 = 0 THEN '/t?' || p_size END AS url, CASE WHEN p_size % 2 = 0 THEN p_size::DOUBLE END AS y FROM part
""")
def record_types(spark: SparkSession, sf: str) -> DataFrame:
    """JSN-04, JSN-05, JSN-06."""
    k = F.col("p_size") % 3
    state = fl.navigation_state(F.when(F.col("p_size") % 2 == 0, say('{"from":"talks","url":"/t?{p_size}","y":{p_size}}')).otherwise(say("{broken {p_size}")))
    return t(spark, sf, "part").select(
        "p_partkey", fl.classify_type(F.when(k == 0, F.lit("Dissertation")).otherwise(F.lit("article")), F.when(k == 1, F.col("p_type")).otherwise(F.lit(""))).alias("kind"),
        fl.source_slug(F.when(k == 0, F.col("p_brand")).otherwise(F.lit(" ")), F.when(k == 1, F.lit("Bundle")).otherwise(F.lit(None))).alias("source"), state["url"].alias("url"), state["y"].alias("y"),
    )
