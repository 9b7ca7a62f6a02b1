"""Registered queries of pages: talks, titles and values out of HTML.

Each part is a page of its own, written from the part's words in the forms that such pages have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.functions import udfs
from quillstack.functions.text import strip_markup
from quillstack.operators import documents, pages

from .registry import query, t
from .texts import say


def page(spark: SparkSession, sf: str, form: str) -> DataFrame:
    return t(spark, sf, "part").select("p_partkey", say(form).alias("html"), "p_name", "p_brand", "p_type", "p_size")


@query("""
    SELECT p_partkey AS id, 'tutorial' AS category, p_name AS title, p_brand || ' (Acme), Bo' AS speakers, 'A longer text on ' || p_type AS abstract, '/v/' || p_size AS video, 's.pdf' AS slides FROM part
    UNION ALL SELECT p_partkey, 'keynote', 'On ' || p_type, '', '', '', '' FROM part
    UNION ALL SELECT p_partkey, 'tutorial', 'Last ' || p_brand, '', 'The end', '', '' FROM part
""")
def session_talks(spark: SparkSession, sf: str) -> DataFrame:
    """HTM-07, HTM-11, WIN-02, TXT-22, KEY-23: a heading that names no category leaves the last one open."""
    p = page(spark, sf, (
        '<p><b>Tutorials</b></p><div class="session-entry"><i>{p_name}</i><br>Speakers: {p_brand} (Acme), Bo<br><a href="/v/{p_size}">Video</a> <a href="s.pdf">Slides</a>'
        "<p>Short</p><p>{p_name} [Video] A longer text on {p_type}</p></div>"
        '<p><b>Lunch</b></p><div class="session-entry"><i>Keynote: On {p_type}</i></div><div class="session-entry"><i>Last {p_brand}</i><p>The end</p><p>Last {p_brand}</p></div>'))  # fmt: skip
    return pages.session_entries(p, "p_partkey", "html").drop("pos")


@query("""
    SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'keynote' ELSE 'technical-talk' END AS category, p_name AS title, p_brand AS speakers, p_name || ': About ' || p_type AS abstract FROM part WHERE p_size % 3 <> 0
""")
def section_talks(spark: SparkSession, sf: str) -> DataFrame:
    """HTM-08: only of pages without session entries."""
    entry = F.when(F.col("p_size") % 3 == 0, F.lit('<div class="session-entry"><i>x</i></div>')).otherwise(F.lit(""))
    keynote = F.when(F.col("p_size") % 2 == 0, F.lit("Keynote: ")).otherwise(F.lit(""))
    html = F.concat(entry, F.lit("<h3 id='a'>Call for Speakers</h3><h4>x</h4><p>y</p><h3 id=\"b\">"), keynote, say("{p_name}</h3>\n<h4>{p_brand}</h4> <p>{p_name}: About {p_type}</p>"))
    p = t(spark, sf, "part").select("p_partkey", html.alias("html"))
    return pages.abstract_sections(p, "p_partkey", "html", pages.session_entries(p, "p_partkey", "html")).select("id", "category", "title", "speakers", "abstract")


@query("""
    SELECT year(o_orderdate) || '-' || lpad(month(o_orderdate)::VARCHAR, 2, '0') AS slug, 'Day of ' || max(o_orderkey) AS date, 'Hall - ' || CASE WHEN max(o_orderkey) % 2 = 0 THEN 'A' ELSE 'B' END AS location FROM orders GROUP BY 1
""")
def meeting_hints(spark: SparkSession, sf: str) -> DataFrame:
    """HTM-12: one index page of a list entry a month, made of the months' last orders."""
    m = F.date_format("o_orderdate", "yyyy-MM")
    o = t(spark, sf, "orders").groupBy(m.alias("m")).agg(F.max("o_orderkey").alias("k"))
    li = F.concat(say('<li><b><a href="{m}/">Day of {k}</a></b> in - Hall - '), F.when(F.col("k") % 2 == 0, F.lit("A - Canceled")).otherwise(F.lit("B")), F.lit("</li><li>no link</li>"))
    return pages.index_hints(o.select(li.alias("html")), "html")


@query("""
    SELECT p_partkey, p_type AS place, CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN p_brand ELSE 'slug-' || p_size END AS name, p_size % 2 = 0 AS canceled, 'On ' || p_type AS abstract, '/' || p_size || '.pdf' AS slides FROM part
""")
def page_values(spark: SparkSession, sf: str) -> DataFrame:
    """HTM-09, HTM-10, HTM-11, HTM-13, HTM-14."""
    k = F.col("p_size") % 3
    head = F.when(k == 0, say("<h1>{p_name}</h1>")).when(k == 1, say('<div class="www_sectiontitle">{p_brand}</div>')).otherwise(F.lit(""))
    rest = say('<ul><li><b>When</b>: x</li><li><b>Where:</b> <i>{p_type}</i></li></ul><a href="v">a talk</a> <a href="/{p_size}.pdf">The Slides</a> <h2>Abstract:</h2> <blockquote>On <b>{p_type}</b></blockquote>')
    html = F.concat(head, rest, F.when(F.col("p_size") % 2 == 0, F.lit("<p>Cancelled!</p>")).otherwise(F.lit("")))
    return t(spark, sf, "part").select("p_partkey", pages.labelled_value(html, ["Location", "Where"]).alias("place"), pages.meeting_name(html, say("slug-{p_size}")).alias("name"), pages.is_canceled(html).alias("canceled"), pages.abstract_of(html).alias("abstract"), pages.first_link(html, "slide").alias("slides"))


@query("""
    SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'The "' || p_name || '" thing' ELSE 'A study of ' || p_name END AS title FROM part
""")
def best_titles_of_scripts(spark: SparkSession, sf: str) -> DataFrame:
    """HTM-01, HTM-02, HTM-03, HTM-04, RNK-11: a script that says English wins over the title tag, metadata that says cookies loses."""
    script = F.when(F.col("p_size") % 3 == 0, say("<script>var x = {englishTitle: 'The \\\"{p_name}\\\" thing', title = 7};</script>")).otherwise(say("<script type=\"application/ld+json\">{\"name\": \"A study of {p_name}\"}</script>"))
    html = F.concat(say('<title>Page {p_brand} ééé</title><meta name="og:title" content="Accept the cookie of {p_name} and go on">'), script)
    c = pages.meta_candidates(t(spark, sf, "part").select("p_partkey", html.alias("html")), "p_partkey", "html")
    return pages.best_title(c).select("id", F.col("value").alias("title"))


@query("""
    SELECT p_partkey AS id, 'We show that ' || p_name || ' is better than ' || p_brand || ' in more ways than there are in this world of many ways' AS abstract FROM part
""")
def best_abstracts(spark: SparkSession, sf: str) -> DataFrame:
    """HTM-01, HTM-05: of a German and an English abstract the latter, whatever comes first."""
    html = say('<meta name="dc.description" lang="de" content="Größe übertrifft Änderung: öäüßéèêëàâîïôûçñáíóúÀÉÈÖÄÜ ÿžščřžýáíéúůťďň ĺľŕ {p_name} ĄĆĘŁŃÓŚŹŻąćęłńóśźż"><meta name="citation_abstract" content="We show that {p_name} is better than {p_brand} in more ways than there are in this world of many ways">')
    c = pages.meta_candidates(t(spark, sf, "part").select("p_partkey", html.alias("html")), "p_partkey", "html")
    return pages.best_abstract(c).select("id", F.col("value").alias("abstract"))


@query("""
    SELECT p_partkey, p_size % 4 < 3 AS low FROM part
""")
def low_quality_titles(spark: SparkSession, sf: str) -> DataFrame:
    """HTM-06: boilerplate, the publication itself, two short words, and a real title."""
    k = F.col("p_size") % 4
    title = F.when(k == 0, F.lit(" Sign   in ")).when(k == 1, say("The {p_name} Letters")).when(k == 2, F.lit("Short one")).otherwise(say("A study of {p_name}"))
    return t(spark, sf, "part").select("p_partkey", pages.low_quality_title(title, say("the {p_name} letters"), F.lit("")).alias("low"))


@query(r"""
    SELECT p_partkey, 2 AS n, 'O''Neil ' || p_name AS title, '199' || p_size % 10 AS year, 'next' AS other FROM part
""")
def script_objects(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-09, SRC-10: objects of an array in JavaScript source, strings joined by +, comments, numbers."""
    src = F.concat(F.lit("// list\nvar PUBS = [{title: 'O\\'Neil ' + \""), F.col("p_name"), F.lit("\", /* c */ year: 199"), (F.col("p_size") % 10).cast("string"), F.lit("}, {title: 'next', x: null},];"))
    rows = t(spark, sf, "part").select("p_partkey", src.alias("src"))
    rows.createOrReplaceTempView("script_sources")
    spark.udtf.register("js_objects", udfs.JsObjects)
    o = spark.sql("SELECT p_partkey, o.seq, o.fields FROM script_sources, LATERAL js_objects(src, 'PUBS') o")
    return o.groupBy("p_partkey").agg(F.count("*").cast("int").alias("n"), F.max(F.when(F.col("seq") == 0, F.col("fields")["title"])).alias("title"), F.max(F.when(F.col("seq") == 0, F.col("fields")["year"])).alias("year"), F.max(F.when(F.col("seq") == 1, F.col("fields")["title"])).alias("other"))


# --- derived documents ------------------------------------------------------------------------------------


@query("""
    SELECT p_partkey, '{"@context":"https://schema.org","@type":"ScholarlyArticle","headline":"' || p_name || '","author":[{"@type":"Person","name":"' || p_brand || '"}],"datePublished":"' || p_size || '"}' AS paper,
        '{"@context":"https://schema.org","@type":"' || CASE WHEN p_size % 2 = 0 THEN 'VideoObject' ELSE 'CreativeWork' END || '","name":"' || p_name || '","description":"' || p_type || '"' || CASE WHEN p_size % 2 = 0 THEN ',"contentUrl":"v' || p_size || '"' ELSE '' END || '}' AS talk FROM part
""")
def linked_data(spark: SparkSession, sf: str) -> DataFrame:
    """EXP-02, EXP-03: blank fields are left out."""
    none = F.lit("")
    video = F.when(F.col("p_size") % 2 == 0, say("v{p_size}")).otherwise(none)
    return t(spark, sf, "part").select("p_partkey", documents.paper_json_ld(F.col("p_name"), F.array("p_brand"), F.col("p_size").cast("string"), none, none).alias("paper"), documents.talk_json_ld(F.col("p_name"), F.col("p_type"), video, none).alias("talk"))


@query("""
    SELECT p_partkey, 'https://x/new?title=' || replace(p_name, ' ', '%20') || '&body=' || replace(substr(p_name, 1, 4), ' ', '%20') AS issue, CASE WHEN p_size % 2 = 0 THEN 'https://s.org/p/' || p_size ELSE 'http://y/' || p_size END AS public,
        CASE p_size % 3 WHEN 0 THEN 'Post' WHEN 1 THEN 'PDF' ELSE 'Paper' END AS action, p_brand || ', Bo' AS speakers FROM part
""")
def exported_forms(spark: SparkSession, sf: str) -> DataFrame:
    """EXP-04, EXP-06, EXP-08, EXP-09."""
    k = F.col("p_size") % 3
    people = F.array(F.struct(say(" {p_brand} ").alias("name")), F.struct(F.lit("").alias("name")), F.struct(F.lit("Bo").alias("name")))
    url = F.when(F.col("p_size") % 2 == 0, say("./p/{p_size}")).otherwise(say("http://y/{p_size}"))
    return t(spark, sf, "part").select("p_partkey", documents.issue_url("https://x/new", F.col("p_name"), F.substring("p_name", 1, 4), 120, 1200).alias("issue"), documents.public_url(url, "https://s.org").alias("public"), documents.action_label(F.when(k == 1, F.lit("a.pdf#p")).otherwise(F.lit("a.html")), k == 0).alias("action"), documents.speaker_list(people).alias("speakers"))


@query("""
    SELECT 'missing' AS problem, 'site/0.html' AS path UNION ALL SELECT 'missing', 'nowhere' UNION ALL SELECT 'stray', 'site/' || p_partkey || '.html' FROM part WHERE p_partkey % 3 = 1
    UNION ALL SELECT 'dangling', 'site/' || (p_partkey + 1) || '.json' FROM part WHERE p_partkey % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM part q WHERE q.p_partkey = part.p_partkey + 1 AND q.p_partkey % 3 = 0)
""")
def listing_checks(spark: SparkSession, sf: str) -> DataFrame:
    """VAL-01, VAL-02, VAL-03, VAL-06: a listing where every third file is JSON and every third HTML, and references to neighbours."""
    k = F.col("p_partkey") % 3
    path = F.concat(F.lit("site/"), F.col("p_partkey").cast("string"), F.when(k == 0, F.lit(".json")).when(k == 1, F.lit(".html")).otherwise(F.lit(".HTM.json")))
    files = t(spark, sf, "part").select(path.alias("path"), "p_partkey")
    refs = files.where(F.col("p_partkey") % 3 != 0).select(F.concat(F.lit("site/"), (F.col("p_partkey") + 1).cast("string"), F.lit(".json")).alias("path"))
    said = lambda d, what: d.select(F.lit(what).alias("problem"), "path")
    missing = documents.missing_files(files, "path", ["site/0.html", "site/0.json", "nowhere"])
    listed = files.where("p_partkey % 3 = 0").select("path")
    return said(missing, "missing").unionByName(said(documents.stray_files(files, "path", "site/"), "stray")).unionByName(said(documents.dangling(refs, "path", listed, "path"), "dangling"))


@query("""
    WITH e AS (SELECT page_id, unnest(regexp_extract_all(regexp_replace(lower(html), '(?s)<(script|style)>.*?</(script|style)>|<!--.*?-->', '<\\1>', 'g'), '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages)
    SELECT page_id, tag, count(*) AS n, CASE tag WHEN 'html' THEN 0 WHEN 'head' THEN 1 WHEN 'body' THEN 1 WHEN 'title' THEN 2 WHEN 'nav' THEN 2 WHEN 'ul' THEN 3 WHEN 'li' THEN 4 WHEN 'a' THEN 5 ELSE -1 END AS depth FROM e GROUP BY 1, 2
""")
def page_elements(spark: SparkSession, sf: str) -> DataFrame:
    """TXT-34, HTM-01: the elements of all pages by tag, and how deep those of a fixed place lie: list entries don't nest in each other, and what is never closed ends with its parent."""
    e = pages.elements(t(spark, sf, "pages"), "page_id", "html").groupBy(F.col("id").alias("page_id"), "tag").agg(F.count("*").alias("n"), F.max("depth").alias("d"))
    return e.select("page_id", "tag", "n", F.when(F.col("tag").isin("html", "head", "body", "title", "nav", "ul", "li", "a"), F.col("d")).otherwise(-1).alias("depth"))


@query("""
    WITH p AS (SELECT page_id, regexp_replace(html, '(?s)<(script|style)>.*?</(script|style)>|<meta[^>]*>|<!--.*?-->|<!DOCTYPE[^>]*>', '', 'g') AS h FROM pages)
    SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(h, '<[^>]+>', ' ', 'g'), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS text, len(regexp_extract_all(h, '<a href=')) AS n_links, 0::BIGINT AS n_active FROM p
""")
def sanitized_pages(spark: SparkSession, sf: str) -> DataFrame:
    """TXT-34: all pages without scripts, styles and metadata, links opening elsewhere, and the same text as before."""
    s = pages.sanitized(t(spark, sf, "pages"), "page_id", "html")
    n = lambda pattern: F.size(F.regexp_extract_all("html", F.lit(pattern), F.lit(0))).cast("long")
    return s.select(F.col("id").alias("page_id"), strip_markup("html").alias("text"), n(r'<a href="[^"]*" target="_blank" rel="noopener noreferrer">').alias("n_links"), n(r"(?i)<(script|style|meta)|<!| on\w+=").alias("n_active"))
