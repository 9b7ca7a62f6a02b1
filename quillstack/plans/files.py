"""Registered queries of sources and sinks: files are written to the shared scratch folder and read back.

What is written are small fixtures made of the tables of a fixed size (regions and nations); the SQL says
what a reader must give back.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.functions import keys as ky
from quillstack.operators import numbering
from quillstack.sources import bundles, readers
from quillstack.sources.versions import VersionedTable, save_with_figures

from .registry import query, scratch, t
from .texts import say


def put(spark: SparkSession, path: str, text: str) -> None:
    """A small text file, through Spark's file systems."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


@query("""
    SELECT 's' || n_regionkey AS meeting, 't-' || n_nationkey AS id, n_name AS title, 's' || n_regionkey || '.json' AS file, (n_regionkey * 1000000 + row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::BIGINT AS seq FROM nation
""")
def event_bundles(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-01, SRC-02, SRC-03, SRC-07, VAL-04: a bundle a region behind the second of three manifests, strictly read."""
    root = scratch(spark)
    n = t(spark, sf, "nation").orderBy("n_nationkey").collect()  # 25 rows
    regions = sorted({r.n_regionkey for r in n})
    put(spark, f"{root}/empty.json", "[]")
    put(spark, f"{root}/index.json", json.dumps({"dataVersion": "v1", "eventFiles": [{"file": f"s{k}.json"} if k % 2 else f"s{k}.json" for k in regions]}))
    for k in regions:
        put(spark, f"{root}/s{k}.json", json.dumps({"meeting": {"slug": f"s{k}"}, "talks": [{"id": f"t-{r.n_nationkey}", "meeting": f"s{k}", "title": r.n_name} for r in n if r.n_regionkey == k]}))
    _, files, _ = bundles.load_manifest(spark, [f"{root}/none.json", f"{root}/empty.json", f"{root}/index.json"], ("files", "eventFiles"))
    return bundles.talks(bundles.read_bundles(spark, root, files, bundles.EVENT_BUNDLE, "talks")).select("meeting", "id", "title", F.col("_file").alias("file"), F.col("_seq").alias("seq"))


@query("""
    SELECT 'p-' || n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'own' ELSE 'r' || n_regionkey END AS source, 'Region ' || n_regionkey AS name FROM nation WHERE n_regionkey <> 1
""")
def paper_bundles(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-04, SRC-05, SRC-06, SRC-08, VAL-07, VAL-09: read permissively, one bundle missing, one malformed; sources fill in for papers without one."""
    root = scratch(spark)
    n = t(spark, sf, "nation").orderBy("n_nationkey").collect()  # 25 rows
    regions = sorted({r.n_regionkey for r in n})
    _, files = bundles.normalize_manifest({"dataVersion": "v", "paperFiles": [f"r{k}.json" for k in regions] + ["gone.json"]}, ("paperFiles",))
    for k in regions:
        papers = [{"id": f"p-{r.n_nationkey}", "source": "own" if r.n_nationkey % 2 == 0 else " "} for r in n if r.n_regionkey == k]
        put(spark, f"{root}/r{k}.json", "{broken" if k == 1 else json.dumps({"source": {"slug": f"r{k}", "name": f"Region {k}"}, "papers": papers}))
    read = bundles.read_bundles(spark, root, files, bundles.PAPER_BUNDLE, "papers", strict=False)
    return bundles.papers(read).select("id", "source", F.col("sourceName").alias("name"))


@query("""
    SELECT lower(r_name) AS canonical, v.a || r_regionkey AS alias FROM region, (VALUES ('a '), ('b')) v(a) UNION ALL SELECT lower(r_name), lower(r_name) FROM region UNION ALL SELECT 'alone', 'alone'
""")
def seed_files(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-23: comments, names alone, names with aliases, repeats."""
    root = scratch(spark)
    rows = t(spark, sf, "region").orderBy("r_regionkey").collect()  # 5 rows
    put(spark, f"{root}/seeds.txt", "# comment\n\nalone\n" + "".join(f"{r.r_name.lower()}: a {r.r_regionkey},b{r.r_regionkey},,b{r.r_regionkey}\n" for r in rows))
    return bundles.seeds(spark, f"{root}/seeds.txt")


@query("SELECT 'W' || n_nationkey AS id, n_name AS title FROM nation WHERE n_nationkey % 2 = 0")
def cached_works(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-13, SRC-14, SRC-15, SRC-16: of cached responses in batches the wanted works, the first file's of each."""
    root = scratch(spark)
    n = t(spark, sf, "nation").orderBy("n_nationkey").collect()  # 25 rows
    for i in range(0, len(n), 10):
        put(spark, f"{root}/a{i}.json", json.dumps({"results": [{"id": f"https://api.example.org/w{r.n_nationkey}", "title": r.n_name} for r in n[i : i + 10]]}))
    put(spark, f"{root}/z.json", json.dumps({"results": [{"id": "W0", "title": "later"}, {"id": "bad", "title": "no id"}]}))
    wanted = t(spark, sf, "nation").where("n_nationkey % 2 = 0").select(say("W{n_nationkey}").alias("id"))
    return bundles.cached_works(spark, f"{root}/*.json", wanted, "id: string, title: string").select("id", "title")


@query("""
    SELECT 1::BIGINT AS version, 'v1' AS label, count(*) AS rows, 'b.json,a.json' AS files FROM part
    UNION ALL SELECT 2, 'v3', count(*), 'c.json,b.json,a.json' FROM part WHERE p_size > 1
""")
def idempotent_writes(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-01, SNK-02, SNK-06, INC-11, SET-04: the manifests of a table that was published, again without a change, and with one."""
    table, p = VersionedTable(spark, f"{scratch(spark)}/parts"), t(spark, sf, "part")
    table.publish(p, ["p_partkey"], "v1", files=["a.json", "b.json"])
    table.publish(p.repartition(3, "p_brand"), label="v2", files=["a.json"])
    table.publish(p.where("p_size > 1"), label="v3", files=["c.json"])
    return table.history().select("version", "label", "rows", F.array_join("files", ",").alias("files"))


@query("""
    SELECT count(*) AS rows, count(*) FILTER (p_size % 2 = 0) AS papers_with_work_id, count(*) FILTER (p_size % 12 = 0) AS papers_changed, count(*) FILTER (p_name LIKE '% widget') AS with_keywords, sum(p_partkey)::BIGINT AS written FROM part
""")
def observed_figures(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-11, AGG-12, VAL-05: figures of a run, taken in the write itself and kept beside the table, and a sum over what was written."""
    root, s = f"{scratch(spark)}/enriched", F.col("p_size")
    p = t(spark, sf, "part").withColumns({"work": F.when(s % 2 == 0, "W1").otherwise(" "), "before": F.lit("x"), "after": F.when(s % 12 == 0, "y").otherwise("x"), "keywords": F.when(F.col("p_name").endswith(" widget"), F.array("p_type")).otherwise(F.array().cast("array<string>"))})
    figures = {"papers_with_work_id": F.count_if(F.trim("work") != ""), "papers_changed": F.count_if(F.col("before") != F.col("after")), "with_keywords": F.count_if(F.size("keywords") > 0)}
    save_with_figures(p.select("p_partkey", "work", "before", "after", "keywords"), root, figures)
    told = spark.read.json(f"{root}/figures.json")
    return told.crossJoin(spark.read.parquet(f"{root}/rows").agg(F.sum("p_partkey").alias("written")))  # one row each


@query("""
    SELECT o_orderkey, CASE WHEN o_orderkey % 500 = 1 THEN o_totalprice + 1 ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 500 = 1 THEN 'modified' WHEN o_orderkey % 500 = 2 THEN 'removed' ELSE 'added' END AS change
    FROM orders WHERE o_orderkey % 500 IN (1, 2, 3)
""")
def published_changes(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-20, SRC-21, SNK-07: what differs between two published versions of all orders, by buckets whose checksums differ."""
    table, o = VersionedTable(spark, f"{scratch(spark)}/orders"), t(spark, sf, "orders")
    table.publish(o.where("o_orderkey % 500 <> 3"), ["o_orderkey"], "v1", buckets=256)
    table.publish(o.where("o_orderkey % 500 <> 2").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 500 == 1, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))), label="v2")
    return table.changed_rows(1, 2).select("o_orderkey", F.col("o_totalprice").alias("price"), F.col("_change").alias("change"))


@query("""
    WITH w AS (SELECT p_partkey, unnest([p_type, lower(p_type), p_brand || '!', '--', p_name]) AS tag, unnest([0, 1, 2, 3, 4]) AS i FROM part),
    k AS (SELECT *, regexp_replace(lower(tag), '[^a-z0-9]+', '', 'g') AS key FROM w),
    f AS (SELECT key, tag, p_partkey, i FROM k WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY key ORDER BY p_partkey, i) = 1)
    SELECT key, tag, row_number() OVER (ORDER BY p_partkey, i)::BIGINT AS place FROM f
""")
def tag_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-24: without a configuration all parts' own tags, the first spelling of each, in order."""
    rows = t(spark, sf, "part").select("p_partkey", F.array("p_type", F.lower("p_type"), F.concat("p_brand", F.lit("!")), F.lit("--"), "p_name").alias("tags"))
    return bundles.tag_vocabulary(rows, "tags", "p_partkey")


@query("SELECT 'repo/content/posts/' || lower(r_name) || '.md' AS path, 'Post ' || r_regionkey AS text, (row_number() OVER (ORDER BY lower(r_name)) - 1)::INTEGER AS seq FROM region")
def archived_posts(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-11: markdown under content/posts of an archive, in order."""
    import io
    import tarfile

    root, buffer = scratch(spark), io.BytesIO()
    rows = t(spark, sf, "region").orderBy(F.desc("r_regionkey")).collect()  # 5 rows
    with tarfile.open(fileobj=buffer, mode="w:gz") as tar:
        for name, body in [(f"repo/content/posts/{r.r_name.lower()}.md", f"Post {r.r_regionkey}") for r in rows] + [("repo/README.md", "no"), ("repo/content/posts/x.png", "no")]:
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body.encode()))
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{root}/posts.tar.gz")
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(buffer.getvalue()))
    out.close()
    return readers.posts_of(spark, f"{root}/posts.tar.gz").select("path", "text", F.col("_seq").alias("seq"))


def write_files(df: DataFrame, root: str) -> int:
    """Write rows (file, text) as files under root, by the tasks that hold them; their number."""
    import pyarrow as pa

    def run(batches):
        fs, base = readers.opened(root)
        fs.create_dir(base, recursive=True)
        n = 0
        for b in batches:
            for file, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with fs.open_output_stream(f"{base}/{file}") as f:
                    f.write((text or "").encode())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return df.select("file", "text").mapInArrow(run, "n long").agg(F.sum("n")).first()[0]


def write_archives(df: DataFrame, root: str) -> DataFrame:
    """Write rows (path, text) into archives under root, one a task, every second one compressed; the archives that are whole."""
    import pyarrow as pa

    def run(batches):
        import io
        import tarfile
        import uuid

        from pyspark import TaskContext

        fs, base = readers.opened(root)
        fs.create_dir(base, recursive=True)
        packed = TaskContext.get().partitionId() % 2 == 1
        name = f"{uuid.uuid4().hex}.tar{'.gz' if packed else ''}"
        with fs.open_output_stream(f"{base}/{name}.part", compression=None) as f, tarfile.open(fileobj=f, mode="w|gz" if packed else "w|") as tar:
            for b in batches:
                for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    content = (text or "").encode()
                    info = tarfile.TarInfo(path)
                    info.size = len(content)
                    tar.addfile(info, io.BytesIO(content))
        fs.move(f"{base}/{name}.part", f"{base}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([name])], names=["archive"])

    return df.select("path", "text").mapInArrow(run, "archive string")


@query("SELECT 'site/content/posts/p' || page_id || '.html' AS path, coalesce(html, '') AS text FROM pages")
def archived_pages(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-11: all pages, from archives that tasks have written, beside members that are no posts."""
    root = f"{scratch(spark)}/archives"
    pages = t(spark, sf, "pages").select(F.explode(F.array(F.struct(say("site/content/posts/p{page_id}.html").alias("path"), F.col("html").alias("text")), F.struct(say("site/static/{page_id}.png").alias("path"), F.lit("no").alias("text")))).alias("m")).select("m.*")
    whole = write_archives(pages.repartition(4), root)
    names = whole.distinct().collect()  # an archive a task
    return readers.posts_of(spark, root, files=[r["archive"] for r in names]).select("path", "text")


@query("SELECT 'W' || c_custkey AS id, c_name AS title, n_name AS venue FROM customer JOIN nation ON c_nationkey = n_nationkey")
def cached_searches(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-13, SRC-14: all pages of a search for each nation, of which each is a file; the search ends where the count says."""
    root, per_page = f"{scratch(spark)}/pages", 20
    c = t(spark, sf, "customer").join(t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "c_custkey", "c_name")
    placed = numbering.running(c, ["n_name"], ["c_custkey"], {"n": ("sum", F.lit(1).cast("long"))})
    of_nation = placed.groupBy(F.col("n_name").alias("venue")).agg(F.max("n").alias("count"))
    work = F.struct(say("W{c_custkey}").alias("id"), F.col("c_name").alias("title"), F.col("n_name").alias("venue"))
    pages = placed.groupBy(F.col("n_name").alias("venue"), (F.floor((F.col("n") - 1) / per_page) + 1).alias("page")).agg(F.collect_list(work).alias("results")).join(of_nation, "venue")
    body = F.to_json(F.struct("results", F.struct("count").alias("meta")))
    write_files(pages.select(F.format_string("%s-y2000-n20-p%d.json", ky.slugify("venue"), "page").alias("file"), body.alias("text")), root)
    keywords = [r["n_name"] for r in t(spark, sf, "nation").select("n_name").collect()]  # what is searched for is a parameter
    return readers.discovered_works(spark, root, keywords, "id string, title string, venue string", 2000, per_page)


@query("""
    WITH e AS (SELECT event_id, event_type || ':' || event_id AS fingerprint, CASE WHEN event_id % 50 <> 0 THEN ts END AS told, user_id::VARCHAR AS hint, event_type AS title FROM events)
    SELECT event_id, title, strftime(told, '%Y-%m-%d %H:%M:%S') AS at_utc, row_number() OVER (ORDER BY told DESC NULLS LAST, hint DESC, title DESC, fingerprint)::BIGINT AS place FROM e
""")
def logs_read(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-22, SRT-02, DAT-07: all events as logs, a file a day, read back and put in order; what has no readable time comes last."""
    root, e = f"{scratch(spark)}/logs", t(spark, sf, "events")
    at = F.when(F.col("event_id") % 50 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    entry = F.struct(F.lit("talk").alias("kind"), at.alias("loggedAt"), F.col("user_id").cast("string").alias("sortHint"), F.concat_ws(":", "event_type", "event_id").alias("fingerprint"), F.col("event_type").alias("title"))
    days = e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.collect_list(entry).alias("entries"))
    write_files(days.select(say("{day}.json").alias("file"), F.to_json(F.struct(F.lit("v1").alias("dataVersion"), F.col("day").alias("generatedAt"), "entries")).alias("text")), root)
    log = numbering.numbered(bundles.update_log(spark, f"{root}/*.json"), bundles.newest_first())
    return log.select(F.element_at(F.split("fingerprint", ":"), -1).cast("long").alias("event_id"), "title", F.date_format("logged_at", "yyyy-MM-dd HH:mm:ss").alias("at_utc"), "place")
