"""Checks and derived documents: validation, citations, metadata, cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.functions.fields import PDF, detail_url, encode_component
from quillstack.functions.keys import bibtex_key
from quillstack.functions.text import blank, collapse_ws, truncate


def violations(df: DataFrame, id_col: str, required: list[str]) -> DataFrame:
    """(id, field) of required fields that are blank (VAL-05)."""
    missing = F.array_compact(F.array(*(F.when(F.trim(blank(F.col(c).cast("string"))) == "", F.lit(c)) for c in required)))
    return df.select(F.col(id_col).alias("id"), F.explode(missing).alias("field"))


def dangling(references: DataFrame, ref: str, listing: DataFrame, name: str) -> DataFrame:
    """References that the listing doesn't have (VAL-03, VAL-06, VAL-08)."""
    return references.join(listing.select(F.col(name).alias(ref)).distinct(), ref, "left_anti")


def bibtex_escape(c: Column | str) -> Column:
    out = F.replace(blank(c), F.lit("\\"), F.lit("\\textbackslash "))
    return F.replace(F.replace(out, F.lit("{"), F.lit("\\{")), F.lit("}"), F.lit("\\}"))


def bibtex(kind: Column, authors: Column, title: Column, year: Column, publication: Column, doi: Column, url: Column) -> Column:
    """EXP-01."""
    field = lambda k, v: F.when(F.trim(blank(v)) != "", F.concat(F.lit(f"  {k} = {{"), bibtex_escape(v), F.lit("}")))
    thesis = blank(kind).contains("thesis")
    lines = F.concat_ws(",\n", field("title", title), field("author", F.array_join(authors, " and ")), field("year", year), F.when(thesis, field("school", publication)).otherwise(field("journal", publication)), field("doi", doi), field("url", url))
    head = F.concat(F.when(thesis, F.lit("@phdthesis{")).otherwise(F.lit("@article{")), bibtex_key(F.coalesce(F.try_element_at(authors, F.lit(1)), F.lit("")), year, title))
    return F.concat(head, F.lit(",\n"), lines, F.lit("\n}"))


def paper_json_ld(title: Column, authors: Column, year: Column, abstract: Column, url: Column) -> Column:
    """EXP-02: blanks are left out."""
    n = lambda c: F.nullif(F.trim(blank(c)), F.lit(""))
    people = F.when(F.size(authors) > 0, F.transform(authors, lambda a: F.struct(F.lit("Person").alias("@type"), a.alias("name"))))
    return F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("ScholarlyArticle").alias("@type"), n(title).alias("headline"), people.alias("author"), n(year).alias("datePublished"), F.nullif(truncate(abstract, 300), F.lit("")).alias("description"), n(url).alias("url")))


def talk_json_ld(title: Column, abstract: Column, video: Column, url: Column) -> Column:
    """EXP-03."""
    n = lambda c: F.nullif(F.trim(blank(c)), F.lit(""))
    kind = F.when(F.trim(blank(video)) != "", F.lit("VideoObject")).otherwise(F.lit("CreativeWork"))
    return F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), kind.alias("@type"), n(title).alias("name"), F.nullif(truncate(abstract, 300), F.lit("")).alias("description"), n(video).alias("contentUrl"), n(url).alias("url")))


def issue_url(base: str, title: Column, body: Column, title_cap: int = 120, body_cap: int = 1200) -> Column:
    """EXP-04."""
    return F.concat(F.lit(f"{base}?title="), encode_component(F.substring(collapse_ws(title), 1, title_cap)), F.lit("&body="), encode_component(F.substring(blank(body), 1, body_cap)))


def public_url(url: Column, root: str) -> Column:
    """EXP-06."""
    return F.when(blank(url).rlike("(?i)^https?://"), url).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), F.regexp_replace(blank(url), "^[./]+", "")))


def card(df: DataFrame, id_col: str, video_id: Column, abstract: Column, meeting: Column, year: Column, topics: Column, base: str) -> DataFrame:
    """EXP-05, EXP-07: what a result shows of an item."""
    some = F.slice(topics, 1, 8)
    thumb = F.when(F.trim(blank(video_id)) != "", F.concat(F.lit("https://img.youtube.com/vi/"), video_id, F.lit("/hqdefault.jpg"))).otherwise(F.lit(""))
    return df.select(F.col(id_col).alias("id"), thumb.alias("thumbnail"), F.substring(blank(abstract), 1, 300).alias("preview"), F.coalesce(F.nullif(F.trim(blank(meeting)), F.lit("")), year.cast("string")).alias("label"), F.slice(some, 1, 4).alias("topics"), F.greatest(F.size(some) - 4, F.lit(0)).alias("more"), detail_url(F.lit(base), "talk.html", F.col(id_col).cast("string")).alias("url"))


def action_label(url: Column, is_blog: Column) -> Column:
    """EXP-09."""
    return F.when(is_blog, F.lit("Post")).when(blank(url).rlike(PDF), F.lit("PDF")).otherwise(F.lit("Paper"))


def speaker_list(people: Column) -> Column:
    """EXP-08."""
    return F.array_join(F.filter(F.transform(people, lambda p: collapse_ws(p["name"])), lambda x: x != ""), ", ")


def missing_files(listing: DataFrame, path: str, required: list[str]) -> DataFrame:
    """(path) of required files that a listing doesn't have (VAL-01)."""
    wanted = listing.sparkSession.createDataFrame([(r,) for r in required], f"{path} string")
    return wanted.join(listing.select(path).distinct(), path, "left_anti")


def stray_files(listing: DataFrame, path: str, folder: str, suffix: str = ".json") -> DataFrame:
    """(path) of files in a folder that aren't of the one kind allowed there (VAL-02)."""
    return listing.select(path).where(F.startswith(F.col(path), F.lit(folder)) & ~F.endswith(F.lower(F.col(path)), F.lit(suffix)))


def check_options(batch_size: int | None = None, repository: str | None = None, max_posts: int | None = None) -> None:
    """Raise ValueError for options of a run that mean nothing (VAL-10)."""
    if batch_size is not None and batch_size <= 0:
        raise ValueError("batch size must be positive")
    if repository is not None and not (repository.count("/") == 1 and all(repository.split("/"))):
        raise ValueError("repository must be owner/name")
    if max_posts is not None and max_posts < 0:
        raise ValueError("max posts must not be negative")


def option_errors(batch_size: Column, repository: Column, max_posts: Column) -> Column:
    """What check_options() would say of a row's options, in their order; null where they are fine or not given (VAL-10)."""
    return F.concat_ws(
        "; ",
        F.when(batch_size <= 0, "batch size must be positive"),
        F.when(~repository.rlike("^[^/]+/[^/]+$"), "repository must be owner/name"),
        F.when(max_posts < 0, "max posts must not be negative"),
    )
