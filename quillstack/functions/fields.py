"""URLs, dates, numbers, arrays and nested fields as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import Text, blank, collapse_ws

MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
PDF = r"(?i)\.pdf($|[?#])"


def youtube_id(c: Text) -> Column:
    """URL-01: the id of a video address, else empty."""
    u = F.trim(blank(c))
    host = F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(u, F.lit("HOST")), F.lit(""))), "^(www|m|music)\\.", "")
    path = F.coalesce(F.try_parse_url(u, F.lit("PATH")), F.lit(""))
    found = F.when(host == "youtu.be", F.regexp_extract(path, "^/([^/]+)", 1)).when(
        host.isin("youtube.com", "youtube-nocookie.com"),
        F.coalesce(F.try_parse_url(u, F.lit("QUERY"), F.lit("v")), F.nullif(F.regexp_extract(path, "^/(?:embed|shorts|live|v)/([^/]+)", 1), F.lit("")), F.try_parse_url(u, F.lit("QUERY"), F.lit("vi"))),
    )
    return F.when(found.rlike("^[A-Za-z0-9_-]{11}$"), found).otherwise(F.lit(""))


def absolute_url(base: Text, href: Text) -> Column:
    """URL-02."""
    h = F.trim(blank(href))
    root = F.regexp_extract(blank(base), r"^([a-z]+://[^/]+)", 1)
    return F.when(h.rlike("(?i)^[a-z][a-z0-9+.-]*:"), h).when(h.startswith("/"), F.concat(root, h)).otherwise(F.concat(F.regexp_replace(blank(base), "/+$", ""), F.lit("/"), h))


def pick_paper_url(candidates: Column) -> Column:
    """The first PDF among candidates, else the first (URL-03)."""
    some = F.filter(candidates, lambda x: x.isNotNull() & (F.trim(x) != ""))
    return F.coalesce(F.try_element_at(F.filter(some, lambda x: x.rlike(PDF)), F.lit(1)), F.try_element_at(some, F.lit(1)), F.lit(""))


# What a PDF's name counts by how it agrees with the wanted stem, and words of names that aren't the paper's.
STEM_EQUAL, STEM_PREFIX, STEM_WITHIN, NOT_THE_PAPER = 200, 140, 80, 40
AUXILIARY = "slides?|presentation|pres|poster|handout|book|supplement"


def pdf_score(url: Text, stem: Text) -> Column:
    """struct<score, shortness>, compared from left to right (URL-04, RNK-18)."""
    name = F.lower(F.element_at(F.split(F.regexp_replace(blank(url), "[?#].*$", ""), "/"), -1))
    s = F.lower(collapse_ws(stem))
    fit = F.when(s == "", 0).when(name == F.concat(s, F.lit(".pdf")), STEM_EQUAL).when(F.startswith(name, F.concat(s, F.lit("-"))), STEM_PREFIX).when(F.contains(name, s), STEM_WITHIN).otherwise(0)
    return F.struct((fit - F.when(name.rlike(AUXILIARY), NOT_THE_PAPER).otherwise(0)).alias("score"), (-F.length(name)).alias("shortness"))


def primary_pdf(candidates: Column, stem: Text) -> Column:
    """The best of the PDF addresses on a page, else empty (URL-04)."""
    pdfs = F.filter(F.coalesce(candidates, F.array().cast("array<string>")), lambda x: x.rlike(PDF))
    ranked = F.transform(pdfs, lambda x, i: F.struct(pdf_score(x, stem).alias("s"), (-i).alias("place"), x.alias("url")))
    return F.coalesce(F.array_max(ranked)["url"], F.lit(""))


def url_host(c: Text) -> Column:
    """URL-05: the host, lower case, without www."""
    return F.regexp_replace(F.lower(F.regexp_extract(blank(c), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), r"^www\.", "")


def video_link_label(c: Text) -> Column:
    """URL-05."""
    u = F.lower(blank(c))
    return F.when(u == "", F.lit("")).when(u.rlike(r"\.(mp4|mov|m4v|webm|avi)($|[?#])") | u.contains("download"), F.lit("Download")).when(youtube_id(c) != "", F.lit("Watch")).otherwise(F.concat(F.lit("Watch on "), url_host(c)))


def encode_component(c: Text) -> Column:
    """Percent-encoded, spaces as %20."""
    return F.replace(F.url_encode(blank(c)), F.lit("+"), F.lit("%20"))


def detail_url(base: Text, page: str, item: Text) -> Column:
    """URL-06, EXP-05."""
    return F.concat(F.regexp_replace(blank(base), "/+$", ""), F.lit(f"/{page}?id="), encode_component(item))


def internal_url(c: Text, base: str, prefix: str) -> Column:
    """URL-07: absolute addresses as they are; paths under prefix moved to base."""
    u = F.trim(blank(c))
    return F.when(u.rlike("(?i)^([a-z][a-z0-9+.-]*:|//)"), u).when(u == "", u).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(F.regexp_replace(u, f"^/?{prefix.strip('/')}/", ""), "^/+", "")))


def safe_url(c: Text) -> Column:
    """URL-08: the address if it is relative or of an allowed scheme, else empty."""
    u = F.trim(blank(c))
    return F.when(u.rlike("(?i)^(https?|mailto|tel):") | ~u.rlike("(?i)^[\\s]*[a-z][a-z0-9+.-]*:"), u).otherwise(F.lit(""))


def query_parameters(c: Text) -> Column:
    """map of a query string, the last of equal names (URL-09)."""
    parts = F.filter(F.split(F.regexp_replace(blank(c), r"^\?", ""), "&"), lambda x: x != "")
    dec = lambda x: F.coalesce(F.try_url_decode(x), x)
    pairs = F.transform(parts, lambda x: F.struct(dec(F.regexp_extract(x, "^([^=]*)", 1)).alias("k"), dec(F.regexp_extract(x, "^[^=]*=(.*)$", 1)).alias("v")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_entries(F.transform(names, lambda k: F.struct(k, F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"])))


def blog_url(base: str, url: Text, aliases: Column, stem: Text) -> Column:
    """URL-10."""
    path = F.coalesce(F.nullif(F.trim(blank(url)), F.lit("")), F.try_element_at(aliases, F.lit(1)), F.concat(F.lit("posts/"), blank(stem), F.lit("/")))
    return F.when(path.rlike("(?i)^https?://"), path).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(path, "^/+", "")))


def meeting_dates(c: Text) -> Column:
    """struct<month, year, start, end> of "Month D[-D], YYYY"; null for anything else (DAT-01)."""
    t = F.regexp_replace(collapse_ws(c), r"\s*-\s*", "-")
    form = r"(?i)^([a-z]+) (\d{1,2})(?:st|nd|rd|th)?(?:(?:-|/| ?to )(\d{1,2})(?:st|nd|rd|th)?)?\s*,? ?(\d{4})$"
    get = lambda i: F.regexp_extract(t, form, i)
    names = F.array(*(F.lit(m) for m in MONTHS))
    month = F.array_position(F.transform(names, lambda m: F.when((F.lower(get(1)) == m) | (F.lower(get(1)) == F.substring(m, 1, 3)), F.lit(True)).otherwise(F.lit(False))), F.lit(True)).cast("int")
    year, d1 = get(4).try_cast("int"), get(2).try_cast("int")
    d2 = F.coalesce(get(3).try_cast("int"), d1)
    start, end = _date(year, month, d1), _date(year, month, d2)
    return F.when(t.rlike(form) & (month > 0) & start.isNotNull() & end.isNotNull(), F.struct(month.alias("month"), year.alias("year"), start.alias("start"), end.alias("end")))


def _date(y: Column, m: Column, d: Column) -> Column:
    return F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")).try_cast("date")


def meeting_date_label(c: Text) -> Column:
    """One form for dates that are understood, others trimmed as they are (DAT-02)."""
    d = meeting_dates(c)
    one = F.concat(F.date_format(d["start"], "MMMM d"), F.when(d["start"] != d["end"], F.concat(F.lit("-"), F.date_format(d["end"], "d"))).otherwise(""), F.lit(", "), d["year"].cast("string"))
    return F.coalesce(one, F.trim(blank(c)))


def slug_sort_hint(c: Text) -> Column:
    """YYYY-MM-DD with day 00 where there is none, for sorting (DAT-03)."""
    form = r"^(\d{4})-(\d{2})(?:-(\d{2}))?"
    day = F.regexp_extract(blank(c), form, 3)
    return F.when(blank(c).rlike(form), F.concat_ws("-", F.regexp_extract(blank(c), form, 1), F.regexp_extract(blank(c), form, 2), F.when(day == "", F.lit("00")).otherwise(day))).otherwise(F.lit("0000-00-00"))


def post_date(date: Text, file_name: Text) -> Column:
    """Year, month and day of a post from its metadata, else its file's name, 01 for what is missing (DAT-04)."""
    form = r"((?:19|20)\d{2})(?:-(\d{2}))?(?:-(\d{2}))?"
    src = F.when(blank(date).rlike(form), blank(date)).otherwise(blank(file_name))
    part = lambda i: F.when(F.regexp_extract(src, form, i) == "", F.lit("01")).otherwise(F.regexp_extract(src, form, i))
    return F.when(src.rlike(form), F.concat_ws("-", part(1), part(2), part(3))).otherwise(F.lit(""))


def iso_timestamp(c: Text) -> Column:
    """DAT-05, DAT-07: UTC where no zone is given; null if malformed."""
    return F.try_to_timestamp(F.trim(blank(c)))


def older_than(c: Text, days: int, now: Column | None = None) -> Column:
    """DAT-06: never for negative days, always for malformed times."""
    if days < 0:
        return F.lit(False)
    return F.coalesce(iso_timestamp(c) < (now if now is not None else F.current_timestamp()) - F.expr(f"interval {days} days"), F.lit(True))


def month_abbreviation(slug: Text) -> Column:
    """DAT-08."""
    m = F.regexp_extract(blank(slug), r"^\d{4}-(\d{2})", 1).try_cast("int")
    return F.coalesce(F.when(m.between(1, 12), F.get(F.array(*(F.lit(x[:3].title()) for x in MONTHS)), m - 1)), F.lit(""))


def parse_int(c: Text) -> Column:
    """NUM-01."""
    return F.when(F.trim(blank(c)).rlike(r"^[+-]?\d+$"), F.trim(blank(c)).try_cast("int"))


def citation_count(*aliases: Text) -> Column:
    """The first positive count among fields, else 0 (NUM-02)."""
    return F.coalesce(*(F.when(blank(a).try_cast("int") > 0, blank(a).try_cast("int")) for a in aliases), F.lit(0))


def bounded_levenshtein(a: Text, b: Text, most: int) -> Column:
    """The distance, or most + 1 beyond the bound (NUM-03)."""
    d = F.levenshtein(blank(a), blank(b), most)
    return F.when(d < 0, F.lit(most + 1)).otherwise(d)


def is_subsequence(token: str, c: Text) -> Column:
    """NUM-04."""
    import re

    return blank(c).rlike("(?s)" + ".*".join(re.escape(x) for x in token))


def format_count(c: Text) -> Column:
    """NUM-05."""
    return F.format_number(F.coalesce(blank(c).try_cast("long"), F.lit(0)), 0)


def distinct_ignoring_case(values: Column, key=F.lower) -> Column:
    """Trimmed values, the first spelling of each (ARR-01)."""
    clean = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: collapse_ws(x)), lambda x: x != "")
    return F.filter(clean, lambda x, i: F.array_position(F.transform(clean, key), key(x)) == i + 1)


def merged_arrays(*arrays: Column) -> Column:
    """ARR-02."""
    return distinct_ignoring_case(F.concat(*(F.coalesce(a, F.array().cast("array<string>")) for a in arrays)))


def csv_values(c: Text) -> Column:
    """ARR-03."""
    return F.filter(F.transform(F.split(blank(c), ","), lambda x: F.trim(x)), lambda x: x != "")


PARTS = ("talk", "slides", "video", "paper")


def ordered_parts(parts: Column) -> Column:
    """The known parts that occur, in their order (ARR-04)."""
    low = F.transform(parts, lambda x: F.lower(F.trim(x)))
    return F.filter(F.array(*(F.lit(p) for p in PARTS)), lambda p: F.array_contains(low, p))


def author_list(c: Text) -> Column:
    """ARR-05."""
    t = F.regexp_replace(F.regexp_replace(collapse_ws(c), r"(?i)\s+and\s+", ", "), ";", ",")
    return distinct_ignoring_case(F.split(t, ","))


def work_authors(authorships: Column) -> Column:
    """array<struct<name, affiliation>>: the first institution that is given, one entry a name (ARR-06)."""
    from .keys import name_key

    people = F.transform(authorships, lambda a: F.struct(collapse_ws(a["author"]["display_name"]).alias("name"), F.coalesce(F.try_element_at(F.filter(F.transform(a["institutions"], lambda i: collapse_ws(i["display_name"])), lambda x: x != ""), F.lit(1)), F.lit("")).alias("affiliation")))
    named = F.filter(people, lambda p: p["name"] != "")
    return F.filter(named, lambda p, i: F.array_position(F.transform(named, lambda q: name_key(q["name"])), name_key(p["name"])) == i + 1)


def publication_and_venue(source: Text, volume: Text, issue: Text) -> Column:
    """struct<publication, venue> (JSN-01)."""
    from .text import clean_meta

    v, i, p = clean_meta(volume), clean_meta(issue), clean_meta(source)
    vol = F.when(v != "", F.concat(F.lit("Vol. "), v, F.when(i != "", F.concat(F.lit(" (Issue "), i, F.lit(")"))).otherwise(""))).when(i != "", F.concat(F.lit("Issue "), i))
    return F.struct(p.alias("publication"), F.concat_ws(" | ", F.nullif(p, F.lit("")), vol).alias("venue"))


def venue_parts(venue: Text) -> Column:
    return F.filter(F.transform(F.split(blank(venue), r"\|"), lambda x: collapse_ws(x)), lambda x: x != "")


VOLUME, ISSUE = r"(?i)^Vol\.\s*(.+?)(?:\s*\(Issue\s*(.+?)\))?$", r"(?i)^Issue\s*(.+)$"


def volume_and_issue(venue: Text) -> Column:
    """struct<volume, issue> of the parts of a venue that say so, the last of each (JSN-02)."""
    parts = venue_parts(venue)
    vol = F.coalesce(F.try_element_at(F.filter(parts, lambda x: x.rlike(VOLUME)), F.lit(-1)), F.lit(""))
    # the last part that names an issue, a volume without one leaves it empty
    told = F.coalesce(F.try_element_at(F.filter(parts, lambda x: x.rlike(VOLUME) | x.rlike(ISSUE)), F.lit(-1)), F.lit(""))
    issue = F.when(told.rlike(VOLUME), F.regexp_extract(told, VOLUME, 2)).otherwise(F.regexp_extract(told, ISSUE, 1))
    return F.struct(F.trim(F.regexp_extract(vol, VOLUME, 1)).alias("volume"), F.trim(issue).alias("issue"))


def rebuild_venue(publication: Text, venue: Text) -> Column:
    """JSN-02: the publication, volume and issue in one form, then the venue's other parts, once each."""
    vi = volume_and_issue(venue)
    form = publication_and_venue(publication, vi["volume"], vi["issue"])["venue"]
    others = F.filter(venue_parts(venue), lambda x: ~x.rlike(VOLUME) & ~x.rlike(ISSUE))
    return F.array_join(distinct_ignoring_case(F.concat(F.split(form, r" \| "), others)), " | ")


def derive_publication(publication: Text, venue: Text) -> Column:
    """JSN-03."""
    first = collapse_ws(F.element_at(F.split(blank(venue), r"\|"), 1))
    return F.coalesce(F.nullif(collapse_ws(publication), F.lit("")), F.when(~first.rlike(r"(?i)^(vol\.|issue\b)"), first), F.lit(""))


def classify_type(kind: Text, existing: Text) -> Column:
    """JSN-04."""
    k, e = F.lower(blank(kind)), F.lower(blank(existing))
    return F.when(k.contains("dissertation") | k.contains("thesis") | e.contains("thesis"), F.lit("thesis")).when(e != "", e).otherwise(F.lit("research-paper"))


def source_slug(raw: Text, bundle: Text) -> Column:
    """JSN-05."""
    from .keys import slugify

    return F.coalesce(F.nullif(slugify(raw), F.lit("")), F.nullif(slugify(bundle), F.lit("")), F.lit("unknown"))


def navigation_state(c: Text) -> Column:
    """struct or null where the JSON is malformed or has wrong types (JSN-06)."""
    return F.from_json(blank(c), "from string, url string, y double", {"mode": "PERMISSIVE"})
