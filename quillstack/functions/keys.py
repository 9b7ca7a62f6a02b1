"""Keys, ids and names as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import Text, blank, col, collapse_ws, strip_markup

# Categories in their order, other spellings of them, and what counts as no affiliation.
CATEGORIES = ("keynote", "technical-talk", "tutorial", "panel", "quick-talk", "lightning-talk", "student-talk", "bof", "poster", "workshop", "other")
CATEGORY_ALIASES = {
    "keynotes": "keynote", "key-note": "keynote",
    "technical-talks": "technical-talk", "technical": "technical-talk", "technical-session": "technical-talk", "technical-sessions": "technical-talk", "tech-talk": "technical-talk", "tech-talks": "technical-talk",
    "tutorials": "tutorial", "panels": "panel", "quick-talks": "quick-talk", "quick": "quick-talk", "lightning-talks": "lightning-talk", "lightning": "lightning-talk",
    "student-talks": "student-talk", "student-technical-talk": "student-talk", "student-technical-talks": "student-talk", "student-technical": "student-talk", "student-talk-session": "student-talk", "student-talk-sessions": "student-talk",
    "birds-of-feather": "bof", "birds-of-a-feather": "bof", "birds-feather": "bof", "birds-a-feather": "bof", "round-table": "bof", "round-tables": "bof",
    "posters": "poster", "workshops": "workshop",
}
NO_AFFILIATION = ("", "-", "--", "none", "null", "nan", "n/a", "na", "unknown", "no affiliation", "not available")

#: Latin letters with marks and what is left without them; functions.udfs.fold_nfkd folds all of Unicode.
ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďēęěğīłńňőřśšťūůűźżž", "aaaaaaceeeeiiiinooooouuuuyyaaaccdeeegilnnorsstuuuzzz"


def fold(c: Text) -> Column:
    """Lower case without the marks of Latin letters."""
    return F.translate(F.lower(blank(c)), ACCENTED, PLAIN)


def alnum_key(c: Text) -> Column:
    """KEY-01."""
    return F.regexp_replace(F.lower(collapse_ws(c)), "[^a-z0-9]+", "")


def soft_key(c: Text) -> Column:
    """KEY-02."""
    return collapse_ws(F.regexp_replace(F.lower(strip_markup(c)), "[^a-z0-9 ]+", " "))


def title_key(c: Text) -> Column:
    """KEY-03."""
    return F.trim(F.regexp_replace(F.lower(blank(c)), "[^a-z0-9]+", " "))


def name_key(c: Text) -> Column:
    """KEY-04: markup and marks dropped, other than letters and digits as spaces."""
    return collapse_ws(F.regexp_replace(fold(strip_markup(c)), "[^a-z0-9]+", " "))


def name_tokens(c: Text) -> Column:
    """KEY-08."""
    kept = F.regexp_replace(fold(c), "[^a-z0-9' -]+", " ")
    return F.filter(F.split(kept, r"[\s-]+"), lambda x: x != "")


def person_key(c: Text) -> Column:
    """KEY-05."""
    return F.array_join(name_tokens(c), "")


def affiliation_key(c: Text) -> Column:
    """KEY-06."""
    return F.regexp_replace(F.regexp_replace(fold(normalize_affiliation(c)), "^the ", ""), "[^a-z0-9]+", "")


def doi_key(c: Text) -> Column:
    """KEY-07."""
    bare = F.regexp_replace(F.lower(F.trim(blank(c))), r"^(https?://(dx\.)?doi\.org/|doi:\s*)", "")
    return F.regexp_replace(F.regexp_extract(bare, r"(10\.\d{4,9}/\S+)", 1), "[.,;)]+$", "")


def work_id(c: Text) -> Column:
    """KEY-09: the id of a work at an external catalogue, from its address or bare."""
    return F.regexp_extract(F.upper(F.element_at(F.split(F.trim(blank(c)), "/"), -1)), r"^(W\d+)$", 1)


def person_signature(c: Text) -> Column:
    """struct<first, last, initials, base_key, exact_key> (KEY-10)."""
    t = name_tokens(c)
    first, last = F.coalesce(F.try_element_at(t, F.lit(1)), F.lit("")), F.coalesce(F.try_element_at(t, F.lit(-1)), F.lit(""))
    middle = F.when(F.size(t) > 2, F.slice(t, 2, F.greatest(F.size(t) - 2, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    initials = F.array_join(F.transform(middle, lambda x: F.substring(x, 1, 1)), "")
    return F.struct(first.alias("first"), last.alias("last"), initials.alias("initials"), F.concat_ws("|", first, last).alias("base_key"), F.array_join(t, "").alias("exact_key"))


def name_signature(c: Text) -> Column:
    """Last name and first initial (KEY-11)."""
    s = person_signature(c)
    return F.concat_ws("|", s["last"], F.substring(s["first"], 1, 1))


def middle_variants(a: Column, b: Column) -> Column:
    """Whether two person signatures may be one person's (KEY-12)."""
    x, y = a["initials"], b["initials"]
    return (a["base_key"] == b["base_key"]) & ((a["exact_key"] == b["exact_key"]) | (x == "") | (y == "") | x.startswith(y) | y.startswith(x))


def same_person(a: Column, b: Column) -> Column:
    """FLT-04, over signatures."""
    return (a["exact_key"] == b["exact_key"]) | middle_variants(a, b)


def identity_keys(work: Text, doi: Text, title: Text, year: Text, blog_url: Text | None = None, is_blog: Column | None = None) -> Column:
    """Keys by which records are the same (KEY-13)."""
    blog = F.lit(False) if is_blog is None else is_blog
    y, t = F.trim(blank(year)), title_key(title)
    keys = [
        F.when(work_id(work) != "", F.concat(F.lit("oa:"), work_id(work))),
        F.when(doi_key(doi) != "", F.concat(F.lit("doi:"), doi_key(doi))),
        F.when(~blog & (y != "") & (t != ""), F.concat(F.lit("title:"), y, F.lit(":"), t)),
    ]
    if blog_url is not None:
        keys.append(F.when(blog & (F.trim(blank(blog_url)) != ""), F.concat(F.lit("blog:"), F.lower(F.trim(blank(blog_url))))))
    return F.array_compact(F.array(*keys))


def slugify(c: Text) -> Column:
    """KEY-14."""
    return F.regexp_replace(F.regexp_replace(F.lower(blank(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def with_unique_ids(df: DataFrame, base: str, order: str, out: str = "id") -> DataFrame:
    """Ids in order of encounter: the base, then base-2, base-3, ...; suffixes that are bases themselves are passed over (KEY-15, WIN-03).

    The n-th of a base gets suffix n and one more for each suffix below it that is taken, both running totals:
    work is linear in the rows, and a base that most rows have is spread like any other.
    """
    from quillstack.operators.numbering import running

    one = F.lit(1).cast("long")
    numbered = running(df, [base], [order], {"__n": ("sum", one)}).drop("_part", "_row")
    bases = df.select(F.col(base).alias("__b")).distinct()
    parts = lambda i: F.regexp_extract("__b", r"^(.*)-([1-9]\d*)$", i)
    taken = bases.select(parts(1).alias(base), parts(2).try_cast("long").alias("__k")).where("__k >= 2").join(bases.withColumnRenamed("__b", base), base, "left_semi")
    suffix = F.col("__n")
    if not taken.isEmpty():
        # the i-th taken suffix k moves every number from k - i + 1 on
        moves = running(taken, [base], ["__k"], {"__i": ("sum", one)}).select(base, (F.col("__k") - F.col("__i") + 1).alias("__n"), F.lit(0).alias("__late"), one.alias("__moved"), F.lit(None).cast(numbered.select(F.struct("*")).schema[0].dataType).alias("__r"))
        points = moves.unionByName(numbered.select(base, "__n", F.lit(1).alias("__late"), F.lit(0).cast("long").alias("__moved"), F.struct("*").alias("__r")))
        moved = running(points, [base], ["__n", "__late"], {"__by": ("sum", F.col("__moved"))}).where("__late = 1")
        numbered = moved.select("__r.*", "__by")
        suffix = F.col("__n") + F.col("__by")
    made = F.when(F.col("__n") == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("-"), suffix.cast("string")))
    return numbered.withColumn(out, made).drop("__n", "__by")


def next_talk_ids(new: DataFrame, existing: DataFrame, group: str, order: str, id_col: str = "id") -> DataFrame:
    """Ids <group>-NNN for new rows, numbered on from the largest that exists (KEY-16)."""
    from quillstack.operators.numbering import running

    top = existing.groupBy(group).agg(F.max(F.regexp_extract(id_col, r"-(\d+)$", 1).try_cast("int")).alias("__top"))
    placed = running(new, [group], [order], {"__n": ("sum", F.lit(1).cast("long"))}).drop("_part", "_row")
    n = F.col("__n") + F.coalesce("__top", F.lit(0))
    return placed.join(top, group, "left").withColumn(id_col, F.concat(F.col(group), F.lit("-"), F.lpad(n.cast("string"), F.greatest(F.lit(3), F.length(n.cast("string"))), "0"))).drop("__top", "__n")


AFFILIATION_WORDS = r"(?i)\b(university|institute|college|school|laborator(y|ies)|labs?|inc|corp|ltd|gmbh|research|technologies|company)\b"


def split_speaker(c: Text) -> Column:
    """struct<name, affiliation> of "Name (Place)", "Name - Place" or "Name, Place" (KEY-17)."""
    t = collapse_ws(c)
    paren, dash, comma = r"^(.+?)\s*\(([^()]+)\)$", r"^(.+?)\s+[-–—]\s+(.+)$", r"^([^,]+),\s*(.+)$"
    is_comma = t.rlike(comma) & F.regexp_extract(t, comma, 2).rlike(AFFILIATION_WORDS)
    pick = lambda i, other: F.when(t.rlike(paren), F.regexp_extract(t, paren, i)).when(t.rlike(dash), F.regexp_extract(t, dash, i)).when(is_comma, F.regexp_extract(t, comma, i)).otherwise(other)
    return F.struct(F.trim(pick(1, t)).alias("name"), F.trim(pick(2, F.lit(""))).alias("affiliation"))


def display_name(c: Text) -> Column:
    """"Last, First" turned round, stray punctuation dropped (KEY-18)."""
    t = F.regexp_replace(collapse_ws(c), r"^[\s,;.]+|[\s,;]+$", "")
    flip = r"^([^,]+),\s*([^,]+)$"
    return collapse_ws(F.when(t.rlike(flip), F.concat_ws(" ", F.regexp_extract(t, flip, 2), F.regexp_extract(t, flip, 1))).otherwise(t))


def normalize_affiliation(c: Text) -> Column:
    """Abbreviations written out, a country in brackets at the end dropped, missing ones empty (KEY-19)."""
    t = F.regexp_replace(collapse_ws(c), r"^[\s,;|]+|[\s,;|]+$", "")
    for short, full in (("Univ", "University"), ("Inst", "Institute"), ("Dept", "Department"), ("Lab", "Lab")):
        t = F.regexp_replace(t, rf"(?i)(?<![A-Za-z]){short}(?:\.|(?![A-Za-z.]))", full)
    for pattern, to in ((r"\s*&\s*", " & "), (r"\s+,", ","), (r"(?i)\(\s*(?:United States|USA|United Kingdom|UK)\s*\)$", "")):
        t = F.regexp_replace(t, pattern, to)
    return F.when(F.lower(t).isin(*NO_AFFILIATION), F.lit("")).otherwise(collapse_ws(t))


def person_record(name: Text, affiliation: Text) -> Column:
    """struct<name, affiliation>: the affiliation given, else that in the name (KEY-20)."""
    s = split_speaker(name)
    given = normalize_affiliation(affiliation)
    return F.struct(display_name(s["name"]).alias("name"), F.when(given != "", given).otherwise(normalize_affiliation(s["affiliation"])).alias("affiliation"))


def category(c: Text) -> Column:
    """One of CATEGORIES (KEY-21)."""
    key = slugify(c)
    table = F.create_map(*(F.lit(x) for k in CATEGORIES for x in (k, k)), *(F.lit(x) for kv in CATEGORY_ALIASES.items() for x in kv))
    return F.coalesce(F.try_element_at(table, key), F.lit("other"))


def category_order(c: Column) -> Column:
    return F.array_position(F.array(*(F.lit(k) for k in CATEGORIES)), c)


def student_talk(title: Text, slides: Text) -> Column:
    """KEY-22."""
    return F.lower(blank(title)).rlike(r"(?<![a-z])student (technical )?talk") | F.lower(blank(slides)).rlike(r"student[-_ ]?talk")


def category_from_heading(c: Text, labels: list[tuple[str, str]]) -> Column:
    """The category of the label that the heading is, else of the first that it holds, else null (KEY-23)."""
    key = F.regexp_replace(F.lower(collapse_ws(c)), ":+$", "")
    exact = F.coalesce(*(F.when(key == k, F.lit(v)) for k, v in labels))
    return F.coalesce(exact, *(F.when(F.contains(key, F.lit(k)), F.lit(v)) for k, v in labels))


def canonical_topic(c: Text, aliases: dict[str, str]) -> Column:
    """KEY-24: by a table from key to label; without an entry null."""
    key = F.regexp_replace(F.lower(blank(c)), "[^a-z0-9+]+", "")
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv)), key) if aliases else F.lit(None).cast("string")


def bibtex_key(author: Text, year: Text, title: Text) -> Column:
    """KEY-25."""
    return F.concat(F.coalesce(F.try_element_at(name_tokens(author), F.lit(-1)), F.lit("anon")), blank(year), F.lit("-"), F.substring(alnum_key(title), 1, 16))


def compatible_last_names(a: Text, b: Text) -> Column:
    """KEY-26."""
    x, y = col(a), col(b)
    return (x != "") & (y != "") & ((x == y) | x.endswith(y) | y.endswith(x))
