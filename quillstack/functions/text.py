"""Text functions as Columns.  Every function takes a Column (or a name) and returns one."""

from __future__ import annotations

import re
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

Text = Column | str

# What counts as missing in metadata, and tokens that mark an abstract of little worth.
MISSING_META = ("", "none", "null", "nan", "n/a")
#: Letters of any script, as Java names them.
LETTER = r"\p{L}"


def col(c: Text) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank(c: Text) -> Column:
    """The text, null as empty."""
    return F.coalesce(col(c), F.lit(""))


def collapse_ws(c: Text) -> Column:
    """White space of any kind as single spaces, trimmed (TXT-01)."""
    return F.trim(F.regexp_replace(blank(c), r"(?U)\s+", " "))


def unescape(c: Text, times: int = 4) -> Column:
    """Character references resolved, named ones (of HTML 4) and numbers, again and again up to `times`, as for text escaped more than once (TXT-02)."""
    named = F.create_map(*(F.lit(x) for name, point in name2codepoint.items() for x in (name, chr(point))))

    def piece(p: Column) -> Column:
        name = F.regexp_extract(p, r"^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)
        point = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 6), 16, 10)).when(name.startswith("#"), F.substring(name, 2, 7)).cast("int")
        valid = point.between(1, 0xD7FF) | point.between(0xE000, 0x10FFFF)
        char = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")).when(point.isNotNull(), F.lit("\ufffd")).otherwise(F.try_element_at(named, name))
        return F.coalesce(F.concat(char, F.substr(p, F.length(name) + 2)), F.concat(F.lit("&"), p))

    def once(t: Column) -> Column:
        parts = F.split(t, "&", -1)
        return F.when(F.contains(t, F.lit("&")), F.concat(parts[0], F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), piece), ""))).otherwise(t)

    return F.aggregate(F.sequence(F.lit(1), F.lit(times)), blank(c), lambda t, _: once(t))


def strip_markup(c: Text) -> Column:
    """Entities, then script and style blocks, then tags, then white space (TXT-03)."""
    out = F.regexp_replace(unescape(c), r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    return collapse_ws(F.regexp_replace(out, r"(?s)<[^>]+>", " "))


def strip_tags(c: Text) -> Column:
    """Line breaks and paragraph ends as spaces, tags dropped, and entities resolved only then (TXT-04)."""
    out = F.regexp_replace(blank(c), r"(?i)<br\s*/?>|</p>", " ")
    return collapse_ws(unescape(F.regexp_replace(out, r"(?s)<[^>]+>", ""), 1))


def strip_markdown(c: Text) -> Column:
    """Plain text of markdown: no fences and code, what images and links say, no marks of headings, lists and emphasis (TXT-05)."""
    steps = (
        ("(?s)```.*?```|`[^`]*`", " "), (r"!?\[([^\]]*)\]\([^)]+\)", "$1"), (r"(?m)^#{1,6}\s*", ""),
        (r"(?m)^\s*(?:[-*]|\d+\.)\s+", ""), ("[*_]", " "),
    )
    out = F.regexp_replace(blank(c), "\r\n?", "\n")
    for pattern, to in steps:
        out = F.regexp_replace(out, pattern, to)
    return strip_tags(out)


def summarize(c: Text, max_words: int = 110, default: str = "") -> Column:
    """The first words; cut texts lose trailing punctuation and get dots (TXT-06)."""
    words = F.split(collapse_ws(c), " ")
    cut = F.concat(F.regexp_replace(F.array_join(F.slice(words, 1, max_words), " "), r"[ ,;:.]+$", ""), F.lit("..."))
    return F.when(collapse_ws(c) == "", F.lit(default)).when(F.size(words) > max_words, cut).otherwise(collapse_ws(c))


def normalize_body(c: Text) -> Column:
    """One kind of line end, trimmed (TXT-07)."""
    return F.regexp_replace(F.regexp_replace(blank(c), "\r\n?", "\n"), r"(?U)^\s+|\s+$", "")


def truncate(c: Text, limit: int = 180, mark: str = "…") -> Column:
    """At most limit characters, the mark included (TXT-08)."""
    t = collapse_ws(c)
    return F.when(F.length(t) > limit, F.concat(F.rtrim(F.substring(t, 1, limit - len(mark))), F.lit(mark))).otherwise(t)


def english_ratio(c: Text) -> Column:
    """Share of ASCII letters among the letters of the text without markup, 0 without letters (TXT-09)."""
    t = strip_markup(c)
    letters = F.regexp_count(t, F.lit(LETTER))
    return F.when(letters > 0, F.regexp_count(t, F.lit("[A-Za-z]")) / letters).otherwise(F.lit(0.0))


def looks_non_english(c: Text, threshold: float = 0.35) -> Column:
    """Whether there are letters, but too few ASCII ones (TXT-10)."""
    return strip_markup(c).rlike(LETTER) & (english_ratio(c) < threshold)


def is_placeholder(c: Text, placeholders: tuple[str, ...]) -> Column:
    """Whether the soft key is empty or one of the placeholders (TXT-11)."""
    from .keys import soft_key

    return (soft_key(c) == "") | soft_key(c).isin(*placeholders)


def decode_inverted_index(c: Text) -> Column:
    """The text of a map from token to places; of tokens at one place the last stays (TXT-12)."""
    m = F.from_json(col(c), "map<string,array<int>>") if isinstance(c, str) else c
    pairs = F.flatten(F.transform(F.map_entries(m), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    placed = F.map_from_entries(F.transform(F.array_sort(F.array_distinct(F.transform(pairs, lambda x: x["p"]))), lambda p: F.struct(p, F.element_at(F.filter(pairs, lambda x: x["p"] == p), -1)["w"])))
    return collapse_ws(F.array_join(F.transform(F.array_sort(F.map_keys(placed)), lambda p: F.element_at(placed, p)), " "))


def query_tokens(query: str, least: int = 2) -> list[str]:
    """Tokens of a query: quoted phrases or runs without spaces, lower case, of two characters or more (TXT-13)."""
    found = [(a or b).strip().lower() for a, b in re.findall(r'"([^"]+)"|(\S+)', query or "")]
    return [t for t in (x.replace('"', "").strip() for x in found) if len(t) >= least]


def unique_tokens(*parts: Text) -> Column:
    """Distinct tokens of letters, digits, +, # and dots, of two characters or more, in order (TXT-14)."""
    joined = F.lower(F.concat_ws(" ", *(blank(p) for p in parts)))
    return F.array_distinct(F.filter(F.split(joined, "[^a-z0-9+#.]+"), lambda x: F.length(x) >= 2))


def keyword_tokens(c: Text) -> Column:
    """Tokens for mining (TXT-15)."""
    return F.regexp_extract_all(F.lower(blank(c)), F.lit("([a-z0-9][a-z0-9+#-]*)"), F.lit(1))


def mining_fragment(c: Text) -> Column:
    """Text for mining: no URLs, brackets, quotes and names of markup, spaces where letters and digits meet signs and other scripts, lower case (TXT-16)."""
    out = F.regexp_replace(blank(c), r"https?://\S+|[\r\n]+", " ")
    out = F.regexp_replace(out, r"(?<=[A-Za-z0-9])(?=[^A-Za-z0-9\s])|(?<=[^A-Za-z0-9\s])(?=[A-Za-z0-9])", " ")
    out = F.regexp_replace(out, r"[<>{}\[\]()`\"']", " ")
    return F.lower(collapse_ws(F.regexp_replace(out, r"(?i)\b(?:xmlns|mathml|xlink|mml|https?|www|org)\b", " ")))


def strip_title_annotation(c: Text) -> Column:
    """Machine-translation notes in brackets at the end dropped, all of them (TXT-17)."""
    return F.trim(F.regexp_replace(blank(c), r"(?i)(\s*[【\[][^】\]]{0,140}(powered|nict|jst|translation|翻訳)[^】\]]*[】\]])+\s*$", ""))


def low_signal_abstract(c: Text, markers: tuple[str, ...]) -> Column:
    """Two markers, or one in fewer than 24 tokens (TXT-18)."""
    hits = sum((F.contains(F.lower(blank(c)), F.lit(m)).cast("int") for m in markers), F.lit(0))
    return (hits >= 2) | ((hits >= 1) & (F.size(keyword_tokens(c)) < 24))


def clean_title(c: Text) -> Column:
    """Without the note that leads back to a schedule (TXT-19)."""
    return collapse_ws(F.regexp_replace(blank(c), r"(?is)\s*▲?\s*back to schedule.*$", ""))


def escape_html(c: Text) -> Column:
    """TXT-24."""
    out = blank(c)
    for ch, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(ch), F.lit(entity))
    return out


def highlight(c: Text, tokens: list[str]) -> Column:
    """Escaped text with each token marked, one after the other, whatever its case (TXT-23)."""
    out = escape_html(c)
    for t in tokens:
        out = F.regexp_replace(out, f"(?i)({re.escape(t)})", "<mark>$1</mark>")
    return out


def clean_meta(c: Text) -> Column:
    """Collapsed, and empty where it says that nothing is there (TXT-25)."""
    t = collapse_ws(c)
    return F.when(F.lower(t).isin(*MISSING_META), F.lit("")).otherwise(t)


def title_case_slug(c: Text) -> Column:
    """TXT-26."""
    return F.initcap(F.replace(blank(c), F.lit("-"), F.lit(" ")))


def paper_type_label(c: Text) -> Column:
    """TXT-27."""
    key = F.lower(F.trim(blank(c)))
    return F.when(key == "", F.lit("Paper")).when(key == "blog-post", F.lit("Blog Post")).when(key.contains("thesis"), F.lit("Thesis")).otherwise(title_case_slug(key))


def paragraphs(c: Text) -> Column:
    """array<struct<kind, lines>>: paragraphs, bullet lists and numbered lists of an abstract (TXT-28)."""
    blocks = F.filter(F.split(normalize_body(c), "\n{2,}"), lambda b: F.trim(b) != "")

    def block(b: Column) -> Column:
        lines = F.filter(F.transform(F.split(b, "\n"), lambda x: F.trim(x)), lambda x: x != "")
        kind = F.when(F.forall(lines, lambda x: x.rlike("^[-*•]\\s")), "bullets").when(F.forall(lines, lambda x: x.rlike("^\\d+[.)]\\s")), "numbers").otherwise("text")
        return F.struct(kind.alias("kind"), F.transform(lines, lambda x: F.when(kind == "text", x).otherwise(F.regexp_replace(x, "^([-*•]|\\d+[.)])\\s+", ""))).alias("lines"))

    return F.transform(blocks, block)


def decode_json_literal(c: Text) -> Column:
    """The string that a JSON literal's inside means; itself where it is malformed (TXT-29)."""
    return F.coalesce(F.element_at(F.from_json(F.concat(F.lit('["'), blank(c), F.lit('"]')), "array<string>"), 1), blank(c))


def rewrite_shortcodes(c: Text) -> Column:
    """Simple site-generator shortcodes as markup; unknown ones dropped (TXT-33)."""
    out = F.regexp_replace(blank(c), r'(?s)\{\{[<%]\s*highlight[^%>]*[%>]\}\}(.*?)\{\{[<%]\s*/highlight\s*[%>]\}\}', "```\n$1\n```")
    out = F.regexp_replace(out, r'\{\{<\s*figure[^>]*?src="([^"]+)"[^>]*>\}\}', "![]($1)")
    out = F.regexp_replace(out, r"\{\{<\s*youtube\s+\"?([A-Za-z0-9_-]{11})\"?\s*>\}\}", "https://www.youtube.com/watch?v=$1")
    return F.regexp_replace(out, r"\{\{[<%].*?[%>]\}\}", "")


def sanitize_html(c: Text) -> Column:
    """Active elements, event attributes and unsafe addresses dropped (TXT-34, without a parser)."""
    out = F.regexp_replace(blank(c), r"(?is)<(script|style|iframe|object|embed|form)\b[^>]*>.*?</\1\s*>", "")
    out = F.regexp_replace(out, r"(?is)</?(script|style|iframe|object|embed|form|meta|link|base)\b[^>]*>", "")
    out = F.regexp_replace(out, r"(?is)\s(on\w+|srcdoc|srcset)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", "")
    return F.regexp_replace(out, r"(?is)\s(href|src)\s*=\s*([\"'])\s*(javascript|vbscript|data):[^\"']*\2", "")


def reference_definitions(c: Text) -> Column:
    """array<struct<label, url>>: reference definitions of markdown outside fences (TXT-35)."""
    body = F.regexp_replace(normalize_body(c), r"(?s)```.*?```", "")
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"^\s{0,3}\[[^\]]+\]:\s*\S+"))
    return F.transform(lines, lambda x: F.struct(F.lower(F.regexp_extract(x, r"^\s{0,3}\[([^\]]+)\]:", 1)).alias("label"), F.regexp_extract(x, r"\]:\s*<?([^\s>]+)", 1).alias("url")))


def shortcode_args(c: Text) -> Column:
    """struct<named: map, positional: array> of a shortcode's arguments (TXT-36)."""
    found = F.regexp_extract_all(blank(c), F.lit(r'(\w+="[^"]*"|\w+=\S+|"[^"]*"|\S+)'), F.lit(1))
    named = F.filter(found, lambda x: x.rlike('^\\w+='))
    pairs = F.transform(named, lambda x: F.struct(F.substring_index(x, "=", 1), F.regexp_replace(F.regexp_replace(x, "^\\w+=", ""), '^"|"$', "")))
    return F.struct(F.map_from_entries(pairs).alias("named"), F.transform(F.filter(found, lambda x: ~x.rlike("^\\w+=")), lambda x: F.regexp_replace(x, '^"|"$', "")).alias("positional"))
