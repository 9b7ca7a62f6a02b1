"""The few functions that Spark has no expression for, as vectorised Python functions."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _unescape(t: str | None, times: int = 4) -> str:
    t = t or ""
    for _ in range(times):
        new = html.unescape(t)
        if new == t:
            break
        t = new
    return t


@F.pandas_udf(T.StringType())
def html_unescape(s: pd.Series) -> pd.Series:
    """All entities, up to four times over (TXT-02)."""
    return s.map(_unescape)


@F.pandas_udf(T.StringType())
def fold_nfkd(s: pd.Series) -> pd.Series:
    """Compatibility decomposition without marks, lower case (KEY-04)."""
    return s.map(lambda t: "".join(c for c in unicodedata.normalize("NFKD", t or "") if unicodedata.category(c) != "Mn").lower())


def _alnum(t: str) -> str:
    return re.sub(r"[^a-z0-9]+", "", t.lower())


def _without_title(text: str, title: str) -> str:
    """The text without the title before it, if nothing or mere metadata is left then, or the title is followed by a break."""
    if not title.strip():
        return text
    if text.lower().startswith(title.strip().lower()):
        rest = text[len(title.strip()) :].lstrip(" :-–—\n.")
    else:
        want, seen, at = _alnum(title), "", 0
        while at < len(text) and len(seen) < len(want):
            seen += _alnum(text[at])
            at += 1
        if not want or seen != want:
            return text
        rest = text[at:].lstrip(" :-–—\n.")
    return rest if not rest or re.match(r"(?i)(\[|speakers?\b|presenters?\b|abstract\b|authors?\b)", rest) else text


def _without_speakers(text: str, speakers: list[str]) -> str:
    m = re.match(r"(?i)\s*(speakers?|presenters?)\s*:\s*", text)
    if not m:
        return text
    rest = text[m.end() :]
    for name in sorted(speakers, key=len, reverse=True):
        rest = re.sub(rf"(?i)^\W*{re.escape(name)}(\s*\([^)]*\))?", "", rest.lstrip(" ,;&")) if name else rest
    return rest.lstrip(" ,;:.-–—")


@F.pandas_udf(T.StringType())
def strip_leading_title(text: pd.Series, title: pd.Series) -> pd.Series:
    """TXT-20."""
    return pd.Series([_without_title(a or "", b or "") for a, b in zip(text, title, strict=True)])


def cleaned_abstract(raw: str | None, title: str, names: list[str]) -> str:
    """Leading titles, link tags, speakers and punctuation off, until nothing changes, six times at most (TXT-21, TXT-22)."""
    now = re.sub(r"\s+", " ", raw or "").strip()
    for _ in range(6):
        new = _without_title(now, title)
        new = re.sub(r"(?i)^\s*(\[\s*(video|slides?)\s*\]\s*)+", "", new)
        new = _without_speakers(new, names).lstrip(" ,;:.-–—")
        if new == now:
            break
        now = new
    return now


@F.pandas_udf(T.StringType())
def clean_abstract(text: pd.Series, title: pd.Series, speakers: pd.Series) -> pd.Series:
    """cleaned_abstract of each row."""
    return pd.Series([cleaned_abstract(raw, t or "", list(names) if names is not None else []) for raw, t, names in zip(text, title, speakers, strict=True)])


def parse_front_matter(raw: str | None) -> tuple[dict[str, list[str]], str]:
    """Metadata between --- (YAML) or +++ (TOML) lines at the start, as lists of strings, and the body (TXT-30, TXT-31)."""
    lines = (raw or "").replace("\r\n", "\n").split("\n")
    mark = lines[0].strip() if lines else ""
    if mark not in ("---", "+++"):
        return {}, raw or ""
    stop = next((i for i, x in enumerate(lines[1:], 1) if (re.fullmatch(r"-{3,}|\.\.\.", x.strip()) if mark == "---" else re.fullmatch(r"\+{3,}", x.strip()))), None)
    if stop is None:
        return {}, raw or ""
    meta: dict[str, list[str]] = {}
    key, sep = "", ":" if mark == "---" else "="
    clean = lambda v: v.strip().strip("\"'").strip()
    for x in lines[1:stop]:
        if key and re.match(r"\s*-\s+", x):
            meta[key].append(clean(re.sub(r"^\s*-\s+", "", x)))
        elif m := re.match(rf"^([A-Za-z_][\w-]*)\s*{sep}\s*(.*)$", x):
            key, v = m[1].lower(), m[2].strip()
            if v.startswith("[") and v.endswith("]"):
                meta[key] = [clean(y) for y in re.findall(r'"[^"]*"|\'[^\']*\'|[^,\[\]]+', v[1:-1]) if clean(y)]
            else:
                meta[key] = [clean(v)] if v else []
    return meta, "\n".join(lines[stop + 1 :])


@F.pandas_udf(T.StructType([T.StructField("meta", T.MapType(T.StringType(), T.ArrayType(T.StringType()))), T.StructField("body", T.StringType())]))
def front_matter(s: pd.Series) -> pd.DataFrame:
    found = [parse_front_matter(x) for x in s]
    return pd.DataFrame({"meta": [m for m, _ in found], "body": [b for _, b in found]})


def parse_js_objects(text: str | None, name: str) -> list[dict[str, str]]:
    """Objects of the array literal given to a JavaScript variable: strings (joined by +), numbers, names (SRC-09, SRC-10)."""
    m = re.search(rf"\b{re.escape(name)}\s*=\s*\[", text or "")
    if not m:
        return []
    token = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|[{}\[\],:+]|[^\s{}\[\],:+\"']+", re.S)
    rows, row, key, parts, depth = [], None, None, [], 1
    for t in token.finditer(text, m.end()):
        x = t.group()
        if x.startswith(("//", "/*")):
            continue
        if x == "[":
            depth += 1
        elif x == "]":
            depth -= 1
            if not depth:
                break
        elif x == "{":
            row, key, parts = {}, None, []
        elif x == ":" and row is not None and key is None:
            key, parts = "".join(parts), []
        elif x in (",", "}") and row is not None:
            if key is not None:
                row[key] = "".join(parts)
            key, parts = None, []
            if x == "}":
                rows.append(row)
                row = None
        elif x != "+":
            parts.append(re.sub(r"\\(.)", lambda e: {"n": "\n", "t": "\t"}.get(e[1], e[1]), x[1:-1]) if x[0] in "\"'" else "" if x == "null" else x)
    return rows


@F.udtf(returnType="seq int, fields map<string,string>")
class JsObjects:
    """Rows of an array of objects in JavaScript source."""

    def eval(self, text: str, name: str):
        for i, r in enumerate(parse_js_objects(text, name)):
            yield i, r
