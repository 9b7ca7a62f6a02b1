"""HTML as elements: a tokenizer with a stack of open elements, and what is read off the tree."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.entities import html5
from html.parser import HTMLParser
from urllib.parse import urljoin

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An element that opens ends those of the second kind that are open above the third.
IMPLIED = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Elements that end an open paragraph, and those beyond which they don't look for one.
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
P_SCOPE = frozenset("button td th table caption body html".split())
# Elements that go with all they hold, and attributes that go whatever their value.
BLOCKED, ACTIVE = ("script", "style", "iframe", "object", "embed", "form", "meta", "link", "base"), ("srcdoc", "srcset", "style")
#: What html.unescape() takes for a reference.
REFERENCE = re.compile(r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")


@dataclass
class Element:
    """start, inner, inner_end, end: places in the text of the element and of what it holds."""

    tag: str
    attrs: dict[str, str]
    parent: int
    depth: int
    start: int
    inner: int
    inner_end: int = -1
    end: int = -1
    kids: list = field(default_factory=list)  # places of elements, and texts


class Tree(HTMLParser):
    """All elements of a page in the order in which they open; whatever is left open ends with its parent."""

    def __init__(self, text: str):
        super().__init__(convert_charrefs=True)
        self.text, self.elements, self.open = text, [], []
        self.roots: list = []
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]
        self.feed(text)
        self.close()
        self.end_down_to(0, len(text), len(text))

    def at(self) -> int:
        line, column = self.getpos()
        return self.lines[min(line, len(self.lines)) - 1] + column

    def hold(self, kid) -> None:
        (self.elements[self.open[-1]].kids if self.open else self.roots).append(kid)

    def end_down_to(self, n: int, inner_end: int, end: int) -> None:
        """End the open elements above the n-th."""
        while len(self.open) > n:
            e = self.elements[self.open.pop()]
            e.inner_end, e.end = inner_end, end if len(self.open) == n else inner_end

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        at = self.at()
        ends, within = IMPLIED.get(tag, ((), ()))
        for kinds, stop in ((ends, within), ({"p"} if tag in ENDS_P else (), P_SCOPE)):
            for n in range(len(self.open) - 1, -1, -1):
                name = self.elements[self.open[n]].tag
                if name in stop:
                    break
                if name in kinds:
                    self.end_down_to(n, at, at)
        inner = at + len(self.get_starttag_text() or "")
        known: dict[str, str] = {}
        for k, v in attrs:
            known.setdefault(k.lower(), v or "")
        e = Element(tag, known, self.open[-1] if self.open else -1, len(self.open), at, inner)
        self.hold(len(self.elements))
        self.elements.append(e)
        if tag in VOID:
            e.inner_end = e.end = inner
        else:
            self.open.append(len(self.elements) - 1)

    def handle_endtag(self, tag: str) -> None:
        at = self.at()
        for n in range(len(self.open) - 1, -1, -1):
            if self.elements[self.open[n]].tag == tag:
                close = self.text.find(">", at)
                self.end_down_to(n, at, len(self.text) if close < 0 else close + 1)
                return

    def handle_data(self, data: str) -> None:
        self.hold(data)

    def inner_html(self, i: int) -> str:
        return self.text[self.elements[i].inner : self.elements[i].inner_end]

    def within(self, i: int, tag: str | None = None) -> Iterator[int]:
        """Elements inside the i-th, in order."""
        for j in range(i + 1, len(self.elements)):
            if self.elements[j].start >= self.elements[i].end or self.elements[j].depth <= self.elements[i].depth:
                return
            if tag is None or self.elements[j].tag == tag:
                yield j

    def lines_of(self, i: int) -> Iterator[str]:
        """Texts of an element between its line breaks, each that a break ends."""
        breaks = [self.elements[i].inner] + [self.elements[j].end for j in self.within(i, "br")]
        starts = [self.elements[j].start for j in self.within(i, "br")]
        for a, b in zip(breaks, starts, strict=False):
            yield plain(self.text[a:b])


def plain(fragment: str) -> str:
    """The text of a fragment: references, then script and style, then tags, then white space (TXT-03)."""
    t = fragment
    for _ in range(4):
        if (new := html.unescape(t)) == t:
            break
        t = new
    t = re.sub(r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ", t)
    return re.sub(r"\s+", " ", re.sub(r"(?s)<[^>]+>", " ", t)).strip()


def has_class(e: Element, name: str) -> bool:
    return name in e.attrs.get("class", "").split()


def safe_address(value: str, base: str, data: bool) -> str:
    """The address, absolute where a base is given; empty where it would run something (URL-08)."""
    bare = re.sub(r"[\x00-\x20]+", "", value).lower()
    if re.match(r"(javascript|vbscript):", bare) or (bare.startswith("data:") and not (data and bare.startswith("data:image/"))):
        return ""
    return urljoin(base, value.strip()) if base and value.strip() else value.strip()


def escaped(written: str) -> str:
    """A text as written, its references resolved and escaped anew; those that no semicolon ends stay: a browser resolves some, strip_markup() none."""

    def one(m: re.Match) -> str:
        said = html.unescape(m[0])
        ended = m[1].endswith(";") and (m[1].startswith("#") or m[1] in html5)
        return html.escape(said, quote=False) if ended or said == m[0] else "&" + html.escape(m[1], quote=False)

    parts, at = [], 0
    for m in REFERENCE.finditer(written):
        parts += html.escape(written[at : m.start()], quote=False), one(m)
        at = m.end()
    return "".join(parts) + html.escape(written[at:], quote=False)


class Escaped(Tree):
    """A tree whose texts are escaped()."""

    def handle_data(self, data: str) -> None:
        at = self.at()
        # the parser takes a text up to the next tag; after a sign that opens none it may be less
        end = self.text.find("<", at)
        written = self.text[at : len(self.text) if end < 0 else end]
        self.hold(escaped(written) if "&" in written and html.unescape(written) == data else html.escape(data, quote=False))


def sanitized(text: str | None, base: str = "", allowed: frozenset[str] | None = None, attributes: frozenset[str] | None = None) -> str:
    """The page without what acts: blocked elements with all they hold, handlers, styles, unsafe addresses (TXT-34).

    allowed, attributes: the only elements and attributes to keep, if given; of other elements what they hold stays.
    Comments and declarations go.  What comes out is balanced and its texts are escaped; see escaped() for references
    without a semicolon.
    """
    tree, out = Escaped(text or ""), []
    # a stack of its own: pages may be nested deeper than Python's
    todo: list = [(k, None) for k in reversed(tree.roots)]
    while todo:
        kid, closing = todo.pop()
        if closing is not None:
            out.append(closing)
            continue
        if isinstance(kid, str):
            out.append(kid)
            continue
        e = tree.elements[kid]
        if e.tag in BLOCKED:
            continue
        keep = allowed is None or e.tag in allowed
        if keep:
            attrs = []
            for k, v in e.attrs.items():
                if k.startswith("on") or k in ACTIVE or (attributes is not None and k not in attributes) or not re.fullmatch(r"[a-z][a-z0-9:_.-]*", k):
                    continue
                if k in ("href", "src", "action", "formaction", "xlink:href", "poster", "background"):
                    v = safe_address(v, base, data=k == "src")
                    if not v:
                        continue
                attrs.append((k, v))
            if e.tag == "a" and any(k == "href" for k, _ in attrs):
                attrs = [(k, v) for k, v in attrs if k not in ("target", "rel")] + [("target", "_blank"), ("rel", "noopener noreferrer")]
            out.append("<" + e.tag + "".join(f' {k}="{html.escape(v)}"' for k, v in attrs) + ">")
            if e.tag not in VOID:
                todo.append((None, f"</{e.tag}>"))
        todo += [(k, None) for k in reversed(e.kids)]
    return "".join(out)


def sessions(text: str | None, opened: Callable[[str], str | None], default: str) -> Iterator[tuple[int, str, str, str, list[str], str]]:
    """(pos, category, title, speakers, paragraphs, html) of a programme's entries: divs of class session-entry (HTM-07, WIN-02).

    Headings are paragraphs of nothing but bold text and divs of class www_sectiontitle, outside entries; the last that
    opens a category counts.  pos counts headings and entries.
    """
    tree = Tree(text or "")
    category, beyond, pos = default, -1, -1
    for i, e in enumerate(tree.elements):
        if e.start < beyond:
            continue
        if e.tag == "div" and has_class(e, "session-entry"):
            pos, beyond = pos + 1, e.end
            italic = next((tree.inner_html(j) for j in tree.within(i, "i")), "")
            said = next((m[1] for line in tree.lines_of(i) if (m := re.search(r"(?i)(?:speaker|presenter)s?\s*:\s*(.*)", line))), "")
            yield pos, category, italic, said, [tree.inner_html(j) for j in tree.within(i, "p")], tree.inner_html(i)
        elif (e.tag == "div" and has_class(e, "www_sectiontitle")) or (e.tag == "p" and not e.attrs and _only_bold(tree, e)):
            pos += 1
            category = opened(plain(tree.inner_html(i))) or category


def _only_bold(tree: Tree, e: Element) -> bool:
    some = [k for k in e.kids if not (isinstance(k, str) and not k.strip())]
    return len(some) == 1 and not isinstance(some[0], str) and tree.elements[some[0]].tag == "b" and all(isinstance(k, str) for k in tree.elements[some[0]].kids) and bool(plain(tree.inner_html(some[0])))


def sections(text: str | None) -> Iterator[tuple[int, str, str, str]]:
    """(pos, title, speakers, paragraph) of h3 with an id, directly followed by h4 and p (HTM-08)."""
    tree = Tree(text or "")
    after: dict[tuple[int, int], int] = {(e.parent, e.start): i for i, e in enumerate(tree.elements)}

    def next_to(i: int, tag: str) -> int | None:
        e = tree.elements[i]
        gap = re.compile(r"\s*").match(tree.text, e.end).end()
        j = after.get((e.parent, gap))
        return j if j is not None and tree.elements[j].tag == tag else None

    pos = 0
    for i, e in enumerate(tree.elements):
        if e.tag == "h3" and e.attrs.get("id") and (j := next_to(i, "h4")) is not None and (k := next_to(j, "p")) is not None:
            yield pos, tree.inner_html(i), tree.inner_html(j), tree.inner_html(k)
            pos += 1


def listed_meetings(text: str | None) -> Iterator[tuple[int, str, str, str]]:
    """(pos, slug, date, location) of list entries that link to a meeting's folder (HTM-12)."""
    tree = Tree(text or "")
    for pos, i in enumerate(i for i, e in enumerate(tree.elements) if e.tag == "li"):
        a = next((j for j in tree.within(i, "a") if re.fullmatch(r"\d{4}-\d\d(-\d\d)?/?", tree.elements[j].attrs.get("href", "").strip())), None)
        if a is not None:
            rest = plain(tree.text[tree.elements[a].end : tree.elements[i].inner_end])
            place = rest.split("-", 1)[1] if "-" in rest else rest
            yield pos, tree.elements[a].attrs["href"].strip().rstrip("/"), plain(tree.inner_html(a)), re.sub(r"(?i)\s*-\s*canceled\s*$", "", " ".join(place.split())).strip()


def first_link(fragment: str, word: str) -> str:
    """The target of the first anchor whose text has a word (HTM-11)."""
    tree = Tree(fragment)
    return next((e.attrs["href"] for i, e in enumerate(tree.elements) if e.tag == "a" and e.attrs.get("href") and word in plain(tree.inner_html(i)).lower()), "")
