"""A linear walk over HTML: text, sections between markers, cleaned text.

The tree is the plain one of the standard parser: void tags close themselves, an end tag
closes up to its nearest open match and is ignored without one, unclosed tags nest, script,
style and comments are no text.  A walk writes the normal form of the markup once and numbers
tags, strings and pieces of markup in document order.  A tag is a range of each of the three,
running sums give the length of its text and of its markup without building them, and open
tags are counted by name; so deep, unclosed or endless nesting costs time in proportion.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html import escape
from html.parser import HTMLParser

VOID = frozenset("area base basefont bgsound br col command embed frame hr image img input isindex keygen link menuitem meta nextid param source spacer track wbr".split())
NO_TEXT = frozenset(("script", "style"))
#: Tags that may hold a section marker, and those that must be short to.
MARKER_TAGS = frozenset("summary h1 h2 h3 h4 h5 h6 p strong b div span".split())
SHORT_TAGS, SHORT = frozenset(("div", "span", "p")), 220
CLIMBED = frozenset(("details", "section", "article", "div", "p"))
#: Markers: patterns that follow one another in a line.
SECTION_START = (r"\b4\.?\s*8\b", r"\b(?:undesirable\s+effects|adverse\s+reactions)\b")
SECTION_END = (r"\b4\.?\s*9\b",)
NAME_START = (r"\b1\b", r"\bname of the medicinal product\b")
SECTION_COLUMNS = ("found", "method", "end_found", "content_html", "has_table", "has_list")
NAME_END = (r"\b2\b", r"\bqualitative", r"quantitative\b")


class Marker:
    """Patterns to be found one behind the other in a line; letters of either case.

    Each is searched once from the end of the one before, so a line costs time in proportion
    however often the first ones occur.  No pattern may hold at the ends of a text only, for
    what a tag holds must be found in the tags around it as well.
    """

    def __init__(self, parts: str | tuple[str, ...]):
        self.parts = [re.compile(p, re.I) for p in ((parts,) if isinstance(parts, str) else parts)]

    def search(self, text: str) -> bool:
        for line in text.split("\n"):
            at = 0
            for part in self.parts:
                m = part.search(line, at)
                if m is None:
                    break
                at = m.end()
            else:
                return True
        return False


@dataclass(eq=False, slots=True)
class Tag:
    name: str
    classes: list[str]
    parent: Tag | None
    node: int
    first_string: int
    first_out: int
    last_node: int = 0
    last_string: int = 0
    last_out: int = 0
    children: list = field(default_factory=list)  # tags and numbers of strings


class Page(HTMLParser):
    def __init__(self, html: str, cells: bool = False):
        super().__init__(convert_charrefs=True)
        self.tags: list[Tag] = []
        self.strings: list[str] = []
        self.out: list[str] = []
        self.cells = cells
        self.open: list[Tag] = [Tag("", [], None, -1, 0, 0)]
        self.open_names: Counter[str] = Counter()
        self.feed(html)
        self.close()
        while len(self.open) > 1:
            self._pop()
        # strings with single blanks: how many that are not empty, their length and the markup's up to each place
        lines = [" ".join(x.split()) for x in self.strings]
        self.lines = [x for x in lines if x]
        self.lines_upto = self._running(map(bool, lines))
        self.text_upto = self._running(len(x) + 1 for x in self.lines)
        self.out_upto = self._running(map(len, self.out))

    @staticmethod
    def _running(sizes) -> list[int]:
        upto = [0]
        for n in sizes:
            upto.append(upto[-1] + n)
        return upto

    def _string(self, text: str) -> None:
        self.open[-1].children.append(len(self.strings))
        self.strings.append(text)

    def handle_starttag(self, name, attrs):
        written = []
        given = {k: v or "" for k, v in attrs}
        classes = given.get("class", "").split()
        if "class" in given:
            given["class"] = " ".join(classes)
        for k, v in given.items():
            v = escape(v, quote=False)
            quote = '"'
            if '"' in v:
                quote, v = ("'", v) if "'" not in v else ('"', v.replace('"', "&quot;"))
            written.append(f" {k}={quote}{v}{quote}")
        tag = Tag(name, classes, self.open[-1], len(self.tags), len(self.strings), len(self.out))
        self.open[-1].children.append(tag)
        self.tags.append(tag)
        self.open.append(tag)
        self.open_names[name] += 1
        self.out.append(f"<{name}{''.join(written)}{'/' if name in VOID else ''}>")
        if name in VOID:
            self._pop()

    def handle_startendtag(self, name, attrs):
        self.handle_starttag(name, attrs)
        if name not in VOID:
            self._pop()

    def _pop(self) -> None:
        tag = self.open.pop()
        self.open_names[tag.name] -= 1
        if self.cells and tag.name in ("br", "td", "th", "tr"):
            self.open.append(tag)
            self._string(" | " if tag.name in ("td", "th") else "\n")
            self.open.pop()
        if tag.name not in VOID:
            self.out.append(f"</{tag.name}>")
        tag.last_node, tag.last_string, tag.last_out = len(self.tags), len(self.strings), len(self.out)

    def handle_endtag(self, name):
        while self.open_names[name]:
            done = self.open[-1].name == name
            self._pop()
            if done:
                break

    def handle_data(self, data):
        if self.open[-1].name in NO_TEXT:
            self.out.append(data)
        else:
            self._string(data)
            self.out.append(escape(data, quote=False))

    def handle_comment(self, data):
        self.out.append(f"<!--{data}-->")

    # --- reading ---

    def text(self, tag: Tag | int, sep: str = " ") -> str:
        """Stripped strings of a tag (or one string), joined."""
        some = [self.strings[tag]] if isinstance(tag, int) else self.strings[tag.first_string : tag.last_string]
        return sep.join(s for x in some if (s := x.strip()))

    def line(self, tag: Tag) -> str:
        """A tag's text with single blanks between words."""
        return " ".join(self.lines[self.lines_upto[tag.first_string] : self.lines_upto[tag.last_string]])

    def span(self, tag: Tag) -> tuple[int, int]:
        """Where the tag's line lies in the line of the whole page."""
        a, z = self.text_upto[self.lines_upto[tag.first_string]], self.text_upto[self.lines_upto[tag.last_string]]
        return a, max(a, z - 1)

    def line_length(self, tag: Tag) -> int:
        a, z = self.span(tag)
        return z - a

    def html(self, tag: Tag) -> str:
        return "".join(self.out[tag.first_out : tag.last_out])

    def html_length(self, tag: Tag) -> int:
        return self.out_upto[tag.last_out] - self.out_upto[tag.first_out]

    def siblings(self, tag: Tag) -> list[Tag]:
        return [t for t in tag.parent.children if isinstance(t, Tag)]

    def place(self, tags: list[Tag], tag: Tag) -> int:
        """Place of the first tag with the same markup, or -1."""
        own, size = self.html(tag), self.html_length(tag)
        alike = lambda t: t.name == tag.name and self.html_length(t) == size and self.html(t) == own
        return next((i for i, t in enumerate(tags) if t is tag or alike(t)), -1)

    def first_marked(self, tags: list[Tag], marker: Marker, read) -> Tag | None:
        """The first of ``tags`` (in document order) whose text, as ``read`` gives it, has the marker.

        Tags inside one that was searched in vain are passed over, so no string is read twice.
        """
        passed = 0
        for tag in tags:
            if tag.node >= passed:
                if marker.search(read(tag)):
                    return tag
                passed = tag.last_node
        return None


def page_text(html: str) -> str:
    page = Page(html)
    return "\n".join(s for x in page.strings if (s := x.strip()))


def marked_text(html: str) -> str:
    """All strings joined by spaces, with line breaks, cell bars and row ends."""
    return " ".join(Page(html, cells=True).strings)


def root_of(page: Page) -> Tag | None:
    root = next((t for t in page.tags if t.name == "div" and "spcWrapper" in t.classes), None)
    return root or next((t for t in page.tags if t.name == "body"), None) or (page.tags[0] if page.tags else None)


def section(html: str, start: Marker, end: Marker) -> tuple[bool, str, bool, str, bool, bool]:
    """(found, method, end found, markup, has a table, has a list)."""
    page = Page(html)
    root = root_of(page)
    if root is None:
        return False, "no_root", False, "", False, False
    inner = [t for t in page.tags[root.node + 1 : root.last_node] if t.name in MARKER_TAGS and page.line_length(t)]
    # short tags are read one by one, for all are short; of the others the outer ones are read
    small = [t for t in inner if t.name in SHORT_TAGS and page.line_length(t) <= SHORT]
    large = [t for t in inner if t.name not in SHORT_TAGS]

    def first_behind(node: int, marker: Marker) -> Tag | None:
        one = next((t for t in small if t.node > node and marker.search(page.line(t))), None)
        other = page.first_marked([t for t in large if t.node > node], marker, page.line)
        return min(filter(None, (one, other)), key=lambda t: t.node, default=None)

    first = first_behind(root.node, start)
    if first is None:
        return False, "not_found", False, "", False, False
    last = first_behind(first.node, end)

    def climbed(tag: Tag) -> Tag:
        while tag.parent.parent is not None and tag.parent is not root and tag.parent.name in CLIMBED:
            tag = tag.parent
        return tag

    folded = lambda t: t is not None and t.name == "summary" and t.parent.name == "details"
    method, chosen = "generic_fallback", []
    if folded(first):
        around = page.siblings(first.parent)
        a = page.place(around, first.parent)
        z = page.place(around, last.parent) if folded(last) else -1
        chosen = around[a : z if z >= 0 else len(around)]
        method = "details_summary" if chosen else method
    if not chosen:
        box = climbed(first)
        around = page.siblings(box)
        a = page.place(around, box)
        z = page.place(around, climbed(last)) if last is not None else -1
        z = z if z >= 0 else len(around)
        chosen = [box] if z <= a else around[a:z]
    # siblings without a gap are one range of tags
    inside = {t.name for t in page.tags[chosen[0].node : chosen[-1].last_node]}
    markup = "\n".join(map(page.html, chosen)).strip()
    return True, method, last is not None, markup, "table" in inside, bool(inside & {"ul", "ol"})


def name_section(html: str, start: Marker, end: Marker) -> str:
    """Text of the section that names the product."""
    page = Page(html)
    tag = page.first_marked([t for t in page.tags if t.name == "summary"], start, page.text)
    if tag is not None:
        around = page.siblings(tag)
        box = next((t for t in around[around.index(tag) + 1 :] if t.name == "div"), None)
        return page.text(box if box is not None else tag.parent)
    tag = page.first_marked([t for t in page.tags if t.name in ("h1", "h2", "h3", "h4")], start, page.text)
    if tag is not None:
        after = tag.parent.children
        parts = []
        for item in after[after.index(tag) + 1 :]:
            text = page.text(item)
            if end.search(text):
                break
            if text:
                parts.append(text)
        return " ".join(parts)
    return ""
