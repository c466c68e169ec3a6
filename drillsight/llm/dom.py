"""HTML text to a tree of blocks, forgiving like a browser.

Nodes are block-level elements and runs of text between their borders; inline elements only
lend their marks (links, images).  An element with one run and nothing else holds its text
itself.  Character references are decoded and white space (any that
Unicode calls so) is turned into one space.  Comments, scripts, styles and other elements that
show no text are left out; what never ends (a comment, a script, a tag) runs to the end of
the page.  An end tag without its start is passed over, and elements that may be left open (``p``,
``li``, table parts) end where the next one begins.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

# What elements are, as in the HTML standard.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style xmp iframe noembed noframes textarea title noscript template svg math".split())
_SILENT = frozenset("button select option optgroup datalist object canvas audio video map head".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q ruby rb rp rt "
    "s samp slot small span strike strong sub sup time tt u var".split()
)
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split()
)
#: What a start tag ends, and where the search for it stops.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
}
#: Searches for the start of an end tag do not leave these, unless they are looked for.
_SCOPES = frozenset("table td th caption".split())
_TABLE = frozenset("table caption thead tbody tfoot tr td th".split())

_TAG = re.compile(
    r"<!--(?s:.*?)(?:--!?>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"""|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)"
)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>`]+)))?""")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE) for tag in _RAW}
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)

TEXT = "#text"


@dataclass
class Tree:
    """Nodes in page order; ``ends`` is one behind the last node of a node's subtree."""

    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    depths: list[int] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)
    tokens: list[tuple[str, ...]] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    link_chars: list[int] = field(default_factory=list)
    links: list[int] = field(default_factory=list)
    inputs: list[int] = field(default_factory=list)
    images: list[int] = field(default_factory=list)
    inlines: list[int] = field(default_factory=list)
    marks: list[str] = field(default_factory=list)

    def add(self, tag: str, parent: int, tokens: tuple[str, ...], mark: str) -> int:
        at = len(self.tags)
        self.tags.append(tag)
        self.parents.append(parent)
        self.depths.append(self.depths[parent] + 1 if parent >= 0 else 0)
        self.ends.append(at + 1)
        self.tokens.append(tokens)
        self.texts.append("")
        for column in (self.link_chars, self.links, self.inputs, self.images, self.inlines):
            column.append(0)
        self.marks.append(mark)
        return at


    def fold(self) -> None:
        """Let the node before the last one take its text over."""
        for column in (self.tags, self.parents, self.depths, self.ends, self.tokens, self.marks):
            column.pop()
        self.texts[-2:] = [self.texts[-1]]
        for column in (self.link_chars, self.links, self.inputs, self.images, self.inlines):
            column[-2:] = [column[-2] + column[-1]]


def words_of(name: str) -> list[str]:
    """Words of a class or id, singular and in lower case."""
    found = [x.lower() for x in _WORDS.findall(name)]
    return [x[:-1] if len(x) > 2 and x.endswith("s") and not x.endswith("ss") else x for x in found if len(x) > 1]


def attribute_tokens(tag: str, attributes: dict[str, str]) -> tuple[str, ...]:
    """The tag, words of class, id and role, and whether the element is hidden."""
    out = {f"<{tag}>"}
    for name in ("class", "id", "role"):
        out.update(words_of(attributes.get(name, "")))
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or _HIDDEN.search(attributes.get("style", "")):
        out.add("<hidden>")
    return tuple(sorted(out))


def parse(html: str, mark: str | None = None) -> Tree:
    """The tree of a page.  ``mark`` names an attribute whose value nodes inherit (for training)."""
    tree = Tree()
    stack = [tree.add("body", -1, (), "")]
    pieces: list[tuple[str, bool]] = []
    silent: list[str] = []
    link_in, counts = -1, [0, 0, 0, 0]
    at = 0

    def end_run() -> None:
        nonlocal counts
        if not pieces and not any(counts):
            return
        top = stack[-1]
        text = " ".join("".join(x for x, _ in pieces).split())
        where = tree.add(TEXT, top, (), tree.marks[top]) if text else top
        if text:
            tree.texts[where] = text
            tree.link_chars[where] = min(len(text), sum(len(x.strip()) for x, linked in pieces if linked))
        for column, n in zip((tree.links, tree.inputs, tree.images, tree.inlines), counts, strict=True):
            column[where] += n
        pieces.clear()
        counts = [0, 0, 0, 0]

    def pop() -> None:
        nonlocal link_in
        end_run()
        done = stack.pop()
        if done and len(tree.tags) == done + 2 and tree.tags[-1] == TEXT:
            tree.fold()
        tree.ends[done] = len(tree.tags)
        if link_in == done:
            link_in = -1

    def pop_to(tags: set[str] | frozenset[str], stops: set[str] | frozenset[str]) -> None:
        """End the nearest open element of ``tags``, and what is open in it."""
        for k in range(len(stack) - 1, 0, -1):
            tag = tree.tags[stack[k]]
            if tag in tags:
                while len(stack) > k:
                    pop()
                return
            if tag in stops:
                return

    while found := _TAG.search(html, at):
        if found.start() > at and not silent:
            pieces.append((unescape(html[at : found.start()]), link_in >= 0))
        at = found.end()
        close, tag, rest = found.group(1, 2, 3) if found.group(2) else found.group(4, 5, 6)
        if not tag:
            continue
        if at == len(html) and html[-1] != ">":
            break  # a tag that never ends
        tag = tag.lower()
        if silent:
            if close and tag == silent[-1]:
                silent.pop()
            elif not close and tag in _SILENT and tag == silent[-1]:
                silent.append(tag)
            elif (tag == "body" and not close) or (close and tag in ("html", "body")):
                silent.clear()
            elif not close and tag in _RAW:
                end = _RAW_END[tag].search(html, at)
                at = end.end() if end else len(html)
            continue
        if close:
            if tag in _INLINE:
                link_in = -1 if tag == "a" else link_in
            elif tag == "br":
                pieces.append((" ", False))
            elif tag not in ("html", "body") and tag not in _VOID:
                end_run()
                pop_to({tag}, _TABLE - {tag} if tag in _TABLE and tag != "table" else _SCOPES - {tag})
            continue
        if tag in ("html", "body"):
            continue
        if tag in _RAW:
            if not rest.rstrip().endswith("/") or tag not in ("svg", "math"):
                end = _RAW_END[tag].search(html, at)
                at = end.end() if end else len(html)
            counts[1] += tag == "textarea"
            continue
        if tag in _SILENT:
            counts[1] += tag in ("button", "select")
            silent.append(tag)
            continue
        if tag in _VOID:
            if tag == "br":
                pieces.append((" ", False))
            elif tag == "hr":
                end_run()
                if tree.tags[stack[-1]] == "p":
                    pop()
            counts[1] += tag == "input"
            counts[2] += tag == "img"
            continue
        if tag in _INLINE:
            counts[3] += 1
            if tag == "a":
                counts[0] += 1
                link_in = stack[-1]
            continue
        end_run()
        if tag in _CLOSES_P and tree.tags[stack[-1]] == "p":
            pop()
        if tag in _ENDS:
            pop_to(*_ENDS[tag])
            if tree.tags[stack[-1]] == "p":
                pop()
        attributes = {}
        if rest.strip():
            for name, *values in _ATTRIBUTE.findall(rest):
                attributes.setdefault(name.lower(), unescape(next(filter(None, values), "")))
        of = attributes.get(mark, tree.marks[stack[-1]]) if mark else ""
        stack.append(tree.add(tag, stack[-1], attribute_tokens(tag, attributes), of))
    if at < len(html) and not silent:
        pieces.append((unescape(html[at:]), link_in >= 0))
    while stack:
        pop()
    return tree
