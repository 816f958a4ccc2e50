"""Pages as trees of block elements, in arrays that hold many pages at once."""
from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import numpy as np

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</[^a-zA-Z>][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|itemprop|aria-label|data-testid)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
ENDS = {t: re.compile(rf"</{t}(?=[\s/>])|\Z", re.I) for t in ("script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes")}

# Element names by their part in a page.
HIDDEN = {"script", "style", "title", "xmp", "iframe", "noembed", "noframes", "head", "template", "noscript", "svg", "object", "canvas", "audio", "video", "math"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "rp", "rt",
          "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4",
            "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
KINDS = (("p",), ("h1",), ("h2", "h3", "h4", "h5", "h6"), ("li", "dt", "dd"), ("ul", "ol", "dl", "menu"), ("div", "center"), ("section",), ("article",), ("main",),
         ("nav",), ("header",), ("footer",), ("aside",), ("form", "button", "select", "option", "label", "textarea", "fieldset", "legend"),
         ("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"), ("blockquote",), ("pre",), ("figure", "figcaption"), ("body", "html"))
# Usual words in the class, id and role attributes of page parts.
GROUPS = {
    "content": "article content main story post entry body text articlebody hentry blogpost prose",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs tabs toc pagination pager sitemap crumbs",
    "header": "header masthead topbar logo branding hero tagline",
    "footer": "footer copyright colophon legal bottom credits foot",
    "side": "sidebar aside side widget widgets rail complementary secondary column",
    "advert": "ad ads advert advertisement advertising sponsor sponsored promo promotion banner adsense dfp commercial",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay dialog disclaimer paywall subscribe newsletter signup message",
    "comment": "comment comments commentlist reply replies respond disqus discussion discuss feedback reader readers",
    "form": "form search login register contact",
    "more": "share sharing social related recommended recommendations more popular trending tags follow",
}
OF_KIND = {name: k for k, names in enumerate(KINDS) for name in names}
OF_WORD = {word: 1 << g for g, words in enumerate(GROUPS.values()) for word in words.split()}
CLOSERS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
           "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}


def groups_of(attributes: str) -> int:
    """Word groups that the attributes of an element name, as bits."""
    bits = 0
    for found in ATTRIBUTE.finditer(attributes):
        for word in NAME.findall(found[2] or found[3] or found[4] or ""):
            bits |= OF_WORD.get(word.lower(), 0)
    return bits


@dataclass
class Forest:
    """Block elements of several pages in document order; element 0 of each page is its root."""
    page: list[int] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    last: list[int] = field(default_factory=list)      # the last element within each
    kind: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    groups: list[int] = field(default_factory=list)    # word groups of its own attributes
    above: list[int] = field(default_factory=list)     # those of all elements around it
    around: list[int] = field(default_factory=list)    # kinds of all elements around it, as bits
    chars: list[int] = field(default_factory=list)     # of its own text
    linked: list[int] = field(default_factory=list)    # of its own text, within links
    marks: list[int] = field(default_factory=list)     # full stops and commas of its own text
    pieces: list[tuple[int, str, bool]] = field(default_factory=list)  # (element, text, whether a block ends before it)
    marked: list[int] = field(default_factory=list)    # whether a training page says that an element is kept (1) or not (0), -1 where it says nothing

    def element(self, page: int, parent: int, kind: int, groups: int) -> int:
        k = len(self.page)
        inside = parent >= 0
        for column, value in ((self.page, page), (self.parent, parent), (self.last, k), (self.kind, kind), (self.groups, groups), (self.chars, 0),
                              (self.linked, 0), (self.marks, 0), (self.depth, self.depth[parent] + 1 if inside else 0), (self.marked, -1),
                              (self.above, self.above[parent] | self.groups[parent] if inside else 0),
                              (self.around, self.around[parent] | 1 << self.kind[parent] if inside else 0)):
            column.append(value)
        return k

    def add(self, page: int, source: str, training: bool = False) -> None:
        """Reads one page; any text is some page."""
        root = self.element(page, -1, OF_KIND["html"], 0)
        names, nodes = ["html"], [root]      # open elements; an inline one stands for the block around it
        count: dict[str, int] = {"html": 1}
        links = hidden = 0
        split, at, size = True, 0, len(source)

        def close(to: int) -> None:
            nonlocal links, hidden, split
            while len(names) > to:
                name, node = names.pop(), nodes.pop()
                count[name] -= 1
                if name in HIDDEN:
                    hidden -= 1
                elif name == "a":
                    links -= 1
                if name not in INLINE:
                    split = True
                if node != nodes[-1]:
                    self.last[node] = len(self.page) - 1

        def latest(name: str) -> int:
            k = len(names) - 1
            while names[k] != name:  # what lies above is closed with it, so each element is passed once
                k -= 1
            return k

        def closed_by(name: str) -> None:
            if name in CLOSES_P and count.get("p"):
                close(latest("p"))
            if name in CLOSERS:
                same, border = CLOSERS[name]
                for k in range(len(names) - 1, 0, -1):
                    if names[k] in same:
                        close(k)
                        break
                    if names[k] in border or names[k] not in INLINE and names[k] not in ("p", "div", "address"):
                        break

        while at < size:
            token = TOKEN.match(source, at)
            at = token.end()
            name = token[2]
            if name is None:
                text = token[0]
                if hidden or text[:2] in ("<!", "<?", "</"):
                    continue
                if "&" in text:
                    text = html.unescape(text)
                node = nodes[-1]
                self.pieces.append((node, text, split))
                if not text.isspace():
                    split = False
                    n = len(text)
                    self.chars[node] += n
                    self.marks[node] += text.count(".") + text.count(",")
                    if links:
                        self.linked[node] += n
                continue
            name = name.lower()
            if token[1]:
                if count.get(name) and len(names) > 1 and name != "html":
                    close(max(1, latest(name)))
                elif name == "p":
                    split = True
                continue
            if name == "br":
                self.pieces.append((nodes[-1], "\n", split))
                continue
            if name not in INLINE:
                closed_by(name)
                split = True
            if name in VOID or name in ("html", "body") and count.get(name):
                continue
            attributes = token[3]
            groups = groups_of(attributes) if "=" in attributes else 0
            node = nodes[-1]
            if not hidden and name not in HIDDEN and (name not in INLINE or groups and name != "a"):
                node = self.element(page, node, OF_KIND.get(name, len(KINDS)), groups)
                if training and "data-keep=" in attributes:
                    self.marked[node] = int(attributes.split("data-keep=")[1][0])
            if attributes.endswith("/") and name in ("svg", "math", "object"):
                continue
            names.append(name)
            nodes.append(node)
            count[name] = count.get(name, 0) + 1
            hidden += name in HIDDEN
            links += name == "a"
            if name in ENDS:
                stop = ENDS[name].search(source, at).start()
                if name == "textarea":
                    self.chars[node] += stop - at
                at = stop
        close(1)
        self.last[root] = len(self.page) - 1

    def features(self) -> np.ndarray:
        """One row per element: its kind, words of its attributes and of those around it, depth, text and link density of its
        subtree, its share of the page and of its parent, and the same of its neighbours among its siblings."""
        a = {k: np.array(getattr(self, k), np.int64) for k in ("page", "parent", "last", "kind", "depth", "groups", "above", "around", "chars", "linked", "marks")}
        n = len(a["page"])
        here = np.arange(n)

        def below(x: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(x)])
            return (total[a["last"] + 1] - total[here]).astype(np.float64)

        root = np.maximum.accumulate(np.where(a["parent"] < 0, here, 0))
        up = np.where(a["parent"] < 0, here, a["parent"])
        chars, linked, marks, size = below(a["chars"]), below(a["linked"]), below(a["marks"]), below(np.ones(n))
        paragraphs = below(a["kind"] == OF_KIND["p"])
        before = np.concatenate([[0], np.cumsum(a["chars"])])
        page_chars = np.maximum(chars[root], 1)
        order = np.lexsort((here, up))
        sibling = np.empty(n, np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(up[order])) + 1])
        sibling[order] = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
        many = np.bincount(up, minlength=n)
        same = np.unique(up * (len(KINDS) + 1) + a["kind"], return_inverse=True, return_counts=True)
        density = linked / np.maximum(chars, 1)
        previous, following = np.full(n, -1), np.full(n, -1)
        inner = np.flatnonzero(up[order][1:] == up[order][:-1])
        previous[order[inner + 1]], following[order[inner]] = order[inner], order[inner + 1]
        columns = [a["kind"] == k for k in range(len(KINDS))] + [a["around"] >> k & 1 for k in range(len(KINDS))]
        columns += [a["groups"] >> g & 1 for g in range(len(GROUPS))] + [a["above"] >> g & 1 for g in range(len(GROUPS))]
        columns += [a["depth"], np.log1p(chars), np.log1p(a["chars"]), density, chars / size, chars / page_chars, (before[here] - before[root]) / page_chars,
                    paragraphs, paragraphs / size, marks / np.maximum(chars, 1), size, many[up], many, sibling, sibling / np.maximum(many[up], 1),
                    same[2][same[1].ravel()] / np.maximum(many[up], 1), chars / np.maximum(chars[up], 1), density[up], paragraphs[up]]
        for near in (previous, following):
            columns += [np.where(near < 0, -1, np.log1p(chars[near])), np.where(near < 0, -1, density[near]), np.where(near < 0, -1, a["kind"][near])]
        return np.stack([np.asarray(c, np.float32) for c in columns], axis=1)

    def blocks(self, keep: np.ndarray, pages: int) -> list[str]:
        """Text of the kept elements of each page, white space within a block made one space, blocks joined by a blank line."""
        found: list[list[str]] = [[] for _ in range(pages)]
        current: list[str] = []
        of, broken = -1, True
        held = keep.tolist()

        def flush() -> None:
            if current:
                text = " ".join("".join(current).split())
                if text:
                    found[of].append(text)
                current.clear()

        for node, text, split in self.pieces:
            broken = broken or split
            if held[node]:
                if broken or self.page[node] != of:
                    flush()
                    of, broken = self.page[node], False
                current.append(text)
        flush()
        return ["\n\n".join(parts) for parts in found]
