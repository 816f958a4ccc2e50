"""Main text of web pages.

Gradient-boosted trees over features of block elements say how likely each belongs to the article.  Decoding is hierarchical:
an element is outside, inside or cut out; inside may start anywhere below outside, a cut may start anywhere below
inside, and below a cut all is cut, so no element is kept within one that is cut.  Of all such choices the most
likely is found from the leaves up.

The trees are trained here on a bounded sample of pages (`sample`).  A page that marks its article by an element is taken with
these marks as labels.  Besides, pages are laid out anew from the texts of the sample: the blocks of a marked article, or
else the long ones, become the article, the rest its surroundings.  The layouts vary how parts are marked (elements,
classes, ids, or not at all), nested and ordered, so the trees learn from density, depth and neighbours too.
"""
from __future__ import annotations

import html
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelgrid.llm import boosting
from parcelgrid.llm.dom import GROUPS, OF_KIND, OF_WORD, Forest

BATCH = 1 << 20  # characters of pages that a task reads at once
MARKED = 1 << OF_KIND["article"] | 1 << OF_KIND["main"]
SWITCH = 4.0  # log odds that it takes to begin the article, or a cut in it
ELSEWHERE = 1 << OF_KIND["nav"] | 1 << OF_KIND["aside"] | 1 << OF_KIND["footer"] | 1 << OF_KIND["form"]
FOREIGN = OF_WORD["advert"] | OF_WORD["comment"] | OF_WORD["notice"]
SPARE = ["Home", "About", "Products", "News", "Contact us", "Read more", "Sign up now", "All rights reserved.", "Share this", "Log in", "We use cookies on this site."]


def marked(forest: Forest) -> np.ndarray:
    """Elements within the marked article, less what its marks call something else; none where no article is marked."""
    kind, around, words = np.array(forest.kind), np.array(forest.around), np.array(forest.above) | np.array(forest.groups)
    spans = around | 1 << kind
    return (spans & MARKED > 0) & (spans & ELSEWHERE == 0) & (words & FOREIGN == 0)


def material(source: str) -> tuple[list[str], list[str]]:
    """Blocks of a page that go into articles, and those that go around them."""
    forest = Forest()
    forest.add(0, source)
    within = marked(forest)
    if within.any():
        inner, outer = forest.blocks(within, 1)[0], forest.blocks(~within, 1)[0]
        return [b for b in inner.split("\n\n") if b], [b for b in outer.split("\n\n") if b]
    every = [b for b in forest.blocks(np.ones(len(within), bool), 1)[0].split("\n\n") if b]
    return [b for b in every if len(b) >= 80], [b for b in every if len(b) < 80]


class Layout:
    """One random way to lay out a page."""

    def __init__(self, inner: list[str], outer: list[str], rng: random.Random):
        self.rng, self.inner, self.outer = rng, inner, [b[:120] for b in outer] or SPARE
        self.marking = rng.choice(("element", "class", "id", "none", "element"))

    def short(self, words: int = 4) -> str:
        text = " ".join(self.rng.choice(self.rng.choice((self.outer, SPARE))).split()[:self.rng.randint(1, words)])
        return html.escape(text, quote=False)

    def sentence(self) -> str:
        words = self.rng.choice(self.inner).split()
        at = self.rng.randrange(len(words))
        return html.escape(" ".join(words[at:at + self.rng.randint(6, 60)]), quote=False)

    def wrap(self, body: str, element: str, group: str, keep: int | None = None, plain: str = "div") -> str:
        word = self.rng.choice(GROUPS[group].split())
        name = self.rng.choice((word, f"{word}-{self.rng.choice('abcxyz')}", f"{self.rng.choice(('site', 'page', 'main', 'top', 'block'))}-{word}"))
        tag, mark = {"element": (element, ""), "class": (plain, f' class="{name}"'), "id": (plain, f' id="{name}"'), "none": (plain, "")}[self.marking]
        if group in ("advert", "comment", "notice", "more", "side") and self.rng.random() < 0.8:  # these are hardly ever left unmarked
            mark = f' {self.rng.choice(("class", "id"))}="{name}"'
        return f"<{tag}{mark}{'' if keep is None else f' data-keep={keep}'}>{body}</{tag}>"

    def links(self, n: int, listed: bool = True) -> str:
        each = [f'<a href="/{k}">{self.short()}</a>' for k in range(n)]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in each) + "</ul>" if listed else " | ".join(each)

    def around(self, group: str) -> str:
        r = self.rng
        if group == "menu":
            return self.wrap(self.links(r.randint(3, 10), r.random() < 0.8), "nav", "menu")
        if group == "header":
            return self.wrap(f"<p>{self.short(6)}</p>" + (self.links(r.randint(2, 6)) if r.random() < 0.5 else ""), "header", "header")
        if group == "footer":
            return self.wrap(f"&copy; {self.short(8)} &middot; {self.short(12)}" + (self.links(r.randint(2, 8), False) if r.random() < 0.5 else ""), "footer", "footer")
        if group == "side":
            parts = "".join(f"<h3>{self.short()}</h3>" + r.choice((self.links(r.randint(2, 6)), f"<p>{self.sentence()}</p>")) for _ in range(r.randint(1, 4)))
            return self.wrap(parts, "aside", "side")
        if group == "advert":
            text = r.choice((self.short(10), self.sentence()))
            return self.wrap(r.choice((text, f'<a href="/x">{text}</a>', f"<p>{text}</p>")), "div", "advert")
        if group == "notice":
            return self.wrap(f"<p>{r.choice((self.short(12), self.sentence()))}</p><button>{self.short(2)}</button>", "div", "notice")
        if group == "form":
            return (f"<form{r.choice(('', ' class=search', ' id=login'))}><label>{self.short(3)}</label><input type=text><p>{self.short(8)}</p>"
                    f"<select><option>{self.short(2)}<option>{self.short(2)}</select><button>{self.short(2)}</button></form>")
        if group == "comment":
            each = "".join(r.choice((f"<div class=comment><b>{self.short(2)}</b><p>{self.sentence()}</p></div>", f"<li><p>{self.short(2)}</p><p>{self.sentence()}</p></li>",
                                     f"<article class=comment><p>{self.sentence()}</p></article>")) for _ in range(r.randint(1, 8)))
            return self.wrap(f"<h3>{self.short()}</h3>{each}", "section", "comment")
        return self.wrap(f"<h3>{self.short()}</h3>{self.links(r.randint(2, 6), r.random() < 0.6)}", r.choice(("div", "section")), "more")

    def part(self, block: str) -> str:
        """One block of the article."""
        r, text = self.rng, html.escape(block, quote=False)
        words = text.split(" ")
        if r.random() < 0.3 and len(words) > 4:
            at = r.randrange(len(words) - 2)
            tag = r.choice(("b", "i", 'a href="/l"', "em", "span"))
            words[at:at + 2] = [f"<{tag}>{words[at]}", f"{words[at + 1]}</{tag.split()[0]}>"]
            text = " ".join(words)
        kind = r.random()
        if kind < 0.75:
            return f"<p>{text}</p>"
        if kind < 0.8:
            return f"<p>{text}"
        if kind < 0.84:
            return f"<blockquote><p>{text}</p></blockquote>"
        if kind < 0.88:
            return f"<{r.choice(('div', 'pre'))}>{text}</{r.choice(('div', 'pre'))}>"
        if kind < 0.92:
            return f"<h2>{' '.join(words[:8])}</h2><p>{text}</p>"
        if kind < 0.96:
            step = max(1, len(words) // r.randint(2, 6))
            return "<ul>" + "".join(f"<li>{' '.join(words[k:k + step])}</li>" for k in range(0, len(words), step)) + "</ul>"
        return f"<figure><img src=x><figcaption>{' '.join(words[:20])}</figcaption></figure><p>{text}</p>"

    def page(self) -> str:
        r = self.rng
        blocks = r.choice((self.inner, r.sample(self.inner, r.randint(1, len(self.inner)))))
        if r.random() < 0.25:  # a short one
            blocks = [" ".join(b.split()[:r.randint(1, 15)]) for b in blocks[:r.randint(1, 4)]]
        if r.random() < 0.3:  # the heading comes again as text
            blocks = blocks[:1] + blocks
        cut = [f"<div data-keep=0>{self.around(g)}</div>" if r.random() < 0.3 else self.around(g).replace(">", " data-keep=0>", 1)
               for g in r.sample(("advert", "more", "form", "notice", "side"), r.randint(0, 2))]
        parts = [self.part(b) for b in blocks[1:]]
        for c in cut:
            parts.insert(r.randint(0, len(parts)), c)
        body = f"<h1>{html.escape(blocks[0], quote=False)}</h1>" + "".join(parts)
        if r.random() < 0.3:
            body = f"<div>{body}</div>"
        comments = self.around("comment") if r.random() < 0.4 else ""
        if comments and r.random() < 0.4:  # within the article's element
            body, comments = body + comments.replace(">", " data-keep=0>", 1), ""
        main = self.wrap(body, r.choice(("article", "article", "main", "section")), "content", keep=1)
        before = [self.around(g) for g in ("header", "menu", "notice", "advert", "form") if r.random() < 0.55]
        after = [comments] + [self.around(g) for g in ("side", "more", "advert", "notice", "form", "footer") if r.random() < 0.5]
        if r.random() < 0.3:
            before.append(after.pop())
        for _ in range(r.randint(0, 2)):
            main = f"<div{r.choice(('', ' class=wrap', ' id=page', ' class=container'))}>{main}</div>"
        return "<body>" + "".join(before) + main + "".join(after) + "</body>"


def train(pages: DataFrame, sample: int = 400, layouts: int = 2, **settings) -> boosting.Trees:
    """Boosted trees fitted on `layouts` layouts of each of about `sample` pages, chosen by a hash of their text over all pages."""
    usable = pages.select(F.col("html")).filter(F.length("html") > 0)
    share = max(1, usable.count() // sample)
    texts = [r["html"] for r in usable.filter(F.pmod(F.xxhash64("html"), F.lit(share)) == 0).limit(2 * sample).collect()]
    return fitted(sorted(set(texts)), layouts, **settings)


def fitted(texts: list[str], layouts: int, seed: int = 11, **settings) -> boosting.Trees:
    """Trees from the pages with a marked article and `layouts` new layouts of each page."""
    rng, own, laid = random.Random(seed), Forest(), Forest()
    pages = [0, 0]
    for source in texts:
        inner, outer = material(source)
        one = Forest()
        one.add(0, source)
        if marked(one).any():
            own.add(pages[0], source)
            pages[0] += 1
        for _ in range(layouts if inner else 0):
            laid.add(pages[1], Layout(inner[:60], outer[:60], rng).page(), training=True)
            pages[1] += 1
    some = [f for f, n in zip((own, laid), pages) if n]
    if not some:
        return boosting.train(np.zeros((0, 1), np.float32), np.zeros(0), np.zeros(0), **settings)
    label = np.concatenate([marked(f) if f is own else kept(f) for f in some])
    return boosting.train(np.concatenate([f.features() for f in some]), label.astype(float), np.concatenate([weights(f) for f in some]), **settings)


def kept(forest: Forest) -> np.ndarray:
    """Which elements of training pages are the article: marks hold for all below, and within a cut all is cut."""
    label = np.zeros(len(forest.page), np.int64)
    for k, (up, mark) in enumerate(zip(forest.parent, forest.marked)):
        label[k] = -1 if up >= 0 and label[up] < 0 else (label[up] if up >= 0 else 0) if mark < 0 else (1 if mark else -1)
    return label > 0


def weights(forest: Forest) -> np.ndarray:
    """An element counts by the text below it."""
    total = np.concatenate([[0], np.cumsum(forest.chars)])
    return 0.2 + np.log1p(total[np.array(forest.last) + 1] - total[:-1])


def decoded(forest: Forest, odds: np.ndarray) -> np.ndarray:
    """The elements that are inside, in the most likely consistent choice."""
    w = weights(forest)
    yes, no = (-w * np.logaddexp(0, -odds)).tolist(), (-w * np.logaddexp(0, odds)).tolist()
    n, parent = len(yes), forest.parent
    inside, outside, cut = yes, list(no), no  # best values with all below, filled from the last element up
    for k in range(n - 1, -1, -1):
        up = parent[k]
        if up >= 0:
            inside[up] += max(inside[k], cut[k] - SWITCH)
            outside[up] += max(inside[k] - SWITCH, outside[k])
            cut[up] += cut[k]
    state = [0] * n  # 0 outside, 1 inside, 2 cut
    for k in range(n):
        above = state[parent[k]] if parent[k] >= 0 else 0
        if above == 0:
            state[k] = 1 if inside[k] - SWITCH > outside[k] else 0
        elif above == 1:
            state[k] = 1 if inside[k] >= cut[k] - SWITCH else 2
        else:
            state[k] = 2
    return np.array(state) == 1


def main_texts(sources: list[str], trees: boosting.Trees) -> list[str]:
    """Main text of each page."""
    forest = Forest()
    for k, source in enumerate(sources):
        forest.add(k, source)
    if not sources:
        return []
    return forest.blocks(decoded(forest, trees.score(forest.features())), len(sources))


def extract(pages: DataFrame, trees: boosting.Trees) -> DataFrame:
    """page_id, url, text, n_chars (code points) for every row.

    Null and empty html, and pages where nothing is likely enough, give an empty text; rows with equal or null ids and urls are
    rows of their own; other columns are not looked at.  Character references are decoded, white space within a block becomes one
    space, and blocks are joined by a blank line.
    """
    shared = pages.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        for batch in batches:
            texts, held, size = [], [], 0
            for source in batch.column("html"):
                held.append(source.as_py())
                size += len(held[-1])
                if size > BATCH:
                    texts += main_texts(held, shared.value)
                    held, size = [], 0
            texts += main_texts(held, shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return (pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
            .mapInArrow(run, "page_id long, url string, text string, n_chars long"))
