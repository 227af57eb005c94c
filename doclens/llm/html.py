"""Main text of web pages by composite text density.

Every DOM node has its characters, tags, and the same within links. Its density is
characters per tag, scaled down by the share of link text; a node's sum is its children's densities together. The least density on the path
from the node of greatest sum up to the body is the threshold. That node, and of each block beside its path that reaches the threshold the
node of greatest sum, are the text; blocks below it are none.

Names only adjust that, where density can't tell, as in a reader's comment or an advert of plain prose. Subtrees that their element, role, class or id names as
menus, footers, sidebars, notices, adverts, forms or reader comments are no text, unless they hold <main>, most of the text of articles or most of the page's; nor are headers, but for those within an article that hold its heading. A name that
only contains such a word ("related-work") raises a doubt, which the subtree's density settles. <article> and <main> are hints: the node of greatest sum stands for the one around it, and beside the path they need a lower density. Scripts and styles aren't parsed.

Defined cases: null, empty and text-free pages give an empty text; unclosed and misnested tags are
closed as browsers do for paragraphs, list items and table cells; a < without a > is text; after a quote that never ends tags end at the next >; repeated rows and null ids are treated one by
one; an empty table gives an empty result; other columns are ignored, whatever their names. A page is read in time in proportion to its length.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from functools import lru_cache
from math import e, log

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.llm.common import arrow_map, table

NAME = re.compile(r"[A-Za-z][^\s/>]*")
#: The rest of a tag: quoted values may hold its end. Possessive, so a tag without an end is read once.
REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
MARKS = frozenset("class id role itemprop".split())
NONE = re.compile(r"(?<![\w-])display\s*:\s*none", re.I)
SPACE = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe canvas select".split())
#: Elements that part text into blocks; all others, known or not, stand within a line.
BLOCKS = frozenset(
    "html head body address article aside blockquote button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr "
    "legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
NOISE = frozenset("nav header footer aside form menu dialog button fieldset head".split())
NOISE_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs masthead footer sidebar aside ad ads advert adverts advertisement advertising "
    "adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social recommended skip "
    "comment comments commentlist reply replies respond disqus discussion pagination pager toolbar contentinfo complementary".split()
)
#: Words that name noise as a whole token; as a part of one they only raise a doubt ("related-work"), which the density settles.
DOUBTFUL = frozenset("header foot side rail widget search related".split())
#: First parts of tokens that tell of noise elsewhere ("has-sidebar").
TELLS = frozenset("has with without no not is show hide hidden".split())
#: The part of the threshold that a doubtful subtree has to reach, and an <article> or <main> beside the path.
DOUBT, HINT = 0.5, 0.25
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements and roles whose plain text may be most of a page's and still be none of its main text.
MENUS = frozenset("nav footer menu button head".split())
KEEP = frozenset("html body main".split())
#: A start tag in the key closes open elements of the value, up to the nearest that stands in SCOPE.
P_ENDS = "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dd dt".split()
CLOSES = {x: frozenset({"p"}) for x in P_ENDS} | {
    "li": frozenset({"p", "li"}), "dd": frozenset({"p", "dd", "dt"}), "dt": frozenset({"p", "dd", "dt"}), "tr": frozenset({"p", "tr", "td", "th"}),
    "td": frozenset({"p", "td", "th"}), "th": frozenset({"p", "td", "th"}), "option": frozenset({"option"}), "tbody": frozenset({"p", "tr", "td", "th", "thead", "tbody"}),
    "tfoot": frozenset({"p", "tr", "td", "th", "tbody"}),
}
SCOPE = frozenset("ul ol dl table div article section main body html td th blockquote".split())


class Node:
    __slots__ = ("tag", "noise", "doubt", "kids", "parent", "chars", "tags", "link_chars", "link_tags", "density", "total", "main", "kept")

    def __init__(self, tag: str, parent: Node | None, named: tuple[bool, bool] = (False, False)):
        self.tag, self.parent, self.kids = tag, parent, []
        self.noise, self.doubt = named
        self.main = tag in ("article", "main")


@lru_cache(4096)
def named(token: str) -> tuple[bool, bool]:
    """Whether a class or id names noise, and whether it raises a doubt: by the whole of it, or by its first or last part."""
    parts = [x for x in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", token).lower()) if x]
    if len(parts) < 2:
        return bool(parts) and (parts[0] in NOISE_WORDS or parts[0] in DOUBTFUL), False
    if parts[0] in TELLS:
        return False, False
    ends = (parts[0], parts[-1])
    return any(x in NOISE_WORDS for x in ends), any(x in DOUBTFUL for x in ends)


def is_noise(tag: str, attributes: str) -> tuple[bool, bool]:
    """(noise, doubtful), by what the element is and is called."""
    if tag in NOISE:
        return True, False
    noise = doubt = False
    if not attributes or tag in KEEP:
        return noise, doubt
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "style" and NONE.search(value) or name == "aria-hidden" and value.strip().lower() == "true":
            return True, False
        if name == "aria-label":
            x = value.strip().lower()
            noise |= x in NOISE_WORDS or x in DOUBTFUL
        elif name in MARKS:
            for x, y in map(named, value.split()):
                noise, doubt = noise or x, doubt or y
    return noise, doubt


def spare_content(root: Node) -> None:
    """What was named noise but holds most of the page's plain text (outside links, menus and footers), <main>, or most of what stands in articles, is none; nor is an article's header with its heading."""
    nodes = walk(root)
    plain, named, mains, heads = {}, {}, set(), set()
    for n in reversed(nodes):
        kids = [k for k in n.kids if isinstance(k, Node)]
        plain[n] = 0 if n.tag == "a" or n.tag in MENUS else sum(len(k.strip()) for k in n.kids if isinstance(k, str)) + sum(plain[k] for k in kids)
        named[n] = plain[n] if n.tag == "article" else sum(named[k] for k in kids)
        if n.tag == "main" or any(k in mains for k in kids):
            mains.add(n)
        if n.tag in HEADINGS or any(k in heads for k in kids):
            heads.add(n)
    within = set()
    for n in nodes:
        if n.main or n.parent in within:
            within.add(n)
        if n.noise and (n in mains or 2 * plain[n] > plain[root] or 2 * named[n] > named[root] or n.tag == "header" and n in heads and n in within):
            n.noise = False


class Open:
    """The open elements, and how many of each tag are open within each scope: what isn't open isn't looked for."""

    def __init__(self, root: Node):
        self.top, self.counts, self.all = root, [Counter({root.tag: 1})], Counter({root.tag: 1})

    def push(self, node: Node) -> None:
        self.top = node
        if node.tag in SCOPE:
            self.counts.append(Counter())
        self.counts[-1][node.tag] += 1
        self.all[node.tag] += 1

    def close(self, node: Node) -> None:
        """Closes the node and all within it; the root stays."""
        while True:
            x = self.top
            self.all[x.tag] -= 1
            self.counts[-1][x.tag] -= 1
            if x.tag in SCOPE:
                self.counts.pop()
            self.top = x.parent
            if x is node:
                return

    def nearest(self, tag: str) -> Node | None:
        """The innermost open element of the tag; of one within a line, none beyond its scope."""
        if not (self.all[tag] if tag in BLOCKS else self.counts[-1][tag]):
            return None
        node = self.top
        while node.tag != tag:
            node = node.parent
        return node

    def outermost(self, tags: frozenset[str]) -> Node | None:
        """The outermost open element of the tags within the scope."""
        found, node = None, self.top
        for counts in reversed(self.counts):
            if not (left := sum(counts[t] for t in tags)):
                break
            while left:
                if node.tag in tags:
                    left, found = left - 1, node
                node = node.parent
            if found.tag not in SCOPE:  # else the scope itself is to be closed, and the one around it is asked
                break
        return found


def parse(page: str) -> Node:
    """The tree; text stands in it as strings. Each character is read a bounded number of times."""
    root = Node("html", None)
    open_, at, gt, size, quotes = Open(root), 0, -1, len(page), True
    while at < size:
        lt = page.find("<", at)
        if 0 <= gt < lt or gt < lt and at == 0:
            gt = page.find(">", lt)
        if lt < 0 or gt < 0 and not page.startswith("<!--", lt):
            open_.top.kids.append(page[at:])
            break
        if lt > at:
            open_.top.kids.append(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = end + 3 if end >= 0 else size
            continue
        closing = page.startswith("/", lt + 1)
        m = NAME.match(page, lt + 1 + closing)
        if m is None:
            if page[lt + 1] in "!?" or closing:
                at = gt + 1
            else:
                open_.top.kids.append("<")
                at = lt + 1
            continue
        tag, rest = m[0].lower(), REST.match(page, m.end()) if quotes else None
        if rest is None:  # a quote that never ends: from here on tags end at the next >
            quotes, at = False, page.find(">", m.end()) + 1
        else:
            at = rest.end()
        attributes = page[m.end() : at - 1]
        if closing:
            node = open_.nearest(tag)
            if node is not None and node.parent is not None:
                open_.close(node)
            elif tag == "br":
                open_.top.kids.append(" ")
            continue
        empty = attributes.endswith("/") and attributes[-2:-1] in ("", " ", "\n", "\t", '"', "'")  # not <a href=/>
        if tag in RAW and not empty:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag in VOID or tag == "html":
            if tag in ("br", "hr"):
                open_.top.kids.append(" " if tag == "br" else Node(tag, open_.top))
            continue
        if tag == "body":
            while open_.top.parent is not None:
                open_.close(open_.top)
        elif open_.top.tag == "head" and tag in BLOCKS:
            open_.close(open_.top)
        if tag in CLOSES and (node := open_.outermost(CLOSES[tag])) is not None:
            open_.close(node)
        node = Node(tag, open_.top, is_noise(tag, attributes))
        node.parent.kids.append(node)
        if not empty or tag in BLOCKS:
            open_.push(node)
    spare_content(root)
    return root


def walk(root: Node) -> list[Node]:
    """All nodes, parents first."""
    out, i = [root], 0
    while i < len(out):
        out += [k for k in out[i].kids if isinstance(k, Node)]
        i += 1
    return out


def measure(root: Node) -> list[Node]:
    """All nodes with their densities; kept is what a node has of text outside noise."""
    nodes = walk(root)
    for n in reversed(nodes):
        kids = [k for k in n.kids if isinstance(k, Node)]
        own = sum(len(k.strip()) for k in n.kids if isinstance(k, str))
        n.chars = own + sum(k.chars for k in kids)
        n.kept = 0 if n.noise else own + sum(k.kept for k in kids)
        n.tags = sum(1 + k.tags for k in kids)
        link = n.tag == "a"
        n.link_chars = n.chars if link else sum(k.link_chars for k in kids)
        n.link_tags = n.tags + 1 if link else sum(k.link_tags for k in kids)
    body = next((n for n in nodes if n.tag == "body"), root)
    ratio = body.link_chars / body.chars if body.chars else 0.0
    for n in reversed(nodes):
        if not n.chars:
            n.density = 0.0
        else:
            tags, plain = max(n.tags, 1), max(n.chars - n.link_chars, 0)
            base = log(n.chars / max(plain, 1) * n.link_chars + ratio * n.chars + e)
            x = (n.chars / max(n.link_chars, 1)) * (tags / max(n.link_tags, 1))
            n.density = n.chars / tags * (log(x) / log(base) if x > 1 and base > 1 else 0.0)
        n.total = sum(k.density for k in n.kids if isinstance(k, Node) and not k.noise)
    return nodes


def densest(root: Node) -> Node:
    """The node of greatest sum in a subtree, outside noise; the first of equal ones."""
    best, stack = root, [root]
    while stack:
        n = stack.pop()
        if n.total > best.total:
            best = n
        stack += [k for k in reversed(n.kids) if isinstance(k, Node) and k.kept and not k.noise]
    return best


def raised(n: Node, top: Node | None) -> Node:
    """The <article> or <main> around a node, or what holds the same text, or the block of an inline; within top."""
    outer = n
    while outer is not None and not outer.main and outer is not top:
        outer = outer.parent
    if outer is not None and outer.main:
        return outer
    while n is not top and n.parent is not None and n.tag not in ("body", "html") and (n.tag not in BLOCKS or n.tag == "p" or n.parent.kept == n.kept):
        n = n.parent
    return n


def article(root: Node) -> list[Node]:
    """The subtrees that are the text, in order."""
    nodes = measure(root)
    if not root.kept:
        return []
    found = densest(root)
    path, node, least = set(), found, found.density
    while node is not None:
        path.add(node)
        if node.tag not in ("body", "html"):
            least = min(least, node.density)
        node = node.parent
    for n in nodes:
        if n.doubt and n not in path and n.density < DOUBT * least:
            n.noise = True
    best = raised(found, None)
    path, node = set(), best.parent
    while node is not None:
        path.add(node)
        node = node.parent
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        if n is best:
            out.append(n)
        elif n in path:
            stack += [k for k in reversed(n.kids) if isinstance(k, Node) and k.kept and not k.noise and (k is best or k in path or k.tag in BLOCKS)]
        elif n.density >= (HINT if n.main else 1.0) * least > 0:
            out.append(n if n.main else raised(densest(n), n))
        else:  # a wrapper of many tags may hold a dense block
            stack += [k for k in reversed(n.kids) if isinstance(k, Node) and k.kept and not k.noise and k.tag in BLOCKS]
    return out


def blocks(node: Node) -> list[str]:
    """Texts of the node's blocks, in order."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if text := SPACE.sub(" ", entities.unescape("".join(run))).strip():
            out.append(text)
        run.clear()

    stack: list = [iter(node.kids)]
    owners = [node]
    while stack:
        for k in stack[-1]:
            if isinstance(k, str):
                run.append(k)
            elif not k.noise:
                if k.tag in BLOCKS:
                    flush()
                stack.append(iter(k.kids))
                owners.append(k)
                break
        else:
            stack.pop()
            if owners.pop().tag in BLOCKS:
                flush()
    flush()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    return "\n\n".join(b for n in article(parse(page)) for b in blocks(n))


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns, text and n_chars (code points) for each row; a kept column of these names gives way to them. No shuffle."""
    keep = tuple(c for c in keep if c not in ("text", "n_chars"))
    names = [*keep, html_col]

    def run(batch):
        out = [main_text(h) for h in batch.column(len(keep)).to_pylist()]
        return {**{c: batch.column(i) for i, c in enumerate(keep)}, "text": out, "n_chars": [len(t) for t in out]}

    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return arrow_map(pages.select(*(F.col(c) for c in names)), run, f"{schema}, text string, n_chars long")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
