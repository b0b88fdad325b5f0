"""Main text of web pages by tree scoring.

A tolerant reader builds a tree of the page in one pass over it, whatever its depth. Scripts, styles, forms, menus,
headers and footers of the page do not count, nor do containers whose class, id or role names an advert, a cookie notice or the comments,
unless they hold the page's article or title. Every paragraph passes points - one, one more for each comma, one for each 100 characters up
to three - to its parent, and half as many to the one above; an element's score is what it got, times the share of its text that is not
links, more for `article`, `main` and what a title stands in, less where a name hints at something else. The best element wins. On the way up from it to the body,
of what stands beside it only siblings that score a fifth as much or hold paragraphs without many links, titles, headings right before something
kept and plain paragraphs are kept. Inside, what a name merely hints at goes only if it scores next to nothing; nothing is left out for its links alone.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanmill.llm.common import drop_clashing

#: Fixed values of HTML: elements without content, with raw content, that start a block, and that end an open p.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe svg math object canvas title textarea xmp noembed noframes".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend", "body", "html"}
#: An open element that a start tag closes, and the element beyond which it does not look.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Elements that never belong to the text; words in class, id or role that say so of a container, and those that only hint at it.
JUNK_TAGS = set("nav aside footer form button select fieldset menu dialog head".split())
JUNK_WORDS = set("ad ads advert adverts advertisement advertising adsense adslot comment comments consent cookie cookies disqus gdpr newsletter outbrain overlay popup promoted replies sidebar sidenav sponsored subscribe subscription taboola alertdialog complementary contentinfo".split())
HINTS = set("alert banner breadcrumb breadcrumbs disclaimer footer header masthead menu menubar modal nav navbar navigation notice notification pager pagination promo promotion recommendations recommended related reply respond search share sharing signup skip social sponsor toolbar widget widgets".split())
#: Those that say so of a single paragraph too.
ADVERTS = set("ad ads advert adverts advertisement advertising adsense adslot promoted sponsored outbrain taboola".split())
#: Elements that are the article, whatever they are called, and what shows that a container holds it.
FRAME, HOLDS = {"html", "body", "main"}, {"article", "main", "h1"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PARAGRAPHS = {"p", "pre", "blockquote", "li", "td", "dd"} | HEADINGS
#: Blocks that the end tag of an inline element does not close.
WALLS = set("td th table article main section div".split())
#: Elements beyond which an open p is not seen.
P_LIMITS = set("td th table button object caption".split())
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
PLAIN = re.compile(r"[^>\"']*")
ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}
#: A share of links that a plain paragraph has not; what a hinted element has to score to stay; the score of article and main as such, and of what an
#: h1 stands in; what a hint costs, and the least score of a sibling.
LINKS, HINT_LEAST, ARTICLE, TITLED, HINT_COST, SIBLING = 0.25, 1.5, 25.0, 5.0, 5.0, 10.0


class Node:
    """An element: `junk` never belongs to the text, `named` neither unless it holds the article, `hinted` only if it scores; `own`, `commas`:
    length and commas of the text that stands in it but in no block below; `scope`: open elements that a start tag may close."""

    __slots__ = ("chars", "children", "commas", "depth", "hinted", "holds", "inside", "junk", "links", "named", "own", "paragraphs", "parent", "points", "scope", "tag", "titled", "wall")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent = tag, parent
        self.children: list = []  # nodes and strings
        self.points, self.chars, self.links, self.own, self.commas, self.paragraphs = 0.0, 0, 0, 0, 0, 0
        self.junk = self.named = self.hinted = self.holds = self.titled = False
        self.depth = parent.depth + 1 if parent else 0
        self.inside = tag in ("article", "main") or parent is not None and parent.inside
        self.wall = self.depth if tag in WALLS or parent is None else parent.wall
        self.scope = _scope(tag, self, parent.scope if parent else {})


def _scope(tag: str, node: Node, above: dict) -> dict:
    """For "p" and the keys of CLOSES, the open element that such a start tag closes."""
    new = {}
    if tag == "p":
        new["p"] = node
    elif tag in P_LIMITS:
        new["p"] = None
    for key, (own, limit) in CLOSES.items():
        if tag in own:
            new[key] = node
        elif tag in limit:
            new[key] = None
    return above | new if any(above.get(k) is not v for k, v in new.items()) else above


def words_of(attrs: str) -> tuple[set, bool]:
    """The words in class, id and role; whether the element is hidden."""
    found, hidden = set(), False
    for name, a, b, c in ATTR.findall(attrs):
        name, value = name.lower(), entities.unescape(a or b or c)
        if name in ("class", "id", "role"):
            found.update(w.lower() for w in re.split(r"[^a-zA-Z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value)) if w)
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hidden = True
    return found, hidden


def judged(node: Node, attrs: str) -> None:
    """Sets junk, named and hinted."""
    if node.tag in JUNK_TAGS or node.tag == "header" and not node.inside:
        node.junk = True
    elif attrs and node.tag not in FRAME:
        found, node.junk = words_of(attrs)
        node.named = bool(found & (ADVERTS if node.tag in PARAGRAPHS else JUNK_WORDS))
        node.hinted = node.tag not in PARAGRAPHS and bool(found & HINTS)


def tokens(page: str) -> Iterator[tuple]:
    """(text, None, None) and (tag, attributes, whether it ends). Every character is looked at a bounded number of times: a
    quote that nothing closes, and all quotes once a tag could not be ended because of one, are characters like others."""
    at, size, quoting = 0, len(page), True
    last = {c: page.rfind(c) for c in ">\"'"}
    while at < size:
        lt = page.find("<", at)
        if lt < 0 or lt > last[">"]:
            rest = page.find("<!--", at)
            yield page[at : rest if rest >= 0 else size], None, None
            return
        m = NAME.match(page, lt)
        if m is None:
            if page.startswith("<!--", lt):
                ends = [page.find(e, lt + 2) for e in ("-->", "--!>")]
                stops = [e + n for e, n in zip(ends, (3, 4), strict=True) if e >= 0]
                end = min(stops, default=size)
            elif page[lt + 1 : lt + 2] in ("!", "?", "/"):
                end = page.index(">", lt) + 1
            else:  # a character
                yield page[at : lt + 1], None, None
                at = lt + 1
                continue
            if lt > at:
                yield page[at:lt], None, None
            at = end
            continue
        if lt > at:
            yield page[at:lt], None, None
        end = m.end()
        while quoting:
            end = PLAIN.match(page, end).end()
            c = page[end : end + 1]
            if c in ("", ">"):
                break
            close = page.find(c, end + 1) if end < last[c] else -1
            end = close + 1 if close >= 0 else end + 1
        if not quoting or end >= size:
            quoting, end = False, page.find(">", m.end())
        attrs = page[m.end() : end]
        at = end + 1
        tag = m[1].lower()
        starts = page[lt + 1] != "/"
        yield tag, attrs, not starts
        if starts and tag in RAW and not attrs.endswith("/"):
            stop = RAW_END[tag].search(page, at)
            at = stop.end() if stop else size


def tree(page: str) -> Node:
    """The page's elements; end tags that match nothing are passed over, missing ones are supplied."""
    root = Node("#root", None)
    path, open_ = [root], {}  # open elements, and the depths of those of a tag

    def close(depth: int) -> None:
        while len(path) > depth:
            open_[path.pop().tag].pop()

    def opened(tag: str) -> Node:
        node = Node(tag, path[-1])
        path[-1].children.append(node)
        return node

    for tag, attrs, ends in tokens(page):
        if attrs is None:
            path[-1].children.append(entities.unescape(tag))
        elif ends:
            depths = open_.get(tag)
            if depths and (tag in BLOCK or depths[-1] > path[-1].wall):
                close(depths[-1])
            elif tag == "p":
                opened("p")
        elif tag == "br":
            path[-1].children.append(" ")
        elif tag not in RAW and (tag not in VOID or tag == "hr"):
            if tag in ENDS_P and (p := path[-1].scope.get("p")):
                close(p.depth)
            if tag in CLOSES and (own := path[-1].scope.get(tag)):
                close(own.depth)
            if tag in HEADINGS and path[-1].tag in HEADINGS:
                close(path[-1].depth)
            if tag in ("html", "body") and open_.get(tag):
                continue
            node = opened(tag)
            judged(node, attrs)
            if tag != "hr" and (not attrs.endswith("/") or tag in BLOCK or tag in ("a", "b", "i", "span", "em", "strong")):
                open_.setdefault(tag, []).append(node.depth)
                path.append(node)
    return root


def measure(root: Node) -> list[Node]:
    """Sets junk by name, chars, links and points; the elements outside junk, parents first."""
    every, todo = [], [root]
    while todo:
        n = todo.pop()
        if not n.junk:
            every.append(n)
            todo += [c for c in reversed(n.children) if isinstance(c, Node)]
    for n in reversed(every):
        n.holds = n.holds or n.tag in HOLDS
        if n.parent and n.tag == "h1":
            n.parent.titled = True
        if n.parent and n.holds:
            n.parent.holds = True
        n.junk = n.named and not n.holds
    order, todo = [], [(root, root, False)]
    while todo:  # down: whose text is it, and is it in a link
        n, holder, linked = todo.pop()
        order.append(n)
        holder, linked = n if n.tag in BLOCK else holder, linked or n.tag == "a"
        for c in n.children:
            if isinstance(c, str):
                k = len(" ".join(c.split()))
                n.chars += k
                n.links += k if linked else 0
                holder.own += k
                holder.commas += c.count(",")
        todo += [(c, holder, linked) for c in reversed(n.children) if isinstance(c, Node) and not c.junk]
    for n in reversed(order):
        if n.parent:
            n.parent.chars += n.chars
            n.parent.links += n.links
    for n in order:
        if n.tag in HEADINGS or not n.own or n.tag not in BLOCK and n is not root:
            continue
        if n.tag in PARAGRAPHS:
            target, above = n.parent, n.parent.parent
            target.paragraphs += 1
        elif n.own < 25:
            continue
        else:  # text that stands in a container without a paragraph of its own
            target, above = n, n.parent
        points = 1 + n.commas + min(n.own / 100, 3)
        target.points += points
        if above is not None:
            above.points += points / 2
    for n in order:
        if n.hinted and not n.holds and content(n) < HINT_LEAST:
            n.junk = True
    return order


def inline(n: Node) -> str:
    out, todo = [], [n]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.junk:
            todo += reversed(x.children)
    return " ".join("".join(out).split())


def density(n: Node) -> float:
    return n.links / n.chars if n.chars else 0.0


def content(n: Node) -> float:
    return n.points * (1 - density(n))


def final(n: Node) -> float:
    """What the best element is told by."""
    own = content(n)
    return 0.0 if own <= 0 or n.junk else own + (ARTICLE if n.tag in ("article", "main") else 0.0) + (TITLED if n.titled else 0.0) - (HINT_COST if n.hinted else 0.0)


def blocks(n: Node) -> Iterator[str]:
    """The texts of n between block boundaries, white space made one blank."""
    out: list[str] = []
    todo: list = [n]
    while todo:
        x = todo.pop()
        if x is None:
            if text := " ".join("".join(out).split()):
                yield text
            out = []
        elif isinstance(x, str):
            out.append(x)
        elif not x.junk:
            if x.tag in BLOCK or x is n:
                todo += [None, *reversed(x.children), None]
            else:
                todo += reversed(x.children)
    if text := " ".join("".join(out).split()):
        yield text


def extract(page: str | None) -> str:
    """The main text of a page, its blocks in page order, one a line; empty if there is none."""
    if not page:
        return ""
    root = tree(page)
    order = measure(root)
    best = max(order, key=final)
    if final(best) <= 0:
        return "\n".join(blocks(root))
    limit, out = max(SIBLING, 0.2 * content(best)), deque(blocks(best))
    node = best
    while node.parent is not None and node.tag not in ("body", "html"):
        at = next(i for i, s in enumerate(node.parent.children) if s is node)
        before, after = siblings(node.parent.children[:at], limit, True), siblings(node.parent.children[at + 1 :], limit, False)
        out.extendleft(t for s in reversed(before) for t in reversed(list(blocks(s))))
        out.extend(t for s in after for t in blocks(s))
        node = node.parent
    return "\n".join(out)


def siblings(nodes: list, limit: float, leads: bool) -> list[Node]:
    """Those of some neighbours of the best element that belong to it; leads: whether it follows them."""
    kept, held = [], []  # held: headings that wait for what they are headings of
    for s in nodes:
        if not isinstance(s, Node) or s.junk or not s.chars:
            continue
        paragraph = s.tag == "p" and (s.chars > 80 and density(s) < LINKS or s.chars <= 80 and not s.links and inline(s).endswith((".", "!", "?")))
        if s.tag in HEADINGS and s.tag != "h1":
            held.append(s)
        elif s.tag == "h1" or paragraph or content(s) >= limit or s.paragraphs and not s.hinted and density(s) < LINKS:
            kept += [*held, s]
            held = []
        else:
            held = []
    return kept + held if leads else kept


def main_text(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """The columns of pages but html, with `text` and `n_chars` (long, code points). Null and empty html give
    an empty text. Rows are independent; clashing columns give way to the results."""
    pages = drop_clashing(pages, text, "n_chars")
    kept = [f for f in pages.schema.fields if f.name != html]
    schema = T.StructType([*kept, T.StructField(text, T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                texts = [extract(h) for h in b.column(b.schema.names.index(html)).to_pylist()]
                cols = [b.column(b.schema.names.index(f.name)) for f in kept]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*[f.name for f in kept], text, "n_chars"])

    return pages.mapInArrow(run, schema)


def report(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page: see main_text()."""
    return main_text(pages.select("page_id", "url", "html"))
