"""Main text of web pages by scoring the tree of their elements.

Paragraph-like blocks earn points for their length and commas. They pass the points to their ancestors, less at each
level, discounted by the share of their text that is in links. The best container is kept with what stands beside it and
is not mostly links, and so on up the tree while the rest of the parent's text is mostly unlinked. Elements that are never content (menus, forms, scripts, and so on) are left out first. Those that only
have a name of such content are left out too, unless the page's article or a large share of its prose lies inside; where the name
also has a topic, little linked text in the midst of an article wins it back. Nothing within a line is left out by its name.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

# A tag whose quotes never close ends at its first ">".
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?=>|\Z)|[^>]*)(?:>|\Z)", re.S)
NAME = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
SPACE = re.compile(r"\s+")

# Elements by what they are in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg xmp".split())
DROPPED = RAW | frozenset("nav footer aside form button select option fieldset dialog menu canvas audio video annotation annotation-xml".split())
BLOCKS = frozenset(
    "address article blockquote body caption center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 header hr html li "
    "main ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p pre td blockquote dd li figcaption h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCKS - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
UNLIKELY = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu "
    "breadcrumb breadcrumbs header masthead footer sidebar aside widget notice notices cookie cookies consent gdpr popup modal "
    "overlay alert comment comments disqus respond reply replies related share sharing social subscribe subscription newsletter "
    "signup login search pagination pager toolbar skip banner complementary contentinfo form feedback".split()
)
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
# What names are put together with: such a word says where a thing stands or how it is built, and nothing of what it is about.
BUILD = frozenset(
    "area bar block body bottom box button buttons col column container content cta entry float foot footer global group head header icon icons inner item label "
    "left link links list main mobile module outer page panel post posts primary right row secondary section side site slot sticky sub tag text thread "
    "title top unit view wrap wrapper zone".split()
)
# Names that start or end so tell of the page, not of the element; the header of such a thing holds its title.
FLAGS = frozenset("has no not with without".split())
PAGES = frozenset("page layout template enabled disabled".split())
TITLED = frozenset("post entry article story content section".split())
READERS = frozenset("comment comments disqus respond reply replies feedback".split())
WRAPS = frozenset("wrap wrapper container content".split())
SURE, UNSURE, TOPIC = "sure", "unsure", "topic"
"""Doubts by name: the name says only what is never content (or what readers write), or says how that is built besides, or names something to write about."""
INTRO = 10
"""Unlinked characters of a paragraph beside the article that keep it whatever its links."""
NEIGHBOUR = 80
"""Characters of a paragraph beside which an element with a topic in its name may stand in the article."""
LEAST_PROSE = {SURE: 0.8, UNSURE: 0.5}
"""Share of the page's unlinked text in paragraphs that keeps an element in doubt; a sure one must hold all unlinked first headings too."""
LEAST_ARTICLE = 0.1
"""Share of that text below which an article element without a first heading does not keep what is around it."""
DOUBTED = 0.5
"""Factor of the points of what is kept for its share of the prose only."""
START = {"article": 25.0, "main": 25.0, "div": 5.0, "section": 3.0, "td": 3.0, "blockquote": 3.0, "pre": 3.0}


class Node:
    __slots__ = ("anchor", "children", "doubt", "factor", "links", "name", "parent", "score", "size", "unlikely")

    def __init__(self, name: str, parent: Node | None, unlikely: bool = False, doubt: str = "", anchor: str = "") -> None:
        self.name, self.parent, self.unlikely, self.doubt, self.anchor = name, parent, unlikely, doubt, anchor
        self.factor = 1.0
        self.children: list[Node | str] = []
        self.score = START.get(name, 0.0)
        self.size = self.links = 0


def _unlikely(name: str, attributes: str) -> bool:
    return name in DROPPED or bool(HIDDEN.search(attributes))


def _doubt(name: str, attributes: str, in_article: bool) -> tuple[str, str]:
    """What the element's names say against it, and its id if that alone speaks so. An article or main element in doubt is one of many, such as a comment.

    Headings and what stands within a line are never in doubt, and the ids of paragraphs and the like are places to link to.
    """
    if name in ("html", "body") or name in HEADINGS or name in INLINE:
        return "", ""
    if name == "header":  # a header inside an article holds its title
        return ("" if in_article else UNSURE), ""
    found = anchor = ""
    for m in NAME.finditer(attributes) if attributes else ():
        kind, value = m[1].lower(), m[2].lower().strip("\"'")
        if kind == "id" and name in PARAGRAPHS:
            continue
        for one in value.split():
            words = [part for w in re.split(r"[^a-z]+", one) if w for part in _parted(w)]
            bad = UNLIKELY.intersection(words)
            if not bad or words[0] in FLAGS or words[-1] in PAGES or (bad == {"header"} and not TITLED.isdisjoint(words)):
                continue
            anchor = value if kind == "id" and not found and READERS.isdisjoint(words) else ""
            if bad.issuperset(words) or (not READERS.isdisjoint(words) and WRAPS.isdisjoint(words)):
                found = SURE
                if not anchor:
                    return SURE, ""
            topic = not (set(words) <= UNLIKELY | BUILD)
            found = found if found in (SURE, UNSURE) else TOPIC if topic else UNSURE
    return found, anchor


@cache
def _parted(word: str) -> tuple[str, ...]:
    """A joined name such as commentlist or sidenav as its two words, of which one is of those never content; other words whole."""
    if word not in UNLIKELY:
        for i in range(2, len(word) - 1):
            parts = word[:i], word[i:]
            if (parts[0] in UNLIKELY and parts[1] in BUILD) or (parts[0] in BUILD and parts[1] in UNLIKELY):
                return parts
    return (word,)


def _plain(text: str) -> str:
    return "".join(c for c in text.lower() if c.isalnum())


def _clear_sections(root: Node) -> None:
    """Takes the doubt from elements of an article whose names speak against them, if most of their text is unlinked.

    These are sections whose id is their first heading's text, and elements with a topic in their name that stand in an article
    element or beside a paragraph of ``NEIGHBOUR`` characters. Any other with a topic is as unsure as the rest.
    """
    order, todo = [], [(root, False)]
    while todo:
        node, inside = todo.pop()
        if not node.unlikely:
            order.append((node, inside))
            inside = inside or (node.name in ("article", "main") and not node.doubt)
            todo += [(c, inside) for c in node.children if isinstance(c, Node)]
    if not any(n.anchor or n.doubt == TOPIC for n, _ in order):
        return
    held: dict[int, tuple[str | None, int, int]] = {}  # by node: first heading, size, size of links
    for node, _ in reversed(order):
        heading, size, links = (_own_text(node) if node.name in HEADINGS else None), 0, 0
        for c in node.children:
            if isinstance(c, str):
                size += len(c.strip())
            elif not c.unlikely:
                first, n, linked = held[id(c)]
                heading, size, links = first if heading is None else heading, size + n, links + linked
        held[id(node)] = heading, size, size if node.name == "a" else links
        if node.anchor and heading is not None and _plain(heading) == _plain(node.anchor) and 2 * links < size:
            node.doubt = ""
    beside = {id(n.parent) for n, _ in order if n.name == "p" and held[id(n)][1] - held[id(n)][2] >= NEIGHBOUR}
    for node, inside in order:
        if node.doubt == TOPIC:
            _, size, links = held[id(node)]
            node.doubt = "" if 2 * links < size and (inside or id(node.parent) in beside) else UNSURE


# Items that end the item before them, and what bounds the search for an open one.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th")}
LISTS = ("ul", "ol", "dl", "table")
BOXES = ("td", "th", "li", "div", "section", "article", "main")


def parse(page: str) -> Node:
    """The tree of a page. Unclosed elements end with their parents, stray end tags are ignored.

    ``within`` counts the open elements by name, so that no search goes up the tree in vain.
    """
    root = node = Node("html", None)
    within: Counter = Counter()
    at = 0

    def leave(upto: Node) -> Node:
        """Closes elements until ``upto`` is the innermost open one."""
        here = node
        while here is not upto:
            within[here.name] -= 1
            here = here.parent
        return upto

    while at < len(page):
        m = TOKEN.search(page, at)
        if m is None:
            node.children.append(page[at:])
            break
        if m.start() > at:
            node.children.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name, attributes = m[2].lower(), m[3] or ""
        if m[1]:
            if within[name]:
                up = node
                while up.name != name:
                    up = up.parent
                node = leave(up.parent)
            continue
        if name in ("html", "head", "body"):  # what a head holds is void or dropped, and text ends it
            continue
        # A new block ends an open paragraph, a new item the one before.
        ends = (("p",) if name in CLOSES_P else ()) + SIBLINGS.get(name, ())
        if any(within[e] for e in ends):
            stops, up, last = (BOXES if name == "p" else LISTS), node, None
            while up is not None and up.name not in stops:
                if up.name in ends:
                    last = up
                up = up.parent
            if last is not None:
                node = leave(last.parent)
        child = Node(name, node, _unlikely(name, attributes), *_doubt(name, attributes, within["article"] + within["main"] > 0))
        node.children.append(child)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif name not in VOID and (name in BLOCKS or not attributes.rstrip().endswith("/")):
            node = child  # "/>" means nothing on a block
            within[name] += 1
    return root


def _settle(root: Node) -> None:
    """Makes the elements in doubt unlikely, but for those that hold the article or so much of the page's prose as to be a wrapper.

    The article is each ``article`` or ``main`` element with the fewest elements in doubt around it. A header stays that
    holds all first headings of the page, unlinked. Other elements kept for their prose keep it at ``DOUBTED`` of its points.
    """
    _clear_sections(root)
    order, todo = [], [(root, 0, False, False)]
    any_doubt = False
    while todo:
        node, depth, prose, linked = todo.pop()
        if node.unlikely:
            continue
        order.append((node, depth, prose, linked))
        if node.doubt and node.name not in ("article", "main"):
            any_doubt, depth = True, depth + 1
        prose, linked = prose or node.name in PARAGRAPHS, linked or node.name == "a"
        todo += [(c, depth, prose, linked) for c in node.children if isinstance(c, Node)]
    if not any_doubt:
        return
    # By node: characters of unlinked paragraphs, unlinked first headings, all first headings, article elements, main elements.
    held: dict[int, list[int]] = {id(n): [0] * 5 for n, *_ in order}
    least = {k: min((d for n, d, *_ in order if n.name == k and not n.doubt), default=0) for k in ("article", "main")}
    for node, depth, prose, linked in reversed(order):
        own = held[id(node)]
        text = sum(len(c.strip()) for c in node.children if isinstance(c, str))
        inside = prose or node.name in PARAGRAPHS
        own[0] += text * (inside and not linked and node.name != "a")
        if node.name == "h1":
            links = sum(_linked(c) for c in node.children if isinstance(c, Node))
            own[1] += links == 0
            own[2] += 1
        for k, name in ((3, "article"), (4, "main")):
            own[k] += node.name == name and not node.doubt and depth == least[name]
        if node.parent is not None:
            up = held[id(node.parent)]
            for k, x in enumerate(own):
                up[k] += x
    total = held[id(root)]
    for node, *_ in order:
        if not node.doubt or node.name in ("article", "main"):
            continue
        text, titles, _, articles, mains = held[id(node)]
        if mains or (articles and node.doubt == UNSURE and (titles or text >= LEAST_ARTICLE * total[0])):
            continue
        if node.name == "header" and titles and titles == total[2]:
            continue
        if total[0] and text >= LEAST_PROSE[node.doubt] * total[0] and (node.doubt == UNSURE or titles == total[1]):
            node.factor = 1.0 if articles else DOUBTED
        else:
            node.unlikely = True


def _linked(root: Node) -> int:
    """Number of link elements with the node at their top."""
    found, todo = 0, [root]
    while todo:
        node = todo.pop()
        found += node.name == "a"
        todo += [c for c in node.children if isinstance(c, Node)]
    return found


def _measure(root: Node) -> list[Node]:
    """Sets the sizes of text and of linked text; returns the kept nodes, children before parents."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.unlikely:
            continue
        order.append(node)
        todo += [c for c in node.children if isinstance(c, Node)]
    for node in order:  # parents before children
        node.factor *= node.parent.factor if node.parent is not None else 1.0
        node.score *= node.factor
    order.reverse()
    for node in order:
        for c in node.children:
            if isinstance(c, str):
                node.size += len(c.strip())
            elif not c.unlikely:
                node.size += c.size
                node.links += c.size if c.name == "a" else c.links
    return order


def _own_text(node: Node) -> str:
    """Text of the block itself, without that of blocks inside it."""
    out, todo = [], list(reversed(node.children))
    while todo:
        c = todo.pop()
        if isinstance(c, str):
            out.append(c)
        elif not c.unlikely and c.name not in BLOCKS:
            todo += reversed(c.children)
    return "".join(out)


def _score(order: list[Node]) -> dict[int, Node]:
    """Passes the points of each paragraph to its ancestors; returns the nodes that got some."""
    holders: dict[int, Node] = {}
    for node in order:
        if node.name not in PARAGRAPHS and node.name not in ("div", "section", "article", "main", "html"):
            continue
        own = SPACE.sub(" ", _own_text(node)).strip()
        if not own:
            continue
        points = (1 + own.count(",") + own.count("，") + min(len(own) / 100, 3)) * (1 - node.links / max(node.size, 1)) * node.factor
        up, share = (node.parent if node.name in PARAGRAPHS else node), 1.0
        while up is not None and share > 0.1:
            up.score += points * share
            holders[id(up)] = up
            up, share = up.parent, share / 2
    return holders


def _density(node: Node) -> float:
    return node.links / max(node.size, 1)


def _chosen(root: Node) -> list[Node | str]:
    _settle(root)
    order = _measure(root)
    holders = _score(order)
    if not holders:
        return [root]
    place = {id(n): i for i, n in enumerate(order)}
    # Ties: the outermost, which comes last.
    best = max(holders.values(), key=lambda n: (n.score * (1 - _density(n)), place[id(n)]))
    if best.parent is None:
        return [best]
    # Inside an article or main element, all of it is the article.
    up = best
    while up is not None and up.name not in ("article", "main"):
        up = up.parent
    if up is None:
        return _climbed(best)
    best = up
    if best.parent is None:
        return [best]
    least = max(10.0, best.score * 0.2)
    kept = []
    for c in best.parent.children:
        if not isinstance(c, Node) or c.unlikely:
            continue
        near = c.score * (1 - _density(c)) >= least
        prose = c.name == "p" and _density(c) < 0.25 and (c.size > 80 or (c.links == 0 and "." in _own_text(c)))
        if c is best or near or prose:
            kept.append(c)
    return kept


def _climbed(best: Node) -> list[Node | str]:
    """The best container with all texts and unlinked siblings, then those of its parent, as far as the rest of the parent is mostly unlinked.

    Siblings that score near it stay whatever their links, and so does a first heading below the top, which often links to its own page.
    """
    least = max(10.0, best.score * 0.2)
    before, after, node = [], [], best
    while (parent := node.parent) is not None:
        sides: tuple[list, list] = ([], [])
        passed = 0
        for c in parent.children:
            if c is node:
                passed = 1
            elif isinstance(c, str):
                sides[passed].append(c)
            elif not c.unlikely and c.factor >= node.factor:
                title = c.name == "h1" and parent.parent is not None
                linked = c.size if c.name == "a" else c.links
                intro = c.name == "p" and c.size - linked >= INTRO and "." in _own_text(c)
                if 2 * linked < max(c.size, 1) or title or intro or c.score * (1 - _density(c)) >= least:
                    sides[passed].append(c)
        before += [Node("hr", None), *reversed(sides[0])]
        after += [*sides[1], Node("hr", None)]
        rest, links = parent.size - node.size, parent.links - node.links
        if 2 * links >= max(rest, 1):
            break
        node = parent
    return [*reversed(before), best, *after]


def _blocks(nodes: list[Node | str]) -> list[str]:
    """Texts of the blocks in page order, white space made single spaces."""
    found: list[list[str]] = [[]]
    END = object()
    todo: list = list(reversed(nodes))
    while todo:
        c = todo.pop()
        if c is END:
            found.append([])
        elif isinstance(c, str):
            found[-1].append(c)
        elif not c.unlikely:
            if c.name == "br":
                found[-1].append(" ")
            block = c.name in BLOCKS
            if block:
                found.append([])
                todo.append(END)
            todo += reversed(c.children)
    texts = (SPACE.sub(" ", entities.unescape("".join(parts))).strip() for parts in found if parts)
    return [t for t in texts if t]


def main_text(page: str | None) -> str:
    """Main text of one page, one line a block; empty for a null or empty page."""
    return "\n".join(_blocks(_chosen(parse(page)))) if page else ""


def extract(pages: DataFrame, html: str = "html", keys: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """(keys, text, n_chars): the main text of every page from its whole html.

    A null or empty page gives an empty text. Long pages are read whole, in time in proportion to their length. Repeated rows
    have a row each; columns besides the keys are not carried, whatever their names. Buttons, and what stands in a canvas,
    audio or video for browsers without it, are not text of the article.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p) for p in batch.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keys)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                [*keys, "text", "n_chars"],
            )

    fields = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keys)
    return pages.select(*keys, html).mapInArrow(run, f"{fields}, text string, n_chars long")
