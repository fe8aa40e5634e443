"""HTML extraction by tree scoring.

A page is read into a light tree (raw text of scripts and styles and comments are skipped, an open paragraph ends where HTML
says it does). Paragraphs pass points for length and commas to their ancestors, less with distance, and each container's points
are discounted by its link density. The best container and its siblings with enough points, or of plain prose, are kept; an article or main
element around it is taken instead, and then only siblings with points count, and a title before it.

Inside them, menus, adverts, forms, notices and comments are left out: elements and roles that say so at once, others by the words of their
class and id. A word alone may mislead (a page about a notice board): an element that holds the page's title, or, for words that
are no sure sign, more than half of the page's text outside links, stays. So does a form whose blocks hold more than half of the page's text: it is
wrapped around the page, and only its controls and labels go. What no name tells is judged by structure: blocks of links, signed replies
after the text, and boxes of a line or two beside paragraphs.

Every step is linear in the page: tags are found by one scan, and what is open is looked up by tag.

Defined cases: null or empty html gives the empty text; a page without paragraphs gives the blocks of its body; unclosed comments and
scripts end with the page, and a last tag without its end is text; other columns pass through untouched.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OPENS = re.compile(r"<(?=[a-zA-Z/!?])")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_CUT = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|/|$)")
# Fixed values of HTML: elements without an end tag, elements with raw text, elements that make a block, and those before which
# an open paragraph ends.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split())
CELL = frozenset(("td", "th", "option"))
# What never belongs to the article's text, by element, by role and by words of class and id.
DROPPED = frozenset("nav footer aside script style head noscript template iframe svg button select textarea input object dialog menu canvas audio video search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
# Words of class and id of what is no article: sure signs, and signs that the page's text outweighs.
STRONG = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsored sidebar nav navbar navigation breadcrumb breadcrumbs footer comment comments commentlist respond disqus cookie cookies consent gdpr".split()
)
WEAK = frozenset(
    "disclaimer sponsor sponsors promo promos promotion promotions banner banners menu menus notice notices popup modal newsletter subscribe signup login share sharing social related recommended recommendations widget widgets toolbar pagination pager hidden".split()
)
HEADS = frozenset("header masthead topbar".split())
HEAD_OF = frozenset("site page top main global".split())
# after these a name tells of the page's layout, not of the element; and these after it tell of a setting
WITH, SETTING = frozenset("has with no without is".split()), frozenset("open closed enabled disabled layout page".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
PARAGRAPHS = frozenset(("p", "pre", "blockquote", "li", "dd", "td", "div", "section", "article", "main"))
#: Elements of an article that are kept as siblings of the best container whatever their points, if they are no list of links.
BESIDE = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6 table ul ol dl figure".split())
#: Shares of the best container's points: of a sibling that is kept, of a parent that is taken instead (its points come from
#: more than one child then), and the share of links from which a sibling is navigation.
SIBLING, PARENT, LINKS = 0.1, 0.6, 0.3
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Parts of a form that are no text; shares of a page's text: a named block of links, of replies, of a line or two beside paragraphs.
LABELS = frozenset(("label", "legend", "option", "datalist"))
LINK_BLOCK, REPLIES, BOX_CHARS = 0.6, 0.5, 120
_PROSE = re.compile(r"(?:\S+\s+){3,}\S*[.!?…。][\"'”’)]*$")
_RIGHTS = re.compile(r"^\W*(?:©|\(c\)|copyright\b)|all rights reserved", re.I)


class Node:
    __slots__ = ("tag", "parent", "items", "dropped", "inside", "doubt", "titled", "points", "chars", "linked", "names")

    def __init__(self, tag: str, parent: Node | None) -> None:
        self.tag, self.parent = tag, parent
        self.items: list[Node | str] = []
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))
        self.dropped = self.titled = False
        self.doubt = 0  # 1: its names are a sign of what is no article, 2: a sure one
        self.points = 0.0
        self.chars = self.linked = 0
        self.names = ""


def doubtful(names: str) -> int:
    """2 if a class or id has a word of STRONG, 1 if one of WEAK, else 0."""
    found = 0
    for token in names.split():
        words = [w.lower() for part in re.split(r"[^a-zA-Z]+", token) for w in ([part] if part.lower() in STRONG or part.lower() in WEAK else _WORDS.findall(part))]
        for i, w in enumerate(words):
            if w in WITH:
                break
            if i + 1 < len(words) and words[i + 1] in SETTING:
                continue
            found = max(found, 2 if w in STRONG else 1 if w in WEAK else 0)
    return found


def _heads(names: str) -> bool:
    """A class or id of the head of a site or page, as header, site-header or top_bar."""
    for token in names.lower().split():
        words = re.split(r"[_-]", token)
        if words[-1] in HEADS and (len(words) == 1 or (len(words) == 2 and words[0] in HEAD_OF)):
            return True
    return False


def _judge(node: Node, attributes: str) -> None:
    """Sets whether an element is dropped whatever it holds, and what its names say."""
    if node.tag in DROPPED or (node.tag == "header" and not node.inside):
        node.dropped = True
        return
    if node.tag == "form":
        node.doubt = 3
    if "=" not in attributes and "hidden" not in attributes:
        return
    values = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
    if values.get("role", "").lower() in ROLES or _HIDES.search(values.get("style", "")) or values.get("aria-hidden") == "true" or _HIDDEN.search(_ATTRIBUTE.sub("", attributes)):
        node.dropped = True
    elif node.tag not in ("html", "body", "main") and not (node.tag == "article" and not node.inside and node.parent.doubt < 2):
        node.names = names = f"{values.get('class', '')} {values.get('id', '')}".strip()
        node.doubt = max(node.doubt, doubtful(names))
        node.dropped = not node.inside and _heads(names)


def parse(page: str) -> Node:
    root = Node("html", None)
    stack = [root]
    places: dict[str, list[int]] = {}  # of each open tag, of all blocks and of all cells: where on the stack
    blocks: list[int] = []
    cells: list[int] = []
    at, last = 0, page.rfind(">")

    def close(i: int) -> None:
        """Ends what is open from place i on."""
        while len(stack) > i:
            node = stack.pop()
            places[node.tag].pop()
            for kind in (blocks, cells):
                if kind and kind[-1] >= len(stack):
                    kind.pop()

    while True:
        m = _OPENS.search(page, at)
        while m and page[m.start() + 1] not in "!?" and m.start() > last:
            m = None  # no tag ends any more
        text = page[at : m.start()] if m else page[at:]
        if text:
            stack[-1].items.append(text)
        if not m:
            return root
        start = m.start()
        if page[start + 1] in "!?":
            comment = page.startswith("<!--", start)
            end = page.find("-->" if comment else ">", start + 4 if comment else start + 1)
            if end < 0:
                return root
            at = end + (3 if comment else 1)
            continue
        m = _TAG.match(page, start) or _CUT.match(page, start)  # a quote that never closes ends with the tag
        if not m:
            stack[-1].items.append("<")
            at = start + 1
            continue
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            if places.get(tag) and not (cells and cells[-1] > places[tag][-1] and tag not in ("tr", "table", "tbody", "thead", "tfoot")):
                close(places[tag][-1])
            continue
        if tag == "html" and len(stack) <= 1:
            continue
        if (tag in BLOCK or tag in CELL) and blocks:
            ends = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": CELL, "th": CELL, "option": CELL}.get(tag, ())
            name = stack[blocks[-1]].tag
            if name in ends or (name == "p" and tag not in CELL):
                close(blocks[-1])
        node = Node(tag, stack[-1])
        if stack[-1].dropped:
            node.dropped = True
        else:
            _judge(node, m[3] or "")
        stack[-1].items.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*+[^>]*+>", re.I).search(page, at)
            if not node.dropped and tag not in ("script", "style", "title"):
                node.items.append(page[at : end.start()] if end else page[at:])
            at = end.end() if end else len(page)
        elif tag not in VOID and not (m[3] or "").endswith("/"):
            places.setdefault(tag, []).append(len(stack))
            if tag in BLOCK or tag in CELL:
                blocks.append(len(stack))
                if tag in CELL:
                    cells.append(len(stack))
            stack.append(node)


def _in_order(root: Node) -> list[Node]:
    """What is not dropped, parents first; dropped is passed on to all below."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        for x in node.items:
            if isinstance(x, Node) and not x.dropped:
                todo.append(x)
    return out


def _settle(root: Node) -> None:
    """Drops the elements whose names say so and whose place and text do not say otherwise."""
    order = _in_order(root)
    if not any(n.doubt for n in order):
        return
    links = {id(root): False}
    plain: dict[int, int] = {}  # characters outside links
    whole: dict[int, int] = {}
    blocks: dict[int, int] = {}  # characters outside links in blocks: what a form says besides its controls
    bare = {id(root): False}  # whether a node's text stands right in a form, or is a label
    for n in order:
        link = links[id(n)] or n.tag == "a"
        bare[id(n)] = n.tag == "form" or n.tag in LABELS or (bare.get(id(n.parent), False) and (n.tag not in BLOCK and n.tag not in CELL or n.parent.tag in LABELS))
        size = sum(len(x.strip()) for x in n.items if isinstance(x, str))
        whole[id(n)], plain[id(n)] = size, 0 if link else size
        blocks[id(n)] = 0 if link or bare[id(n)] else size
        n.titled = n.tag in ("h1", "main")
        for x in n.items:
            if isinstance(x, Node) and not x.dropped:
                links[id(x)] = link
    for n in reversed(order):
        if n.parent is not None:
            for sums in (plain, whole, blocks):
                sums[id(n.parent)] += sums[id(n)]
            n.parent.titled = n.parent.titled or n.titled
    total = plain[id(root)]
    for n in order:
        if n.doubt == 3:  # a page inside a form keeps its text, of which the form's labels are none
            n.dropped = not 2 * blocks[id(n)] > total
        elif n.doubt:
            most = 2 * plain[id(n)] > total
            prose = plain[id(n)] > (1 - LINKS) * whole[id(n)]
            n.dropped = not (n.titled or (n.doubt == 1 and most and prose))
        if n.tag in LABELS and _in_form(n):
            n.dropped = True


def _in_form(node: Node) -> bool:
    while node is not None and node.tag != "form":
        node = node.parent
    return node is not None


def _set_aside(best: Node) -> None:
    """Drops, inside the best container, what its structure says is no text of the article: named blocks that are mostly links, replies (items of
    one kind after the article's text, each signed, none with a heading), and named boxes of a line or two beside paragraphs."""
    order = _in_order(best)
    if best.chars <= 0:
        return
    told = 0  # characters before the block, outside links
    counts: dict[int, list[int]] = {}
    for n in reversed(order):
        own = counts.setdefault(id(n), [0, 0, 0])  # links, headings, paragraphs
        own[0] += n.tag == "a"
        own[1] += n.tag in HEADINGS
        own[2] += n.tag in BESIDE or n.tag in ("li", "img", "br")
        if n is not best:
            above = counts.setdefault(id(n.parent), [0, 0, 0])
            for k in range(3):
                above[k] += own[k]
    todo = [best]
    while todo:  # in page order
        n = todo.pop()
        if isinstance(n, str):
            told += len(n.strip())
            continue
        if n.dropped:
            continue
        links, heads, paragraphs = counts.get(id(n), (0, 0, 0))
        if n is not best and n.tag in ("div", "section", "ul", "ol", "table", "ins") and n.chars and 2 * n.chars < best.chars:
            linked = n.names and links > 1 and n.linked >= LINK_BLOCK * n.chars and not heads
            box = n.names and n.tag in ("div", "section", "ins") and not paragraphs and n.chars <= BOX_CHARS and told and not _PROSE.search(" ".join(_blocks([n])))
            if linked or box or (told > (1 - REPLIES) * (best.chars - best.linked) and _replies(n, counts)):
                n.dropped = True
                continue
        todo += reversed(n.items)


def _replies(node: Node, counts: dict[int, list[int]]) -> bool:
    """Two or more items alike in tag and name, each with a short signed part and a text, and no heading or picture in any."""
    items = [x for x in node.items if isinstance(x, Node) and not x.dropped and x.chars]
    kinds: dict[tuple[str, str], list[Node]] = {}
    for x in items:
        if x.tag in ("div", "article", "section", "li") and (x.names or x.tag != "div"):
            kinds.setdefault((x.tag, x.names), []).append(x)
    most = max(kinds.values(), key=len, default=[])
    if len(most) < 2 or 2 * sum(x.chars for x in most) < node.chars:
        return False
    for x in most:
        parts = [y for y in x.items if isinstance(y, Node) and y.chars]
        signed = any(y.tag in ("span", "div", "b", "strong", "cite", "time", "a", "small", "header", "h5", "h6", "p") and y.chars <= 60 and (y.names or y.tag in ("b", "strong", "cite", "time", "a", "small")) for y in parts)
        if counts[id(x)][1] or len(parts) < 2 or not signed or not any(y.tag in ("p", "div", "blockquote", "span") and y.chars > 0 for y in parts[1:]):
            return False
    return True


def _clean(pieces: list[str]) -> str:
    return " ".join(html.unescape("".join(pieces)).split())


def _blocks(nodes: list[Node]) -> list[str]:
    """Texts of the blocks under nodes, in page order."""
    out: list[str] = []
    pieces: list[str] = []

    def end() -> None:
        if pieces and (text := _clean(pieces)):
            out.append(text)
        pieces.clear()

    todo: list[tuple[Node | str, bool]] = [(n, False) for n in reversed(nodes)]
    while todo:
        item, closes = todo.pop()
        if isinstance(item, str):
            pieces.append(item)
            continue
        if closes or item.tag in BLOCK:
            end()
        if closes or item.dropped:
            continue
        if item.tag == "br" or item.tag in CELL:
            pieces.append(" ")
        if item.tag in BLOCK:
            todo.append((item, True))
        elif item.tag in CELL:
            todo.append((" ", False))
        todo += [(x, False) for x in reversed(item.items)]
    end()
    return out


def _score(root: Node) -> list[Node]:
    """Gives containers their points; the nodes that have any."""
    order, todo = [], [(root, False)]
    while todo:
        node, link = todo.pop()
        if node.dropped:
            continue
        order.append(node)
        link = link or node.tag == "a"
        own: list[str] = []
        inner = [node]
        for x in node.items:
            if isinstance(x, str):
                node.chars += len(x.strip())
                node.linked += len(x.strip()) * link
            else:
                todo.append((x, link))
        if node.tag in PARAGRAPHS:  # its text up to the next block
            while inner:
                for x in inner.pop().items:
                    if isinstance(x, str):
                        own.append(x)
                    elif x.tag not in BLOCK and x.tag not in CELL and not x.dropped and x.tag != "a":
                        inner.append(x)
            text = "".join(own).strip()
            if text:
                points, share, above = min(len(text) / 100, 3) + text.count(",") + 1, 1.0, node.parent if node.tag not in ("div", "section", "article", "main") else node
                for _ in range(3):
                    if above is None:
                        break
                    above.points += points * share
                    share, above = share / 2, above.parent
    for node in reversed(order):
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
    scored = [n for n in order if n.points > 0]
    for n in scored:
        n.points *= 1 - min(1.0, n.linked / max(1, n.chars))
    return scored


def _beside(best: Node, around: bool) -> list[Node]:
    """The best container with the siblings that belong to it. Around says that it is the page's article or main element."""
    level = SIBLING * best.points
    siblings = [x for x in best.parent.items if isinstance(x, Node)]
    place = next(i for i, x in enumerate(siblings) if x is best)
    keep = []
    for i, x in enumerate(siblings):
        if x is best:
            keep.append(True)
        elif x.dropped or x.linked >= LINKS * max(1, x.chars):
            keep.append(False)
        elif around:
            keep.append((x.tag == "h1" and i < place) or (x.points >= level and x.points > 0 and x.tag not in ("article",)))
        else:
            text = " ".join(_blocks([x]))
            keep.append(not _RIGHTS.search(text) and (x.tag in BESIDE or x.points >= level or bool(_PROSE.search(text))))
    # a heading after the best container belongs to what follows it
    for i in range(len(siblings) - 1, place, -1):
        if siblings[i].tag in HEADINGS and not (i + 1 < len(siblings) and keep[i + 1]):
            keep[i] = False
    return [x for x, k in zip(siblings, keep) if k]


def main_text(page: str) -> str:
    root = parse(page)
    _settle(root)
    scored = _score(root)
    best = max(scored, key=lambda n: n.points, default=root)  # of equals, the first in the page
    around = best
    while around is not None and around.tag not in ("article", "main"):
        around = around.parent
    best = around or best
    while best.parent is not None and best.tag in ("p", "span", "b", "i", "em", "strong", "font"):
        best = best.parent
    while not around and best.parent is not None and best.parent.tag not in ("body", "html") and best.parent.points >= PARENT * best.points:
        best = best.parent
    _set_aside(best)
    kept = _beside(best, around is not None) if best.parent is not None and best.tag not in ("body", "html") else [best]
    return "\n".join(_blocks(kept))


def extract(pages: DataFrame, column: str = "text") -> DataFrame:
    """pages with a column (one of that name is replaced) of the main text of each whole html."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(h) if h else "" for h in batch], dtype=object)

    return pages.withColumn(column, text(F.coalesce("html", F.lit(""))))
