"""Main text of web pages by composite text density.

Every element of a page gets a density: characters per tag, adjusted for the share
of its characters and tags that are in links.  The densities of an element's
children are summed; the element with the greatest sum is where the article is.
The least density on the path from the body to it is the threshold that its
neighbours must reach to count as parts of the same article; an article or main
element on that path bounds where they are looked for.  Elements that are menus,
asides or forms by tag or role never count, and those that name themselves as such,
as notices, adverts or comments count only where their density shows them to be the
article or around it.

Pages are worked on one by one inside a partition; nothing is shuffled.
"""

from __future__ import annotations

import html
import math
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas select".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Blocks that hold text rather than parts of a page.
TEXTS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Those that are never where the article is, but parts of it.
PARTS = TEXTS - {"table"} | {"li", "dt", "dd"}
#: Those that may be menus; the others stay in an article even if they are a link.
LISTS = frozenset("ul ol dl table".split())
#: Elements that an opening tag of the kind closes, up to the elements that bound the search.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)), "body": (("head",), ("html",)),
}
#: Never part of an article.
DROPPED = frozenset("nav footer aside form dialog menu button head".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of class and id that mark what is not the article.
DROPPED_WORDS = frozenset(
    "ad ads adv advert advertisement adverts advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments respond disqus pagination pager widget toolbar skip copyright".split()
)
#: Words that leave the meaning of those beside them.
PLAIN_WORDS = frozenset(
    "area articles bar block body box button buttons container content form icons inner item items left link links list main outer page panel posts right row section site top bottom title unit wrap wrapper".split()
)
#: These only outside an article, where a page's head has them; within one they hold its title.
DROPPED_OUTSIDE = frozenset("header masthead topbar".split())
HOLDERS = frozenset("article main".split())

#: Elements below this depth stand beside one another, as in browsers, so a tag never walks far up.
DEPTH = 256

_NAME = re.compile(r"[^\s/>]+")
_ATTRIBUTE = re.compile(r"[\s/]*(?:(>)|([^\s/>][^\s/>=]*)(?:\s*=\s*(?:(\"|')|([^\s>]*)))?)")
_SPACE = re.compile(r"[ \t\n\r\f\v ]+")


class Node:
    __slots__ = ("tag", "parent", "children", "dropped", "named", "held", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, dropped: bool, held: bool):
        self.tag, self.parent, self.dropped, self.held = tag, parent, dropped, held
        self.named = 0
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _named(tag: str, value: str, held: bool) -> int:
    """What a class or id says: 2 for not the article, 1 if only a part of a name says so, else 0."""
    told = 0
    if tag in ("html", "body", *HOLDERS):
        return told
    for name in value.split():
        for way in {name.lower(), re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()}:
            words = set(re.split(r"[^a-z0-9]+", way)) - {""}
            marks = words & DROPPED_WORDS | (set() if held else words & DROPPED_OUTSIDE)
            if marks:
                told = max(told, 2 if words - marks <= PLAIN_WORDS else 1)
    return told


def _is_dropped(tag: str, attributes: list[tuple[str, str]], held: bool) -> tuple[bool, int]:
    """Whether tag and attributes leave an element out, and what its class and id say (-1: only the id, within an article)."""
    if tag in DROPPED or not held and tag in DROPPED_OUTSIDE:
        return True, 0
    named = 0
    for name, value in attributes:
        if name in ("class", "id"):
            told = _named(tag, value, held)
            if held and name == "id":  # in an article these are mostly its headings' words
                named = named or -min(told, 1)
            else:
                named = max(named, told) if told else named
        value = value.lower()
        if name == "hidden" or name == "role" and value in DROPPED_ROLES or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True, named
    return False, named


def tags(page: str):
    """The texts and tags of a page in order: str, or (name, whether it closes, attributes, whether it closes itself).

    Quotes are read as browsers do: one inside a bare value or between attributes is
    a character like others; one that nothing closes is too.  Every place of the page
    is looked at a bounded number of times.  What a script or the like holds is not
    given.
    """
    at, size = 0, len(page)
    last = {q: page.rfind(q) for q in "\"'"}
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            yield page[at:]
            return
        first = page[lt + 1 : lt + 2]
        closes = first == "/"
        m = _NAME.match(page, lt + 1 + closes) if (page[lt + 2 : lt + 3] if closes else first).isalpha() else None
        if m is None:
            if first and first in "!?/":  # comments and the like
                if lt > at:
                    yield page[at:lt]
                comment = page.startswith("<!--", lt)
                end = page.find("-->" if comment else ">", lt + (4 if comment else 2))
                at = size if end < 0 else end + (3 if comment else 1)
            else:
                yield page[at : lt + 1]
                at = lt + 1
            continue
        if lt > at:
            yield page[at:lt]
        name, at, attributes = m.group().lower(), m.end(), []
        while True:
            m = _ATTRIBUTE.match(page, at)
            if m is None:  # a tag that the page's end cuts is none
                return
            if m.group(1):
                break
            at, quote, value = m.end(), m.group(3), m.group(4) or ""
            if quote:
                if at <= last[quote]:
                    end = page.index(quote, at)
                    value, at = page[at:end], end + 1
                else:
                    bare = _BARE.match(page, at)
                    value, at = bare.group(), bare.end()
            attributes.append((m.group(2).lower(), value))
        at = m.end()
        yield name, closes, attributes, page[at - 2] == "/"
        if name in RAW and not closes:
            end = _closing(name).search(page, at)
            at = end.end() if end else size


_BARE = re.compile(r"[^\s>]*")


@lru_cache(maxsize=64)
def _closing(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I)


def parse(page: str) -> Node:
    """The tree of a page, read leniently: tags that are not closed end where their parents or followers do."""
    root = Node("html", None, False, False)
    node, depth = root, 0
    opened: dict[str, int] = {}

    def leave(to: Node) -> None:
        nonlocal node, depth
        while node is not to:
            opened[node.tag] -= 1
            depth -= 1
            node = node.parent

    for token in tags(page):
        if isinstance(token, str):
            node.children.append(token)
            continue
        tag, closes, attributes, closed = token
        if closes:
            up = node if opened.get(tag) else None
            while up is not None and up.tag != tag:
                if tag not in BLOCKS and up.tag in ("td", "th", "table", "article", "body", "div", "section"):
                    up = None  # an inline tag does not close its block
                    break
                up = up.parent
            if up is not None and up.parent is not None:
                leave(up.parent)
            elif tag in BLOCKS:
                node.children.append(Node(tag, node, False, node.held))  # an end tag still parts its blocks
            continue
        if tag in BLOCKS:
            open_, bounds = CLOSES.get(tag, ((), ()))
            up = end = node
            while up.parent is not None and up.tag not in bounds and (up.tag not in BLOCKS or up.tag in ("p", *open_)):
                if up.tag == "p" or up.tag in open_:
                    end = up.parent
                    if up.tag in open_ and tag not in ("tr",):
                        break
                up = up.parent
            leave(end)
            if open_ and node.tag not in bounds:
                up = end = node
                while up.parent is not None and up.tag not in bounds:
                    if up.tag in open_:
                        end = up.parent
                    up = up.parent
                leave(end)
        dropped, named = _is_dropped(tag, attributes, node.held)
        child = Node(tag, node, node.dropped or tag in RAW or dropped, node.held or tag in HOLDERS)
        child.named = named
        node.children.append(child)
        if tag not in RAW and tag not in VOID and not closed and depth < DEPTH:
            node, depth = child, depth + 1
            opened[tag] = opened.get(tag, 0) + 1
    return root


def density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Characters per tag, adjusted for links; ``share`` is that of the body's characters in links."""
    base = math.log(chars / max(1, chars - link_chars) * link_chars + share * chars + math.e)
    adjusted = math.log(max(1.0, chars / max(1, link_chars) * max(1, tags) / max(1, link_tags))) / max(0.1, math.log(base))
    return chars / max(1, tags) * adjusted


def weigh(root: Node) -> tuple[Node, Node]:
    """Set counts, densities and sums; return the body and the element with the greatest sum."""
    order: list[Node] = []
    stack = [root]
    body = root
    while stack:
        n = stack.pop()
        if n.dropped:
            continue
        order.append(n)
        if n.tag == "body":
            body = n
        stack += [c for c in n.children if isinstance(c, Node)]
    for n in reversed(order):
        n.chars = n.tags = n.link_chars = n.link_tags = 0
        n.density = 0.0
        for c in n.children:
            if isinstance(c, str):
                n.chars += len(_SPACE.sub(" ", c).strip())
            elif not c.dropped:
                n.chars += c.chars
                n.tags += c.tags + 1
                n.link_chars += c.link_chars
                n.link_tags += c.link_tags + (c.tag == "a")
        if n.tag == "a":
            n.link_chars = n.chars
    share = body.link_chars / max(1, body.chars)
    best = body
    for n in reversed(order):
        if n.chars:
            n.density = density(n.chars, n.tags, n.link_chars, n.link_tags, share)
        n.total = sum(c.density for c in n.children if isinstance(c, Node) and not c.dropped) + (n.density if any(isinstance(c, str) and c.strip() for c in n.children) and n.tag in BLOCKS else 0)
    for n in order:
        if n.total > best.total or best is body and n is not body and n.total >= best.total:
            best = n
    return body, best


def up(n: Node, end: Node) -> list[Node]:
    """An element and those around it, up to ``end``."""
    path = [n]
    while path[-1] is not end and path[-1].parent is not None:
        path.append(path[-1].parent)
    return path


def judge(root: Node) -> tuple[Node, Node]:
    """Mark as dropped what its name and its density show not to be the article; the body and the densest element then.

    A heading, or a part of a text block, is never judged by its name, a paragraph or
    the like only by a whole name.  A whole name tells where the element does not
    hold the densest one, or holds it only because it is longer than the article
    (comments); a part of a name tells only where the density misses the threshold,
    and an id within an article only where no heading or paragraph is in it besides.
    """
    named = []
    stack = [(root, False)]
    while stack:
        n, part = stack.pop()
        if n.dropped:
            continue
        if n.named and not part and n.tag not in HEADINGS and (n.named > 1 or n.tag in LISTS or n.tag not in TEXTS):
            named.append(n)
        part = part or n.tag in TEXTS - LISTS
        stack += [(c, part) for c in n.children if isinstance(c, Node)]
    body, best = weigh(root)
    unsettled = {id(n) for n in named if n.named > 1}
    while doubtful := [n for n in up(best, body) if id(n) in unsettled]:
        n = doubtful[-1]  # the outermost
        unsettled.remove(id(n))
        held = n.chars
        n.dropped = True
        body, best = weigh(root)
        if not (any(x.tag in HOLDERS for x in up(best, body)) or not has(n, {"h1", "main"}) and (has(body, {"h1"}) or not has(n, HOLDERS) and body.chars * 4 >= held)):
            n.dropped = False
            body, best = weigh(root)
    for whole in (True, False):
        path = up(best, body)
        around, threshold = set(map(id, path)), min(n.density for n in path)
        low = [n for n in named if not n.dropped and id(n) not in around and (n.named > 1 if whole else n.named < 2 and n.density < threshold and (n.named > 0 or not has(n, TEXTS - LISTS)))]
        for n in low:
            n.dropped = True
        if low:
            body, best = weigh(root)
    return body, best


def has(n: Node, tags: set[str] | frozenset[str]) -> bool:
    """Whether an element has another of some kinds in it."""
    stack = [n]
    while stack:
        x = stack.pop()
        if x.tag in tags:
            return True
        stack += [c for c in x.children if isinstance(c, Node) and not c.dropped]
    return False


def article(root: Node) -> Node:
    """The element that bounds the article, all in it that is not the article's marked as dropped.

    The element with the greatest sum is the article.  Its neighbours, and those of
    the elements around it, are parts of it if they reach the threshold and are not
    links in the main, and so are headings, however short; the search ends at an
    article element, else at main, else at the body.  In the element itself only what
    misses the threshold and is links in the main goes, as a short text there is
    still the article's.
    """
    body, best = judge(root)
    while best is not body and best.parent is not None and (best.tag not in BLOCKS or best.tag in PARTS):
        best = best.parent
    path = up(best, body)
    threshold = min(n.density for n in path)
    share = body.link_chars / max(1, body.chars)
    bound = next((n for tag in ("article", "main") for n in path if n.tag == tag), path[-1])
    between = set(map(id, path))

    def belongs(c: Node | str, parent: Node, inside: bool) -> bool:
        if isinstance(c, str):
            n = len(_SPACE.sub(" ", c).strip())
            return inside or parent is best or not n or density(n, 0, 0, 0, share) >= threshold
        if not c.chars or id(c) in between:
            return True
        links = c.link_chars * 2 >= c.chars
        if inside:
            return c.density >= threshold or not links or c.tag not in BLOCKS or c.tag in TEXTS - LISTS
        if parent is best and (c.tag not in BLOCKS or c.tag in TEXTS):
            return not links or c.tag not in LISTS
        return (c.density >= threshold or c.tag in HEADINGS) and not links

    stack = [(bound, False)]
    while stack:
        n, inside = stack.pop()
        inside = inside or n is best and n is not body or id(n) not in between
        kept = []
        for c in n.children:
            if isinstance(c, str):
                if belongs(c, n, inside):
                    kept.append(c)
                continue
            kept.append(c)
            if not c.dropped:
                c.dropped = not belongs(c, n, inside)
                if not c.dropped and (c.tag in BLOCKS and c.tag not in TEXTS or id(c) in between):
                    stack.append((c, inside))
        n.children = kept
    return bound


def blocks(top: Node) -> list[str]:
    """The texts of the blocks of an element, references decoded and white space made one space."""
    out: list[str] = []
    parts: list[str] = []

    def end() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        parts.clear()
        if text:
            out.append(text)

    stack: list[Node | str | None] = [top]
    while stack:
        n = stack.pop()
        if n is None:
            end()
        elif isinstance(n, str):
            parts.append(n)
        elif n.dropped:
            if n.tag in BLOCKS:
                end()
        else:
            if n.tag in BLOCKS:
                end()
                stack.append(None)
            elif n.tag == "br":
                parts.append(" ")
            stack += reversed(n.children)
    end()
    return out


def main_text(page: str | None) -> str:
    """The article of a page: its blocks joined by two line feeds; empty for a page without text."""
    return "\n\n".join(blocks(article(parse(page)))) if page else ""


def extract(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``pages`` (or their columns ``keep``) with text and n_chars (code points).

    A null page has the empty text, repeated rows each come back.  Elements nested
    deeper than ``DEPTH`` count as parts of the one at that depth, as in browsers,
    which have such a bound too: their texts stay, their tags divide it no further.
    """
    keep = [c for c in (keep or pages.columns) if c not in ("text", "n_chars")]
    out = pages.select(*keep, *[html_col] * (html_col not in keep))
    at, n = out.columns.index(html_col), len(keep)

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(texts, pa.string())], names=[*batch.schema.names[:n], "text"])

    return out.mapInArrow(run, T.StructType([*out.schema.fields[:n], T.StructField("text", T.StringType())])).withColumn("n_chars", F.length("text").cast("long"))
