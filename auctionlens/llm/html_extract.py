"""Main text of web pages by scoring the element tree.

Paragraphs pass points for their length and their commas to their ancestors; an
element's points are discounted by the share of its text that is in links. The
best container is kept, with siblings that score well beside it.
"""

from __future__ import annotations

import html
import re
import sys
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements of the language, by their part in the page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
SKIPPED = frozenset(
    "head script style noscript template iframe nav footer aside button select option textarea input label svg "
    "canvas object audio video dialog menu menuitem title xmp noembed noframes".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr "
    "ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search toolbar".split())
#: Words of a class or an id that tell of something beside the article, whatever the element is.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement breadcrumb breadcrumbs comments consent disqus footer gdpr masthead nav navbar "
    "newsletter pager pagination popup promo promoted replies shoutbox sidebar signup skip sponsor sponsored subscribe "
    "toolbar widget".split()
)
#: Words that do so too, but are also what an article may be about.
MAYBE_WORDS = frozenset(
    "advertising banner comment cookie cookies form login menu navigation notice notices promotion related reply search share "
    "sharing social tags".split()
)
#: Words that only say which part, place or number of it an element is.
NEUTRAL_WORDS = frozenset(
    "a area article articles bar block body bottom box button buttons col column container content field group header icons "
    "inner item items left link links list main middle module more outer page panel post posts reader right row section site "
    "slot stories thread title top unit user widgets wrap wrapper".split()
)
#: Elements whose name decides on all they hold; of others, such as headings, a name says nothing.
NAMED = frozenset("article center dd details div dl fieldset figure header li ol p section span table td tr ul".split())
#: Element that a start tag closes: those it names, up to the nearest of the limits.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.DOTALL,
)
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Names of a container that say what it has beside the article, such as has-sidebar.
_ABOUT = re.compile(r"(?<!\S)(?:no|has|with|without)-\S*", re.I)
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: Points: a paragraph's own, one for each comma, one for each so many characters up to a limit.
PARAGRAPH, PER_CHARS, MOST = 1.0, 100, 3.0
#: What an element has from its name.
BASE = {"article": 25.0, "main": 10.0, "section": 2.0, "div": 2.0, "blockquote": 1.0, "td": 1.0, "ul": -3.0, "ol": -3.0}
#: A sibling is kept from this share of the best score on; the score of a container of doubtful name is this share of its own.
SIBLING, DOUBTFUL = 0.2, 0.2
#: Elements that stand for themselves beside the best container, if not mainly of links.
PLAIN = frozenset("blockquote details dl figure ol p pre table ul".split())


class Node:
    """An element, with what holds for all it contains, so no step has to walk up a deep tree."""

    __slots__ = ("tag", "parent", "depth", "block", "hidden", "in_link", "in_article", "points", "chars", "linked", "first",
                 "doubtful", "form", "paragraphs")

    def __init__(self, tag: str, parent: Node | None = None, skipped: bool = False, doubtful: bool = False):
        self.tag, self.parent, self.depth = tag, parent, parent.depth + 1 if parent else 0
        self.block = self if tag in BLOCKS or not parent else parent.block  # the innermost block element
        self.hidden = skipped or bool(parent and parent.hidden)
        self.in_link = tag == "a" or bool(parent and parent.in_link)
        self.in_article = tag == "article" or bool(parent and parent.in_article)
        self.doubtful = doubtful
        self.form = self if tag == "form" else parent.form if parent else None  # the innermost form
        self.points, self.chars, self.linked, self.paragraphs = 0.0, 0, 0, 0
        self.first = sys.maxsize  # number of its first block of text

    def score(self) -> float:
        density = self.linked / self.chars if self.chars else 0.0
        share = (1.0 - density) * (DOUBTFUL if self.doubtful else 1.0)
        return (BASE.get(self.tag, 0.0) * (self.chars > 0) + self.points) * share


def _words(name: str) -> list[str]:
    return [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w]


def _named_aside(tag: str, name: str, value: str) -> str:
    """"aside" if a class or an id tells that the element is beside the article, "doubtful" if it may, or nothing.

    Every name counts for itself. It tells so if it has no words but those of such
    things and of parts and places: ``form-validation`` does not.
    """
    found = ""
    for part in _ABOUT.sub(" ", value).split():
        words = set(_words(part))
        strong, maybe = words & ASIDE_WORDS, words & MAYBE_WORDS
        # A section of an article is often named by its heading.
        if not (strong or maybe) or tag == "section" and name == "id" and not strong and maybe != {"comment"}:
            continue
        if tag in ("p", "span", "li", "td", "tr", "dd") and not (strong and words <= ASIDE_WORDS):
            continue
        if words <= ASIDE_WORDS | MAYBE_WORDS | NEUTRAL_WORDS:
            return "aside"
        found = "doubtful"
    return found


def _marked(tag: str, attrs: str) -> str:
    """"aside" if the attributes hide the element or put it beside the article, "doubtful" if its names may, or nothing."""
    found = ""
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id"):
            said = _named_aside(tag, name, value) if tag in NAMED else ""
            if said == "aside":
                return said
            found = found or said
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return "aside"
        elif name == "role" and value.lower() in ROLES or name == "style" and _HIDDEN_STYLE.search(value):
            return "aside"
    return found


def blocks_of(page: str) -> tuple[list[Node], list[tuple[Node, str, int]]]:
    """All elements, parents first, and (innermost block element, text, characters in links) of every visible block."""
    root = Node("#page")
    nodes, stack, found, parts, links = [root], [root], [], [], 0
    opened: dict[str, list[int]] = {}  # places in the stack by tag
    place = 0

    def flush() -> None:
        nonlocal links
        text = " ".join("".join(parts).split())
        if text:
            found.append((stack[-1].block, text, min(links, len(text))))
        parts.clear()
        links = 0

    def nearest(tags: Iterable[str]) -> int:
        return max((opened[t][-1] for t in tags if opened.get(t)), default=0)

    def close(depth: int) -> None:
        if stack[-1].block.depth >= depth:
            flush()
        while len(stack) > depth:
            opened[stack.pop().tag].pop()

    def add(raw: str) -> None:
        nonlocal links
        text = html.unescape(raw)
        parts.append(text)
        if stack[-1].in_link:
            links += len(" ".join(text.split()))

    while True:
        m = _TOKEN.search(page, place)
        if not stack[-1].hidden:
            add(page[place : m.start() if m else len(page)])
        if not m:
            break
        place = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if m["end"]:
            at = nearest([tag])
            if at:
                close(at)
            elif tag == "br" or tag == "p":
                parts.append(" ")
            continue
        if tag in IMPLIED:
            shut, limits = IMPLIED[tag]
            at = nearest(shut)
            if at > nearest(limits):
                close(at)
        if tag in BLOCKS:
            block = stack[-1].block
            if block.tag == "p" or block.tag in HEADINGS and tag in HEADINGS:
                close(block.depth)
            flush()
        if tag in VOID:
            parts.append(" " if tag in ("br", "hr") and not stack[-1].hidden else "")
            continue
        in_article = stack[-1].in_article
        skipped = tag in SKIPPED or tag == "header" and not in_article
        said = "" if skipped or tag in ("html", "body", "main") else _marked(tag, m["attrs"])
        if tag == "article" and not in_article and "comment" not in m["attrs"].lower():
            said = ""
        skipped = skipped or said == "aside"
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, place)
            place = end.end() if end else len(page)
            continue
        opened.setdefault(tag, []).append(len(stack))
        stack.append(Node(tag, stack[-1], skipped, said == "doubtful"))
        nodes.append(stack[-1])
    flush()
    return nodes, found


def _without_forms(blocks: list[tuple[Node, str, int]], nodes: list[Node]) -> list[tuple[Node, str, int]]:
    """The blocks outside forms, and those of a form around the page: one that holds an article, or most of the long text."""
    total = sum(len(text) for _, text, _ in blocks if len(text) >= 80)
    for n in nodes:
        if n.form and n.tag in ("article", "main"):
            n.form.paragraphs += 2
            n.form.points = sys.maxsize
    for node, text, linked in blocks:
        if node.form and len(text) >= 80 and 2 * linked <= len(text):
            node.form.paragraphs += 1
            node.form.points += len(text)
    wraps = {id(n) for n in nodes if n.tag == "form" and n.paragraphs >= 2 and 2 * n.points >= total}
    for n in nodes:
        if n.tag == "form":
            n.points = 0.0
    return [b for b in blocks if not b[0].form or id(b[0].form) in wraps]


def _beside(best: Node, nodes: list[Node]) -> set[int]:
    """The siblings of the best container that belong to the article.

    Those that score well; headings, lists, tables, quotes and paragraphs too, if they are not mainly of links, and
    stand in an element of the page's content, or are long, or lead the best container (a heading just before it).
    """
    kept = {id(best)}
    around = best.parent
    if around is None:
        return kept
    siblings = sorted((n for n in nodes if n.parent is around), key=lambda n: n.first)
    content = around.tag in ("main", "article", "section")
    least = max(10.0, SIBLING * best.score())
    for n in siblings:
        if n is best or n.doubtful or 3 * n.linked > n.chars:
            continue
        if n.tag in HEADINGS:
            good = content or n.first < best.first
        elif n.tag in PLAIN:
            good = content or n.tag == "p" and n.chars >= 80
        elif n.tag == "article" and best.tag == "article":
            good = n.points >= max(2.0, best.points / 10)
        else:
            good = n.tag in ("article", "section", "div", "td") and n.score() - BASE.get(n.tag, 0.0) >= least
        if good:
            kept.add(id(n))
    return kept


def main_text(page: str | None) -> str:
    """The blocks of the article in page order, joined by line feeds; empty if the page has no text."""
    nodes, blocks = blocks_of(page or "")
    blocks = _without_forms(blocks, nodes)
    for i, (node, text, linked) in enumerate(blocks):
        node.first = min(node.first, i)
        node.chars += len(text)
        node.linked += linked
        points = 0.0
        if node.tag not in HEADINGS and len(text) >= 25:
            density = linked / len(text)
            points = (PARAGRAPH + text.count(",") + min(MOST, len(text) / PER_CHARS)) * (1.0 - density)
        share, up = 1.0, node.parent if node.tag in ("p", "pre", "li") and node.parent else node
        while up is not None and share > 0.05:
            up.points += points * share
            share, up = share / 2, up.parent
    for n in reversed(nodes[1:]):
        n.parent.chars += n.chars
        n.parent.linked += n.linked
        n.parent.first = min(n.parent.first, n.first)
    nodes = [n for n in nodes if n.chars]
    held = [n for n in nodes if n.tag not in ("#page", "html", "p", "li", "pre", *HEADINGS)]
    # Of equal scores that whose text begins first; of those, the innermost.
    best = max(held, key=lambda n: (n.score(), -n.first, n.depth), default=None)
    if best is None or best.score() <= 0:
        return "\n".join(text for _, text, linked in blocks if 2 * linked <= len(text))
    up = best
    while up is not None:  # an article is kept whole, its heading too
        if up.tag == "article":
            best = up
        up = up.parent
    inside = _beside(best, nodes)
    headed: set[int] = set()  # parents that had a heading or a paragraph so far
    for n in nodes:
        # In the article a list of links stays, such as its references, if text of the article led to it.
        of_links = n.tag in ("ul", "ol", "table", "dl") and 3 * n.linked > 2 * n.chars
        mainly_links = n.doubtful and 3 * n.linked > n.chars or of_links and id(n.parent) not in headed
        if id(n.parent) in inside and not mainly_links:
            inside.add(id(n))
        if n.tag in HEADINGS or n.tag == "p":
            headed.add(id(n.parent))
    return "\n".join(text for node, text, _ in blocks if id(node) in inside)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    A null or empty page has an empty text; a malformed one is read as far as its
    tags make sense. Repeated rows and null ids get a row each. Other columns are
    not read.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column(2)]
            columns = [*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(rows, "page_id bigint, url string, text string, n_chars bigint")
