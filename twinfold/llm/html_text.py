"""HTML extraction by tree scoring (operator 2).

A page is read into a tree by one pass over its tags, with the usual repairs
(void elements, paragraphs and list items that end implicitly, stray end tags,
missing ends). Boilerplate subtrees go by element, role or the names in class
and id. Every paragraph then passes points for its length and commas to its
ancestors, less at each step; a paragraph's points and a container's are
discounted by the share of its text that is in links. The best container is
kept, with those siblings
that hold similar text; an article element around it that has a fair share of
its points, as it does when its text is not in deeper boxes, takes its place.
Headings in an article's header are kept, the rest of the header isn't.

Reading is linear in the page: a quote counts only where a value begins, and
what never ends is text or, as a comment or script, nothing.

Text comes out by blocks in page order: character references decoded, white
space inside a block made one space, ``\\n\\n`` between blocks.

Defined results: null and empty pages, and pages without text, give empty text;
null and repeated ids each keep their rows; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset(
    "script style textarea title xmp iframe noembed noframes head nav aside footer header form template noscript svg canvas object embed audio video button select option input dialog menu".split()
)
PARAGRAPH = frozenset("p pre td blockquote li dd h1 h2 h3 h4 h5 h6 div section article main".split())
#: An open element of the first kind ends when one of the second begins.
ENDS = {
    "p": BLOCK, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option", "optgroup"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody"]), "th": frozenset(["td", "th", "tr", "tbody"]), "head": frozenset(["body"]),
}
#: An implied end looks no further up than to these.
SCOPE = frozenset("table ul ol dl div article section main body td th li blockquote nav aside footer header form".split())
BAD_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|commentlist|consent|cookies?|disqus|footer|footnav|form|gdpr|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|pager|pagination|popup|promo\w*|recommend\w*|related|replies|reply|share|sharing|sidebar|signup|social|sponsor\w*|subscribe|subscription|tags|toolbar|widget)(?=$|[\s_-])",
    re.I,
)
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_MARKUP = re.compile(r"<(?=[a-zA-Z/!?])")
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
#: What stands up to the end of a tag. A quote counts only after an equals sign; nothing is ever read twice.
_REST = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+")
_ATTRIBUTE = re.compile(r"([a-zA-Z_:-]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))")


#: Share of the best container's points from which the article around it is taken in its place.
WIDEN = 0.3
#: What opens below this depth holds nothing itself: its content goes to the element around it, in place.
DEEPEST = 256


class Node:
    __slots__ = ("tag", "parent", "parts", "bad", "score", "chars", "linked", "depth")

    def __init__(self, tag: str, parent: Node | None, bad: bool = False):
        self.tag, self.parent, self.parts, self.bad = tag, parent, [], bad
        self.score, self.chars, self.linked = 0.0, 0, 0
        self.depth = parent.depth + 1 if parent else 0


def _is_bad(tag: str, attributes: str) -> bool:
    if tag in DROPPED:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id") and BAD_NAMES.search(value):
            return True
        if name == "role" and value.lower() in BAD_ROLES or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|$)", attributes))


def tokens(html: str) -> Iterator[tuple[str | None, bool, str, int]]:
    """(name, whether an end tag, attributes, where it ends), or for text (None, False, text, where it ends).

    One pass: the caller may send the place to go on from. Where quotes would
    run over the end of the page, tags end at their first ``>`` from there on.
    """
    at, plain_ends = 0, False
    while at < len(html):
        m = _MARKUP.search(html, at)
        begin = m.start() if m else len(html)
        if begin > at:
            yield None, False, html[at:begin], begin
        if not m:
            return
        close = html.find(">", begin)
        if html.startswith("<!--", begin):
            end = html.find("-->", begin + 4)
            at = end + 3 if end >= 0 else len(html)
            continue
        name = _NAME.match(html, begin + 1)
        if close < 0 or not name:  # no tag: text if it never ends, else a comment of a kind
            if close < 0:
                yield None, False, html[begin:], len(html)
                return
            at = close + 1
            continue
        end = close if plain_ends else _REST.match(html, name.end()).end()
        if end >= len(html):
            plain_ends, end = True, close
        at = end + 1
        jump = yield name[2].lower(), bool(name[1]), html[name.end() : end], at
        if jump is not None:
            at = jump
            yield "", False, "", at


def _kept_heading(tag: str, now: Node) -> bool:
    """Whether a heading stands in the header of an article, which is dropped but for its headings."""
    if tag not in HEADINGS:
        return False
    while now is not None and now.tag != "header":
        if now.bad:
            return False
        now = now.parent
    while now is not None:
        if now.tag in ("article", "main"):
            return True
        if now.bad and now.tag != "header":
            return False
        now = now.parent
    return False


def parse(html: str) -> Node:
    root = Node("html", None)
    now = root
    raw_ends: dict[str, re.Pattern] = {}
    unended: set[str] = set()
    skipped: Counter[str] = Counter()
    reader = tokens(html)
    for name, is_end, attributes, at in reader:
        if name is None:
            now.parts.append(unescape(attributes))
            continue
        if is_end:
            if skipped[name]:
                skipped[name] -= 1
                continue
            node = now
            while node is not None and node.tag != name:
                # An inline end tag doesn't close the blocks around it.
                node = None if name not in BLOCK and node.tag in BLOCK else node.parent
            if node is not None and node.parent is not None:
                now = node.parent
            continue
        if name in VOID:
            now.parts.append(Node(name, now))
            continue
        if name in BLOCK:  # inline elements left open end with the block they are in
            node = now
            while node.parent is not None:
                if node.tag in ENDS and name in ENDS[node.tag]:
                    now = node.parent
                elif node.tag in SCOPE:
                    break
                node = node.parent
        node = Node(name, now, _is_bad(name, attributes))
        if _kept_heading(name, now):  # before the header that it stands in
            header = now
            while header.tag != "header":
                header = header.parent
            header.parent.parts.insert(len(header.parent.parts) - 1, node)
        else:
            now.parts.append(node)
        if name in RAW:
            if name not in raw_ends:
                raw_ends[name] = re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I)
            end = None if name in unended else raw_ends[name].search(html, at)
            if end is None:
                unended.add(name)
            reader.send(end.end() if end else len(html))
        elif attributes.endswith("/"):
            continue
        elif node.depth <= DEEPEST or node.bad and not now.bad:
            now = node
        else:
            skipped[name] += 1
    return root


def _measure(node: Node, link: bool = False) -> tuple[int, int]:
    """Characters, and those in links, of what isn't boilerplate; deep pages need no recursion limit."""
    order, stack = [], [node]
    while stack:
        x = stack.pop()
        if x.bad:
            continue
        order.append(x)
        stack += [p for p in x.parts if isinstance(p, Node)]
    for x in reversed(order):
        for p in x.parts:
            if isinstance(p, Node):
                x.chars += p.chars
                x.linked += p.linked
            else:
                x.chars += len(p.strip())
        if x.tag == "a":
            x.linked = x.chars
    return node.chars, node.linked


def _own_text(node: Node) -> str:
    """Text of a paragraph without the blocks in it."""
    out, stack = [], list(reversed(node.parts))
    while stack:
        p = stack.pop()
        if not isinstance(p, Node):
            out.append(p)
        elif not p.bad and p.tag not in BLOCK:
            stack += reversed(p.parts)
    return " ".join("".join(out).split())


def _walk(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        x = stack.pop()
        if not x.bad:
            yield x
            stack += [p for p in reversed(x.parts) if isinstance(p, Node)]


def best_container(root: Node) -> list[Node]:
    """The container with the most points and the siblings to keep with it, in page order."""
    _measure(root)
    scored: list[Node] = []
    for x in _walk(root):
        if x.tag not in PARAGRAPH:
            continue
        text = _own_text(x)
        if not text:
            continue
        points = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - x.linked / max(x.chars, 1))
        up, level = x.parent, 1
        while up is not None and level <= 4:
            if not up.score:
                scored.append(up)
            up.score += points / level
            up, level = up.parent, level + 1
    for x in scored:
        x.score *= 1 - x.linked / max(x.chars, 1)
    if not scored:
        return [root]
    best = max(scored, key=lambda x: x.score)  # the first of equals
    around = best
    while around is not None:
        if around.tag in ("article", "main") and around.score >= WIDEN * best.score:
            best = around
            break
        around = around.parent
    if best.tag in ("article", "main", "body", "html") or best.parent is None:
        return [best]
    kept = []
    for p in best.parent.parts:
        if not isinstance(p, Node) or p.bad:
            continue
        if p is best or p.score > 0 and p.score >= 0.2 * best.score:
            kept.append(p)
            continue
        text, density = _own_text(p), p.linked / max(p.chars, 1)
        if p.tag in ("h1", "h2", "h3") and density < 0.5 or p.tag == "p" and text and (len(text) > 80 and density < 0.25 or not p.linked and re.search(r"[.!?]$", text)):
            kept.append(p)
    return kept


def blocks(nodes: list[Node]) -> Iterator[str]:
    """Texts of blocks in page order."""
    run: list[str] = []
    stack: list = [(n, False) for n in reversed(nodes)]
    while stack:
        p, done = stack.pop()
        if not isinstance(p, Node):
            run.append(p)
            continue
        if p.bad:
            continue
        edge = p.tag in BLOCK
        if edge or done:
            text = " ".join("".join(run).split())
            run = []
            if text:
                yield text
        if done:
            continue
        if p.tag == "br":
            run.append(" ")
        if edge:
            stack.append((p, True))
        stack += [(q, False) for q in reversed(p.parts)]
    text = " ".join("".join(run).split())
    if text:
        yield text


def main_text(html: str) -> str:
    return "\n\n".join(blocks(best_container(parse(html)))) if html else ""


EXTRACTED = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, main text and its length for every page."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [main_text(x or "") for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, type=pa.string()), pa.array(map(len, texts), type=pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return small_batches(pages).select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(each, EXTRACTED)
