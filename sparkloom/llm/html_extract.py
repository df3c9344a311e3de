"""HTML extraction by tag-path ratios.

Every text node of a page belongs to a root-to-leaf tag path; elements that are marked as boilerplate
by their tag, role, class or id are steps of their own in it. Per path the text length and the
punctuation of its nodes are summed; both are put over the path's tag count, smoothed over the paths
in page order, fused by multiplication, weighed down by `MARKED` where the path is marked, and held
against a threshold. The paths above it are content and name the content container; its unmarked
other paths (headings, short paragraphs, lists) come along, paths below the threshold that are marked
or stand outside of it go. A mark gives way where its element holds most of the page's <article> or
<main> text, or, for roles, classes and forms, most of its text; and all roles and classes do where
they would take more of the high-scoring text than they leave. Marks of reader comments give way only on
pages that have no sentence beside them, however long the comments are; a heading with nothing but
comments below it goes with them.

Edge cases: null or empty html and pages without text give an empty text; unclosed and stray tags
are repaired as a browser would (a block closes an open paragraph); a tag without `>` ends at the next
`<`, and a quote that is never closed is an ordinary character; a page cut off inside a tag, comment or
script loses that piece of markup only; work grows with the page's length, also on broken or deeply
nested markup; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tag names of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe svg".split())
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
BOILER_TAGS = set("head nav header footer aside form menu button select dialog script style noscript template iframe object svg textarea label fieldset option title".split())
#: Of these, elements that may wrap a page's content.
WRAPPERS = set("nav header footer aside form menu fieldset".split())
BOILER_ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
# Words in class names and ids that name boilerplate.
BOILER_WORDS = set("ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus discussion footer form gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices notification pagination pager paywall popup promo promoted promotion reactions recommended related replies reply respond search share sharing sidebar signup sitenav skip social sponsor sponsored subscribe subscription tags teaser toolbar widget widgets".split())
#: Of these, words that name reader comments.
TALK_WORDS = set("comment comments discussion disqus reactions replies reply respond".split())

#: Weight of a marked path's score.
MARKED = 0.02
_TAG = re.compile(r"</?([a-zA-Z][^\s/><]*)((?:[^<>=]+|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)>?")
_ATTR = re.compile(r"""(?<![^\s\"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?(?![^\s=/>])""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_ENDS = {tag: re.compile(rf"</{tag}\b[^>]*>?", re.I) for tag in RAW}
_PUNCT = re.compile(r"[.,;:!?…。，、！？؟،]")


def _mark(tag: str, attributes: str, by_words: bool) -> str:
    """What names an element as boilerplate: "tag", "talk" (a class or id of reader comments), "word" (another class or id, a role or hidden attribute) or nothing."""
    if tag in BOILER_TAGS:
        return "tag"
    if not by_words or not attributes or tag in ("html", "body", "main", "article"):
        return ""
    for name, value in _ATTR.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return "word"
        words = _SPLIT.split(_CAMEL.sub(" ", value).lower())
        if name != "role" and not TALK_WORDS.isdisjoint(words):
            return "talk"
        if not BOILER_WORDS.isdisjoint(words) if name != "role" else not BOILER_ROLES.isdisjoint(words):
            return "word"
    return ""


class _Node:
    """An element: path is a number for its tag path, inside whether an <article> or <main> holds it."""

    __slots__ = ("tag", "parent", "path", "mark", "boiler", "depth", "inside", "plain", "talk", "body", "named", "block", "home")

    def __init__(self, tag: str, parent: _Node | None, mark: str, paths: dict):
        self.tag, self.parent, self.mark = tag, parent, mark
        self.path = paths.setdefault((parent.path if parent else -1, tag, mark), len(paths))
        self.depth = parent.depth + 1 if parent else 0
        self.inside = tag in ("article", "main") or bool(parent and parent.inside)
        # Not in a navigation or the like, though maybe in a form.
        self.plain = not (mark == "tag" and tag != "form") and (parent is None or parent.plain)
        self.talk = mark == "talk" or bool(parent and parent.talk)
        self.boiler = bool(mark) or bool(parent and parent.boiler)
        self.body = self.named = 0
        #: The innermost block element, and the innermost that is a block or marked.
        self.block = self if parent is None or tag in BLOCKS else parent.block
        self.home = self if self.block is self or mark else parent.home


def _free(nodes: list[_Node], blocks: list[tuple[_Node, str]], named_by: tuple[str, ...]) -> None:
    """Free the elements so marked that hold most of the blocks' content, and what isn't marked itself inside them."""
    for x in nodes:
        x.body = x.named = 0
    for x, text in blocks:
        x.body += len(text) * x.plain
        x.named += len(text) * x.inside
    for x in reversed(nodes[1:]):  # a node comes after its parent
        x.parent.body += x.body
        x.parent.named += x.named
    total, named = nodes[0].body, nodes[0].named
    freed = False
    for x in nodes:
        if x.mark:
            wraps = 2 * x.named > named and (x.mark in named_by or x.tag in WRAPPERS)
            if wraps or ((x.mark in named_by or x.tag == "form") and 2 * x.body > total and 4 * (named - x.named) < total):
                x.mark, freed = "", True
    if freed:
        for x in nodes:
            x.boiler = bool(x.mark) or bool(x.parent and x.parent.boiler)


def _settle(nodes: list[_Node], blocks: list[tuple[_Node, str]]) -> None:
    """Free the marked elements that hold most of the page's content; those of reader comments only where no sentence is beside them."""
    told = [b for b in blocks if not b[0].talk]
    if len(told) < len(blocks):
        _free(nodes, told, ("word",))
        if any(not x.boiler and text.count(" ") >= 4 and _PUNCT.search(text) for x, text in told):
            return
    _free(nodes, blocks, ("word", "talk"))


def blocks_of(html: str, by_words: bool = True) -> list[tuple[_Node, str]]:
    """Text blocks in page order: the block element they stand in, and their white-space-folded text."""
    paths: dict = {}
    top = node = _Node("", None, "", paths)
    nodes = [top]
    standing: dict[str, list[_Node]] = {}  # open elements by tag
    out: list[tuple[_Node, str]] = []
    parts: list[str] = []
    at: _Node | None = None

    def flush() -> None:
        nonlocal at
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text and at is not None:
                out.append((at, text))
            parts.clear()
        at = None

    def put(raw: str) -> None:
        nonlocal at
        if raw:
            if at is None and not raw.isspace():
                at = home
            parts.append(raw)

    def leave(until: _Node) -> None:
        """Close the open elements below until."""
        nonlocal node
        while node is not until:
            standing[node.tag].pop()
            node = node.parent

    home = top  # the innermost block element
    pos, n = 0, len(html)
    while pos < n:
        start = html.find("<", pos)
        if start < 0:
            put(html[pos:])
            break
        put(html[pos:start])
        after = html[start + 1 : start + 2]
        if after in ("!", "?"):
            if html.startswith("<!--", start):
                end = html.find("-->", start + 4)
                pos = end + 3 if end >= 0 else n
            elif html.startswith("<![CDATA[", start):
                end = html.find("]]>", start)
                put(html[start + 9 : end if end >= 0 else n].replace("&", "&amp;"))
                pos = end + 3 if end >= 0 else n
            else:
                end = html.find(">", start)
                pos = end + 1 if end >= 0 else n
            continue
        m = _TAG.match(html, start)
        if m is None:
            put("<")
            pos = start + 1
            continue
        pos = m.end()
        token = m.group()
        tag = m.group(1).lower()
        if token[1] == "/":
            if tag in VOID:
                put(" ")
                continue
            x = standing[tag][-1] if standing.get(tag) else top
            if x is top or (tag not in BLOCKS and node.block.depth > x.depth):
                if tag == "p":
                    flush()
                continue
            if tag in BLOCKS:
                flush()
            leave(x.parent)
        else:
            if tag in VOID:
                if tag == "hr":
                    flush()
                else:
                    put(" " if tag == "br" else "")
                continue
            if tag in BLOCKS:
                flush()
                closes = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "p": "p"}.get(tag, "p").split()
                x, inner = node.block, None
                while x is not top and (x.tag in closes or x.tag == "p"):
                    inner, x = x, x.parent.block
                if inner is not None:
                    leave(inner.parent)
            if tag in RAW:
                end = _ENDS[tag].search(html, pos)
                pos = end.end() if end else n
                continue
            if not token.endswith("/>") or tag in BLOCKS:
                node = _Node(tag, node, _mark(tag, m.group(2), by_words), paths)
                nodes.append(node)
                standing.setdefault(tag, []).append(node)
        home = node.home
    flush()
    if any(x.boiler for x, _ in out):
        _settle(nodes, out)
    return out


def path_scores(blocks: list[tuple[_Node, str]]) -> dict[tuple[int, bool], float]:
    """Fused, smoothed and weighed text and punctuation ratios of the tag paths, by path and whether it is marked."""
    sums: dict[tuple[int, bool], list] = {}
    for node, text in blocks:
        of = sums.setdefault((node.path, node.boiler), [0, 0, 0, 0 if node.talk else MARKED])
        of[0] += len(text)
        of[1] += len(_PUNCT.findall(text))
        of[2] += 1
    out = {}
    for marked in (False, True):  # a marked path's neighbours are marked ones: no content next to it lifts it
        paths = [p for p in sums if p[1] == marked]
        raw = [(sums[p][0] / sums[p][2], sums[p][1] / sums[p][2]) for p in paths]
        for i, p in enumerate(paths):
            near = [(raw[i + d], w) for d, w in ((-1, 0.15), (0, 0.7), (1, 0.15)) if 0 <= i + d < len(paths)]
            total = sum(w for _, w in near)
            length, punct = (sum(r[k] * w for r, w in near) / total for k in (0, 1))
            out[p] = length * (1 + punct) * math.sqrt(sums[p][2]) * (sums[p][3] if marked else 1)
    return out


def _high(scores: dict[tuple[int, bool], float]) -> set[tuple[int, bool]]:
    """The paths above the threshold, which the unmarked ones set where there are any."""
    values = [v for p, v in scores.items() if not p[1]] or list(scores.values())
    mean = sum(values) / len(values)
    deviation = math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))
    return {p for p, v in scores.items() if v >= min(mean + 0.5 * deviation, max(values))}


def _taken_and_left(blocks: list[tuple[_Node, str]], by_tags: list[tuple[_Node, str]]) -> bool:
    """Whether words take more text of high-scoring paths than they leave, and leave no article or main."""
    if any(not x.boiler and x.inside for x, _ in blocks):
        return False
    high = _high(path_scores(by_tags))
    taken = left = 0
    for (x, text), (y, _) in zip(blocks, by_tags, strict=True):  # the same blocks, with and without marks by words
        if not y.boiler and (y.path, False) in high and not (x.boiler and x.talk):
            taken += len(text)
            left += len(text) * (not x.boiler)
    return taken > 2 * left


HEADS = set("h2 h3 h4 h5 h6".split())
_NEVER_BOX = set("p li h1 h2 h3 h4 h5 h6 pre td b span blockquote a ul ol strong em i".split())


def extract(html: str | None) -> str:
    """The page's main text: content blocks joined by newlines."""
    blocks = blocks_of(html or "")
    if any(x.boiler for x, _ in blocks):
        by_tags = blocks_of(html, by_words=False)
        if all(x.boiler for x, _ in blocks) or _taken_and_left(blocks, by_tags):  # classes or ids named the content itself: go by tags alone
            blocks = by_tags
    if all(x.boiler and x.mark not in ("word", "talk") and not x.plain for x, _ in blocks):
        return ""
    high = _high(path_scores(blocks))
    mass: dict[int, list] = {}
    total = 0
    for node, text in blocks:
        if (node.path, node.boiler) in high:
            total += len(text)
            mass.setdefault(id(node), [node, 0])[1] += len(text)
    deep = [[] for _ in range(1 + max((m[0].depth for m in mass.values()), default=0))]
    for m in mass.values():
        deep[m[0].depth].append(m)
    for d in range(len(deep) - 1, 0, -1):  # what an element holds counts for its parent
        for x, n in deep[d]:
            if id(x.parent) not in mass:
                mass[id(x.parent)] = [x.parent, 0]
                deep[d - 1].append(mass[id(x.parent)])
            mass[id(x.parent)][1] += n
    # The container: the innermost <article> or <main> with nearly all of the high-scoring text, or else the innermost such element.
    held = [m[0] for row in deep for m in row if m[1] >= 0.9 * total]
    box = ([x for x in held if x.tag in ("article", "main")] or [x for x in held if x.tag not in _NEVER_BOX] or [None])[-1]
    inside = {id(box)}
    kept: list[str] = []
    head = talk = False  # whether the last kept block is a heading, and reader comments came since
    for node, text in blocks:
        talk = talk or (head and node.boiler and node.talk)
        way, x = [], node
        while x is not None and id(x) not in inside and x.depth > (box.depth if box else -1):
            way.append(x)
            x = x.parent
        if x is not None and id(x) in inside:
            inside.update(map(id, way))
            if not node.boiler or (node.path, True) in high:
                if talk and node.tag in HEADS:  # nothing came between two headings but comments
                    kept.pop()
                kept.append(text)
                head, talk = node.tag in HEADS, False
    if talk:
        kept.pop()
    return "\n".join(kept)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                texts = [extract(h) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")
