"""Main text of web pages by consensus of each host's pages.

Pass one scores the containers of every page: a block of text counts for its container, less what is link text, and less with
each step outwards.  The best containers vote for their path, the tags and classes from the root with digits generalised, and Spark sums
the votes of each host.  Pass two re-reads every page and takes the container on its host's winning path, or the page's own
best container where the page has no text on that path.

Within the container, menus, footers, sidebars, notices, adverts, forms and reader comments are left out by tag, and by whole names of class, id and role
where these do not hold most of the page's text.  Blocks are split at block-level tags; a line break inside a block is white space.
Tags are read from left to right as browsers read them, attribute values as such, in time that grows with the page whatever it holds.

The winners are one row for each host.  They are broadcast only if their measured size is small, and joined by a merge join otherwise.

Cases: null and empty html give an empty text; unclosed and misnested tags, comments and scripts are read to the end like
a browser does, and a tag that the page ends in is dropped; a null url is a host of its own; repeated rows are extracted each; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, written

# HTML element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg math canvas".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
CONTAINER = frozenset("html body main article section div td center form fieldset aside nav header footer".split())
UNWANTED = frozenset("nav aside footer form button select input textarea dialog menu label object audio video head".split())
CLOSES_P = BLOCK - {"html", "body"}
#: Words that mark, as a whole class, id or role, what is not the article; beside them in one name only the neutral ones may stand.
UNWANTED_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert "
    "popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget widgets related recommended share sharing social "
    "footer header masthead topbar toolbar comment comments disqus replies respond newsletter subscribe signup login search pagination pager "
    "skip complementary contentinfo form".split()
)
NEUTRAL_WORDS = frozenset("site page main top bottom left right bar box wrap wrapper container inner outer list item items link links posts articles buttons icons slot area section block row thread primary secondary global js".split())
ARTICLE, SHELL, LISTS = ("article", "main"), frozenset("nav aside header footer form ul ol menu".split()), ("ul", "ol", "menu")

_NAME = re.compile(r"[A-Za-z][^\s/>]*+")
_ATTR = re.compile(r"[\s/]*+(?:([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+)?+")
_SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
_DIGITS = re.compile(r"\d+")
#: Steps outwards keep this share of a block's score; containers that vote for each page.
OUTWARDS, VOTERS = 0.6, 3
#: Characters of a path; what is below is told apart by a hash.
PATH_LENGTH = 1000
#: Bytes of winners up to which they are broadcast.
BROADCAST_BYTES = 8 << 20


@dataclass
class Node:
    tag: str
    path: str
    depth: int
    parent: Node | None
    by_tag: bool
    marked: bool
    order: int
    blocks: list[tuple[int, str, int]] = field(default_factory=list)
    score: float = 0.0
    size: int = 0
    unwanted: bool = False


def _tokens(page: str) -> Iterator[tuple[str, str, bool, dict[str, str]]]:
    """Runs of text (with an empty tag) and tags (name, whether closing, attributes) of a page, from left to right; no place is read twice."""
    at, n = 0, len(page)
    ends: dict[str, int] = {}  # where the next end of a kind is, so that a missing one is looked for once

    def find(what: str, start: int) -> int:
        if ends.get(what, 0) < start:
            k = page.find(what, start)
            ends[what] = k if k >= 0 else n + 1
        return ends[what]

    while at < n:
        lt = page.find("<", at)
        if lt < 0 or lt + 1 >= n:
            yield page[at:], "", False, {}
            return
        after = page[lt + 1]
        if after in "!?":
            if lt > at:
                yield page[at:lt], "", False, {}
            comment = page.startswith("!--", lt + 1)
            at = find("-->" if comment else ">", lt + (4 if comment else 2)) + (3 if comment else 1)
            continue
        closing = after == "/"
        m = _NAME.match(page, lt + 1 + closing)
        if m is None:
            yield page[at : lt + 1], "", False, {}
            at = lt + 1
            continue
        if lt > at:
            yield page[at:lt], "", False, {}
        tag, k, attributes = m[0].lower(), m.end(), {}
        while k < n and page[k] != ">":
            a = _ATTR.match(page, k)
            if a.end() == k:
                k += 1
                continue
            if a[1]:
                attributes.setdefault(a[1].lower(), next((g for g in a.groups()[1:] if g is not None), ""))
            k = a.end()
        if k >= n:  # a tag that the page ends in is no text
            return
        at = k + 1
        yield "", tag, closing, attributes
        if tag in RAW and not closing:
            end = at
            while True:
                end = page.find("</", end) if tag not in ends else n
                if end < 0:
                    end = n
                    break
                if end >= n or (page[end + 2 : end + 2 + len(tag)].lower() == tag and page[end + 2 + len(tag) : end + 3 + len(tag)] in (">", " ", "/", "\t", "\n", "\r", "\f", "")):
                    break
                end += 2
            if end >= n:
                ends[tag] = n + 1
                at = n if tag in ("script", "style") else at
            else:
                at = find(">", end) + 1


def _named_unwanted(value: str) -> bool:
    """Whether some whole name of an attribute's value says that this is not the article."""
    for name in value.split():
        words = [w.lower() for w in _SPLIT.split(name) if w]
        if any(w in UNWANTED_WORDS for w in words) and all(w in UNWANTED_WORDS or w in NEUTRAL_WORDS for w in words):
            return True
    return False


def _attributes(tag: str, attributes: dict[str, str]) -> tuple[str, bool]:
    """Generalised name of an element, and whether its attributes speak against it."""
    classes = ".".join(sorted({_DIGITS.sub("#", c) for c in attributes.get("class", "").split()}))
    against = "hidden" in attributes or any(_named_unwanted(attributes[k]) for k in ("class", "id", "role") if k in attributes)
    return tag + ("." + classes if classes else ""), against and tag not in ("html", "body", *ARTICLE)


def _below(path: str, name: str) -> str:
    whole = f"{path}>{name}"
    return whole if len(whole) <= PATH_LENGTH else "#" + hashlib.blake2b(whole.encode(), digest_size=16).hexdigest()


@dataclass
class _Open:
    """An open element: its container, the places on the stack of the li that another li would close and of the first part around an article, and whether it is in one."""

    tag: str
    node: Node
    li: int
    shell: int
    inside: bool


def read(page: str | None) -> list[Node]:
    """Containers of a page in page order, with their own blocks (order, text, link characters)."""
    root = Node("", "", 0, None, False, False, 0)
    nodes, stack = [root], [_Open("", root, -1, -1, False)]
    opened: dict[str, int] = {}
    parts: list[str] = []
    linked = links = order = 0

    def close_block() -> None:
        nonlocal order, linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                order += 1
                stack[-1].node.blocks.append((order, text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def pop_to(k: int) -> None:
        close_block()
        for x in stack[k:]:
            opened[x.tag] -= 1
        del stack[k:]

    for text, tag, closing, attributes in _tokens(page or ""):
        if not tag:
            parts.append(text)
            if links:
                linked += len(text)
        elif tag == "a":
            links = 0 if closing else 1
        elif tag == "br":
            parts.append(" ")
        elif tag in RAW or tag not in BLOCK and tag not in UNWANTED:
            continue
        elif closing:
            if opened.get(tag, 0):
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                pop_to(k)
            elif tag in BLOCK:
                close_block()
        elif tag in VOID:
            if tag in BLOCK:
                close_block()
        else:
            close_block()
            links = 0
            if tag in ARTICLE and stack[-1].shell >= 0:  # an unclosed menu does not swallow the article
                pop_to(stack[-1].shell)
            if tag in CLOSES_P and stack[-1].tag == "p":
                pop_to(len(stack) - 1)
            if tag == "li" and stack[-1].li >= 0:
                pop_to(stack[-1].li)
            name, marked = _attributes(tag, attributes)
            top = stack[-1]
            node = top.node
            by_tag = tag in UNWANTED or (tag == "header" and not top.inside)
            if tag in CONTAINER or by_tag or marked:
                node = Node(tag, _below(node.path, name), node.depth + 1, node, by_tag, marked, order)
                nodes.append(node)
            li = len(stack) if tag == "li" else -1 if tag in LISTS or tag in CONTAINER else top.li
            shell = top.shell if top.shell >= 0 else len(stack) if tag in SHELL else -1
            stack.append(_Open(tag, node, li, shell, top.inside or tag in ARTICLE))
            opened[tag] = opened.get(tag, 0) + 1
    close_block()
    _judge(nodes)
    return nodes


def _judge(nodes: list[Node]) -> None:
    """Which containers are unwanted, and all scores.  What a name speaks against goes unless it holds most of the page."""
    for n in reversed(nodes):
        n.size += sum(len(t) for _, t, _ in n.blocks)
        if n.parent is not None:
            n.parent.size += n.size
    whole = nodes[0].size
    for n in nodes:
        n.unwanted = (n.parent is not None and n.parent.unwanted) or n.by_tag or (n.marked and n.size * 2 <= whole)
    for n in nodes:
        own = 0.0 if n.unwanted else sum((len(t) - k) * (0.2 if k * 2 > len(t) else 1.0) for _, t, k in n.blocks)
        while own >= 1 and n is not None:
            n.score += own
            own *= OUTWARDS
            n = n.parent


def best_paths(page: str | None) -> list[tuple[str, float]]:
    """The best containers' paths with their share of the page's votes."""
    by_path: dict[str, float] = {}
    for n in read(page):
        if n.score and not n.unwanted:
            by_path[n.path] = by_path.get(n.path, 0.0) + n.score
    top = sorted(by_path.items(), key=lambda x: (-x[1], x[0]))[:VOTERS]
    total = sum(s for _, s in top)
    return [(p, s / total) for p, s in top]


def text_at(page: str | None, path: str | None) -> str:
    """Text of the containers on a path, or of the page's best container if they hold none."""
    nodes = read(page)
    text = _joined(nodes, path) if path is not None else ""
    if not text:
        good = [n for n in nodes if n.score and not n.unwanted]
        if good:
            text = _joined(nodes, max(good, key=lambda n: (n.score, -n.order)).path)
    return text


def _joined(nodes: list[Node], path: str) -> str:
    blocks: list[tuple[int, str, int]] = []
    within: set[int] = set()
    for n in nodes:  # parents come first
        if n.path == path or id(n.parent) in within:
            within.add(id(n))
            if not n.unwanted:
                blocks += n.blocks
    return "\n\n".join(t for _, t, _ in sorted(blocks))


def host_of(url: str = "url"):
    """Lower-cased host of a url column, empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def host_paths(pages: DataFrame) -> DataFrame:
    """``host, path``: the winning path of each host."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            votes: dict[tuple[str, str], float] = {}
            for h, page in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True):
                for p, s in best_paths(page):
                    votes[h, p] = votes.get((h, p), 0.0) + s
            keys = list(votes)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(votes.values()), pa.float64())], ["host", "path", "votes"])

    summed = pages.select("host", "html").mapInArrow(step, "host string, path string, votes double").groupBy("host", "path").agg(F.round(F.sum("votes"), 6).alias("votes"))
    # ties go to the longer, then the later path
    return summed.groupBy("host").agg(F.max_by("path", F.struct("votes", F.length("path"), "path")).alias("path"))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for each page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col("html").cast("string").alias("html"), host_of().alias("host"))
    winners = written(host_paths(rows))
    size = winners.agg(F.coalesce(F.sum(F.length("host") + F.length("path") + 64), F.lit(0)).alias("n")).first().n
    joined = rows.join(F.broadcast(winners) if size <= BROADCAST_BYTES else winners.hint("merge"), "host", "left")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            texts = [text_at(h, p) for h, p in zip(part.column("html").to_pylist(), part.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "path").mapInArrow(step, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
