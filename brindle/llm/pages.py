"""HTML main text by consensus host paths: pages vote for container paths, then are read along the winner."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.catalog import query
from brindle.llm.common import small
from brindle.llm.urls import host_of
from brindle.session import scratch, table

#: Nothing here is read twice: parts are possessive, and what isn't closed goes to the end of the page, as browsers take it.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^'\">]|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=\s|/|$)", re.I)
CONTAINERS = frozenset("body main article section div td center blockquote".split())
BLOCKS = CONTAINERS | frozenset("html head p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr th pre hr figure figcaption header footer nav aside form fieldset address details summary caption".split())
VOID = frozenset("br hr img input meta link source area base col embed param track wbr".split())
RAW = frozenset("script style textarea title iframe noscript template xmp noembed noframes svg select button".split())
#: Elements that never hold the article's text.
NOISE_TAGS = frozenset("head nav footer aside form".split())
#: Words of class, id and role names that mark what isn't the article.
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies "
    "disclaimer footer login menu modal nav navbar navigation newsletter notice notices popup promo promotion related search share sharing sidebar signup "
    "social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: Heads of pages, unless they stand inside an article.
HEAD_WORDS = frozenset(("header", "masthead"))
#: These are never noise by their names, nor is an element with over half of the page's text.
ROOTS = frozenset("html body main article".split())
#: A page goes along its host's path if that holds so large a part of what its own path holds.
LEAST_SHARE = 0.7
#: The part of a container's score that its parent gets too.
UP = 0.5
#: Hosts whose paths may be broadcast; with more of them pages are shuffled by host.
HOSTS = 200_000
#: Elements nested deeper than this break blocks and may be noise, but are no containers of their own.
DEEPEST = 256


class Element:
    """noise: it or an element around it is noise for sure; doubt: the innermost element with a doubtful
    name that it is or stands in; outer: the next one around that."""

    __slots__ = ("doubt", "noise", "outer", "parent", "path", "tag")

    def __init__(self, tag: str, path: str, parent: Element | None, noise: bool, outer: Element | None, doubtful: bool) -> None:
        self.tag, self.path, self.parent, self.noise, self.outer = tag, path, parent, noise, outer
        self.doubt = self if doubtful else outer


def _names(attrs: str) -> tuple[list[str], list[str], bool]:
    """Class names; words of class, id and role; whether it is hidden."""
    classes, words, hidden = [], [], False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "style":
            hidden |= "display:none" in value.replace(" ", "").lower()
        elif name == "hidden":
            hidden = True
        elif name == "aria-hidden":
            hidden |= value.lower() == "true"
        else:
            words += re.findall("[a-z]+", re.sub("([a-z])([A-Z])", r"\1 \2", value).lower())
            if name == "class":
                classes += value.lower().split()
    return classes, words, hidden


def step_of(tag: str, classes: list[str]) -> str:
    """A generalised step of a path: the tag and its classes, in order, with numbers as ``#``."""
    return ".".join([tag, *sorted({re.sub(r"\d+", "#", c) for c in classes})])


def parse(page: str) -> list[tuple[Element, str, int]]:
    """The page's text blocks in order, as (innermost element, text, characters of it in links)."""
    root = Element("", "", None, False, None, False)
    stack, out = [root], []
    doubtful: list[Element] = []
    opened: Counter[str] = Counter()
    text: list[str] = []
    linked, in_link = 0, False

    def close_block() -> None:
        nonlocal linked
        block = " ".join("".join(text).split())
        if block and not stack[-1].noise:
            out.append((stack[-1], block, linked))
        text.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            plain = html.unescape(raw)
            text.append(plain)
            linked += len(plain.strip()) * in_link

    at = 0
    while m := _TOKEN.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        closing, attrs = m["close"] or m["close2"], m["attrs"] or m["attrs2"] or ""
        if tag == "a":
            in_link = not closing
        elif tag == "br":
            close_block()
        elif tag in RAW:
            if not closing and not attrs.endswith("/"):
                end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
        elif tag not in BLOCKS:
            continue
        elif closing:
            close_block()
            if opened[tag]:
                while (last := stack.pop()).tag != tag:
                    opened[last.tag] -= 1
                opened[tag] -= 1
                in_link = False
        else:
            close_block()
            if stack[-1].tag == "p" or (stack[-1].tag == tag and tag in ("li", "dt", "dd", "tr", "td", "th")):
                opened[stack.pop().tag] -= 1
            classes, words, hidden = _names(attrs) if attrs else ([], [], False)
            up = stack[-1]
            apart = not opened["article"] and not opened["main"]
            noise = up.noise or hidden or (tag in NOISE_TAGS and tag != "form") or (tag == "header" and apart)
            named = not NOISE_WORDS.isdisjoint(words) or (apart and not HEAD_WORDS.isdisjoint(words))
            if tag in VOID:
                continue
            deep = len(stack) > DEEPEST
            own = Element(tag, stack[DEEPEST].path if deep else f"{up.path}/{step_of(tag, classes)}", stack[DEEPEST] if deep else up, noise, up.doubt, tag == "form" or (named and tag not in ROOTS))
            if own.doubt is own:
                doubtful.append(own)
            stack.append(own)
            opened[tag] += 1
    add(page[at:])
    close_block()
    return _without(out, doubtful) if doubtful else out


def _plain(text: str, linked: int) -> int:
    return max(0, len(text) - 2 * linked)


def _without(blocks: list[tuple[Element, str, int]], doubtful: list[Element]) -> list[tuple[Element, str, int]]:
    """The blocks that don't stand in an element with a doubtful name. Such a one (in the order of their
    start tags) counts as the article's if it holds over half of the page's text, unless an article or
    main element outside of it holds a tenth as much."""
    held: Counter[Element | None] = Counter()
    marked: Counter[Element | None] = Counter()  # of that, what stands in an article or main element
    total = 0
    for e, text, linked in blocks:
        n = _plain(text, linked)
        total += n
        held[e.doubt] += n
        up: Element | None = e
        while up is not None and up.tag not in ("article", "main"):
            up = up.parent
        if up is not None:
            marked[e.doubt] += n
    for d in reversed(doubtful):
        held[d.outer] += held[d]
        marked[d.outer] += marked[d]
    noise: set[Element] = set()
    for d in doubtful:
        most = 2 * held[d] > total and 10 * (marked[None] - marked[d]) < held[d]
        if d.outer in noise or not most:
            noise.add(d)
    return [b for b in blocks if b[0].doubt not in noise]


def container(e: Element) -> Element:
    while e.parent is not None and e.tag not in CONTAINERS:
        e = e.parent
    return e


def scored(blocks: list[tuple[Element, str, int]]) -> dict[str, float]:
    """Scores of the page's container paths: the characters outside links that they hold, of nested ones a
    half for each level."""
    scores: dict[str, float] = {}
    for element, text, linked in blocks:
        e, part = container(element), float(_plain(text, linked))
        seen = set()
        while e is not None and part >= 1 / 16:
            if e.path not in seen:
                seen.add(e.path)
                scores[e.path] = scores.get(e.path, 0.0) + part
            part *= UP
            e = container(e.parent) if e.parent is not None else None
    return scores


def best_path(scores: dict[str, float]) -> str | None:
    return max(scores, key=lambda p: (scores[p], p), default=None)


def _under(e: Element | None, path: str) -> Element | None:
    while e is not None and e.path != path:
        e = e.parent
    return e


def whole_path(blocks: list[tuple[Element, str, int]], path: str) -> str:
    """The path of all of the article whose largest part has ``path``: the nearest article element around
    it, else main; else the lowest container below body that holds the page's headline (h1) too, or else
    its parent, where what that adds is more text than links. A quotation is a part of what it stands in."""
    first = next((e for b in blocks if (e := _under(b[0], path)) is not None), None)
    if first is None:
        return path
    while first.tag == "blockquote" and first.parent is not None:
        first = container(first.parent)
    around = []
    e: Element | None = first
    while e is not None and e.tag not in ("", "html", "body"):
        if e.tag in CONTAINERS:
            around.append(e)
        e = e.parent
    for tag in ("article", "main"):
        for e in around:
            if e.tag == tag:
                return e.path
    heads = [b[0] for b in blocks if b[0].tag == "h1"]
    for e in around:
        if any(_under(h, e.path) is not None for h in heads):
            return e.path
    if len(around) > 1:
        more = [b for b in blocks if _under(b[0], first.path) is None and _under(b[0], around[1].path) is not None]
        if sum(_plain(text, linked) for _, text, linked in more) > sum(linked for _, _, linked in more):
            return around[1].path
    return first.path


def main_text(page: str | None, path: str | None = None) -> str:
    """The page's main text along ``path``, or along its own path where that one is missing or poor."""
    blocks = parse(page or "")
    own = best_path(scored(blocks))
    if own is None:
        return ""
    own = whole_path(blocks, own)
    held = lambda p: sum(_plain(text, linked) for e, text, linked in blocks if _under(e, p) is not None)
    if path is None or (path != own and held(path) < max(1, LEAST_SHARE * held(own))):
        path = own
    return "\n".join(text for e, text, _ in blocks if _under(e, path) is not None)


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, paths, scores = [], [], []
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            blocks = parse(page or "")
            found = scored(blocks)
            best = best_path(found)
            if best is not None and found[best]:
                hosts.append(host)
                paths.append(whole_path(blocks, best))
                scores.append(found[best] / sum(found.values()))
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(scores, pa.float64())], names=["host", "path", "score"])


def consensus_paths(pages: DataFrame) -> DataFrame:
    """(host, path): of each host the container path with the most votes of its pages (``url``, ``html``),
    each page's vote counting as its best path's part of all scores. Ties go to the first path."""
    votes = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(_votes, "host string, path string, score double")
    votes = votes.groupBy("host", "path").agg(F.count("*").alias("pages"), F.sum(F.round("score", 6)).alias("score"))
    return votes.groupBy("host").agg(F.min_by("path", F.struct(-F.round("score", 3), "path")).alias("path"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """Add ``text`` to ``pages(url, html, ...)``: the main text of each page, read along its host's path.

    A null or empty page, or one without any text, gives an empty text; a null URL, or one without
    ``://``, belongs to the host with the empty name; repeated rows are read each; an empty table stays
    empty; a column named text is replaced. Pages are read whole.
    """
    pages = pages.drop("text")
    paths = small(scratch(consensus_paths(pages), "page-paths"), HOSTS)
    named = pages.withColumn("_host", host_of(F.col("url"))).join(paths.select(F.col("host").alias("_host"), F.col("path").alias("_path")), "_host", "left")
    keep = pages.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, path) for page, path in zip(batch.column("html").to_pylist(), batch.column("_path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, "text"])

    return named.select(*keep, "_path").mapInArrow(run, pages.withColumn("text", F.lit("")).schema)


@query("op4_html_extraction")
def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extract the main text of every page."""
    found = extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
