"""Main text of pages by a site style tree: what a site repeats is noise."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from textlab.llm.common import slices
from textlab.operators.joins import lookup_join
from textlab.sources.sinks import materialise

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>", re.S)
_CLASS = re.compile(r"(?:\A|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
# Kinds of elements.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe xmp".split())
_RAW_END = {tag: re.compile(f"</{tag}\\b[^>]*>", re.I) for tag in _RAW}
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
_SAME_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("ul ol dl table select body html div article section".split())
# Elements that are presentation by their name, and words that name such parts.
_NOISE_TAGS = frozenset("head nav footer aside form button select menu dialog svg canvas object audio video script style noscript template iframe textarea title".split())
_NOISE_WORDS = frozenset(
    """
    ad ads advert adverts advertisement advertising banner sponsor sponsored promo sidebar menu nav navbar navigation
    breadcrumb breadcrumbs footer masthead topbar cookie cookies consent notice notices popup modal newsletter subscribe
    share sharing social related recommended comment comments disqus replies pagination pager toolbar search login signup
    complementary contentinfo skip
    """.split()
)
_MAIN_TAGS = frozenset(("article", "main"))
_MAIN_WORDS = frozenset(("main", "article"))
# Words that say where or in what form such a part is, and tags whose names are a heading's or paragraph's own.
_FORM_WORDS = frozenset(
    "main site page user global top bottom left right header inner outer box bar block area section widget wrapper wrap container content body links list item items row col column slot unit".split()
)
_PROSE = frozenset("h1 h2 h3 h4 h5 h6 p".split())
MAX_DEPTH = 64


class Element(NamedTuple):
    tag: str
    node: int  # key of the path of tags and classes
    noise: bool
    main: bool


class Page(NamedTuple):
    blocks: list[tuple[str, list[Element]]]  # text and the elements around it, outermost first
    children: dict[int, list[str]]  # node -> kinds of its children, runs as one


def _key(parent: int, tag: str, names: list[str]) -> int:
    label = f"{parent}>{tag}." + ".".join(re.sub(r"\d{3,}", "0", n) for n in sorted(names))
    return xxhash.xxh64_intdigest(label) >> 1


def _names(name: str, words: frozenset[str]) -> bool:
    """Whether a whole class or id names such a part: one of ``words``, and else only words of form."""
    parts = [w for w in re.split(r"[^a-z]+", name.lower()) if w]
    return any(w in words for w in parts) and all(w in words or w in _FORM_WORDS for w in parts)


def parse(source: str | None) -> Page:
    """Blocks of text in page order and the style tree's nodes of one page.

    Unclosed elements end where the next block, list item or cell begins, or with their
    parent. Elements below depth 64 count as part of the one there.
    """
    source = source or ""
    stack = [Element("", 0, False, False)]
    blocks: list[tuple[str, list[Element]]] = []
    children: dict[int, list[str]] = {}
    held: list[str] = []
    at, n = 0, len(source)

    def flush():
        if held:
            raw = "".join(held)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            held.clear()
            if text:
                blocks.append((text, [e for e in stack if e.tag not in _INLINE]))

    def pop_to(depth: int):
        if any(e.tag not in _INLINE for e in stack[depth:]):
            flush()
        del stack[depth:]

    while at < n:
        m = _TAG.search(source, at)
        if m is None:
            held.append(source[at:])
            break
        if m.start() > at:
            held.append(source[at : m.start()])
        at = m.end()
        closing, tag, attributes = m.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if closing:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if depth:
                pop_to(depth)
            elif tag not in _INLINE:
                flush()
            continue
        if tag == "br":
            held.append(" ")
        if tag in _RAW:
            end = _RAW_END[tag].search(source, at)
            at = end.end() if end else n
            continue
        closes = ("p",) if tag in _CLOSES_P else _SAME_CLOSES.get(tag, ())
        if closes:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in closes:
                    pop_to(i)
                    break
                if stack[i].tag in _SCOPE:
                    break
        if tag not in _INLINE:
            flush()
        if tag in _VOID or attributes.endswith("/"):
            continue
        names = []
        if "class" in attributes or "id" in attributes or "role" in attributes:
            for _, *value in _CLASS.findall(attributes):
                names += "".join(value).split()
        parent = stack[-1]
        if tag in _INLINE or len(stack) > MAX_DEPTH:
            node = parent.node
        else:
            node = _key(parent.node, tag, names)
            kinds = children.setdefault(parent.node, [])
            if not kinds or kinds[-1] != tag:
                kinds.append(tag)
            children.setdefault(node, [])
        main = parent.main or tag in _MAIN_TAGS or any(_names(name, _MAIN_WORDS) for name in names)
        telling = tag not in ("html", "body", *_MAIN_TAGS) and not (parent.main and tag in _PROSE)
        noise = tag in _NOISE_TAGS or (tag == "header" and not parent.main) or (telling and any(_names(name, _NOISE_WORDS) for name in names))
        stack.append(Element(tag, node, noise, main))
    flush()
    return Page(blocks, children)


def observations(pages: DataFrame) -> DataFrame:
    """(host, node, kind, value, n): on how many of the host's pages a node has a style (kind 0:
    the order of its children's tags) or a text somewhere below it (kind 1), counted per batch."""

    def run(batches):
        for batch in slices(batches, 1_000):
            counts: dict[tuple, int] = {}
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                page = parse(source)
                seen = {(host, node, 0, xxhash.xxh64_intdigest(",".join(kinds)) >> 1) for node, kinds in page.children.items()}
                for text, around in page.blocks:
                    value = xxhash.xxh64_intdigest(text) >> 1
                    seen.update((host, e.node, 1, value) for e in around)
                for key in seen:
                    counts[key] = counts.get(key, 0) + 1
            columns = list(zip(*counts)) or [(), (), (), ()]
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.record_batch([*arrays, pa.array(list(counts.values()), pa.int64())], ["host", "node", "kind", "value", "n"])

    rows = pages.select("host", "html").mapInArrow(run, "host string, node long, kind int, value long, n long")
    return rows.groupBy("host", "node", "kind", "value").agg(F.sum("n").alias("n"))


def importance(seen: DataFrame, *keys: str, gamma: float = 0.9):
    """Importance of each node of the merged tree, 0 (the same on all pages) to 1, and its pages.

    Presentation: entropy of the styles over the m pages of the node, to the base m. Content: one
    less the mean entropy of the texts below it, over all their occurrences; a text on n pages
    has log n / log m. The more styles a node has, the more the first one counts, as gamma to the power of them.
    """
    style, text = F.col("kind") == 0, F.col("kind") == 1
    log_n = F.log("n")
    node = seen.groupBy(*keys, "node").agg(
        F.sum(F.when(style, F.col("n"))).alias("m"),
        F.sum(F.when(style, F.col("n") * log_n)).alias("n_log_n"),
        F.count_if(style).alias("styles"),
        F.sum(F.when(text, F.col("n"))).alias("texts"),
        F.sum(F.when(text, F.col("n") * log_n)).alias("log_texts"),
    )
    log_m = F.log("m")
    presentation = (log_m - F.col("n_log_n") / F.col("m")) / log_m
    content = 1 - F.coalesce(F.col("log_texts") / F.col("texts"), F.lit(0.0)) / log_m
    weight = F.pow(F.lit(gamma), F.col("styles"))
    value = F.when(F.col("m") > 1, (1 - weight) * presentation + weight * content).otherwise(1.0)
    return node.where("m is not null").select(*keys, "node", "m", value.alias("importance"))


def noise_nodes(pages: DataFrame, least: float = 0.4, prior_pages: float = 3.0) -> DataFrame:
    """(host, noise array<long>, firm array<long>): the nodes of each host's style tree below ``least``.

    A node seen on few pages of its host leans on the tree of all hosts, which counts as
    ``prior_pages`` pages. ``firm`` nodes stay below ``least`` when as many pages more speak for
    importance 1, the prior of what lies in an article or main part. Texts are counted per task before they are shuffled, so a hot host is
    split; what meets in a host's row is its distinct paths, not its pages.
    """
    seen = materialise(observations(pages), "style-tree")
    own = importance(seen, "host")
    everywhere = importance(seen.groupBy("node", "kind", "value").agg(F.sum("n").alias("n"))).select(
        "node", F.col("importance").alias("all_importance"), F.col("m").alias("all_m")
    )
    # pages beyond the host's own are what the tree of all hosts can add
    prior = F.when(F.col("all_m") > F.col("m"), F.lit(prior_pages)).otherwise(0.0)
    told = F.col("m") - 1 + prior
    blended = F.when(told > 0, ((F.col("m") - 1) * F.col("importance") + prior * F.col("all_importance")) / told).otherwise(1.0)
    firm = (told * blended + prior_pages) / (told + prior_pages) < least
    low = own.join(everywhere, "node").where((blended < least) & (F.col("node") != 0))
    return low.groupBy("host").agg(F.collect_list("node").alias("noise"), F.collect_list(F.when(firm, F.col("node"))).alias("firm"))


def main_text(source: str | None, low: set[int], firm: set[int] = frozenset()) -> str:
    """Blocks outside noise, joined by line breaks. Parts called navigation, footer, advert and the
    like are noise. In an article or main part only ``firm`` nodes are, and none where the
    part as a whole is what the site repeats: then it is a copy, not boilerplate in a text."""
    kept = []
    for text, around in parse(source).blocks:
        inner = [e.node for e in around if e.main]
        repeated = inner and inner[0] not in low and any(n in firm for n in inner)
        if not repeated and not any(e.noise or (e.node in low and not e.main) for e in around):
            kept.append(text)
    return "\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every row of ``pages``; columns besides page_id, url, html are not read.

    A null html counts as empty and has an empty text. The site is the url's host; pages with a null url
    or one without a host are one site. Repeated rows give repeated results and count as often. An
    empty table gives none.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "://([^/?#]*)", 1))
    sited = pages.select("page_id", "url", "html", host.alias("host"))
    # pages stay where they are while the table of hosts is small enough to be broadcast
    known = lookup_join(sited, noise_nodes(sited), ["host"], "left").select("page_id", "url", "html", "noise", "firm")

    def run(batches):
        for batch in slices(batches):
            columns = (batch.column(k).to_pylist() for k in (2, 3, 4))
            texts = [main_text(source, set(low or ()), set(firm or ())) for source, low, firm in zip(*columns)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kind = dict(pages.dtypes)["page_id"]
    return known.mapInArrow(run, f"page_id {kind}, url string, text string")
