"""Main text of web pages by tag-path ratios.

A page is read as a stream of tags and text. Each text node belongs to its
root-to-leaf tag path (tag names, with class and id words). For each path are
summed: characters of text, punctuation marks, characters inside links, and
the number of nodes. Two ratios are taken, text per node and punctuation per
node; both are smoothed over the paths in page order (a Gaussian window), so
that a short paragraph between long ones is held with them, and fused by their
product with the share of text outside links. Paths above a share of the
page's mean are content.

The content paths fix the region: all ``article`` elements that hold content,
if together they hold nearly all of it; else the ``main`` elements, if they
hold most; else the smallest subtree with nearly all of it. Inside an article
or main element everything is main text but boilerplate parts; elsewhere in
the smallest common ancestor of the region, only content paths are.

Boilerplate parts: menus, headers and footers of the page, sidebars, notices,
adverts, forms, scripts, styles, reader comments. They are known by element,
role and hidden state, or by the name of the part in class or id, if all words
there are names of parts or say nothing (``cookie-notice``, ``site-footer``, but
not ``social-history``). The ratios come before the names: neither a name nor
being a form rules out an element that holds the page's title (``h1``) or
``main``, or nearly all content of a page that marks none; and weak names (legal,
search and the like; outside a marked region also those of parts among other
words) rule out only what the ratios hold no content.

Text: character references are decoded, white space inside a block becomes one
space, blocks are trimmed and joined in page order by one space.

Defined results. Null or empty html, or a page without content: the empty
text. Unclosed and stray tags are allowed; a ``p`` ends at the next block.
Nesting of any depth takes linear time. Repeated rows each get a row. Extra
columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .base import columns_as

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"
    # a quote counts only behind an equals sign; one that is never closed ends with the tag
    r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*)?)*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=>/\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*))?")
_NAME_WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。！？、，；：¿¡]")
_SPACE = re.compile(r"\s+")

#: Fixed values of HTML: elements without content, with raw content, and those that end a paragraph or a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCK - frozenset("br body html td th caption option".split())
#: An open element of the key's kind ends where one of the values starts.
ENDS_SAME = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
#: Elements and roles that never hold main text.
NEVER = frozenset("head script style nav footer aside form noscript template iframe svg math object button select textarea input label fieldset dialog menu canvas audio video map".split())
NEVER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
#: Names of parts beside the main text, names that say so only where the ratios agree, and names of articles that are remarks or adverts.
PART_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promotion promoted nav navbar navigation menu menus breadcrumb breadcrumbs "
    "sidebar footer footnav masthead topbar toolbar cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login share sharing "
    "social related recommended comment comments commentlist respond disqus replies reply pager pagination".split()
)
#: Words that say what kind of element a part is, not what it holds.
HELPERS = frozenset(
    "site page main top bottom left right upper lower global primary secondary wrap wrapper container box bar block section area inner outer content list item items text title body header heading head row col "
    "column panel group unit slot zone module region holder reader user users visitor post article blog thread form button buttons icon icons link links image img media inline sticky fixed mobile desktop small large".split()
)
WEAK_NAMES = frozenset("pageno copyright legal disclaimer widget tags tagcloud skip search".split())
ARTICLE_NAMES = frozenset("ad ads advert advertisement sponsored promo comment comments reply replies".split())
REGION_ROLES = frozenset(("main", "article"))
#: Width of the smoothing window, the share of the mean from which a path is content, and the shares of the content that make a region.
SIGMA, SHARE, NEARLY_ALL, MOST = 1.0, 0.5, 0.9, 0.5
OPEN, WEAK, NAMED, NEVER_SHOWN = range(4)


@dataclass
class Node:
    tag: str
    path: int  # number of the tag path
    parent: int
    doubt: int  # OPEN, WEAK, NAMED or NEVER_SHOWN
    kind: str  # "article", "main" or ""
    in_region: bool
    link: bool


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=list)
    texts: list[tuple[int, int, str]] = field(default_factory=list)  # node, block number, text
    paths: dict[tuple[int, str], int] = field(default_factory=dict)  # (number of the path above, name) to number


def _attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        value = m[2] or ""
        found.setdefault(m[1].lower(), value[1:-1] if value[:1] in ("'", '"') else value)  # the first of equal names counts
    return found


def _doubt(tag: str, found: dict[str, str], in_region: bool) -> int:
    if tag in NEVER or (tag == "header" and not in_region):
        return NEVER_SHOWN
    if not found:
        return OPEN
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")):
        return NEVER_SHOWN
    role = found.get("role", "").lower()
    if role in NEVER_ROLES:
        return NEVER_SHOWN
    if tag in ("main", "body", "html") or role == "main":
        return OPEN
    names = [[w.lower() for w in _NAME_WORDS.findall(token) if len(w) > 1] for key in ("class", "id") for token in found.get(key, "").split()]
    if tag == "article" or role == "article":
        return NAMED if _named(names, ARTICLE_NAMES) else OPEN
    words = {w for name in names for w in name}
    if _named(names, PART_NAMES):
        return NAMED
    return WEAK if words & WEAK_NAMES or (words & PART_NAMES and not in_region) else OPEN


def _named(names: list[list[str]], parts: frozenset[str]) -> bool:
    """Whether class and id say that an element is such a part: one name does, and none says that it holds something else."""
    plain = PART_NAMES | WEAK_NAMES | HELPERS
    return any(parts & set(name) for name in names) and all(w in plain for name in names for w in name)


def parse(page: str) -> Page:
    """Elements with their tag paths, and text nodes in page order with the block that each belongs to."""
    out = Page()
    out.nodes.append(Node("", 0, -1, OPEN, "", False, False))
    stack = [0]
    opened: Counter[str] = Counter()  # open elements by tag, so that a search that must fail is not begun
    block, at, skip_to = 0, 0, -1

    def close(k: int) -> None:
        for node in stack[k:]:
            opened[out.nodes[node].tag] -= 1
        del stack[k:]

    for match in _TAG.finditer(page):
        start, stop = match.span()
        if start < skip_to:
            continue
        if start > at:
            out.texts.append((stack[-1], block, page[at:start]))
        at = stop
        tag = match[2]
        if tag is None:
            continue
        tag = tag.lower()
        if match[1]:
            if tag in BLOCK:
                block += 1
            if opened[tag]:
                k = len(stack) - 1
                while out.nodes[stack[k]].tag != tag:
                    k -= 1
                close(k)
            continue
        if tag in BLOCK:
            block += 1
        if tag in ENDS_P and opened["p"]:
            for k in range(len(stack) - 1, 0, -1):
                open_tag = out.nodes[stack[k]].tag
                if open_tag == "p":
                    close(k)
                    break
                if open_tag in BLOCK:
                    break
        if tag in ENDS_SAME:
            alike = ("td", "th") if tag in ("td", "th") else ("dd", "dt") if tag in ("dd", "dt") else (tag,)
            if any(opened[t] for t in alike):
                for k in range(len(stack) - 1, 0, -1):
                    open_tag = out.nodes[stack[k]].tag
                    if open_tag in alike:
                        close(k)
                        break
                    if open_tag in ENDS_SAME[tag]:
                        break
        if tag in VOID:
            continue
        parent = out.nodes[stack[-1]]
        found = _attributes(match[3])
        role = found.get("role", "").lower()
        kind = tag if tag in ("article", "main") else role if role in REGION_ROLES else ""
        name = tag + "".join(f".{found[k]}" for k in ("class", "id") if found.get(k))
        path = out.paths.setdefault((parent.path, name), len(out.paths) + 1)
        out.nodes.append(Node(tag, path, stack[-1], _doubt(tag, found, parent.in_region), kind, parent.in_region or kind != "", parent.link or tag == "a"))
        node = len(out.nodes) - 1
        if tag in RAW:
            if not match[3].rstrip().endswith("/"):
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, stop)
                if tag == "title" or tag in NEVER or end:
                    at = skip_to = end.end() if end else len(page)
            continue
        if not match[3].rstrip().endswith("/") or tag not in ("svg", "math"):
            stack.append(node)
            opened[tag] += 1
    if at < len(page):
        out.texts.append((stack[-1], block, page[at:]))
    return out


def wrappers(page: Page) -> list[bool]:
    """For each element: whether the page's content stands in it, so that its name or being a form says nothing.

    So it is if it holds the page's title or ``main``, or nearly all content by
    the ratios of all tag paths, with no marked content (``article``) beside it.
    """
    holds_title = [n.tag in ("h1", "main") or n.kind == "main" for n in page.nodes]
    marked = [n.kind == "article" and n.doubt == OPEN for n in page.nodes]
    visible = [True]
    for node in page.nodes[1:]:
        visible.append(visible[node.parent] and not (node.doubt == NEVER_SHOWN and node.tag != "form"))
    texts = [t for t in page.texts if visible[t[0]]]
    chosen = content_paths(path_sums(page, texts))
    weight = [0.0] * len(page.nodes)
    for node, _, text in texts:
        if page.nodes[node].path in chosen:
            weight[node] += len(text.strip())
    for k in range(len(page.nodes) - 1, 0, -1):  # parents stand before their children
        parent = page.nodes[k].parent
        weight[parent] += weight[k]
        holds_title[parent] = holds_title[parent] or holds_title[k]
        marked[parent] = marked[parent] or marked[k]
    whole = [weight[0] > 0 and w >= NEARLY_ALL * weight[0] and (marked[k] or not marked[0]) and not holds_title[0] for k, w in enumerate(weight)]
    return [a or b for a, b in zip(holds_title, whole, strict=True)]


def shown(page: Page) -> tuple[list[bool], list[bool]]:
    """For each element: whether it is in no boilerplate part, and whether it is in a part with a weak name."""
    holds_title = wrappers(page)
    open_, weak = [True], [False]
    for k, node in enumerate(page.nodes[1:], 1):
        out = node.doubt == NEVER_SHOWN and not (node.tag == "form" and holds_title[k]) or (node.doubt == NAMED and not holds_title[k])
        open_.append(open_[node.parent] and not out)
        weak.append(weak[node.parent] or (node.doubt == WEAK and not holds_title[k]))
    return open_, weak


def _smoothed(values: list[float]) -> list[float]:
    reach = int(3 * SIGMA)
    kernel = [math.exp(-(k * k) / (2 * SIGMA * SIGMA)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for k, w in enumerate(kernel, i - reach):
            if 0 <= k < len(values):
                total, weight = total + w * values[k], weight + w
        out.append(total / weight)
    return out


def path_sums(page: Page, texts: list[tuple[int, int, str]]) -> dict[int, list[float]]:
    """For each tag path, in page order: characters, punctuation marks, characters inside links, and text nodes."""
    sums: dict[int, list[float]] = {}
    for node, _, text in texts:
        of = page.nodes[node]
        n = len(text.strip())
        if n:
            s = sums.setdefault(of.path, [0.0, 0.0, 0.0, 0.0])
            s[0] += n
            s[1] += len(_PUNCTUATION.findall(text))
            s[2] += n * of.link
            s[3] += 1
    return sums


def content_paths(sums: dict[int, list[float]]) -> set[int]:
    """The tag paths whose smoothed, fused ratios pass the threshold."""
    if not sums:
        return set()
    text_ratio = _smoothed([s[0] / s[3] for s in sums.values()])
    mark_ratio = _smoothed([s[1] / s[3] for s in sums.values()])
    fused = [t * (1.0 + m) * (1.0 - s[2] / s[0]) for t, m, s in zip(text_ratio, mark_ratio, sums.values(), strict=True)]
    least = SHARE * sum(fused) / len(fused)
    return {path for path, value in zip(sums, fused, strict=True) if value >= least and value > 0}


def _region(page: Page, weight: list[float], total: float) -> tuple[list[int], int]:
    """The article or main elements that are main text as a whole, and the smallest element that holds all content to be looked at."""
    found: dict[str, list[int]] = {"article": [], "main": []}
    inside: list[set[str]] = [set()]
    for k, node in enumerate(page.nodes[1:], 1):
        above = inside[node.parent]
        if node.kind and weight[k] > 0 and node.kind not in above:
            found[node.kind].append(k)
            above = above | {node.kind}
        inside.append(above)
    for kind, least in (("article", NEARLY_ALL), ("main", MOST), ("article", MOST)):
        if sum(weight[k] for k in found[kind]) >= least * total:
            held = sum(weight[k] for k in found[kind])
            return found[kind], max(k for k in range(len(weight)) if weight[k] >= held) if len(found[kind]) > 1 else found[kind][0]
    best = max(k for k in range(len(weight)) if weight[k] >= NEARLY_ALL * total)
    while page.nodes[best].tag and page.nodes[best].tag not in ("div", "section", "td", "body", "html", "main", "article", "center"):
        best = page.nodes[best].parent
    return [], best


def extract(page_html: str) -> str:
    """The main text of one page."""
    page = parse(page_html)
    open_, weak = shown(page)
    open_texts = [t for t in page.texts if open_[t[0]]]
    chosen = content_paths(path_sums(page, open_texts))
    if not chosen:
        return ""
    weight = [0.0] * len(page.nodes)
    for node, _, text in open_texts:
        if page.nodes[node].path in chosen:
            weight[node] += len(text.strip())
    for k in range(len(weight) - 1, 0, -1):
        weight[page.nodes[k].parent] += weight[k]
    whole, around = _region(page, weight, weight[0])
    kept_parents = {page.nodes[n].parent for n, _, _ in open_texts if page.nodes[n].path in chosen} if not whole else set()
    in_whole, in_around = [False], [around == 0]
    marked = set(whole)
    for k, node in enumerate(page.nodes[1:], 1):
        in_whole.append(in_whole[node.parent] or k in marked)
        in_around.append(in_around[node.parent] or k == around)

    lead: set[int] = set()
    if not whole and around:
        above = page.nodes[around].parent
        side = [0] * len(page.nodes)  # the child of the region's parent that an element is in
        for k, node in enumerate(page.nodes[1:], 1):
            side[k] = k if node.parent == above else side[node.parent] if k > above else 0
        lead = {k for k in range(1, around) if side[k] and side[k] != around and page.nodes[k].tag == "p" and not page.nodes[k].link}

    def kept(node: int) -> bool:
        of = page.nodes[node]
        content = of.path in chosen
        if weak[node] and not content:
            return False
        if whole:
            return in_whole[node] or (in_around[node] and content)
        # without a marked region: content paths, what shares their element, and a lead before the region
        if node in lead:
            return content
        return in_around[node] and (content or not (of.link or (of.parent not in kept_parents and node not in kept_parents)))

    blocks: list[str] = []
    last = None
    for node, block, text in open_texts:
        if not kept(node):
            continue
        if block == last:
            blocks[-1] += text
        else:
            blocks.append(text)
            last = block
    cleaned = (_SPACE.sub(" ", html.unescape(b) if "&" in b else b).strip() for b in blocks)
    return " ".join(b for b in cleaned if b)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: the main text of each page."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h) if h else "" for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=schema)

    return columns_as(pages, page_id="bigint", url="string", html="string").mapInArrow(rows_of, "page_id long, url string, text string, n_chars long")
