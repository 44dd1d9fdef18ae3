"""HTML extraction: the main text of pages, with what a site repeats on many pages taken out.

Pages are read as trees of elements. Site template removal comes first, on the whole tree: each element's subtree is
hashed, Spark counts the pages of a host that hold each hash, and subtrees that recur on many of them are deleted. A
subtree has two hashes: one of its words, and one of its shape, in which texts and digits are masked and repeated parts
count once. A menu that is filled anew on each page recurs by its shape; only subtrees whose text is mostly links and
that lie outside of articles go by that. Inside an article text blocks are no template, as articles may quote the same passage; containers in it may be. What a
site fills anew on each page without links has no recurring subtree: menus, headers, footers, sidebars, notices, adverts, forms,
comments and scripts also go by their tags, roles, and classes or ids that consist of the words for such parts. Last,
where a page marks articles or a main element, what is outside goes.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import map_columns, set_aside
from .staging import Staging, small_batches

MIN_PAGES = 5  # pages of a host that a template is on at least
MIN_SHARE = 0.2  # share of the host's pages
MOST_KEYS = 4_000_000  # hashes of templates (8 bytes each) up to which they are broadcast; more are joined by a shuffle

# Fixed values of HTML and of common page layouts.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe noembed noframes textarea title xmp".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
_CLOSES_P = _BLOCK - frozenset("body caption dd dt html legend li tbody td tfoot th thead title tr".split())
_DROPPED = frozenset("nav header footer aside form script style noscript template iframe svg canvas object button select input textarea dialog menu head title math audio video noembed noframes".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_TEXT_BLOCKS = _HEADINGS | frozenset("p li blockquote pre td th tr table tbody thead ul ol dl dt dd figure figcaption b i em strong a span code br caption sub sup u s small mark q cite abbr time".split())
_INLINE = frozenset("b i em strong a span code br sub sup u s small mark q cite abbr time".split())
_BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation navi menu topbar toolbar header masthead footer sidebar aside rail widget widgets breadcrumb breadcrumbs pagination pager "
    "cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login social share sharing comment comments disqus replies reply respond related recommended recommendations copyright search skip".split()
)
#: Words that stand beside those in names of classes and ids.
_NEUTRAL = frozenset("site page main top bottom left right global primary secondary user users reader readers visitor post posts article articles entry entries news content list lists item items box bar block section sections wrapper wrap container area link links button buttons icon icons field group inner outer row col column unit slot panel text title head body js is has".split())
_TITLES = frozenset("header masthead banner".split())  # inside an article these hold its title
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z", re.DOTALL)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)
_PARTS = re.compile(r"[^a-z]+")
_MASKED = re.compile(r"\d+")
#: Of those words the ones for what readers add, which may be articles of their own.
_REMARKS = frozenset("comment comments disqus replies reply respond".split())


class Element:
    """inside: in an article or main element; within: in an article; holds: has an article or main in it; articles: how many
    outermost articles; key, shape, chars, links: see survey."""

    __slots__ = ("articles", "attributes", "chars", "children", "holds", "inside", "key", "links", "shape", "tag", "within")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes = tag, attributes
        self.children: list[Element | str] = []
        self.key, self.shape, self.chars, self.links, self.articles = 0, 0, 0, 0, 0
        self.inside, self.within, self.holds = False, False, False


def _closed_by(tag: str, opened: str) -> bool:
    """Whether an open element ends where the tag begins."""
    if opened == "p":
        return tag in _CLOSES_P
    if opened == "li":
        return tag == "li"
    if opened in ("dt", "dd"):
        return tag in ("dt", "dd")
    if opened in ("td", "th"):
        return tag in ("td", "th", "tr", "tbody", "tfoot", "thead")
    if opened == "tr":
        return tag in ("tr", "tbody", "tfoot", "thead")
    return opened == "option" and tag in ("option", "optgroup") or opened == "head" and tag == "body"


_SCOPES = frozenset("html body table ul ol dl div section article main td th".split())


def parse(source: str) -> Element:
    root = Element("#page")
    stack = [root]
    at = 0
    raw: str | None = None
    for m in _TOKEN.finditer(source):
        if m.start() < at:
            continue
        if m.start() > at:
            stack[-1].children.append(html.unescape(source[at : m.start()]))
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            if m[0].startswith("<![CDATA["):
                stack[-1].children.append(m[0][9:].removesuffix("]]>"))
            continue
        tag, closing, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in ("article", "main", "body") and tag not in ("body", "html", "main"):
                    break
            continue
        for k in range(len(stack) - 1, 0, -1):
            if _closed_by(tag, stack[k].tag):
                del stack[k:]
                break
            if stack[k].tag in _SCOPES and not (stack[k].tag in ("td", "th") and tag in ("tr", "td", "th")):
                break
        node = Element(tag, attributes)
        stack[-1].children.append(node)
        if tag in _RAW:
            end = re.compile(f"</{tag}\\s*>", re.IGNORECASE).search(source, at)
            at = end.end() if end else len(source)
        elif tag not in _VOID and not attributes.endswith("/"):
            stack.append(node)
    if at < len(source):
        stack[-1].children.append(html.unescape(source[at:]))
    return root


def elements(page: Element) -> list[Element]:
    """All elements in page order, however deep."""
    out, stack = [], [page]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(c for c in reversed(node.children) if not isinstance(c, str))
    return out


def survey(page: Element) -> list[Element]:
    """All elements in page order, each with what it is in, what it holds, how many characters of text it has, how many of
    them in links, and its key: a hash of its tag, its text and its children's keys; 0 without any text; and its shape: a
    hash of its tag, its class and id without digits, and the shapes of its children, runs of equal ones once."""
    every = elements(page)
    for node in every:
        inside, within = node.inside or node.tag in ("article", "main"), node.within or node.tag == "article"
        for c in node.children:
            if not isinstance(c, str):
                c.inside, c.within = inside, within
    for node in reversed(every):
        h, some = xxhash.xxh64(node.tag), False
        named = sorted((n.lower(), _MASKED.sub("", "".join(v).lower())) for n, *v in _ATTRIBUTE.findall(node.attributes)) if node.attributes else []
        shape, last = xxhash.xxh64(f"{node.tag} {named}", seed=1), None
        for c in node.children:
            if isinstance(c, str):
                text = " ".join(c.split())
                if text:
                    h.update(b"\0" + text.encode("utf-8", "surrogatepass"))
                    some = True
                    node.chars += len(text)
                now = 0 if text else last
            else:
                node.holds |= c.holds or c.tag in ("article", "main")
                node.articles += 1 if c.tag == "article" else c.articles
                node.chars += c.chars
                node.links += c.chars if c.tag == "a" else c.links
                if c.key:
                    h.update(b"\1" + c.key.to_bytes(8, "little"))
                    some = True
                now = c.shape
            if now != last:
                shape.update(now.to_bytes(8, "little"))
                last = now
        node.key = h.intdigest() if some else 0
        node.shape = shape.intdigest()
    return every


def _linked(node: Element) -> bool:
    """Whether links are most of an element's text and it lies outside of articles."""
    return not node.inside and 2 * node.links > node.chars


def candidates(every: list[Element]) -> Iterator[Element]:
    """Elements that a template may delete; never a part of a line."""
    for c in every:
        if c.key and c.tag not in _INLINE and not c.holds and c.tag not in ("#page", "html", "body", "article", "main") and not (c.inside and c.tag in _TEXT_BLOCKS):
            yield c


def _named(value: str, titles: bool, of: frozenset[str] = _BOILERPLATE) -> bool:
    """Whether a class or an id is made of words for boilerplate."""
    for name in value.split():
        parts = [p for p in _PARTS.split(name) if p]
        words = [p for p in parts if p in of and not (titles and p in _TITLES)]
        if words and all(p in words or p in _NEUTRAL for p in parts):
            return True
    return False


def is_boilerplate(node: Element, articles: int = 0) -> bool:
    """Whether its marks say so. What holds articles that are in no other is none, but for readers' remarks; articles: how
    many the page has, of which remarks do not hold all."""
    if node.tag in ("#page", "html", "body", "main"):
        return False
    title = node.inside or node.tag == "article"
    found, remarks = node.tag in _DROPPED and not (title and node.tag == "header"), False
    if node.attributes:
        for name, *values in _ATTRIBUTE.findall(node.attributes):
            value, name = "".join(values).lower(), name.lower()
            if name in ("class", "id"):
                found |= _named(value, title)
                remarks |= _named(value, title, _REMARKS)
            elif name == "role":
                found |= value.strip() in _ROLES
            else:
                found |= name == "hidden" or value == "true"
    return found and (node.tag == "article" or node.within or not node.holds or remarks and node.articles < articles)


def take_out(every: list[Element], gone: Callable[[Element], bool]) -> None:
    for node in every:
        node.children = [c for c in node.children if isinstance(c, str) or not gone(c)]


def _prose_beside(main: Element) -> bool:
    """Whether a main element has paragraphs, that are not mostly links, outside of its articles."""
    stack = list(main.children)
    while stack:
        node = stack.pop()
        if isinstance(node, str) or node.tag == "article":
            continue
        if node.tag in ("p", "blockquote", "pre") and 2 * node.links < node.chars:
            return True
        stack.extend(node.children)
    return False


def roots(page: Element) -> list[Element]:
    """The outermost articles, or a main element that has prose beside its own; else the outermost main elements, else the
    page."""
    for tags in (("article",), ("main",)):
        found, stack = [], [page]
        while stack:
            node = stack.pop()
            if node.tag in tags or node.tag == "main" and node.articles and _prose_beside(node):
                found.append(node)
            else:
                stack.extend(c for c in reversed(node.children) if not isinstance(c, str))
        if found:
            return found
    return [page]


def _signed(key: int) -> int:
    return key - (1 << 64) if key >= 1 << 63 else key


def template_keys(source: str | None) -> list[int]:
    """The different hashes of subtrees of a page that may be a template: of all their words, of those that may go by their
    shape that, too."""
    found = list(candidates(survey(parse(source or ""))))
    return sorted({_signed(c.key) for c in found} | {_signed(c.shape) for c in found if _linked(c)})


def extract(source: str | None, templates: list[int] | None, marks: bool = True) -> str:
    """The text of a page without the templates; marks: without what its tags, classes and roles mark as boilerplate."""
    page = parse(source or "")
    every = survey(page)
    if templates:
        known = set(templates)
        deleted = {id(c) for c in candidates(every) if _signed(c.key) in known or _linked(c) and _signed(c.shape) in known}
        take_out(every, lambda c: id(c) in deleted)
    if marks:
        take_out(every, lambda c: is_boilerplate(c, page.articles))
    blocks: list[str] = []
    now: list[str] = []

    def flush() -> None:
        text = " ".join("".join(now).split())
        if text:
            blocks.append(text)
        now.clear()

    stack: list[Element | str | None] = list(reversed(roots(page))) if marks else [page]
    while stack:
        x = stack.pop()
        if x is None:  # a block ends
            flush()
        elif isinstance(x, str):
            now.append(x)
        else:
            if x.tag in _BLOCK:
                flush()
                stack.append(None)
            elif x.tag == "br":
                now.append(" ")
            stack.extend(reversed(x.children))
    flush()
    return "\n".join(blocks)


def host_key(url: Column) -> Column:
    """A hash of the host of an address; null without one."""
    host = F.lower(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]+)", 1))
    return F.when(F.length(host) > 0, F.xxhash64(host))


def extract_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", keep: list[str] | None = None, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """The columns keep (all by default) of each row of pages, and text.

    A null or empty html has an empty text. Pages without a host are in no count, and no template is taken out of
    them. Repeated rows are pages of their own. A column named text is replaced.
    """
    spark = pages.sparkSession
    small_batches(spark)
    staging = Staging(spark)
    keep = [c for c in (pages.columns if keep is None else keep) if c != "text"]
    pages, keep, back = set_aside(pages, keep)
    rows = pages.select(*(F.col(f"`{c}`") for c in keep), host_key(F.col(f"`{url_col}`")).alias("__host"), F.col(f"`{html_col}`").alias("__html"))

    def keys(columns: list[pa.Array]) -> list:
        return [[template_keys(x) for x in columns[0].to_pylist()]]

    hashed = map_columns(rows.where("__host is not null"), [F.col("__html")], keys, "__keys array<long>", ["__host"])
    held = hashed.select("__host", F.explode_outer("__keys").alias("key")).groupBy("__host", "key").agg(F.count("*").alias("n"))
    held = staging.save(held.where(F.col("n") >= min_pages), "held")
    sizes = rows.where("__host is not null").groupBy("__host").agg(F.count("*").alias("pages"))
    templates = held.where("key is not null").join(sizes, "__host").where(F.col("n") >= F.col("pages") * min_share)
    # each is on a share of its host's pages, so that a host has at most 1 / min_share times the subtrees of a page
    by_host = staging.save(templates.groupBy("__host").agg(F.collect_list("key").alias("__templates")), "templates")
    staging.drop(held)
    if (by_host.select(F.sum(F.size("__templates") + 2)).first()[0] or 0) <= MOST_KEYS:
        by_host = F.broadcast(by_host)
    joined = rows.join(by_host, "__host", "left")

    def texts(columns: list[pa.Array]) -> list:
        return [[extract(x, t) for x, t in zip(columns[0].to_pylist(), columns[1].to_pylist(), strict=True)]]

    return back(map_columns(joined, [F.col("__html"), F.col("__templates")], texts, "text string", keep))
