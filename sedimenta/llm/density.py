"""HTML extraction by composite text density.

A page is tokenised and its tree built in one pass (unclosed and misnested tags are closed as browsers do). Every node
has its characters, link characters, tags and link tags; its composite density is its characters per tag, adjusted for
links,

    C/T * log_b( C/L' * T/LT )   with   b = ln( C/NL * L + LB/CB * C + e ),

where NL are its characters outside of links and LB/CB the link share of the body. A node's density sum adds up its
children's densities. The nodes on the path from the body to the node of largest sum set the threshold: the least
density on that path; the main text is the subtree of largest sum, grown along that path (all of it meets the
threshold) to the enclosing article where there is one.

Furniture never counts as text: head, scripts, styles, templates, menus, headers and footers of the page, asides,
forms, controls, dialogs, hidden nodes, and elements whose role, or a whole token of whose class or id, names a menu,
banner, advert, notice, sidebar, breadcrumb, cookie or comment section. Tokens that only suggest furniture (``related``,
``share``, ``legal``) are hints: density decides, and such an element goes only if it is below the threshold or mostly
links, as lists of links below the threshold do.

Defined results: null, empty and tag-free input give what text there is (empty if none); white space inside a block
becomes one blank, blocks are joined by line feeds in page order; character references are decoded once; repeated
rows, null ids and further columns don't matter (columns named as a result are replaced by it); pages of any length are
read whole, in time linear in it however broken their tags; no rows give no rows.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm.common import batched, slices, text_or_empty

#: An opening or closing tag, a comment or a declaration. Quotes count after an equals sign only. Every loop is possessive
#: and ``parse`` looks no further than the last ">", so each "<" is decided in time linear in what it covers.
_TOKEN = re.compile(r"<!--|<!\[CDATA\[|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)>")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?")
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in _RAW}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4",
    "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
_CLOSES_P = _BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html"}
#: An element that an opening tag ends, and the elements at which the search for it stops.
_IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"})}
_IMPLIED["thead"] = _IMPLIED["tfoot"] = _IMPLIED["tbody"]
_FURNITURE = {"head", "script", "style", "template", "noscript", "iframe", "object", "svg", "canvas", "audio", "video", "nav", "aside", "form", "button", "select", "input", "textarea", "label", "fieldset", "dialog", "menu", "search", "title", "datalist", "map"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
#: Words of a class or id token that name furniture, alone or among words that say nothing.
_STRONG = frozenset(
    "nav navbar navigation menu menus topbar header masthead footer sidebar sidebars ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promos promotion promoted banner banners "
    "cookie cookies consent gdpr notice notices popup popups modal newsletter subscribe subscription signup login breadcrumb breadcrumbs pagination pager comment comments commentlist disqus replies respond".split()
)
#: Words that only suggest it: such an element goes if it is less dense than the threshold or mostly links.
_WEAK = frozenset("side aside foot overlay share sharing social related recommended recommendations widget widgets skip copyright legal disclaimer toolbar search".split())
_NEUTRAL = frozenset(
    "site page pages global top bottom left right upper lower primary secondary inner outer box boxes block blocks bar bars wrap wrapper container area section list item items panel group row col column link links "
    "button buttons btn icon icons strip zone slot unit region reader readers user view mobile desktop sticky fixed form post posts article articles story main google dfp js".split()
)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[^\W\d_]+")
_HIDDEN = re.compile(r"display\s*+:\s*+none|visibility\s*+:\s*+hidden", re.I)
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "parts", "chars", "links", "tags", "link_tags", "density", "total", "gone", "hinted")

    def __init__(self, tag: str, parent: Node | None, gone: bool = False, hinted: bool = False):
        self.tag, self.parent, self.parts, self.gone, self.hinted = tag, parent, [], gone, hinted
        self.chars = self.links = self.tags = self.link_tags = 0
        self.density = self.total = 0.0


@lru_cache(1 << 14)
def _named(value: str) -> tuple[bool, bool, bool]:
    """Whether a token of the class or id names furniture, names a header, suggests furniture."""
    strong = header = weak = False
    for token in value.split():
        words = {w.lower() for w in _PARTS.findall(token)} - _NEUTRAL
        if words and words <= _STRONG | _WEAK:
            strong |= bool(words & _STRONG - {"header"})
            header |= "header" in words
            weak |= bool(words & _WEAK)
    return strong, header, weak


def _furniture(tag: str, attributes: str, inside_article: bool) -> tuple[bool, bool]:
    """Whether an element is furniture, and whether its names only suggest so."""
    if tag in _FURNITURE:
        return True, False
    if tag in ("header", "footer"):
        return not inside_article or tag == "footer", False
    if not attributes or tag in ("html", "body", "article", "main"):
        return False, False
    hinted = False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m.group(1).lower(), (m.group(2) or "").strip("\"'")
        if name in ("class", "id"):
            strong, header, weak = _named(value)
            if strong or header and not inside_article:
                return True, False
            hinted |= weak
        if name == "role" and value.strip().lower() in _ROLES:
            return True, False
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _HIDDEN.search(value)):
            return True, False
    return False, hinted


def parse(html: str) -> Node:
    """The tree of the page. Text parts are decoded; the parts of a node are nodes and strings in order."""
    root = node = Node("html", None)
    articles = 0
    at, n = 0, len(html)
    stop = html.rfind(">") + 1  # no tag ends after it
    find = _TOKEN.search
    open_: dict[str, int] = {}  # elements on the path by tag, so that nothing is looked for in vain

    def text(s: str) -> None:
        if s:
            node.parts.append(unescape(s) if "&" in s else s)

    def leave(to: Node) -> None:
        """Close all elements below ``to``."""
        nonlocal node, articles
        while node is not to:
            articles -= node.tag in ("article", "main")
            open_[node.tag] -= 1
            node = node.parent

    while at < n:
        m = find(html, at, stop) if at < stop else None
        if m is None:
            k = html.find("<!--", at)  # a comment that nothing ends
            text(html[at : k if k >= 0 else n])
            break
        if m.start() > at:
            text(html[at : m.start()])
        at = m.end()
        name = m.group(2)
        if name is None:
            if m.group() in ("<!--", "<![CDATA["):  # CDATA in HTML is a comment
                end = "-->" if m.group() == "<!--" else "]]>"
                k = html.find(end, at)
                at = k + 3 if k >= 0 else n
            continue
        tag = name.lower()
        if m.group(1):
            up = node if open_.get(tag) else None
            while up is not None and up.tag != tag:
                if up.tag in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "html", "body"):
                    up = None
                    break
                up = up.parent
            if up is not None and up is not root and tag not in ("html", "body"):
                leave(up.parent)
            elif tag == "p":
                node.parts.append(Node("p", node))
            continue
        attributes = m.group(3) or ""
        if tag == "html":
            continue
        if tag == "body":
            leave(root)
        if tag in _CLOSES_P or tag in _IMPLIED:
            ends, stops = _IMPLIED.get(tag, (None, None))
            if tag in _CLOSES_P and open_.get("p"):
                up = node
                while up is not None and up.tag != "p" and up.tag not in ("td", "th", "li", "div", "article", "section", "table", "button", "blockquote", "main", "body", "nav", "aside", "header", "footer"):
                    up = up.parent
                if up is not None and up.tag == "p":
                    leave(up.parent)
            if ends and any(open_.get(t) for t in ends):
                up, last = node, None
                while up is not None and up.tag not in stops:
                    if up.tag in ends:
                        last = up
                    up = up.parent
                if last is not None:
                    leave(last.parent)
        child = Node(tag, node, *_furniture(tag, attributes, articles > 0))
        node.parts.append(child)
        if tag in _VOID or attributes.rstrip().endswith("/") and tag not in _BLOCK and tag not in _RAW:
            continue
        if tag in _RAW:
            end = _RAW_END[tag].search(html, at)
            at = end.end() if end else n
            continue
        node = child
        open_[tag] = open_.get(tag, 0) + 1
        articles += tag in ("article", "main")
    return root


def _measure(root: Node) -> list[Node]:
    """Characters, links and tags of every node, children first. Furniture is left out."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack += [p for p in x.parts if isinstance(p, Node) and not p.gone]
    for x in reversed(order):
        for p in x.parts:
            if isinstance(p, str):
                x.chars += len(_SPACE.sub(" ", p).strip())
            elif not p.gone:
                x.chars += p.chars
                x.links += p.chars if p.tag == "a" else p.links
                x.tags += p.tags + 1
                x.link_tags += p.link_tags + (p.tag == "a")
    return order


def _composite(x: Node, share: float) -> float:
    c, t = x.chars, max(x.tags, 1)
    if not c:
        return 0.0
    links, plain, lt = max(x.links, 1), max(c - x.links, 1), max(x.link_tags, 1)
    base = math.log(c / plain * links + share * c + math.e)
    return c / t * math.log(max(c / links * t / lt, 1.0)) / math.log(base) if base > 1 else c / t


def main_node(root: Node) -> tuple[Node, float]:
    """The subtree of largest density sum and the threshold: the least density on its path from the body."""
    order = _measure(root)
    body = next((x for x in order if x.tag == "body"), root)
    if not body.chars:
        body = root
    share = body.links / max(body.chars, 1)
    for x in order:
        x.density = _composite(x, share)
    for x in order:
        x.total = sum(p.density for p in x.parts if isinstance(p, Node) and not p.gone)
    best = max(order, key=lambda x: x.total)
    if best.total <= 0:
        return body, 0.0
    threshold, up = best.density, best
    while up is not None:
        threshold = min(threshold, up.density)
        if up is body:
            break
        up = up.parent
    top, up = best, best
    while up is not None:  # an enclosing article is the unit that its author marked
        if up.tag in ("article", "main"):
            top = up
        up = up.parent
    if top is best and best.tag not in ("article", "main", "body", "html"):
        # without a marked article: as far up as the text stays dense and nothing but text is added
        up = best
        while up.parent is not None and up.parent.tag not in ("html",) and up.parent.density >= threshold and up.tag in ("p", "b", "i", "em", "strong", "span", "blockquote", "li", "ul", "ol", "td", "tr", "tbody", "table"):
            up = up.parent
        top = up
    return top, threshold


def blocks(top: Node, threshold: float) -> list[str]:
    """The blocks of the subtree: white space inside a block is one blank."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if run:
            t = _SPACE.sub(" ", "".join(run)).strip()
            if t:
                out.append(t)
            run.clear()

    stack: list = [(top, 0)]
    while stack:
        x, k = stack.pop()
        if k == 0 and x.tag in _BLOCK:
            flush()
        parts = x.parts
        while k < len(parts):
            p = parts[k]
            k += 1
            if isinstance(p, str):
                run.append(p)
            elif p.gone:
                if p.tag in _BLOCK:
                    flush()
            elif p.hinted and (p.density < threshold or 2 * p.links > p.chars):
                if p.tag in _BLOCK:
                    flush()
            elif p.tag == "br":
                run.append(" ")
            elif p.chars and p.links == p.chars and p.link_tags > 1 and p.tag in ("ul", "ol", "div", "section", "p", "table") and p.density < threshold:
                flush()  # a list of links
            else:
                stack += [(x, k), (p, 0)]
                break
        else:
            if x.tag in _BLOCK:
                flush()
    flush()
    return out


def extract(html: str) -> str:
    """The main text of a page."""
    if not html:
        return ""
    return "\n".join(blocks(*main_node(parse(html))))


def extracted(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with the main text and ``n_chars``, its code points; every other column is kept."""

    @F.arrow_udf("string")
    def main_text(col: pa.Array) -> pa.Array:
        return pa.array([extract(h) for h in col.to_pylist()], pa.string())

    out = batched(pages).withColumn(text, main_text(text_or_empty(html)))
    return out.withColumn("n_chars", F.char_length(text).cast("long"))


def op4_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")

    def run(batches):
        for b in slices(batches, "html"):
            texts = [extract(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return batched(pages).select("page_id", "url", text_or_empty("html").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


QUERIES = {"op4_extract_html": op4_extract_html}
ORACLES: dict[str, str] = {}
