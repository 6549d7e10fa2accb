"""HTML in plain Python: outer HTML by tag name, visible text, attributes. One pass each, no dependencies."""

from __future__ import annotations

import re
from html import unescape

#: A tag or declaration; quotes count after an equals sign only. All loops are possessive, and a search ends at the last
#: ">", so each "<" is decided in time linear in what it covers.
_TAG = re.compile(r"<!--|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)>")
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset(("script", "style", "textarea", "title"))
_SKIP = frozenset(("script", "style", "noscript", "template", "head"))
_BREAK = frozenset("address article aside blockquote body br dd div dl dt fieldset footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table td th tr ul".split())
_SPACE = re.compile(r"\s+")


def _scan(html: str):
    """(start, end, closing, tag or None, attributes) of each tag, comment and declaration. ``send`` moves on to a place."""
    at, stop = 0, html.rfind(">") + 1
    while at < stop and (m := _TAG.search(html, at, stop)):
        at = m.end()
        if m.group() == "<!--":
            k = html.find("-->", at)
            at = k + 3 if k >= 0 else len(html)
        to = yield m.start(), at, bool(m.group(1)), m.group(2) and m.group(2).lower(), m.group(3)
        if to is not None:
            at = to
            yield


def _raw_end(html: str, tag: str, at: int):
    return re.compile(rf"</{tag}\s*+>", re.I).search(html, at)


def _tokens(html: str):
    """(start, end, closing, tag, attributes) of each tag; the content of raw-text elements has no tags."""
    scan = _scan(html)
    for start, at, closing, tag, attributes in scan:
        if tag is None:
            continue
        yield start, at, closing, tag, attributes
        if not closing and tag in _RAW:
            end = _raw_end(html, tag, at)
            if end is None:
                return
            scan.send(end.start())


def outer(html: str | None, name: str, most: int | None = None) -> list[str]:
    """Outer HTML of the elements called ``name`` in order of their opening tags; stops after ``most``.

    An element ends at its own closing tag (nested ones of its name are counted), or where its parent's text ends if
    it has none.
    """
    if not html:
        return []
    name = name.lower()
    found: list[list[int]] = []
    open_: list[int] = []
    for start, end, closing, tag, attributes in _tokens(html):
        if tag != name:
            continue
        if closing:
            if open_:
                found[open_.pop()][1] = end
                if most is not None and len(found) >= most and not any(k < most for k in open_):
                    break
        else:
            found.append([start, end if tag in _VOID or attributes.endswith("/") else -1])
            if found[-1][1] < 0:
                open_.append(len(found) - 1)
            elif most is not None and len(found) >= most and not any(k < most for k in open_):
                break
    for k in open_:
        following = found[k + 1][0] if k + 1 < len(found) else len(html)
        found[k][1] = following if name in ("a", "li", "p", "td", "tr", "option", "b") else len(html)
    out = [html[s:e] for s, e in found]
    return out if most is None else out[:most]


def text(html: str | None) -> str | None:
    """Visible text: without scripts, styles, comments and markup, decoded, white space collapsed, trimmed."""
    if html is None:
        return None
    out, at, skip, skipped = [], 0, 0, None
    scan = _scan(html)
    for start, end, closing, tag, _ in scan:
        if not skip:
            out.append(html[at:start])
        at = end
        if tag is None:
            continue
        if skip:
            if tag == skipped:
                skip += -1 if closing else 1
        elif not closing and tag in _SKIP:
            skip, skipped = 1, tag
            if tag in _RAW:
                raw = _raw_end(html, tag, at)
                at, skip = (raw.end(), 0) if raw else (len(html), 0)
                scan.send(at)
        elif tag in _BREAK:
            out.append(" ")
    if not skip:
        rest = html[at:]
        out.append(rest[: rest.find("<!--")] if "<!--" in rest else rest)
    return _SPACE.sub(" ", unescape("".join(out))).strip()


def attribute(html: str | None, name: str) -> str | None:
    """The attribute of the first tag in the string; None if there is no tag or no such attribute."""
    if not html:
        return None
    for _, _, closing, _, attributes in _tokens(html):
        if closing:
            continue
        for m in _ATTR.finditer(attributes):
            if m.group(1).lower() == name.lower():
                v = m.group(2) or ""
                return unescape(v[1:-1] if v[:1] in "\"'" else v)
        return None
    return None
