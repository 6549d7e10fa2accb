"""Derivation functions: what they read, which fields they add under it, and how."""

from __future__ import annotations

import copy
import itertools

from pyspark.sql import Column
from pyspark.sql import functions as F

from sedimenta.functions import entities, http, markup, urls
from sedimenta.operators.paths import Pointer, parse


class Func(Pointer):
    """A derivation that is also a pointer to its default field.

    ``fields``: name to type. ``expr`` maps the source's Column to the fields' Columns and stays in the JVM; ``py`` maps
    one value to a dict of values and runs Arrow-batched. ``setup`` makes what ``py`` gets as second argument, once for
    a worker (a model); with ``cleanup`` it is made for each partition and handed to ``cleanup`` at its end, whatever
    happens. ``namespace``: segments between the source and the fields.
    """

    def __init__(self, fields, source=None, expr=None, py=None, namespace=(), multi=(), default=None, load="text", setup=None, context=(), cleanup=None):
        self.fields, self.expr, self.py, self.setup, self.cleanup = dict(fields), expr, py, setup, cleanup
        self.namespace, self.multi_fields, self.load, self.context = tuple(namespace), frozenset(multi), load, tuple(context)
        self.default = default or next(iter(self.fields))
        self.source = source
        self.func = self
        self.name = self.default

    @property
    def path(self):
        return (*self.base, self.default)

    @property
    def base(self):
        source = self.source.path if self.source is not None else LOADS[self.load]
        if source[:1] and source[0].startswith("@"):  # a physical column is no place in the tree
            source = ()
        return (*source, *self.namespace)

    def __repr__(self):
        return f"{type(self).__name__}({'.'.join(self.base)}: {', '.join(self.fields)})"

    def of(self, source) -> Func:
        """The same function on another source."""
        out = copy.copy(self)
        out.source = source if isinstance(source, Pointer) else Pointer(source)
        out.func = out
        return out

    on = of

    def of_each(self, source) -> Func:
        """The same function on each element of a list."""
        source = source if isinstance(source, Pointer) else Pointer(source)
        return self.of(source.each)

    on_each = of_each

    def get(self, field: str) -> Pointer:
        if field not in self.fields:
            raise KeyError(f"{self!r} has no field {field}")
        return Pointer((*self.base, field), self)

    def child(self, name: str) -> Pointer:
        # the outputs of a function of several fields are found under either spelling
        if len(self.fields) > 1 and name in self.fields:
            return self.get(name)
        return super().child(name)

    def _to(self, path):
        return Pointer(path, self)


class Derived(Func):
    """A function made by ``Pointer.map`` and its kin."""


class Identity(Func):
    """A namespace: a place whose value is its parent's, and which adds nothing of its own to the output."""

    def __init__(self, field: str, source: Pointer):
        super().__init__({field: "string"}, source=source, expr=lambda c: {field: c})


#: Where the text and the bytes of a record are, unless the archive says otherwise.
LOADS = {"text": parse("payload.string"), "bytes": parse("payload"), "root": ()}


class HtmlTag(Func):
    """Outer HTML of the elements of one name: all, or the ``index``-th."""

    def __init__(self, tag: str, index: int | None = None, field: str | None = None):
        field = field or tag
        if index is None:
            super().__init__({field: "array<string>"}, py=lambda v: {field: markup.outer(v, tag)}, namespace=("html",), multi=(field,))
        else:
            super().__init__({field: "string"}, py=lambda v: {field: next(itertools.islice(markup.outer(v, tag, index + 1), index, None), None)}, namespace=("html",))


class Html:
    """Tags of a page's text. ``Html()`` is the whole ``html`` element."""

    def __new__(cls, tag: str = "html", index: int = 0, field: str | None = None):
        return HtmlTag(tag, index, field)

    @staticmethod
    def first(tag: str, field: str | None = None) -> HtmlTag:
        return HtmlTag(tag, 0, field)

    @staticmethod
    def all(tag: str, field: str | None = None) -> HtmlTag:
        return HtmlTag(tag, None, field)


def HtmlText() -> Func:
    return Func({"text": "string"}, source=Html.first("body"), py=lambda v: {"text": markup.text(v)})


def HtmlAttribute(name: str) -> Func:
    return Func({name: "string"}, py=lambda v: {name: markup.attribute(v, name)}, namespace=("attributes",))


def LowerCase() -> Func:
    return Func({"lowercase": "string"}, expr=lambda c: {"lowercase": F.lower(c)})


def SURT(base: str | None = "originalUrl") -> Func:
    """Canonical URL; relative ones are resolved against the record's ``base`` column if it has one."""
    return Func({"SURT": "string"}, expr=lambda c, *b: {"SURT": urls.surt(urls.absolute(c, b[0]) if b else c)}, context=(base,) if base else ())


def AbsoluteUrl(base: str = "originalUrl") -> Func:
    return Func({"absolute": "string"}, expr=lambda c, *b: {"absolute": urls.absolute(c, b[0]) if b else c}, context=(base,))


def Entities(tagger=None, mapping: dict[str, str] | None = None, latin: bool = False) -> Func:
    """Named entities by field, each distinct and sorted. ``tagger``: a factory of text -> [(kind, entity)], made once a worker."""
    mapping = mapping or {"PERSON": "persons", "ORGANIZATION": "organizations", "LOCATION": "locations", "DATE": "dates"}
    make = tagger or entities.gazetteer

    def run(v, tag):
        if v is None:
            return {f: None for f in mapping.values()}
        return entities.grouped(tag(entities.clean_latin(v) if latin else v), mapping)

    return Func({f: "array<string>" for f in mapping.values()}, source=HtmlText(), py=run, setup=make, namespace=("entities",), multi=tuple(mapping.values()))


def StringContent(limit: int = http.TEXT_LIMIT) -> Func:
    """The payload's text; ``limit``: bytes of the payload that become text, 0 for all."""

    def run(v):
        payload, header = (v["payload"], v["httpHeader"]) if isinstance(v, dict) else (v, None)
        return {"string": http.string_content(payload, [(h["k"], h["v"]) for h in header] if header else None, limit)}

    return Func({"string": "string"}, py=run, load="bytes", context=("@httpHeader",))


HEADER_TYPE = "array<struct<k:string,v:string>>"


def WarcPayload(http_only: bool = True) -> Func:
    """Header, HTTP status line and header, and payload of the raw WARC record in the ``content`` column."""

    def run(data):
        if data is None:
            return {}
        header, block = http.warc_record(bytes(data))
        out = {"recordHeader": [{"k": k, "v": v} for k, v in header]}
        if not http_only:
            return out | {"payload": block}
        message = http.http_message(block)
        if message is None:
            return out
        status, fields, body = message
        return out | {"httpStatusLine": status, "httpHeader": [{"k": k, "v": v} for k, v in fields], "payload": body}

    fields = {"recordHeader": HEADER_TYPE} | ({"httpStatusLine": "string", "httpHeader": HEADER_TYPE} if http_only else {}) | {"payload": "binary"}
    return Func(fields, source=Pointer("@content"), py=run, default="payload", load="root")


def HttpPayload() -> Func:
    """The same for a bare HTTP response."""

    def run(data):
        message = http.http_message(bytes(data)) if data is not None else None
        if message is None:
            return {}
        return {"httpStatusLine": message[0], "httpHeader": [{"k": k, "v": v} for k, v in message[1]], "payload": message[2]}

    return Func({"httpStatusLine": "string", "httpHeader": HEADER_TYPE, "payload": "binary"}, source=Pointer("@content"), py=run, default="payload", load="root")


def Data(field: str = "data") -> Func:
    """The record's raw bytes as a value."""
    return Func({field: "binary"}, source=Pointer("@content"), expr=lambda c: {field: c}, load="root")


class Values(Func):
    """The values of several pointers as one list of strings, each relative to the place it is attached to.

    Members are derived on demand. A missing member without a default makes the list null.
    """

    def __init__(self, *pointers: Pointer, field: str | None = None, defaults: list[str | None] | None = None):
        self.pointers, self.defaults = pointers, list(defaults or [])
        super().__init__({field or "_".join(p.name for p in pointers): "array<string>"}, load="root", expr=None)

    def with_defaults(self, *defaults) -> Values:
        out = copy.copy(self)
        out.defaults = list(defaults)
        out.func = out
        return out

    def combine(self, members: list[Column]) -> dict[str, Column]:
        filled = []
        for k, m in enumerate(members):
            m = m.cast("string")
            filled.append(F.coalesce(m, F.lit(self.defaults[k])) if k < len(self.defaults) and self.defaults[k] is not None else m)
        whole = F.lit(True)
        for f in filled:
            whole = whole & f.isNotNull()
        return {self.default: F.when(whole, F.array(*filled))}
