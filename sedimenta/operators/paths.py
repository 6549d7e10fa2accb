"""Dotted paths into the tree of derived values, and pointers to them.

``a.b`` a child, ``a[3]`` an element, ``a*`` or ``a.*`` each element. A path given as a list may start with an empty
segment: the name after it is then searched for depth-first.
"""

from __future__ import annotations

import re

_PART = re.compile(r"([^.\[\]*]+)|(\[\d+\])|(\*)")


def parse(path: str | list[str] | tuple[str, ...]) -> tuple[str, ...]:
    """Segments: names, ``[i]`` and ``*``."""
    if not isinstance(path, str):
        deep = ("",) if path and path[0] == "" else ()
        return deep + tuple(s for p in path if p for s in parse(p))
    out = []
    for part in path.split("."):
        m = re.fullmatch(r"([^\[\]*]*)((?:\[\d+\]|\*)*)", part)
        if m is None:
            out.append(part)
            continue
        out += [x for x in (m.group(1), *re.findall(r"\[\d+\]|\*", m.group(2))) if x]
    return tuple(out)


def show(path: tuple[str, ...]) -> str:
    out = ""
    for s in path:
        out += s if s == "*" or s.startswith("[") else ("." if out else "") + s
    return out


def is_index(segment: str) -> bool:
    return segment.startswith("[")


class Pointer:
    """A reference to a place in the tree; ``func`` is what derives it, if anything does."""

    def __init__(self, path="", func=None, name: str | None = None):
        self.path, self.func = parse(path), func
        self.name = name or next((s for s in reversed(self.path) if s != "*" and not is_index(s)), "")

    def __repr__(self):
        return f"Pointer({show(self.path)})"

    def _to(self, path: tuple[str, ...]) -> Pointer:
        return Pointer(path, self.func)

    def named(self, name: str) -> Pointer:
        return Pointer(self.path, self.func, name)

    def child(self, name: str) -> Pointer:
        return self._to((*self.path, *parse(name)))

    @property
    def parent(self) -> Pointer:
        return self.up(1)

    def up(self, n: int) -> Pointer:
        """The n-th parent: indexes belong to the name before them."""
        path = list(self.path)
        for _ in range(n):
            while path and (path[-1] == "*" or is_index(path[-1])):
                path.pop()
            if path:
                path.pop()
        return self._to(tuple(path))

    @property
    def chain(self) -> list[Pointer]:
        """The places from the record's own on down to this one."""
        out = [self]
        while out[0].parent.path:
            out.insert(0, out[0].parent)
        return out

    def sibling(self, name: str) -> Pointer:
        return self.up(1).child(name)

    @property
    def root(self) -> Pointer:
        return self._to(())

    @property
    def each(self) -> Pointer:
        return self._to((*self.path, "*"))

    def single(self, i: int) -> Pointer:
        return self._to((*self.path, f"[{i}]"))

    @property
    def multi(self) -> Pointer:
        """The same place, read as a list."""
        return self._to(self.path)

    def get(self, field: str) -> Pointer:
        """Another output of the function behind this pointer."""
        return self.sibling(field)

    def map(self, field: str, f, dtype="string"):
        """A function that derives ``field`` under this place; ``f``: Column to Column, or a Python function with ``python=True``."""
        from sedimenta.operators.functions import Derived

        return Derived({field: dtype}, expr=lambda c: {field: f(c)}, source=self)

    def map_python(self, field: str, f, dtype="string"):
        from sedimenta.operators.functions import Derived

        return Derived({field: dtype}, py=lambda v: {field: f(v)}, source=self)

    def map_multi(self, field: str, f, dtype="array<string>"):
        from sedimenta.operators.functions import Derived

        return Derived({field: dtype}, expr=lambda c: {field: f(c)}, source=self, multi=(field,))

    def map_identity(self, field: str):
        from sedimenta.operators.functions import Identity

        return Identity(field, self)
