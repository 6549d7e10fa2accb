"""A small deterministic tagger with the interface of a real one: text -> [(kind, entity)]."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
_DATE = re.compile(rf"\b(?:\d{{1,2}} (?:{_MONTHS})(?: \d{{4}})?|(?:{_MONTHS}) \d{{1,2}}(?:, \d{{4}})?|\d{{4}}-\d{{2}}-\d{{2}}|(?:19|20)\d{{2}})\b")
_ORG = re.compile(r"\b(?:[A-Z][\w&.-]*\s+)+(?:Inc|Ltd|LLC|GmbH|Corp|University|Institute|Foundation|Library|Archive)\b\.?")
_PERSON = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.?\s+((?:[A-Z][\w'-]+\s?)+)")
_PLACES = ("Paris", "Berlin", "London", "Madrid", "Rome", "Vienna", "New York", "San Francisco", "Tokyo", "France", "Germany", "Spain", "Italy", "Austria", "Japan", "Europe", "Africa", "Asia", "Hannover", "Hanover")


def gazetteer(places: Iterable[str] = _PLACES) -> Callable[[str], list[tuple[str, str]]]:
    """Dates, titled persons, organisations by their suffix, places from a list."""
    place = re.compile(r"\b(?:" + "|".join(sorted(map(re.escape, places), key=len, reverse=True)) + r")\b")

    def tag(text: str) -> list[tuple[str, str]]:
        return (
            [("DATE", m.group()) for m in _DATE.finditer(text)]
            + [("ORGANIZATION", m.group().strip()) for m in _ORG.finditer(text)]
            + [("PERSON", m.group(1).strip()) for m in _PERSON.finditer(text)]
            + [("LOCATION", m.group()) for m in place.finditer(text)]
        )

    return tag


def grouped(found: list[tuple[str, str]], mapping: dict[str, str]) -> dict[str, list[str]]:
    """Field to its distinct entities, sorted."""
    out: dict[str, set[str]] = {f: set() for f in mapping.values()}
    for kind, entity in found:
        if kind in mapping:
            out[mapping[kind]].add(entity)
    return {f: sorted(v) for f, v in out.items()}


def clean_latin(text: str) -> str:
    """Only Latin letters, digits and common punctuation; anything else becomes one blank."""
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s.,;:!?'\"()&/-]|[^\x00-ɏ]", " ", text)).strip()
