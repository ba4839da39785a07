"""The term language, on the driver: words, & binding tighter than |, and parentheses; no negation."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Limits of a term.
MAX_SUBTERMS = 100
MAX_WORDS = 20

_TOKEN = re.compile(r"[^\W_]+|[&|()]")
_OPERATORS = set("&|()")


def tokenize(text: str, keep_operators: bool = False) -> list[str]:
    found = _TOKEN.findall(text.lower())
    return found if keep_operators else [t for t in found if t not in _OPERATORS]


def sanitize(term: str, keep_operators: bool = True) -> str:
    out = ""
    for t in tokenize(term, keep_operators):
        out += (" " if out and out[-1] not in _OPERATORS and t not in _OPERATORS else "") + t
    return out


def split(term: str, keep_operators: bool = False) -> list[str]:
    parts = [p.strip() for p in re.split(r"([&|()])", sanitize(term))]
    return [p for p in parts if p and (keep_operators or p not in _OPERATORS)]


def ngrams(text: str, orders: tuple[int, ...] = (1, 2)) -> list[str]:
    t = text.split(" ")
    return [" ".join(t[i : i + k]) for i in range(len(t)) for k in orders if i + k <= len(t)]


@dataclass(frozen=True)
class Query:
    """A parsed term: its distinct subterms and a tree ('sub', i), ('and', ...), ('or', ...); None finds nothing."""

    text: str
    subterms: tuple[str, ...]
    tree: tuple | None


def parse(term: str) -> Query:
    """A term that is malformed, empty or beyond the limits finds nothing; with a single subterm operators are ignored."""
    text = sanitize(term)
    subs = split(text)
    if not subs or len(subs) > MAX_SUBTERMS:
        return Query(text, (), None)
    distinct = tuple(dict.fromkeys(subs))
    if len(subs) == 1:
        return Query(text, distinct, ("sub", 0))
    tokens, at = split(text, keep_operators=True), 0

    def peek() -> str | None:
        return tokens[at] if at < len(tokens) else None

    def either() -> tuple:
        nonlocal at
        parts = [both()]
        while peek() == "|":
            at += 1
            parts.append(both())
        return parts[0] if len(parts) == 1 else ("or", *parts)

    def both() -> tuple:
        nonlocal at
        parts = [atom()]
        while peek() == "&":
            at += 1
            parts.append(atom())
        return parts[0] if len(parts) == 1 else ("and", *parts)

    def atom() -> tuple:
        nonlocal at
        t = peek()
        if t is None or t in "&|)":
            raise SyntaxError
        at += 1
        if t != "(":
            return ("sub", distinct.index(t))
        inner = either()
        if peek() != ")":
            raise SyntaxError
        at += 1
        return inner

    try:
        tree = either()
        return Query(text, distinct, tree if at == len(tokens) else None)
    except SyntaxError:
        return Query(text, distinct, None)
