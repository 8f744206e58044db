"""Queries built from a form's groups of literals, refinements, and equality of meaning."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from .nodes import And, AtLeast, Meta, Near, Node, Not, Or, Term, conjuncts
from .parser import parse_query
from .printer import to_query_string

#: Extensions that stand for a kind in the form (fixed values).
KIND_EXTENSIONS = {
    "pdf": ("pdf",),
    "excel": ("xlsx", "xlsm", "xltx", "xltm", "xls", "xlsb"),
    "word": ("docx", "docm"),
    "ppt": ("pptx", "pptm"),
    "text": ("txt", "csv", "tsv", "log", "md"),
    "archive": ("zip",),
}


def clean_literal(text: str) -> str:
    """A form entry without surrounding space or one pair of quotes."""
    text = " ".join(text.split())
    return text[1:-1].strip() if len(text) > 1 and text[0] == text[-1] == '"' else text


def _literal(text: str) -> Term:
    return Term(text, phrase=" " in text)


def _group(kind: type, items: Iterable[Node]) -> list[Node]:
    items = list(dict.fromkeys(items))
    return [items[0] if len(items) == 1 else kind(tuple(items))] if items else []


@dataclass
class Groups:
    """What a form holds: literals that must, may or must not occur, k of several, pairs and filters."""

    every: list[str] = field(default_factory=list)
    some: list[str] = field(default_factory=list)
    none: list[str] = field(default_factory=list)
    several: list[str] = field(default_factory=list)
    count: int = 2
    near: list[tuple[str, str, int]] = field(default_factory=list)
    extensions: list[str] = field(default_factory=list)
    filters: list[Meta] = field(default_factory=list)
    advanced: str = ""

    def build(self) -> Node | None:
        said = lambda xs: [_literal(t) for x in xs if (t := clean_literal(x))]
        parts: list[Node] = list(said(self.every))
        parts += _group(Or, said(self.some))
        if several := said(self.several):
            parts.append(AtLeast(max(1, min(self.count, len(several))), tuple(several)))
        parts += [Near(_literal(clean_literal(a)), _literal(clean_literal(b)), d) for a, b, d in self.near]
        if self.extensions:
            parts.append(Meta("ext", "in", ",".join(x.lower().lstrip(".") for x in self.extensions)))
        parts += self.filters
        parts += [Not(t) for t in said(self.none)]
        if extra := parse_query(self.advanced):
            parts += conjuncts(extra)
        parts = list(dict.fromkeys(parts))
        return None if not parts else parts[0] if len(parts) == 1 else And(tuple(parts))

    def query(self) -> str:
        return to_query_string(self.build())


def to_groups(node: Node | None) -> Groups:
    """The form that builds ``node``; parts without a field of their own go to ``advanced``."""
    out, rest = Groups(), []
    for part in conjuncts(node):
        words = lambda xs: all(isinstance(x, Term) for x in xs)
        if isinstance(part, Term):
            out.every.append(part.text)
        elif isinstance(part, Or) and not out.some and words(part.children):
            out.some = [t.text for t in part.children]
        elif isinstance(part, Not) and isinstance(part.child, Term):
            out.none.append(part.child.text)
        elif isinstance(part, AtLeast) and not out.several and words(part.children):
            out.several, out.count = [t.text for t in part.children], part.count
        elif isinstance(part, Near) and words((part.left, part.right)):
            out.near.append((part.left.text, part.right.text, part.distance))
        elif isinstance(part, Meta) and part.field == "ext" and not out.extensions:
            out.extensions = part.value.split(",")
        elif isinstance(part, Meta) and part.field == "type" and not out.extensions:
            out.extensions = list(KIND_EXTENSIONS[part.value])
        elif isinstance(part, Meta):
            out.filters.append(part)
        else:
            rest.append(part)
    out.advanced = to_query_string(rest[0] if len(rest) == 1 else And(tuple(rest)) if rest else None)
    return out


def _canonical(node: Node | None) -> object:
    if isinstance(node, Term):
        return ("term", node.text)
    if isinstance(node, Not):
        return ("not", _canonical(node.child))
    if isinstance(node, Near):
        return ("near", frozenset({_canonical(node.left), _canonical(node.right)}), node.distance)
    if isinstance(node, Meta):
        if node.field in ("type", "ext"):
            return ("ext", frozenset(KIND_EXTENSIONS[node.value] if node.field == "type" else node.value.split(",")))
        return (node.field, node.op, node.value)
    if isinstance(node, AtLeast):
        return ("k", node.count, tuple(sorted(map(repr, map(_canonical, node.children)))))
    if node is None:
        return None
    flat = [x for c in node.children for x in (c.children if type(c) is type(node) else (c,))]
    found = frozenset(map(_canonical, flat))
    return next(iter(found)) if len(found) == 1 else (type(node).__name__, found)


def equivalent(left: Node | None, right: Node | None) -> bool:
    """Equal up to order and repetition; ``type:x`` equals the list of its extensions."""
    return _canonical(left) == _canonical(right)


def combined(query: str, refinement: str = "", exclude: str = "", *, spaces: str = "OR") -> Node | None:
    """A query narrowed by another one and by words (parted by space or comma) that must not occur."""
    parts = [n for q in (query, refinement) if (n := parse_query(q, spaces=spaces))]
    parts += [Not(Term(w)) for w in exclude.replace(",", " ").split()]
    return None if not parts else parts[0] if len(parts) == 1 else And(tuple(x for p in parts for x in conjuncts(p)))
