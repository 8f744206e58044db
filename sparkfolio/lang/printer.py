"""Writing query trees: as queries that parse back, and as labels."""

from __future__ import annotations

import re

from .nodes import And, AtLeast, Meta, Near, Node, Not, Or, Term
from .parser import UNITS, parse_query

_SIGNS = {"le": "<=", "ge": ">=", "lt": "<", "gt": ">"}


def human_size(size: int) -> str:
    """A size in the largest unit that divides it."""
    power = next((p for p in range(len(UNITS) - 1, 0, -1) if size and size % 1024**p == 0), 0)
    return f"{size // 1024**power}{UNITS[power].upper() + 'B' if power else 'B'}"


def _meta(node: Meta) -> str:
    shown = (lambda v: human_size(int(v))) if node.field == "size" else str
    if node.op == "range":
        return f"{node.field}:{'..'.join(map(shown, node.value.split('..', 1)))}"
    return f"{node.field}:{_SIGNS.get(node.op, '')}{shown(node.value)}"


def _word(node: Term, bare: bool) -> str:
    if bare and not node.phrase:
        return node.text
    if not node.phrase and re.fullmatch(r"[^\s()&|!\";,]+", node.text):
        try:
            if parse_query(node.text) == node:
                return node.text
        except ValueError:
            pass
    return '"' + re.sub(r'(["\\])', r"\\\1", node.text) + '"'


def _write(node: Node, bare: bool, spaced: bool, level: int = 0) -> str:
    if isinstance(node, Term):
        return _word(node, bare)
    if isinstance(node, Meta):
        return _meta(node)
    if isinstance(node, Not):
        return "!" + _write(node.child, bare, spaced, 3)
    if isinstance(node, Near):
        return f"NEAR({_write(node.left, bare, spaced)},{_write(node.right, bare, spaced)},{node.distance})"
    inner = 2 if isinstance(node, And) else 1
    parts = [_write(c, bare, spaced, 3 if isinstance(node, AtLeast) else inner + 1) for c in node.children]
    if isinstance(node, AtLeast):
        # a filter's value may hold commas, so only a space ends it
        ends = [" " if isinstance(c, Meta) else "," for c in node.children[:-1]]
        return f"{node.count}of({''.join(p + e for p, e in zip(parts, [*ends, ''], strict=True))})"
    sign = "&" if isinstance(node, And) else "|"
    text = (f" {sign} " if spaced else sign).join(parts)
    return f"({text})" if level > inner else text


def to_query_string(node: Node | None) -> str:
    """A query that parses to ``node``."""
    return "" if node is None else _write(node, bare=False, spaced=True)


def display_name(node: Node | None) -> str:
    """A short label."""
    return "" if node is None else _write(node, bare=True, spaced=False)
