"""The query tree and what can be asked of it without evaluating it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Union


class QueryError(ValueError):
    """A query that can't be read; ``position`` counts characters of the folded query."""

    def __init__(self, message: str, position: int = 0) -> None:
        super().__init__(message)
        self.message, self.position = message, position

    def pretty(self, query: str) -> str:
        return f"{self.message}\n{query}\n{' ' * max(0, min(self.position, len(query)))}^"


@dataclass(frozen=True)
class Term:
    text: str
    phrase: bool = False


@dataclass(frozen=True)
class Not:
    child: Node


@dataclass(frozen=True)
class And:
    children: tuple[Node, ...]


@dataclass(frozen=True)
class Or:
    children: tuple[Node, ...]


@dataclass(frozen=True)
class AtLeast:
    count: int
    children: tuple[Node, ...]


@dataclass(frozen=True)
class Near:
    left: Node
    right: Node
    distance: int = 100


@dataclass(frozen=True)
class Meta:
    field: str
    op: str
    value: str


Node = Union[Term, Not, And, Or, AtLeast, Near, Meta]


def below(node: Node) -> tuple[Node, ...]:
    if isinstance(node, Not):
        return (node.child,)
    if isinstance(node, Near):
        return (node.left, node.right)
    return getattr(node, "children", ())


def walk(node: Node | None) -> Iterator[Node]:
    """All nodes, parents first, from left to right."""
    if node is not None:
        yield node
        for child in below(node):
            yield from walk(child)


def _signed(node: Node | None, positive: bool = True) -> Iterator[tuple[Term, bool]]:
    if isinstance(node, Term):
        yield node, positive
    elif node is not None:
        for child in below(node):
            yield from _signed(child, positive != isinstance(node, Not))


def terms(node: Node | None) -> list[Term]:
    """Distinct terms that can help a document match, in order of appearance."""
    return list(dict.fromkeys(t for t, positive in _signed(node) if positive))


def negative_terms(node: Node | None) -> list[Term]:
    return list(dict.fromkeys(t for t, positive in _signed(node) if not positive))


def all_terms(node: Node | None) -> list[Term]:
    return list(dict.fromkeys(t for t, _ in _signed(node)))


def nears(node: Node | None) -> list[Near]:
    return list(dict.fromkeys(n for n in walk(node) if isinstance(n, Near)))


def metadata_nodes(node: Node | None) -> list[Meta]:
    return [n for n in walk(node) if isinstance(n, Meta)]


def is_monotone(node: Node | None) -> bool:
    """True if more text can only turn a verdict from no to yes."""
    return not any(isinstance(n, Not) or isinstance(n, Meta) and n.field in ("confirmed", "ocr") for n in walk(node))


def requires_term(node: Node | None) -> bool:
    """True if no document without any term of the query can match.

    Only then may chunks be pruned by terms without changing the answer.
    """
    if isinstance(node, (Term, Near)):
        return True
    if isinstance(node, And):
        return any(map(requires_term, node.children))
    if isinstance(node, Or):
        return all(map(requires_term, node.children))
    if isinstance(node, AtLeast):
        return sum(not requires_term(c) for c in node.children) < node.count
    return False


def conjuncts(node: Node | None) -> list[Node]:
    """The parts of a top-level AND, or the query itself."""
    if node is None:
        return []
    return [x for c in node.children for x in conjuncts(c)] if isinstance(node, And) else [node]
