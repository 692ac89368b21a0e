"""Syntax trees over a text, with what is named and imported in it."""

from __future__ import annotations

from dataclasses import dataclass, field


class ParseFailure(ValueError):
    """A text that its parser doesn't accept."""


@dataclass(slots=True)
class Node:
    """A range of the text; children are ordered, apart from each other and inside it."""

    kind: str
    start: int
    end: int
    children: list[Node] = field(default_factory=list)


@dataclass(frozen=True, slots=True)
class Symbol:
    name: str
    kind: str
    signature: str
    start: int
    end: int
    scope: tuple[Symbol, ...] = ()


@dataclass(frozen=True, slots=True)
class Import:
    source: str
    bindings: tuple[str, ...]
    start: int
    end: int


@dataclass(slots=True)
class Tree:
    root: Node
    symbols: list[Symbol] = field(default_factory=list)
    imports: list[Import] = field(default_factory=list)


def check(tree: Tree, size: int) -> Tree:
    """The tree, if its root covers the text and every child lies in its parent, after the child before; else ParseFailure."""
    if (tree.root.start, tree.root.end) != (0, size):
        raise ParseFailure(f"the root covers {tree.root.start}-{tree.root.end} of {size}")
    seen: set[int] = set()
    agenda = [tree.root]
    while agenda:
        node = agenda.pop()
        if id(node) in seen:
            raise ParseFailure(f"{node.kind} at {node.start} stands in the tree twice")
        seen.add(id(node))
        at = node.start
        for child in node.children:
            if not at <= child.start <= child.end <= node.end:
                raise ParseFailure(f"{child.kind} {child.start}-{child.end} overlaps, or leaves {node.kind} {node.start}-{node.end}")
            at = child.end
        agenda += node.children
    for named in (*tree.symbols, *tree.imports):
        if not 0 <= named.start <= named.end <= size:
            raise ParseFailure(f"{named} lies outside the text")
    return tree


def nest(node: Node, by: int) -> Node:
    """The node and all below it, moved by an offset."""
    agenda = [node]
    while agenda:
        now = agenda.pop()
        now.start += by
        now.end += by
        agenda += now.children
    return node


def line_nodes(text: str, start: int, end: int, kind: str) -> list[Node]:
    """A node for each line of a range of several lines, its line end included; none for a single line."""
    out, at = [], start
    while at < end:
        stop = text.find("\n", at, end) + 1 or end
        out.append(Node(kind, at, stop))
        at = stop
    return out if len(out) > 1 else []
