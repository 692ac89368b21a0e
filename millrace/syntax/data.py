"""JSON, strictly, with the places of its values."""

from __future__ import annotations

import json
import re

from millrace.syntax.tree import Node, ParseFailure, Tree

_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\.)*")|(-?\d[-+.eE\d]*|true|false|null))')


def _refuse(name: str):
    raise ParseFailure(f"{name} is no JSON")


def parse(text: str) -> Tree:
    try:
        json.loads(text, parse_constant=_refuse)
    except (ValueError, RecursionError) as error:
        raise ParseFailure(f"JSON: {error}") from error
    root = Node("json:document", 0, len(text))
    stack = [root]

    def value_ended(end: int) -> None:
        """A property ends with its value."""
        if stack[-1].kind == "json:property" and len(stack[-1].children) > 1:
            stack.pop().end = end

    at = 0
    while found := _TOKEN.match(text, at):
        at = found.end()
        mark, string, plain = found.groups()
        start = found.start(found.lastindex)
        top = stack[-1]
        if mark in ("{", "["):
            node = Node("json:object" if mark == "{" else "json:array", start, at)
            top.children.append(node)
            stack.append(node)
        elif mark in ("}", "]"):
            stack.pop().end = at
            value_ended(at)
        elif mark is None:
            if string and top.kind == "json:object":
                node = Node("json:property", start, at, [Node("json:key", start, at)])
                top.children.append(node)
                stack.append(node)
            else:
                top.children.append(Node("json:string" if string else "json:literal", start, at))
                value_ended(at)
    return Tree(root)
