"""HTML elements, text, comments and doctypes with their places."""

from __future__ import annotations

import re

from millrace.syntax.tree import Node, ParseFailure, Tree, line_nodes

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Start tags that end an open element of the key.
ENDED_BY = {
    "p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option", "optgroup"]), "optgroup": frozenset(["optgroup"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "thead": frozenset(["tbody", "tfoot"]), "tbody": frozenset(["tbody", "tfoot"]), "head": frozenset(["body"]),
}
#: Elements that HTML lets end without an end tag.
OPTIONAL = frozenset(ENDED_BY) | {"html", "body", "tfoot", "colgroup"}

_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"""[^<>"']*+""")


def tag_end(text: str, at: int) -> int:
    """The place after the > of a tag; quotes count if they are closed before the next tag; -1 if there is none."""
    start = at
    while True:
        at = _REST.match(text, at).end()
        c = text[at : at + 1]
        if c == ">":
            return at + 1
        close = text.find(c, at + 1) if c in ('"', "'") else -1
        if close < 0:
            return text.find(">", start) + 1 or -1
        at = close + 1


def parse(text: str, strict: bool = False, kind: str = "html") -> Tree:
    """Elements as `element:<tag>`. Strict: a tag that is never ended, or ends nothing, is a failure; else it is mended."""
    root = Node(f"{kind}:document", 0, len(text))
    stack: list[tuple[str, Node]] = [("", root)]
    open_: dict[str, int] = {}
    at = 0

    def add(what: str, start: int, end: int) -> None:
        if end > start:
            stack[-1][1].children.append(Node(what, start, end, line_nodes(text, start, end, f"{what}:line")))

    def drop(depth: int, end: int) -> None:
        while len(stack) > depth:
            tag, node = stack.pop()
            open_[tag] -= 1
            node.end = end
            if strict and len(stack) > depth and tag not in OPTIONAL:
                raise ParseFailure(f"<{tag}> at {node.start} isn't closed")

    while at < len(text):
        start = text.find("<", at)
        start = len(text) if start < 0 else start
        add("text", at, start)
        if start == len(text):
            break
        if text.startswith("<!--", start):
            end = text.find("-->", start + 4)
            if end < 0 and strict:
                raise ParseFailure(f"the comment at {start} isn't closed")
            at = end + 3 if end >= 0 else len(text)
            add("comment", start, at)
            continue
        if text[start + 1 : start + 2] in ("!", "?"):
            at = text.find(">", start) + 1 or len(text)
            add("doctype" if text[start + 2 : start + 9].lower() == "doctype" else "comment", start, at)
            continue
        found = _OPEN.match(text, start)
        end = tag_end(text, found.end()) if found else -1
        if end < 0:
            if strict and found:
                raise ParseFailure(f"the tag at {start} isn't closed")
            at = start + 1 if not found else len(text)
            add("text", start, at)
            continue
        at, tag = end, found[2].lower()
        if found[1]:
            if open_.get(tag):
                depth = max(k for k, (name, _) in enumerate(stack) if name == tag)
                drop(depth, at)
            elif strict:
                raise ParseFailure(f"</{tag}> at {start} ends nothing")
            else:
                add("text", start, at)
            continue
        while len(stack) > 1 and tag in ENDED_BY.get(stack[-1][0], ()):
            drop(len(stack) - 1, start)
        node = Node(f"element:{tag}", start, at)
        stack[-1][1].children.append(node)
        if tag in VOID or text[at - 2] == "/":
            continue
        stack.append((tag, node))
        open_[tag] = open_.get(tag, 0) + 1
        if tag in RAW:
            close = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(text, at)
            if not close and strict:
                raise ParseFailure(f"<{tag}> at {start} isn't closed")
            inner = close.start() if close else len(text)
            add("text", at, inner)
            at = inner
    if strict and any(tag not in OPTIONAL for tag, _ in stack[1:]):
        raise ParseFailure(f"<{stack[-1][0]}> isn't closed")
    drop(1, len(text))
    return Tree(root)
