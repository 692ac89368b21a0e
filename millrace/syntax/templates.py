"""Documents that hold others: Vue components and Twig templates."""

from __future__ import annotations

import re
from collections.abc import Callable

from millrace.syntax import html, script, stylesheet
from millrace.syntax.tree import Import, Node, ParseFailure, Symbol, Tree, nest

_LANG = re.compile(r"""\blang\s*=\s*["']?([\w-]+)""")
_TWIG = re.compile(r"\{\{|\{%|\{#")
_CLOSE = {"{{": "}}", "{%": "%}", "{#": "#}"}
_KIND = {"{{": "twig:output", "{%": "twig:tag", "{#": "twig:comment"}
_STRING = re.compile(r""""(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'""", re.S)


def parse_vue(text: str) -> Tree:
    """HTML, with the tree of each top-level script and style in the place of its text; symbols and imports come from the scripts."""
    tree = html.parse(text, kind="vue")
    for block in tree.root.children:
        if block.kind not in ("element:script", "element:style") or not block.children:
            continue
        inner = block.children[0]
        own = text[inner.start : inner.end]
        lang = _LANG.search(text, block.start, inner.start)
        if block.kind == "element:style" and lang and lang[1] not in ("css", "scss", "less", "postcss"):
            continue
        read: Callable[[str], Tree] = script.parse if block.kind == "element:script" else stylesheet.parse
        found = read(own)
        block.children = [nest(found.root, inner.start)]
        by = inner.start
        tree.symbols += [Symbol(s.name, s.kind, s.signature, s.start + by, s.end + by, s.scope) for s in found.symbols]
        tree.imports += [Import(i.source, i.bindings, i.start + by, i.end + by) for i in found.imports]
    return tree


def twig_tokens(text: str) -> list[Node]:
    """The outputs, tags and comments of a template; one that isn't closed is a failure. Quotes hide closing marks but in comments."""
    out, at = [], 0
    while found := _TWIG.search(text, at):
        mark, at = found[0], found.end()
        close = _CLOSE[mark]
        while True:
            end = text.find(close, at)
            if end < 0:
                raise ParseFailure(f"the {mark} at {found.start()} isn't closed")
            quote = re.compile(r"[\"']").search(text, at, end) if mark != "{#" else None
            string = _STRING.match(text, quote.start()) if quote else None
            if string is None:
                break
            at = string.end()
        at = end + 2
        out.append(Node(_KIND[mark], found.start(), at))
        if mark == "{%" and re.match(r"\{%-?\s*verbatim\b", found[0] + text[found.end() : at]):
            stop = re.compile(r"\{%-?\s*endverbatim\s*-?%\}").search(text, at)
            if not stop:
                raise ParseFailure(f"verbatim at {found.start()} isn't closed")
            out[-1].end = at = stop.end()
    return out


def parse_twig(text: str) -> Tree:
    """HTML of the text with its template tokens blanked, and the tokens put into the tree where they fit."""
    tokens = twig_tokens(text)
    blanked, at = [], 0
    for token in tokens:
        blanked += [text[at : token.start], re.sub(r"[^\n]", "\x00", text[token.start : token.end])]
        at = token.end
    tree = html.parse("".join(blanked) + text[at:], kind="twig")
    for token in tokens:
        node = tree.root
        while True:
            inner = next((c for c in node.children if c.start <= token.start and token.end <= c.end and c.kind.startswith("element:")), None)
            if inner is None:
                break
            node = inner
        fits = [k for k, c in enumerate(node.children) if c.start < token.end and token.start < c.end]
        if not fits:
            place = next((k for k, c in enumerate(node.children) if c.start >= token.end), len(node.children))
            node.children.insert(place, token)
        elif len(fits) == 1 and node.children[fits[0]].kind == "text" and node.children[fits[0]].start <= token.start and token.end <= node.children[fits[0]].end:
            held = node.children[fits[0]]
            around = [Node("text", held.start, token.start), token, Node("text", token.end, held.end)]
            node.children[fits[0] : fits[0] + 1] = [n for n in around if n.end > n.start]
    return tree
