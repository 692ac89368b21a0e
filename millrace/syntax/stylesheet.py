"""CSS and SCSS: rules, at-rules and declarations, nested."""

from __future__ import annotations

import re

from millrace.syntax.tree import Node, ParseFailure, Tree

_STEP = re.compile(r"""[^{};"'/()#]+|/\*.*?(?:\*/|\Z)|//[^\n]*|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|#\{|.""", re.S)
_URL = re.compile(r"""url\(\s*(?!["'])[^)]*\)""", re.I)


def parse(text: str, line_comments: bool = True) -> Tree:
    root = Node("css:document", 0, len(text))
    stack, at, begin, round_, inserts = [root], 0, 0, 0, []

    def ended(end: int) -> None:
        """What stands since `begin` is a declaration or a statement."""
        nonlocal begin
        own = text[begin:end]
        if own.strip().strip(";"):
            lead = len(own) - len(own.lstrip())
            stack[-1].children.append(Node("css:atrule" if own.lstrip().startswith("@") else "css:declaration", begin + lead, end))
        begin = end

    while at < len(text):
        url = _URL.match(text, at - 3) if text[at] == "(" and at >= 3 else None
        if url and url.end() > at:
            at = url.end()
            continue
        found = _STEP.match(text, at)
        token = found[0]
        start, at = at, found.end()
        if token.startswith("/*"):
            if not token.endswith("*/") or len(token) < 4:
                raise ParseFailure(f"the comment at {start} isn't closed")
            if not text[begin:start].strip():
                stack[-1].children.append(Node("css:comment", start, at))
                begin = at
        elif token.startswith("//") and line_comments and (start == 0 or text[start - 1] != ":"):
            if not text[begin:start].strip():
                stack[-1].children.append(Node("css:comment", start, at))
                begin = at
        elif token in ('"', "'"):
            raise ParseFailure(f"the string at {start} isn't closed")
        elif token == "(":
            round_ += 1
        elif token == ")":
            round_ = max(0, round_ - 1)
        elif token == "#{":
            inserts.append(len(stack))
        elif token == "}" and inserts and inserts[-1] == len(stack):
            inserts.pop()
        elif round_:
            continue
        elif token == ";":
            ended(at)
        elif token == "{":
            own = text[begin:start]
            lead = len(own) - len(own.lstrip())
            node = Node("css:atrule" if own.lstrip().startswith("@") else "css:rule", begin + lead, at)
            stack[-1].children.append(node)
            stack.append(node)
            begin = at
        elif token == "}":
            if len(stack) == 1:
                raise ParseFailure(f"the brace at {start} closes nothing")
            ended(start)
            stack.pop().end = begin = at
    if len(stack) > 1:
        raise ParseFailure(f"the block at {stack[-1].start} isn't closed")
    ended(len(text.rstrip()) if text[begin:].strip() else len(text))
    return Tree(root)
