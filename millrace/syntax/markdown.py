"""Markdown blocks: sections by headings, fenced and indented code, quotes, lists, tables, raw HTML, paragraphs."""

from __future__ import annotations

import re

from millrace.syntax.tree import Node, Tree, line_nodes

_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]|$)")
_UNDERLINE = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_FENCE = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})")
_QUOTE = re.compile(r" {0,3}> ?")
_ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])(?:([ \t]+)|$)")
_DELIMITER = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_TAG = re.compile(r" {0,3}<(?:(script|pre|style|textarea)\b|(!--)|(\?)|(![A-Za-z])|/?[a-zA-Z][\w-]*(?:[\s/>]|$))", re.I)
_INDENTED = re.compile(r"(?: {4}| {0,3}\t)")
_DEEP = 60

Line = tuple[int, int]  # where a line's own content begins, and its end with the line end left out


class _Blocks:
    def __init__(self, text: str):
        self.text = text

    def own(self, line: Line) -> str:
        return self.text[line[0] : line[1]]

    def blank(self, line: Line) -> bool:
        return not self.own(line).strip()

    def ends_paragraph(self, line: Line) -> bool:
        own = self.own(line)
        if not own.strip() or _HEADING.match(own) or _FENCE.match(own) or _RULE.match(own) or _QUOTE.match(own):
            return True
        item = _ITEM.match(own)
        # only a list that starts at 1 and isn't empty interrupts a paragraph
        return bool(item and item[3] and own[item.end() :].strip() and (item[2] in "-+*" or item[2][:-1] == "1")) or bool(_TAG.match(own) and not re.match(r" {0,3}</?(?:a|b|i|em|strong|span|code|img|br|kbd|sub|sup)\b", own, re.I))

    def parse(self, lines: list[Line], depth: int = 0) -> list[Node]:
        out, i = [], 0
        while i < len(lines):
            if self.blank(lines[i]):
                i += 1
                continue
            node, taken = self.block(lines, i, depth)
            out.append(node)
            i += taken
        return out

    def leaf(self, kind: str, lines: list[Line]) -> Node:
        start, end = lines[0][0], lines[-1][1]
        return Node(f"markdown:{kind}", start, end, line_nodes(self.text, start, end, f"markdown:{kind}:line"))

    def block(self, lines: list[Line], i: int, depth: int) -> tuple[Node, int]:
        own = self.own(lines[i])
        if _INDENTED.match(own):
            end = last = i + 1
            while end < len(lines) and (self.blank(lines[end]) or _INDENTED.match(self.own(lines[end]))):
                end += 1
                last = last if self.blank(lines[end - 1]) else end
            return self.leaf("code", lines[i:last]), last - i
        if found := _HEADING.match(own):
            return Node(f"markdown:heading:{len(found[1])}", *lines[i]), 1
        if found := _FENCE.match(own):
            mark = found[1]
            close = re.compile(rf" {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$")
            end = next((k + 1 for k in range(i + 1, len(lines)) if close.match(self.own(lines[k]))), len(lines))
            return self.leaf("code", lines[i:end]), end - i
        if _RULE.match(own):
            return Node("markdown:thematicBreak", *lines[i]), 1
        if depth < _DEEP and _QUOTE.match(own):
            return self.quote(lines, i, depth)
        if depth < _DEEP and _ITEM.match(own):
            return self.list(lines, i, depth)
        if found := _TAG.match(own):
            stop = f"</{found[1]}>" if found[1] else "-->" if found[2] else "?>" if found[3] else ">" if found[4] else None
            if stop:
                end = next((k + 1 for k in range(i, len(lines)) if stop in self.own(lines[k]).lower()), len(lines))
            else:
                end = next((k for k in range(i, len(lines)) if self.blank(lines[k])), len(lines))
            return self.leaf("html", lines[i:end]), end - i
        if "|" in own and i + 1 < len(lines) and _DELIMITER.match(self.own(lines[i + 1])) and "|" in self.own(lines[i + 1]):
            end = next((k for k in range(i + 2, len(lines)) if self.ends_paragraph(lines[k])), len(lines))
            rows = [Node("markdown:tableRow", *line) for line in lines[i:end]]
            return Node("markdown:table", rows[0].start, rows[-1].end, rows), end - i
        end = i + 1
        while end < len(lines) and not self.blank(lines[end]):
            if found := _UNDERLINE.match(self.own(lines[end])):
                return Node(f"markdown:heading:{1 if found[1][0] == '=' else 2}", lines[i][0], lines[end][1]), end + 1 - i
            if self.ends_paragraph(lines[end]):
                break
            end += 1
        return self.leaf("paragraph", lines[i:end]), end - i

    def quote(self, lines: list[Line], i: int, depth: int) -> tuple[Node, int]:
        inner, end, lazy = [], i, False
        while end < len(lines):
            start, stop = lines[end]
            if found := _QUOTE.match(self.own(lines[end])):
                inner.append((start + found.end(), stop))
                lazy = bool(self.text[start + found.end() : stop].strip())
            elif lazy and not self.ends_paragraph(lines[end]):
                inner.append(lines[end])
            else:
                break
            end += 1
        return Node("markdown:blockquote", lines[i][0], lines[end - 1][1], self.parse(inner, depth + 1)), end - i

    def list(self, lines: list[Line], i: int, depth: int) -> tuple[Node, int]:
        items, end, kind = [], i, None
        while end < len(lines):
            own = self.own(lines[end])
            found = _ITEM.match(own)
            if not found or _RULE.match(own) or kind not in (None, found[2][-1]):
                break
            kind = found[2][-1]
            gap = found[3] or " "
            width = found.end() if found[3] and len(gap.expandtabs(4)) <= 4 else found.end(2) + 1
            start = lines[end][0]
            inner = [(min(start + width, lines[end][1]), lines[end][1])]
            end += 1
            last, lazy = end, bool(self.text[inner[0][0] : inner[0][1]].strip())
            while end < len(lines):
                line, text = lines[end], self.own(lines[end])
                if not text.strip():
                    inner.append((line[1], line[1]))
                    lazy = False
                elif len(text.expandtabs(4)) - len(text.expandtabs(4).lstrip()) >= width:
                    inner.append((line[0] + min(width, len(text) - len(text.lstrip())), line[1]))
                    last, lazy = end + 1, True
                elif lazy and not self.ends_paragraph(line) and not _ITEM.match(text):
                    inner.append(line)
                    last = end + 1
                else:
                    break
                end += 1
            items.append(Node("markdown:listItem", start, lines[last - 1][1], self.parse(inner[: len(inner) - (end - last)], depth + 1)))
            if end < len(lines) and not _ITEM.match(self.own(lines[end])):
                end = last
                break
        end = max(end, i + 1) if items else i + 1
        while end > i + 1 and self.blank(lines[end - 1]):
            end -= 1
        return Node("markdown:list", items[0].start, items[-1].end, items), end - i


def parse(text: str) -> Tree:
    """Blocks under sections: each heading opens one, which lasts to the next heading that isn't deeper."""
    lines, at = [], 0
    for line in text.split("\n"):
        lines.append((at, at + len(line.removesuffix("\r"))))
        at += len(line) + 1
    root = Node("markdown:document", 0, len(text))
    if lines[0] and text.startswith("---") and (end := next((k for k in range(1, len(lines)) if text[slice(*lines[k])].rstrip() in ("---", "...")), 0)):
        root.children.append(Node("markdown:frontmatter", 0, lines[end][1], line_nodes(text, 0, lines[end][1], "markdown:frontmatter:line")))
        lines = lines[end + 1 :]
    open_: list[tuple[int, Node]] = [(0, root)]
    for node in _Blocks(text).parse(lines):
        if node.kind.startswith("markdown:heading:"):
            depth = int(node.kind[-1])
            while open_[-1][0] >= depth:
                open_.pop()[1].end = node.start
            section = Node(f"markdown:section:{depth}", node.start, len(text))
            open_[-1][1].children.append(section)
            open_.append((depth, section))
        open_[-1][1].children.append(node)
    return Tree(root)
