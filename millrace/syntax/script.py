"""JavaScript and TypeScript, and PHP: statements, members and list elements by a scanner of brackets.

The scanner knows strings, templates, regular expressions and comments, so that nothing is cut inside
them; it doesn't check a statement's own grammar. Brackets that don't match are a failure.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from millrace.syntax.tree import Import, Node, ParseFailure, Symbol, Tree

# Fixed values of the languages.
MODIFIERS = frozenset("export default declare abstract async public private protected static readonly override final accessor".split())
BLOCK_WORDS = frozenset("if for foreach while do try switch function fn class interface enum trait namespace module with match declare".split())
HEADERS = frozenset("if for foreach while with switch elseif catch".split())
GOES_ON = frozenset("else elseif catch finally instanceof insteadof in of as satisfies extends implements".split())
OPERAND_FOLLOWS = frozenset("return typeof instanceof in of new delete void throw case do else await yield extends default".split())
KINDS = {"class": "class", "interface": "interface", "enum": "enum", "type": "type", "function": "function", "trait": "class", "namespace": None, "module": None}

_BASE = r"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z)%s)|(?P<string>"(?:[^"\\%s]|\\.)*"|'(?:[^'\\%s]|\\.)*')|(?P<word>[%s\w]+)|(?P<mark>=>|\+\+|--|\?\.|\.\.\.|->|::|[{}()\[\];,]|.)"""
_SCRIPT = re.compile(_BASE % ("", r"\n", r"\n", r"\$#@"), re.S)
_PHP = re.compile(r"(?P<heredoc><<<[ \t]*[\"']?(?P<label>[A-Za-z_]\w*)[\"']?\r?\n(?:.*?\n)??[ \t]*(?P=label)\b)|" + _BASE % (r"|\#(?!\[)[^\n]*?(?=\?>|\n|\Z)", "", "", r"\$\\"), re.S)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_PAIR = {"{": "}", "(": ")", "[": "]"}


@dataclass(slots=True)
class Part:
    """A token, or a bracketed group with its parts."""

    kind: str
    start: int
    end: int
    text: str = ""
    parts: list[Part] = field(default_factory=list)
    breaks: bool = False  # whether a line ends before it
    role: str = ""


def _template(text: str, at: int) -> tuple[int, list[tuple[int, int]]]:
    """The end of the template literal that begins at `at`, and the ranges of its substitutions' code."""
    held, at = [], at + 1
    while at < len(text):
        c = text[at]
        if c == "\\":
            at += 2
        elif c == "`":
            return at + 1, held
        elif text.startswith("${", at):
            end = _group_end(text, at + 2)
            held.append((at + 2, end))
            at = end + 1
        else:
            at += 1
    raise ParseFailure("a template isn't closed")


def _group_end(text: str, at: int) -> int:
    """The place of the brace that closes a substitution whose code begins at `at`; templates inside may nest."""
    depth, before = 0, ""
    while at < len(text):
        if text[at] == "`":
            at, before = _template(text, at)[0], "`"
            continue
        found = _SCRIPT.match(text, at)
        if text[at] == "/" and not found["comment"] and not _operand(before) and (regex := _REGEX.match(text, at)):
            at, before = regex.end(), ")"
            continue
        mark = found["mark"]
        if mark == "}" and not depth:
            return at
        depth += (mark == "{") - (mark == "}")
        if not found["space"] and not found["comment"]:
            before = found[0]
        at = found.end()
    raise ParseFailure("a substitution isn't closed")


def _operand(text: str) -> bool:
    """Whether a token before it makes a slash a division."""
    return bool(text) and (text in (")", "]", "}", "`", "++", "--") or text[0] in "\"'`" or (re.match(r"[\w$#@]", text) is not None and text not in OPERAND_FOLLOWS))


def scan(text: str, start: int, end: int, php: bool = False) -> list[Part]:
    """The parts of a range of code, brackets matched; deep nesting needs no recursion."""
    top: list[Part] = []
    stack: list[tuple[Part | None, list[Part]]] = [(None, top)]
    at, breaks, before = start, False, ""
    rules = _PHP if php else _SCRIPT
    while at < end:
        c = text[at]
        if c == "`":
            if php:
                stop = text.find("`", at + 1, end) + 1
                if not stop:
                    raise ParseFailure(f"the command at {at} isn't closed")
            else:
                stop, _ = _template(text, at)
            kind, token = "string", "`"
        elif c == "/" and not php and not _operand(before) and (found := _REGEX.match(text, at, end)):
            kind, stop, token = "string", found.end(), ")"
        else:
            found = rules.match(text, at, end)
            kind, stop, token = found.lastgroup, found.end(), found[0]
            kind = "heredoc" if php and found["heredoc"] else kind
            if kind == "comment" and token.startswith("/*") and (len(token) < 4 or not token.endswith("*/")):
                raise ParseFailure(f"the comment at {at} isn't closed")
            if kind in ("space", "comment"):
                breaks = breaks or "\n" in token
                at = stop
                continue
        part = Part(kind, at, stop, token, breaks=breaks)
        if token in _PAIR and kind == "mark":
            part.kind = "group"
            stack[-1][1].append(part)
            stack.append((part, part.parts))
        elif token in ("}", ")", "]") and kind == "mark":
            opened = stack.pop()[0] if len(stack) > 1 else None
            if opened is None or _PAIR[opened.text] != token:
                raise ParseFailure(f"the {token} at {at} closes nothing")
            opened.end = stop
        else:
            stack[-1][1].append(part)
        at, breaks, before = stop, False, token
    if len(stack) > 1:
        raise ParseFailure(f"the {stack[-1][0].text} at {stack[-1][0].start} isn't closed")
    return top


def _head(parts: list[Part]) -> list[Part]:
    """A statement's parts without its modifiers and decorators."""
    at = 0
    while at < len(parts):
        p = parts[at]
        if p.kind == "word" and p.text.startswith("@"):
            at += 1
            while at < len(parts) and (parts[at].text == "." or parts[at].kind == "word" and parts[at - 1].text == "." or parts[at].text == "(" and parts[at].kind == "group"):
                at += 1
        elif p.kind == "mark" and p.text == "#" or p.text == "[" and p.kind == "group" and at and parts[at - 1].text == "#":
            at += 1
        elif p.kind == "word" and p.text in MODIFIERS and at + 1 < len(parts) and not (parts[at + 1].kind == "group" and parts[at + 1].text == "(") and parts[at + 1].text not in ("=", ":", ";"):
            at += 1
        else:
            break
    return parts[at:]


def _is_object(before: Part | None) -> bool:
    """Whether a brace after this part opens a literal, a type or a list of names, not a block."""
    if before is None:
        return False
    if before.kind == "word":
        return before.text in ("return", "default", "in", "of", "yield", "await", "typeof", "import", "export", "type", "from", "throw", "case")
    return before.kind == "mark" and before.text not in ("=>", ";", ">")


def _ends(held: list[Part], after: Part | None, role: str) -> bool:
    """Whether a statement or member that holds these parts ends before the next part."""
    last, head = held[-1], _head(held)
    if last.kind == "mark" and last.text == ";":
        return True
    if after is None:
        return False
    if after.kind == "word" and after.text in GOES_ON or after.kind == "mark" and after.text not in ("@", "#", "*") and not after.text.startswith("@"):
        return False
    first = head[0].text if head and head[0].kind == "word" else ""
    block = last.kind == "group" and last.text == "{" and last.role != "list"
    if block and first == "do" and after.text == "while":
        return False
    if block:
        assigned = any(p.kind == "mark" and p.text == "=" for p in head)
        if first in BLOCK_WORDS or not first and len(head) == 1:
            return not assigned or first != "function"
        if role == "class" and not assigned:
            return True
    if len(held) > 1 and last.kind == "group" and last.text == "(" and held[-2].kind == "word" and held[-2].text in HEADERS and role != "class":
        return False  # the header of a statement without a block
    if last.kind == "word" and last.text in ("else", "do") or held[-1].kind == "word" and held[-1].text.startswith("@"):
        return False
    if not after.breaks or last.kind == "mark" and last.text not in ("++", "--", "!"):
        return False
    if last.kind == "group" and last.text == "(" and len(held) > 1 and held[0].kind == "word" and held[0].text.startswith("@") and not head:
        return False  # a decorator's arguments
    return after.kind in ("word", "string", "heredoc") and not (last.kind == "word" and last.text in OPERAND_FOLLOWS | MODIFIERS and last.text not in ("default", "yield")) or after.kind == "group" and after.text == "{" and block


class Builder:
    """Turns parts into nodes, with the symbols and imports of the statements."""

    def __init__(self, text: str, php: bool):
        self.text, self.php = text, php
        self.symbols: list[Symbol] = []
        self.imports: list[Import] = []

    def build(self, node: Node, parts: list[Part], start: int, end: int) -> None:
        agenda = [(node, parts, start, end, "block", ())]
        while agenda:
            into, inside, begin, stop, role, scope = agenda.pop()
            for held, a, b in self.split(inside, begin, stop, role):
                own = Node(f"script:{'element' if role == 'list' else 'member' if role == 'class' else 'statement'}", a, b)
                into.children.append(own)
                inner, body = scope, ""
                if role != "list":
                    named, body = self.name(held, a, b, scope, role)
                    inner = (*scope, named) if named else scope
                    self.take_import(held, b)
                for k, part in enumerate(held):
                    if part.kind == "group" and part.parts:
                        part_role = part.role or ("list" if part.text != "{" else "block")
                        if part.text == "{" and body and part.role != "list":
                            part_role, body = body, ""
                        group = Node(f"script:{'block' if part.text == '{' else 'list'}", part.start, part.end)
                        own.children.append(group)
                        agenda.append((group, part.parts, part.start + 1, part.end - 1, part_role, inner))

    def split(self, parts: list[Part], start: int, end: int, role: str):
        """(parts, start, end) of each statement, member or element; a range begins where the one before ends."""
        held, at = [], start
        for k, part in enumerate(parts):
            held.append(part)
            if part.kind == "group" and part.text == "{":
                part.role = "list" if _is_object(held[-2] if len(held) > 1 else None) or role == "list" and len(held) == 1 else ""
            after = parts[k + 1] if k + 1 < len(parts) else None
            if part.kind == "mark" and part.text == "," and (role == "list" or role == "enum") or role in ("block", "class", "interface") and _ends(held, after, "class" if role == "interface" else role):
                yield held, at, part.end
                held, at = [], part.end
        if held:
            yield held, at, held[-1].end

    def name(self, held: list[Part], start: int, end: int, scope: tuple[Symbol, ...], role: str) -> tuple[Symbol | None, str]:
        """The symbol that a statement defines, and the role of its body."""
        head = _head(held)
        words = [p for p in head if p.kind == "word"]
        if not words or head[0].kind != "word" and head[0].text not in ("*", "["):
            return None, ""
        first = words[0].text
        if first == "const" and len(words) > 1 and words[1].text == "enum":
            words, first = words[1:], "enum"
        if first in KINDS and len(words) > 1 and head[0].kind == "word" and head[1].text not in ("=", ":", "(", "."):
            kind, name, body = KINDS[first], words[1].text, {"class": "class", "trait": "class", "interface": "interface", "enum": "class" if self.php else "enum"}.get(first, "block")
            if kind is None:
                return None, "block"
            if first == "function" and role == "class":
                kind = "constructor" if name == "__construct" else "method"
        elif role in ("class", "interface") and head[0].kind == "word" and len(head) > 1:
            body, at = "block", 0
            kind = "method"
            if first in ("get", "set") and head[1].kind == "word":
                kind, at = ("getter", "setter")[first == "set"], 1
            name = head[at].text
            follows = head[at + 1] if at + 1 < len(head) else None
            if follows is None or not (follows.kind == "group" and follows.text == "(" or follows.text == "<"):
                return None, ""
            kind = "constructor" if name == "constructor" else kind
        else:
            return None, ""
        stop = next((p.start for p in head if p.kind == "group" and p.text == "{" and p.role != "list"), held[-1].end)
        begin = next((p.start for p in held if p.text not in ("export", "default")), held[0].start)
        signature = " ".join(self.text[begin:stop].split()).rstrip("; ")[:400]
        found = Symbol(name, kind, signature, held[0].start, end, scope)
        self.symbols.append(found)
        return found, body

    def take_import(self, held: list[Part], end: int) -> None:
        first = held[0]
        if first.kind != "word" or first.text not in ("import", "use"):
            return
        if first.text == "use":
            if self.php:
                for source, name in re.findall(r"([\w\\]+)(?:\s+as\s+(\w+))?\s*(?=[,;}])", self.text[first.end : end]):
                    self.imports.append(Import(source, (name or source.rsplit("\\", 1)[-1],), first.start, end))
            return
        sources = [p for p in held if p.kind == "string"] or [q for p in held if p.kind == "group" and p.text == "(" for q in p.parts if q.kind == "string"]
        if not sources or len(held) > 1 and held[1].text in ("(", "."):
            return
        names: list[str] = []
        flat = [q for p in held[1:] for q in ([p, *p.parts] if p.kind == "group" and p.text == "{" else [p])]
        for k, p in enumerate(flat):
            if p.kind == "word" and p.text not in ("from", "as", "type", "require", "with", "assert") and not (k + 1 < len(flat) and flat[k + 1].text == "as"):
                names.append(p.text)
            if p.kind == "string":
                break
        self.imports.append(Import(sources[0].text[1:-1], tuple(dict.fromkeys(names)), first.start, end))

    def done(self, root: Node) -> Tree:
        return Tree(root, sorted(self.symbols, key=lambda s: (s.start, -s.end)), sorted(self.imports, key=lambda i: i.start))


def parse(text: str) -> Tree:
    root, builder = Node("script:document", 0, len(text)), Builder(text, False)
    at = text.find("\n") + 1 or len(text) if text.startswith("#!") else 0
    builder.build(root, scan(text, at, len(text)), at, len(text))
    return builder.done(root)


_PHP_OPEN = re.compile(r"<\?(?:php\b|=)?", re.I)
_PHP_STEP = re.compile(r"""\?>|<<<[ \t]*["']?([A-Za-z_]\w*)["']?\r?\n(?:.*?\n)??[ \t]*\1\b|"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|/\*.*?(?:\*/|\Z)|(?://|\#(?!\[))[^\n]*?(?=\?>|\n|\Z)""", re.S)


def parse_php(text: str) -> Tree:
    """Text outside the marks of code, and statements inside; blocks that go on over a closing mark aren't followed beyond it."""
    root, builder, at = Node("php:document", 0, len(text)), Builder(text, True), 0
    while at < len(text):
        found = _PHP_OPEN.search(text, at)
        stop = found.start() if found else len(text)
        if stop > at:
            root.children.append(Node("php:text", at, stop))
        if not found:
            break
        end = begin = found.end()
        while (step := _PHP_STEP.search(text, end)) and step[0] != "?>":
            end = step.end()
        end, at = (step.start(), step.end()) if step else (len(text), len(text))
        code = Node("php:code", found.start(), at)
        root.children.append(code)
        try:
            parts = scan(text, begin, end, php=True)
        except ParseFailure:
            if "?>" not in text:
                raise
            continue  # a block that goes on in another piece of code
        builder.build(code, parts, begin, end)
    return builder.done(root)
