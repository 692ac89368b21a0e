"""Chunks along a syntax tree: nodes are split where they are too large, and merged with their neighbours where they fit."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

from millrace.functions.positions import BLANK
from millrace.syntax.tree import Node, Symbol, Tree

# What a fragment that leads to its follower ends with, how large it and a small fragment may be, and patterns of text between, at the end and at the start of fragments.
LEADING_ENDS = ("=>", ",", "=", "{", "(", "[", ":")
LEADING_WORDS = ("do", "else", "finally", "try")
SMALL_SIZE, SMALL_SHARE, HEADER_SHARE = 512, 0.2, 0.5
SPACE = f"[{BLANK}]"
GAP = re.compile(rf"^{SPACE}*(?:else|finally|while{SPACE}*\()" + rf"{SPACE}*\Z")
DECLARATION = re.compile(rf"(?:^|[{BLANK};{{}}])(?:class|enum|interface|module|namespace){SPACE}+[^;{{}}]+\Z")
RETURN_TYPE = re.compile(rf"\){SPACE}*:{SPACE}*[^;{{}}=]+\Z")
CONTINUATION = re.compile(r"^(?:catch|else|finally)\b")
CLOSER = re.compile(r"^[}\])]")
# End of the fixed values.


@dataclass(frozen=True, slots=True)
class Fragment:
    """A range, the kind of its node if it is one, and of blank nodes only: the side to which they lean (-1, 0 or 1)."""

    start: int
    end: int
    kind: str | None = None
    lean: int | None = None

    @property
    def size(self) -> int:
        return self.end - self.start


def _lean(text: str, node: Node, start: int, end: int) -> int | None:
    """None for a node with words; a blank one leans away from the side on which its range was widened."""
    if text[node.start : node.end].strip(BLANK):
        return None
    return (start < node.start) - (end > node.end)


def _ranges(text: str, node: Node, start: int, end: int) -> Iterator[tuple[Node, int, int]]:
    """The children with their share of the range: what stands between two goes to the first, but a lone else, finally or while( to the second."""
    edges = [start]
    for a, b in zip(node.children, node.children[1:]):
        edges.append(a.end if a.end < b.start and GAP.match(text[a.end : b.start]) else b.start)
    return zip(node.children, edges, [*edges[1:], end])


def _unfinished(own: str) -> bool:
    """Whether text ends in a word after which something has to follow."""
    word = re.search(r"[\w$]*\Z", own)[0]
    return word in LEADING_WORDS


def _heads_block(own: str) -> bool:
    """Whether text is what stands before a block's opening brace: a parameter list, a return type, a declaration or a word."""
    return own[-1] not in ";}" and (own[-1] == ")" or _unfinished(own) or bool(DECLARATION.search(own) or RETURN_TYPE.search(own)))


def _leads(text: str, first: Fragment, then: Fragment | None, most: int) -> bool:
    """Whether a short fragment is unfinished, so that it belongs to the one after it; one that heads a block may be longer."""
    own = "" if first.lean is not None else text[first.start : first.end].rstrip(BLANK)
    if not own:
        return False
    if then and text[then.start : then.end].lstrip(BLANK)[:1] == "{" and _heads_block(own):
        return first.size <= min(SMALL_SIZE, int(most * HEADER_SHARE))
    return first.size <= min(SMALL_SIZE, int(most * SMALL_SHARE)) and (own.endswith(LEADING_ENDS) or _unfinished(own))


def _cut(text: str, root: Node, most: int, leaf) -> list[Fragment]:
    """Fragments in order: a node that fits is one, with the siblings after it while they fit; a larger one is split, a larger leaf cut by `leaf`."""
    out: list[Fragment] = []
    agenda: list[Fragment | tuple[Node, int, int]] = [(root, 0, root.end)]
    while agenda:
        now = agenda.pop()
        if isinstance(now, Fragment):
            out.append(now)
            continue
        node, start, end = now
        lean = _lean(text, node, start, end)
        if end - start <= most or not node.children and lean is not None:
            out.append(Fragment(start, end, node.kind, lean))
        elif not node.children:
            out += [Fragment(a, b, node.kind) for a, b in leaf(start, end)]
        else:
            parts: list[Fragment | tuple[Node, int, int]] = []
            held: Fragment | None = None
            for child, a, b in _ranges(text, node, start, end):
                own = Fragment(a, b, child.kind, _lean(text, child, a, b))
                if own.size > most:
                    if held and _leads(text, held, own, most):
                        a = held.start
                    elif held:
                        parts.append(held)
                    held = None
                    parts.append((child, a, b))
                elif held and b - held.start <= most:
                    held = Fragment(held.start, b, None, _both(held.lean, own.lean))
                else:
                    parts += [held] if held else []
                    held = own
            parts += [held] if held else []
            agenda += reversed(parts)
    return out


def _both(a: int | None, b: int | None) -> int | None:
    return None if a is None or b is None else a if a == b else 0


class _Row:
    """Fragments in a row of which neighbours are joined, each known by the place that it had at first."""

    def __init__(self, text: str, parts: list[Fragment], most: int):
        self.text, self.most = text, most
        self.parts: list[Fragment | None] = list(parts)
        self.left, self.right = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]

    def sides(self, at: int) -> list[int]:
        return [k for k in (self.left[at], self.right[at]) if k >= 0]

    def fit(self, at: int, to: int) -> bool:
        return self.parts[at].size + self.parts[to].size <= self.most

    def blank(self, at: int) -> int | None:
        """Blank text goes to the side that it leans to, or else to the smaller neighbour; to one that is too large anyway, too."""
        own = self.parts[at]
        if own.lean is None:
            return None
        liked = {-1: self.left[at], 1: self.right[at]}.get(own.lean)
        order = sorted(self.sides(at), key=lambda k: self.parts[k].size if own.lean == 0 else k != liked)
        return next((k for k in order if self.fit(at, k) or self.parts[k].size > self.most), None)

    def leading(self, at: int) -> int | None:
        """What leads to its follower joins it."""
        to = self.right[at]
        good = to >= 0 and self.parts[to].lean is None and self.fit(at, to) and _leads(self.text, self.parts[at], self.parts[to], self.most)
        return to if good else None

    def small(self, at: int) -> int | None:
        """A small fragment goes to its larger neighbour, but one that goes on with what is before it, as a catch or a closing bracket does, to that."""
        own = self.parts[at]
        room = [k for k in self.sides(at) if self.parts[k].lean is None and self.fit(at, k)]
        if own.lean is not None or own.size > min(SMALL_SIZE, int(self.most * SMALL_SHARE)) or not room:
            return None
        told = self.text[own.start : own.end].strip(BLANK)
        if self.left[at] in room and (CONTINUATION.search(told) or CLOSER.search(told)):
            return self.left[at]
        return max(room, key=lambda k: self.parts[k].size)

    def join(self, at: int, to: int) -> int:
        """Join two neighbours under the place of the left one."""
        first, second = min(at, to), max(at, to)
        a, b = self.parts[first], self.parts[second]
        blank = [x for x in (a, b) if x.lean is not None]
        kind = (b if blank == [a] else a).kind if len(blank) == 1 else None
        self.parts[first], self.parts[second] = Fragment(a.start, b.end, kind, _both(a.lean, b.lean)), None
        after = self.right[first] = self.right[second]
        if after >= 0:
            self.left[after] = first
        return first


def _compacted(text: str, parts: list[Fragment], most: int) -> list[Fragment]:
    """Fragments joined by what each wants, one kind of wish after another: blank text from the start, leading fragments from the end, small ones from the start.

    Wishes wait in a heap by place; a join leaves new ones to what it made and its neighbours.
    """
    row = _Row(text, parts, most)
    for wish, way in ((row.blank, 1), (row.leading, -1), (row.small, 1)):
        waiting = [way * k for k, part in enumerate(row.parts) if part]
        heapq.heapify(waiting)
        while waiting:
            at = way * heapq.heappop(waiting)
            if row.parts[at] is None or (to := wish(at)) is None:
                continue
            made = row.join(at, to)
            for k in (made, *row.sides(made)):
                heapq.heappush(waiting, way * k)
    return [part for part in row.parts if part]


def fragments(text: str, tree: Tree, most: int, leaf) -> list[Fragment]:
    """Contiguous fragments that cover the text; leaf(start, end) cuts a range that no syntax divides into parts of at most `most`."""
    if not text:
        return []
    parts = _compacted(text, _cut(text, tree.root, most, leaf), most)
    at = 0
    for part in parts:
        if part.start != at:
            raise ValueError(f"chunks cover {at}, then {part.start}")
        at = part.end
    if at != len(text):
        raise ValueError(f"chunks cover {at} of {len(text)}")
    return parts


def context(text: str, tree: Tree, part: Fragment) -> tuple[list[Symbol], list[Symbol], list[tuple[str, tuple[str, ...]]]]:
    """Of a fragment: the symbols around it from the outermost, those that begin in it, and (source, bindings) of imports in it or used by it; each once."""
    around = [s for s in tree.symbols if s.start <= part.start and s.end >= part.end]
    scope = []
    if around:
        nearest = min(around, key=lambda s: (s.end - s.start, s.start))
        scope = [*nearest.scope, nearest]
    defined = [s for s in tree.symbols if part.start <= s.start < part.end]
    own = text[part.start : part.end]
    words = set(re.findall(r"[\w$]+", own)) if tree.imports else set()
    used = [i for i in tree.imports if i.start < part.end and i.end > part.start or any(_occurs(b, own, words) for b in i.bindings)]
    once = lambda symbols: list({(s.kind, s.name, s.signature): s for s in reversed(symbols)}.values())[::-1]
    return once(scope), once(defined), list(dict.fromkeys((i.source, i.bindings) for i in used))


def _occurs(binding: str, text: str, words: set[str]) -> bool:
    return binding in words if re.fullmatch(r"[\w$]+", binding) else bool(re.search(rf"(?<![\w$]){re.escape(binding)}(?![\w$])", text))
