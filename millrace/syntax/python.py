"""Python by its own grammar: statements and what they hold, symbols and imports."""

from __future__ import annotations

import ast

from millrace.functions.positions import Utf8Offsets
from millrace.syntax.tree import Import, Node, ParseFailure, Symbol, Tree


def parse(text: str) -> Tree:
    source = text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
    try:
        module = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as error:
        raise ParseFailure(f"Python: {error}") from error
    place = Utf8Offsets(source)
    tree = Tree(Node("python:module", 0, len(text)))
    agenda: list[tuple[ast.AST, Node, tuple[Symbol, ...], bool]] = [(module, tree.root, (), False)]
    while agenda:
        parent, node, scope, in_class = agenda.pop()
        inside = []
        for child in ast.iter_child_nodes(parent):
            # what has no place of its own, as arguments and handlers' parts, passes its children on; contexts and operators have none
            if hasattr(child, "lineno"):
                inside.append(child)
            elif child._fields:
                inside += [c for c in ast.walk(child) if hasattr(c, "lineno")]
        at = node.start
        for start, end, child in sorted(((*_range(place, c), c) for c in inside), key=lambda x: (x[0], -x[1])):
            if start < at or end > node.end or end <= start:
                continue
            at = end
            own = Node(f"python:{type(child).__name__}", start, end)
            node.children.append(own)
            named, class_ = scope, in_class
            if isinstance(child, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                class_ = isinstance(child, ast.ClassDef)
                kind = "class" if class_ else "function" if not in_class else "constructor" if child.name == "__init__" else "method"
                first = place.at(child.lineno, child.col_offset)
                header = " ".join(text[first : place.at(child.body[0].lineno, child.body[0].col_offset)].split())[:400].rstrip(": ")
                symbol = Symbol(child.name, kind, header, start, end, scope)
                tree.symbols.append(symbol)
                named = (*scope, symbol)
            elif isinstance(child, (ast.Import, ast.ImportFrom)):
                module_ = "." * getattr(child, "level", 0) + (getattr(child, "module", None) or "")
                for source_ in [module_] if isinstance(child, ast.ImportFrom) else [a.name for a in child.names]:
                    bound = child.names if isinstance(child, ast.ImportFrom) else [a for a in child.names if a.name == source_]
                    tree.imports.append(Import(source_, tuple((a.asname or a.name).split(".")[0] for a in bound), start, end))
            agenda.append((child, own, named, class_))
    tree.symbols.sort(key=lambda s: (s.start, -s.end))
    tree.imports.sort(key=lambda i: (i.start, i.source))
    return tree


def _range(place: Utf8Offsets, node: ast.AST) -> tuple[int, int]:
    marks = getattr(node, "decorator_list", None)
    first = min([node, *marks], key=lambda n: (n.lineno, n.col_offset)) if marks else node
    start = place.at(first.lineno, first.col_offset)
    return start - (first is not node), place.at(node.end_lineno, node.end_col_offset)
