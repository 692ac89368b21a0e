"""Which parser reads what: by (language, format) first, by language else."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import partial

from millrace.syntax import data, html, markdown, python, script, stylesheet, templates
from millrace.syntax.tree import ParseFailure, Tree, check

Parser = Callable[[str], Tree]


class Registry:
    """Parsers by id and target. An id is in kebab case and unique, and so is a target."""

    def __init__(self):
        self.ids: dict[str, Parser] = {}
        self.targets: dict[tuple[str, str | None], str] = {}

    def add(self, parser_id: str, parser: Parser, *targets: tuple[str, str | None]) -> Registry:
        if not re.fullmatch(r"[a-z0-9]+(?:-[a-z0-9]+)*", parser_id):
            raise ValueError(f"a parser id is in kebab case, not {parser_id!r}")
        if parser_id in self.ids:
            raise ValueError(f"parser {parser_id!r} is there already")
        if taken := [t for t in targets if t in self.targets]:
            raise ValueError(f"{taken[0]} has a parser already")
        self.ids[parser_id] = parser
        self.targets |= dict.fromkeys(targets, parser_id)
        return self

    def find(self, language: str | None, format_: str | None = None) -> str | None:
        """The id of the parser of a document."""
        return self.targets.get((language or "", format_)) or self.targets.get((language or "", None))

    def parse(self, text: str, language: str | None, format_: str | None = None) -> Tree:
        """The checked tree of a text, in the offsets of its UTF-16 units; any failure of a parser is a ParseFailure that names it."""
        parser_id = self.find(language, format_)
        if parser_id is None:
            raise ParseFailure(f"no parser reads {language or 'this'}")
        try:
            return check(self.ids[parser_id](text), len(text))
        except ParseFailure as error:
            raise ParseFailure(f"{parser_id}: {error}") from error
        except Exception as error:
            raise ParseFailure(f"{parser_id}: {type(error).__name__}: {error}") from error


def standard() -> Registry:
    """The parsers that come with the engine."""
    out = Registry()
    out.add("markdown", markdown.parse, ("markdown", None)).add("html", html.parse, ("html", None)).add("html-strict", partial(html.parse, strict=True), ("html", "strict"))
    out.add("json", data.parse, ("json", None)).add("python", python.parse, ("python", None)).add("php", script.parse_php, ("php", None))
    out.add("script", script.parse, *((x, None) for x in ("javascript", "typescript", "javascriptreact", "typescriptreact")))
    out.add("stylesheet", stylesheet.parse, ("css", None), ("scss", None), ("less", None))
    return out.add("vue", templates.parse_vue, ("vue", None)).add("twig", templates.parse_twig, ("twig", None))
