"""Parsers, the chunker along their trees, and the context of chunks."""

import json
import random

import pytest

from millrace.operators.chunking import Units, chunk, leaf_cuts, syntax_fragments
from millrace.syntax import cast
from millrace.syntax.registry import Registry, standard
from millrace.syntax.tree import Node, ParseFailure, Symbol, Tree, check
from pyspark.sql import functions as F

TYPESCRIPT = """import a, {b as c, type D} from "x";
import * as ns from 'y'
@dec({a: 1})
export default class Foo<T> extends Bar {
  private x = {a: 1, b: [1,2]};
  constructor(readonly y: string) { super(); }
  get z(): number { return this.x.a }
  async m(q = `t ${q ? `in ${1}` : "}"} `): Promise<void> {
    if (q) { return /[/}]/.test(q) } else { throw 1 }
    for (const k of q) foo(k)
  }
}
interface I { a: string; b(): void }
enum E { A = 1, B }
type U = { a: 1 } | null
export function f(a: number, {b}: {b: string}) { return a / 2 / b }
const g = (x) => { return c(x) }
g(1) // }
"""
PYTHON = '''"""doc
string"""
import os.path as p, sys
from . import x as y

@dec
class A(B):
    def __init__(self, é="é😀"):
        s = """
def not_code(): pass
"""
        return 1
    async def m(self): pass

def f():
    return y
'''
MARKDOWN = """---
t: 1
---
# A
para one
still
```py
# not a heading
```
## B
- x
  more

  para
- y
  1. z
> quote
lazy

| a | b |
|---|---|
| 1 | 2 |

Set
===
end 😀
"""
VUE = '<template><p>{{ a }}</p></template>\n<script lang="ts">import q from "q"; export default { data() { return 1 } }\nfunction w() {}</script><style>.a{b:c}</style>'
TWIG = '<div class="{{ a }}">{% if x == "%}" %}<p>t {{ y }} u</p>{% endif %}</div>{# c #}{% verbatim %}{{{% endverbatim %}'
PHP = '<p>x</p><?php namespace A; use B\\C as D; /* } */ class X extends Y { public function __construct($a) { $s = "}"; # c }\n } function m(): int { return 1; } }\n$t = <<<EOT\n } foo\nEOT;\nfunction q() { if (1) { a(); } else { b(); } } ?> tail'
CSS = '@import url(a;b.css);\n.a { color: red; &:hover { x: "}"; } }\n/* } */ @media (x) { .b { c: url(data:;x) } }\n$v: #{1};'
JSON = '{"a": [1, {"b": "x\\"}"}], "c": null}'
HTML = '<!DOCTYPE html><p>a<p>b<div x=">">c<br><script>if (a</b>) "</p>"</script></div>'
TEXTS = {"typescript": TYPESCRIPT, "python": PYTHON, "markdown": MARKDOWN, "vue": VUE, "twig": TWIG, "php": PHP, "css": CSS, "json": JSON, "html": HTML}


def kinds(node):
    return [node.kind, *(k for c in node.children for k in kinds(c))]


@pytest.mark.parametrize("language", sorted(TEXTS))
@pytest.mark.parametrize("most", [1, 7, 40, 100, 10_000])
def test_chunks_cover(language, most):
    units = Units(TEXTS[language] * 3 if language not in ("json", "html", "python", "vue") else TEXTS[language])
    found, _ = syntax_fragments(units, most, language)
    assert [f.start for f in found] == [0, *(f.end for f in found[:-1])] and found[-1].end == len(units.text)
    assert all(f.size <= most or f.lean is not None for f in found) or most == 1 and units.wide


def test_no_cut_inside_strings_and_fences():
    for language, text, whole in (("typescript", TYPESCRIPT, '`t ${q ? `in ${1}` : "}"} `'), ("python", PYTHON, '"""\ndef not_code(): pass\n"""'), ("markdown", MARKDOWN, "```py\n# not a heading\n```"), ("css", CSS, '"}"'), ("php", PHP, "<<<EOT\n } foo\nEOT")):
        units = Units(text)
        at = units.text.index(whole)
        found, _ = syntax_fragments(units, max(60, len(whole) + 25), language)
        assert not [f.start for f in found if at < f.start < at + len(whole)], language


def test_symbols_and_imports():
    told = lambda language: standard().parse(Units(TEXTS[language]).text, language)
    tree = told("typescript")
    assert [(s.kind, s.name, [x.name for x in s.scope]) for s in tree.symbols] == [
        ("class", "Foo", []), ("constructor", "constructor", ["Foo"]), ("getter", "z", ["Foo"]), ("method", "m", ["Foo"]), ("interface", "I", []), ("method", "b", ["I"]), ("enum", "E", []), ("type", "U", []), ("function", "f", []),
    ]
    assert tree.symbols[3].signature == 'async m(q = `t ${q ? `in ${1}` : "}"} `): Promise<void>'
    assert [(i.source, i.bindings) for i in tree.imports] == [("x", ("a", "c", "D")), ("y", ("ns",))]
    tree = told("python")
    assert [(s.kind, s.name, s.signature) for s in tree.symbols] == [("class", "A", "class A(B)"), ("constructor", "__init__", Units('def __init__(self, é="é😀")').text), ("method", "m", "async def m(self)"), ("function", "f", "def f()")]
    assert [(i.source, i.bindings) for i in tree.imports] == [("os.path", ("p",)), ("sys", ("sys",)), (".", ("y",))]
    assert [(s.kind, s.name) for s in told("php").symbols] == [("class", "X"), ("constructor", "__construct"), ("method", "m"), ("function", "q")] and told("php").imports[0].bindings == ("D",)
    assert [s.name for s in told("vue").symbols] == ["w"] and told("vue").imports[0].source == "q"


def test_context():
    units = Units(TYPESCRIPT)
    found, tree = syntax_fragments(units, 120, "typescript")
    inner = next(f for f in found if units.text[f.start : f.end].startswith("{\n    if"))
    scope, symbols, used = cast.context(units.text, tree, inner)
    assert [s.name for s in scope] == ["Foo"] or [s.name for s in scope] == ["Foo", "m"]
    last = next(f for f in found if "const g" in units.text[f.start : f.end])
    assert [i[0] for i in cast.context(units.text, tree, last)[2]] == ["x"] and [s.name for s in cast.context(units.text, tree, last)[1]] == ["f"]
    first = cast.context(units.text, tree, found[0])
    assert [i[0] for i in first[2]] == ["x", "y"]


def test_markdown_blocks():
    tree = standard().parse(Units(MARKDOWN).text, "markdown")
    found = kinds(tree.root)
    for kind in ("frontmatter", "section:1", "heading:1", "paragraph", "code", "section:2", "list", "listItem", "blockquote", "table"):
        assert f"markdown:{kind}" in found
    top = [c.kind for c in tree.root.children]
    assert top == ["markdown:frontmatter", "markdown:section:1", "markdown:section:1"]
    assert tree.root.children[1].children[-1].kind == "markdown:section:2"


@pytest.mark.parametrize(
    ("language", "text"),
    [("json", "{'a': 1}"), ("json", "[1,]"), ("json", "NaN"), ("python", "def f(:"), ("typescript", "f({)"), ("typescript", "`${"), ("typescript", "/* "), ("css", "a { b: c"), ("css", "}"), ("css", "/* x"), ("twig", "{{ a"), ("twig", "{% verbatim %}"), ("php", "<?php class A { "), (None, "x"), ("cobol", "x")],
)
def test_failures(language, text):
    with pytest.raises(ParseFailure):
        standard().parse(text, language)


def test_strict_html():
    registry = standard()
    for bad in ("<div>", "</p>", "<b><i></b></i>", "<!-- x", "<a", "<script>x"):
        registry.parse(bad, "html")
        with pytest.raises(ParseFailure):
            registry.parse(bad, "html", "strict")
    assert registry.parse("<ul><li>a<li>b</ul><p>x<p>y<br>", "html", "strict").root.children


def test_deep_texts_need_no_recursion():
    for language, text in (("json", "[" * 900 + "]" * 900), ("html", "<div>" * 50_000), ("typescript", "(" * 20_000 + ")" * 20_000), ("css", "a{" * 20_000 + "}" * 20_000), ("markdown", ">" * 2000 + " x\n"), ("html", "<a " * 100_000)):
        units = Units(text)
        assert syntax_fragments(units, 500, language)[0][-1].end == len(units.text)


def test_registry():
    registry = Registry().add("one", lambda t: Tree(Node("x", 0, len(t))), ("a", None)).add("two", lambda t: Tree(Node("y", 0, len(t) - 1)), ("a", "b"))
    assert registry.find("a") == "one" and registry.find("a", "b") == "two" and registry.find("a", "c") == "one" and registry.find("z") is None
    with pytest.raises(ParseFailure, match="two"):
        registry.parse("text", "a", "b")
    for bad in (("one", ("q", None)), ("Three", ("q", None)), ("three", ("a", None))):
        with pytest.raises(ValueError):
            registry.add(bad[0], len, bad[1])
    with pytest.raises(ParseFailure, match="ZeroDivisionError"):
        Registry().add("broken", lambda t: 1 / 0, ("a", None)).parse("x", "a")


def test_trees_are_checked():
    leaf = Node("l", 2, 4)
    for bad in (Node("r", 0, 9), Node("r", 0, 10, [Node("a", 3, 5), Node("b", 4, 6)]), Node("r", 0, 10, [Node("a", 5, 11)]), Node("r", 0, 10, [leaf, Node("b", 4, 8, [leaf])]), Node("r", 0, 10, [Node("a", 5, 4)])):
        with pytest.raises(ParseFailure):
            check(Tree(bad), 10)
    with pytest.raises(ParseFailure):
        check(Tree(Node("r", 0, 10), [Symbol("s", "class", "", 5, 11)]), 10)


def plain(start, end):
    return [(start, end)]


def test_passes():
    """The three passes on fragments: blank ones lean to a side, unfinished ones join what follows, small ones their larger neighbour."""
    text = "aaaaaaaaaa" + "   " + "bbbbbbbbbb" + "if (x) " + "{ cccccccccc }" + "}" + "dddddddddddddddddddddddddddddd"
    f = cast.Fragment
    parts = [f(0, 10, "a"), f(10, 13, "w", 1), f(13, 23, "b")]
    assert cast._compacted(text, parts, 20) == [f(0, 10, "a"), f(10, 23, "b")]
    parts = [f(0, 10, "a"), f(10, 13, "w", -1), f(13, 23, "b")]
    assert cast._compacted(text, parts, 20) == [f(0, 13, "a"), f(13, 23, "b")]
    parts = [f(0, 23, "a"), f(23, 30, "h"), f(30, 44, "body"), f(44, 75, "rest")]
    assert [(p.start, p.end) for p in cast._compacted(text, parts, 40)] == [(0, 23), (23, 44), (44, 75)]
    parts = [f(0, 44, "a"), f(44, 45, "close"), f(45, 75, "d")]
    assert [(p.start, p.end) for p in cast._compacted(text, parts, 50)] == [(0, 45), (45, 75)]
    parts = [f(0, 10, "small"), f(10, 13, "w", 0), f(13, 30)]
    assert cast._Row(text, parts, 60).small(0) is None


def test_random_trees_are_covered():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice("ab {}();\n  =,") for _ in range(rng.randint(1, 200)))

        def grow(start, end, depth):
            edges = sorted({rng.randint(start, end) for _ in range(rng.randint(0, 6))})
            return Node(rng.choice("xyz"), start, end, [grow(a, b, depth - 1) for a, b in zip(edges[::2], edges[1::2])] if depth else [])

        tree, most = Tree(grow(0, len(text), 3)), rng.randint(1, 60)
        tree.root.start, tree.root.end = 0, len(text)
        units = Units(text)
        found = cast.fragments(text, tree, most, lambda a, b: leaf_cuts(units, a, b, most))
        assert [f.start for f in found] == [0, *(f.end for f in found[:-1])] and found[-1].end == len(text)


def test_chunk_rows_of_syntax(spark):
    rows = [(i, text, language) for i, (language, text) in enumerate(sorted(TEXTS.items()))] + [(90, "{", "json"), (91, None, "json"), (92, "", "html"), (93, "x y z", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, language string")
    found = chunk(docs, "syntax", 60, whole=True).collect()
    by = {}
    for r in found:
        by.setdefault(r["doc_id"], []).append(r)
    for i, text, _ in rows[: len(TEXTS)]:
        assert "".join(r["content"] for r in by[i]) == text and [r["chunk_index"] for r in by[i] if r["searchable"]] == list(range(sum(r["searchable"] for r in by[i])))
    assert by[90][0]["error"].startswith("json: ") and 91 not in by and 92 not in by and by[93][0]["error"]
    assert [r["error"] is None for r in chunk(docs.where("doc_id in (90)"), "syntax", 60, failure="report").collect()] == [False]
    with pytest.raises(Exception, match="json"):
        chunk(docs.where("doc_id = 90"), "syntax", 60, failure="error").collect()
    with pytest.raises(ValueError):
        chunk(docs, "syntax", 0)
    assert json.loads(JSON) and chunk(docs.where("doc_id < 0"), "syntax", 60).count() == 0
    assert chunk(docs.where(F.col("language") == "typescript"), "syntax", 60).where("size(scope) > 0").count() > 0


@pytest.mark.parametrize("language, text", [("python", "def f_{}():\n    pass\n"), ("typescript", "function f_{}() {{ return 1 }}\n"), ("json", '{{"id": {}}}')])
def test_one_piece_of_a_file_is_parsed_by_many_tasks(spark, language, text):
    docs = spark.range(400).coalesce(1).select(F.col("id").alias("doc_id"), F.format_string(text.replace("{}", "%d").replace("{{", "{").replace("}}", "}"), "id").alias("text"), F.lit(language).alias("language"))
    made = chunk(docs, "syntax", 1000).withColumn("task", F.spark_partition_id()).collect()
    by_task = {}
    for row in made:
        by_task.setdefault(row["task"], set()).add(row["doc_id"])
    assert sorted(row["doc_id"] for row in made) == list(range(400))
    assert len(by_task) > 1 and max(map(len, by_task.values())) < 200
