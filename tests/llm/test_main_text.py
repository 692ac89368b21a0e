"""Main text against a plain second version that finds templates itself, and on pages where templates and articles are hard to tell apart."""

from collections import defaultdict
from html.parser import HTMLParser

import pytest

from millrace.llm import queries, site_templates

DATA = "/root/testdata/sf0.01"
KIND = "page_id long, url string, html string"
GONE = {"nav", "header", "footer", "aside", "form", "script", "style", "head", "title"}


class Tree(HTMLParser):
    """Nested lists (tag, attributes, children) of a page in which only p goes without an end tag."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.top = ("#page", "", [])
        self.path = [self.top]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in site_templates.BLOCK and any(x[0] == "p" for x in self.path):
            self.handle_endtag("p")
        node = (tag, str(attrs), [])
        self.path[-1][2].append(node)
        if tag not in site_templates.VOID:
            self.path.append(node)

    def handle_endtag(self, tag):
        if tag in [x[0] for x in self.path]:
            while self.path.pop()[0] != tag:
                pass

    def handle_data(self, data):
        self.path[-1][2].append(data)


def texts_in(node):
    if isinstance(node, str):
        return [" ".join(node.split())] if node.split() else []
    return [t for child in node[2] for t in texts_in(child)] if node[0] not in GONE else []


def plain_texts(pages):
    """{page_id: text} of (page_id, url, html): templates are subtrees with ten different surroundings, and those of a twentieth of a host's different pages."""
    contexts, different, trees = defaultdict(set), defaultdict(set), []
    for page_id, url, page in pages:
        host, top = site_templates.host_of(url), Tree(page or "").top
        trees.append((page_id, host, top))
        different[host].add(tuple(sorted(texts_in(top))))

        def walk(node, inside):
            for k, child in enumerate(node[2]):
                if isinstance(child, str):
                    continue
                within = inside or child[0] in ("article", "main")
                if child[0] in site_templates.BLOCK - {"article", "main", "html", "body"} and not (within and child[0] in site_templates.PROSE):
                    beside = sorted(t for other in node[2][:k] + node[2][k + 1 :] for t in texts_in(other))
                    contexts[host, repr(child)].add(tuple(beside))
                walk(child, within)

        walk(top, False)
    out = {}
    for page_id, host, top in trees:
        blocks, held = [], []

        def end():
            if words := "".join(held).split():
                blocks.append(" ".join(words))
            held.clear()

        def roots(node, tag):
            return [node] if node[0] == tag else [r for c in node[2] if not isinstance(c, str) and c[0] not in GONE for r in roots(c, tag)]

        found = roots(top, "article") or roots(top, "main")
        whole = sum(len(t) for r in found or [top] for t in texts_in(r))

        def read(node):
            for child in node[2]:
                if isinstance(child, str):
                    held.append(child)
                    continue
                tag, often = child[0], len(contexts.get((host, repr(child)), ()))
                block = tag in site_templates.BLOCK
                if tag == "br":
                    held.append(" ")
                    continue
                if block:
                    end()
                recurs = block and often >= 10 and often >= 0.05 * len(different[host]) and not (found and tag in site_templates.PROSE)
                if tag in GONE and not (found and tag == "header") or recurs and 2 * sum(map(len, texts_in(child))) <= whole:
                    continue
                read(child)
                if block:
                    end()

        for root in found or [top]:
            read(root)
            end()
        out[page_id] = "\n".join(blocks)
    return out


def extracted(spark, pages):
    return {r["page_id"]: r["text"] for r in site_templates.extract(spark.createDataFrame(pages, KIND)).collect()}


def site(shape, copies=12, pages=40):
    """Pages of one host, of which the first are copies of one article; a bar stands on all, a different line beside it."""
    out = []
    for i in range(pages):
        own = "The article that is copied" if i < copies else f"Article {i}"
        body = shape.format(title=own, one=f"{own} says one thing, and says it in some words.", two=f"{own} says another thing, as long as the first.")
        out.append((i, f"http://h.example/{i}", f"<html><body><div class='top'><p>Our site</p><p>All of it</p></div><div>Visitor {i}</div>{body}<footer>f</footer></body></html>"))
    return out


SHAPES = {
    "entry": "<article><div class='entry'><h1>{title}</h1><p>{one}</p><p>{two}</p></div></article>",
    "bare": "<article><div>{one} {two}</div></article>",
    "main": "<main><section><h2>{title}</h2><p>{one}</p><p>{two}</p></section></main>",
    "heading outside": "<article><h1>{title}</h1><div class='entry'><p>{one}</p></div><div><p>{two}</p></div></article>",
    "paragraphs": "<article><h1>{title}</h1><p>{one}</p><p>{two}</p></article>",
}


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("copies", [9, 10, 12, 35])
def test_copies_keep_their_text(spark, shape, copies):
    pages = site(SHAPES[shape], copies)
    got = extracted(spark, pages)
    assert got == plain_texts(pages)
    for i in range(40):
        own = "The article that is copied" if i < copies else f"Article {i}"
        assert got[i].replace("\n", " ").endswith(f"{own} says one thing, and says it in some words. {own} says another thing, as long as the first.")


@pytest.mark.parametrize("copies", [9, 12])
def test_copies_without_an_article_element(spark, copies):
    pages = site("<div class='entry'><h1>{title}</h1><p>{one}</p><p>{two}</p></div>", copies)
    got = extracted(spark, pages)
    assert got == plain_texts(pages)
    assert all("says one thing" in t and "says another" in t and "Our site" not in t for t in got.values())


def test_unmarked_blocks_that_recur_go(spark):
    pages = [(i, "http://h/", f"<article><h1>Title {i}</h1><p>Text {i}</p><div class='x'><p>Written by us</p><ul><li>more</li></ul></div><section><p>Own {i % 30}</p></section></article>") for i in range(30)]
    got = extracted(spark, pages)
    assert got == plain_texts(pages) == {i: f"Title {i}\nText {i}\nOwn {i}" for i in range(30)}


def test_given_pages_against_the_plain_version(spark):
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()]
    assert {r["page_id"]: r["text"] for r in queries.op3_main_text(spark, DATA).collect()} == plain_texts(rows)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article><h1>T</h1><h2 id="search">Search</h2><p>How to find.</p><h2 id="login">Login</h2><p>Sign in.</p><section id="discussion"><h2>Discussion</h2><p>We found that.</p></section></article>', "T\nSearch\nHow to find.\nLogin\nSign in.\nDiscussion\nWe found that."),
        ('<article><p class="legal">A.</p><div class="form"><p>B.</p></div><p id="notice">C.</p><section class="related"><h2>Related work</h2><p>D.</p></section></article>', "A.\nB.\nC.\nRelated work\nD."),
        ('<article><p>Own</p><div class="search"><input><button>Go</button></div><div class="notice"><p>We use cookies</p></div><p class="ad">Buy</p></article>', "Own"),
        ('<article><p>Own</p><section class="comments"><h2>Comments</h2><p>c</p></section><div class="user-opinions"><p>I loved it</p></div><div class="ourpartners">Buy now</div></article>', "Own"),
        ('<article><p>Own</p><section class="related"><h2>Related posts</h2><ul><li><a>One of many</a></li><li><a>Another one</a></li></ul></section></article>', "Own"),
        ("<main><article><p>One</p></article><article><p>Two</p></article><p>Tail.</p></main>", "One\nTwo\nTail."),
        ("<main><article><p>One</p></article><div class='sidebar'><p>s</p></div></main>", "One"),
        ("<body><div hidden><h2>Not</h2></div><h1>Own</h1></body>", "Own"),
    ],
)
def test_words_in_names_and_ids(page, text):
    parts, marked = site_templates._signed(page)[:2]
    assert site_templates.text_of(parts, marked, ()) == text
