"""Main-text extraction by removal of site templates: element subtrees that recur on many pages of a host."""

from __future__ import annotations

import hashlib
import html
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut, sliced

#: A subtree is a site template if it stands in at least so many contexts of its host, and this share of its different pages.
MIN_PAGES, MIN_SHARE = 10, 0.05
#: Up to so many template keys, 8 bytes each, are broadcast; more are joined to the pages by a shuffle.
SMALL = 500_000

# Fixed values of HTML: kinds of elements by name.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt td th figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements of text alone, which lay nothing out.
TEXT = HEADINGS | frozenset("p blockquote pre dd dt figcaption".split())
ROOTS = frozenset(("article", "main"))
#: Elements that never hold an article's text.
APART = frozenset("nav header footer aside form script style noscript iframe template svg button select textarea input dialog menu head title object canvas audio video fieldset search".split())
#: Words of class, id or role that mark what is not the article.
MARKS = frozenset(
    "nav navbar navigation menubar breadcrumb breadcrumbs masthead banner footer colophon sidebar aside complementary contentinfo ad ads advert adverts advertisement advertising sponsor sponsored promo promotion partners ourpartners cookie cookies consent gdpr popup modal overlay newsletter subscribe signup share sharing social comment comments commentlist disqus respond reply replies opinions feedback widget widgets toolbar pagination pager".split()
)
#: Words that mark it too, but may also be what a part of an article is about: they count where no prose is.
WEAK = frozenset("header menu search login form copyright legal discussion related recommended recommendations subscription skip".split())
#: Words of notices, which are prose: they count unless a heading opens the element.
NOTICES = frozenset("notice notices alert".split())
#: Words that may stand beside a mark in one class name without changing what it says.
NEUTRAL = frozenset("user users reader readers our site page main top bottom left right primary secondary global section block box bar list links link items item wrapper wrap container area slot unit inner outer body content button buttons post posts article articles icon icons group row col panel text form thread".split())
#: Elements that tell a form around a whole page from one of inputs.
PAGE_PARTS = frozenset("article main section nav header footer h1".split())
#: An open element of the key is ended by a start tag of the values.
ENDED_BY = {
    "p": BLOCK - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "legend", "dialog"},
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option", "optgroup"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "head": frozenset(["body"]),
}
#: Elements that an implied end does not reach beyond.
WALLS = frozenset("html body table td th caption button div section article main aside ul ol dl select blockquote form".split())

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_PLAIN = re.compile(r"[^<>\"']*+")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_MARK_WORD = re.compile(r"[a-z]+")
_HUMP = re.compile(r"([a-z])([A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none")
_MAIN = re.compile(r"\brole\s*=\s*[\"']?main\b")
_HOST = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


class Element:
    __slots__ = ("tag", "attributes", "children", "key", "block", "inside", "holds", "marked", "opened", "prose", "text", "links", "sum")

    def __init__(self, tag: str, attributes: str, inside: bool = False):
        self.tag, self.attributes, self.children, self.key = tag, attributes, [], 0
        self.block = tag in BLOCK
        # whether it is in or is an article or main element; holds a part of a page; how it is marked
        self.inside, self.holds, self.marked = inside or tag in ROOTS, False, 0
        # whether a heading opens it, it holds elements of text; characters, and those in links; see weigh() and sign()
        self.opened, self.prose, self.text, self.links, self.sum = False, False, 0, 0, 0
        if attributes and tag not in ("html", "body"):
            self.marked = _mark(attributes) if len(attributes) < 500 else _mark.__wrapped__(attributes)


class _Ends:
    """Ends of start tags in a page; each stretch of it is looked at a bounded number of times."""

    def __init__(self, page: str):
        self.page, self.last = page, {q: page.rfind(q) for q in "\"'>"}

    def after(self, at: int) -> int:
        """The place of the tag's >, not one in quotes unless the quotes aren't closed or a < comes first; -1 if there is none."""
        page, start = self.page, at
        while True:
            at = _PLAIN.match(page, at).end()
            c = page[at : at + 1]
            if c == ">":
                return at
            if not c or c == "<" or self.last[c] <= at:
                return page.find(">", start) if self.last[">"] >= start else -1
            at = page.find(c, at + 1) + 1


class _Open:
    """The open elements, with where each name stands, and those at which the search for an implied end looks."""

    def __init__(self, top: Element):
        self.stack, self.names, self.stops = [top], {}, []

    def push(self, element: Element) -> None:
        if element.tag in ENDED_BY or element.tag in WALLS:
            self.stops.append(len(self.stack))
        self.names.setdefault(element.tag, []).append(len(self.stack))
        self.stack.append(element)

    def cut(self, depth: int) -> None:
        while len(self.stack) > depth:
            self.names[self.stack.pop().tag].pop()
        while self.stops and self.stops[-1] >= depth:
            self.stops.pop()

    def close(self, name: str) -> None:
        if at := self.names.get(name):
            self.cut(at[-1])

    def imply(self, name: str) -> None:
        """End what a start tag of this name ends. Between walls each kind of stop is open once at most."""
        for depth in reversed(self.stops):
            tag = self.stack[depth].tag
            if name in ENDED_BY.get(tag, ()):
                return self.cut(depth)
            if tag in WALLS:
                return None


def parse(page: str) -> list[Element]:
    """A forgiving element tree, as a list of its elements in the order of their start tags, the page itself first.

    Children are elements and strings of undecoded text; comments are left out. Time and memory grow with the
    length of the page, whatever is in it; no step is recursive.
    """
    top = Element("#page", "")
    order, open_, ends = [top], _Open(top), _Ends(page)
    at, size = 0, len(page)
    while at < size:
        start = page.find("<", at)
        if start < 0:
            start = size
        if start > at:
            open_.stack[-1].children.append(page[at:start])
            at = start
            continue
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = end + 3 if end >= 0 else size
            continue
        if page[at + 1 : at + 2] in ("!", "?"):
            end = page.find(">", at)
            at = end + 1 if end >= 0 else size
            continue
        name = _NAME.match(page, at + 1)
        end = ends.after(name.end()) if name else -1
        if end < 0:
            # a < that opens no tag is text; without any > that follows, so is all the rest
            stop = size if name else at + 1
            open_.stack[-1].children.append(page[at:stop])
            at = stop
            continue
        closing, tag, attributes = name[1], name[2].lower(), page[name.end() : end]
        at = end + 1
        if closing:
            open_.close(tag)
            continue
        open_.imply(tag)
        element = Element(tag, attributes, open_.stack[-1].inside)
        open_.stack[-1].children.append(element)
        order.append(element)
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(page, at)
            at = end.start() if end else size
        open_.push(element)
    weigh(order)
    return order


def weigh(order: list[Element]) -> None:
    """Set what an element holds: parts of a page, prose, characters of text and of links, and whether a heading opens it."""
    for element in reversed(order):  # children come after their parents
        first = None
        element.holds = element.tag in PAGE_PARTS
        element.prose = element.tag in TEXT
        for child in element.children:
            if isinstance(child, str):
                if size := len(child) if not child.isspace() else 0:
                    element.text += size
                    first = first or child
                continue
            first = first or child
            element.holds |= child.holds
            element.prose |= child.prose
            if child.tag not in APART:
                element.text += child.text
                element.links += child.text if child.tag == "a" else child.links
        element.opened = element.tag in HEADINGS or first is not None and not isinstance(first, str) and first.opened


#: What _mark finds, the least first.
HEADER, MAYBE, NOTICE, NAMED, CLASSED, HIDDEN = range(1, 7)


@lru_cache(maxsize=20_000)
def _mark(attributes: str) -> int:
    """How a class, id or role marks boilerplate as a whole, or that the element isn't shown; 0 if none does.

    A name is split at its hyphens, underscores and capitals; one of its words is a mark and each other is
    a mark or neutral: `site-header` and `ad_slot` are marks, `has-sidebar` and `comments-open` say something else.
    """
    most = 0
    for name, *values in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name in ("class", "id", "role"):
            for token in "".join(values).split():
                words = set(_MARK_WORD.findall(_HUMP.sub(r"\1 \2", token).lower()))
                marks = words & (MARKS | WEAK | NOTICES)
                if marks and words <= marks | NEUTRAL:
                    most = max(most, (NAMED if name == "id" else CLASSED) if marks & MARKS else NOTICE if marks & NOTICES else HEADER if marks == {"header"} else MAYBE)
        elif name == "hidden" or name == "aria-hidden" and "true" in values or name == "style" and _HIDDEN.search("".join(values)):
            return HIDDEN
    return most


def apart(element: Element, inside: bool, lenient: bool = False) -> bool:
    """Whether an element is boilerplate by its name or marks.

    In a root, a header may hold text; a form around parts of a page is none of inputs. Ids say what a heading or paragraph is about, and
    words that an article may be about say nothing of an element with prose or a heading. Lenient: marks
    count on no element that holds an article or main element.
    """
    if element.tag in APART and not (inside and element.tag == "header") and not (element.tag in ("form", "fieldset") and element.holds):
        return True
    mark = element.marked
    if not mark or lenient:
        return False
    if mark == HIDDEN:
        return True
    if element.tag in TEXT:
        return mark == CLASSED and element.tag not in HEADINGS
    if mark in (NAMED, CLASSED):
        return True
    if mark == NOTICE:
        return not element.opened
    if mark == HEADER and inside:
        return False
    return mark == HEADER or not ((element.opened or element.prose) and 2 * element.links <= element.text)


def _is_root(element: Element, kind: str) -> bool:
    return element.tag == kind or kind == "main" and bool(element.attributes) and _MAIN.search(element.attributes) is not None


def _roots(top: Element, kind: str, lenient: bool) -> list[Element]:
    found, agenda = [], [top]
    while agenda:
        element = agenda.pop()
        if element is not top and _is_root(element, kind):
            found.append(element)
            continue
        agenda += [c for c in reversed(element.children) if not isinstance(c, str) and not apart(c, False, lenient and (c.holds or _is_root(c, kind)))]
    return found


def main_parts(top: Element) -> tuple[list[Element], bool]:
    """Where the article stands: its article elements, else main ones, else the whole page; and whether it is marked so.

    Those under boilerplate marks, as reader comments are, count only where there are no others. A main element with text of its own
    beside its articles is read whole.
    """
    for lenient in (False, True):
        found, mains = (_roots(top, kind, lenient) for kind in ("article", "main"))
        if found and any(not isinstance(c, str) and c.tag in TEXT for m in mains for c in m.children):
            held = [_roots(m, "article", lenient) for m in mains]
            if sum(map(len, held)) == len(found):
                return mains, True
        if found or mains:
            return found or mains, True
    return [top], False


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def sign(order: list[Element]) -> tuple[dict[int, set[int]], int]:
    """Set the key of every element of a page, a hash of its whole subtree; returns the keys of what may be deleted, with their contexts, and the page's own sum.

    A context is what text is beside the subtree under the same parent, as a sum of hashes: copies of an article hold the
    same parts in one context, while what a site repeats stands in as many as there are different pages. Not among the keys: whole articles
    and pages and, inside an article or main element, blocks of prose, which are text of the page however often they recur.
    """
    found: dict[int, set[int]] = {}
    for element in reversed(order):
        parts = [element.tag, " ".join(element.attributes.split())]
        for child in element.children:
            if isinstance(child, str):
                parts.append(" ".join(child.split()))
                element.sum += _hash(parts[-1]) if parts[-1] else 0
            else:
                parts.append(str(child.key))
                element.sum += 0 if apart(child, child.inside) else child.sum
        element.sum &= (1 << 63) - 1
        element.key = _hash("\x00".join(parts))
    for element in order:
        for child in element.children:
            if not isinstance(child, str) and child.block and child.tag not in ROOTS and child.tag not in ("html", "body") and not (child.inside and child.tag in PROSE):
                beside = element.sum - (0 if apart(child, child.inside) else child.sum)
                found.setdefault(child.key, set()).add(beside & (1 << 63) - 1)
    return found, order[0].sum


def text_of(parts: list[Element], marked: bool, templates) -> str:
    """Blocks of text of the parts without boilerplate and template subtrees, joined by line feeds. What holds most of the text is no template."""
    blocks: list[str] = []
    whole = sum(part.text - part.links for part in parts)
    held: list[str] = []

    def end() -> None:
        if words := html.unescape("".join(held)).split():
            blocks.append(" ".join(words))
        held.clear()

    for part in parts:
        agenda: list = [iter(part.children)]  # None among them ends a block
        while agenda:
            if agenda[-1] is None:
                end()
                agenda.pop()
                continue
            child = next(agenda[-1], None)
            if child is None:
                agenda.pop()
            elif isinstance(child, str):
                held.append(child)
            elif child.tag == "br":
                held.append(" ")
            elif apart(child, marked):
                if child.block:
                    end()
            elif child.block and child.key in templates and child.tag not in ROOTS and not (marked and child.tag in PROSE) and 2 * (child.text - child.links) <= whole:
                end()
            else:
                if child.block:
                    end()
                    agenda.append(None)
                agenda.append(iter(child.children))
        end()
    return "\n".join(blocks)


def _signed(page: str | None) -> tuple[list[Element], bool, dict[int, set[int]], int]:
    order = parse(page or "")
    found, whole = sign(order)
    return *main_parts(order[0]), found, whole


def _count(batches):
    """The (host, subtree, context) of a task's pages, once each as far as they fit; subtree null has the pages' own sums."""
    seen: set = set()

    def emit():
        rows = list(zip(*seen)) or [()] * 3
        seen.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], names=["host", "subtree", "context"])

    for batch in sliced(batches, 64):
        for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
            host = _hash(host_of(url))
            found, whole = _signed(page)[2:]
            seen.add((host, None, whole))
            seen.update((host, key, context) for key, contexts in found.items() for context in contexts)
        if len(seen) > 200_000:
            yield emit()
    yield emit()


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, subtree) keys of the subtrees that recur in at least min_pages different contexts of a host, as many as min_share of its different pages."""
    counted = pages.select("url", "html").mapInArrow(_count, "host long, subtree long, context long").distinct().groupBy("host", "subtree").agg(F.count("*").alias("pages"))
    counted = cut(counted.where((F.col("pages") >= min_pages) | F.col("subtree").isNull()))  # pages are read once for both
    often = counted.where("subtree is not null")
    whole = counted.where("subtree is null").select("host", F.col("pages").alias("whole"))
    return often.join(whole, "host").where(F.col("pages") >= F.lit(min_share) * F.col("whole")).select("host", "subtree")


def _extractor(shared):
    def extract(batches):
        templates = {}
        if shared is not None:
            hosts, subtrees = shared.value
            for host, subtree in zip(hosts.tolist(), subtrees.tolist()):
                templates.setdefault(host, set()).add(subtree)
        for batch in sliced(batches, 64):
            texts, given = [], batch.column("templates").to_pylist() if shared is None else [None] * batch.num_rows
            for url, page, own in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), given):
                parts, marked = _signed(page)[:2]
                texts.append(text_of(parts, marked, set(own or ()) if shared is None else templates.get(_hash(host_of(url)), ())))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return extract


def _list_subtrees(batches):
    for batch in sliced(batches, 64):
        keys, hosts, subtrees = [], [], []
        for key, url, page in zip(batch.column("key").to_pylist(), batch.column("url").to_pylist(), batch.column("html").to_pylist()):
            found = _signed(page)[2]
            keys += [key] * len(found)
            hosts += [_hash(host_of(url))] * len(found)
            subtrees += found
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (keys, hosts, subtrees)], names=["key", "host", "subtree"])


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, small: int = SMALL) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html).

    The article element, else main, else the page is read without elements
    that are boilerplate by name, class, id or role, and without subtrees that recur on many different pages of the host.
    Pages that are copies of one count once, as their parts stand in one context, so however many there are keep their text. Articles and their own paragraphs,
    headings, items and cells are never deleted for recurring, nor is what holds most of a page's text. Character references are decoded, white space inside a block becomes one space,
    blocks are joined by a line feed. A null or empty html gives an empty text, a null url
    counts as one host; repeated rows count and stay each; an empty table gives no rows; other columns are ignored.
    Contexts are made distinct over all keys before they are counted, so a host with a third of all pages is no hot key.
    """
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    out = f"page_id {kinds['page_id']}, url string, text string, n_chars long"
    templates = site_templates(pages, min_pages, min_share)
    spark = pages.sparkSession
    first = templates.limit(small + 1).toArrow()
    if first.num_rows <= small:
        shared = spark.sparkContext.broadcast(tuple(np.asarray(first.column(c)) for c in ("host", "subtree")))
        return pages.select("page_id", "url", "html").mapInArrow(_extractor(shared), out)
    keyed = pages.select("page_id", "url", "html", F.xxhash64("page_id", "url", "html").alias("key"))
    listed = keyed.select("key", "url", "html").mapInArrow(_list_subtrees, "key long, host long, subtree long").distinct()
    own = listed.join(templates, ["host", "subtree"]).groupBy("key").agg(F.collect_set("subtree").alias("templates"))
    return keyed.join(own, "key", "left").select("page_id", "url", "html", "templates").mapInArrow(_extractor(None), out)
