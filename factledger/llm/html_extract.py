"""HTML extraction by wrapper induction: main text without the template.

Pages are parsed into DOM trees. Elements that HTML itself gives to menus, forms, scripts and the like are left out at once; so are those
whose class or id says nothing else (`says_noise`), but never for the sake of a class the element that holds the article. What remains is aligned,
by simple tree matching, with the tree of one page of the same host; nodes are told apart by tag and class, and runs of like
siblings are generalised to one repeated node, so a list or the paragraphs of an article are one slot. Over ALL pages of the host it is
counted in how many different pages each slot holds which text, and, as the one page may be a stub or of another layout,
each path of tags too. A text that a slot holds in most pages is template, in that slot only; what varies is content. Of the content the article is what stands
in an `article` or `main` element where there is one, and otherwise what is not mostly links.

Statistics are summed by (host, slot, text) before they are shuffled, so a host with a third of all pages is a few rows a
task; the reference of a host is the squeezed list of one page's paths, one row, and joins by host under AQE's skew handling. Two pages with the same
content count once, so copies do not turn an article into a template.

Defined results: null or empty html gives an empty text; text outside any element is content; broken markup is
repaired as browsers do in simple cases (open paragraphs and items end where the next begins, unknown end tags are dropped);
a null url belongs to the empty host; repeated rows are extracted alike; an empty table gives an empty table; columns
other than page_id, url and html are ignored. Hosts of fewer than `PAGES` different pages have no template, as a text that all of them
share may be their article. Nothing is cut or capped.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factledger.llm import packed
from factledger.llm.common import materialise, table
from factledger.llm.url_filter import host_of

#: Fixed vocabulary of HTML.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section",
    "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Never article text, whatever it says.
OUT = RAW | {"head", "nav", "footer", "aside", "form", "button", "select", "option", "input", "svg", "canvas", "object", "video", "audio", "menu", "dialog", "math"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "form"}
#: Words of a class or id that name what is never article text, and words that may stand beside them in one name.
NOISE = set(
    "ad ads advert adverts advertisement banner sponsor sponsored promo promos promotion promotions nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead cookie cookies "
    "consent notice notification alert popup modal overlay newsletter subscribe subscription share sharing social related recommend recommended recommendations comment comments reply replies "
    "disqus respond response responses discussion gdpr widget widgets toolbar pagination pager login signup search".split()
)
BESIDE = set("area bar block body bottom box button buttons container content global group holder icon icons inner item items left link links list main outer page post posts primary reader readers right row secondary section site slot text thread title top unit user users wall wrap wrapper".split())
#: Names of reader comments, the only ones that an id inside an article is judged by; a section may be the discussion of what the article is about.
TALK = set("comment comments reply replies disqus respond".split())
TALKED = {"section": TALK} | dict.fromkeys(("div", "ul", "ol"), TALK | {"discussion", "response", "responses"})
MAIN = {"article", "main"}
#: A node is template if this share of at least so many different pages of the host have its text.
SHARE, PAGES = 0.5, 5
#: Links take at most this share of a block's text outside an article.
LINKS = 0.5
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<![^>]*(?:>|$)|<\?[^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^<>]*)(?:>|(?=<)|$)", re.S)
_PART = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"[0-9]+")
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_CLOSERS = {x: re.compile(rf"</{x}(?=[\s/>])[^>]*>", re.I) for x in RAW}
#: An element that ends an open one by beginning.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}


class Node:
    """An element; `label` is its tag with its classes, by which trees are aligned."""

    __slots__ = ("tag", "label", "noise", "main", "children")

    def __init__(self, tag: str, label: str = "", noise: bool = False, main: bool = False) -> None:
        self.tag, self.label, self.noise, self.main = tag, label or tag, noise, main
        self.children: list = []  # nodes and texts


def says_noise(names: str, noise: set[str] = NOISE) -> bool:
    """Whether one of the names of a class or id is made of noise words, and of words that may stand beside them, alone."""
    for name in names.lower().split():
        parts = _PART.findall(name)
        if any(x in noise for x in parts) and all(x in noise or x in BESIDE for x in parts):
            return True
    return False


def named_noise(tag: str, name: str, inside: bool) -> bool:
    """Whether the id of an element says that it is no article text; inside an article few ids do."""
    if not name or tag[:1] == "h" and tag[1:].isdigit() or tag == "p":
        return False
    return says_noise(name, TALKED.get(tag, set())) if inside else says_noise(name)


def labelled(tag: str, classes: str) -> str:
    """Numbers in class names differ from page to page and are left out."""
    names = sorted({_DIGITS.sub("", x).replace("/", "_") for x in classes.split()} - {""})
    return f"{tag}.{'.'.join(names)}" if names else tag


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(text)} if text else {}


def said_in(node: Node) -> int:
    """Characters of text in an element, without what is noise there."""
    n, todo = 0, [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            n += len(x.strip())
        elif not x.noise or x is node:
            todo += x.children
    return n


def spare_article(mains: list[tuple[Node, list[Node]]]) -> None:
    """If every article stands in noise, or is noise, the largest one is not, nor what it stands in."""
    some = [(said_in(node), -k, node, above) for k, (node, above) in enumerate(mains)]
    some = [x for x in some if x[0]]
    if some and all(node.noise or any(x.noise for x in above) for _, _, node, above in some):
        _, _, node, above = max(some, key=lambda x: x[:2])
        for x in (node, *above):
            x.noise = False


def parse(source: str) -> Node:
    """A tree of elements and decoded texts."""
    root = Node("html")
    stack, at, mains = [root], 0, []

    def say(raw: str) -> None:
        if raw:
            stack[-1].children.append(entities.unescape(raw))

    def close(tags: set[str], stop: set[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return
            if stack[i].tag in stop:
                return

    while True:
        mark, found = at, None
        while found is None:
            mark = source.find("<", mark)
            if mark < 0:
                say(source[at:])
                spare_article(mains)
                return root
            found = _TOKEN.match(source, mark)
            mark += found is None
        say(source[at:mark])
        at = found.end()
        end, tag, rest = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag == "html":
            continue
        if end:
            if tag == "p" and all(x.tag != "p" for x in stack):
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in MAIN and tag not in BLOCK:
                    break
            continue
        given = attributes(rest)
        classes = given.get("class", "")
        noise = tag in OUT or given.get("role", "").lower() in ROLES or "hidden" in given or given.get("aria-hidden") == "true" or (tag not in ("body", "main") and (says_noise(classes) or named_noise(tag, given.get("id", ""), any(x.main for x in stack))))
        node = Node(tag, labelled(tag, classes), noise, tag in MAIN or given.get("role", "").lower() == "main" or given.get("itemprop", "").lower() == "articlebody")
        if tag in BLOCK:
            close({"p"}, {"td", "th", "button", "object"} | MAIN)
        if tag in _ENDS:
            close(_ENDS[tag], {"ul", "ol", "dl", "table", "select"})
        if tag == "header":
            node.noise = not any(x.main for x in stack)
        stack[-1].children.append(node)
        if node.main:
            mains.append((node, list(stack)))
        if tag in RAW:
            closer = _CLOSERS[tag].search(source, at)
            at = closer.end() if closer else len(source)
        elif tag not in VOID and not rest.endswith("/"):
            stack.append(node)


class Block:
    """One block of text: where it stands, what it says, whether it is in the article, and how much of it is links."""

    __slots__ = ("path", "text", "main", "links")

    def __init__(self, path: tuple[str, ...], text: str, main: bool, links: int) -> None:
        self.path, self.text, self.main, self.links = path, text, main, links


def blocks(root: Node) -> list[Block]:
    """Blocks in page order, without what is never article text."""
    out: list[Block] = []
    line: list[str] = []
    state = {"links": 0, "path": (), "main": False}

    def flush() -> None:
        text = " ".join("".join(line).split())
        if text:
            out.append(Block(state["path"], text, state["main"], state["links"]))
        line.clear()
        state["links"] = 0

    todo: list[tuple] = [(root, (), False, False, 0)]
    while todo:
        node, path, main, link, phase = todo.pop()
        if phase:
            flush()
            continue
        if isinstance(node, str):
            if not line:
                state["path"], state["main"] = path, main
            line.append(node)
            state["links"] += len(node) if link else 0
            continue
        if node.noise:
            line.append(" ")
            continue
        if node.tag in ("br", "hr", "wbr", "img"):
            line.append(" " if node.tag != "wbr" else "")
        main, link = main or node.main, link or node.tag == "a"
        if node.tag in BLOCK:
            flush()
            path = (*path, node.label)
            todo.append((node, path, main, link, 1))
        todo += [(c, path, main, link, 0) for c in reversed(node.children)]
    flush()
    return out


class Slot:
    """A tree of block paths; runs of like siblings are one repeated node."""

    __slots__ = ("tag", "children", "texts", "shape", "size")

    def __init__(self, tag: str) -> None:
        self.tag, self.shape, self.size = tag, 0, 1
        self.children: list[Slot] = []
        self.texts: list[int] = []  # numbers of the paths that end right here


def skeleton(paths: tuple[str, ...]) -> Slot:
    root = Slot("")
    for n, path in enumerate(paths):
        at = root
        for tag in path.split("/"):
            if not at.children or at.children[-1].tag != tag:
                at.children.append(Slot(tag))
            at = at.children[-1]
        at.texts.append(n)
    return root


def shape(root: Slot, known: dict) -> None:
    """Gives every node the number of its shape and its size: equal numbers, equal subtrees."""
    todo = [(root, False)]
    while todo:
        node, ready = todo.pop()
        if ready:
            node.shape = known.setdefault((node.tag, *(c.shape for c in node.children)), len(known))
            node.size = 1 + sum(c.size for c in node.children)
        else:
            todo.append((node, True))
            todo += [(c, False) for c in node.children]


def equal_ends(a: Slot, b: Slot) -> tuple[int, int]:
    """How many first and how many last children are alike: matching those to each other is never worse than any other way."""
    n, m = len(a.children), len(b.children)
    most = min(n, m)
    first = next((i for i in range(most) if a.children[i].shape != b.children[i].shape), most)
    last = next((i for i in range(most - first) if a.children[n - 1 - i].shape != b.children[m - 1 - i].shape), most - first)
    return first, last


def match(a: Slot, b: Slot, memo: dict) -> tuple[int, list]:
    """Simple tree matching: the most nodes two trees with like roots share, order and ancestry kept; and the pairs of children.

    Pairs of subtrees wait on a list for those below them, so a tree may be of any depth.
    """
    todo = [(a, b)]
    while todo:
        x, y = todo[-1]
        key = (id(x), id(y))
        if key in memo:
            todo.pop()
            continue
        if x.tag != y.tag:
            memo[key] = (0, [])
            continue
        n, m = len(x.children), len(y.children)
        first, last = equal_ends(x, y)
        left, right = x.children[first : n - last], y.children[first : m - last]
        below = [(p, q) for p in left for q in right if p.tag == q.tag and (id(p), id(q)) not in memo]
        if below:
            todo += below
            continue
        best = np.zeros((len(left) + 1, len(right) + 1), np.int32)
        alike: dict[str, list[int]] = {}
        for j, q in enumerate(right):
            alike.setdefault(q.tag, []).append(j)
        for i, p in enumerate(left):
            own = best[i, :-1].copy()
            at = alike.get(p.tag, [])
            own[at] += np.array([memo[id(p), id(right[j])][0] for j in at], np.int32)
            best[i + 1, 1:] = np.maximum.accumulate(np.maximum(own, best[i, 1:]))
        pairs, i, j = [], len(left), len(right)
        while i and j:
            if best[i, j] == best[i - 1, j]:
                i -= 1
            elif best[i, j] == best[i, j - 1]:
                j -= 1
            else:
                pairs.append((first + i - 1, first + j - 1))
                i, j = i - 1, j - 1
        ends = [*range(first), *range(n - last, n)]
        pairs = [*((i, i) for i in range(first)), *pairs[::-1], *((n - last + i, m - last + i) for i in range(last))]
        memo[key] = (1 + int(best[-1, -1]) + sum(x.children[i].size for i in ends), pairs)
    return memo[id(a), id(b)]


@lru_cache(512)
def aligned(page: tuple[str, ...], reference: tuple[str, ...]) -> tuple[str | None, ...]:
    """The place in the reference's tree of each path of a page, None where it matches none."""
    memo: dict = {}
    out: list[str | None] = [None] * len(page)
    own, other, shapes = skeleton(page), skeleton(reference), {}
    shape(own, shapes)
    shape(other, shapes)
    todo = [(own, other, "")]
    while todo:
        a, b, place = todo.pop()
        for n in a.texts:
            out[n] = place
        for i, j in match(a, b, memo)[1]:
            todo.append((a.children[i], b.children[j], f"{place}/{j}{b.children[j].tag}"))
    return tuple(out)


PARSED = "page_id long, url string, host string, paths array<string>, texts array<string>, main array<boolean>, links array<int>"


def read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of every page, as lists of the same length."""
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            found = [blocks(parse(x)) if x else [] for x in part.column("html").to_pylist()]
            cols = [(["/".join(b.path) for b in page], [b.text for b in page], [b.main for b in page], [b.links for b in page]) for page in found]
            lists = [pa.array([c[i] for c in cols], pa.list_(t)) for i, t in enumerate((pa.string(), pa.string(), pa.bool_(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), part.column("host"), *lists], names=["page_id", "url", "host", "paths", "texts", "main", "links"])


def keys(paths: list[str], said: list[int], reference: list[str]) -> list[tuple[int, ...]]:
    """For each block hashes of its slot and text, if the reference has the slot, and of its path and text."""
    run = [n for n, path in enumerate(paths) if not n or path != paths[n - 1]]
    places = aligned(tuple(paths[n] for n in run), tuple(reference))
    digest = lambda place, text: xxhash.xxh64_intdigest(f"{place} {text}") - (1 << 63)
    out, of = [], -1
    for n, text in enumerate(said):
        of += of + 1 < len(run) and run[of + 1] == n
        spot = digest(f"?{paths[n]}", text)
        out.append((spot,) if places[of] is None else (digest(places[of], text), spot))
    return out


def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, key, whole page) of every block, once for each different page of a batch; the key of a page itself is null."""
    for batch in batches:
        out: set[tuple] = set()
        for host, page, paths, said, reference in zip(*(batch.column(n).to_pylist() for n in ("host", "page", "paths", "said", "reference")), strict=True):
            out.update((host, k, page) for block in keys(paths, said, reference) for k in block)
            out.add((host, None, page))
        rows = list(out)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["host", "key", "page"])


def wrappers(parsed: DataFrame, share: float = SHARE, least: int = PAGES) -> DataFrame:
    """host, reference (squeezed paths of one page), template: keys of the texts that one slot holds in most different pages of the host."""
    some = parsed.filter(F.size("paths") > 0).select("host", "paths", F.transform("texts", lambda x: F.xxhash64(x)).alias("said")).withColumn("page", F.xxhash64("said"))
    squeezed = F.filter("paths", lambda x, i: ~x.eqNullSafe(F.get("paths", i - 1)))
    # Stored, so that the joins by host stand on their own and a hot host can be split there.
    reference = materialise(some.groupBy("host").agg(F.min(F.struct("page", squeezed.alias("reference"))).alias("r")).select("host", "r.reference"))
    seen = some.join(reference, "host").select("host", "page", "paths", "said", "reference").mapInArrow(packed.frugal(facts), "host string, key long, page long").distinct()
    counted = seen.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n"))
    total = counted.filter("key is null").select("host", F.col("n").alias("pages"))
    same = counted.filter("key is not null").join(total, "host").filter((F.col("n") >= F.lit(least)) & (F.col("n") >= F.col("pages") * F.lit(share)))
    template = same.groupBy("host").agg(F.collect_set("key").alias("template"))  # at most 1 / share texts a slot
    return materialise(reference.join(template, "host", "left"))


def articles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The content blocks of each page, joined by line feeds: those inside the article, or else those that are not mostly links."""
    for batch in batches:
        out = []
        for paths, texts, main, links, said, reference, template in zip(*(batch.column(n).to_pylist() for n in ("paths", "texts", "main", "links", "said", "reference", "template")), strict=True):
            rest = range(len(texts))
            if template:
                known = set(template)
                rest = [n for n, k in enumerate(keys(paths, said, reference)) if known.isdisjoint(k)]
            inside = [texts[n] for n in rest if main[n]] or [texts[n] for n in rest if links[n] <= len(texts[n]) * LINKS]
            out.append("\n".join(inside))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, share: float = SHARE, least: int = PAGES) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages(page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host_of(F.col("url")).alias("host"), "html")
    parsed = materialise(rows.mapInArrow(packed.frugal(read_blocks), PARSED))
    known = parsed.join(wrappers(parsed, share, least), "host", "left").withColumn("said", F.transform("texts", lambda x: F.xxhash64(x)))
    return known.mapInArrow(packed.frugal(articles), "page_id long, url string, text string, n_chars long")


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
