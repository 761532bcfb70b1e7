"""Main text of web pages by wrapper inference: a union-free regular expression for the pages of each host.

A page's tokens become a tree of its block elements; runs of like siblings fold into repeated groups. The pages of a host
are aligned one after another: where elements differ they become optional, where a single meets a run they become a
repeated group, and where texts differ they become slots, which carry how many letters they held. What is left is the host's
wrapper: tags, constant texts with the number of pages that have them, slots, groups with + and ?, and no alternatives.
Wrappers are aligned in tasks first, then in salted parts, then by host, so a host with any share of all pages is never
gathered. A wrapper holds tags and names that are no page's own, and digests instead of long texts, so its size is that of
a page's structure.

The host's wrapper says what the article is, once for all its pages: the topmost article or main elements of the wrapper,
else the element that holds most of the letters in slots. It also says what is left out: elements that by tag, role,
class or id are menus, forms, notices and the like (by whole tokens, and never an element that holds the article or most of
the letters in slots), and texts that are the same on MANY pages or more of the host. A page is walked along the
wrapper, and what stands in slots of the article is its text, one line for each block, references decoded, white space
single. A page that has nothing in the host's article is read by the wrapper of itself alone.

Defined cases: a null or empty page has empty text; a page of a host of its own has only itself to align; a null url
counts as a host without name; unclosed and stray tags are closed and left out as browsers do, near enough; elements nested
deeper than DEEPEST stand one after another at that depth; repeated rows give repeated results; other columns stay, and
result columns take the place of columns of the same name.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import fresh, materialize, quoted

#: Pages of a host on which a text must be the same to be part of the template.
MANY = 5
#: Salts that a host's partial wrappers are dealt to.
SALTS = 64
#: Longest constant text that a wrapper holds as it is; of longer ones it holds a digest.
CONSTANT = 200
#: Depth of a tree, at most.
DEEPEST = 120

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>", re.S)
MARK = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
RAW = frozenset("script style title textarea noscript template svg iframe object canvas math audio video select".split())
DIGEST = re.compile(r"#\d+ [0-9a-f]{32}")
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
BLOCKS = frozenset(
    "html body p div h1 h2 h3 h4 h5 h6 li ul ol menu table thead tbody tfoot tr td th caption section article main header footer nav aside "
    "blockquote pre figure figcaption form fieldset legend dl dt dd hr address details summary dialog center hgroup search button label head".split()
)
DROPPED = frozenset("head nav aside footer form menu dialog button label fieldset search".split())
MAIN = frozenset(("article", "main"))
#: Elements that belong to the article where they stand beside the element that holds most of it.
BESIDE_ARTICLE = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre figure hgroup".split())
#: Words of classes, ids and roles that name what is not the article.
NOT_ARTICLE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "footer comment comments disqus reply replies respond notice notices alert cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription "
    "signup login share sharing social related recommended widget toolbar pagination pager search hidden skip masthead topbar contentinfo complementary".split()
)
PAGE_ONLY = frozenset(("header", "banner", "masthead"))
#: Words that may stand beside those in a token, as in "site-header" or "left_sidebar_2".
BESIDE = frozenset("site page main global top bottom left right primary secondary inner outer box bar block container wrapper wrap section area list links buttons icons form".split())
#: Elements that names never leave out.
NEVER = frozenset(("html", "body", "main", "article"))
#: An open element of the key is closed by an opening one of these.
CLOSED_BY = {
    "p": BLOCKS - {"html", "body", "button", "label", "head"},
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "thead", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"},
    "head": {"body", "article", "main", "nav", "div", "p", "header", "section"},
}


class Element:
    __slots__ = ("tag", "names", "side", "children")

    def __init__(self, tag: str, names: frozenset[str] = frozenset(), side: frozenset[str] = frozenset()):
        self.tag, self.names, self.side, self.children = tag, names, side, []

    @property
    def key(self) -> str:
        return self.tag + "".join("." + n for n in sorted(self.names)) + "".join("!" + n for n in sorted(self.side))


def _names(attributes: str) -> tuple[frozenset[str], frozenset[str]]:
    """Words of an element's class and role that have no digits, and those of them and of its id that name it as not the
    article: whole tokens, or with words of BESIDE."""
    words, side = set(), set()
    for name, a, b, c in MARK.findall(attributes):
        for token in (a or b or c).lower().split():
            parts = {word for word in re.split(r"[^a-z]+", token) if word}
            if name.lower() != "id" and token.isalpha():
                words.add(token)
            if parts <= BESIDE | NOT_ARTICLE | PAGE_ONLY:
                side |= parts - BESIDE
    return frozenset(words), frozenset(side)


def parse(page: str | None) -> Element:
    """Tree of block elements; texts are strings with single spaces, inline markup is gone."""
    root = Element("#page")
    stack, text, at, skip, opened = [root], [], 0, None, Counter()
    page = page or ""

    def end_text() -> None:
        joined = " ".join("".join(text).split())
        text.clear()
        if joined:
            place(joined)

    def place(child: str | Element) -> None:
        deep = stack[DEEPEST:]
        if not deep:
            stack[-1].children.append(child)
        elif isinstance(child, str):  # what of its elements matters stands for all of them
            tag = next((e.tag for e in deep if e.tag in DROPPED or e.tag in MAIN), deep[-1].tag)
            one = Element(tag, deep[-1].names, frozenset().union(*(e.side for e in deep)))
            one.children.append(child)
            stack[DEEPEST - 1].children.append(one)

    for token in TOKEN.finditer(page):
        closing, tag = token[1], (token[2] or "").lower()
        if skip:
            if closing and tag == skip:
                skip, at = None, token.end()
            continue
        text.append(entities.unescape(page[at : token.start()]))
        at = token.end()
        if not tag:
            continue
        if not closing and tag in RAW and not token[3].endswith("/"):
            if tag != "title" or opened["head"]:
                skip = tag
            continue
        if tag == "br":
            text.append(" ")
        if tag not in BLOCKS:
            continue
        end_text()
        if closing:
            while opened[tag]:
                last = stack.pop().tag
                opened[last] -= 1
                if last == tag:
                    break
            continue
        while len(stack) > 1 and tag in CLOSED_BY.get(stack[-1].tag, ()):
            opened[stack.pop().tag] -= 1
        element = Element(tag, *_names(token[3]))
        place(element)
        if tag not in VOID:
            stack.append(element)
            opened[tag] += 1
    if not skip:
        text.append(entities.unescape(page[at:]))
    end_text()
    return root


# A wrapper is a list of nodes: ["c", text] or ["c", text, pages] a constant, with the number of pages that have just that
# text there, ["x"] a slot, ["e", key, wrapper] or ["e", key, wrapper, letters] an element, with the letters of the texts
# right in it on all pages, ["+", node] a node once or more, ["?", node] one that may be missing.


def _shape(node: list) -> str:
    """What makes two nodes alike: their kind, and for elements the key and whether they hold elements."""
    while node[0] in "+?":
        node = node[1]
    return node[1] + "/" * any(_bare(child)[0] == "e" for child in node[2]) if node[0] == "e" else "#"


def fold(nodes: list) -> list:
    """Runs of like siblings as one repeated node."""
    out: list = []
    for node in nodes:
        if out and _shape(out[-1]) == _shape(node) and node[0] in "e+" and out[-1][0] in "e+":
            a = out[-1][1] if out[-1][0] == "+" else out[-1]
            b = node[1] if node[0] == "+" else node
            out[-1] = ["+", merge_nodes(a, b, max)]
        else:
            out.append(node)
    return out


def _constant_of(text: str) -> str:
    return text if len(text) <= CONSTANT else f"#{len(text)} " + hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def _length(constant: str) -> int:
    return int(constant[1:].partition(" ")[0]) if DIGEST.fullmatch(constant) else len(constant)


def wrapper_of(element: Element, counted: bool = False) -> list:
    """The wrapper of one page; its constants carry their pages and letters where ``counted``."""
    nodes = []
    for child in element.children:
        if isinstance(child, str):
            nodes.append(["c", _constant_of(child), *[1] * counted])
        else:
            letters = sum(len(c) for c in child.children if isinstance(c, str))
            nodes.append(["e", child.key, wrapper_of(child, counted), *[letters] * counted])
    return fold(nodes)


def merge_nodes(a: list, b: list, pages: Callable[[int, int], int] = add) -> list:
    """One node for two of the same shape; ``pages`` joins the counts of a constant: max where both are of one page."""
    if a[0] == "?" or b[0] == "?":
        return ["?", merge_nodes(a[1] if a[0] == "?" else a, b[1] if b[0] == "?" else b, pages)]
    if a[0] == "+" or b[0] == "+":
        return ["+", merge_nodes(a[1] if a[0] == "+" else a, b[1] if b[0] == "+" else b, pages)]
    if a[0] == "e":
        return ["e", a[1], align(a[2], b[2], pages), *map(add, a[3:], b[3:])]
    if a[0] == b[0] == "c" and a[1] == b[1]:
        return ["c", a[1], *map(pages, a[2:], b[2:])]
    return ["x"]


def _matched(left: list[str], right: list[str]) -> Iterator[tuple[int, int]]:
    """Places of both that go together, in order: as many as can be.

    A row holds for one place i of the left a bit for each place of the right, the last one lowest: 0 where the longest
    match of left[i:] grows by it, so the zeros among the lowest m - j bits are the length of that with right[j:].
    A row follows from the next one by one addition of whole integers; of all rows every ``step``-th is kept, those
    between are found again on the way.
    """
    m, full, marks = len(right), (1 << len(right)) - 1, {}
    for k, shape in enumerate(reversed(right)):
        marks[shape] = marks.get(shape, 0) | 1 << k

    def before(row: int, shape: str) -> int:
        here = row & marks.get(shape, 0)
        return (row + here | row - here) & full if here else row

    step = math.isqrt(len(left)) + 1
    row, kept = full, {len(left): full}
    for i in range(len(left) - 1, -1, -1):
        row = before(row, left[i])
        if i % step == 0:
            kept[i] = row
    j = 0
    for start in range(0, len(left), step):
        part = left[start : start + step]
        rows = [kept[start + len(part)]]
        for shape in reversed(part):
            rows.append(before(rows[-1], shape))
        for i, shape in enumerate(part, start):
            here, after = rows[start + len(part) - i], rows[start + len(part) - i - 1]
            low = (1 << m - j) - 1
            more = (after & low).bit_count() - (here & low).bit_count()  # what the place adds to the longest match: 0 or 1
            while more and right[j] != shape:
                j += 1
                more += (here >> m - j & 1) - (after >> m - j & 1)
            if j < m and right[j] == shape:
                yield i, j
                j += 1


def align(a: list, b: list, pages: Callable[[int, int], int] = add) -> list:
    """One wrapper for two: what matches in order is merged, what stands on one side only is optional."""
    optional = lambda node: node if node[0] == "?" else ["?", node]
    left, right = [_shape(n) for n in a], [_shape(n) for n in b]
    if left == right:
        return [merge_nodes(x, y, pages) for x, y in zip(a, b)]
    out, i, j = [], 0, 0
    for k, m in _matched(left, right):
        out += [*map(optional, a[i:k]), *map(optional, b[j:m]), merge_nodes(a[k], b[m], pages)]
        i, j = k + 1, m + 1
    return [*out, *map(optional, a[i:]), *map(optional, b[j:])]


@dataclass
class Plan:
    """What a wrapper says about its elements, by identity: those to leave out, and those that are the article."""

    wrapper: list
    pages: int
    out: set[int] = field(default_factory=set)
    main: set[int] = field(default_factory=set)
    tagged: bool = False  # whether article or main elements say where the article is

    def constant(self, text: str, node: list | None) -> bool:
        """Whether the wrapper has the text as a part of the template; in a tagged article all texts are the article's."""
        return not self.tagged and bool(node) and _template(node, self.pages) and node[1] == _constant_of(text)


def _template(node: list, pages: int) -> bool:
    return node[0] == "c" and pages >= MANY and sum(node[2:]) >= MANY


def _letters(element: list, pages: int) -> int:
    """Letters right in an element that aren't the template's, on all pages."""
    texts = [n for n in map(_bare, element[2]) if _template(n, pages)]
    return max(0, sum(element[3:]) - sum(n[2] * _length(n[1]) for n in texts))


def _bare(node: list) -> list:
    while node[0] in "+?":
        node = node[1]
    return node


def _dropped(key: str, inside: bool, spared: bool) -> bool:
    tag, _, side = key.partition("!")
    tag = tag.partition(".")[0]
    if tag in DROPPED or tag == "header" and not inside:
        return True
    return not spared and tag not in NEVER and not (NOT_ARTICLE - PAGE_ONLY if inside else NOT_ARTICLE | PAGE_ONLY).isdisjoint(side.split("!"))


def _tag(key: str) -> str:
    return re.split("[.!]", key, maxsplit=1)[0]


def plan_of(wrapper: list, pages: int = 1) -> Plan:
    """Find the article in a wrapper, and what of it and around it is left out."""
    plan = Plan(wrapper, pages)
    spared: set[int] = set()
    listed: list[tuple[list, int, bool, bool]] = []
    free = False

    def weigh(nodes: list, under: bool) -> tuple[int, bool, bool]:
        """Letters in slots, and whether there are main and article elements; names never leave out what holds these."""
        nonlocal free
        mass, main, article = 0, False, False
        for node in map(_bare, nodes):
            if node[0] != "e":
                continue
            tag = _tag(node[1])
            if tag in DROPPED:
                continue
            named = "!" in node[1] and tag not in NEVER
            free |= tag == "article" and not under
            inner = weigh(node[2], under or named)
            here = inner[0] + _letters(node, pages)
            found = inner[1] or tag == "main", inner[2] or tag == "article"
            if named:
                listed.append((node, here, *found))
            mass, main, article = mass + here, main or found[0], article or found[1]
        return mass, main, article

    whole = weigh(wrapper, False)[0]
    for node, mass, main, article in listed:
        if main or article and not free or 2 * mass > whole:
            spared.add(id(node))
    masses: dict[int, int] = {}

    def settle(nodes: list, inside: bool) -> int:
        """Which elements are left out, and how many letters in slots each of the others holds."""
        mass = 0
        for node in map(_bare, nodes):
            if node[0] != "e":
                continue
            if _dropped(node[1], inside, id(node) in spared):
                plan.out.add(id(node))
                continue
            main = not inside and _tag(node[1]) in MAIN
            masses[id(node)] = settle(node[2], inside or main) + _letters(node, pages)
            mass += masses[id(node)]
            if main:
                plan.main.add(id(node))
        return mass

    whole = settle(wrapper, False)
    plan.tagged = bool(plan.main)
    if not plan.main:
        nodes, at = wrapper, None
        while True:
            inner = [n for n in map(_bare, nodes) if n[0] == "e" and id(n) not in plan.out]
            best = max(inner, key=lambda n: masses[id(n)], default=None)
            if best is None or _tag(best[1]) in ("p", "td", "li") or masses[id(best)] < 0.8 * whole or not whole or at and _letters(at, pages):
                break
            # Headings and paragraphs beside the heaviest element are the article's too, unless the template has them.
            plan.main |= {id(n) for n in inner if n is not best and _tag(n[1]) in BESIDE_ARTICLE and masses[id(n)]}
            nodes, at, whole = best[2], best, masses[id(best)]
        plan.main.add(id(at) if at else id(wrapper))
    return plan


def _along(element: Element, way: list | None) -> list[tuple[Element | str, list | None]]:
    """Children with the nodes of the wrapper that they match, in order."""
    out, at = [], 0
    way = way or []
    for child in element.children:
        shape = "#" if isinstance(child, str) else child.key + "/" * any(not isinstance(c, str) for c in child.children)
        match = None
        for k in range(at, len(way)):
            if _shape(way[k]) == shape:
                node = way[k]
                at = k if node[0] == "+" or node[0] == "?" and node[1][0] == "+" else k + 1
                while node[0] in "+?":
                    node = node[1]
                match = node
                break
        out.append((child, match))
    return out


def _texts(root: Element, plan: Plan) -> Iterator[tuple[str, bool]]:
    """Texts of the article in page order, and whether each is a part of the template."""
    stack = [(iter(_along(root, plan.wrapper)), id(plan.wrapper) in plan.main)]
    while stack:
        child, node = next(stack[-1][0], (None, None))
        inside = stack[-1][1]
        if child is None:
            stack.pop()
        elif isinstance(child, str):
            if inside:
                yield child, plan.constant(child, node)
        elif id(node) not in plan.out if node else not _dropped(child.key, inside, False):
            stack.append((iter(_along(child, node[2] if node else None)), inside or bool(node) and id(node) in plan.main))


def extract(page: str | None, plan: Plan | list | None = None, pages: int = 0) -> str:
    """Main text of a page whose host has this wrapper or plan, aligned over so many pages; of a page by itself without."""
    root = parse(page)
    if plan is not None:
        texts = list(_texts(root, plan if isinstance(plan, Plan) else plan_of(plan, pages)))
        if any(not constant for _, constant in texts):
            return "\n".join(text for text, constant in texts if not constant)
    texts = list(_texts(root, plan_of(wrapper_of(root, True))))
    return "\n".join(text for text, _ in texts)


def host_of(url):
    """Host of a url column, lower case; empty for none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def _merge_rows(rows: Iterator[tuple[str, list, int]]) -> dict[str, tuple[list, int]]:
    merged: dict[str, tuple[list, int]] = {}
    for host, wrapper, pages in rows:
        known = merged.get(host)
        merged[host] = (align(known[0], wrapper), known[1] + pages) if known else (wrapper, pages)
    return merged


WRAPPERS = "host string, wrapper string, pages long"


def _batch(merged: dict[str, tuple[list, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(merged), pa.string()), pa.array([json.dumps(w) for w, _ in merged.values()], pa.string()), pa.array([n for _, n in merged.values()], pa.int64())],
        names=["host", "wrapper", "pages"],
    )


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper as JSON, pages), one row for each host."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, texts = batch.column("host").to_pylist(), batch.column("html")
            yield _batch(_merge_rows((h, wrapper_of(parse(t.as_py()), True), 1) for h, t in zip(hosts, texts)))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged: dict[str, tuple[list, int]] = {}
        for batch in batches:
            rows = zip(*(batch.column(n).to_pylist() for n in ("host", "wrapper", "pages")))
            for host, wrapper, count in rows:
                if merged and host not in merged:  # rows are sorted by host
                    yield _batch(merged)
                    merged = {}
                merged = _merge_rows([*((h, w, n) for h, (w, n) in merged.items()), (host, json.loads(wrapper), count)])
        if merged:
            yield _batch(merged)

    parts = pages.select(host_of(F.col(quoted(url_col))).alias("host"), F.col(quoted(html_col)).alias("html")).mapInArrow(first, WRAPPERS)
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS))).repartition("host", "salt").select("host", "wrapper", "pages")
    part = salted.sortWithinPartitions("host", "wrapper").mapInArrow(again, WRAPPERS)
    return part.repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(again, WRAPPERS)


def extract_pages(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` with text and n_chars."""
    host, of, wrapper_col, pages_col = fresh(pages, "__host", "__of", "__wrapper", "__pages")
    wrappers = materialize(infer_wrappers(pages, url_col, html_col)).select(F.col("host").alias(of), F.col("wrapper").alias(wrapper_col), F.col("pages").alias(pages_col))
    kept = [n for n in pages.columns if n not in ("text", "n_chars")]
    schema = T.StructType([pages.schema[n] for n in kept] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    joined = pages.select("*", host_of(F.col(quoted(url_col))).alias(host)).join(wrappers, F.col(host) == F.col(of), "left")

    # Numbered names: mapInArrow can't take dotted ones.
    given = list(dict.fromkeys([*kept, html_col]))
    numbered = [F.col(quoted(n)).alias(f"c{i}") for i, n in enumerate(given)]
    page_at = given.index(html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Plan] = {}
        for batch in batches:
            texts = []
            for page, wrapper, count in zip(batch.column(page_at), batch.column("wrapper").to_pylist(), batch.column("pages").to_pylist()):
                if len(known) > 1000:
                    known.clear()
                if wrapper is not None and wrapper not in known:
                    known[wrapper] = plan_of(json.loads(wrapper), count)
                texts.append(extract(page.as_py(), known.get(wrapper)))
            columns = [batch.column(i) for i in range(len(kept))] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "text", "n_chars"])

    return joined.select(*numbered, F.col(wrapper_col).alias("wrapper"), F.col(pages_col).alias("pages")).mapInArrow(run, schema)
