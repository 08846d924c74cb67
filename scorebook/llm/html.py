"""Main text of web pages by wrapper induction.

For every host a bounded sample of its pages is parsed and their trees are aligned
by simple tree matching. Nodes whose text is the same on nearly all aligned pages
are the host's template; the others are slots. The wrapper of a host is the path
to the smallest element that holds most of the slots' text, and the constant texts
inside it. All pages are then read with the wrapper of their host: text below the
content path, without template nodes and without elements that menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles or comments mark by tag,
role or class. A name that only contains a mark word (has-sidebar) drops no element
that holds much of the page's text, an article or the content path. A page that its host's wrapper does not fit is read by the same rule
from its own tree.

A host's sample comes from the first page by hash in each of POOL hash buckets, found
by a partial aggregation, so a host with a third of all pages costs no more than others.
Near copies of a page count once: an article that a host repeats is not its template.

Defined cases: a null or empty html gives an empty text; a null url is a host of its
own; broken markup is read as far as it goes; repeated rows give equal texts.
"""

from __future__ import annotations

import html as entities
import json
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, per_batch, ship

#: Pages of a host that its wrapper is learned from, none longer than this many characters
#: or with more elements than NODES (bounds of the fit; every page is read).
SAMPLE = 12
#: Pages of a host that the sample is taken from: near copies of a page in it are passed over.
POOL = 48
#: Share of the shorter page's text in common that makes two pages near copies.
COPY = 0.7
SAMPLE_CHARS = 200_000
NODES = 1500
#: Share of the aligned pages with the same text that makes a node template, and least pages.
CONSTANT = 0.8
LEAST_PAGES = 4
#: Template texts that are more than this share of an element's text are its article.
MOST = 0.8
#: An element with a mark word inside a longer name stays if it holds more than this share of the page's text
#: and the text outside of all such elements is less than FEW of its own.
SMALL, FEW = 0.3, 0.1
#: Characters in which a tag must end; a longer one ends at its next ">".
TAG_CHARS = 4096
#: Share of an element's slot text that a child must hold to be the content instead.
DOMINANT = 0.6

# Element names and attribute words of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody "
    "td tfoot th thead tr ul".split()
)
SKIPPED = set(
    "head script style noscript template nav footer aside form button select textarea input label iframe object embed "
    "svg math canvas audio video map dialog menu title xmp noembed noframes".split()
)
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
MARKS = set(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar aside nav "
    "navbar navigation menu breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices newsletter "
    "subscribe subscription social share sharing related recommended comment comments disqus replies widget popup modal "
    "overlay toolbar pagination pager login signup search".split()
)
#: Words that with a mark word name the marked block itself.
BLOCK_WORDS = set(
    "list lists section area wrapper wrap block blocks box container left right top bottom inner outer panel region thread "
    "column col holder zone slot unit item items row bar group primary secondary desktop mobile".split()
)
#: Mark words of what readers and other pages add; a block that one begins or ends the name of is no layout.
ADDED = set("comment comments disqus replies related recommended newsletter cookie cookies consent notice notices".split())
#: An open element of the key is closed by the start of one of the values.
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option", "optgroup"}, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"},
}
SCOPES = set("ul ol dl table select html body div section article main td th aside nav header footer form".split())

_NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>")
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_MARK_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    __slots__ = ("tag", "attributes", "children", "_skip", "hinted", "added")

    def __init__(self, tag: str, attributes: str):
        self.tag, self.attributes, self.children, self._skip = tag, attributes, [], None
        self.hinted = self.added = False

    def attribute(self, name: str) -> str | None:
        for m in _ATTRIBUTE.finditer(self.attributes):
            if m[1].lower() == name:
                return m[2] or m[3] or m[4] or ""
        return None

    @property
    def signature(self) -> str:
        names = self.attribute("class") if self.attributes else None
        return f"{self.tag}.{'.'.join(sorted(names.split()))}" if names else self.tag

    @property
    def skipped(self) -> bool:
        """Whether tag, role, class or id mark the element as no part of an article."""
        if self._skip is None:
            self._skip = self.tag in SKIPPED or bool(self.attributes.strip()) and self._marked()
        return self._skip

    def _marked(self) -> bool:
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(self.attributes)}
        if "hidden" in found or found.get("aria-hidden") == "true" or (found.get("role") or "").lower() in ROLES:
            return True
        if re.search(r"display\s*:\s*none", found.get("style", "")):
            return True
        if self.tag in ("html", "body", "article", "main"):
            return False
        names = [
            [w.lower() for w in _MARK_PARTS.findall(n)] for n in f"{found.get('class', '')} {found.get('id', '')}".split()]
        for words in names:
            ends = words[:1] + words[-1:]
            if MARKS.intersection(ends) and all(w in MARKS or w in BLOCK_WORDS for w in words):
                return True
            self.added |= bool(ADDED.intersection(ends))
        # The word is a part of a longer name: `settle` decides by what the element holds.
        self.hinted = any(MARKS.intersection(words) for words in names)
        return self.hinted


def parse(page: str) -> Node:
    """A tree of elements and text; end tags that were left out are supplied."""
    root = Node("", "")
    stack = [root]
    # Text before `at` is in the tree; markup is looked for from `seek` on.
    at = seek = 0
    end = len(page)
    while True:
        start = page.find("<", seek)
        if start < 0:
            start = end
            break
        if page.startswith(("<!", "<?"), start):
            name, attributes, closing = None, "", False
            comment = page.startswith("<!--", start)
            stop = page.find("-->", start + 4) if comment else page.find(">", start)
            if stop < 0 and not comment:
                break  # cut off by the end of the page
            stop = end if stop < 0 else stop + (3 if comment else 1)
        elif (m := _TAG.match(page, start, min(end, start + TAG_CHARS))) is not None:
            closing, name, attributes, stop = m[1], m[2], m[3], m.end()
        elif (m := _NAME.match(page, start)) is not None:
            # Very long, or a quote in it is never closed.
            stop = page.find(">", m.end()) + 1
            if not stop:
                break
            closing, name, attributes = m[1], m[2], page[m.end() : stop - 1]
        else:
            seek = start + 1  # a sign and no tag
            continue
        if start > at:
            stack[-1].children.append(page[at:start])
        at = seek = stop
        if name is None:
            continue
        tag = name.lower()
        if closing:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
                if tag == "p" and stack[depth].tag in SCOPES:
                    break
            continue
        if tag in BLOCKS and tag != "br":
            _close(stack, "p", SCOPES | {"li"})
        for open_tag, starts in CLOSED_BY.items():
            if tag in starts:
                _close(stack, open_tag, SCOPES)
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS:
            continue
        if tag in RAW:
            close = re.compile(f"</{tag}[^>]*>", re.I).search(page, at)
            node.children.append(page[at : close.start()] if close else page[at:])
            at = seek = close.end() if close else end
            continue
        stack.append(node)
    if at < start:
        stack[-1].children.append(page[at:start])
    settle(root)
    return root


def settle(root: Node) -> None:
    """Keeps the elements with a mark word inside a longer name that hold the article.

    They hold it if an article, main or h1 element is in them; or if they hold much of the
    page's text, there is hardly any outside of such elements, and their name is not that of
    what readers or other pages add.
    """
    order, todo = [], [(root, False)]
    outside = 0
    while todo:
        node, inside = todo.pop()
        if not node.skipped or node.hinted:
            inside = inside or node.skipped
            order.append(node)
            if not inside:
                outside += len(own_text(node))
            todo.extend((c, inside) for c in node.children if isinstance(c, Node))
    if not any(n.hinted for n in order):
        return
    mass: dict[int, int] = {}
    article: set[int] = set()
    for node in reversed(order):
        children = [c for c in node.children if isinstance(c, Node)]
        mass[id(node)] = len(own_text(node)) + sum(mass.get(id(c), 0) for c in children)
        if node.tag in ("article", "main", "h1") or any(id(c) in article for c in children):
            article.add(id(node))
    for node in order:
        much = mass[id(node)] > SMALL * mass[id(root)] and outside < FEW * mass[id(node)] and not node.added
        if node.hinted and (id(node) in article or much):
            node._skip = False


def _close(stack: list[Node], tag: str, scopes: set[str]) -> None:
    for depth in range(len(stack) - 1, 0, -1):
        if stack[depth].tag == tag:
            del stack[depth:]
            return
        if stack[depth].tag in scopes:
            return


def own_text(node: Node) -> str:
    """The element's direct text, white space turned into one space."""
    return " ".join(entities.unescape(" ".join(c for c in node.children if isinstance(c, str))).split())


def _key(path: str, text: str) -> str:
    return f"{xxhash.xxh64_intdigest(f'{path}\x00{text}'):016x}"


def text_of(roots: list[tuple[str, Node]], constant: frozenset[str] = frozenset()) -> str:
    """Text below the given elements without skipped ones and template texts; blocks joined by a space."""
    out: list[str] = []
    # (node or text, path, inside a header element: only headings count)
    todo: list[tuple] = [(node, path, False) for path, node in reversed(roots)]
    while todo:
        item, path, heading_only = todo.pop()
        if isinstance(item, str):
            out.append(item)
            continue
        if item.skipped:
            continue
        if item.tag == "header":
            heading_only = True
        elif heading_only and re.fullmatch("h[1-6]", item.tag):
            heading_only = False
        block = item.tag in BLOCKS
        if block:
            out.append(" ")
            todo.append((" ", path, False))
        template = bool(constant) and _key(path, own_text(item)) in constant
        for child in reversed(item.children):
            if isinstance(child, str):
                if not template and not heading_only:
                    todo.append((entities.unescape(child) if "&" in child else child, path, False))
            else:
                todo.append((child, f"{path}/{child.signature}" if constant else path, heading_only))
    return " ".join("".join(out).split())


def match(a: Node, b: Node, pairs: list | None = None) -> int:
    """Simple tree matching: size of the largest top-down matching that keeps order; `pairs` gets it."""
    memo: dict[tuple[int, int], int] = {}

    def inner(x: Node) -> list[Node]:
        return [c for c in x.children if isinstance(c, Node)]

    def size(x: Node, y: Node) -> int:
        return memo[id(x), id(y)] if x.signature == y.signature else 0

    def table(xs: list[Node], ys: list[Node]) -> list[list[int]]:
        rows = [[0] * (len(ys) + 1)]
        for x in xs:
            row, last = [0], rows[-1]
            for j, y in enumerate(ys):
                row.append(max(row[j], last[j + 1], last[j] + size(x, y)))
            rows.append(row)
        return rows

    # Pairs of nodes in an order in which those of their children come later.
    order, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        if x.signature == y.signature and (id(x), id(y)) not in memo:
            memo[id(x), id(y)] = 0
            order.append((x, y))
            todo.extend((c, d) for c in inner(x) for d in inner(y))
    for x, y in reversed(order):
        memo[id(x), id(y)] = 1 + table(inner(x), inner(y))[-1][-1]
    total = size(a, b)
    if pairs is not None and total:
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            pairs.append((x, y))
            xs, ys = inner(x), inner(y)
            rows = table(xs, ys)
            i, j = len(xs), len(ys)
            while i and j:
                if rows[i][j] == rows[i - 1][j]:
                    i -= 1
                elif rows[i][j] == rows[i][j - 1]:
                    j -= 1
                else:
                    todo.append((xs[i - 1], ys[j - 1]))
                    i, j = i - 1, j - 1
    return total


def elements(root: Node) -> list[tuple[str, Node]]:
    """Every element with its path of signatures, in page order."""
    out, todo = [], [("", root)]
    while todo:
        path, node = todo.pop()
        out.append((path, node))
        for child in reversed(node.children):
            if isinstance(child, Node):
                todo.append((f"{path}/{child.signature}", child))
    return out


def content(root: Node, weight: dict[int, float] | None = None) -> tuple[str, Node]:
    """The smallest element that holds most of the text (or of the given weights by element)."""
    order = elements(root)
    mass: dict[int, float] = {}
    for _, node in reversed(order):
        if node.skipped or node.tag == "header":
            mass[id(node)] = 0.0
            continue
        own = weight.get(id(node), 0.0) if weight is not None else float(len(own_text(node)))
        mass[id(node)] = own + sum(mass[id(c)] for c in node.children if isinstance(c, Node))
    whole = mass[id(root)]
    named = [(p, n) for p, n in order if n.tag in ("article", "main") or n.attributes and (n.attribute("role") or "") == "main"]
    # The only article of a page is the content; among several one must hold most of the text.
    for kind in (True, False):
        marked = [(p, n) for p, n in named if not n.skipped and (n.tag == "article") == kind]
        for path, node in marked:
            if mass[id(node)] and (len(marked) == 1 or mass[id(node)] >= 0.5 * whole):
                return path, node
    path, node = "", root
    while True:
        inside = [c for c in node.children if isinstance(c, Node)]
        best = max(inside, key=lambda c: mass[id(c)], default=None)
        if best is None or best.tag not in SCOPES or mass[id(best)] < DOMINANT * mass[id(node)] or not mass[id(best)]:
            return path, node
        path, node = f"{path}/{best.signature}", best


def paragraphs(root: Node) -> set[str]:
    """Texts of the elements of a page's content, by the page's own tree."""
    out, todo = set(), [content(root)[1]]
    while todo:
        node = todo.pop()
        if not node.skipped:
            out.add(own_text(node))
            todo.extend(c for c in node.children if isinstance(c, Node))
    return out - {""}


def different(pages: list[str]) -> list[Node]:
    """Trees of the first SAMPLE pages that are no near copies of one before."""
    trees: list[Node] = []
    known: list[tuple[set[str], int]] = []
    for page in dict.fromkeys(pages):
        tree = parse(page)
        if len(elements(tree)) > NODES:
            continue
        texts = paragraphs(tree)
        mass = sum(map(len, texts))
        if all(sum(map(len, texts & t)) < COPY * min(mass, m) or not min(mass, m) for t, m in known):
            trees.append(tree)
            known.append((texts, mass))
            if len(trees) == SAMPLE:
                break
    return trees


def induce(pages: list[str]) -> dict:
    """The wrapper of a host from some of its pages."""
    trees = different(pages)
    if not trees:
        return {}
    base = trees[0]
    texts: dict[int, list[str]] = {id(n): [own_text(n)] for _, n in elements(base)}
    for other in trees[1:]:
        pairs: list = []
        match(base, other, pairs)
        for x, y in pairs:
            texts[id(x)].append(own_text(y))
    constant, weight = [], {}
    for path, node in elements(base):
        seen = texts[id(node)]
        common = max(set(seen), key=lambda t: (seen.count(t), t))
        fixed = len(trees) >= LEAST_PAGES and seen.count(common) >= CONSTANT * len(trees) and bool(common)
        if fixed:
            constant.append(_key(path, common))
        else:
            weight[id(node)] = sum(map(len, seen)) / len(trees)
    path, _ = content(base, weight)
    return {"path": path, "constant": sorted(set(constant))}


def extract(page: str, wrapper: dict) -> str:
    root = parse(page)
    path = wrapper.get("path")
    roots = _at(root, path) if path else []
    constant = frozenset(wrapper.get("constant", ()))
    if not roots:
        roots = [content(root)]
    found = text_of(roots, constant)
    if not constant:
        return found
    # A page of template texts for the most part is an article that the sample repeats.
    whole = text_of(roots)
    return found if len(found) >= (1 - MOST) * len(whole) else whole


def _at(root: Node, path: str) -> list[tuple[str, Node]]:
    """Elements at a path of signatures that are not skipped on the way, or only for a part of a name."""
    level = [root]
    for part in path.split("/")[1:]:
        level = [
            c for n in level for c in n.children
            if isinstance(c, Node) and c.signature == part and (not c.skipped or c.hinted)
        ]
        for node in level:
            node._skip = False
    return [(path, n) for n in level]


def host(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1))


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (as JSON) of every host; `pages` has url and html."""
    ship(pages.sparkSession)
    keyed = pages.select(
        host(pages["url"]).alias("host"), pages["html"].alias("html"), F.xxhash64(pages["url"], pages["html"]).alias("key")
    ).where(F.length("html").between(1, SAMPLE_CHARS))
    first = keyed.groupBy("host", F.pmod("key", F.lit(POOL)).alias("bucket")).agg(F.min("key").alias("key"))
    chosen = cut(first.select("host", "key"))

    def run(rows: pa.Table) -> pa.Table:
        found = rows.sort_by("key")
        pages = dict(zip(found.column("key").to_pylist(), found.column("html").to_pylist()))
        return pa.table({
            "host": pa.array([rows.column("host")[0].as_py()], pa.string()),
            "wrapper": pa.array([json.dumps(induce(list(pages.values())))], pa.string()),
        })

    # Repeated rows of a chosen page are one page of the sample.
    sample = keyed.join(chosen, ["host", "key"], "left_semi").dropDuplicates(["host", "key"])
    return sample.groupBy("host").applyInArrow(run, "host string, wrapper string")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    known = cut(wrappers(pages))
    rows = pages.select(
        pages["page_id"].cast("long").alias("page_id"), pages["url"].alias("url"), pages["html"].alias("html"),
        host(pages["url"]).alias("host"),
    ).join(known, "host", "left").select("page_id", "url", "html", "wrapper")

    def run(batch: pa.RecordBatch) -> dict:
        read: dict[str, dict] = {None: {}}
        texts = []
        for page, wrapper in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            if wrapper not in read:
                read[wrapper] = json.loads(wrapper)
            texts.append(extract(page, read[wrapper]) if page else "")
        return {
            "page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": list(map(len, texts)),
        }

    return per_batch(rows, run, "page_id long, url string, text string, n_chars long")
