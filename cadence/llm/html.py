"""Main text of web pages by site style trees.

The pages of a host are merged into one tree whose nodes are element paths (tag, class, id and
role of each element from the root). Each node has two entropies over the host's pages that
hold it: of its presentation (the sequences of child elements) and of its content (the texts
of the whole branch), both as shares of the greatest possible value. The importance of a node is
(1 - GAMMA^v) * presentation + GAMMA^v * content for v kinds of presentation. A branch that looks and
reads alike on all pages has importance near 0, and is removed from each page.

What the markup itself declares stands above the tree: elements that are menus, page headers,
footers, sidebars, notices, adverts, forms, scripts or comments by their tag, role, class or id have
importance 0 everywhere, so a host with one page needs no statistics. What an <article> (or else <main>)
declares as its content has a prior importance of DECLARED, to which the tree adds: its blocks go only if nearly
nothing of them differs between pages. A bare paragraph is prose and stays, whatever repeats; only what has a container of its own is judged. There an element is also judged by itself, with its content, where others stand at the
same path. Pages of one content count once, titles and parts of sentences, lists and tables are not
judged, and an article that would lose more than half of its words stays whole.

Cases: null or empty html gives an empty text; a url that is null or has no host belongs to the host
''; repeated pages are extracted each for itself; broken markup is read as browsers roughly do
(unclosed paragraphs and list items end at the next one, stray end tags are ignored, unended comments
run to the end); a table without rows gives no rows; further columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

GAMMA, LOW = 0.9, 0.3
#: Least importance of what the markup declares as content, and least words of an element that is judged by itself there.
DECLARED, LEAST_WORDS = 0.2, 5
#: A branch is judged if so many pages of its host hold it.
LEAST_PAGES = 5
#: Most (host, path) pairs, and pages that lose some, that are sent to every executor; beyond that, they are joined by host and path, and by page.
BROADCAST_PATHS = 50_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_PART = re.compile(r"[a-z0-9]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe noscript template svg math noembed noframes xmp object canvas audio video select".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_ENDS_P = _BLOCK - frozenset("body caption dd dt html li tbody td tfoot th thead tr legend".split())
#: A start tag ends the open elements of these kinds, up to the nearest one of those that hold them.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)), "tfoot": (("tbody", "thead", "tr", "td", "th"), ("table",)),
}
#: Elements of declared content that the tree judges.
_JUDGED = frozenset("address blockquote details div dl figure ol section table ul".split())
_NOISE_TAGS = frozenset("nav footer aside form button dialog menu head fieldset".split())
_NOISE_PARTS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs masthead banner footer sidebar aside ad ads advert adverts advertisement sponsor sponsored"
    " promo promotion cookie cookies consent notice gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social"
    " related recommended comment comments disqus reply replies respond widget pagination pager toolbar complementary contentinfo search".split()
)


#: Words that say nothing beside one of a role: share-bar and related-posts are roles, related-work and has-sidebar are not.
_BESIDE = frozenset(
    "bar bars list lists box boxes block blocks area section container wrapper wrap inner outer holder panel item items link links post posts article articles"
    " button buttons icons form left right top bottom primary secondary main site page global header content text slot unit row col column group media".split()
)
#: Elements whose class or id may name a role; headings, paragraphs and parts of sentences may not.
_NAMED = frozenset("div section ul ol dl li span table td article".split())


def names_role(name: str, attribute: str) -> bool:
    """Whether the whole of a class, id or role names what is no content; a class may also begin with ad-."""
    parts = [x for x in _PART.findall(name) if not x.isdigit()]
    known = [x in _NOISE_PARTS for x in parts]
    return any(known) and all(k or x in _BESIDE for k, x in zip(known, parts, strict=True)) or attribute == "class" and parts[:1] in (["ad"], ["ads"])


class Node:
    __slots__ = ("tag", "names", "role", "hidden", "parent", "children", "path")

    def __init__(self, tag: str, attributes: str, parent: Node | None) -> None:
        self.tag, self.parent, self.children, names, self.hidden, self.role = tag, parent, [], [], False, False
        if attributes:
            for name, value in _ATTRIBUTE.findall(attributes):
                name, value = name.lower(), value.strip("\"'").lower()
                if name in ("class", "id", "role"):
                    names += _PART.findall(value)
                    self.role = self.role or any(names_role(x, name if tag != "article" else "") for x in value.split())
                elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                    self.hidden = True
        self.names = tuple(names)
        own = tag + "." + ".".join(x for x in names if not x.isdigit()) if names else tag
        self.path = f"{parent.path}/{own}" if parent else own


def parse(page: str) -> Node:
    root = Node("html", "", None)
    stack, at = [root], 0
    for m in iter_tokens(page):
        text = page[at : m[0]]
        if text and not text.isspace():
            stack[-1].children.append(text)
        elif text:
            stack[-1].children.append(" ")
        at, end, start, attributes = m[1], m[2], m[3], m[4]
        if end:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == end:
                    del stack[k:]
                    break
        elif start:
            if start == "html":
                continue
            if start in _ENDS_P:
                _close(stack, ("p",), ("article", "section", "div", "td", "li", "body", "table", "button"))
            elif start in _ENDS:
                _close(stack, *_ENDS[start])
            node = Node(start, attributes, stack[-1])
            stack[-1].children.append(node)
            if start not in _VOID and start not in _RAW:
                stack.append(node)
    if page[at:]:
        stack[-1].children.append(page[at:])
    return root


def iter_tokens(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(begin, end, end tag, start tag, attributes); an element of raw text ends where its end tag ends."""
    at = 0
    while m := _TOKEN.search(page, at):
        at = m.end()
        end, a, x, b, y = m.groups()
        start = (a or b or "").lower()
        if start in _RAW and not (x or y or "").endswith("/"):
            closing = re.compile(rf"</{start}\b[^>]*>", re.I).search(page, at)
            at = closing.end() if closing else len(page)
        yield m.start(), at, (end or "").lower(), start, x or y or ""


def _close(stack: list[Node], kinds: tuple[str, ...], scope: tuple[str, ...]) -> None:
    last = None
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in kinds:
            last = k
            if len(kinds) == 1:
                break
        elif stack[k].tag in scope:
            break
    if last is not None:
        del stack[last:]


def is_noise(node: Node, named: bool = True) -> bool:
    """By what the element says of itself; by its class, id or role only if named."""
    if node.tag in _NOISE_TAGS or node.hidden:
        return True
    return named and node.tag in _NAMED and node.role and (node.tag != "article" or not _COMMENT.isdisjoint(node.names))


_COMMENT = frozenset("comment comments reply related sponsored ad advert promo".split())


def roots(top: Node) -> list[Node]:
    """The outermost <article> elements, or else what is declared as main, that lie in no noise; none if neither is there.
    Names of roles don't count for what holds the only ones."""
    for named in (True, False):
        for declared in (lambda n: n.tag == "article", lambda n: n.tag == "main" or "main" in n.names and n.tag in ("div", "section")):
            found, todo = [], [top]
            while todo:
                n = todo.pop()
                if is_noise(n, named or n.tag == "article") or n.tag == "header":
                    continue
                if declared(n):
                    found.append(n)
                else:
                    todo += [c for c in reversed(n.children) if not isinstance(c, str)]
            if found:
                return found
    return []


def text_of(nodes: list[Node], gone: set[int] | frozenset = frozenset(), trusted: bool = True) -> str:
    """The texts of all blocks below the nodes in page order, without noise and the nodes in gone (their id())."""
    blocks, run = [], []

    def end() -> None:
        if run:
            if text := " ".join(unescape("".join(run)).split()):
                blocks.append(text)
            run.clear()

    todo: list = list(reversed(nodes))
    while todo:
        n = todo.pop()
        if n is None:
            end()
        elif isinstance(n, str):
            run.append(n)
        elif n.tag == "br":
            run.append(" ")
        elif n.tag in _RAW or is_noise(n, n not in nodes) or n.tag == "header" and not trusted or id(n) in gone:
            if n.tag in _BLOCK:
                end()
        elif n.tag in _BLOCK:
            end()
            todo.append(None)
            todo += reversed(n.children)
        else:
            todo += reversed(n.children)
    end()
    return "\n".join(blocks)


def path_id(path: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(path.encode("utf-8", "replace")) - (1 << 63)


def extract(page: str, removed: set[int] | frozenset = frozenset()) -> str:
    top = parse(page)
    found = roots(top)
    gone = {id(n) for n, marks in marked(top, found)[1] if not removed.isdisjoint(marks)} if removed else frozenset()
    if not found:
        return text_of([top], gone, False)
    whole = text_of(found)
    rest = text_of(found, gone) if gone else whole
    return rest if 2 * len(rest.split()) >= len(whole.split()) else whole


def marked(top: Node, found: list[Node]) -> tuple[int, list[tuple[Node, tuple[int, ...]]], dict[int, tuple[int, int]]]:
    """A hash of all content that is read, the judged nodes with their marks, and for each mark hashes of the presentation
    and of the content of all elements that have it. A mark stands for a path, or for a path and one content."""
    order, todo = [], list(found or [top])
    while todo:
        n = todo.pop()
        order.append(n)
        todo += [c for c in reversed(n.children) if not isinstance(c, str)]
    content: dict[int, int] = {}
    words: dict[int, int] = {}
    at: dict[str, list[tuple[Node, str]]] = {}
    roots_of = {id(n) for n in found}
    for n in reversed(order):
        parts = [f"<{content[id(c)]}>" if not isinstance(c, str) else " ".join(c.split()) for c in n.children]
        own = "\x00".join(x for x in parts if x)
        content[id(n)] = path_id(f"{n.tag}\x00{own}")
        words[id(n)] = sum(words[id(c)] if not isinstance(c, str) else len(c.split()) for c in n.children)
        if not found or n.tag in _JUDGED and id(n) not in roots_of:
            at.setdefault(n.path, []).append((n, own))
    nodes, seen = [], {}
    for path, those in at.items():
        mark = path_id(f"={path}" if found else path)
        seen[mark] = (path_id("\x01".join(" ".join(c.tag for c in n.children if not isinstance(c, str)) for n, _ in those)), path_id("\x01".join(own for _, own in those)))
        for n, own in those:
            marks = (mark,)
            if found and len(those) > 1 and words[id(n)] >= LEAST_WORDS:
                marks = (mark, path_id(f"={path}\x00{own}"))
                seen[marks[1]] = (0, 0)
            nodes.append((n, marks))
    return path_id("\x01".join(str(content[id(n)]) for n in found or [top])), nodes, seen


_HOST = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def _pages(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    yield from W.slices(batch, "html", 8 << 20)


def style_tree(pages: DataFrame) -> DataFrame:
    """pages(url, html) -> host, path, pages, looks, importance: one row per node of each host's merged tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _pages(batch):
                out = []
                for url, page in zip(b.column("url").to_pylist(), b.column("html").to_pylist(), strict=True):
                    host, top = path_id(host_of(url)), parse(page or "")
                    found = roots(top)
                    body, _, seen = marked(top, found)
                    for p, (look, read) in seen.items():
                        out += [(host, body, p, bool(found), 0, look), (host, body, p, bool(found), 1, read)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 6, (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64()), strict=True)], names=["host", "body", "path", "declared", "kind", "variant"])

    nodes = pages.select("url", "html").mapInArrow(run, "host long, body long, path long, declared boolean, kind int, variant long").distinct()  # repeated pages count once
    variants = nodes.groupBy("host", "path", "declared", "kind", "variant").agg(F.count("*").alias("n"))
    n = F.col("n").cast("double")
    both = variants.groupBy("host", "path", "declared").agg(*(
        x for kind, name in ((0, "look"), (1, "read"))
        for x in (F.sum(F.when(F.col("kind") == kind, F.col("n"))).alias(f"{name}_pages"), F.sum(F.when(F.col("kind") == kind, n * F.log(n))).alias(f"{name}_sum"), F.count_if(F.col("kind") == kind).alias(f"{name}s"))
    ))

    def entropy(name: str):
        """-sum p log_m p over m pages, from the sum of n log n."""
        m = F.col(f"{name}_pages").cast("double")
        return F.when(m > 1, F.greatest(F.lit(0.0), (F.log(m) - F.col(f"{name}_sum") / m) / F.log(m))).otherwise(1.0)

    fade = F.pow(F.lit(GAMMA), F.col("looks"))
    prior = F.when(F.col("declared"), DECLARED).otherwise(0.0)
    return both.select("host", "path", F.col("look_pages").alias("pages"), "looks", (prior + (1 - prior) * ((1 - fade) * entropy("look") + fade * entropy("read"))).alias("importance"))


def unimportant(tree: DataFrame) -> DataFrame:
    """host, path: what is to be removed, however small a share of the host's pages holds it."""
    return tree.filter((F.col("importance") < LOW) & (F.col("pages") >= LEAST_PAGES)).select("host", "path")


def main_text(pages: DataFrame, low: DataFrame) -> DataFrame:
    """pages(page_id, url, html) and what unimportant() gives -> page_id, url, text, n_chars.

    Each page is joined with those of its own paths that are to be removed, so no list is longer than a page.
    The paths of a hot host are joined by host and path, and its pages by their text: no key is the host alone.
    """

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _pages(batch):
                out = []
                for url, page, text in zip(*(b.column(c).to_pylist() for c in ("url", "html", "page_hash")), strict=True):
                    top, host = parse(page or ""), path_id(host_of(url))
                    out += [(host, text, p) for p in marked(top, roots(top))[2]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [()] * 3)], names=["page_host", "of_hash", "page_path"])

    def hosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [path_id(host_of(u)) for u in b.column("url").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.int64())], names=[*b.schema.names, "page_host"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _pages(batch):
                gone = [frozenset(x or ()) for x in b.column("removed").to_pylist()]
                text = [extract(p or "", g) for p, g in zip(b.column("html").to_pylist(), gone, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    keyed = pages.select("page_id", "url", "html", F.xxhash64("html").alias("page_hash"))
    low = low.checkpoint()
    n = low.count()
    known = keyed.limit(0).select(F.lit(0).cast("long").alias("host"), F.col("page_hash").alias("hash"), F.array(F.lit(0).cast("long")).alias("removed"))
    if n:
        each = keyed.select("url", "html", "page_hash").mapInArrow(paths, "page_host long, of_hash long, page_path long")
        hit = each.join(F.broadcast(low) if n <= BROADCAST_PATHS else low, (F.col("page_host") == F.col("host")) & (F.col("page_path") == F.col("path")))
        known = hit.groupBy("host", F.col("of_hash").alias("hash")).agg(F.collect_set("path").alias("removed")).checkpoint()
        n = known.agg(F.sum(F.size("removed"))).first()[0] or 0
    known = F.broadcast(known) if n <= BROADCAST_PATHS else known
    hosted = keyed.mapInArrow(hosts, f"page_id {kind}, url string, html string, page_hash long, page_host long")
    joined = hosted.join(known, (F.col("page_host") == F.col("host")) & (F.col("page_hash") == F.col("hash")), "left").select("page_id", "url", "html", "removed")
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def extract_pages(pages: DataFrame) -> DataFrame:
    return main_text(pages, unimportant(style_tree(pages)))
