"""Main text of web pages, with the removal of a site's templates.

Pages are parsed into element trees.  Each block's subtree is hashed by what it holds; Spark counts, for each
host, on how many pages with different articles a hash occurs, and subtrees found on many are deleted as part
of the site's template, before anything else is looked at.  From what is left, elements that are boilerplate by
name or by their class, id or role are deleted anywhere.  If a page has an article (or main) element, its text
is the page's text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, materialise, slices

#: Pages with different articles on which a subtree must occur to be a template of the host: one beside the
#: article, and one in it (or anywhere on a page that has neither article nor main element).
TEMPLATE_PAGES, ARTICLE_PAGES = 3, 8

VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that never hold main text.
DROPPED = RAW - {"plaintext", "xmp"} | frozenset("head nav header footer aside form menu dialog select option button input label fieldset template svg math object applet audio video canvas map search template".split())
_JUNK = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertis(?:ement|ements|ing)|adsense|adslot|sponsor(?:ed|s)?|promo(?:tion|tions)?|banner|nav|navbar|navigation|menu|breadcrumbs?|sidebar|footer|header|masthead|comments?|commentlist|disqus|replies|respond|cookies?|consent|gdpr|notices?|notification|alert|newsletter|subscribe|subscription|signup|login|popup|modal|overlay|social|share|sharing|related|recommended|widget|pagination|pager|toolbar|skip-link|paywall)(?:$|[\s_-])",
    re.I,
)
_JUNK_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Deleted inside an article only as whole containers; its paragraphs are text, however often they recur.
CONTAINER = frozenset("div section ul ol dl table figure details center".split()) | DROPPED & BLOCK
#: Never templates themselves.
_KEPT = frozenset("html head body article main".split())
_CLOSES = {
    "li": ("li", frozenset("ul ol menu dir".split())), "dt": (("dt", "dd"), frozenset(["dl"])), "dd": (("dt", "dd"), frozenset(["dl"])), "tr": (("tr", "td", "th"), frozenset(["table"])), "td": (("td", "th"), frozenset(["table", "tr"])), "th": (("td", "th"), frozenset(["table", "tr"])), "option": (("option",), frozenset(["select"])),
}
_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]*)))?")


class Node:
    __slots__ = ("tag", "attributes", "children", "dropped")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children, self.dropped = tag, attributes, [], False


def _junk(tag: str, attributes: str) -> bool:
    if tag in DROPPED:
        return True
    if not attributes or tag in ("html", "body", "article", "main") and "comment" not in attributes:
        return False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id") and _JUNK.search(value) or name == "role" and value.lower() in _JUNK_ROLE:
            return True
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
    return False


def parse(source: str) -> Node:
    """A tree of a page, however badly nested; text children are strings with references decoded."""
    root = Node("#root")
    stack, at, size = [root], 0, len(source)

    def text(part: str) -> None:
        if part:
            stack[-1].children.append(html.unescape(part) if "&" in part else part)

    while at < size:
        m = _TOKEN.search(source, at)
        if not m:
            text(source[at:])
            break
        text(source[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "p" and all(n.tag != "p" for n in stack):
                stack[-1].children.append(Node("p"))
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in ("td", "th", "table", "article", "main") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "article", "main", "body", "html", "section", "div"):
                    break
            continue
        if tag in BLOCK:  # an open paragraph ends, with the inline elements left open in it
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in BLOCK:
                    break
        if tag in _CLOSES:
            closes, within = _CLOSES[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in within:
                    break
                if stack[i].tag == closes or stack[i].tag in closes and isinstance(closes, tuple):
                    del stack[i:]
                    break
        node = Node(tag, m[3])
        stack[-1].children.append(node)
        if tag in RAW and tag not in ("plaintext", "noscript"):
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
            node.children.append(source[at : end.start() if end else size])
            at = end.end() if end else size
        elif tag not in VOID and not m[3].endswith("/") or tag in BLOCK - VOID:
            stack.append(node)
    return root


def _walk(root: Node) -> Iterator[Node]:
    """All elements below, children before their parents."""
    todo = [(root, False)]
    while todo:
        node, seen = todo.pop()
        if seen:
            yield node
        else:
            todo.append((node, True))
            todo += [(c, False) for c in node.children if isinstance(c, Node)]


def _hash(parts: Iterable[bytes]) -> int:
    h = blake2b(digest_size=8)
    for p in parts:
        h.update(p)
    return int.from_bytes(h.digest(), "big") >> 2


def _utf8(text: str) -> bytes:
    return " ".join(text.split()).encode("utf-8", "surrogatepass")


def subtree_hashes(root: Node) -> dict[int, int]:
    """The hash of each element's tag and content, by the element's id(); 0 where it holds no text."""
    out: dict[int, int] = {}
    for node in _walk(root):
        parts, filled = [node.tag.encode()], False
        for c in node.children:
            if isinstance(c, Node):
                found = out[id(c)]
                filled |= found != 0
                parts.append(b"\1" + (_utf8(c.tag) if not found else found.to_bytes(8, "big")))
            else:
                text = _utf8(c)
                filled |= bool(text)
                parts.append(b"\2" + text)
        out[id(node)] = _hash(parts) | 1 if filled else 0
    return out


def _main(root: Node) -> list[Node]:
    """The outermost article elements that aren't boilerplate (else main elements, else the whole page)."""
    for tag in ("article", "main"):
        found, todo = [], [root]
        while todo:
            node = todo.pop()
            if node is not root and (node.tag in DROPPED or _junk(node.tag, node.attributes)):
                continue
            if node.tag == tag:
                found.append(node)
            else:
                todo += [c for c in reversed(node.children) if isinstance(c, Node)]
        if any(blocks(n) for n in found):
            return found
    return [root]


def _visit(root: Node, hashes: dict[int, int], templates: set[int] | frozenset[int]) -> tuple[list[int], int]:
    """(keys of the subtrees that may be templates, deleted subtrees): those whose key is in ``templates`` are
    cut out of the tree, with what is below them.  A key is a hash and, as its last bit, whether the subtree is in
    the article."""
    parts = {id(p) for p in _main(root)}
    keys, deleted, todo = [], 0, [(root, id(root) in parts)]
    while todo:
        node, inside = todo.pop()
        gone = set()
        for c in node.children:
            if not isinstance(c, Node):
                continue
            if c.tag not in _KEPT and hashes[id(c)] and (c.tag in CONTAINER or not inside and c.tag in BLOCK):
                key = hashes[id(c)] << 1 | inside
                keys.append(key)
                if key in templates:
                    gone.add(id(c))
                    continue
            todo.append((c, inside or id(c) in parts))
        if gone:
            node.children = [c for c in node.children if id(c) not in gone]
            deleted += len(gone)
    return keys, deleted


def candidates(root: Node, hashes: dict[int, int]) -> tuple[int, set[int]]:
    """(hash of the page's article, keys of the subtrees that may be templates)."""
    parts = _main(root)
    article = hashes[id(root)] if parts[0] is root else _hash(_utf8(b) for p in parts for b in blocks(p))
    return article, set(_visit(root, hashes, frozenset())[0])


def blocks(root: Node) -> list[str]:
    """The text blocks below an element, in order, without boilerplate."""
    out: list[str] = []
    now: list[str] = []

    def close() -> None:
        joined = " ".join("".join(now).split())
        now.clear()
        if joined:
            out.append(joined)

    todo: list = [root]
    while todo:
        x = todo.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            now.append(x)
        elif x is not root and _junk(x.tag, x.attributes):
            if x.tag in BLOCK:
                close()
        else:
            if x.tag == "br":
                now.append(" ")
            block = x.tag in BLOCK or x is root
            if block:
                close()
                todo.append(None)
            todo += reversed(x.children)
    close()
    return out


def cleaned(source: str, templates: set[int] | frozenset[int] = frozenset()) -> tuple[str, int]:
    """(main text of a page, template subtrees deleted from it)."""
    root = parse(source)
    deleted = _visit(root, subtree_hashes(root), templates)[1] if templates else 0
    return "\n\n".join(b for part in _main(root) for b in blocks(part)), deleted


def main_text(source: str, templates: set[int] | frozenset[int] = frozenset()) -> str:
    return cleaned(source, templates)[0]


def extract(pages: DataFrame, template_pages: int = TEMPLATE_PAGES, article_pages: int = ARTICLE_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars, template_subtrees) for every row of ``pages`` (page_id, url, html).

    Only hashes travel: (page, host, subtree) rows are counted by host with partial sums, and those that
    are templates come back to their page.  A host with fewer pages than ``template_pages`` has no templates,
    and what recurs on copies of one article is none.  Null html is an empty page; a null url is a host of its
    own; a null page_id has its text without template removal; repeated rows are repeated.  A page of any length
    is parsed whole, one at a time.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b):
                rows: list[tuple] = []
                for page, host, source in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True):
                    root = parse(source.as_py() or "")
                    article, found = candidates(root, subtree_hashes(root))
                    rows += [(page, host, article, k) for k in found]
                cols = list(zip(*rows, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["page_id", "host", "article", "subtree"])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b):
                found = [cleaned(s.as_py() or "", set(t or ())) for s, t in zip(part.column(2), part.column(3).to_pylist(), strict=True)]
                texts, deleted = [t for t, _ in found], [n for _, n in found]
                columns = [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(deleted, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars", "template_subtrees"])

    host = F.xxhash64(F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1), F.lit(""))))
    found = pages.where("page_id is not null").select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), "html")
    found = materialise(map_arrow(found, find, "page_id long, host long, article long, subtree long"), "subtrees")  # no page is parsed for each use
    articles = found.select("host", "subtree", "article").distinct()
    many = F.when(F.col("subtree") % 2 == 1, article_pages).otherwise(template_pages)
    templates = articles.groupBy("host", "subtree").agg(F.count("*").alias("n")).where(F.col("n") >= many).select("host", "subtree")
    templates = materialise(templates, "templates")
    of_page = found.join(templates, ["host", "subtree"], "left_semi").groupBy("page_id").agg(F.collect_set("subtree").alias("templates"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").join(of_page, "page_id", "left")
    return map_arrow(rows.select("page_id", "url", "html", "templates"), clean, "page_id long, url string, text string, n_chars long, template_subtrees int")
