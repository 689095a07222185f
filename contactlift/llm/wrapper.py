"""HTML extraction by wrapper induction.

For every host up to three reference pages are drawn by hash. Each page's DOM tree is aligned with the references' trees by
simple tree matching (labels are tag, class and id; runs of equal siblings are one list node). Nodes that match a
reference node of equal content are template; the others are slots. The content slot is the article-like element, or
else the element, that holds the most text in slots; its text is the page's main text, whole, as lines of the article
may well occur in other pages too. Elements whose tag, class, id or role names a menu, header, footer, sidebar, notice,
advert, form, script, style or reader comment are never content; nor are template blocks (not headings or paragraphs)
inside the slot. In an article-like element only boxes such as div are dropped as template: its lists, tables and quotations
are its own, also if near copies on the same host repeat them. Scanning is linear: a tag ends at a "<" outside quotes, so unclosed tags are text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactlift.llm.store import written

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
                    r"|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|([^<]++|<)", re.S | re.I)
# What follows the last ">": text, up to an unclosed comment.
_REST = re.compile(r"(?:(?!<!--)[\s\S])++")
_ATTR = re.compile(r"([A-Za-z][\w:-]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
# HTML element classes.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo big br cite code data dfn em font i img kbd label mark q s samp small span strike "
                    "strong sub sup time tt u var wbr".split())
_NEVER = frozenset("nav footer aside form button select option input head menu dialog object".split())
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p "
                      "pre section table ul".split())
_BOILER = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advert[a-z]+|sponsor(?:ed|s)?|promo|promotion|cookies?|consent|gdpr|notices?|"
                     r"newsletter|subscribe|popup|modal|nav|navbar|navigation|menu|breadcrumbs?|sidebar|comments?|commentlist|"
                     r"disqus|respond|footer|masthead|share|social|related|pagination|skip-link)(?:$|[\s_-])", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
REFERENCES = 3
# Nodes that nest deeper are not aligned, so they are content unless their names tell otherwise.
MOST_DEPTH = 400
_KEPT_TEMPLATE = frozenset("h1 h2 h3 h4 h5 h6 p".split())
_ARTICLE_OWN = frozenset("ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption".split())


class Node:
    __slots__ = ("tag", "label", "kids", "never", "size", "key", "template", "main")

    def __init__(self, tag: str, label: str, never: bool, main: bool):
        self.tag, self.label, self.never, self.main = tag, label, never, main
        self.kids: list = []  # nodes and strings
        self.size, self.key, self.template = 0, None, False


def _opened(tag: str, attrs: str) -> Node:
    if not attrs or attrs.isspace():
        return Node(tag, tag, tag in _NEVER, tag in ("article", "main"))
    got = {k.lower(): (v or "").strip("\"'") for k, v in _ATTR.findall(attrs)}
    named = f"{got.get('class', '')} {got.get('id', '')}"
    never = (tag in _NEVER or (tag not in ("html", "body") and bool(_BOILER.search(named))) or got.get("role") in _ROLES
             or "hidden" in got or got.get("aria-hidden") == "true")
    main = tag in ("article", "main") or got.get("role") in ("main", "article") or got.get("itemprop") == "articleBody"
    return Node(tag, f"{tag} {named.strip()}" if named.strip() else tag, never, main)


def _tokens(html: str) -> Iterator[re.Match]:
    """Matches of ``_TOKEN`` up to the last ">", then the text behind it, if no comment or element without tags is open there."""
    last, m = html.rfind(">") + 1, None
    for m in _TOKEN.finditer(html, 0, last):
        yield m
    if m and ((m[1] and not re.search(rf"</{m[1]}\s*>\Z", m[0], re.I)) or (m[0].startswith("<!--") and not m[0].endswith("-->"))):
        return
    rest = _REST.match(html, last)
    if rest:
        yield rest


def parse(html: str) -> Node:
    """A tree of elements and texts; unclosed and stray tags are mended the way browsers do for simple cases."""
    root = Node("html", "html", False, False)
    stack = [root]
    for m in _tokens(html):
        text = m[0] if m.re is _REST else m[5]
        if text is not None:
            stack[-1].kids.append(text)
            continue
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if m[2]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in ("html", "body"):
            continue
        if tag in _CLOSES_P or tag == "li":
            shut = "li" if tag == "li" else "p"
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == shut:
                    del stack[i:]
                    break
                if stack[i].tag not in _INLINE:
                    break
        node = _opened(tag, m[4].rstrip("/"))
        stack[-1].kids.append(node)
        if tag not in _VOID and not m[4].endswith("/"):
            stack.append(node)
    _measure(root)
    return root


def _measure(root: Node) -> None:
    """Text sizes and content keys, bottom up (no recursion: pages may nest deeply)."""
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo += [k for k in n.kids if isinstance(k, Node)]
    for n in reversed(order):
        n.size = sum(len(k) if isinstance(k, str) else k.size for k in n.kids)
        n.key = hash((n.label, *(" ".join(k.split()) if isinstance(k, str) else k.key for k in n.kids)))


def _groups(n: Node) -> list[list[Node]]:
    """Element children, runs of one label together."""
    out: list[list[Node]] = []
    for k in n.kids:
        if isinstance(k, Node) and k.tag not in _INLINE:
            if out and out[-1][0].label == k.label:
                out[-1].append(k)
            else:
                out.append([k])
    return out


def simple_tree_matching(a: Node, b: Node, depth: int = 0) -> tuple[int, list[tuple[Node, Node]]]:
    """Size of the largest order-preserving match of two trees with equal root labels, and its node pairs."""
    if a.label != b.label:
        return 0, []
    x, y = _groups(a), _groups(b)
    if a.key == b.key or not x or not y or depth > MOST_DEPTH:
        return 1, [(a, b)]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    pairs: dict[tuple[int, int], tuple[int, list]] = {}
    for i, g in enumerate(x):
        for j, h in enumerate(y):
            w = 0
            if g[0].label == h[0].label:
                pairs[i, j] = (simple_tree_matching(g[0], h[0], depth + 1) if len(g) == len(h) == 1
                               else (1, []))  # a list varies as a whole
                w = pairs[i, j][0]
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + w)
    i, j, found = len(x), len(y), [(a, b)]
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            found += pairs[i, j][1]
    return best[len(x)][len(y)] + 1, found


@lru_cache(maxsize=256)
def _reference(html: str) -> Node:
    return parse(html)


def _slot_size(n: Node) -> int:
    """Text of ``n`` that is in slots."""
    total, todo = 0, [n]
    while todo:
        k = todo.pop()
        if isinstance(k, str):
            total += len(k)
        elif not (k.template or k.never):
            todo += k.kids
    return total


def _content(root: Node) -> Node:
    mains, todo = [], [root]
    while todo:
        n = todo.pop()
        if n.never:
            continue
        if n.main:
            mains.append(n)
        todo += [k for k in n.kids if isinstance(k, Node)]
    if mains:
        articles = [n for n in mains if n.tag == "article"] or mains
        return max(articles, key=lambda n: (_slot_size(n), n.size))
    n = root  # walk down to the element that alone holds most of the slots' text
    while True:
        kids = [k for k in n.kids if isinstance(k, Node) and not k.never and k.tag not in _INLINE]
        whole = _slot_size(n)
        top = max(kids, key=_slot_size, default=None)
        if top is None or top.tag in _KEPT_TEMPLATE or _slot_size(top) < 0.8 * whole:
            return n
        n = top


def _blocks_of(n: Node) -> list[str]:
    """Texts of the blocks below ``n``, in page order."""
    out, part = [], []

    def end():
        t = " ".join(unescape("".join(part)).split())
        if t:
            out.append(t)
        part.clear()

    todo: list = [n]
    while todo:
        k = todo.pop()
        if k is None:
            end()
        elif isinstance(k, str):
            part.append(k)
        elif k.tag == "br":
            part.append(" ")
        elif k is not n and (k.never or (k.tag == "header" and not k.main)):
            if k.tag == "header":  # the article's own title stays
                todo += [x for x in reversed(k.kids) if isinstance(x, Node) and x.tag in ("h1", "h2")]
            elif k.tag not in _INLINE:
                end()
        elif (k is not n and k.template and k.tag not in _KEPT_TEMPLATE and k.tag not in _INLINE
              and not (n.main and k.tag in _ARTICLE_OWN)):
            end()
        elif k.tag in _INLINE:
            todo += reversed(k.kids)
        else:
            end()
            todo.append(None)
            todo += reversed(k.kids)
    end()
    return out


def main_text(html: str | None, references: list[str | None]) -> str:
    """The main text of one page, given reference pages of its host."""
    if not html:
        return ""
    page = parse(html)
    for ref in references:
        if ref and ref != html:
            other = _reference(ref)
            for a, b in simple_tree_matching(page, other)[1]:
                if a.key == b.key and not a.main:
                    a.template = True
    return "\n".join(_blocks_of(_content(page)))


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per row of ``pages``: (id_col, url, text, n_chars).

    A null or empty html gives an empty text. Pages without a host are one group. Equal rows get equal results: the
    references depend on the host's pages alone, with ties between equal hashes being ties between equal pages. Null ids
    are allowed; extra columns are ignored; an empty table gives an empty result.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[^?#]*?://([^/?#]*)", 1))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url).alias("url"), F.col(html).alias("html"), host.alias("host"))
    names = [f"r{j}" for j in range(REFERENCES)]
    draw = {c: F.xxhash64(F.lit(j), "id", "url") for j, c in enumerate(names)}
    drawn = written(rows.where("html IS NOT NULL").groupBy(F.col("host").alias("of"))
                    .agg(*[F.min(x).alias(f"{c}_least") for c, x in draw.items()]), "drawn")
    hit = {c: x == F.col(f"{c}_least") for c, x in draw.items()}
    some = F.lit(False)
    for x in hit.values():
        some = some | x
    refs = (rows.join(drawn, (F.col("host") == F.col("of")) & some).groupBy("host")
            .agg(*[F.max(F.when(x, F.col("html"))).alias(c) for c, x in hit.items()]))
    refs = written(refs.withColumnRenamed("host", "of"), "references")

    def task(batches):
        for b in batches:
            text = [main_text(h, refs) for h, *refs in zip(*(b.column(c).to_pylist() for c in ("html", *names)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(text, pa.string()),
                                              pa.array([len(t) for t in text], pa.int64())], [id_col, "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    return rows.join(refs, F.col("host") == F.col("of"), "left").select("id", "url", "html", *names).mapInArrow(
        task, f"`{id_col}` {kind}, url string, text string, n_chars long")
