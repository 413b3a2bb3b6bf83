"""Main text of HTML pages by composite text density.

The page becomes a tree (a tolerant reader: raw text elements, implied end tags, unclosed and stray tags; the head ends
where content begins, and what follows the body belongs to it). Subtrees that are never main text are left out by their
element, role or class words: menus, headers and footers of the page, sidebars, notices, adverts, forms, scripts, styles,
reader comments. Forms and what class words leave out are taken back where they hold most of the text outside links, of
the article or main part they are in or else of the page; adverts only where they hold all of it. Every node then has C characters, T tags, and LC
and LT, those inside links; its composite density is

    C / T * log base ln(C / nLC * LC + LCb / Cb * C + e) of (C / max(LC, 1) * T / max(LT, 1))

with nLC the characters outside links and b the body. A node's density sum is that of its children. The node with the
largest sum is the kernel; the smallest density on its path below the body is the threshold, and the kernel rises, to an
article or main part around it at least, while text beside it reaches the threshold.

Cases: null html counts as empty; a page without text gives an empty string; pages are read whole, however long or
deep (no recursion); repeated rows give alike results; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

import html as _html
import math
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.shared import slices

# Fixed values of HTML: elements without content, with raw text, and those that begin a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th", "thead", "tbody"), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "thead", "tbody")}
P_SCOPE = ("article", "main", "td", "th", "li", "div", "section", "body", "table", "blockquote", "button")
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",)}
# Elements, roles and class words of what is never main text.
LEFT_OUT = frozenset("head script style noscript template nav aside button select option input textarea iframe object embed svg canvas dialog menu audio video title link meta".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
HEAD = frozenset("html head title meta link base basefont bgsound style script noscript noframes template".split())
LEFT_OUT_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar nav navbar navigation menu breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup share sharing social related recommended comment comments respond disqus reply replies widget toolbar pagination pager".split())

# Of these, what names adverts and consent: taken back only where nothing else is text.
ADVERT_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored cookie cookies consent gdpr".split())
TEXT_TAGS = frozenset("article p h1 h2 h3".split())
# Of these, what may be text inside an article or a main part: blocks of page builders and hints to the reader.
TEXT_INSIDE = frozenset("widget alert notice notices".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>|</[^a-zA-Z>][^>]*>|</>", re.S)
#: A tag with a quote that never closes ends at the first >; after `ODD_TAGS` such tags, every tag of the page does.
PLAIN_TAG, ODD_TAGS = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"), 8
ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("chars", "children", "density", "link_chars", "link_tags", "out", "parent", "tag", "tags", "total", "words")

    def __init__(self, tag, parent, out=0, words=frozenset()):
        self.tag, self.parent, self.children, self.out, self.words = tag, parent, [], out, words
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def left_out(tag: str, attributes: str, inside_article: bool) -> tuple[int, frozenset]:
    """0: may be main text; 1: is not; 2: is not by its class or id words (these come too), 3: is a form; the latter two
    unless the main text proves to be inside."""
    none = frozenset()
    if tag in LEFT_OUT or tag == "footer" or (tag == "header" and not inside_article):
        return 1, none
    out, words = 3 if tag == "form" else 0, set()
    if not attributes or tag in ("html", "body", "main"):
        return out, none
    for m in ATTR.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return 1, none
        if name == "role" and value.lower() in LEFT_OUT_ROLES:
            return 1, none
        if name == "role" and value.lower() == "form":
            out = 3
        if name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return 1, none
        if name in ("class", "id"):
            words |= {w.lower() for w in WORD.findall(value)} & LEFT_OUT_WORDS
    if inside_article:
        words -= TEXT_INSIDE
    return out or (2 if words else 0), frozenset(words)


def restore(root: Node) -> None:
    """Takes back what was left out by words alone but holds an article, a main part or a first heading."""
    for tags, never in ((("article", "main"), (1,)), (("h1",), (1, 3))):
        free = set()
        stack = [(root, False)]
        while stack:
            node, shut = stack.pop()
            if node.tag in tags and not node.out and not shut:
                up = node.parent
                while up is not None and id(up) not in free:
                    free.add(id(up))
                    up.out, up = 0, up.parent
            shut = shut or node.out in never
            stack.extend((c, shut) for c in node.children if isinstance(c, Node))


def take_back(root: Node) -> None:
    """Takes back forms, and subtrees left out by the same words, that hold most of the text outside links of the article
    or main part they are in, or else of the page. Words stand if another article or main part there has text."""
    every, stack = [], [(root, False)]
    weight: dict[int, int] = {}
    while stack:
        node, linked = stack.pop()
        every.append(node)
        linked = linked or node.tag == "a"
        weight[id(node)] = 0 if linked else sum(len(SPACE.sub("", c)) for c in node.children if isinstance(c, str))
        stack.extend((c, linked) for c in node.children if isinstance(c, Node) and c.out != 1)
    for node in reversed(every):
        if node.parent is not None:
            weight[id(node.parent)] += weight[id(node)]
    changed = True
    while changed:
        changed = False
        groups: dict[tuple, list[Node]] = {}
        parts: dict[int, int] = {}  # text of the articles and main parts directly within each
        walk = [(root, root)]
        while walk:
            node, within = walk.pop()
            if node.out:
                groups.setdefault((id(within), node.out, node.words), [within]).append(node)
                continue
            if node.tag in ("article", "main") and weight[id(node)]:
                parts[id(within)] = parts.get(id(within), 0) + weight[id(node)]
                within = node
            walk.extend((c, within) for c in node.children if isinstance(c, Node) and c.out != 1)
        for (_, out, words), (within, *nodes) in groups.items():
            if out == 2 and parts.get(id(within)):
                continue
            most = 1 if words & ADVERT_WORDS else 2
            if most * sum(weight[id(x)] for x in nodes) > weight[id(within)] - (most == 1):
                for x in nodes:
                    x.out = 0
                changed, heavy = True, nodes
                while heavy and heavy[0].tag not in ("article", "main"):  # down to where the text parts, at once
                    heavy = [c for c in heavy[0].children if isinstance(c, Node) and c.out != 1 and 2 * weight[id(c)] > weight[id(within)]]
                    for x in heavy:
                        x.out = 0


def parse(page: str) -> Node:
    """The tree; children are nodes and strings (character references decoded). Linear in the page: open elements are
    found by their tag's depths, not by walking up."""
    root = Node("#root", None)
    stack, depths = [root], {}  # the open elements, and by tag the depths at which it is open
    at, n, begun, odd = 0, len(page), False, 0
    last = page.rfind(">")

    def close(depth: int) -> None:
        while len(stack) > depth:
            depths[stack.pop().tag].pop()

    def text(s: str) -> None:
        nonlocal begun
        if s:
            if s.strip():
                if stack[-1].tag == "head":
                    close(len(stack) - 1)
                begun = begun or stack[-1].tag in ("#root", "html")
            stack[-1].children.append(_html.unescape(s) if "&" in s else s)

    while at < n:
        begin = page.find("<", at)
        if begin < 0 or begin > last:
            text(page[at:] if not page.startswith("<!--", begin) or begin < 0 else page[at:begin])
            break
        m = TOKEN.match(page, begin) if odd < ODD_TAGS else None
        if m is None:
            m = PLAIN_TAG.match(page, begin) or TOKEN.match(page, begin)
            if m is None:
                text(page[at : begin + 1])
                at = begin + 1
                continue
            odd += 1
        text(page[at:begin])
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag, now = tag.lower(), stack[-1]
        if m[1]:
            if tag in ("html", "body"):
                continue
            if depths.get(tag):
                close(depths[tag][-1])
            elif tag in ("p", "br"):
                now.children.append(Node(tag, now))
            continue
        if now.tag == "head" and tag not in HEAD:
            close(len(stack) - 1)
        if tag == "body" or tag not in HEAD:
            if tag == "body" and begun:
                continue
            begun = True
        if tag in CLOSES_P or tag in SIBLINGS:
            ends, stop = (("p",), P_SCOPE) if tag in CLOSES_P else (SIBLINGS[tag], SCOPE[tag])
            bound = max((depths[t][-1] for t in stop if depths.get(t)), default=0)
            first = [d[i] for t in ends if (d := depths.get(t)) and (i := bisect_right(d, bound)) < len(d)]
            if first:
                close(min(first))
        now, attributes = stack[-1], m[3]
        node = Node(tag, now, *left_out(tag, attributes, bool(depths.get("article") or depths.get("main"))))
        now.children.append(node)
        if tag in VOID or attributes.endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            node.out = 1
            at = end.end() if end else n
            continue
        depths.setdefault(tag, []).append(len(stack))
        stack.append(node)
    return root


def in_order(root: Node) -> list[Node]:
    """Nodes that are not left out, parents first."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node) and not c.out)
    return out


def measure(nodes: list[Node]) -> None:
    linked = {id(x): x.tag == "a" for x in nodes}
    for x in nodes:
        linked[id(x)] = linked[id(x)] or bool(x.parent is not None and linked.get(id(x.parent)))
    for x in reversed(nodes):
        own = sum(len(SPACE.sub("", c)) for c in x.children if isinstance(c, str))
        x.chars += own
        if linked[id(x)]:
            x.link_chars += own
        if x.parent is not None:
            p = x.parent
            p.chars += x.chars
            p.link_chars += x.link_chars
            p.tags += x.tags + 1
            p.link_tags += x.link_tags + (x.tag == "a")


def densities(nodes: list[Node], body: Node) -> None:
    """Composite density of each node, and the sum over its children."""
    share = body.link_chars / body.chars if body.chars else 0.0
    for x in nodes:
        c, t, lc, lt = x.chars, max(1, x.tags), x.link_chars, x.link_tags
        if not c:
            continue
        base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
        x.density = c / t * max(0.0, math.log(max(1.0, c / max(1, lc) * t / max(1, lt))) / base)
    for x in nodes:
        own = sum(len(c.strip()) for c in x.children if isinstance(c, str))
        x.total = own + sum(c.density for c in x.children if isinstance(c, Node) and not c.out)


def beside(node: Node) -> list[Node]:
    """Its siblings that are text rather than links."""
    return [c for c in node.parent.children if isinstance(c, Node) and not c.out and c is not node and c.chars and c.link_chars * 2 < c.chars]


def kernel(nodes: list[Node], body: Node) -> Node:
    """The subtree that holds the main text: the node with the largest density sum, raised while what stands beside it
    reaches the threshold, the least density on its path below the body.

    An article or a main part around it is kept whole, and nothing rises out of a main part. Text beside it that falls
    short ends the rise; blocks on the way that are links for the most part stay out."""
    best = max(nodes, key=lambda x: x.total)
    path = [best]
    while path[-1] is not body and path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(x.density for x in path[:-1] or path)
    marks = [i for i, x in enumerate(path) if x.tag == "article"] or [i for i, x in enumerate(path) if x.tag == "main"]
    first = top = marks[-1] if marks else 0
    for i in range(first, len(path) - 1):
        node, parent = path[i], path[i + 1]
        if node.tag == "main":
            break
        near = beside(node)
        loose = any(isinstance(c, str) and c.strip() for c in parent.children)
        if loose or node.tag not in BLOCK or any(c.density >= threshold or c.tag in TEXT_TAGS for c in near):
            top = i + 1
        elif near:
            break
    for x in path[first:top]:
        for c in x.parent.children:
            if isinstance(c, Node) and c is not x and c.tag in BLOCK and c.link_chars * 2 >= c.chars > 0:
                c.out = 1
    return path[top]


def text_of(top: Node) -> str:
    """Blocks in page order, one a line; white space inside a block is one space."""
    blocks, part = [], []

    def flush() -> None:
        if part:
            s = SPACE.sub(" ", "".join(part)).strip()
            if s:
                blocks.append(s)
            part.clear()

    stack: list = [top]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            part.append(x)
        elif not x.out:
            if x.tag in BLOCK:
                flush()
                stack.append(None)
            stack.extend(reversed(x.children))
    flush()
    return "\n".join(blocks)


def extract(page: str | None) -> str:
    root = parse(page or "")
    restore(root)
    take_back(root)
    nodes = in_order(root)
    body = next((x for x in nodes if x.tag == "body"), root)
    nodes = nodes if body is root else in_order(body)
    if body is not root:
        body.parent = None
    measure(nodes)
    if not body.chars:
        return ""
    densities(nodes, body)
    return text_of(kernel(nodes, body))


def extract_text(pages: DataFrame, *, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), slice_bytes: int = 1 << 20) -> DataFrame:
    """The kept columns and text, one row a page."""

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(batch.num_columns - 1), slice_bytes):
                part = batch.slice(a, b - a)
                out = [extract(h) for h in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(out, pa.string())], [*keep, "text"])

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return pages.select(*[F.col(c) for c in keep], F.col(html_col).cast("string").alias("html")).mapInArrow(run, f"{kinds}, text string")


def query(spark, sf_dir: str) -> DataFrame:
    from veilspark.llm.shared import table

    return extract_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
