"""Main text of web pages by tree scoring."""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import aside

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>", re.S
)
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+))|(\bhidden\b)", re.S)

# Element names of HTML by what they do here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe xmp noembed noframes textarea title".split())
INLINE = frozenset(
    "a abbr acronym area b base bdi bdo big cite code data del dfn em embed font i img input ins kbd label link map mark math meta mi mn mo mrow msub msup mtext object param "
    "picture q rb rp rt ruby s samp small source span strike strong sub sup svg time track tt u var wbr".split()
)
FOREIGN = ("svg", "math")
JUNK_TAGS = frozenset("nav header footer aside form button select option menu dialog head svg".split())
JUNK_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog form".split())
KEPT_TAGS = frozenset("html body article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p pre td th blockquote li dd dt figcaption div section article main body center".split())
TEXT_BLOCKS = frozenset("p pre blockquote ul ol dl figure table address details".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCES = frozenset("table ul ol dl article section main div body html blockquote aside form nav header footer".split())

# Words in class names and ids. A listed name lowers the score of what an element holds; nothing is dropped by it alone.
COMMENT_WORDS = frozenset(
    "comment comments commentlist commentaires comentarios kommentare replies responses reactions discussion discussions disqus guestbook".split()
)
STRONG_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead "
    "cookie cookies gdpr consent popup modal share sharing related recommended subscribe newsletter signup pagination pager".split()
)
WEAK_WORDS = frozenset(
    "banner header head foot respond notice notices notification alert overlay social login search toolbar widget copyright disclaimer skip".split()
)
#: What a listed word may stand with and still name the whole element: with any other word it only may.
PLACES = frozenset(
    "box boxes container wrapper wrap block area list lists link links button buttons bar section inner outer top left right bottom main primary secondary site page global "
    "post posts article articles story stories item items content text body unit slot row col column panel module group form region zone first second last new more icon icons".split()
)
STATES = frozenset("has with without no is open closed on off enabled allowed".split())
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
PLAIN, WEAK, STRONG, COMMENT, NEVER = range(5)
#: What is left of the points of an element's paragraphs, by the kind of its name.
FACTORS = (1.0, 0.5, 0.15, 0.05, 0.0)


class Node:
    __slots__ = ("tag", "parent", "items", "kind", "factor", "score", "points", "total", "chars", "linked", "commas", "own", "heads")

    def __init__(self, tag, parent, kind=PLAIN):
        self.tag, self.parent, self.items, self.kind, self.factor = tag, parent, [], kind, 1.0
        self.score = self.points = self.total = 0.0
        self.chars = self.linked = self.commas = self.own = self.heads = 0


def kind_of_name(name: str) -> int:
    """Whether a class name or id names a comment, a menu, advert, sidebar and the like, or may do so."""
    parts = [x.lower() for x in NAME_PART.findall(name)]
    if not parts or parts[0] in STATES or parts[-1] in STATES:
        return PLAIN
    if any(x in COMMENT_WORDS for x in parts):
        return COMMENT
    listed = [x in STRONG_WORDS or x in WEAK_WORDS for x in parts]
    if not any(listed):
        return PLAIN
    sure = any(x in STRONG_WORDS for x in parts) or len(parts) == 1
    return STRONG if sure and all(a or x in PLACES for a, x in zip(listed, parts, strict=True)) else WEAK


def kind_of(tag: str, attributes: str) -> int:
    """What an element's tag, role, visibility and names say of it."""
    kind = {"form": STRONG, "header": WEAK}.get(tag, NEVER) if tag in JUNK_TAGS else PLAIN
    if not attributes or kind == NEVER:
        return kind
    for name, a, b, c, hidden in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if hidden or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return NEVER
        if name == "role" and value.lower() in JUNK_ROLES:
            return NEVER
        if name in ("class", "id"):
            named = max(map(kind_of_name, value.split()), default=PLAIN)
            if tag not in KEPT_TAGS or named == COMMENT:
                kind = max(kind, named)
    return kind


def parse(html: str) -> Node:
    """The tree of a page: children are nodes and decoded texts; scripts, styles and comments are left out."""
    root = Node("html", None)
    at, node, text_from = 0, root, 0
    opened = Counter()  # elements on the way from the root to `node`, by name
    lower = None

    def add(text):
        if text:
            node.items.append(unescape(text) if "&" in text else text)

    while m := TOKEN.search(html, at):
        add(html[text_from : m.start()])
        at = text_from = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        tag, closing, attributes = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if closing:
            if opened[tag]:
                up = node
                while up.tag != tag:
                    opened[up.tag] -= 1
                    up = up.parent
                opened[tag] -= 1
                node = up.parent
            continue
        if tag in RAW:
            if not attributes.endswith("/") or tag in ("script", "style"):
                lower = lower or html.lower()  # positions agree: only used to find ASCII names
                if len(lower) != len(html):
                    lower = re.sub("[A-Z]", lambda x: x[0].lower(), html)
                end = lower.find(f"</{tag}", at)
                close = html.find(">", end) if end >= 0 else -1
                if close >= 0:
                    at = text_from = close + 1
                elif tag in ("script", "style"):
                    at = text_from = len(html)
            continue
        if tag == "html" or tag == "body" and opened[tag]:
            continue
        if tag not in INLINE:
            if opened["svg"] or opened["math"]:  # left open: pages go on in HTML
                while opened["svg"] or opened["math"]:
                    opened[node.tag] -= 1
                    node = node.parent
            for ended in ({"p"}, CLOSES.get(tag, ())):
                if any(opened[x] for x in ended):
                    up = node
                    while up.tag not in ended and up.tag not in FENCES:
                        up = up.parent
                    if up.tag in ended:
                        while node is not up.parent:
                            opened[node.tag] -= 1
                            node = node.parent
        if tag in VOID:
            node.items.append(Node(tag, node))
            continue
        child = Node(tag, node, kind_of(tag, attributes))
        node.items.append(child)
        if not attributes.endswith("/") or tag in ("p", "div", "a", "span"):
            node = child
            opened[tag] += 1
    add(html[text_from:])
    return root


def density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def measure(root: Node) -> list[Node]:
    """Characters, commas, linked characters and points of all nodes; returns those that can count, in page order.

    A paragraph's points are 1, its commas, and a point for each 100 characters (3 at most), less its share of
    linked text and what its own and its ancestors' names take off. Its parent gets them in full, every
    further ancestor half of what the one below it got.
    """
    nodes, todo = [], [(root, False)]
    while todo:
        node, linked = todo.pop()
        if node.kind == NEVER:
            continue
        nodes.append(node)
        if node.parent:
            node.factor = node.parent.factor
        node.factor *= FACTORS[node.kind]
        linked = linked or node.tag == "a"
        below = []
        for x in node.items:
            if isinstance(x, str):
                n = len(" ".join(x.split()))
                node.own += n
                node.chars += n
                node.commas += x.count(",") + x.count("،") + x.count("，") + x.count("、")
                node.linked += n if linked else 0
            else:
                below.append((x, linked))
        todo.extend(reversed(below))
    for node in reversed(nodes):
        if node.tag in PARAGRAPHS and node.own >= 25:
            node.points = (1 + node.commas + min(node.own / 100, 3)) * (1 - density(node))
            node.total += node.points
            if node.tag in FENCES:
                node.score += node.points * node.factor
        up = node.parent
        if up:
            up.chars += node.chars
            up.linked += node.linked
            up.total += node.total
            up.heads += node.heads + (node.tag in ("h1", "h2"))
            up.score += node.score / 2 + (0 if node.tag in FENCES else node.points * node.factor)
            if node.tag in INLINE:
                up.own += node.own
                up.commas += node.commas
    return nodes


def _ancestors(node: Node):
    while node := node.parent:
        yield node


def _length(node: Node) -> int:
    n, todo = 0, [node]
    while todo:
        for x in todo.pop().items:
            if isinstance(x, str):
                n += len(x)
            else:
                todo.append(x)
    return n


def mark_lists(root: Node) -> list[list[Node]]:
    """Marks lists of articles that follow the page's own text, or stand inside an article, as comments.

    Elements of one shape, repeated: replies of readers, or teasers of other articles. A list counts as the
    page's own where no article and fewer than two long paragraphs stand before it; those are returned.
    """
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.kind != NEVER:
            order.append(node)
            todo.extend(x for x in reversed(node.items) if not isinstance(x, str))
    lists = {}
    for k, node in enumerate(order):
        if node.tag == "article":
            holder = node.parent
            while holder.tag == "li":
                holder = holder.parent
            lists.setdefault(id(holder), (holder, k, []))[2].append(node)
    own = []
    if sum(len(x) for *_, x in lists.values()) < 2:
        return own
    first = next(k for k, x in enumerate(order) if x.tag == "article")
    for holder, at, members in lists.values():
        if len(members) < 2:
            continue
        if not (first < at or any(x.tag == "article" for x in (holder, *_ancestors(holder)))):
            before = (x for x in order[:at] if x.tag == "p" and x.kind == PLAIN and _length(x) >= 80)
            if next(before, None) is None or next(before, None) is None:
                own.append(members)
                continue
        for x in members:
            x.kind = max(x.kind, COMMENT)
        if holder.tag not in KEPT_TAGS and sum(map(_length, members)) >= 0.8 * _length(holder):
            holder.kind = max(holder.kind, COMMENT)
    return own


def main_nodes(root: Node) -> list[Node | str]:
    """The best container and those of its siblings that belong to it, in page order.

    The best is the node with the highest score after its own share of linked text is taken off; of equal
    ones the first. Inside an article (or a main element of which it holds most) that element takes its place.
    """
    listed = mark_lists(root)
    nodes = measure(root)
    for node in nodes:
        node.score *= 1 - density(node)
        if node.tag in ("article", "main") and node.chars:
            node.score += 25 * node.factor
    best = max((n for n in nodes if n.tag not in INLINE and n.tag != "p"), key=lambda n: n.score, default=None)
    if best is None or best.score <= 0:
        return [root]
    for up in _ancestors(best):
        if up.tag == "article" and 3 * best.total >= up.total or up.tag == "main" and 2 * best.total >= up.total:
            best = up
            break
    if best.parent is None:
        return [best]
    if best.tag == "article":  # alone, or with others as good in a page that lists them
        line = max(10.0, 0.2 * best.score)
        of = next((x for x in listed if best in x), [best])
        return [x for x in of if x is best or x.kind == PLAIN and x.score >= line]
    return _with_siblings(best)


def _with_siblings(best: Node) -> list[Node | str]:
    line, out, kept_after = max(10.0, 0.2 * best.score), [], False
    for run in reversed(_runs(best.parent.items)):
        x = run[0]
        if x is best:
            keep = True
        elif isinstance(x, str) or x.tag in INLINE:
            chars = sum(len(" ".join(i.split())) if isinstance(i, str) else i.chars for i in run)
            linked = sum(0 if isinstance(i, str) else i.linked for i in run)
            if not chars:
                continue  # blank, so it stands between nothing
            keep = chars >= 25 and linked < 0.25 * chars
        elif x.kind != PLAIN:
            keep = x.kind == WEAK and x.score >= line
        elif x.tag in HEADINGS:
            keep = kept_after and density(x) < 0.5
        else:
            keep = x.score >= line or x.tag in TEXT_BLOCKS and x.chars > 0 and density(x) < 0.25
        kept_after = keep
        if keep:
            out.extend(reversed(run))
    return out[::-1]


def _runs(items):
    """Children one by one, but texts and inline elements that follow each other together."""
    out, inline = [], False
    for x in items:
        now = isinstance(x, str) or x.tag in INLINE
        if now and inline:
            out[-1].append(x)
        else:
            out.append([x])
        inline = now
    return out


def _dropped(x: Node, total: float) -> bool:
    """Whether an element inside what is kept (of `total` points) is none of the article.

    Comments go unless they are nearly all there is, other listed names unless they hold most of the points,
    and names that only may be junk where the element is also full of links, or short and no sentence.
    """
    if x.kind == WEAK:
        return density(x) > 0.33 or x.chars < 80 and not x.heads and not (x.points and x.commas)
    return x.kind == NEVER or x.kind == STRONG and 2 * x.total <= total or x.kind == COMMENT and x.total <= 0.9 * total


def text_of(kept: list[Node | str]) -> str:
    """The texts of nodes, blocks joined by one space, without the elements that are none of the article."""
    total = sum(x.total for x in kept if isinstance(x, Node))
    parts, todo, chosen = [], list(reversed(kept)), set(map(id, kept))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            parts.append(x)
            continue
        if x.kind == NEVER or x.kind != PLAIN and id(x) not in chosen and _dropped(x, total):
            continue
        if x.tag not in INLINE:
            parts.append(" ")
            todo.append(" ")
        todo.extend(reversed(x.items))
    return " ".join("".join(parts).split())


def main_text(html: str | None) -> str:
    """The article of a page as one line of text; empty if it has none."""
    return text_of(main_nodes(parse(html))) if html else ""


def extract_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """Every row of `pages` without its html, with text and n_chars (code points).

    Null html is empty and has an empty text; broken markup is read as browsers do, more or less: open
    elements end with their parent, unknown end tags are passed over. Every row is judged alone, so nothing
    is shuffled and repeated rows and ids keep their rows; of equally good containers the first counts; an
    empty table gives an empty result. A page of any length is read whole, in time linear in it, with some
    30 times its bytes in its task. Columns named text or n_chars are replaced, others are kept.
    """
    names = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    away, back = aside(names)
    kept = [f"c{k}" for k in range(len(names))]

    def run(batches):
        for b in batches:
            texts = [main_text(h) for h in b.column(b.num_columns - 1).to_pylist()]
            made = [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], names=[*kept, "text", "n_chars"])

    taken = pages.select(*away, F.coalesce(F.col("`" + html.replace("`", "``") + "`"), F.lit("")).alias("html"))
    made = taken.mapInArrow(run, T.StructType([*taken.schema.fields[:-1], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
    return made.select(*back, "text", "n_chars")


def op3_html_extraction(spark, sf_dir: str) -> DataFrame:
    """Every row of pages: page_id, url, text, n_chars."""
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
