"""Records and links of crawled pages: an HTML page in, rows out."""

from __future__ import annotations

from collections import Counter
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import batch_of, rows_by_pieces
from ..functions.phrases import GENERIC_LABELS, HEADERS
from ..functions.unicode import canonical_url, header

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Element:
    __slots__ = ("name", "attributes", "parent", "items")

    def __init__(self, name, attributes=(), parent=None):
        self.name, self.attributes, self.parent, self.items = name, dict(attributes), parent, []

    def all(self, *names):
        """Descendants of these names in page order."""
        todo = [x for x in reversed(self.items) if isinstance(x, Element)]
        while todo:
            x = todo.pop()
            if x.name in names:
                yield x
            todo.extend(y for y in reversed(x.items) if isinstance(y, Element))

    def text(self) -> str:
        parts, todo = [], [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                parts.append(x)
            elif x.name not in ("script", "style"):
                todo.extend(reversed(x.items))
        return " ".join(" ".join(parts).split())

    def ancestor(self, *names):
        x = self.parent
        while x is not None and x.name not in names:
            x = x.parent
        return x


class Tree(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("")
        self.open = Counter()  # elements from the root to `at`, so that stray end tags cost nothing
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        child = Element(tag, attrs, self.at)
        self.at.items.append(child)
        if tag not in VOID:
            self.at = child
            self.open[tag] += 1

    def handle_endtag(self, tag):
        if self.open[tag]:
            while self.at.name != tag:
                self.open[self.at.name] -= 1
                self.at = self.at.parent
            self.open[tag] -= 1
            self.at = self.at.parent

    def handle_data(self, data):
        self.at.items.append(data)

    def free(self) -> None:
        """Takes the tree apart: elements and their parents hold each other, so it would stay until the collector finds it."""
        todo = [self.root]
        self.at = self.root
        while todo:
            x = todo.pop()
            todo.extend(y for y in x.items if isinstance(y, Element))
            x.parent, x.items = None, []


class Anchors(HTMLParser):
    """The addresses of a page's links, in page order; no tree is kept."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.found = []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.found.append(dict(attrs).get("href"))


def is_document(url: str, hosts) -> bool:
    parts = urlsplit(url)
    return ".pdf" in parts.path.lower() and (parts.hostname or "") in hosts


def header_places(cells) -> dict[str, int]:
    """Column of each field by its header's names; the first that fits wins."""
    out = {}
    for k, cell in enumerate(cells):
        name = header(cell.text())
        for field, aliases in HEADERS.items():
            if field not in out and any(header(a) == name for a in aliases):
                out[field] = k
    return out


def rows_of(html: str, page_url: str, hosts):
    """(values, header values by field, pdf_url) of table rows with a document link, then of other links."""
    tree = Tree(html)
    try:
        yield from _rows(tree.root, page_url, hosts)
    finally:
        tree.free()


def _rows(root: Element, page_url: str, hosts):
    seen = set()

    def links(node):
        for a in node.all("a"):
            if a.attributes.get("href") is not None:
                try:
                    url = canonical_url(a.attributes["href"], page_url, hosts)
                except ValueError:
                    continue
                if is_document(url, hosts):
                    yield a, url

    for table in root.all("table"):
        rows = list(table.all("tr"))
        places = header_places([x for x in rows[0].items if isinstance(x, Element) and x.name in ("th", "td")]) if rows else {}
        for row in rows:
            cells = [x.text() for x in row.items if isinstance(x, Element) and x.name == "td"]
            url = next((u for _, u in links(row)), None)
            if cells and url and url not in seen:
                seen.add(url)
                yield cells, {f: cells[k] for f, k in places.items() if k < len(cells) and cells[k]}, url
    for a, url in links(root):
        if url in seen:
            continue
        seen.add(url)
        box = a.ancestor("li", "p", "td")
        name = urlsplit(url).path.rstrip("/").rpartition("/")[2]
        stem = name.rpartition(".")[0] or name
        labels = (a.text(), box.text() if box is not None else "", stem)
        yield [next((x for x in labels if x.casefold() not in GENERIC_LABELS), "")], {}, url


def page_rows(pages: DataFrame, hosts: tuple[str, ...], url: str = "url", html: str = "html") -> DataFrame:
    """page_url, values, named (map of header fields), pdf_url: one row for each document link of each page."""

    schema = pa.schema([("page_url", pa.string()), ("values", pa.list_(pa.string())), ("named", pa.map_(pa.string(), pa.string())), ("pdf_url", pa.string())])

    def run(batches):
        for b in batches:
            for rows in rows_by_pieces(b, "html"):
                yield batch_of([(u, v, list(n.items()), p) for u, h in rows if h for v, n, p in rows_of(h, u or "", hosts)], schema)

    taken = pages.select(F.col(url).alias("url"), F.col(html).alias("html"))
    return taken.mapInArrow(run, "page_url string, values array<string>, named map<string,string>, pdf_url string")


def records(pages: DataFrame, hosts: tuple[str, ...], **columns) -> DataFrame:
    """Catalogue records of crawled pages; header-mapped cells come before what is inferred."""
    from ..operators.catalog import records_from_values

    made = records_from_values(page_rows(pages, hosts, **columns))
    return made.select("document_number", "date", "title", "language", "pdf_url", F.col("page_url").alias("source_page"))


def relevant_links(pages: DataFrame, slug: str, hosts: tuple[str, ...], url: str = "url", html: str = "html") -> DataFrame:
    """Distinct links to official pages, no documents, whose path holds the topic's slug."""

    schema = pa.schema([("page_url", pa.string()), ("link", pa.string())])

    def links(u, h):
        for href in Anchors(h or "").found:
            try:
                link = canonical_url(href or "", u or "", hosts)
            except ValueError:
                continue
            parts = urlsplit(link)
            if slug and (parts.hostname or "") in hosts and ".pdf" not in parts.path.lower() and slug in parts.path.lower():
                yield u, link

    def run(batches):
        for b in batches:
            for rows in rows_by_pieces(b, "html"):
                yield batch_of(list({x for u, h in rows for x in links(u, h)}), schema)

    taken = pages.select(F.col(url).alias("url"), F.col(html).alias("html"))
    return taken.mapInArrow(run, "page_url string, link string").distinct()
