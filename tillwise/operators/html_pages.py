"""Title, content, links and list rows of HTML pages.

Spark has no HTML parser, so pages are read in Python over Arrow batches, each in one pass: elements are kept as ranges of
the page's text pieces and links, so the text of any element, its length and its links are slices and no tree is built."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

# Elements without content, elements that are left out, where content is looked for, what a list row is.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
DROPPED = {"script", "style", "iframe", "noscript", "svg", "form", "nav", "header", "footer", "aside", "template"}
ROOT_TAGS = ["main", "article"]
ROOT_IDS = ["content", "contents"]
ROOT_CLASSES = ["content", "contents", "view-content", "board-view", "detail", "notice-view"]
ROW_TAGS = {"tr", "li"}
ROW_CLASSES = {"event", "event-card", "event-item", "calendar-item"}
PUBLISHER = ["og:site_name", "author"]
PUBLISHED = ["article:published_time", "date", "datePublished"]

SCHEMA = ("page_id bigint, url string, title string, body string, published_at string, publisher string, "
          "links array<struct<href:string,in_row:boolean>>, rows array<struct<text:string,hrefs:array<string>>>")


def clean_lines(text: str) -> str:
    """Composed form, blanks folded inside lines, no empty lines."""
    lines = unicodedata.normalize("NFKC", text).replace("\r\n", "\n").replace("\r", "\n").split("\n")
    return "\n".join(line for line in (re.sub(r"[ \t]+", " ", line).strip() for line in lines) if line)


def root_order(tag: str, attrs: dict[str, str | None]) -> int | None:
    """Place of the first selector that an element meets, or None."""
    classes = (attrs.get("class") or "").split()
    meets = [*(tag == t for t in ROOT_TAGS), attrs.get("role") == "main", *(attrs.get("id") == i for i in ROOT_IDS), *(c in classes for c in ROOT_CLASSES)]
    return meets.index(True) if any(meets) else None


class Element:
    """An open or closed element as ranges of text pieces and links."""

    __slots__ = ("tag", "order", "row", "text", "links", "text_end", "links_end")

    def __init__(self, tag: str, order: int | None, row: bool, text: int, links: int):
        self.tag, self.order, self.row = tag, order, row
        self.text, self.links, self.text_end, self.links_end = text, links, None, None


class PageReader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self.links: list[str] = []
        self.open: list[Element] = []
        self.kept: list[Element] = []  # candidates for the root, rows, title and body, in document order
        self.dropped = 0
        self.by_property: dict[str, str] = {}
        self.by_name: dict[str, str] = {}
        self.time: str | None = None
        self.joined = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.joined = False
        a = dict(attrs)
        if not self.dropped and tag == "meta":
            for key, table in (("property", self.by_property), ("name", self.by_name)):
                if a.get(key):
                    table.setdefault(a[key], a.get("content") or "")
        if not self.dropped and tag == "time" and self.time is None and "datetime" in a:
            self.time = (a["datetime"] or "").strip()
        if tag in VOID:
            return
        self.dropped += tag in DROPPED
        element = Element(tag, None, False, len(self.pieces), len(self.links))
        self.open.append(element)
        if self.dropped:
            return
        element.order = root_order(tag, a)
        element.row = tag in ROW_TAGS or "data-event" in a or bool(ROW_CLASSES.intersection((a.get("class") or "").split()))
        if element.order is not None or element.row or tag in ("title", "body"):
            self.kept.append(element)
        if tag == "a" and "href" in a:
            self.links.append((a["href"] or "").strip())

    def handle_endtag(self, tag: str) -> None:
        self.joined = False
        if tag in VOID or all(e.tag != tag for e in reversed(self.open)):
            return
        while True:
            element = self.open.pop()
            element.text_end, element.links_end = len(self.pieces), len(self.links)
            self.dropped -= element.tag in DROPPED
            if element.tag == tag:
                return

    def handle_comment(self, data: str) -> None:
        self.joined = False

    def handle_decl(self, decl: str) -> None:
        self.joined = False

    def handle_data(self, data: str) -> None:
        if self.dropped:
            return
        if self.joined:
            self.pieces[-1] += data
        else:
            self.pieces.append(data)
        self.joined = True

    def result(self) -> dict:
        self.close()
        for element in self.open:
            element.text_end, element.links_end = len(self.pieces), len(self.links)
        pieces = [p.strip() for p in self.pieces]
        sizes = [0, *accumulate(len(p) for p in pieces)]
        counts = [0, *accumulate(p != "" for p in pieces)]

        def length(e: Element) -> int:
            """Of the element's pieces with a blank between them."""
            some = counts[e.text_end] - counts[e.text]
            return sizes[e.text_end] - sizes[e.text] + max(0, some - 1)

        text = lambda a, b, mark="\n": clean_lines(mark.join(p for p in pieces[a:b] if p))
        title = next((text(e.text, e.text_end, " ") for e in self.kept if e.tag == "title"), "")
        roots = [e for e in self.kept if e.order is not None]
        whole = Element("", None, False, 0, 0)
        whole.text_end, whole.links_end = len(pieces), len(self.links)
        body = next((e for e in self.kept if e.tag == "body"), whole)
        root = min(roots, key=lambda e: (-length(e), e.order)) if roots else body  # of equals the first in document order
        inside = lambda e: e is not root and root.text <= e.text and e.text_end <= root.text_end and root.links <= e.links and e.links_end <= root.links_end
        at = self.kept.index(root) if root in self.kept else -1
        rows = [e for i, e in enumerate(self.kept) if e.row and i > at and inside(e)]
        in_row = [False] * len(self.links)
        for e in rows:
            in_row[e.links:e.links_end] = [True] * (e.links_end - e.links)
        wanted = lambda h: h and not h.casefold().startswith(("javascript:", "#"))
        stated = lambda names: next((v.strip() for v in ((self.by_property.get(n) if n in self.by_property else self.by_name.get(n)) for n in names) if v), None)
        return {"title": title, "body": text(root.text, root.text_end), "published_at": stated(PUBLISHED) or self.time, "publisher": stated(PUBLISHER),
                "links": [{"href": self.links[i], "in_row": in_row[i]} for i in range(root.links, root.links_end) if wanted(self.links[i])],
                "rows": [{"text": t, "hrefs": list(dict.fromkeys(h for h in self.links[e.links:e.links_end] if h))} for e in rows if (t := text(e.text, e.text_end))]}


def read_page(html: str) -> dict:
    reader = PageReader()
    reader.feed(html)
    return reader.result()


def extract_pages(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) to title, content, links and rows.

    The content is the longest of the elements that meet a content selector, and the body, or all, where none does; links
    and rows are those inside it. Navigation, forms, scripts and the like are left out beforehand. A null page has no text."""
    type_ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("title", pa.string()), ("body", pa.string()), ("published_at", pa.string()), ("publisher", pa.string()),
                       ("links", pa.list_(pa.struct([("href", pa.string()), ("in_row", pa.bool_())]))), ("rows", pa.list_(pa.struct([("text", pa.string()), ("hrefs", pa.list_(pa.string()))])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                rows = [{"page_id": i, "url": u, **read_page(h or "")} for i, u, h in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html")))]
                yield pa.RecordBatch.from_pylist(rows, type_)

    return pages.select("page_id", "url", "html").mapInArrow(run, SCHEMA)
