"""The one-pass page reader beside a reader that builds a tree."""

import random
import re
from html.parser import HTMLParser

import pytest

from tillwise.operators import html_pages as hp


class Node:
    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self):
        for child in self.children:
            yield child
            if isinstance(child, Node):
                yield from child.walk()

    def strings(self):
        return [c.strip() for c in self.walk() if isinstance(c, str) and c.strip()]


class Tree(HTMLParser):
    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.at = self.top = Node("", {}, None)
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in hp.VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node and node.tag != tag:
            node = node.parent
        if node and tag not in hp.VOID:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def drop(node):
    node.children = [c for c in node.children if isinstance(c, str) or c.tag not in hp.DROPPED]
    for c in node.children:
        if isinstance(c, Node):
            drop(c)


def by_tree(html):
    top = Tree(html).top
    drop(top)
    nodes = [n for n in top.walk() if isinstance(n, Node)]
    classes = lambda n: (n.attrs.get("class") or "").split()
    selectors = [*(lambda n, t=t: n.tag == t for t in ("main", "article")), lambda n: n.attrs.get("role") == "main", *(lambda n, i=i: n.attrs.get("id") == i for i in ("content", "contents")),
                 *(lambda n, c=c: c in classes(n) for c in ("content", "contents", "view-content", "board-view", "detail", "notice-view"))]
    found = list(dict.fromkeys(n for s in selectors for n in nodes if s(n)))
    body = next((n for n in nodes if n.tag == "body"), top)
    root = max(found, key=lambda n: len(" ".join(n.strings()))) if found else body
    rows = [n for n in root.walk() if isinstance(n, Node) and (n.tag in ("tr", "li") or "data-event" in n.attrs or {"event", "event-card", "event-item", "calendar-item"} & set(classes(n)))]
    anchors = lambda n: [(a.attrs["href"] or "").strip() for a in n.walk() if isinstance(a, Node) and a.tag == "a" and "href" in a.attrs]
    title = next((n for n in nodes if n.tag == "title"), None)
    return {"title": hp.clean_lines(" ".join(title.strings())) if title else "", "body": hp.clean_lines("\n".join(root.strings())),
            "links": [h for h in anchors(root) if h and not h.lower().startswith(("javascript:", "#"))],
            "rows": [(t, list(dict.fromkeys(h for h in anchors(n) if h))) for n in rows if (t := hp.clean_lines("\n".join(n.strings())))]}


def shape(page):
    return {"title": page["title"], "body": page["body"], "links": [x["href"] for x in page["links"]], "rows": [(r["text"], r["hrefs"]) for r in page["rows"]]}


def random_page(rng):
    opens = ["<div>", "<p>", "<main>", "<article>", '<div class="a content">', '<div id="contents">', "<li>", "<tr>", '<div class="event-card">', "<ul>", '<div role="main">', "<nav>", "<header>", "<form>", "<td data-event>", "<body>", "<title>", "<br>", "<br/>", "<section class='detail'>", "<div/>"]
    closes = [re.sub(r"<(\w+).*", r"</\1>", o) for o in opens]
    bits = ["text", " two words ", "&amp; more", "ｗｉｄｅ", "\n", "", "2001-05-06", '<a href="/x/%d">link</a>', "<a href=''>none</a>", "<a name='n'>no link</a>", '<a href="JavaScript:x()">js</a>', "<!-- note -->"]
    return "".join(rng.choice([*opens, *closes, *bits, *bits, *bits]).replace("%d", str(rng.randrange(5))) for _ in range(rng.randrange(1, 60)))


def test_random_pages():
    rng = random.Random(8)
    for _ in range(3000):
        html = random_page(rng)
        if "<title>" not in html:  # what stands in a title is text, tags and all, in newer parsers: both readers leave that to the parser
            assert shape(hp.read_page(html)) == by_tree(html), html


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01"])
def test_raw_pages(spark, name):
    pages = spark.read.parquet(f"/root/testdata/{name}/pages.parquet")
    want = {r.page_id: by_tree(r.html or "") for r in pages.collect()}
    got = {r.page_id: {"title": r.title, "body": r.body, "links": [x.href for x in r.links], "rows": [(x.text, x.hrefs) for x in r.rows]} for r in hp.extract_pages(pages).collect()}
    assert got == want


def test_content_root_and_what_is_outside():
    html = ('<body><a href="/event/out">out</a><div id="content"><p>long enough to win here</p><a href="/event/in">in</a></div><article>short</article><li>Outside row of 2001-05-06, long enough</li></body>')
    page = hp.read_page(html)
    assert page["body"] == "long enough to win here\nin" and [x["href"] for x in page["links"]] == ["/event/in"] and page["rows"] == []


def test_times_and_meta():
    assert hp.read_page("<time datetime=' 2001-05-05 '>x</time>")["published_at"] == "2001-05-05"
    assert hp.read_page("<meta name=date content=''><meta name=datePublished content='2001'><time datetime='1999'>x</time>")["published_at"] == "2001"
    assert hp.read_page("<nav><time datetime='1999'>x</time></nav>")["published_at"] is None
    assert hp.read_page("<meta name=author content='A'><meta property='og:site_name' content='S'>")["publisher"] == "S"


def test_null_and_empty_pages(spark):
    got = hp.extract_pages(spark.createDataFrame([(1, "u", None), (2, None, "")], "page_id bigint, url string, html string")).collect()
    assert [(r.title, r.body, r.links, r.rows, r.published_at) for r in got] == [("", "", [], [], None)] * 2
