"""Web pages as rows: one pass of the standard library's parser gives a page's links and elements, which columns then score."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from quillflow.functions.selectors import NODE, shortest

VOID = {*"area base br col embed hr img input link meta param source track wbr".split()}
HIDDEN = {"script", "style", "iframe", "noscript", "template"}
BREAKS = {"p", "div", "li", "h1", "h2", "h3", "tr", "section", "article", "ul", "ol"}
#: Elements that a paragraph cannot hold: they end it.
ENDS_P = {*"address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()}
LINK = "struct<n: int, href: string, title: string>"
ELEMENT = "struct<tag: string, id: string, class: string, depth: int, selector: string, first_link: int, n_links: int, n_chars: int, n_solid: int, n_link_chars: int, n_tags: int, n_br: int, n_p: int, text: string>"
PAGE = f"title string, h1 string, body string, links array<{LINK}>, elements array<{ELEMENT}>"
#: Elements whose text is kept, as content may be in them.
CONTAINERS = {"div", "article", "section", "td", "main"}


def _stays(href: str) -> bool:
    """Whether a link leads nowhere else: its text is part of the page's."""
    return not href or href == "#" or href.lower().startswith("javascript:")


class _Node:
    __slots__ = ("tag", "id", "cls", "depth", "path", "first", "start", "solid", "tags", "br", "p", "link_solid", "children", "at", "end", "last")

    def __init__(self, tag: str, attrs: dict, depth: int, path: str, page: "_Page"):
        self.tag, self.id, self.cls, self.depth, self.path = tag, attrs.get("id") or "", attrs.get("class") or "", depth, path
        self.first, self.start = len(page.links), len(page.text)
        self.solid, self.tags, self.br, self.p, self.link_solid = page.solid, page.tags, page.br, page.p, page.link_solid
        self.children: dict[str, int] = {}
        self.at, self.end, self.last = -1, None, None


class _Page(HTMLParser):
    """Text is one list of pieces; an element's text, links and counts are what was added between its start and end."""

    def __init__(self, keeps_nodes: bool = False):
        super().__init__(convert_charrefs=True)
        #: (node, parent's place, attributes, its link's place) of each element, void ones too, in the order in which they begin.
        self.nodes: list[tuple] | None = [] if keeps_nodes else None
        self.stack, self.links, self.elements, self.text, self.away = [], [], [], [], []
        self.title, self.h1, self.solid, self.tags, self.br, self.p, self.link_solid = [], [], 0, 0, 0, 0, 0
        self.in_link, self.hidden, self.in_title, self.heading, self.done_title, self.done_h1 = None, 0, False, False, False, False

    def _add(self, piece: str, leads_away: bool = False):
        self.text.append(piece)
        self.away.append(leads_away)

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag in ENDS_P and any(n.tag == "p" for n in self.stack[-3:]):
            self.handle_endtag("p")
        if tag == "li" and self.stack and self.stack[-1].tag == "li":
            self.handle_endtag("li")
        self.tags += 1
        if tag == "br":
            self.br += 1
            self._add("\n")
        parent = self.stack[-1] if self.stack else None
        if tag in VOID:
            if self.nodes is not None:
                node = _Node(tag, attrs, len(self.stack) + 1, "", self)
                node.end, node.last = len(self.text), len(self.links)
                self.nodes.append((node, parent.at if parent else -1, attrs, -1))
            return
        nth = 1
        if parent:
            nth = parent.children[tag] = parent.children.get(tag, 0) + 1
        own = f"#{attrs['id']}" if attrs.get("id") else f"{tag}:nth-of-type({nth})"
        path = own if attrs.get("id") or not parent else f"{parent.path} > {own}"
        if tag == "p":
            self.p += 1
        node = _Node(tag, attrs, len(self.stack) + 1, path, self)
        self.stack.append(node)
        if tag in HIDDEN:
            self.hidden += 1
        elif tag == "title" and not self.done_title:
            self.in_title = True
        elif tag == "h1" and not self.done_h1:
            self.heading = True
        elif tag == "a" and attrs.get("href") is not None:
            self.in_link = len(self.links)
            self.links.append([(attrs["href"] or "").strip(), len(self.text), None])
        if self.nodes is not None:
            node.at = len(self.nodes)
            self.nodes.append((node, parent.at if parent else -1, attrs, self.in_link if tag == "a" and self.in_link is not None else -1))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in VOID or not any(n.tag == tag for n in self.stack):
            return
        while self.stack:
            node = self.stack.pop()
            self._ended(node)
            if node.tag == tag:
                return

    def _ended(self, node: _Node):
        if node.tag in HIDDEN:
            self.hidden -= 1
        elif node.tag == "title":
            self.in_title, self.done_title = False, True
        elif node.tag == "h1":
            self.heading, self.done_h1 = False, True
        elif node.tag == "a" and self.in_link is not None:
            self.links[self.in_link][2] = len(self.text)
            self.in_link = None
            self._add("\n", True)
        if node.tag in BREAKS:
            self._add("\n")
        node.end, node.last = len(self.text), len(self.links)
        self.elements.append((node, len(self.links), len(self.text), self.solid, self.tags, self.br, self.p, self.link_solid))

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
            return
        if self.hidden:
            return
        if self.heading:
            self.h1.append(data)
        leads_away = self.in_link is not None and not _stays(self.links[self.in_link][0])
        self._add(data, leads_away)
        solid = len("".join(data.split()))
        self.solid += solid
        if self.in_link is not None:
            self.link_solid += solid


def _nodes(page: _Page) -> tuple[list[dict], str]:
    """All elements of a page as NODEs, and the text that their start and size are places in: links that lead away are line ends there, as in content."""
    pieces = ["\n" if away else x for x, away in zip(page.text, page.away)]
    at, places = 0, [0]
    for x in pieces:
        at += len(x)
        places.append(at)
    out, prev, kinds, siblings = [], {}, {}, {}
    for i, (n, parent, attrs, link) in enumerate(page.nodes):
        siblings[parent] = siblings.get(parent, 0) + 1
        kinds[parent, n.tag] = kinds.get((parent, n.tag), 0) + 1
        out.append({
            "at": i, "parent": parent, "prev": prev.get(parent, -1), "ancestors": [*out[parent]["ancestors"], parent] if parent >= 0 else [], "tag": n.tag, "id": n.id, "classes": n.cls.split(),
            "attrs": [(k, v or "") for k, v in attrs.items()], "child": siblings[parent], "of_type": kinds[parent, n.tag], "link": link, "first_link": n.first, "n_links": n.last - n.first, "start": places[n.start], "size": places[n.end] - places[n.start],
        })
        prev[parent] = i
    for n in out:
        n["children_after"], n["of_type_after"] = siblings[n["parent"]] - n["child"], kinds[n["parent"], n["tag"]] - n["of_type"]
    for n, own in zip(out, shortest(out)):
        n["selector"] = own
    return out, "".join(pieces)


def parse(html: str | None, nodes: bool = False) -> dict:
    page = _Page(nodes)
    page.feed(html or "")
    page.close()
    while page.stack:
        page._ended(page.stack.pop())
    squeeze = lambda a, b: " ".join("".join(page.text[a:b]).split())
    links = [{"n": i, "href": href, "title": squeeze(a, len(page.text) if b is None else b)} for i, (href, a, b) in enumerate(page.links)]
    elements = []
    for node, last, end, solid, tags, br, p, link_solid in page.elements:
        n_links = last - node.first
        container = node.tag in CONTAINERS
        # what can be a table of contents, a block of text, or be named by a selector of one's own
        if n_links < 3 and not container and not (n_links and (node.id or node.cls)):
            continue
        text = "".join(page.text[node.start : end]) if container else ""
        own = "".join("\n" if a else x for x, a in zip(page.text[node.start : end], page.away[node.start : end])) if container else ""
        elements.append({
            "tag": node.tag, "id": node.id, "class": node.cls, "depth": node.depth, "selector": node.path, "first_link": node.first, "n_links": n_links, "n_chars": len(" ".join(text.split())),
            "n_solid": solid - node.solid, "n_link_chars": link_solid - node.link_solid, "n_tags": tags - node.tags + 1, "n_br": br - node.br, "n_p": p - node.p, "text": own,
        })
    found = {"title": "".join(page.title).strip(), "h1": " ".join("".join(page.h1).split()), "body": squeeze(0, len(page.text))[:4000], "links": links, "elements": elements}
    if nodes:
        found["nodes"], found["own_text"] = _nodes(page)
    return found


_NODE_TYPES = {"ancestors": pa.list_(pa.int32()), "classes": pa.list_(pa.string()), "attrs": pa.map_(pa.string(), pa.string()), "tag": pa.string(), "id": pa.string(), "selector": pa.string()}


def parsed(pages: DataFrame, *columns: str, nodes: bool = False) -> DataFrame:
    """columns of pages, and title, h1, body (the first 4000 characters, for marks in it), links and elements of each page's html.

    nodes: also all its elements as NODEs, which selectors need, and own_text, in which they have their places.
    """
    chosen = pages.select(*columns, "html")
    kept = [f for f in chosen.schema.fields if f.name != "html"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), PAGE, *([f"nodes array<{NODE}>, own_text string"] if nodes else [])])
    more = [n.split(":")[0].strip() for n in NODE[len("struct<") : -1].replace("map<string,string>", "map").split(", ")]
    node = pa.struct([(n, _NODE_TYPES.get(n, pa.int32())) for n in more])
    link = pa.struct([("n", pa.int32()), ("href", pa.string()), ("title", pa.string())])
    ints = ("depth", "first_link", "n_links", "n_chars", "n_solid", "n_link_chars", "n_tags", "n_br", "n_p")
    names = [x.split(":")[0].strip() for x in ELEMENT[len("struct<") : -1].split(",")]
    element = pa.struct([(n, pa.int32() if n in ints else pa.string()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [parse(h.as_py(), nodes) for h in part.column(part.schema.get_field_index("html"))]
                own = [pa.array([p[n] for p in found], pa.string()) for n in ("title", "h1", "body")]
                all_ = [pa.array([p["nodes"] for p in found], pa.list_(node)), pa.array([p["own_text"] for p in found], pa.string())] if nodes else []
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(f.name) for f in kept), *own, pa.array([p["links"] for p in found], pa.list_(link)), pa.array([p["elements"] for p in found], pa.list_(element)), *all_],
                    [*(f.name for f in kept), "title", "h1", "body", "links", "elements", *(["nodes", "own_text"] if nodes else [])],
                )

    return chosen.mapInArrow(run, schema)
