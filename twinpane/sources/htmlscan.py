"""Raw HTML as captures: a walk over the elements of a page in document order.

Elements are classified, placed in their landmark and under their nearest heading, counted, and given a selector. There
is no layout: boxes are zero, styles and hit tests are absent, and an element is hidden only by what the markup says.
End tags that the standard implies (p, li, td ...) are implied; other formatting is taken as it is nested.
"""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bundles import BUNDLE, PAGE

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset("head script style template noscript".split())
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: What a start tag ends if it is open: nearer than any of the elements after the colon.
ENDS = {
    "li": ("li", "ul ol"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
    "option": ("option", "select"), **{b: ("p", "td th li table section article div") for b in BLOCKS},
}
ENDS = {tag: (frozenset(a.split()), frozenset(b.split())) for tag, (a, b) in ENDS.items()}
#: Landmarks by tag and by role (fixed values).
BY_TAG = {"header": "banner", "nav": "navigation", "main": "main", "footer": "contentinfo", "aside": "complementary", "form": "form"}
BY_ROLE = ("banner", "navigation", "main", "contentinfo", "complementary", "form", "region")
MOST_TEXT, MOST_RECTS = 500, 64
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]")


def normal(text: str | None, cap: int = MOST_TEXT) -> str | None:
    """Whitespace collapsed, control characters gone, at most `cap` characters; null if nothing is left."""
    clean = _CONTROL.sub("", (text or "").replace("\xa0", " "))
    return " ".join(clean.split())[:cap].strip() or None


class Element:
    __slots__ = ("attrs", "children", "own", "parent", "parts", "place", "tag")

    def __init__(self, tag: str, attrs: dict, parent: Element | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Element] = []
        self.parts: list = []  # texts and child elements, in order
        self.own = False
        self.place = 1 + sum(c.tag == tag for c in parent.children) if parent else 1

    def text(self) -> str:
        out, stack = [], [iter(self.parts)]
        while stack:
            part = next(stack[-1], None)
            if part is None:
                stack.pop()
            elif isinstance(part, str):
                out.append(part)
            elif part.tag not in SILENT:
                out.append(" " if part.tag in BLOCKS or part.tag in ("br", "li", "td", "tr") else "")
                stack.append(iter(part.parts))
        return "".join(out)

    def up(self):
        at = self.parent
        while at is not None and at.tag != "html":
            yield at
            at = at.parent

    def hidden(self) -> bool:
        return "hidden" in self.attrs or "display:none" in re.sub(r"\s", "", self.attrs.get("style") or "").lower()


class Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("html", {}, None)
        self.at, self.lang, self.body = self.root, None, None

    def handle_starttag(self, tag, attrs):
        attrs = {k: v if v is not None else "" for k, v in attrs}
        if tag == "html":
            self.lang = attrs.get("lang", self.lang)
            return
        if tag in ENDS:
            ended, walls = ENDS[tag]
            at = self.at
            while at is not self.root and at.tag not in walls:
                if at.tag in ended:
                    self.at = at.parent
                    break
                at = at.parent
        new = Element(tag, attrs, self.at)
        self.at.children.append(new)
        self.at.parts.append(new)
        if tag == "body" and self.body is None:
            self.body = new
        if tag not in VOID:
            self.at = new

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        at = self.at
        while at is not self.root and at.tag != tag:
            at = at.parent
        if at is not self.root:
            self.at = at.parent

    def handle_data(self, data):
        self.at.parts.append(data)
        if not data.isspace():
            self.at.own = True


def parse(html: str | None) -> Tree:
    tree = Tree()
    tree.feed(html or "")
    tree.close()
    return tree


def walk(at: Element):
    stack = [at]
    while stack:
        e = stack.pop()
        yield e
        stack += reversed(e.children)


def role_of(e: Element) -> str | None:
    """The landmark that an element itself is."""
    role = (e.attrs.get("role") or "").lower()
    return role if role in BY_ROLE else BY_TAG.get(e.tag)


def classify(e: Element) -> tuple[str, str | None] | None:
    """(kind, role) of an element that counts as a node."""
    role, type_ = (e.attrs.get("role") or "").lower() or None, (e.attrs.get("type") or "text").lower()
    if re.fullmatch("h[1-6]", e.tag):
        return "heading", "heading"
    if e.tag == "a" and e.attrs.get("href") is not None:
        return "link", role or "link"
    if e.tag == "button" or role == "button" or (e.tag == "input" and type_ in ("submit", "button")):
        return "button", role or "button"
    if e.tag == "img":
        return "image", role or "img"
    if e.tag in ("select", "textarea") or (e.tag == "input" and type_ != "hidden"):
        return "field", role or e.tag
    if e.tag == "form":
        return "form", role or "form"
    return ("text", role) if e.own else None


def selector(e: Element, root: Element | None) -> str:
    parts, at = [], e
    while at is not None and at is not root and at.tag not in ("html", "body"):
        parts.append(f"{at.tag}:nth-of-type({at.place})")
        at = at.parent
    return " > ".join(reversed(parts)) or e.tag


def first_heading(e: Element, levels: str = "1-6", cap: int = MOST_TEXT) -> str | None:
    found = (normal(h.text(), cap) for h in walk(e) if h is not e and re.fullmatch(f"h[{levels}]", h.tag))
    return next((x for x in found if x), None)


def rects(body: Element) -> list[dict]:
    """Landmarks and the sections of main, by path; boxes need a layout and are zero."""
    out, count = [], {}
    for e in walk(body):
        role = (e.attrs.get("role") or "").lower()
        named = role if role in BY_ROLE and role != "region" else None
        if named is None and e.tag in BY_TAG:
            inner = e.tag in ("header", "footer") and any(a.tag in ("main", "article") for a in e.up())
            bare = e.tag == "form" and not (e.attrs.get("aria-label") or e.attrs.get("aria-labelledby"))
            named = None if inner or bare else BY_TAG[e.tag]
        if named and len(out) < MOST_RECTS:
            count[named] = count.get(named, 0) + 1
            path = named if count[named] == 1 else f"{named}[{count[named]}]"
            out.append({"path": path, "role": named, "heading": first_heading(e, "1-3", 80), "bbox": [0, 0, 0, 0]})
    main = next((e for e in walk(body) if e.tag == "main"), None) or next((e for e in walk(body) if e.attrs.get("role") == "main"), None)
    sections = [c for c in main.children if c.tag == "section" or (c.tag == "div" and c.attrs.get("id"))] if main else []
    for n, e in enumerate(sections, 1):
        if len(out) < MOST_RECTS:
            out.append({"path": f"main › section[{n}]", "role": "region", "heading": first_heading(e, "1-3", 80), "bbox": [0, 0, 0, 0]})
    return out


def scan(html: str | None, url: str) -> dict:
    """The page of a capture (without its response), the ancestors of its nodes, and its inventory."""
    tree = parse(html)
    body = tree.body or tree.root
    nodes, of, last, last_at, ordinal, firsts, covered = [], {}, None, None, {}, {}, set()
    for e in walk(body):
        if e.tag in SILENT or e.parent in covered or e.hidden():
            covered.add(e)
            continue
        kind = classify(e)
        if kind is None:
            continue
        text = None if kind[0] == "image" else normal(e.text())
        label, alt = normal(e.attrs.get("aria-label")), normal(e.attrs.get("alt")) if e.tag == "img" else None
        raw = normal(e.attrs["href"]) if kind[0] == "link" else None
        href = urljoin(url, e.attrs["href"].strip()) if kind[0] == "link" else None
        src = urljoin(url, e.attrs["src"]) if kind[0] == "image" and e.attrs.get("src") else None
        if kind[0] == "heading":
            last, last_at = text, e
        above = list(e.up())
        home = next((a for a in above if role_of(a)), None)
        landmark = role_of(home) if home else None
        if home is not None:
            key = (home, kind[0], text)
            ordinal[key] = ordinal.get(key, 0) + 1
        near, section = last, next((a for a in above if a.tag == "section"), None)
        if section is not None and not (last_at is not None and (last_at is section or section in last_at.up())):
            if section not in firsts:
                firsts[section] = first_heading(section)
            near = firsts[section] or last
        of[e] = f"node_{len(nodes)}"
        anchors = {"text": text, "role": kind[1], "href": href, "alt": alt, "ariaLabel": label, "nearestHeading": near, "landmark": landmark, "ordinalInLandmark": ordinal[(home, kind[0], text)] if home else None}
        size = [int(v) if (v := e.attrs.get(a) or "").isdigit() else None for a in ("width", "height")]
        nodes.append({
            "id": of[e], "kind": kind[0], "role": kind[1], "text": text, "accName": label or alt or text, "href": href, "imageAlt": alt, "bbox": [0, 0, 0, 0], "seqIndex": len(nodes), "anchors": anchors,
            "cssSelector": selector(e, home), "rawHref": raw, "src": src, "naturalWidth": size[0] if src else None, "naturalHeight": size[1] if src else None, "loaded": None,
            "headingLevel": int(e.tag[1]) if kind[0] == "heading" else None, "hasOnclick": True if "onclick" in e.attrs else None,
        })
    every = list(walk(tree.root))
    count = lambda *tags: sum(e.tag in tags for e in every)
    inventory = {"headingCount": count("h1", "h2", "h3"), "imageCount": count("img"), "landmarkCount": sum(role_of(e) not in (None, "form", "region") for e in every)}
    head = lambda tag, **attrs: next((e for e in every if e.tag == tag and all((e.attrs.get(k) or "").lower() == v for k, v in attrs.items())), None)
    title, description, canonical = head("title"), head("meta", name="description"), head("link", rel="canonical")
    page = {
        "url": url, "finalUrl": url, "title": normal(title.text()) if title else None, "metaDescription": description.attrs.get("content") if description else None,
        "canonical": canonical.attrs.get("href") if canonical else None, "lang": tree.lang, "nodes": nodes, "landmarks": sorted({r for e in every if (r := role_of(e))}), "landmarkRects": rects(body),
    }
    return {"page": page, "ancestors": ancestors(of, nodes), "inventory": inventory}


def ancestors(of: dict, nodes: list[dict]) -> dict:
    """Elements above the nodes, nearest first in chains; one with a single text below it has that text as its anchor."""
    by_id = {n["id"]: n for n in nodes}
    texts, chains, order, heads = {}, {}, {}, []
    for e, id_ in of.items():
        chain = [a for a in e.up() if a.tag not in ("body", "html")]
        for a in chain:
            order.setdefault(a, len(order))
            if by_id[id_]["text"]:
                texts.setdefault(a, []).append(by_id[id_]["text"])
        chains[id_] = chain
        if by_id[id_]["kind"] == "heading" and by_id[id_]["text"]:
            heads.append((e, by_id[id_]["text"]))
    names = {a: of.get(a) or f"anc_{n}" for a, n in order.items()}
    out = []
    for a, n in order.items():
        if a in of:
            continue
        home = next((x for x in a.up() if role_of(x)), None)
        inside = next((t for h, t in heads if a in h.up()), None)
        before = next((t for h, t in reversed(heads) if a not in h.up() and _place(h) < _place(a)), None)
        own = texts.get(a, [])
        anchors = {"text": own[0] if len(own) == 1 else None, "role": None, "href": None, "alt": None, "ariaLabel": None, "nearestHeading": inside or before, "landmark": role_of(a) or (role_of(home) if home else None), "ordinalInLandmark": None}
        out.append({"id": names[a], "tag": a.tag, "bbox": [0, 0, 0, 0], "depth": len(list(a.up())), "cssSelector": selector(a, home), "anchors": anchors})
    return {"ancestors": out, "chains": {k: [names[a] for a in v] for k, v in chains.items()}, "truncated": False, "droppedCount": 0}


def _place(e: Element) -> tuple[int, ...]:
    """Document order as a path of child numbers."""
    path, at = [], e
    while at.parent is not None:
        path.append(next(i for i, c in enumerate(at.parent.children) if c is at))
        at = at.parent
    return tuple(reversed(path))


def scanned(pages: DataFrame) -> DataFrame:
    """pages (..., url, html) with `page`, `styleCandidates` and `inventory` in place of html."""
    keep = [c for c in pages.columns if c != "html"]

    def run(batches):
        for batch in batches:
            urls, html = batch.column("url").to_pylist(), batch.column("html").to_pylist()
            found = [scan(h, u or "") for u, h in zip(urls, html)]
            texts = [pa.array([json.dumps(x[k], ensure_ascii=False) for x in found], pa.string()) for k in ("page", "ancestors", "inventory")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *texts], [*keep, "page", "styleCandidates", "inventory"])

    schema = pages.select(*keep, F.lit("").alias("page"), F.lit("").alias("styleCandidates"), F.lit("").alias("inventory")).schema
    out = pages.mapInArrow(run, schema)
    candidates = next(f.dataType for f in _schema().fields if f.name == "styleCandidates")
    parsed = {"page": F.from_json("page", PAGE), "styleCandidates": F.from_json("styleCandidates", candidates), "inventory": F.from_json("inventory", "headingCount int, imageCount int, landmarkCount int")}
    return out.withColumns(parsed)


def _schema():
    from pyspark.sql.types import StructType

    return StructType.fromDDL(BUNDLE)


def nodes(scans: DataFrame, *by: str | Column) -> DataFrame:
    """One row a node of scanned pages."""
    return scans.select(*by, F.explode("page.nodes").alias("x")).select(*by, "x.*")
