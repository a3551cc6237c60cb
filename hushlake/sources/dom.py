"""A page as one row: its controls with roles and names, labelled text, images,
frames, marked truth.

The parser builds a small tree of one page in Arrow batches; what follows from it
is a nested column, and relations are exploded from that.  Nothing that depends on
layout is guessed: sizes come from width and height attributes only.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushlake.operators.fields import role_of

from .html import BLOCKS, SKIPPED, VOID

#: Tags that name what follows, and containers of prose.
LABELS = {"dt", "th", "label", "strong", "b", "em", "span", "small", "dfn", "caption"}
NAMING = {"dt", "th", "label", "strong", "b"}
PROSE = {"p", "div", "section", "article", "li", "ul", "ol", "table", "form", "blockquote", "pre", "main", "nav"}
CONTROLS = {"input", "select", "textarea", "button", "summary"}
IMAGES = {"img", "canvas", "video", "svg"}
FRAMES = {"iframe", "frame", "embed", "object"}
LEAST_SIZE = 24

ELEMENT = (
    "struct<ord:int,tag:string,type:string,given_role:string,editable:boolean,name:string,placeholder:string,value:string,"
    "autocomplete:string,options:array<string>,group:string,checked:boolean,disabled:boolean,required:boolean>"
)
SNAPSHOT = (
    f"elements array<{ELEMENT}>, blocks array<struct<ord:int,tag:string,text:string,label:string,context:string>>, "
    "images array<struct<ord:int,tag:string,alt:string,class:string,src:string,width:double,height:double>>, "
    "frames array<struct<ord:int,tag:string,src:string,width:double,height:double>>, truth array<struct<ord:int,type:string,text:string>>"
)


class _Node:
    __slots__ = ("tag", "attrs", "up", "below", "place")

    def __init__(self, tag: str, attrs: dict, up: _Node | None):
        self.tag, self.attrs, self.up, self.below = tag, attrs, up, []
        self.place = 0

    def elements(self) -> list[_Node]:
        return [x for x in self.below if isinstance(x, _Node)]

    def text(self, without: frozenset[str] = frozenset()) -> str:
        """Text below, in order; an explicit stack, as pages nest deeply."""
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            elif x is self or (x.tag not in SKIPPED and x.tag not in without):
                stack.extend(reversed(x.below))
        return " ".join(" ".join(out).split())

    def before(self) -> _Node | None:
        if self.up is None:
            return None
        last = None
        for x in self.up.elements():
            if x is self:
                return last
            last = x
        return None

    def around(self, tag: str) -> _Node | None:
        x = self
        while x is not None and x.tag != tag:
            x = x.up
        return x


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("#page", {}, None)
        self.nodes: list[_Node] = []

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, {k: v if v is not None else "" for k, v in attrs}, self.at)
        self.at.below.append(node)
        self.nodes.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        x = self.at.around(tag)
        if x is not None and x.up is not None:
            self.at = x.up

    def handle_data(self, data):
        self.at.below.append(data)


def _size(attrs: dict, side: str) -> float | None:
    digits = attrs.get(side, "").strip().removesuffix("px")
    return float(digits) if digits.replace(".", "", 1).isdigit() else None


def _name(x: _Node, by_id: dict[str, _Node], labels: dict[str, list[_Node]]) -> str:
    """What a control is called: by reference, by its own words, by its label, by what
    it shows, by what stands before it."""
    a = x.attrs
    named = " ".join(t for i in a.get("aria-labelledby", "").split() if i in by_id and (t := by_id[i].text()))
    if named or (named := a.get("aria-label", "").strip()):
        return named
    parts = [n.text() for n in labels.get(a.get("id", ""), [])] if a.get("id") else []
    if (around := x.around("label")) is not None:
        parts.append(around.text(frozenset({"input", "select", "textarea"})))
    if named := " ".join(p for p in parts if p):
        return named
    if x.tag in ("input", "textarea") and a.get("placeholder"):
        return a["placeholder"]
    if x.tag == "input" and a.get("type", "").lower() in ("submit", "button", "reset") and a.get("value"):
        return a["value"]
    if named := a.get("title", "").strip():
        return named
    entry = x.tag in ("input", "textarea") or "contenteditable" in a or a.get("role") == "textbox"
    if not entry and (named := x.text()) and len(named) <= 200:
        return named
    last = x.before()
    if last is not None and last.tag not in CONTROLS and last.tag != "a" and (named := last.text()) and len(named) <= 80:
        return named
    return x.up.text()[:80] if x.up is not None else ""


def _is_label(x: _Node) -> bool:
    n = len(x.text())
    return 0 < n <= 60 and (x.tag in LABELS or (x.tag not in PROSE and n <= 40))


def _context(x: _Node) -> str:
    """Text beside a block that says what it is: the label before it, the head of its
    column."""
    parts = []
    if (last := x.before()) is not None and _is_label(last):
        parts.append(last.text())
    table = x.around("table")
    if x.tag in ("td", "th") and x.up is not None and table is not None:
        rows, head = [], None
        stack = [table]
        while stack:
            y = stack.pop()
            if y.tag == "tr":
                rows.append(y)
                if head is None and y.up is not None and y.up.tag == "thead":
                    head = y
            else:
                stack.extend(reversed(y.elements()))
        head = head or (rows[0] if rows else None)
        if head is not None and head is not x.up:
            column = next(k for k, y in enumerate(x.up.elements()) if y is x)
            cells = head.elements()
            parts.append(cells[column].text() if column < len(cells) else "")
    return " ".join(" ".join(parts).split())[:200]


def _paired(x: _Node) -> str | None:
    last = x.before()
    if x.tag in NAMING or last is None or last.tag not in NAMING:
        return None
    text = last.text()
    return text if text and len(text) <= 80 else None


def _hidden(x: _Node) -> bool:
    while x is not None:
        if x.tag in SKIPPED:
            return True
        x = x.up
    return False


def snapshot_of(html: str | None) -> tuple:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    seen = [x for x in tree.nodes if not _hidden(x)]
    by_id = {x.attrs["id"]: x for x in reversed(seen) if x.attrs.get("id")}
    labels: dict[str, list[_Node]] = {}
    for x in seen:
        if x.tag == "label" and x.attrs.get("for"):
            labels.setdefault(x.attrs["for"], []).append(x)
    elements, images, frames, truth = [], [], [], []
    for x in seen:
        a = x.attrs
        kind = a.get("type", "").lower()
        if x.tag in CONTROLS or (x.tag == "a" and "href" in a) or "contenteditable" in a or a.get("role"):
            if not (x.tag == "input" and kind == "hidden"):
                options = [o.text() for o in seen if o.tag == "option" and o.around("select") is x] if x.tag == "select" else None
                value = None if kind == "password" else a.get("value", x.text() if x.tag == "textarea" or "contenteditable" in a else "")
                elements.append(
                    (len(elements), x.tag, kind or None, a.get("role") or None, "contenteditable" in a, _name(x, by_id, labels), a.get("placeholder") or None,
                     value, a.get("autocomplete") or None, options, a.get("name") if kind == "radio" else None,
                     ("checked" in a) if kind in ("radio", "checkbox") else None, "disabled" in a, "required" in a)
                )
        w, h = _size(a, "width"), _size(a, "height")
        large = not ((w is not None and w < LEAST_SIZE) or (h is not None and h < LEAST_SIZE))
        if x.tag in IMAGES and large:
            images.append((len(images), x.tag, a.get("alt", ""), a.get("class", ""), a.get("src", ""), w, h))
        if x.tag in FRAMES and "srcdoc" not in a and large:
            frames.append((len(frames), x.tag, a.get("src") or a.get("data") or "", w, h))
        if a.get("data-pii"):
            truth.append((len(truth), a["data-pii"], x.text() or a.get("value", "")))
    return elements, _blocks(tree.root), images, frames, truth


def _blocks(root: _Node) -> list[tuple]:
    """Text under its nearest block, in order of the page."""
    pieces: dict[int, tuple[_Node, list[str]]] = {}
    stack: list[tuple[object, _Node]] = [(root, root)]
    while stack:
        x, block = stack.pop()
        if isinstance(x, str):
            if x.strip():
                pieces.setdefault(id(block), (block, []))[1].append(x)
        elif x.tag not in SKIPPED:
            inner = x if x.tag in BLOCKS else block
            stack.extend((y, inner) for y in reversed(x.below))
    out = []
    for block, texts in pieces.values():
        text = " ".join(" ".join(t.split()) for t in texts)
        out.append((len(out), "body" if block.tag == "#page" else block.tag, text, _paired(block), f"{block.text()[:300]} {_context(block)}".strip()))
    return out


def snapshots(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, elements, blocks, images, frames, truth): a row for each page.  A null
    page has empty arrays; a null key stays."""
    names = ["elements", "blocks", "images", "frames", "truth"]

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 64):
                part = frame.iloc[at : at + 64]
                done = pd.DataFrame([snapshot_of(h) for h in part[html]], columns=names)
                done.insert(0, "k", part[key].to_numpy())
                yield done

    kind = pages.schema[key].dataType
    done = pages.select(F.col(key).cast("string").alias(key), html).mapInPandas(rows, f"k string, {SNAPSHOT}")
    return done.select(F.col("k").cast(kind).alias(key), *names)


def controls_of(snaps: DataFrame, key: str = "page_id", most: int | None = None) -> DataFrame:
    """A row for each control, with its role; the first ``most`` of a page if given."""
    each = snaps.select(key, F.explode("elements").alias("e"))
    kept = each if most is None else each.where(F.col("e.ord") < most)
    e = F.col("e")
    return kept.select(key, role_of(e.tag, e.type, e.given_role, e.editable).alias("role"), "e.*")


def listed(snaps: DataFrame, column: str, key: str = "page_id") -> DataFrame:
    """A row for each of a page's ``blocks``, ``images``, ``frames`` or ``truth``."""
    return snaps.select(key, F.explode(column).alias("x")).select(key, "x.*")


def stable_ids(sightings: DataFrame, page: str, thing: str, order: str, most: int = 999) -> DataFrame:
    """(page, thing, id, epoch): numbers in order of first sight; beyond ``most`` a new
    epoch begins at one."""
    from pyspark.sql import Window

    firsts = sightings.groupBy(page, thing).agg(F.min(order).alias("__first"))
    n = F.row_number().over(Window.partitionBy(page).orderBy("__first", thing)) - 1
    return firsts.select(page, thing, (n % most + 1).alias("id"), F.floor(n / most).cast("int").alias("epoch"))
