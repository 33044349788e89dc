"""A page as a tree: a one-pass builder, and first or all elements that a selector matches
(SURVEY A2, B4, B5, B18).

The builder reads markup once, left to right. An end tag closes the innermost open element of its
name and all inside it; one without such an element is ignored. An element without an end tag ends with
its parent, so a paragraph that is never closed holds what follows it there. Scripts and styles end at
their own end tag only, or at the end of the page, and are no text; comments, declarations and a tag that
the page's end cuts off are nothing. Text is kept as a list of pieces in page order and an element
as the pieces between its start and end, so no path is stored and time and memory are linear in the page,
however deep it is nested.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements without content, and those whose content is no markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style"))

_START = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""[\s/]*+([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+""")
_CLOSE = re.compile(r"[\s/=]*+>")
_SELECTOR = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:\.[\w-]+)*)((?:\[[^\]]+\])*)$")
_TEST = re.compile(r"""\[\s*([\w-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\]\s]*)))?\s*\]""")


@dataclass
class Element:
    name: str
    attributes: dict[str, str]
    begin: int                  # text pieces before it
    end: int = -1               # text pieces when it ended


@dataclass
class Page:
    elements: list[Element] = field(default_factory=list)
    pieces: list[str] = field(default_factory=list)

    def text(self, of: Element | None = None) -> str:
        return "".join(self.pieces if of is None else self.pieces[of.begin:of.end])

    def select(self, selector: str):
        """The elements that match ``name.class[attribute=value]`` (each part may be left out), in page
        order."""
        found = _SELECTOR.match(selector)
        if not found or not selector:
            raise ValueError(f"not a selector of one element: {selector}")
        name, classes, tests = found.groups()
        name, classes = (name or "*").lower(), set(classes.split(".")[1:])
        wanted = [(m[0].lower(), m[1] or m[2] or m[3], "=" in t) for t in re.findall(r"\[[^\]]+\]", tests) for m in _TEST.findall(t)]
        for e in self.elements:
            if name not in ("*", e.name) or not classes <= set(e.attributes.get("class", "").split() if classes else ()):
                continue
            if all(a in e.attributes and (not valued or e.attributes[a] == value) for a, value, valued in wanted):
                yield e

    def first(self, selector: str) -> Element | None:
        return next(self.select(selector), None)


def parse(markup: str) -> Page:
    page, at, size = Page(), 0, len(markup)
    stack: list[Element] = []
    open_: dict[str, int] = {}

    def close(name: str) -> None:
        while True:
            e = stack.pop()
            e.end = len(page.pieces)
            open_[e.name] -= 1
            if e.name == name:
                return

    while at < size:
        start = _START.search(markup, at)
        if start is None:
            page.pieces.append(entities.unescape(markup[at:]))
            break
        if start.start() > at:
            page.pieces.append(entities.unescape(markup[at:start.start()]))
        at = start.start()
        if markup.startswith("<!--", at):
            at = _after(markup, "-->", at + 4)
            continue
        if markup[at + 1] in "!?":
            at = _after(markup, ">", at)
            continue
        ends = markup[at + 1] == "/"
        found = _NAME.match(markup, at + 1 + ends)
        name, at = found.group().lower(), found.end()
        attributes: dict[str, str] = {}
        while True:
            shut = _CLOSE.match(markup, at)
            if shut:
                break
            one = _ATTRIBUTE.match(markup, at)
            if one is None or one.end() == at:
                break
            at = one.end()
            value = one.group(2) or ""
            if value[:1] in ("'", '"') and value:
                value = value[1:-1]
            attributes[one.group(1).lower()] = entities.unescape(value)      # of a repeated attribute the last
        if shut is None:
            break                                   # the page ends inside the tag
        at = shut.end()
        if ends:
            if open_.get(name):
                close(name)
            continue
        e = Element(name, attributes, len(page.pieces))
        page.elements.append(e)
        if name in VOID:
            e.end = e.begin
        elif name in RAW:
            e.end = e.begin
            shut = re.compile(rf"</{name}(?=[\s/>])", re.I).search(markup, at)
            if shut is None:
                break                               # never closed: the rest is its content
            at = _after(markup, ">", shut.end())
        else:
            stack.append(e)
            open_[name] = open_.get(name, 0) + 1
    for e in stack:
        e.end = len(page.pieces)
    return page


def _after(markup: str, mark: str, at: int) -> int:
    found = markup.find(mark, at)
    return len(markup) if found < 0 else found + len(mark)


# Where a record's name and description are, and their limits.
NAME_SELECTORS = ("h1", ".product-title", "title")
DESCRIPTION_SELECTOR = 'meta[name="description"]'
LEAST_PARAGRAPH, DESCRIPTION_CHARS = 50, 500


def parts(markup: str | None, title_suffix: str | None = None) -> tuple[str, str, str]:
    """(name, description, text) of a page; empty where it has none."""
    page = parse(markup or "")
    name = ""
    for selector in NAME_SELECTORS:
        e = page.first(selector)
        if e is not None:
            name = page.text(e).strip()
            if selector == "title":
                name = name.split("|")[0].strip()
                name = name.replace(title_suffix, "").strip() if title_suffix else name
            break
    meta = page.first(DESCRIPTION_SELECTOR)
    described = meta.attributes.get("content", "") if meta is not None else ""
    if not described:
        texts = (page.text(p).strip() for p in page.select("p"))
        described = next((t[:DESCRIPTION_CHARS] for t in texts if len(t) > LEAST_PARAGRAPH), "")
    return name, described, page.text()


def page_parts(html, title_suffix: str | None = None) -> Column:
    """struct(name, description, text) of each page, an Arrow batch of pages at a time."""
    @F.pandas_udf("name string, description string, text string")
    def run(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parts(p, title_suffix) for p in pages], columns=["name", "description", "text"])

    return run(F.col(html) if isinstance(html, str) else html)
