"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into blocks: runs of text between block-level tags, in page order. A block's
features are the tags and class, id and role names of its ancestors and the shape of its text
(length, share of link text, punctuation, place in the page, length of its neighbours). The CRF
gives every block the label main or boilerplate; Viterbi decodes the best sequence.

Training pages are a bounded, hash-chosen sample of the table's rows that mark their article
(``<article>`` or ``<main>``): each is labelled by that element, but for menus, forms, asides and
footers in it, and their text is set again
in LAYOUTS random layouts with known labels (menus, headers, footers, sidebars, notices,
adverts, forms and reader comments under many common names), so that the model does not depend
on one site's markup. Weights are learned by AdaGrad on the conditional log-likelihood, in one
task whose input is that sample. Extraction is one pass over whole pages.

Defined cases: a null or empty html has empty text; so has a page without text. Tags that are
cut off at the end of the page are dropped as markup. Scripts, styles and the head are never
text. Without any labelled page the sample is the layouts filled with a fixed sentence.
Repeated rows are extracted each; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.llm.shared import slices

SAMPLE_PAGES, LAYOUTS, EPOCHS, RATE, DECAY = 300, 900, 6, 0.3, 1e-4
MAIN, OTHER = 1, 0
#: Elements that mark an article in the table's pages, those in it that are no part of it, and the mark of layouts.
ARTICLE, ASIDE, MARKER = ("article", "main"), ("aside", "form", "nav", "footer"), "data-main"
PAGE_BLOCKS, PAGE_DEPTH = 20_000, 200_000       # of a page that is trained on; extraction has no such limit

HIDDEN = {"script", "style", "template", "noscript", "head", "iframe", "object", "svg", "canvas", "select", "textarea"}
RAW = {"script", "style", "textarea", "title"}        # their content is not markup
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd",
          "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
          "br", "wbr", "img", "input", "button"}
#: An element that opens ends an open element of these kinds, up to the nearest of the others.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
        "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"})}
#: Any other element that starts, or text, ends an open head.
OF_HEAD = {"title", "meta", "link", "base", "style", "script", "noscript", "template"}
_MARK = re.compile(r"<(?:!--|[!?]|/?[A-Za-z])")
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_NAME = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_TOKEN = re.compile(r"[a-z]+")


class Path:
    """An element with its ancestors, linked to its parent: equal paths of a page are one object. ``fresh`` are
    the features that no ancestor has, so a path's features are those of the elements up to the root."""
    __slots__ = ("parent", "tag", "names", "fresh", "children", "score")

    def __init__(self, parent: "Path | None", tag: str, names: tuple[str, ...], fresh: tuple[str, ...]):
        self.parent, self.tag, self.names, self.fresh = parent, tag, names, fresh
        self.children: dict[tuple, Path] = {}
        self.score: tuple[float, float] | None = None

    def up(self) -> Iterator["Path"]:
        """The element and its ancestors, innermost first, without the page itself."""
        at = self
        while at.parent is not None:
            yield at
            at = at.parent

    def elements(self) -> tuple[tuple[str, tuple[str, ...]], ...]:
        return tuple((p.tag, p.names) for p in self.up())[::-1]


class Block:
    """``article``: inside an article or main element and no menu, form, aside or footer of it; ``marked``: inside
    a ``data-main`` element, which is no part of the path."""
    __slots__ = ("text", "path", "linked", "chars", "article", "marked")

    def __init__(self, text: str, path: Path, linked: int, chars: int, article: bool, marked: bool):
        self.text, self.path, self.linked, self.chars, self.article, self.marked = text, path, linked, chars, article, marked


@lru_cache(4096)
def names_of(attributes: str) -> tuple[str, ...]:
    """Lower-case words of an element's class, id and role."""
    found = " ".join("".join(m) for m in _NAME.findall(attributes))
    return tuple(sorted(set(_TOKEN.findall(found.lower()))))


def blocks(page: str) -> list[Block]:
    """The text blocks of a page with their paths, in one pass: what is asked of the open elements is kept
    by name, so a step does not depend on how deep they are nested."""
    out: list[Block] = []
    stack: list[tuple[str, Path]] = []                # tag, and the path of blocks in it
    places: dict[str, list[int]] = {}                 # of the open elements of a name, outermost first
    held: dict[str, int] = {}                         # features of the open block elements
    root = Path(None, "", (), ())
    text: list[str] = []
    linked = hidden = 0

    def close() -> None:
        nonlocal linked
        whole = " ".join("".join(text).split())
        if whole:
            begun = min((places[t][0] for t in ARTICLE if places.get(t)), default=None)
            article = begun is not None and not any(places[t][-1] > begun for t in ASIDE if places.get(t))
            out.append(Block(whole, stack[-1][1] if stack else root, linked, len(whole), article, bool(places.get(MARKER))))
        text.clear()
        linked = 0

    def pop(to: int) -> None:
        nonlocal hidden
        if any(t not in INLINE for t, _ in stack[to:]):
            close()
        while len(stack) > to:
            tag, path = stack.pop()
            places[tag].pop()
            hidden -= tag in HIDDEN
            if tag not in INLINE and tag != MARKER:
                for f in path.fresh:
                    held[f] -= 1

    def push(tag: str, names: tuple[str, ...]) -> None:
        nonlocal hidden
        above = path = stack[-1][1] if stack else root
        if tag not in INLINE and tag != MARKER:
            path = above.children.get((tag, names))
            if path is None:
                own = ([] if tag in ("html", "body") else [f"tag {tag}"]) + [f"name {w}" for w in names]
                path = above.children[tag, names] = Path(above, tag, names, tuple(f for f in own if not held.get(f)))
            for f in path.fresh:
                held[f] = held.get(f, 0) + 1
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, path))
        hidden += tag in HIDDEN

    def last(tags) -> int:
        """Place of the innermost open element of ``tags``, -1 without one."""
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    def data(raw: str) -> None:
        nonlocal linked
        if stack and stack[-1][0] == "head" and raw.strip():
            pop(len(stack) - 1)
        if hidden or not raw:
            return
        piece = entities.unescape(raw) if "&" in raw else raw
        text.append(piece)
        if places.get("a"):
            linked += len(piece.strip())

    at, n = 0, len(page)
    while at < n:
        mark = _MARK.search(page, at)
        if not mark:
            data(page[at:])
            break
        data(page[at:mark.start()])
        begin = mark.start()
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            at = n if end < 0 else end + 3
            continue
        tag = _TAG.match(page, begin)
        if not tag:
            end = page.find(">", begin)
            at = n if end < 0 else end + 1
            continue
        at = tag.end()
        closing, name, attributes = tag[1], tag[2].lower(), tag[3]
        if closing:
            if places.get(name):
                pop(places[name][-1])
            elif name not in INLINE:
                close()
            continue
        if stack and stack[-1][0] == "head" and name not in OF_HEAD:
            pop(len(stack) - 1)
        if name == "br":
            data(" ")
            continue
        if name not in INLINE:
            if places.get("p"):                                # no block stands inside a paragraph
                pop(places["p"][-1])
            kinds, walls = ENDS.get(name, ((), ()))
            if kinds and last(kinds) > last(walls):
                pop(last(kinds))
            close()
        if name in VOID or attributes.endswith("/"):
            continue
        push(name, names_of(attributes) if "=" in attributes else ())
        if name in RAW:
            end = re.compile(f"</{name}", re.I).search(page, at)
            raw_end = end.start() if end else n
            data(page[at:raw_end])
            at = raw_end
    close()
    return out


def size_of(text: str) -> int:
    return min(9, int(math.log2(text.count(" ") + 1)))


def path_features(path: Path) -> list[str]:
    return [f for p in path.up() for f in p.fresh] + last_features(path)


def last_features(path: Path) -> list[str]:
    """The features of a path's last element that its ancestors have no part in."""
    return [f"parent {path.tag}", *(f"own {w}" for w in path.names)] if path.parent else []


def features(page: list[Block]) -> list[list[str]]:
    """The features of each block's text and place; those of its path stay with the path."""
    sizes = [size_of(b.text) for b in page]
    out = []
    for i, b in enumerate(page):
        last = b.text[-1]
        share = min(4, int(5 * b.linked / max(1, b.chars)))
        found = ["bias", f"size {sizes[i]}", f"links {share}", f"end {last if last in '.!?:,;|' else 'other'}",
                 f"before {sizes[i - 1] if i else 'none'}", f"after {sizes[i + 1] if i + 1 < len(page) else 'none'}",
                 f"place {10 * i // len(page)}", f"commas {min(3, b.text.count(','))}",
                 f"sentences {min(3, b.text.count('. '))}"]
        if "©" in b.text or "·" in b.text or " | " in b.text:
            found.append("rule sign")
        if i and page[i - 1].path is b.path:
            found.append("like before")
        out.append(found)
    return out


class Chain:
    """Weights of a two-label linear-chain CRF."""

    def __init__(self, weights: dict[str, list[float]], moves: list[list[float]]):
        self.weights, self.moves = weights, moves

    def total(self, found, a: float = 0.0, b: float = 0.0) -> tuple[float, float]:
        get = self.weights.get
        for f in found:
            w = get(f)
            if w:
                a += w[0]
                b += w[1]
        return a, b

    def of_path(self, path: Path) -> tuple[float, float]:
        """The scores of a path's elements: of each its parent's and its fresh features', added up once."""
        todo, at = [], path
        while at.score is None and at.parent is not None:
            todo.append(at)
            at = at.parent
        score = at.score or (0.0, 0.0)
        for p in reversed(todo):
            score = p.score = self.total(p.fresh, *score)
        return score

    def scores(self, page: list[Block]) -> list[tuple[float, float]]:
        last: dict[Path, list[str]] = {}
        return [self.total(found, *self.total(last.setdefault(b.path, last_features(b.path)), *self.of_path(b.path)))
                for b, found in zip(page, features(page), strict=True)]

    def decode(self, page: list[Block]) -> list[int]:
        return self.best(self.scores(page))

    def best(self, scores: list[tuple[float, float]]) -> list[int]:
        """The most likely label sequence (Viterbi); ties go to boilerplate."""
        if not scores:
            return []
        (oo, om), (mo, mm) = self.moves
        back = []
        other, main = scores[0]
        for a, b in scores[1:]:
            from_main = (main + mo > other + oo, main + mm > other + om)
            other, main = (a + (main + mo if from_main[0] else other + oo), b + (main + mm if from_main[1] else other + om))
            back.append(from_main)
        labels = [MAIN if main > other else OTHER]
        for step in reversed(back):
            labels.append(int(step[labels[-1]]))
        return labels[::-1]

    def dump(self) -> str:
        return json.dumps([self.weights, self.moves])

    @staticmethod
    def load(text: str) -> "Chain":
        return Chain(*json.loads(text))


def fit(pages: list[tuple[list[list[str]], list[int]]], seed: int = 7) -> Chain:
    """Maximum conditional likelihood with AdaGrad; one update for each page and epoch."""
    index = {f: i for i, f in enumerate(sorted({f for page, _ in pages for found in page for f in found}))}
    w, g = np.zeros((len(index), 2)), np.full((len(index), 2), 1e-6)
    t, tg = np.zeros((2, 2)), np.full((2, 2), 1e-6)
    data = [(np.array([index[f] for found in page for f in found]), np.cumsum([0] + [len(x) for x in page]),
             np.array(labels)) for page, labels in pages if page]
    rng = random.Random(seed)
    for _ in range(EPOCHS):
        rng.shuffle(data)
        for ids, cuts, labels in data:
            n = len(labels)
            emit = np.add.reduceat(w[ids], cuts[:-1], axis=0)
            forward, backward = np.empty((n, 2)), np.zeros((n, 2))
            forward[0] = emit[0]
            for i in range(1, n):
                forward[i] = emit[i] + np.logaddexp(forward[i - 1, 0] + t[0], forward[i - 1, 1] + t[1])
            for i in range(n - 2, -1, -1):
                ahead = emit[i + 1] + backward[i + 1]
                backward[i] = np.logaddexp(t[:, 0] + ahead[0], t[:, 1] + ahead[1])
            z = np.logaddexp(*forward[-1])
            wrong = np.exp(forward + backward - z)
            wrong[np.arange(n), labels] -= 1
            grad = np.zeros_like(w)
            np.add.at(grad, ids, np.repeat(wrong, np.diff(cuts), axis=0))
            seen = np.unique(ids)
            grad = grad[seen] + DECAY * w[seen]
            g[seen] += grad ** 2
            w[seen] -= RATE * grad / np.sqrt(g[seen])
            if n > 1:
                pair = np.exp(forward[:-1, :, None] + t + (emit + backward)[1:, None, :] - z).sum(axis=0)
                np.add.at(pair, (labels[:-1], labels[1:]), -1)
                pair += DECAY * t
                tg += pair ** 2
                t -= RATE * pair / np.sqrt(tg)
    return Chain({f: w[i].tolist() for f, i in index.items() if abs(w[i]).max() > 1e-4}, t.tolist())


# Layouts of labelled pages: common element and class names of each kind of block.
MAIN_NAMES = ["article", "article", "main", "div content", "div post", "div entry content", "div article body", "div story",
              "section text", "div page content", "div post content", "div", "section", "td", "div main", "div body copy"]
OTHER_NAMES = {
    "menu": ["nav", "ul menu", "div navigation", "div nav", "ul navbar", "div breadcrumb", "ul tabs", "div pagination",
             "div main menu", "div toc"],
    "header": ["header", "div header", "div masthead", "div topbar", "div site header", "div branding", "div logo"],
    "footer": ["footer", "div footer", "div copyright", "div bottom", "div site footer", "div legal", "div imprint"],
    "sidebar": ["aside", "div sidebar", "div widget", "div related", "div recommended", "div popular", "div more stories",
                "td sidebar", "section related", "div trending", "div teaser", "div side"],
    "notice": ["div cookie notice", "div notice", "div banner", "div consent", "div alert", "div gdpr", "div popup",
               "div paywall", "div modal", "div message", "div disclaimer"],
    "advert": ["div ad", "div ads", "div advert", "div advertisement", "div sponsored", "div promo", "aside ad",
               "div promotion", "section sponsor", "ins adsbygoogle", "div commercial"],
    "form": ["form", "div newsletter", "form subscribe", "form search", "div login", "form contact", "div signup", "fieldset"],
    "comments": ["section comments", "div comments", "ol comment list", "div comment", "div replies", "div discussion",
                 "div responses", "section reviews", "div reader comments", "ul comments"],
    "share": ["div share", "ul social", "div tags", "div byline", "div meta", "div author"],
}
FILLER = "This is a plain sentence, and here is another one. It has words enough for a paragraph."


def layout(paragraphs: list[str], words: list[str], rng: random.Random) -> str:
    """A page with an article's paragraphs in a random layout; a ``data-main`` element marks each
    main block."""
    def some(low: int, high: int) -> str:
        text = " ".join(rng.choice(words) for _ in range(rng.randint(low, high)))
        return entities.escape(text[:1].upper() + text[1:])

    def sentences(low: int, high: int) -> str:
        return " ".join(some(3, 14).rstrip(".") + "." for _ in range(rng.randint(low, high)))

    def wrap(spec: str, inner: str) -> str:
        tag, *names = spec.split()
        named = ""
        if names:
            joined = rng.choice(["-", "_", " "]).join(names)
            named = f' {rng.choice(["class", "id"])}="{joined}"'
        return f"<{tag}{named}>{inner}</{tag}>"

    link = lambda text: f'<a href="/{rng.randint(1, 999)}">{text}</a>'
    item = lambda text: f"<li>{text}</li>"
    lists = lambda n: "<ul>" + "".join(item(link(some(1, 4))) for _ in range(n)) + "</ul>"

    def heading(most: int) -> str:
        level = rng.choice(["h2", "h3", "h3", "h4"])
        return f"<{level}>{some(1, most)}</{level}>"

    def boilerplate(kind: str) -> str:
        if kind == "menu":
            inner = lists(rng.randint(2, 9)) if rng.random() < 0.7 else " | ".join(link(some(1, 2)) for _ in range(4))
        elif kind == "header":
            inner = rng.choice([f"<h1>{some(1, 3)}</h1>", f"<p>{some(1, 4)}</p>", link(some(1, 3))]) + f"<p>{some(3, 8)}</p>"
        elif kind == "footer":
            inner = f"&copy; {some(1, 4)} &middot; {some(1, 6)}" if rng.random() < 0.6 else f"<p>{sentences(1, 2)}</p>{lists(3)}"
        elif kind == "sidebar":
            inner = heading(4) + rng.choice([lists(rng.randint(2, 6)), f"<p>{sentences(1, 3)}</p>",
                                                           "".join(f"<p>{link(some(4, 10))}</p>" for _ in range(3))])
        elif kind == "notice":
            inner = f"<p>{sentences(1, 3)}</p>" + rng.choice(["", "<button>OK</button>", link(some(1, 3))])
        elif kind == "advert":
            inner = rng.choice([sentences(1, 3), f"<p>{sentences(1, 2)}</p>", link(some(3, 9)), f"<h4>{some(2, 5)}</h4>" + sentences(1, 2)])
        elif kind == "form":
            inner = f"<label>{some(1, 4)}</label><input name=q><p>{some(3, 12)}</p><button>{some(1, 2)}</button>"
        elif kind == "comments":
            one = lambda: wrap(rng.choice(["li comment", "div comment", "div reply", "div"]),
                               f"<p>{some(1, 2)}</p><p>{sentences(1, 4)}</p>")
            inner = heading(3) + "".join(one() for _ in range(rng.randint(1, 5)))
        else:
            inner = "".join(f"<span>{some(1, 2)}</span> " for _ in range(rng.randint(1, 4)))
        return wrap(rng.choice(OTHER_NAMES[kind]), inner)

    def figures() -> str:
        """A table, list of terms or listing, as articles have them."""
        number = lambda: f"{rng.randint(1, 99)},{rng.randint(100, 999)}" if rng.random() < 0.5 else some(1, 4)
        kind = rng.random()
        if kind < 0.6:
            head = rng.choice(["td", "th"])
            row = lambda: f"<tr><{head}>{some(1, 3)}</{head}>" + "".join(f"<td>{number()}</td>" for _ in range(wide)) + "</tr>"
            wide = rng.randint(1, 3)
            return f"<table{rng.choice(['', ' class=infobox', ' class=data'])}>" + "".join(row() for _ in range(rng.randint(1, 6))) + "</table>"
        if kind < 0.8:
            return "<dl>" + "".join(f"<dt>{some(1, 3)}</dt><dd>{some(2, 12)}</dd>" for _ in range(rng.randint(1, 4))) + "</dl>"
        return "<pre>" + "\n".join(f"{some(1, 2)} = {number()}" for _ in range(rng.randint(1, 5))) + "</pre>"

    body = []
    if rng.random() < 0.8:
        level = rng.choice(["h1", "h1", "h2", "p"])
        body.append(f"<{level}>{some(rng.choice([1, 2]), 10)}</{level}>")
    if rng.random() < 0.15:
        body.append(figures())
    for p in paragraphs:
        kind = rng.random()
        text = entities.escape(p)
        if kind < 0.08:
            body.append(f"<h2>{some(1, 6)}</h2>")
        if kind < 0.06:
            body.append("<ul>" + "".join(item(some(3, 12)) for _ in range(rng.randint(2, 4))) + "</ul>")
        if 0.06 < kind < 0.12:
            body.append(figures())
        if kind > 0.93:
            body.append(f"<blockquote>{text}</blockquote>")
        else:
            body.append(f"<p>{text}</p>")
    marked = [f"<data-main>{b}</data-main>" for b in body]
    for kind in ("advert", "share", "notice", "form", "sidebar"):
        if rng.random() < 0.15:                          # between the paragraphs
            marked.insert(rng.randint(0, len(marked)), boilerplate(kind))
    inner = "".join(marked)
    if rng.random() < 0.2:
        inner += boilerplate("comments")
    main = wrap(rng.choice(MAIN_NAMES), inner)
    before = [boilerplate(k) for k in ("notice", "header", "menu", "advert", "menu", "form") if rng.random() < 0.5]
    after = [boilerplate(k) for k in ("share", "sidebar", "advert", "comments", "form", "notice", "menu", "footer")
             if rng.random() < 0.5]
    if rng.random() < 0.15:
        before.append(boilerplate("sidebar"))
    return "<html><body>" + "".join(before) + main + "".join(after) + "</body></html>"


def labelled(found: list[Block], labels: list[bool]) -> tuple[list[list[str]], list[int]]:
    """Features, those of the paths included, and labels of a training page."""
    of_path: dict[Path, list[str]] = {}
    for b in found:
        of_path.setdefault(b.path, path_features(b.path))
    return [f + of_path[b.path] for f, b in zip(features(found), found, strict=True)], [MAIN if x else OTHER for x in labels]


def train_on(pages: list[str], layouts: int = LAYOUTS, seed: int = 7) -> Chain:
    rng, data = random.Random(seed), []
    articles = []
    for page in pages:
        found = blocks(page)
        # a page of very deep elements says no more than others, and its features would be very many
        deep = sum(sum(1 for _ in p.up()) for p in {b.path for b in found}) if len(found) < PAGE_BLOCKS else PAGE_DEPTH + 1
        if any(b.article for b in found) and deep <= PAGE_DEPTH:
            data.append(labelled(found, [b.article for b in found]))
            articles.append([b.text for b in found if b.article])
    articles = articles or [[FILLER] * 5] * 20
    words = sorted({w for a in articles for p in a for w in p.split()[:200]})
    for n in range(layouts):
        article = articles[n % len(articles)]
        most = rng.choice([15, 60, 60, 250, 5000])              # words of a paragraph
        paragraphs = [" ".join(p.split()[i:i + most]) for p in article for i in range(0, len(p.split()), most)]
        found = blocks(layout(paragraphs[:rng.choice([1, 2, 4, 8, 24, 24])], words, rng))
        data.append(labelled(found, [b.marked for b in found]))
    return fit(data, seed)


def train(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> Chain:
    """A model from at most about ``sample_pages`` rows, chosen by the hash of their html."""
    marked = pages.select(F.col("html").cast("string").alias("html")).filter(F.col("html").rlike("(?i)<(article|main)[ >]"))
    n = marked.count()
    share = min(1.0, sample_pages / n) if n else 1.0
    sample = marked.filter(F.pmod(F.xxhash64("html", F.lit("crf")), F.lit(1 << 30)) < share * (1 << 30)).limit(2 * sample_pages)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"model": [train_on(sorted(pdf["html"])).dump()]})

    first = sample.withColumn("job", F.lit(0)).groupBy("job").applyInPandas(run, "model string").first()
    return Chain.load(first["model"]) if first else train_on([])


def main_text(page: str | None, model: Chain) -> str:
    found = blocks(page or "")
    return "\n\n".join(b.text for b, label in zip(found, model.decode(found), strict=True) if label == MAIN)


def extract(pages: DataFrame, model: Chain) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``."""
    shared = pages.sparkSession.sparkContext.broadcast(model.dump())
    source = pages.select("page_id", "url", F.col("html").cast("string").alias("__html"))
    schema = T.StructType([source.schema["page_id"], source.schema["url"], T.StructField("text", T.StringType()),
                           T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = Chain.load(shared.value)
        for s in slices(batches, "__html"):
            texts = [main_text(h, chain) for h in s.column("__html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [s.column("page_id"), s.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(x) for x in texts], pa.int64())], schema.names)

    return source.mapInArrow(run, schema)
