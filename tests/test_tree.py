"""The page tree: hand-computed records, hostile markup, and the standard library's parser."""

import time
from html.parser import HTMLParser

import pytest

from rankloom.functions import html as H
from rankloom.functions import tree
from rankloom.operators import pages as PG

from conftest import SF001

LONG = "x" * 60


@pytest.mark.parametrize("markup,selector,texts", [
    ("<div><p>one<p>two</div>three", "p", ["onetwo", "two"]),                    # never closed: ends with its parent
    ("<p>a<b>b</p>c</b>d", "p", ["ab"]),
    ("<h1 class='x product-title y'>t</h1>", ".product-title", ["t"]),
    ("<h1 class=product-title>t</h1>", "h1.product-title", ["t"]),
    ("<i class='product-titles'>t</i>", ".product-title", []),
    ("<div class=product-title><span>a <b>b</b></span> c</div>", ".product-title", ["a b c"]),
    ("<a data-x>1</a><a data-x=2>2</a>", "a[data-x]", ["1", "2"]),
    ("<a data-x>1</a><a data-x='2'>2</a>", "[data-x=2]", ["2"]),
    ("<A HREF='u'>1</A>", "a[href=u]", ["1"]),
    ("<a title=\"it's\" b=it's>1</a>'<a>2</a>", "a", ["1", "2"]),
    ("</p></div><p>x</p></p>", "p", ["x"]),
    ("<br><p/>x</p><img src=x>y", "p", ["x"]),
    ("1 < 2 <3 <p>x &lt; &amp;y</p>", "p", ["x < &y"]),
])
def test_selected_texts(markup, selector, texts):
    page = tree.parse(markup)
    assert [page.text(e) for e in page.select(selector)] == texts


@pytest.mark.parametrize("markup,text", [
    ("a<script>b<p>c", "a"), ("a<script>b</script >c<style>d</style>e", "ace"), ("a<!-- b <p> -->c<!-- d", "ac"),
    ("<!DOCTYPE html>a<?x y?>b", "ab"), ("a<b title='x", "a"), ("a<script>if (a</b) '</scripts>'</SCRIPT>b", "ab"), ("", ""),
    ("a<p title=\"1 > 0\">b", "ab"), ("&eacute;&#233;&amp;lt;", "éé&lt;")])
def test_text_of_a_page(markup, text):
    assert tree.parse(markup).text() == text


@pytest.mark.parametrize("markup,name,description", [
    (f"<title>A - Site | B</title><p>{LONG}", "A", LONG),
    (f"<title>T</title><div class=product-title><b>N</b>ame</div><p>short<p>{LONG}</p>", "Name", "short" + LONG),
    ("<h1> </h1><title>T</title>", "", ""),
    ("<h1>H</h1><meta content='C' name='description'>", "H", "C"),
    (f"<h1>H</h1><meta name=description content=''><p>{LONG * 10}</p>", "H", (LONG * 10)[:500]),
    (f"<h1>H</h1><meta name=description><p>{LONG[:50]}</p><p>{LONG[:51]}</p>", "H", LONG[:51]),
])
def test_records_by_hand(markup, name, description):
    assert tree.parts(markup, " - Site")[:2] == (name, description)


@pytest.mark.parametrize("unit", ["<div>x", "<p>x", "<a ", "<script>x", "</b>", "<!--", "<a b=\"", "<b '", "<", "<i class=x>", "&"])
def test_hostile_pages_take_linear_time(unit):
    started = time.perf_counter()
    page = tree.parse(unit * (1_000_000 // len(unit)))
    list(page.select("p.x[y=z]"))
    page.text()
    assert time.perf_counter() - started < 8


class Texts(HTMLParser):
    """Text outside scripts and styles, the texts of paragraphs and the described meta, over the standard
    library's tokens."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.open, self.paragraphs, self.meta = [], [], [], None

    def handle_starttag(self, tag, attrs):
        if tag == "meta" and dict(attrs).get("name") == "description" and self.meta is None:
            self.meta = dict(attrs).get("content") or ""
        if tag not in tree.VOID:
            self.open.append((tag, []))
            if tag == "p":
                self.paragraphs.append(self.open[-1][1])

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not any(t in ("script", "style") for t, _ in self.open):
            self.out.append(data)
            for _, inside in self.open:
                inside.append(data)

    def description(self):
        texts = ["".join(x).strip() for x in self.paragraphs]
        return self.meta or next((t[:500] for t in texts if len(t) > 50), H.DEFAULT_DESCRIPTION)


def test_given_pages(spark):
    given = spark.read.parquet(f"{SF001}/pages.parquet")
    described = {}
    for r in given.collect():
        p = Texts()
        p.feed(r.html or "")
        p.close()
        assert tree.parse(r.html or "").text() == "".join(p.out)
        described[r.page_id] = p.description()
    # the records of the expression form, but for their paragraphs, which given pages never close
    columns = ["page_id", "url", "assessment_name", "duration_minutes", "test_type", "adaptive_support", "remote_support", "status"]
    got, want = PG.parsed_records(given), PG.page_records(given)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.select(columns).collect()), key=str) == sorted(map(tuple, want.select(columns).collect()), key=str)
    assert {r.page_id: r.description for r in got.collect()} == described


def test_pages_without_markup(spark):
    df = spark.createDataFrame([(1, "https://h/a-b", None), (2, "https://h/c", ""), (3, "https://h/d", "plain")],
                               "page_id long, url string, html string")
    assert {r.page_id: r.status for r in PG.parsed_records(df).collect()} == {1: "failed", 2: "failed", 3: "failed"}
    assert PG.parsed_text(df).count() == 3
