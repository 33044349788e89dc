import html
import itertools
import random
import re

import numpy as np
import pytest

from rankloom.llm import htmlcrf as H

FOREIGN = """<html><head><title>T</title><style>p{}</style></head><body>
<div id="cookie-banner"><p>We use cookies to improve your visit. <a href=x>More</a></p></div>
<header><h1>My Site</h1><p>The best site</p></header><nav><ul><li><a href=/>Home</a><li><a href=/b>About us</a></ul></nav>
<div class="layout"><div class="post-content"><h1>Real title here</h1>
<p>First paragraph of the article, which has a number of words &amp; a <a href=z>link</a> in it.</p>
<p>Second   paragraph&nbsp;goes
 on here with more words. It has two sentences.</p><div class="advert">Buy now! Great deals await you.</div>
<p>Third paragraph, after the advert. Also of some length, so it counts.</p></div>
<aside class="sidebar"><h3>Related</h3><ul><li><a href=1>Other story</a></ul></aside></div>
<section id="comments"><h2>Comments</h2><div class="comment"><p>Bob</p><p>I liked this very much. Thank you for it.</p></div>
</section><form class="newsletter"><p>Subscribe to our newsletter</p><input><button>Go</button></form>
<footer>&copy; 2020 My Site</footer><script>var x="</p>";</script></body></html>"""


@pytest.fixture(scope="module")
def model(table):
    return H.train(table("pages"))


def expected(page):
    """The given pages' article, by its element."""
    inside = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
    return "\n\n".join(x for x in parts if x)


def test_blocks_of_odd_markup():
    page = ("<!-- <p>no</p> --><p>a<b>b</p>c<p>d &lt;e&gt; &#233;&amp;amp; 1 < 2<br>f<li>g<li>h<script>'</p>'</script>"
            "<td title=\"a > b\">i</td></x>&copy j<p cl")
    assert [b.text for b in H.blocks(page)] == ["ab", "c", "d <e> é&amp; 1 < 2 f", "g", "h", "i", "© j"]


def test_blocks_of_nothing():
    assert H.blocks("") == [] and H.blocks("<p> </p><!-- x") == [] and H.blocks("<script>x") == []


def test_paths_hold_block_ancestors_and_names():
    page = H.blocks('<div class="a-1 Main_x" id=q><a href=u><p>t</p></a></div>')
    assert page[0].path.elements() == (("div", ("a", "main", "q", "x")), ("p", ())) and page[0].linked == 1


def test_viterbi_is_the_best_of_all_sequences():
    rng = random.Random(3)
    for _ in range(30):
        chain = H.Chain({f"f{i}": [rng.uniform(-2, 2), rng.uniform(-2, 2)] for i in range(5)},
                        [[rng.uniform(-1, 1) for _ in range(2)] for _ in range(2)])
        page = [[f"f{rng.randrange(5)}", f"f{rng.randrange(6)}"] for _ in range(rng.randint(1, 7))]
        emit = [chain.total(found) for found in page]

        def value(labels):
            return sum(emit[i][x] for i, x in enumerate(labels)) + sum(chain.moves[a][b] for a, b in itertools.pairwise(labels))

        best = max(itertools.product((0, 1), repeat=len(page)), key=value)
        assert np.isclose(value(chain.best(emit)), value(best))


def test_given_pages_are_extracted_whole(table, model):
    pages = table("pages")
    want = {r.page_id: expected(r.html) for r in pages.select("page_id", "html").collect()}
    got = H.extract(pages, model).collect()
    assert len(got) == len(want)
    assert all(r.text == want[r.page_id] and r.n_chars == len(r.text) for r in got)


def test_other_layouts(model):
    words = "some words of a story that is told here and there".split()
    rng, right, total = random.Random(12), 0, 0
    for _ in range(100):
        paragraphs = [" ".join(rng.choice(words) for _ in range(rng.randint(8, 40))) + "." for _ in range(rng.randint(3, 12))]
        found = H.blocks(H.layout(paragraphs, words, rng))
        labels = [int(b.marked) for b in found]
        right += sum(a == b for a, b in zip(model.decode(found), labels, strict=True))
        total += len(labels)
    assert right / total > 0.95


def test_a_foreign_page(model):
    assert H.main_text(FOREIGN, model).split("\n\n") == [
        "Real title here", "First paragraph of the article, which has a number of words & a link in it.",
        "Second paragraph goes on here with more words. It has two sentences.",
        "Third paragraph, after the advert. Also of some length, so it counts."]


def test_defined_cases(spark, model):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>"), (3, "u", "<article><p>" + "word &amp; " * 40000 + "</p></article>"),
            (3, "u", "x"), (4, "u", "<" * 3000 + "p")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr(
        "*", "'own' as text", "1 as n_chars", "'own' as model")
    got = H.extract(pages, model).collect()
    assert [r.page_id for r in got] == [r[0] for r in rows]
    assert [r.text for r in got[:3]] == ["", "", ""] and got[3].n_chars == 40000 * 7 - 1
    assert H.extract(pages.limit(0), model).collect() == []
    assert H.train(pages.limit(0)).decode([]) == []


def test_a_head_that_is_not_closed_ends_at_the_first_tag_or_text_of_the_body():
    head = "<html><head><meta charset=x><title>T</title><style>p{}</style><noscript><img src=u></noscript>\n<link href=v>"
    for body, want in (("<article><p>One.</p><p>Two.</p></article>", ["One.", "Two."]), ("<p>One.<p>Two.", ["One.", "Two."]),
                       ("<b>One</b> two", ["One two"]), ("One <i>two", ["One two"]), ("<br>One", ["One"]),
                       ("</head><body><p>One.</p>", ["One."]), ("<body><p>One.</p>", ["One."])):
        assert [b.text for b in H.blocks(head + body)] == want, body


def test_a_page_without_a_body_tag_is_extracted(model):
    page = FOREIGN.replace("</head><body>", "").replace("</body>", "")
    assert H.main_text(page, model) == H.main_text(FOREIGN, model) != ""


@pytest.mark.parametrize("unit", ["<div>x", "<p>x<b>", "<a class=q>x", "<li>x<ul>", "</p>x", "<td>x<table>", "<script>x", "<!--"])
def test_deep_and_hostile_pages_take_linear_time_and_memory(model, unit):
    import time
    import tracemalloc
    page = unit * (300_000 // len(unit))
    started = time.perf_counter()
    H.main_text(page, model)
    assert time.perf_counter() - started < 10
    tracemalloc.start()
    H.blocks(page)
    assert tracemalloc.get_traced_memory()[1] < 120 << 20
    tracemalloc.stop()


def test_a_path_scores_what_its_features_add_up_to(model, table):
    for r in table("pages").select("html").limit(20).collect():
        found = H.blocks(r.html)
        for b, score in zip(found, model.scores(found), strict=True):
            i = found.index(b)
            assert np.allclose(score, model.total(H.features(found)[i] + H.path_features(b.path)))
            assert len(set(H.path_features(b.path))) == len(H.path_features(b.path))


def test_menus_and_forms_inside_a_marked_article_are_not_learned_as_main():
    page = H.blocks("<article><p>text</p><nav><p>menu</p></nav><form><p>field</p></form><aside>side</aside><p>more</p></article><p>out")
    assert [(b.text, b.article) for b in page] == [("text", True), ("menu", False), ("field", False), ("side", False), ("more", True), ("out", False)]


LONG = "The town lies by a river, and its history is long. It was first named in an old book, which is lost."
PARTS = {"heading": "<h2>Notes</h2>", "title": "<h1>Short</h1>", "list": "<ul><li>one thing</li><li>another thing</li></ul>",
         "table": "<table><tr><td>Population</td><td>12,000</td></tr><tr><td>Area</td><td>40 km</td></tr></table>",
         "terms": "<dl><dt>river</dt><dd>the water by the town</dd></dl>", "listing": "<pre>x = 1, y = 2</pre>"}


def test_short_parts_of_articles_under_untagged_containers(model):
    """Block recall and precision with a short part at the start, middle and end of an article."""
    found = wanted = right = 0
    for part in PARTS.values():
        for at in range(3):
            inner = [f"<p>{LONG}</p>"] * 2
            inner.insert(at, part)
            page = ("<html><body><div id=m><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></div>"
                    f"<div id=c>{''.join(inner)}</div><div id=f>&copy; 2020 The Site</div></body></html>")
            want = [b.text for b in H.blocks("".join(inner))]
            got = H.main_text(page, model).split("\n\n")
            found, wanted, right = found + len(got), wanted + len(want), right + len([x for x in want if x in got])
    assert right / wanted > 0.9 and right / found > 0.9, (found, wanted, right)


def test_given_pages_with_their_article_tags_renamed(table, model):
    pages = [r.html for r in table("pages").select("html").collect()]
    want = right = found = 0
    for page in pages:
        texts = [b.text for b in H.blocks(page) if b.article]
        got = H.main_text(re.sub(r"<article[^>]*>", "<div id=c>", page).replace("</article>", "</div>"), model).split("\n\n")
        want, found, right = want + len(texts), found + len(got), right + len([x for x in texts if x in got])
    assert right / want > 0.98 and right / found > 0.98
