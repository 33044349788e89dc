"""Hand-computed results for the text, markup and link operators."""

import pytest
from pyspark.sql import functions as F

from rankloom.functions import html as H
from rankloom.functions.text import display_score, html_to_text, keyword_text, rich_text, slug_name, title_case
from rankloom.operators.pages import head_sample, page_links


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("text,expected", [
    ("25#top", "25#Top"), ("ACCOUNT manager", "Account Manager"), ("bob's 3d-view", "Bob'S 3D-View"),
    ("élan vital", "Élan Vital"), ("ß x", "Ss X"), ("a_b", "A_B"), ("", ""), ("%28v2%29", "%28V2%29"),
])
def test_title_case(spark, text, expected):
    assert one(spark, title_case, text) == expected


def test_slug_name_after_digits_and_signs(spark):
    assert one(spark, slug_name, "http://m.example.net/en/25#top") == "25#Top"
    assert one(spark, slug_name, "https://h/view/java-8-(new)/") == "Java 8 (New)"


@pytest.mark.parametrize("markup,expected", [
    ("<p>&copy; a &middot; b &eacute;&#233;&#xE9; &amp;lt; &hellip;&nbsp;x</p>", "© a · b ééé &lt; …\xa0x"),
    ("a &copy b &ampc &unknown; &#0; d", "a © b &c &unknown; � d"),
    ("<script>'&copy;</p>'</script><style>p{}</style>x<!-- &amp; -->y", "xy"),
])
def test_character_references(spark, markup, expected):
    assert one(spark, html_to_text, markup) == expected


@pytest.mark.parametrize("markup,expected", [
    ('<meta name="description" content="a &amp; b">', "a & b"),
    ("<meta content='single' name='description'>", "single"),
    ("<META CONTENT=bare NAME=description />", "bare"),
    ('<meta name="x" content="no"><meta property="description" content="no"><meta data-name="description" content="no">',
     H.DEFAULT_DESCRIPTION),
    ('<meta name="description"><p>' + "long text " * 9 + "&copy;</p>", "long text " * 9 + "©"),
])
def test_description(spark, markup, expected):
    assert one(spark, H.record_description, markup) == expected


def test_links_of_every_form(spark):
    page = """<link href="/style.css"><a href="/one">1</a><a class=x href='/two?a=1&amp;b=2'>2</a><a title="a > b" href=/three>3</a>
        <A HREF="https://o.example.org/four#f">4</A><a href="../five/./six">5</a><a href="sub/seven">6</a><a href="?q=/8">7</a>
        <a href="#/nine">8</a><a name="/no">9</a><a data-href="/no">10</a><abbr href="/no">11</abbr><!-- <a href="/no"> -->
        <script>"<a href='/no'>"</script><a href="mailto:a/b@c">12</a><a href="plain">13</a><a href="/one">again</a>"""
    df = spark.createDataFrame([(1, "https://h.example.com/a/b/c?x=1", page)], "page_id long, url string, html string")
    got = sorted(r.url for r in page_links(df).collect())
    base = "https://h.example.com"
    assert got == sorted([f"{base}/one", f"{base}/two?a=1&b=2", f"{base}/three", "https://o.example.org/four#f",
                          f"{base}/a/five/six", f"{base}/a/b/sub/seven", f"{base}/a/b/c?q=/8", f"{base}/a/b/c?x=1#/nine",
                          "mailto:a/b@c"])


def test_absent_fields_have_defaults(spark):
    df = spark.createDataFrame([(None,)], "n string").select(F.col("n").alias("d"), "n", F.col("n").cast("int").alias("m"))
    assert df.select(keyword_text("n", "d", "n").alias("t")).first().t == "  "
    text = df.select(rich_text("n", "d", "n", "m", "n", "n").alias("t")).first().t
    assert text == ("Assessment Name: \nTitle: \nDescription: \nType: N/A\nCategory: N/A\nDuration: N/A minutes\n"
                    "Remote Testing Support: No\nAdaptive Assessment (IRT): No\nKeywords: , N/A, talent assessment, product catalog")


def test_scores_are_rounded_on_their_binary_value(spark):
    df = spark.createDataFrame([(0.5405,), (0.3505,), (2.0,), (None,)], "x double")
    assert [r.t for r in df.select(display_score("x").alias("t")).collect()] == ["0.540", "0.350", "2.000", None]


@pytest.mark.parametrize("n", [0, 51])
def test_sample_size_is_checked(spark, n):
    with pytest.raises(ValueError):
        head_sample(spark.range(3), n, "id")
