"""Requests made of conversation turns."""

from rankloom.sources.tables import requests_of


def test_a_repeated_page_doubles_no_request(spark):
    turns = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "u"), (2, 0, "system", "t")],
                                  "conv_id long, turn long, role string, text string")
    pages = spark.createDataFrame([(1, "https://h/b"), (1, "https://h/a"), (1, None)], "page_id long, url string")
    got = {r.request_id: (r.query, r.jd_url) for r in requests_of(turns, pages).collect()}
    assert requests_of(turns, pages).count() == 3
    assert got == {"1-0": (None, "https://h/a"), "1-1": ("u", None), "2-0": (None, "https://missing.example.com/2")}
