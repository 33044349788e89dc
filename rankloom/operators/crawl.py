"""The crawl as an iteration over listing pages.

A listing type's pages are read in order until ``empties`` pages in a row have no link. A round reads
the next window of pages of every type still going, twice as long as the last round's, so the rounds grow
with the logarithm of the longest listing: its pages are fetched (a join with the page table, so only
pages that are read are parsed), the stop rule is applied to them and the last pages of the round before,
and the urls found are taken off by those already seen (an anti-join). Each round is written, so a lost
executor repeats a part of one round, and the next round reads tables.

A type may hold any share of the pages: they are numbered by ``number_within``, windows and votes are keyed
by (type, page), and types that have stopped are a small table of their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators.pages import EMPTY_PAGES_TO_STOP, crawl_cutoff, page_links
from rankloom.operators.topk import number_within
from rankloom.session import materialize

WINDOW = 8          # pages of a type in the first round

#: A page's listing type: the first part of its url's path.
TYPE_PATTERN = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([^/?#]+)"


def listing_of(pages: DataFrame) -> DataFrame:
    """listing(type, page, page_id): the pages of every listing type, numbered from 1 in page_id order. Pages
    without a type are no listing pages."""
    typed = pages.select("page_id", F.regexp_extract(F.coalesce("url", F.lit("")), TYPE_PATTERN, 1).alias("type")).filter("type <> ''")
    return number_within(typed, ["type"], [F.col("page_id")], "page").select("type", F.col("page").cast("int").alias("page"), "page_id")


def crawl(pages: DataFrame, marker: str, listing: DataFrame | None = None, empties: int = EMPTY_PAGES_TO_STOP,
          window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(reads, found) of a crawl of ``pages(page_id, url, html)``: reads(type, page, page_id, n_links, round) are
    the pages read, found(url, type, page, round) the urls with ``marker`` in their link, each with the first page,
    by number and then type, that links it."""
    listing = materialize(listing if listing is not None else listing_of(pages), "crawl_listing")
    last = listing.agg(F.coalesce(F.max("page"), F.lit(0))).first()[0]
    reads, found, stopped = [], [], listing.select("type").limit(0)
    start, turn = 1, 0
    while True:
        asked = listing.filter((F.col("page") >= start) & (F.col("page") < start + window)).join(stopped, "type", "left_anti")
        fetched = pages.select("page_id", "url", "html").join(asked.select("page_id"), "page_id", "left_semi")
        links = materialize(page_links(fetched, marker), "crawl_links")
        counts = links.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_links"))
        log = materialize(asked.join(counts, "page_id", "left").select(
            "type", "page", "page_id", F.coalesce("n_links", F.lit(0)).alias("n_links")), "crawl_log")
        # a run of empty pages may begin in the round before
        carried = log if not reads else log.unionByName(reads[-1].drop("round").filter(F.col("page") > start - empties))
        read = materialize(crawl_cutoff(carried, empties).filter(F.col("page") >= start).select(
            "type", "page", "page_id", "n_links", F.lit(turn).alias("round")), "crawl_reads")
        first = links.join(read, "page_id").groupBy("url").agg(F.min(F.struct("page", "type")).alias("at"))
        if found:
            first = first.join(reduce(DataFrame.unionByName, found).select("url"), "url", "left_anti")
        found.append(materialize(first.select("url", "at.type", "at.page", F.lit(turn).alias("round")), "crawl_found"))
        reads.append(read)
        # a type goes on if its window was read whole and has pages after it
        whole = read.groupBy("type").agg(F.max("page").alias("page")).filter(F.col("page") == start + window - 1)
        runs = carried.join(read.select("type").distinct(), "type", "left_semi").filter(
            (F.col("page") >= start + window - empties) & (F.col("n_links") == 0)).groupBy("type").count().filter(F.col("count") == empties)
        going = whole.join(runs, "type", "left_anti").select("type")
        stopped = materialize(listing.select("type").distinct().join(going, "type", "left_anti"), "crawl_stopped")
        start, window, turn = start + window, 2 * window, turn + 1
        if start > last or going.isEmpty():
            return reduce(DataFrame.unionByName, reads), reduce(DataFrame.unionByName, found)
