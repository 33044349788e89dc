"""Crawled pages -> links, crawl progress, catalog records, merged catalog, profiles
(SURVEY A1-A3, B1, B9, C1, D1, E1, E2, E10-E15, F1, F5, F7, G7, H1, H2, H5, L1, L6).

The reference crawls live listing pages; here the crawl output is a ``pages`` table and
every step is a DataFrame job over it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions import html as H
from rankloom.functions import tree as TR
from rankloom.functions.text import absolute_url, decode_entities, phrases, slug_name
from rankloom.operators.topk import number_within

REQUIRED_ROWS = 377          # catalog size the reference checks against
EMPTY_PAGES_TO_STOP = 3


def page_links(pages: DataFrame, marker: str = "/") -> DataFrame:
    """A1 + C1 + B1: (page_id, url) distinct absolute links of ``<a>`` elements whose href
    contains ``marker``. Repeated hrefs of a page go before its row is exploded, so only urls
    that different hrefs of a page resolve to are left to the ``distinct``."""
    hrefs = F.array_distinct(F.filter(F.transform(H.tags("html", "a"), lambda t: H.attribute(t, "href")),
                                      lambda h: h.isNotNull()))
    found = pages.select("page_id", F.col("url").alias("page_url"), F.explode(hrefs).alias("href"))
    found = found.withColumn("href", decode_entities("href")).filter(F.col("href").contains(marker))
    return found.select("page_id", absolute_url("href", "page_url").alias("url")).distinct()


def discovered_urls(links: DataFrame) -> DataFrame:
    """H1: the union of links over all pages, distinct."""
    return links.select("url").distinct()


def new_links_per_page(links: DataFrame) -> DataFrame:
    """F5 + H2: per page (in page_id crawl order) its distinct links and how many were not
    seen on an earlier page. A url is new on its first page only, so the new-link count of
    a page is the number of urls whose first page it is: two grouped counts joined on the
    page, and no join on url (a link present on every page would be a hot url key)."""
    n_links = links.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_links"))
    first = links.groupBy("url").agg(F.min("page_id").alias("page_id"))
    n_new = first.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_new"))
    return (n_links.join(n_new, "page_id", "left")
                   .select("page_id", "n_links", F.coalesce(F.col("n_new"), F.lit(0)).alias("n_new")))


def crawl_log_from_events(events: DataFrame) -> DataFrame:
    """crawl_log(type, page, n_links) stand-in: one listing type per user, pages in time
    order, link count from the event value. Pages are numbered with ``number_within``, so
    a user holding a large share of the events is split over many tasks."""
    log = events.select(F.col("user_id").alias("type"), "ts", "event_id",
                        F.pmod(F.floor("value").cast("bigint"), F.lit(4)).alias("n_links"))
    return number_within(log, ["type"], [F.col("ts"), F.col("event_id")], "page") \
        .select("type", F.col("page").cast("int").alias("page"), "n_links")


def crawl_cutoff(log: DataFrame, empties: int = EMPTY_PAGES_TO_STOP) -> DataFrame:
    """per type, the pages read before the crawler stops - it stops on the page that
    completes ``empties`` consecutive empty pages (a non-empty page resets the count).

    Pages are numbered 1, 2, ... per type, so page p ends a run when p-empties+1 .. p are
    all empty: every empty page votes for itself and the next ``empties - 1`` pages, and a
    page with ``empties`` votes is a stop. The votes are grouped by (type, page) - keys
    that spread a hot type over all tasks - instead of a row frame over one window
    partition per type. ``stops`` has one row per type; AQE broadcasts it at run time when
    small, else splits a hot type (skew join)."""
    votes = (log.filter(F.col("n_links") == 0)
                .select("type", F.explode(F.sequence(F.col("page"), F.col("page") + (empties - 1))).alias("page")))
    ends = votes.groupBy("type", "page").count().filter(F.col("count") == empties)
    stops = ends.groupBy("type").agg(F.min("page").alias("_stop"))
    return (log.join(stops, "type", "left")
               .filter(F.col("_stop").isNull() | (F.col("page") <= F.col("_stop"))).drop("_stop"))


def page_records(pages: DataFrame, title_suffix: str | None = None,
                 failed_description: str = "Error extracting details") -> DataFrame:
    """A2 + A3 + B9: one catalog row per page; a page without markup becomes the
    placeholder row (slug name, Unknown adaptive). Adds ``status`` ok / failed."""
    # page text and name first, in their own projection: every field reads them, and
    # inside the per-field conditionals Spark would re-run the markup regexes each time
    pages = pages.select("page_id", "url", "html", H.page_text(F.col("html")).alias("_text"),
                         H.record_name(F.col("html"), F.col("url"), title_suffix).alias("_name"))
    return _records(pages, H.extract_record("html", "url", title_suffix, text=F.col("_text"), name=F.col("_name")), failed_description)


def parsed_records(pages: DataFrame, title_suffix: str | None = None,
                   failed_description: str = "Error extracting details") -> DataFrame:
    """``page_records`` from each page's tree (``functions.tree``) instead of expressions over its markup:
    elements that are never closed, nested or quoted either way are what a parser makes of them."""
    pages = pages.select("page_id", "url", "html", TR.page_parts("html", title_suffix).alias("_page"))
    name = F.coalesce(F.nullif(F.col("_page.name"), F.lit("")), slug_name("url"))
    pages = pages.select("page_id", "url", "html", name.alias("_name"), F.col("_page.text").alias("_text"),
                         F.coalesce(F.nullif(F.col("_page.description"), F.lit("")), F.lit(H.DEFAULT_DESCRIPTION)).alias("_described"))
    text = F.col("_text")
    rec = [F.col("_name"), F.col("url"), F.col("_described"), H.text_duration(text), H.category(F.col("_name"), text),
           H.adaptive_support(text), H.remote_support(text)]
    return _records(pages, rec, failed_description)


def parsed_text(pages: DataFrame) -> DataFrame:
    """B18 from each page's tree: (page_id, text)."""
    found = pages.select("page_id", TR.page_parts("html").alias("_page")).select("page_id", F.col("_page.text").alias("_text"))
    return found.select("page_id", phrases("_text").alias("text"))


def _records(pages: DataFrame, rec: list, failed_description: str) -> DataFrame:
    """The catalog columns ``rec``, or the placeholder's for a page without markup, and the status."""
    ok = F.col("html").isNotNull() & F.col("html").contains("<")
    placeholder = {"assessment_name": slug_name("url"), "url": F.col("url"),
                   "description": F.lit(failed_description), "duration_minutes": F.lit(None).cast("int"),
                   "test_type": F.lit(H.DEFAULT_CATEGORY), "adaptive_support": F.lit("Unknown"),
                   "remote_support": F.lit("Yes")}
    names = ["assessment_name", "url", "description", "duration_minutes", "test_type",
             "adaptive_support", "remote_support"]
    cols = [F.when(ok, c).otherwise(placeholder[n]).alias(n) for c, n in zip(rec, names)]
    return pages.select("page_id", *cols, F.when(ok, F.lit("ok")).otherwise(F.lit("failed")).alias("status"))


# Fixed value: the description of a url without a record.
PLACEHOLDER_DESCRIPTION = "Talent assessment"


def placeholder_rows(urls: DataFrame, description: str = PLACEHOLDER_DESCRIPTION) -> DataFrame:
    """B9 (merge variant): minimal rows for urls without a record; the merge variant names
    them from the slug without decoding or dropping ' New'."""
    return urls.select(slug_name("url", scraper_variant=False).alias("assessment_name"), "url",
                       F.lit(description).alias("description"), F.lit(None).cast("int").alias("duration_minutes"),
                       F.lit(H.DEFAULT_CATEGORY).alias("test_type"), F.lit("Unknown").alias("adaptive_support"),
                       F.lit("Yes").alias("remote_support"))


CATALOG_COLS = ["assessment_name", "url", "description", "duration_minutes", "test_type",
                "adaptive_support", "remote_support"]


def keep_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """the earliest row per key by ``order`` (not dropDuplicates, whose survivor is
    arbitrary). A grouped min_by keeps a hot key to one row per map partition."""
    others = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_r"))
    return best.select(key, *[F.col("_r").getField(c).alias(c) for c in others])


def merge_catalog(records: DataFrame, urls: DataFrame) -> DataFrame:
    """L1: scraped records first, then placeholders for the other urls (D1 left anti join),
    bag union (H5), keep-first by url (F1). Adds ``source``."""
    recs = records.select(*CATALOG_COLS, F.lit(0).alias("_prio"), F.col("page_id").cast("long").alias("_ord"))
    missing = urls.join(records.select("url"), "url", "left_anti")
    ph = placeholder_rows(missing).select(*CATALOG_COLS, F.lit(1).alias("_prio"), F.lit(0).cast("long").alias("_ord"))
    both = recs.unionByName(ph)
    out = keep_first(both, "url", ["_prio", "_ord"])
    return out.select(*CATALOG_COLS, F.when(F.col("_prio") == 0, "current_scrape").otherwise("dataset_urls")
                      .alias("source"))


def source_counts(records: DataFrame, urls: DataFrame) -> DataFrame:
    """Rows per source; the url list counts distinct urls."""
    a = records.agg(F.count(F.lit(1)).alias("n")).select(F.lit("current_scrape").alias("source"), "n")
    b = urls.agg(F.count_distinct("url").alias("n")).select(F.lit("dataset_urls").alias("source"), "n")
    return a.unionByName(b)


def catalog_profile(catalog: DataFrame) -> DataFrame:
    """E1 + E11 + E15: rows, distinct urls, rows with a duration (0 counts as none),
    adaptive = Yes, remote = Yes."""
    d = F.col("duration_minutes")
    return catalog.agg(F.count(F.lit(1)).alias("total"), F.count_distinct("url").alias("unique_urls"),
                       F.count_if(d.isNotNull() & (d != 0)).alias("with_duration"),
                       F.count_if(F.col("adaptive_support") == "Yes").alias("adaptive_yes"),
                       F.count_if(F.col("remote_support") == "Yes").alias("remote_yes"))


def category_counts(catalog: DataFrame, category: str = "test_type") -> DataFrame:
    """E2 + G10: rows per category, count descending (ties by name)."""
    return (catalog.groupBy(category).agg(F.count(F.lit(1)).alias("count"))
                   .orderBy(F.desc("count"), F.col(category)))


def threshold_check(catalog: DataFrame, required: int = REQUIRED_ROWS) -> DataFrame:
    """One-row size check with surplus / gap and percent of the requirement."""
    n = F.col("total")
    return (catalog.agg(F.count(F.lit(1)).alias("total"))
                   .select("total", F.lit(required).alias("required"),
                           F.when(n >= required, "ok").otherwise("gap").alias("status"),
                           F.when(n >= required, n - required).otherwise(0).alias("surplus"),
                           F.when(n < required, required - n).otherwise(0).alias("gap"),
                           F.round(n / F.lit(required) * 100, 1).alias("percent")))


MAX_SAMPLE = 50


def head_sample(catalog: DataFrame, n: int = 5, order: str = "key") -> DataFrame:
    """G7 + C8: first n (1 to 50) rows in catalog order (a bounded global top-n, not a full sort)."""
    if not 1 <= n <= MAX_SAMPLE:
        raise ValueError(f"the sample size is between 1 and {MAX_SAMPLE}")
    return catalog.orderBy(order).limit(n)


def extraction_counts(records: DataFrame) -> DataFrame:
    """Ok / failed counters."""
    return records.agg(F.count_if(F.col("status") == "ok").alias("successful"),
                       F.count_if(F.col("status") == "failed").alias("failed"))
