"""Text, URL and formatting expressions."""

from __future__ import annotations

import html as html_entities
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# The token pattern (Unicode letters, digits, underscore), matching
# Python's ``\w`` word runs on lower-cased text.
TOKEN_PATTERN = r"[\p{L}\p{N}_]+"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


NON_TOKEN_PATTERN = r"[^\p{L}\p{N}_]+"


def tokens(text) -> Column:
    """Lower-case, every maximal word run; no stopwords, no stemming.

    Written as a split on the complement class (cheaper than extracting each match);
    the empty edges of the split are removed."""
    return F.array_remove(F.split(F.lower(_c(text)), NON_TOKEN_PATTERN), "")


def url_slug(url, lower: bool = True) -> Column:
    """B2: strip all trailing '/', keep the last path part; null -> ''."""
    s = F.substring_index(F.regexp_replace(_c(url), "/+$", ""), "/", -1)
    if lower:
        s = F.lower(s)
    return F.coalesce(s, F.lit(""))


def title_case(text) -> Column:
    """Every run of cased letters starts upper case and goes on lower case, whatever stands
    between the runs (digits, quotes and other signs start a new one)."""
    runs = F.regexp_extract_all(_c(text), F.lit(r"([\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+)"), 1)
    first = lambda w: F.substring(w, 1, 1)
    return F.array_join(F.transform(runs, lambda w: F.concat(
        F.when(first(w) == "ß", F.lit("Ss")).otherwise(F.upper(first(w))), F.lower(F.substr(w, F.lit(2))))), "")


def slug_name(url, scraper_variant: bool = True) -> Column:
    """Slug -> display name ('-'/'_' to space, title case).

    The scraper variant also decodes %28/%29, drops every ' New' and trims.
    """
    s = title_case(F.translate(url_slug(url, lower=False), "-_", "  "))
    if scraper_variant:
        s = F.replace(F.replace(s, F.lit("%28"), F.lit("(")), F.lit("%29"), F.lit(")"))
        s = F.trim(F.replace(s, F.lit(" New"), F.lit("")))
    return s


@F.pandas_udf(StringType())
def _joined(base: pd.Series, href: pd.Series) -> pd.Series:
    def join(b, h):
        try:
            return urljoin(b or "", h)
        except ValueError:              # not a url: kept as it stands
            return h
    return pd.Series([None if h is None else join(b, h) for b, h in zip(base, href)], dtype=object)


def absolute_url(href, page_url, site: Column | None = None) -> Column:
    """B1: '/x' -> site prefix + href; 'http..' -> as is; else resolved against the page
    (dot segments, '?', '#' and other schemes as in RFC 3986)."""
    href, page_url = _c(href), _c(page_url)
    site = site if site is not None else F.regexp_extract(page_url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    return (F.when(href.startswith("/"), F.concat(site, href))
             .when(href.startswith("http"), href)
             .otherwise(_joined(page_url, href)))


def truncate_ellipsis(text, n: int, collapse_ws: bool = False) -> Column:
    """First n chars + '...' when the ORIGINAL text is longer than n.

    With ``collapse_ws`` the whitespace runs are collapsed (and the ends trimmed)
    before cutting, but the ellipsis test still uses the original length (kept quirk).
    """
    t = _c(text)
    body = F.trim(F.regexp_replace(t, r"[ \t\n\x0B\f\r]+", " ")) if collapse_ws else t
    return F.concat(F.substring(body, 1, n), F.when(F.length(t) > n, F.lit("...")).otherwise(F.lit("")))


# The labels of the encoder text and the defaults of absent fields.
RICH_LABELS = ("Assessment Name: ", "\nTitle: ", "\nDescription: ", "\nType: ", "\nCategory: ", "\nDuration: ",
               "\nRemote Testing Support: ", "\nAdaptive Assessment (IRT): ", "\nKeywords: ")
FIELD_DEFAULTS = {"assessment_name": "", "description": "", "test_type": "N/A", "duration_minutes": "N/A",
                  "adaptive_support": "No", "remote_support": "No"}


def with_default(c, field: str) -> Column:
    """A field as text, with its default where it is absent."""
    return F.coalesce(_c(c).cast("string"), F.lit(FIELD_DEFAULTS[field]))


def rich_text(name, description, test_type, duration, remote, adaptive,
              catalog_label: str = "product catalog") -> Column:
    """The nine-line labelled template used as encoder input (trimmed)."""
    n, t = with_default(name, "assessment_name"), with_default(test_type, "test_type")
    desc = F.substring(with_default(description, "description"), 1, 600)
    values = (n, n, desc, t, t, F.concat(with_default(duration, "duration_minutes"), F.lit(" minutes")),
              with_default(remote, "remote_support"), with_default(adaptive, "adaptive_support"),
              F.concat(n, F.lit(", "), t, F.lit(", talent assessment, " + catalog_label)))
    return F.trim(F.concat(*[x for label, v in zip(RICH_LABELS, values) for x in (F.lit(label), v)]))


def keyword_text(name, description, test_type) -> Column:
    """Name, description and type joined by single spaces (absent: empty, so that no
    placeholder becomes a search term)."""
    return F.concat_ws(" ", *[F.coalesce(_c(c), F.lit("")) for c in (name, description, test_type)])


@F.pandas_udf(StringType())
def decode_entities(text: pd.Series) -> pd.Series:
    """All named and numeric character references of HTML5 (a batch of texts at a time)."""
    return text.map(lambda t: html_entities.unescape(t) if t is not None and "&" in t else t)


@F.pandas_udf(ArrayType(StringType()))
def decode_each(texts: pd.Series) -> pd.Series:
    """``decode_entities`` for arrays of texts."""
    return texts.map(lambda ts: None if ts is None else [html_entities.unescape(t) for t in ts])


def without_hidden(html) -> Column:
    """Markup without script and style elements and comments; one that is never closed reaches to the
    end of the page."""
    h = F.regexp_replace(_c(html), r"(?is)<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)", "")
    return F.regexp_replace(h, r"(?s)<!--.*?(?:-->|\z)", "")


def strip_markup(html) -> Column:
    """Markup -> text with its character references: script/style bodies, comments, tags go."""
    return F.regexp_replace(without_hidden(html), r"(?s)<[^>]*>", "")


def strip_tags(html) -> Column:
    """Markup -> raw text: drop script/style bodies, comments, tags; decode entities."""
    return decode_entities(strip_markup(html))


def html_to_text(html, limit: int = 5000) -> Column:
    """Visible text; lines trimmed, split on double spaces, empties dropped, joined by ' '."""
    return phrases(strip_tags(html), limit)


def phrases(text, limit: int = 5000) -> Column:
    """The phrases of a page's text on one line, as B18 has them."""
    lines = F.split(_c(text), r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]")
    parts = F.flatten(F.transform(lines, lambda l: F.split(F.trim(l), "  ")))
    kept = F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: F.length(p) > 0)
    return F.substring(F.array_join(kept, " "), 1, limit)


def display_duration(duration) -> Column:
    """B26: 'n min', or 'N/A' when null or 0."""
    d = _c(duration)
    return F.when(d.isNull() | (d == 0), F.lit("N/A")).otherwise(F.concat(d.cast("string"), F.lit(" min")))


@F.pandas_udf(StringType())
def _three_decimals(score: pd.Series) -> pd.Series:
    return score.map(lambda x: None if pd.isna(x) else f"{x:.3f}")


def display_score(score) -> Column:
    """Three-decimal score text, rounded on the binary value (the JVM's formatter rounds the
    shortest decimal form instead, which differs on halves)."""
    return _three_decimals(_c(score).cast("double"))
