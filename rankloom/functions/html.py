"""Catalog-record extraction from raw HTML pages.

Regex over the markup with built-in functions. Documented approximations of a DOM
parser: a paragraph is the text between ``<p ...>`` and the next ``</p>``; script and
style bodies never count as page text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankloom.functions.text import decode_each, decode_entities, slug_name, strip_markup, strip_tags, without_hidden

# ---- Fixed values -------------------------------------------------------------------
# Ordered category rules: the first rule with a keyword contained in the lower-cased
# name or page text wins; otherwise the default category.
CATEGORY_RULES = [
    ("Technical Skills", ["java", "python", "javascript", "sql", "coding", "programming",
                          "developer", "software"]),
    ("Personality Assessment", ["personality", "opq", "behavioral", "behavior"]),
    ("Leadership", ["leadership", "manager", "executive", "director", "supervisor"]),
    ("Cognitive Ability", ["verbal", "numerical", "reasoning", "cognitive", "aptitude", "logic"]),
    ("Behavioral Skills", ["sales", "communication", "customer", "service"]),
]
DEFAULT_CATEGORY = "General Assessment"
# Page-duration cascade (case-insensitive), first match wins.
PAGE_DURATION_PATTERNS = [
    r"(?i)(\d+)\s*(?:minutes?|mins?)",
    r"(?i)Duration[:\s]+(\d+)",
    r"(?i)Time[:\s]+(\d+)",
]
MIN_PARAGRAPH_CHARS = 50
DESCRIPTION_CHARS = 500
DEFAULT_DESCRIPTION = "Talent assessment for evaluating candidate capabilities"
# -------------------------------------------------------------------------------------

# The inside of a tag: quoted attribute values may hold '>'.
_INSIDE = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""


def tags(html, name: str) -> Column:
    """Opening tags of the named element outside scripts, styles and comments, in order."""
    return F.regexp_extract_all(without_hidden(html), F.lit(rf"(?is)<{name}(?=[\s/>]){_INSIDE}>"), 0)


def attribute(tag: Column, name: str) -> Column:
    """Value of a tag's attribute, double-quoted, single-quoted or bare; null when absent.
    Character references are kept (decode them outside of array functions)."""
    pattern = rf"""(?is)[\s"']{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    value = F.concat(*[F.regexp_extract(tag, pattern, g) for g in (1, 2, 3)])
    return F.when(tag.rlike(pattern), value)


def _element_text(html: Column, tag: str) -> Column:
    """Stripped text of the first <tag> element, or null when the element is absent."""
    inner = F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1)
    return F.when(html.rlike(rf"(?is)<{tag}\b"), F.trim(strip_tags(inner)))


def page_text(html) -> Column:
    """Visible text of the whole page (script/style/comments removed, entities decoded)."""
    h = F.col(html) if isinstance(html, str) else html
    return strip_tags(h)


def record_name(html, url, title_suffix: str | None = None) -> Column:
    """First existing of h1, .product-title, title; title cut at '|' and suffix removed;
    empty -> slug name (an existing but empty h1 skips straight to the slug)."""
    h = F.col(html) if isinstance(html, str) else html
    klass = F.regexp_extract(h, r'(?is)<[a-z0-9]+\b[^>]*class="[^"]*\bproduct-title\b[^"]*"[^>]*>(.*?)</', 1)
    has_klass = h.rlike(r'(?is)class="[^"]*\bproduct-title\b')
    title = F.trim(F.substring_index(_element_text(h, "title"), "|", 1))
    if title_suffix:
        title = F.trim(F.replace(title, F.lit(title_suffix), F.lit("")))
    chosen = (F.when(h.rlike(r"(?is)<h1\b"), _element_text(h, "h1"))
               .when(has_klass, F.trim(strip_tags(klass)))
               .when(h.rlike(r"(?is)<title\b"), title))
    return F.when(F.coalesce(F.length(chosen), F.lit(0)) > 0, chosen).otherwise(slug_name(url))


def paragraphs(html) -> Column:
    """Trimmed text of each <p> element, in document order."""
    h = F.col(html) if isinstance(html, str) else html
    raw = F.regexp_extract_all(h, F.lit(r"(?is)<p\b[^>]*>(.*?)</p\s*>"), 1)
    return F.transform(decode_each(F.transform(raw, strip_markup)), lambda p: F.trim(p))


def record_description(html, default: str = DEFAULT_DESCRIPTION) -> Column:
    """Meta description; else first paragraph longer than 50 chars cut to 500; else default."""
    h = F.col(html) if isinstance(html, str) else html
    described = F.filter(tags(h, "meta"), lambda t: F.coalesce(attribute(t, "name") == "description", F.lit(False)))
    meta = decode_entities(attribute(F.try_element_at(described, F.lit(1)), "content"))
    long_p = F.try_element_at(F.filter(paragraphs(h), lambda p: F.length(p) > MIN_PARAGRAPH_CHARS), F.lit(1))
    return F.coalesce(F.nullif(meta, F.lit("")),
                      F.substring(long_p, 1, DESCRIPTION_CHARS),
                      F.lit(default))


def text_duration(text) -> Column:
    """First matching duration pattern in page text, as int."""
    t = F.col(text) if isinstance(text, str) else text
    expr = None
    for pat in PAGE_DURATION_PATTERNS:
        val = F.regexp_extract(t, pat, 1).try_cast("int")
        expr = F.when(t.rlike(pat), val) if expr is None else expr.when(t.rlike(pat), val)
    return expr.otherwise(F.lit(None).cast("int"))


def adaptive_support(text) -> Column:
    """B7: 'Yes' when the text mentions 'adaptive', else 'No'."""
    t = F.col(text) if isinstance(text, str) else text
    return F.when(F.lower(t).contains("adaptive"), F.lit("Yes")).otherwise(F.lit("No"))


def remote_support(text) -> Column:
    """B7 (kept quirk): both branches of the reference give 'Yes'."""
    return F.lit("Yes")


def category(name, text) -> Column:
    """Ordered keyword rules over name OR page text; first hit wins."""
    n = F.lower(F.col(name) if isinstance(name, str) else name)
    t = F.lower(F.col(text) if isinstance(text, str) else text)
    expr = None
    for cat, kws in CATEGORY_RULES:
        pat = "|".join(kws)
        cond = F.coalesce(n.rlike(pat), F.lit(False)) | F.coalesce(t.rlike(pat), F.lit(False))
        expr = F.when(cond, F.lit(cat)) if expr is None else expr.when(cond, F.lit(cat))
    return expr.otherwise(F.lit(DEFAULT_CATEGORY))


def extract_record(html, url, title_suffix: str | None = None, *,
                   text: Column | None = None, name: Column | None = None) -> list[Column]:
    """A2: the seven catalog columns extracted from one page. ``text`` / ``name`` may be
    columns computed in an earlier projection (see ``pages.page_records``)."""
    h = F.col(html) if isinstance(html, str) else html
    u = F.col(url) if isinstance(url, str) else url
    name = record_name(h, u, title_suffix) if name is None else name
    text = page_text(h) if text is None else text
    return [name.alias("assessment_name"), u.alias("url"),
            record_description(h).alias("description"),
            text_duration(text).alias("duration_minutes"),
            category(name, text).alias("test_type"),
            adaptive_support(text).alias("adaptive_support"),
            remote_support(text).alias("remote_support")]

