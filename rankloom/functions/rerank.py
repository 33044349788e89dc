"""External-ranker surface: context lines, prompt text, reply parsing.

The remote model call is not part of the engine: prompts go out as a table and
replies come back as ``rankings(query_id, reply)``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POOL_SIZE = 20          # candidates shown to the ranker
DESC_CHARS = 200        # description chars per context line
QUERY_CHARS = 1000      # query chars in the prompt
TOP_SCORE, SCORE_STEP = 0.99, 0.01

# What the ranker is told: the request, numbered candidates, how many to choose, and the reply
# form that ``parse_reply`` reads.
PROMPT_TEMPLATE = (
    "A request and a numbered catalog excerpt follow. Choose the {top_k} entries that serve the "
    "request best and answer with their numbers, best first, as one JSON array such as [4, 0, 7].\n\n"
    "Request:\n{query}\n\nCatalog excerpt:\n{candidates}\nJSON array of {top_k} numbers:")


def context_line(pos, name, test_type, description) -> Column:
    """B23: '[i] Name: n | Type: t | Desc: first 200 chars, newlines as spaces' + newline."""
    def c(x):
        return F.col(x) if isinstance(x, str) else x
    desc = F.replace(F.substring(F.coalesce(c(description), F.lit("")), 1, DESC_CHARS),
                     F.lit("\n"), F.lit(" "))
    return F.concat(F.lit("["), c(pos).cast("string"), F.lit("] Name: "),
                    F.coalesce(c(name).cast("string"), F.lit("None")),
                    F.lit(" | Type: "), F.coalesce(c(test_type), F.lit("N/A")),
                    F.lit(" | Desc: "), desc, F.lit("\n"))


def prompt_text(query, candidates, top_k) -> Column:
    """The fixed instructions with the query (first 1000 chars), context and top_k."""
    def c(x):
        return F.col(x) if isinstance(x, str) else x
    k = c(top_k).cast("string") if not isinstance(top_k, int) else F.lit(str(top_k))
    parts = PROMPT_TEMPLATE.split("{")
    out = [F.lit(parts[0])]
    for p in parts[1:]:
        key, rest = p.split("}", 1)
        out.append({"top_k": k, "query": F.substring(c(query), 1, QUERY_CHARS),
                    "candidates": c(candidates)}[key])
        out.append(F.lit(rest))
    return F.concat(*out)


def parse_reply(reply) -> Column:
    """First bracketed span (lazy, dot matches newline) decoded as array<bigint>.

    Null when there is no list, when it is malformed or mixed, or when it holds a null.
    """
    r = F.col(reply) if isinstance(reply, str) else reply
    arr = F.from_json(F.regexp_extract(r, r"(?s)\[.*?\]", 0), "array<bigint>")
    return F.when(arr.isNotNull() & ~F.exists(arr, lambda x: x.isNull()), arr)


def rank_score(rank) -> Column:
    """Score of the j-th reranked item (0-based j)."""
    r = F.col(rank) if isinstance(rank, str) else rank
    return F.lit(TOP_SCORE) - F.lit(SCORE_STEP) * r
