"""Quality rules with robust multivariate outliers, in DataFrame functions only.

Five statistics of each whole text are transformed (log words, log mean word length, log
symbols per word, log repeated lines, root of the repeated-words share). For every language and
source the minimum covariance determinant estimate of their mean and covariance is searched by
concentration steps from several fixed starts (``starting``): the (n + p + 1) / 2 documents
nearest to the centre, and those in the last one's distance bin, give the next mean and
covariance, until the determinant falls no more; the smallest determinant of all starts and steps
is taken and made consistent with the normal distribution at the median, in both directions.
Mean and covariance of the documents within NEAR of it are the group's estimate. The same is
estimated for every language and for all documents, and a group's mean and covariance are shrunk
towards its language's, those towards all documents', by n / (n + SHRINK) for n documents: at
every size alike, so no number of documents changes the rule that judges them. A document is
rejected if its squared Mahalanobis distance from its group's shrunk estimate passes CUTOFF.
TOLERANCE is the least standard deviation a statistic is given (its square is added to the
covariance's diagonal), so statistics that are constant in a group do not make every deviation
an outlier and the covariance is never singular.

Documents that fail the base rules are rejected at once and take no part in the estimates.

Every estimate is a grouped aggregate with partial sums, so a source with a third of all rows
is never gathered in a task. Estimates reach the rows by a broadcast while their number bounds
its size (SIDE_BYTES), and by a join salted on both sides beyond. Quantiles are taken over integer
bins (of a fixed width), whose counts merge exactly: the result does not depend on partitions.

Defined cases: a null or empty text has no words and fails the base rules. Null languages and
sources are groups of their own. A document alone in its table is its own estimate and kept.
Repeated rows count each; a null id is judged like any other. Other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rankloom.llm.shared import Scratch

SPACE = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 3

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SHRINK = 50
TOLERANCE = (0.3, 0.06, 0.25, 0.35, 0.12)
P = len(TOLERANCE)
#: Quantiles of the chi-squared distribution with five degrees of freedom.
CHI2_MEDIAN, NEAR, CUTOFF = 4.3515, 12.8325, 20.515        # 0.5, 0.975 and 0.999
NEAR_FACTOR = 1.0555                       # of a normal covariance to that of its share within NEAR
BINS = 64                                  # of a distance, for each factor of e
FINE = 16                                  # of a statistic, for each tolerance
FALLS = 1e-9                               # of a log determinant; less is rounding
LAST_BIN = (1 << 31) - 1
SIDE_BYTES, ROW_BYTES, SALTS = 64 << 20, 400, 64


def statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of the
    whole text (null: empty). Each step is a projection of its own, so that no array is
    computed twice; a text is sorted against itself only if it repeats a window at all."""
    text = F.coalesce("text", F.lit(""))
    split = docs.select(
        *keep, F.filter(F.split(text, SPACE), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"))
    size = F.size("words")
    hashed = split.select(
        *keep, size.cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(size >= WINDOW, F.transform(
            F.sequence(F.lit(0), size - WINDOW),
            lambda i: F.xxhash64(*[F.get("words", i + d) for d in range(WINDOW)]))).alias("windows"))
    found = [c for c in hashed.columns if c != "windows"]
    numbered = hashed.select(*found, F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"),
        F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("sorted"))
    same = lambda x, j: x["h"] == F.get("sorted", j)["h"]
    again = numbered.select(*found, F.sort_array(F.transform(
        F.filter("sorted", lambda x, j: F.coalesce(same(x, j - 1), F.lit(False)) | F.coalesce(same(x, j + 1), F.lit(False))),
        lambda x: x["i"])).alias("starts"))
    covered = F.aggregate(
        "starts", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"])
    return again.select(*found, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def failing() -> Column:
    """The base rules."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def transformed() -> list[Column]:
    n = F.greatest("n_words", F.lit(1))
    return [F.log(n), F.log(F.greatest(F.col("word_chars") / n, F.lit(1.0))), F.log1p(20 * F.col("n_symbols") / n),
            F.log1p("n_dup_lines"), F.sqrt(F.col("n_repeat_words") / n)]


def cells() -> Column:
    """The three groups whose estimates judge a row: its language's source, its language, and all."""
    null = F.lit(None).cast("string")
    lang, source = F.col("lang").cast("string"), F.col("source").cast("string")
    return F.array(*[F.struct(F.lit(level).alias("level"), a.alias("lang"), b.alias("source"))
                     for level, a, b in ((1, lang, source), (2, lang, null), (3, null, null))])


def met(rows: DataFrame, side: DataFrame, keys: list[str], size: int) -> DataFrame:
    """``rows(cell, x0..)`` with the ``side`` of their cell, whose rows take ``size`` bytes at most."""
    if size <= SIDE_BYTES:
        return rows.join(F.broadcast(side), keys)
    salted = side.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(*xs()), F.lit(SALTS)).cast("int")).join(salted, [*keys, "salt"]).drop("salt")


def xs() -> list[str]:
    return [f"x{j}" for j in range(P)]


def quantile_bins(of: list[Column], share: float, names: list[str]) -> list[Column]:
    """Quantiles over integer bins: the counts of a bounded number of bins are merged."""
    return [F.percentile(c, share).alias(n) for c, n in zip(of, names, strict=True)]


def fine(j: int, x: Column) -> Column:
    return F.round(x * (FINE / TOLERANCE[j])).cast("int")


def bin_of(distance: Column) -> Column:
    return F.floor(F.log(distance + 1e-3) * BINS).cast("int")


def distance() -> Column:
    """Squared Mahalanobis distance from means m and the inverse Cholesky factor w of a cell."""
    centred = [F.col(f"x{j}") - F.col(f"m{j}") for j in range(P)]
    rows = [sum((F.col(f"w{j}{k}") * centred[k] for k in range(j + 1)), F.lit(0.0)) for j in range(P)]
    return sum((r * r for r in rows), F.lit(0.0))


def factored(moments: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, m, w, det: means, inverse Cholesky factor and log determinant of the
    covariances c plus tolerances."""
    out = moments
    for j in range(P):                      # the factor, column by column
        rest = F.col(f"c{j}{j}") + TOLERANCE[j] ** 2
        out = out.withColumn(f"l{j}{j}", F.sqrt(rest - sum((F.col(f"l{j}{k}") ** 2 for k in range(j)), F.lit(0.0))))
        below = {f"l{i}{j}": (F.col(f"c{j}{i}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0)))
                 / F.col(f"l{j}{j}") for i in range(j + 1, P)}
        out = out.withColumns(below) if below else out
    for j in range(P):                      # its inverse, row by row
        row = {f"w{j}{k}": -sum((F.col(f"l{j}{i}") * F.col(f"w{i}{k}") for i in range(k, j)), F.lit(0.0))
               / F.col(f"l{j}{j}") for k in range(j)}
        out = out.withColumns(row | {f"w{j}{j}": 1 / F.col(f"l{j}{j}")})
    det = 2 * sum((F.log(f"l{j}{j}") for j in range(P)), F.lit(0.0))
    return out.select(*keep, *fit(), det.alias("det"))


def fit() -> list[str]:
    return [*[f"m{j}" for j in range(P)], *[f"w{j}{k}" for j in range(P) for k in range(j + 1)]]


def moments(of: DataFrame, keys: list[str]) -> DataFrame:
    return of.groupBy(*keys).agg(
        *[F.avg(f"x{j}").alias(f"m{j}") for j in range(P)],
        *[F.covar_pop(f"x{k}", f"x{j}").alias(f"c{k}{j}") for j in range(P) for k in range(j + 1)])


def starting(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """(cell, start, m, w) of every cell, and a bound on the bytes of so many rows: the centres are
    medians, lower and upper quartiles in units of the median deviations, and medians in units of
    the tolerances."""
    quartiles = [F.percentile(fine(j, F.col(x)), [0.5, 0.25, 0.75]).alias(f"b{j}") for j, x in enumerate(xs())]
    middle = scratch.write(rows.groupBy("cell").agg(*quartiles).select(
        "cell", *[F.array(*[F.col(f"b{j}")[i] * (TOLERANCE[j] / FINE) for i in range(3)]).alias(f"q{j}") for j in range(P)]), "middle")
    names = F.coalesce(F.octet_length("cell.lang"), F.lit(0)) + F.coalesce(F.octet_length("cell.source"), F.lit(0))
    size = 4 * middle.agg(F.coalesce(F.sum(names + ROW_BYTES), F.lit(0))).first()[0]
    apart = [fine(j, F.abs(F.col(x) - F.col(f"q{j}")[0])) for j, x in enumerate(xs())]
    spread = met(rows, middle, ["cell"], size).groupBy("cell").agg(*quantile_bins(apart, 0.5, [f"s{j}" for j in range(P)]))
    units = [F.greatest(1.4826 * F.col(f"s{j}") * (TOLERANCE[j] / FINE), F.lit(TOLERANCE[j])) for j in range(P)]
    zero = [F.lit(0.0).alias(f"w{j}{k}") for j in range(P) for k in range(j)]
    starts = [F.struct(F.lit(i).alias("start"), *[F.col(f"q{j}")[at].alias(f"m{j}") for j in range(P)], *zero,
                       *[(1 / unit[j]).alias(f"w{j}{j}") for j in range(P)])
              for i, (at, unit) in enumerate([(0, units), (1, units), (2, units), (0, [F.lit(t) for t in TOLERANCE])])]
    each = middle.join(spread, "cell").select("cell", F.explode(F.array(*starts)).alias("s")).select("cell", "s.*")
    return scratch.write(each.select("cell", "start", *fit(), F.lit(float("inf")).alias("det")), "state_0"), size


def concentrated(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """(cell, m, w) with the smallest determinant that the concentration steps of all starts
    reach, and the bound of its size. The tables of the steps are small: a row for each cell and
    start still falling. Every further step of a start needs a smaller determinant, so the steps end."""
    (going, size), keys, states = starting(rows, scratch), ["cell", "start"], []
    while not going.isEmpty():
        near = met(rows, going, ["cell"], size).select(*keys, *xs(), F.col("det").alias("last"), bin_of(distance()).alias("bin"))
        # the (n + p + 1) / 2-th of n rows is the median once p more stand behind them
        behind = going.select(*keys, F.lit(LAST_BIN).alias("bin"), F.lit(P).alias("times"))
        limits = near.select(*keys, "bin", F.lit(1).alias("times")).unionByName(behind).groupBy(*keys).agg(
            F.percentile("bin", 0.5, F.col("times")).alias("limit"))
        inside = met(near, limits, keys, size).filter(F.col("bin") <= F.col("limit"))
        state = scratch.write(factored(moments(inside, [*keys, "last"]), [*keys, "last"]), f"state_{len(states) + 1}")
        states.append(state.drop("last"))
        going = state.filter(F.col("det") < F.col("last") - FALLS).drop("last")
    if not states:
        return going.select("cell", *fit()), size
    best = reduce(DataFrame.unionByName, states).groupBy("cell").agg(
        F.min_by(F.struct(*fit()), F.struct(F.round("det", 9), "start")).alias("s"))
    return scratch.write(best.select("cell", "s.*"), "concentrated"), size


def spreads() -> list[str]:
    return [*[f"m{j}" for j in range(P)], *[f"c{k}{j}" for j in range(P) for k in range(j + 1)]]


def estimates(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """(cell, n, m, c) of every cell of ``rows(cell, x0..)``: number of rows, means and covariances
    of those within NEAR; and the bound of its size."""
    state, size = concentrated(rows, scratch)
    at_middle = met(rows, state, ["cell"], size).groupBy("cell").agg(
        F.percentile(bin_of(distance()), 0.5).alias("bin"), F.count(F.lit(1)).alias("n"))
    raw = scratch.write(state.join(at_middle.select(
        "cell", "n", (F.exp((F.col("bin") + 0.5) / BINS) / CHI2_MEDIAN).alias("scale")), "cell"), "raw")
    near = met(rows, raw, ["cell"], size).filter(distance() <= NEAR * F.col("scale"))
    return scratch.write(moments(near, ["cell", "n"]), "estimates"), size


def shrunk(found: DataFrame) -> DataFrame:
    """(lang, source, m, w): each group's estimate, shrunk towards its language's, that towards all
    documents', with its covariance's factor."""
    def level(k: int, *names: str) -> DataFrame:
        return found.filter(F.col("cell.level") == k).select(
            F.lit(0).alias("any"), *[F.col(f"cell.{c}").alias(c) for c in names], "n", *spreads())

    def towards(own: DataFrame, wider: DataFrame, same: Column, keep: list[str]) -> DataFrame:
        share = F.col("a.n") / (F.col("a.n") + SHRINK)
        return own.alias("a").join(wider.alias("b"), same).select(*[F.col(f"a.{c}").alias(c) for c in ("any", "n", *keep)], *[
            (share * F.col(f"a.{c}") + (1 - share) * F.col(f"b.{c}")).alias(c) for c in spreads()])

    langs = towards(level(2, "lang"), level(3), F.col("a.any") == F.col("b.any"), ["lang"])
    groups = towards(level(1, "lang", "source"), langs, F.col("a.lang").eqNullSafe(F.col("b.lang")), ["lang", "source"])
    return factored(groups, ["lang", "source"]).drop("det")


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept, and distance (null if the base rules fail) of
    every row of ``docs``. The texts are read once; all later steps read the written statistics."""
    scratch = Scratch(docs.sparkSession, "outliers")
    counted = statistics(docs, ["doc_id", "lang", "source"]).withColumn("base_failed", failing())
    counted = scratch.write(counted.select("*", *[t.alias(x) for t, x in zip(transformed(), xs(), strict=True)]), "statistics")
    rows = counted.filter(~F.col("base_failed")).select(F.explode(cells()).alias("cell"), *xs())
    found, size = estimates(rows, scratch)
    by_group = scratch.write(shrunk(found), "by_group")
    passed = counted.select("*", F.when(~F.col("base_failed"), F.element_at(cells(), 1)).alias("cell"))
    own = by_group.select(F.struct(F.lit(1).alias("level"), F.col("lang"), F.col("source")).alias("cell"), *fit())
    near = met(passed.filter(~F.col("base_failed")), own, ["cell"], size).select(
        *counted.columns, (distance() / NEAR_FACTOR).alias("distance"))
    judged = near.unionByName(counted.filter("base_failed").withColumn("distance", F.lit(None).cast("double")))
    kept = ~F.col("base_failed") & (F.col("distance") <= CUTOFF)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         F.coalesce(kept, F.lit(False)).alias("kept"), "distance")
