"""Quality rules by robust multivariate outliers (operator 13), DataFrame functions only.

1. Statistics of every whole text are expressions of its row: no words are exploded and
   nothing is shuffled. Windows of three words are compared by hash first; texts in which two
   hashes agree compare the words of just these windows.
2. Texts that fail a base rule are rejected. The others get a vector of transformed
   statistics (FEATURES) and belong to the group of their language and source; groups of
   fewer than LEAST_ROWS share one group.
3. Each group gets a minimum-covariance-determinant estimate of its centre and covariance.
   From several starts, concentration steps fit the ALPHA share of rows that are nearest by
   the last estimate. A step is one aggregate by (group, start, bin of the distance), so a
   hot group combines on the map side; running totals over the bins, a bounded number, give
   the moments of the nearest rows. Of the starts the least determinant wins, and one
   reweighting step over all rows within the 97.5 % distance follows.
4. A text is kept if its Mahalanobis distance is within the CUT quantile of chi-square.

Variances have a floor by feature: most texts have no symbol or repeated line at all, and a
covariance of zero would reject every text that has one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.sources.scratch import shared_dir

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 3
BASE_WORDS, BASE_REPEAT_PERCENT = 50, 50
#: Share of a group's rows that a concentration step fits, and its least number of rows.
ALPHA, LEAST_ROWS = 0.75, 50
STEPS = 4
#: Bins of the squared distance for each doubling.
BINS = 8
#: Tasks over which the rows of one group meet its estimate.
SALTS = 32
#: Quantiles of the reweighting step and of the verdict.
NEAR, CUT = 0.975, 0.9999999
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: name, transformed statistic, least standard deviation
FEATURES = [
    ("x0", "log1p(n_words)", 0.5),
    ("x1", "ln(word_chars / n_words)", 0.1),
    ("x2", "log1p(1000 * n_symbols / word_chars)", 0.7),
    ("x3", "log1p(n_dup_lines)", 0.5),
    ("x4", "sqrt(n_repeat_words / n_words)", 0.15),
]
P = len(FEATURES)
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def bind(value: Column, then) -> Column:
    """then(value) with the value computed once, however often `then` names it."""
    return F.get(F.transform(F.array(value), then), 0)


def repeated_words(words: Column, size: int = WINDOW) -> Column:
    """How many words lie in windows of `size` words that the array holds more than once."""
    def from_hashes(hashes: Column) -> Column:
        windows = F.slice(
            F.transform(hashes, lambda x, i: F.xxhash64(x, *[F.get(hashes, i + k) for k in range(1, size)])),
            1, F.size(hashes) - (size - 1))
        return bind(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), from_windows(w)).otherwise(0))

    def from_windows(windows: Column) -> Column:
        # the upper half of the hash and the place in one number, sorted as numbers
        packed = F.transform(windows, lambda x, i: x.bitwiseAND(F.lit(-1 << 32)).bitwiseOR(i.cast("long")))
        return bind(F.sort_array(packed), from_sorted)

    def from_sorted(packed: Column) -> Column:
        def half(x: Column) -> Column:
            return F.shiftright(x, 32)

        alike = F.filter(packed, lambda x, i: (
            (half(x) == half(F.get(packed, i - 1))) | (half(x) == half(F.get(packed, i + 1)))))
        shown = F.transform(alike, lambda x: bind(x.bitwiseAND(F.lit((1 << 32) - 1)).cast("int"), lambda at: F.struct(
            F.concat_ws(" ", *[F.get(words, at + k) for k in range(size)]).alias("text"), at.alias("at"))))
        return bind(F.sort_array(shown), from_shown)

    def from_shown(shown: Column) -> Column:
        same = F.filter(shown, lambda x, i: (
            (x["text"] == F.get(shown, i - 1)["text"]) | (x["text"] == F.get(shown, i + 1)["text"])))
        return bind(F.sort_array(F.transform(same, lambda x: x["at"])), lambda at: F.aggregate(
            F.transform(at, lambda x, i: F.least(F.lit(size), F.coalesce(F.get(at, i + 1) - x, F.lit(size)))),
            F.lit(0), lambda total, x: total + x))

    return F.when(F.size(words) >= size, bind(F.transform(words, lambda w: F.xxhash64(w)), from_hashes)).otherwise(0)


def text_stats(text: Column) -> Column:
    """A struct of STATS; a null text counts as empty."""
    def from_words(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(words).cast("long").alias("n_repeat_words"))

    return bind(F.array_remove(F.split(text, SPACE), ""), from_words)


def with_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang, source, STATS and base_failed for every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    few = F.col("n_words") < BASE_WORDS
    many = 100 * F.col("n_repeat_words") > BASE_REPEAT_PERCENT * F.col("n_words")
    return (docs.select(F.col(id_col).alias("doc_id"), "lang", "source", text_stats(text).alias("stats"))
            .select("doc_id", "lang", "source", *[F.col(f"stats.{c}").alias(c) for c in STATS])
            .withColumns({"base_failed": few | many, "salt": F.pmod(F.xxhash64("doc_id", "n_words"), F.lit(SALTS)).cast("int")}))


def met(rows: DataFrame, by_group: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows joined with one row per group, salted, so no group's rows meet in one task."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    return rows.join(by_group.select("*", salts), [key, "salt"], how)


def chi2_cdf(x: float, p: int) -> float:
    """The distribution function of chi-square with p degrees of freedom, by its power series."""
    a, y, term, total, k = p / 2, x / 2, 1.0, 1.0, 0
    while term > 1e-17 * total:
        k += 1
        term *= y / (a + k)
        total += term
    return total * math.exp(a * math.log(y) - y - math.lgamma(a + 1)) if y > 0 else 0.0


def chi2_quantile(q: float, p: int) -> float:
    lo, hi = 0.0, 400.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, p) < q else (lo, mid)
    return hi


def consistency(share: float, p: int) -> float:
    """By how much a covariance of the nearest share of normal rows is too small."""
    return share / chi2_cdf(chi2_quantile(share, p), p + 2)


def moments(weight: Column | None = None) -> list[Column]:
    def total(x: Column) -> Column:
        return F.sum(x if weight is None else F.when(weight, x))

    x = [F.col(name) for name, _, _ in FEATURES]
    return [total(F.lit(1)).alias("m"), *[total(x[i]).alias(f"s{i}") for i in range(P)],
            *[total(x[i] * x[j]).alias(f"s{i}_{j}") for i, j in PAIRS]]


MOMENTS = ["m", *[f"s{i}" for i in range(P)], *[f"s{i}_{j}" for i, j in PAIRS]]
SHAPE = [*[f"c{i}" for i in range(P)], *[f"l{i}_{j}" for i, j in PAIRS], "logdet"]


def factored(df: DataFrame, factor: float = 1.0) -> DataFrame:
    """The centre c, the lower triangle l of the covariance's Cholesky factor and its log
    determinant, from moments; `factor` times the covariance, plus the floors."""
    df = df.withColumns({f"c{i}": F.col(f"s{i}") / F.col("m") for i in range(P)})
    for i in range(P):
        for j in range(i + 1):
            own = factor * (F.col(f"s{i}_{j}") / F.col("m") - F.col(f"c{i}") * F.col(f"c{j}"))
            own = F.greatest(own, F.lit(0.0)) + F.lit(FEATURES[i][2] ** 2) if i == j else own
            for k in range(j):
                own = own - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
            df = df.withColumn(f"l{i}_{j}", F.sqrt(F.greatest(own, F.lit(1e-9))) if i == j else own / F.col(f"l{j}_{j}"))
    return df.withColumn("logdet", 2 * sum(F.log(F.col(f"l{i}_{i}")) for i in range(P)))


def with_distance(df: DataFrame, name: str = "d2") -> DataFrame:
    """The squared Mahalanobis distance, by forward substitution."""
    for i in range(P):
        own = F.col(FEATURES[i][0]) - F.col(f"c{i}")
        for k in range(i):
            own = own - F.col(f"l{i}_{k}") * F.col(f"y{k}")
        df = df.withColumn(f"y{i}", own / F.col(f"l{i}_{i}"))
    return df.withColumn(name, sum(F.col(f"y{i}") * F.col(f"y{i}") for i in range(P)))


def stored(df: DataFrame, purpose: str) -> DataFrame:
    folder = shared_dir(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def first_estimates(rows: DataFrame) -> DataFrame:
    """Starts by group: all rows, two halves by a hash of the vector, medians with spreads."""
    x = [F.col(name) for name, _, _ in FEATURES]
    half = F.pmod(F.xxhash64(*x), F.lit(2))
    starts = []
    for start, weight in ((0, None), (1, half == 0), (2, half == 1)):
        starts.append(factored(rows.groupBy("g").agg(*moments(weight))).where("m > 0")
                      .select("g", F.lit(start).alias("start"), *SHAPE))
    quartiles = rows.groupBy("g").agg(*[
        F.percentile_approx(x[i], F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(1000)).alias(f"q{i}") for i in range(P)])
    spread = [F.sqrt(((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349) ** 2 + F.lit(FEATURES[i][2] ** 2)) for i in range(P)]
    starts.append(quartiles.select(
        "g", F.lit(3).alias("start"), *[F.col(f"q{i}")[1].alias(f"c{i}") for i in range(P)],
        *[(spread[i] if i == j else F.lit(0.0)).alias(f"l{i}_{j}") for i, j in PAIRS], F.lit(0.0).alias("logdet")))
    found = starts[0]
    for other in starts[1:]:
        found = found.union(other)
    return found


def concentrate(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """One concentration step for every group and start."""
    placed = with_distance(met(rows, estimates, "g"))
    binned = placed.groupBy("g", "start", F.floor(F.log2(F.col("d2") + 1e-9) * BINS).alias("bin")).agg(*moments())
    group = Window.partitionBy("g", "start")
    upto = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = binned.select("g", "start", F.col("m").alias("own"), F.ceil(F.sum("m").over(group) * ALPHA).alias("least"),
                           *[F.sum(c).over(upto).alias(c) for c in MOMENTS])
    nearest = summed.where((F.col("m") >= F.col("least")) & (F.col("m") - F.col("own") < F.col("least")))
    return factored(nearest, consistency(ALPHA, P)).select("g", "start", *SHAPE)


def estimate(rows: DataFrame) -> DataFrame:
    """g and SHAPE of every group from rows (g, features)."""
    found = stored(first_estimates(rows), "outlier-start")
    for step in range(STEPS):
        found = stored(concentrate(rows, found), f"outlier-step-{step}")
    best = found.groupBy("g").agg(F.min_by(F.struct(*SHAPE), F.struct("logdet", "start")).alias("best")).select("g", "best.*")
    near = with_distance(met(rows, best, "g")).where(F.col("d2") <= chi2_quantile(NEAR, P))
    return stored(factored(near.groupBy("g").agg(*moments()), consistency(NEAR, P)).select("g", *SHAPE), "outlier-shape")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang, source, STATS, base_failed, distance (squared, null if none), kept.

    Null and empty texts, and texts of white space, have no words and fail the base rules.
    Null languages and sources are values like others. Rows that repeat an id are judged by
    their own texts. Without LEAST_ROWS usable rows in the shared group, its rows are kept.
    Other columns are not read; an empty table gives an empty result.
    """
    stats = stored(with_stats(docs, id_col, text_col), "outlier-stats")
    usable = stats.where(~F.col("base_failed")).select(
        "salt", F.to_json(F.struct("lang", "source")).alias("own"), *[F.expr(x).alias(name) for name, x, _ in FEATURES])
    large = stored(usable.groupBy("own").agg(F.count("*").alias("rows")).where(F.col("rows") >= LEAST_ROWS)
                   .select("own", F.col("own").alias("g")), "outlier-groups")
    rows = stored(met(usable, large, "own", "left").select(
        "salt", F.coalesce("g", F.lit("")).alias("g"), *[name for name, _, _ in FEATURES]), "outlier-rows")
    shapes = estimate(rows)
    enough = rows.groupBy("g").agg(F.count("*").alias("rows")).where(F.col("rows") >= LEAST_ROWS).select("g")
    shapes = shapes.join(enough, "g", "left_semi")
    vectors = stats.withColumn("own", F.to_json(F.struct("lang", "source"))).withColumns(
        {name: F.when(~F.col("base_failed"), F.expr(x)) for name, x, _ in FEATURES})
    named = met(vectors, large, "own", "left").withColumn("g", F.coalesce("g", F.lit("")))
    placed = with_distance(met(named, shapes, "g", "left"))
    distance = F.when(~F.col("base_failed"), F.col("d2"))
    return placed.select(
        "doc_id", "lang", "source", *STATS, "base_failed", distance.alias("distance"),
        (~F.col("base_failed") & F.coalesce(F.col("d2") <= chi2_quantile(CUT, P), F.lit(True))).alias("kept"))
