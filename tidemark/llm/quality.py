"""Quality rules: robust multivariate outliers among the documents of a language and source.

Every document gets a vector of transformed text statistics. For each (language, source) a minimum covariance
determinant estimate of location and scatter is found by concentration steps: keep the fraction of rows with the
smallest Mahalanobis distances, estimate again from those, repeat until the determinant stays; then reweight. Rows far
from the estimate are rejected.

Only DataFrame functions are used. One pass over the texts makes the statistics; the concentration steps run over
that narrow table, each as two grouped aggregations whose partial results are combined before any shuffle, so a
source with a third of all rows is no heavier for one task than another.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RUN, text_of, written

FEATURES = ("log_word_length", "symbol_share", "duplicate_line_share", "repeated_word_share")
#: Added to the scatter as standard deviations. At the default level, where the estimate has no scatter of its own, a row
#: goes for one feature alone: words 1.7 times as long, 8 % symbols, 35 % duplicate lines, 24 % repeated words. One line
#: in three repeated is chance in short texts; with floors of 0.02 that alone would reject them.
TOLERANCE = (0.10, 0.05, 0.11, 0.09)
#: Groups whose figures, some hundred bytes each, are sent to all tasks; and parts of a group beyond.
MOST_FIGURES, SALTS = 50_000, 16
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def chi2_cdf(x: float, dof: int) -> float:
    """For an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dof // 2))


def chi2_quantile(p: float, dof: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, dof) < p else (low, mid)
    return high


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` without its text, with the statistics and the number of lines that hold a word (`n_lines`).

    A null or empty text has zero everywhere. `n_repeat_words` counts the words inside any window of three words
    found twice or more in the text: the windows' hashes are sorted together with their positions, equal neighbours
    are confirmed on the full 64-bit hash, and the covered positions are added up. All of it stays in the row.
    """
    others = [c for c in docs.columns if c != text_col]
    rows = docs.select(*others, text_of(text_col).alias("_t"))
    rows = rows.select(
        *others,
        F.char_length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.array_remove(F.split("_t", SPACE_RUN), "").alias("_w"),
        F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"),
    )
    rows = rows.select(
        *others,
        "n_symbols",
        F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size("_w") >= 3,
            F.transform(
                F.sequence(F.lit(0), F.size("_w") - 3),
                lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)),
            ),
        )
        .otherwise(F.array().cast("array<bigint>"))
        .alias("_h"),
        F.length(F.bin(F.size("_w"))).alias("_bits"),
    )
    kept = [*others, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    mask = F.expr("shiftleft(1L, _bits) - 1L")
    rows = rows.select(
        *kept, "_h", "_bits", mask.alias("_mask"),
        F.sort_array(F.transform("_h", lambda x, i: x.bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long")))).alias("_s"),
    )
    near = lambda x, k, d: F.expr("_bits").isNotNull() & (x.bitwiseXOR(F.get("_s", k + d)) <= F.col("_mask")) & (x.bitwiseXOR(F.get("_s", k + d)) >= 0)
    rows = rows.select(
        *kept, "_h",
        F.transform(
            F.filter("_s", lambda x, k: F.coalesce(near(x, k, 1), F.lit(False)) | ((k > 0) & F.coalesce(near(x, k, -1), F.lit(False)))),
            lambda x: x.bitwiseAND(F.col("_mask")).cast("int"),
        ).alias("_c"),
    )
    rows = rows.select(
        *kept,
        F.sort_array(F.transform("_c", lambda i: F.struct(F.get("_h", i).alias("h"), i.alias("i")))).alias("_p"),
    )
    same = lambda x, k, d: F.coalesce(x["h"] == F.get("_p", k + d)["h"], F.lit(False))
    rows = rows.select(
        *kept,
        F.sort_array(
            F.transform(F.filter("_p", lambda x, k: same(x, k, 1) | ((k > 0) & same(x, k, -1))), lambda x: x["i"])
        ).alias("_q"),
    )
    covered = F.transform("_q", lambda i, k: F.least(F.lit(3), F.coalesce(F.get("_q", k + 1) - i, F.lit(3))))
    return rows.select(
        *kept,
        F.when(F.size("_q") == 0, F.lit(0).cast("long"))
        .otherwise(F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x))
        .alias("n_repeat_words"),
    )


def feature_columns() -> list[Column]:
    share = lambda a, b: F.sqrt(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)))
    return [
        F.ln(F.greatest(F.coalesce(F.try_divide(F.col("word_chars"), F.col("n_words")), F.lit(1.0)), F.lit(1.0))).alias("x0"),
        share("n_symbols", "word_chars").alias("x1"),
        share("n_dup_lines", "n_lines").alias("x2"),
        share("n_repeat_words", "n_words").alias("x3"),
    ]


def _distance(p: int, of: str = "") -> Column:
    """Squared Mahalanobis distance of x0.. from m0.. by the Cholesky factor l00, l10, .., fields of the struct `of` if named."""
    figure = lambda c: F.col(f"{of}.{c}" if of else c)
    ys: list[Column] = []
    for i in range(p):
        y = F.col(f"x{i}") - figure(f"m{i}")
        for j in range(i):
            y = y - figure(f"l{i}{j}") * ys[j]
        ys.append(y / figure(f"l{i}{i}"))
    return sum((y * y for y in ys[1:]), ys[0] * ys[0])


def _factored(moments: DataFrame, keys: list[str], p: int, scale: float, floors: tuple[float, ...]) -> DataFrame:
    """Cholesky factor and log determinant of scale * c + diag(floors ** 2), one column at a time."""
    df = moments
    for i in range(p):
        for j in range(i + 1):
            v = F.col(f"c{i}{j}") * F.lit(scale) + (F.lit(floors[i] ** 2) if i == j else F.lit(0.0))
            for k in range(j):
                v = v - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            df = df.withColumn(f"l{i}{j}", F.sqrt(F.greatest(v, F.lit(1e-12))) if i == j else v / F.col(f"l{j}{j}"))
    logdet = sum((F.ln(F.col(f"l{i}{i}")) for i in range(1, p)), F.ln(F.col("l00"))) * 2
    return df.select(*keys, *(f"m{i}" for i in range(p)), *(f"l{i}{j}" for i in range(p) for j in range(i + 1)), logdet.alias("logdet"))


def _moments(df: DataFrame, keys: list[str], p: int) -> DataFrame:
    return df.groupBy(*keys).agg(
        *(F.avg(f"x{i}").alias(f"m{i}") for i in range(p)),
        *(F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}{j}") for i in range(p) for j in range(i + 1)),
    )


def beside(rows: DataFrame, figures: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """`rows` with the figures of their group, one row each. Figures of up to MOST_FIGURES groups are sent to all tasks, so no
    group is dealt to one; of more, groups are many and each dealt in SALTS parts."""
    if figures.count() <= MOST_FIGURES:
        return rows.join(F.broadcast(figures), keys, how)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    salted = rows.withColumn("_salt", F.floor(F.rand(7) * SALTS).cast("int"))
    return salted.join(figures.select("*", salts), [*keys, "_salt"], how).drop("_salt")


def mcd_estimates(points: DataFrame, keys: list[str], p: int, *, fraction: float = 0.75, steps: int = 10, floors: tuple[float, ...], accuracy: int = 10_000, reweight: float = 0.975) -> DataFrame:
    """Minimum covariance determinant estimates of x0.. by `keys` (never null), as means and Cholesky factors.

    Two deterministic starts from medians and median absolute deviations, by Euclidean and by maximum distance of the
    standardised values, of which the half of smaller distances is used. Concentration steps follow until no determinant
    falls by more than a thousandth, `steps` at most; the start of smaller determinant wins, ties by the first. At last the
    estimate is taken again from all rows within the chi-square quantile `reweight` of it. Kept fractions are cut by an
    approximate percentile of bounded size. `floors` keep the scatter regular where a feature is constant.
    """
    cut = lambda c, share: F.percentile_approx(c, share, accuracy)
    xs = [f"x{i}" for i in range(p)]
    med = written(points.groupBy(*keys).agg(*(cut(x, 0.5).alias(f"m{i}") for i, x in enumerate(xs))), "mcd-start")
    dev = beside(points, med, keys)
    mad = written(dev.groupBy(*keys).agg(*(F.first(f"m{i}").alias(f"m{i}") for i in range(p)), *(cut(F.abs(F.col(f"x{i}") - F.col(f"m{i}")), 0.5).alias(f"a{i}") for i in range(p))), "mcd-start")
    z = [F.abs(F.col(f"x{i}") - F.col(f"m{i}")) / F.sqrt(F.pow(F.col(f"a{i}") * 1.4826, 2) + floors[i] ** 2) for i in range(p)]
    starts = ("s", "t")
    distances = {"s": sum((v * v for v in z[1:]), z[0] * z[0]), "t": F.greatest(*z)}
    scored = beside(points, mad, keys).select(*keys, *xs, *(distances[t].alias(f"d_{t}") for t in starts))
    consistency = lambda share: share / chi2_cdf(chi2_quantile(share, p), p + 2)

    def moments(rows: DataFrame, share: float) -> DataFrame:
        """Both starts' factors from the rows within the share of smallest distances, in one row a group."""
        limits = written(rows.groupBy(*keys).agg(*(cut(f"d_{t}", share).alias(f"cut_{t}") for t in starts)), "mcd-cut")
        near = beside(rows, limits, keys)
        own = lambda t, c: F.when(F.col(f"d_{t}") <= F.col(f"cut_{t}"), F.col(c))
        sums = near.groupBy(*keys).agg(*(c for t in starts for c in (*(F.avg(own(t, x)).alias(f"{t}m{i}") for i, x in enumerate(xs)), *(F.covar_pop(own(t, xs[i]), own(t, xs[j])).alias(f"{t}c{i}{j}") for i in range(p) for j in range(i + 1)))))
        one = lambda t: _factored(sums.select(*keys, *(F.col(f"{t}m{i}").alias(f"m{i}") for i in range(p)), *(F.col(f"{t}c{i}{j}").alias(f"c{i}{j}") for i in range(p) for j in range(i + 1))), keys, p, consistency(share), floors)
        s, t = (one(t).select(*keys, F.struct(*(c for c in one(t).columns if c not in keys)).alias(t)) for t in starts)
        return written(s.join(t, keys), "mcd-step")

    def placed(estimate: DataFrame) -> DataFrame:
        rows = beside(points, estimate, keys)
        return rows.select(*keys, *xs, *(_distance(p, t).alias(f"d_{t}") for t in starts))

    estimate = moments(scored, 0.5)
    for _ in range(steps):
        better = moments(placed(estimate), fraction)
        falls = better.select(*keys, *(F.col(f"{t}.logdet").alias(f"new_{t}") for t in starts)).join(estimate, keys)
        done = falls.agg(F.max(F.greatest(*(F.col(f"{t}.logdet") - F.col(f"new_{t}") for t in starts))).alias("fall")).first()["fall"]
        estimate = better
        if done is None or 0 <= done <= 1e-3:
            break
    best = estimate.select(*keys, F.when(F.col("t.logdet") < F.col("s.logdet"), F.col("t")).otherwise(F.col("s")).alias("s"))
    near = beside(points, written(best, "mcd-best"), keys).where(_distance(p, "s") <= chi2_quantile(reweight, p))
    return _factored(_moments(near, keys, p), keys, p, consistency(reweight), floors).drop("logdet")


def robust_outliers(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    fraction: float = 0.75, steps: int = 10, level: float = 1 - 1e-5, min_group: int = 50, min_words: int = 50, max_repeat_percent: int = 50,
) -> DataFrame:
    """Statistics, `base_failed`, squared `distance` and `kept` for every row of `docs` (its text column left out).

    A row fails the base rule when it has fewer than `min_words` words or more than `max_repeat_percent` percent
    repeated words; null and empty texts therefore fail. Estimates use the rows that pass it, by language and source;
    null is a language or source of its own, and groups of under `min_group` rows are pooled by language. `kept`
    needs a distance within the chi-square quantile `level`. Repeated rows count each; an empty table gives no rows.
    """
    p = len(FEATURES)
    others = [c for c in docs.columns if c != text_col]
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("_row"), F.col(f"`{lang_col}`").cast("string").alias("_lang"), F.col(f"`{source_col}`").cast("string").alias("_source"), F.col(f"`{text_col}`").alias("_text"))
    stats = text_statistics(own, "_text").withColumn(
        "base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    )
    tag = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))  # noqa: E731  null apart from every string
    stats = written(stats.select("*", *feature_columns(), tag("_lang").alias("_g"), tag("_source").alias("_h")), "quality")
    passed = stats.where(~F.col("base_failed"))
    sizes = passed.groupBy("_g", "_h").agg(F.count("*").alias("_n"))
    pooled = sizes.select("_g", "_h", F.when(F.col("_n") >= min_group, F.col("_h")).otherwise(F.lit("pooled")).alias("_k"))
    pooled = written(pooled, "quality-groups")
    xs = [f"x{i}" for i in range(p)]
    points = beside(passed, pooled, ["_g", "_h"]).select("_g", "_k", *xs)
    estimate = written(mcd_estimates(points, ["_g", "_k"], p, fraction=fraction, steps=steps, floors=TOLERANCE), "mcd")
    scored = beside(beside(stats, pooled, ["_g", "_h"], "left"), estimate, ["_g", "_k"], "left")
    scored = scored.withColumn("distance", F.when(~F.col("base_failed"), _distance(p)))
    verdict = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= F.lit(chi2_quantile(level, p)))
    return scored.select("_row", *STATISTICS, "n_lines", "base_failed", "distance", verdict.alias("kept"))


def quality_query(docs: DataFrame) -> DataFrame:
    out = robust_outliers(docs.select("doc_id", "text", "lang", "source"))
    return out.select("_row.doc_id", *STATISTICS, "base_failed", "kept", F.col("distance"))
