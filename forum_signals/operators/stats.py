"""Statistics over the contingency counts: intervals, tests, odds ratios, correlation.

Totals and baselines are one-row aggregates. Ranks over all rows come from buckets in the order of the values: a window ranks
the rows within a bucket, and one row tells how many stand in earlier ones. So no window takes all rows into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forum_signals.functions.special import (
    chi_square_p_value,
    normal_p_value,
    profile_limits,
    spearman_p_value,
)

PAIRWISE_COLUMNS = (
    "topic", "n_miscomm", "n_no_miscomm", "n_total", "p_value", "estimate", "ci_lower", "ci_upper", "p_adj",
    "significant", "direction",
)

# Normal quantiles used by the published tables.
Z_DESCRIPTIVE = 1.96
Z_95 = 1.959963984540054


def descriptive(contingency: DataFrame) -> DataFrame:
    """Rates with Wald 95 % limits, largest topics first."""
    p = F.col("n_miscomm") / F.col("n_total")
    half = Z_DESCRIPTIVE * F.sqrt(F.col("miscomm_rate") * (1 - F.col("miscomm_rate")) / F.col("n_total"))
    return (
        contingency.withColumn("miscomm_rate", p)
        .withColumn("ci_lower", F.col("miscomm_rate") - half)
        .withColumn("ci_upper", F.col("miscomm_rate") + half)
        .orderBy(F.desc("n_total"), "topic")
    )


def _cell(observed: Column, expected: Column) -> Column:
    return F.try_divide(F.pow(observed - expected, F.lit(2.0)), expected)


def _strength(statistic: Column, total: Column, rows: Column, columns: Column) -> Column:
    return F.sqrt(F.try_divide(statistic, total * (F.least(rows, columns) - 1)))


def homogeneity_test(contingency: DataFrame, by: str | None = None) -> DataFrame:
    """Chi-square test that all topics share one rate, with Cramer's V; per ``by`` value if given."""
    keys = [by] if by else []
    if by:
        everyone = Window.partitionBy(by)
        flagged = F.sum("n_miscomm").over(everyone) / F.sum("n_total").over(everyone)
    else:
        flagged = contingency.agg(F.sum("n_miscomm") / F.sum("n_total")).scalar()
    cells = contingency.withColumn("_rate", flagged).withColumn(
        "_chi2",
        _cell(F.col("n_miscomm"), F.col("n_total") * F.col("_rate"))
        + _cell(F.col("n_no_miscomm"), F.col("n_total") * (1 - F.col("_rate"))),
    )
    summed = cells.groupBy(*keys).agg(
        F.sum("_chi2").alias("statistic"),
        (F.count("*") - 1).cast("int").alias("df"),
        F.sum("n_total").alias("_n"),
        F.min(F.col("_chi2").isNotNull()).alias("_valid"),
    )
    statistic = F.when(F.col("_valid"), F.col("statistic"))
    return summed.withColumn("statistic", statistic).select(
        *keys,
        F.lit("chi_square").alias("test"),
        "statistic",
        "df",
        chi_square_p_value("statistic", "df").alias("p_value"),
        _strength(F.col("statistic"), F.col("_n"), F.col("df") + 1, F.lit(2)).alias("cramers_v"),
    )


def profile_test(contingency_by_category: DataFrame, track: str = "tags") -> DataFrame:
    """Chi-square test of the topic x category table of flagged counts."""
    cells = contingency_by_category.select("topic", "category", F.col("n_miscomm").alias("n"))
    row_total = F.sum("n").over(Window.partitionBy("topic"))
    column_total = F.sum("n").over(Window.partitionBy("category"))
    total = cells.agg(F.sum("n")).scalar()
    cells = cells.withColumn("_expected", row_total.cast("double") * column_total / total)
    summed = cells.withColumn("_chi2", _cell(F.col("n"), F.col("_expected"))).agg(
        F.sum("_chi2").alias("chi2"),
        F.sum("n").alias("_n"),
        F.count_distinct("topic").cast("int").alias("n_topics"),
        F.count_distinct("category").cast("int").alias("n_cats"),
        F.min(F.col("_chi2").isNotNull()).alias("_valid"),
    )
    df = (F.col("n_topics") - 1) * (F.col("n_cats") - 1)
    return (
        summed.withColumn("chi2", F.when(F.col("_valid"), F.col("chi2")))
        .withColumn("df", df)
        .select(
            F.lit(track).alias("track"),
            "chi2",
            "df",
            chi_square_p_value("chi2", "df").alias("p_value"),
            _strength(F.col("chi2"), F.col("_n"), F.col("n_topics"), F.col("n_cats")).alias("cramers_v"),
            "n_topics",
            "n_cats",
        )
    )


def _earlier_rows(rows: DataFrame, bucket: str) -> Column:
    """How many rows are in lower buckets, as one map from bucket to number; a null bucket does not count."""
    sizes = rows.groupBy(bucket).agg(F.count("*").alias("n"))
    # null buckets are left out after the grouping: as a filter the condition would be planned with all that the bucket is made of
    listed = sizes.agg(F.sort_array(F.collect_list(F.when(F.col(bucket).isNotNull(), F.struct(bucket, "n")))).alias("sizes"))

    def earlier(size: Column, place: Column) -> Column:
        lower = F.slice("sizes", F.lit(1), place)
        return F.struct(size[bucket], F.aggregate(lower, F.lit(0).cast("long"), lambda total, x: total + x["n"]))

    return listed.select(F.map_from_entries(F.transform("sizes", earlier))).scalar()


def _p_bucket(p: Column) -> Column:
    """A p-value's quarter of a power of two: at most 4,402 buckets in ascending order."""
    return F.when(p > 0, F.greatest(F.lit(-4400), F.floor(F.log2(p) * 4).cast("int"))).when(p.isNotNull(), F.lit(-4401))


def adjust_p_values(tests: DataFrame, p: str = "p_value", family: str | None = None) -> DataFrame:
    """Benjamini-Hochberg ``p_adj`` within each family of tests; a missing p-value is no test and stays missing."""
    if family:
        share = Window.partitionBy(family)
        ranked = tests.withColumn("_rank", F.row_number().over(share.orderBy(F.asc_nulls_last(p))))
        size = F.count(p).over(share)
    else:
        tests = tests.withColumn("_bucket", _p_bucket(F.col(p)))
        share = Window.partitionBy("_bucket")
        within = F.row_number().over(share.orderBy(p))
        earlier = F.try_element_at(_earlier_rows(tests, "_bucket"), F.col("_bucket"))
        ranked = tests.withColumn("_rank", F.when(F.col(p).isNotNull(), earlier + within))
        size = tests.agg(F.count(p)).scalar()
    scaled = ranked.withColumn("_scaled", F.least(F.lit(1.0), F.col(p) * size / F.col("_rank")))
    scaled = scaled.withColumn("_scaled", F.when(F.col(p).isNotNull(), F.col("_scaled")))
    later = share.orderBy("_rank").rowsBetween(0, Window.unboundedFollowing)
    adjusted = scaled.withColumn("p_adj", F.min("_scaled").over(later))
    if not family:
        adjusted = adjusted.withColumn("p_adj", F.least("p_adj", F.try_element_at(_later_minimum(scaled), F.col("_bucket"))))
    return adjusted.drop("_rank", "_scaled", "_bucket")


def _later_minimum(scaled: DataFrame) -> Column:
    """The least ``_scaled`` in higher buckets, as one map from bucket to number."""
    lows = scaled.groupBy("_bucket").agg(F.min("_scaled").alias("low"))
    listed = lows.agg(F.sort_array(F.collect_list(F.when(F.col("_bucket").isNotNull(), F.struct("_bucket", "low")))).alias("lows"))

    def later(low: Column, place: Column) -> Column:
        higher = F.slice("lows", place + 2, F.greatest(F.size("lows") - place - 1, F.lit(0)))
        return F.struct(low["_bucket"], F.array_min(F.transform(higher, lambda x: x["low"])))

    return listed.select(F.map_from_entries(F.transform("lows", later))).scalar()


def label_direction(tests: DataFrame, alpha: float) -> DataFrame:
    """``significant`` and whether the topic lies above or below the baseline."""
    direction = F.when(F.col("z") > 0, "above_baseline").otherwise("below_baseline")
    return tests.withColumn("significant", F.col("p_adj") < alpha).withColumn(
        "direction", F.when(F.col("significant"), direction).otherwise("not_significant")
    )


def proportion_test(contingency: DataFrame) -> DataFrame:
    """Each topic's rate against a baseline given as ``base_miscomm, base_total`` columns.

    Two-sample test of equal proportions without continuity correction; the limits are those
    of the difference of rates.
    """
    a, n = F.col("n_miscomm"), F.col("n_total")
    a0, n0 = F.col("base_miscomm"), F.col("base_total")
    pooled = (a + a0) / (n + n0)
    p, p0 = F.col("estimate"), F.col("_p0")
    error = F.sqrt(p * (1 - p) / n + p0 * (1 - p0) / n0)
    return (
        contingency.withColumn("estimate", a / n)
        .withColumn("_p0", a0 / n0)
        .withColumn("z", F.try_divide(p - p0, F.sqrt(pooled * (1 - pooled) * (1 / n + 1 / n0))))
        .withColumn("p_value", normal_p_value("z"))
        .withColumn("ci_lower", F.greatest(F.lit(-1.0), p - p0 - Z_95 * error))
        .withColumn("ci_upper", F.least(F.lit(1.0), p - p0 + Z_95 * error))
        .drop("_p0")
    )


def pairwise(contingency: DataFrame, global_rates: DataFrame, alpha: float) -> DataFrame:
    """All topics against the global rate, adjusted and labelled, clearest first."""
    base = global_rates.select(F.struct("total_miscomm", "total_questions")).scalar()
    based = contingency.withColumn("_base", base).select(
        *contingency.columns,
        F.col("_base.total_miscomm").alias("base_miscomm"),
        F.col("_base.total_questions").alias("base_total"),
    )
    tests = label_direction(adjust_p_values(proportion_test(based)), alpha)
    return tests.select(*PAIRWISE_COLUMNS, "z").orderBy("p_adj", F.desc("n_total"), "topic")


def pairwise_by_category(contingency: DataFrame, global_rates: DataFrame, alpha: float) -> DataFrame:
    """The same within each category, against that category's global rate."""
    base = global_rates.select(
        "category", F.col("total_miscomm").alias("base_miscomm"), F.col("total_questions").alias("base_total")
    )
    tests = adjust_p_values(proportion_test(contingency.join(base, "category")), family="category")
    return (
        label_direction(tests, alpha)
        .select("category", *PAIRWISE_COLUMNS, "z")
        .orderBy("category", "p_adj", F.desc("n_total"), "topic")
    )


def odds_ratios(contingency: DataFrame) -> DataFrame:
    """Logistic regression of the flag on the topic, in closed form (the model is saturated).

    The baseline is the largest topic; its own row is the intercept.
    """
    largest = F.min_by(F.struct("topic", "n_miscomm", "n_no_miscomm"), F.struct(-F.col("n_total"), F.col("topic")))
    based = contingency.withColumn("_base", contingency.agg(largest).scalar()).select(
        *contingency.columns,
        F.col("_base.topic").alias("base_topic"),
        F.col("_base.n_miscomm").alias("base_miscomm"),
        F.col("_base.n_no_miscomm").alias("base_no_miscomm"),
    )
    a, b = F.col("n_miscomm"), F.col("n_no_miscomm")
    a0, b0 = F.col("base_miscomm"), F.col("base_no_miscomm")
    intercept = F.col("topic") == F.col("base_topic")
    inverse = F.try_divide(F.lit(1.0), a0) + F.try_divide(F.lit(1.0), b0)
    ratio = F.when(intercept, F.try_divide(a0, b0)).otherwise(F.try_divide(a, b) * F.try_divide(b0, a0))
    error = F.when(intercept, F.sqrt(inverse)).otherwise(
        F.sqrt(F.try_divide(F.lit(1.0), a) + F.try_divide(F.lit(1.0), b) + inverse)
    )
    return (
        based.withColumn("intercept", intercept)
        .withColumn("term", F.when(intercept, "(Intercept)").otherwise(F.concat(F.lit("topic"), "topic")))
        .withColumn("odds_ratio", ratio)
        .withColumn("std_error", error)
        .withColumn("statistic", F.try_divide(F.ln("odds_ratio"), F.col("std_error")))
    )


def logistic(contingency: DataFrame) -> DataFrame:
    """Odds ratios with test, profile-likelihood limits and adjusted p-values."""
    cells = [F.col(c).cast("double") for c in ("n_miscomm", "n_no_miscomm", "base_miscomm", "base_no_miscomm")]
    # the limits come last: what the adjustment asks of its rows is then planned without them
    tests = adjust_p_values(odds_ratios(contingency).withColumn("p_value", normal_p_value("statistic")))
    return (
        tests.withColumn("_limits", profile_limits(*cells, F.col("intercept")))
        .select("*", "_limits.*")
        .orderBy(F.desc("intercept"), "topic")
        .select("term", "odds_ratio", "std_error", "statistic", "p_value", "conf_low", "conf_high", "p_adj")
    )


#: Buckets per unit of a score or a rate, which are ranked within their bucket.
RANK_BUCKETS = 512


def _average_rank(pairs: DataFrame, column: str) -> Column:
    """The mean rank of equal values."""
    bucket = f"_bucket_{column}"
    ties = F.count("*").over(Window.partitionBy(column))
    within = F.rank().over(Window.partitionBy(bucket).orderBy(column))
    return F.element_at(_earlier_rows(pairs, bucket), F.col(bucket)) + within + (ties - 1) / 2.0


def rank_correlation(scores: DataFrame, rates: DataFrame, track: str = "tags") -> DataFrame:
    """Spearman correlation of concreteness and rate over the topics having both."""
    pairs = (
        scores.select("topic", F.col("concreteness_score").alias("x"))
        .join(rates.select("topic", F.col("miscomm_rate").alias("y")), "topic", "inner")
        .where(F.col("x").isNotNull() & F.col("y").isNotNull())
    )
    for column in ("x", "y"):
        pairs = pairs.withColumn(f"_bucket_{column}", F.floor(F.col(column) * RANK_BUCKETS))
    ranked = pairs.select("x", "y", _average_rank(pairs, "x").alias("_rx"), _average_rank(pairs, "y").alias("_ry"))
    summary = ranked.agg(
        F.corr("_rx", "_ry").alias("rho"),
        F.count("*").cast("int").alias("n_topics"),
        (F.least(F.count_distinct("x"), F.count_distinct("y")) < F.count("*")).alias("_ties"),
    )
    return summary.select(
        F.lit(track).alias("track"),
        "rho",
        spearman_p_value("rho", "n_topics", "_ties").alias("p_value"),
        "n_topics",
    )
