"""Replay of the statistics on published counts.

Collected only if FORUM_PUBLISHED_RESULTS names a folder holding the published CSV files;
test_published_rows.py checks typed-in rows always.
"""

import os
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from forum_signals.operators import stats

FOLDER = os.environ["FORUM_PUBLISHED_RESULTS"]


def published(name):
    return pd.read_csv(Path(FOLDER) / f"{name}.csv", keep_default_na=False)


@pytest.fixture(scope="module")
def contingency(spark):
    counts = published("contingency_tags")
    whole = ["n_miscomm", "n_no_miscomm", "n_total"]
    counts[whole] = counts[whole].astype("int64")
    return spark.createDataFrame(counts).cache()


@pytest.fixture(scope="module")
def overall(spark):
    return spark.createDataFrame(published("global_summary"))


def close(ours, theirs, tolerance, floor=0.0):
    """Largest relative difference of two aligned columns, ignoring values below ``floor``."""
    ours, theirs = ours.astype(float), theirs.astype(float)
    keep = theirs.abs() > floor
    error = ((ours - theirs).abs() / theirs.abs())[keep].max()
    assert error <= tolerance, error


def test_descriptive(contingency):
    ours, theirs = stats.descriptive(contingency).toPandas(), published("stats_tags_descriptive")
    assert list(ours.columns) == list(theirs.columns)
    assert list(ours.topic) == list(theirs.topic)
    for column in ("miscomm_rate", "ci_lower", "ci_upper"):
        close(ours[column], theirs[column], 1e-12)


def test_global_test(contingency):
    ours, theirs = stats.homogeneity_test(contingency).toPandas(), published("stats_tags_global_test")
    assert list(ours.columns) == list(theirs.columns)
    for column in ("statistic", "df", "cramers_v"):
        close(ours[column], theirs[column], 1e-12)
    assert ours.p_value[0] == 0


def test_chi_square_tails():
    from plain_special import chi_square_tail

    theirs = published("stats_tags_by_category_global_test")
    ours = pd.Series([chi_square_tail(x, k) for x, k in zip(theirs.statistic, theirs.df)])
    close(ours, theirs.p_value, 1e-12)
    profile = published("stats_tags_profile_test").iloc[0]
    assert chi_square_tail(profile.chi2, profile.df) == profile.p_value == 0


def test_pairwise(contingency, overall):
    ours, theirs = stats.pairwise(contingency, overall, 0.05).toPandas(), published("stats_tags_pairwise")
    assert list(ours.drop(columns=["z"]).columns) == list(theirs.columns)
    both = theirs.merge(ours, on="topic", suffixes=("_theirs", "_ours"))
    assert len(both) == 200
    for column in ("estimate", "ci_lower", "ci_upper"):
        close(both[column + "_ours"], both[column + "_theirs"], 1e-12)
    for column in ("p_value", "p_adj"):
        close(both[column + "_ours"], both[column + "_theirs"], 1e-9, floor=1e-300)
    assert (both.direction_ours == both.direction_theirs).all()
    assert (both.significant_ours == both.significant_theirs.astype(str).str.upper().eq("TRUE")).all()
    assert ours.p_adj.is_monotonic_increasing


def test_logistic(contingency):
    ours, theirs = stats.logistic(contingency).toPandas(), published("stats_tags_logistic")
    assert list(ours.term) == list(theirs.term)
    close(ours.odds_ratio, theirs.odds_ratio, 1e-6)
    assert (ours.std_error - theirs["std.error"]).abs().max() < 1e-5
    # The published fit stops at its iteration tolerance, ours is the exact maximum; the
    # p-values can agree only as far as z does.
    gap = (ours.statistic - theirs.statistic).abs()
    assert gap[1:].max() < 0.02 and gap[0] < 5e-5 * abs(theirs.statistic[0])
    seen = theirs["p.value"] > 1e-300
    drift = (np.log(ours.p_value[seen]) - np.log(theirs["p.value"][seen])).abs()
    assert (drift <= 1.1 * theirs.statistic[seen].abs() * gap[seen] + 1e-4).all()
    assert (ours.conf_low - theirs["conf.low"]).abs().max() < 1e-6
    assert (ours.conf_high - theirs["conf.high"]).abs().max() < 1e-6


def test_rank_correlation(spark):
    scores = spark.createDataFrame(published("topic_abstractness_tags"))
    rates = spark.createDataFrame(published("track_a_tags"))
    ours = stats.rank_correlation(scores, rates).collect()[0]
    theirs = published("stats_tags_abstractness").iloc[0]
    assert abs(ours.rho - theirs.rho) < 1e-12
    assert abs(ours.p_value / theirs.p_value - 1) < 1e-11
    assert ours.n_topics == theirs.n_topics


def test_adjustment_family(spark):
    theirs = published("stats_tags_logistic")
    ours = stats.adjust_p_values(spark.createDataFrame(theirs[["term", "p.value"]].rename(columns={"p.value": "p_value"})))
    both = theirs.merge(ours.toPandas(), on="term", suffixes=("_theirs", "_ours"))
    close(both.p_adj_ours, both.p_adj_theirs, 1e-12, floor=1e-300)
