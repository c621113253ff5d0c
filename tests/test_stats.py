import math

import pytest
from pyspark.sql.functions import lit as F_lit

import plain_special as plain
from forum_signals.functions import special
from forum_signals.operators import stats

# Published counts of the baseline topic and three others, and of all questions.
CELLS = [
    ("javascript", 339435, 2142948, 2482383),
    ("java", 287850, 1598244, 1886094),
    ("kotlin", 10399, 84017, 94416),
    ("jsp", 6603, 44173, 50776),
]
TOTAL = (23698887, 3072958, 0.1296667645193633)


@pytest.fixture(scope="module")
def contingency(spark):
    return spark.createDataFrame(CELLS, "topic string, n_miscomm long, n_no_miscomm long, n_total long")


@pytest.fixture(scope="module")
def overall(spark):
    return spark.createDataFrame([TOTAL], "total_questions long, total_miscomm long, global_miscomm_rate double")


def test_published_rows(contingency, overall):
    described = {r.topic: r for r in stats.descriptive(contingency).collect()}
    assert described["java"].ci_lower == pytest.approx(0.15210376139294082, rel=1e-12)
    rows = {r.topic: r for r in stats.pairwise(contingency, overall, 0.05).collect()}
    assert rows["kotlin"].p_value == pytest.approx(4.175175212118779e-71, rel=1e-9)
    assert rows["kotlin"].ci_lower == pytest.approx(-0.02152802175862666, rel=1e-12)
    assert (rows["kotlin"].direction, rows["jsp"].direction, rows["java"].direction) == (
        "below_baseline", "not_significant", "above_baseline",
    )
    assert rows["jsp"].p_value == pytest.approx(0.8016132545726301, rel=1e-9)


def test_odds_ratios(contingency):
    rows = stats.logistic(contingency).collect()
    assert [r.term for r in rows] == ["(Intercept)", "topicjava", "topicjsp", "topickotlin"]
    assert rows[0].odds_ratio == pytest.approx(0.15839628418632826, rel=1e-7)
    assert rows[0].conf_low == pytest.approx(0.1578235568063961, abs=1e-7)
    for row in rows:
        assert row.conf_low < row.odds_ratio < row.conf_high
        if row.term == "(Intercept)":
            continue
        a, b = next((c[1], c[2]) for c in CELLS if "topic" + c[0] == row.term)
        for limit in (row.conf_low, row.conf_high):
            deviance = plain._deviance(math.log(limit), a, b, CELLS[0][1], CELLS[0][2])
            assert deviance == pytest.approx(special.CHI2_1_95, abs=1e-6)


def test_empty_cells_give_nulls(spark):
    cells = spark.createDataFrame([("a", 5, 5, 10), ("b", 0, 4, 4)], "topic string, n_miscomm long, n_no_miscomm long, n_total long")
    rows = {r.term: r for r in stats.logistic(cells).collect()}
    assert rows["topicb"].std_error is None and rows["topicb"].odds_ratio == 0
    none = spark.createDataFrame([("a", 0, 5, 5), ("b", 0, 4, 4)], cells.schema)
    tested = stats.homogeneity_test(none).collect()[0]
    assert tested.statistic is None and tested.p_value is None


def test_homogeneity_and_profile(spark):
    cells = [("a", "x", 10, 20, 30), ("b", "x", 30, 10, 40), ("a", "y", 5, 25, 30), ("b", "y", 5, 35, 40)]
    df = spark.createDataFrame(cells, "topic string, category string, n_miscomm long, n_no_miscomm long, n_total long")

    def chi(table):
        rows, columns = [sum(r) for r in table], [sum(c) for c in zip(*table)]
        n = sum(rows)
        return sum((v - rows[i] * columns[j] / n) ** 2 / (rows[i] * columns[j] / n) for i, r in enumerate(table) for j, v in enumerate(r))

    per = {r.category: r for r in stats.homogeneity_test(df, "category").collect()}
    assert per["x"].statistic == pytest.approx(chi([(10, 20), (30, 10)])) and per["x"].df == 1
    assert per["y"].statistic == pytest.approx(chi([(5, 25), (5, 35)]))
    assert per["x"].cramers_v == pytest.approx(math.sqrt(per["x"].statistic / 70))
    profile = stats.profile_test(df).collect()[0]
    assert profile.chi2 == pytest.approx(chi([(10, 5), (30, 5)])) and (profile.df, profile.n_topics, profile.n_cats) == (1, 2, 2)


def test_adjustment(spark):
    p = [0.01, 0.02, 0.03, 0.5, 0.02]
    df = spark.createDataFrame([(i, v, "f") for i, v in enumerate(p)], "i int, p_value double, family string")
    order = sorted(p)
    expected = [min(min(1.0, order[j] * len(p) / (j + 1)) for j in range(len(p)) if order[j] >= v) for v in p]
    for adjusted in (stats.adjust_p_values(df), stats.adjust_p_values(df, family="family")):
        assert [r.p_adj for r in adjusted.orderBy("i").collect()] == pytest.approx(expected)


def test_plain_functions():
    assert plain.chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-12)
    assert plain.chi_square_tail(0.5, 4) == pytest.approx(math.exp(-0.25) * 1.25, rel=1e-12)
    assert plain.chi_square_tail(1000.0, 2) == pytest.approx(math.exp(-500), rel=1e-10)
    assert plain.beta_ratio(2, 3, 0.4) == pytest.approx(0.5248, rel=1e-12)
    # exact permutation tail: three items, S=0 only for the identity
    assert plain.spearman_p(1.0, 3, False) == pytest.approx(2 / 6)
    assert plain.spearman_p(-1.0, 4, False) == pytest.approx(2 / 24)
    assert plain.spearman_p(0.5, 20, True) == pytest.approx(0.024786, rel=1e-3)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_normal_and_chi_square_columns(spark):
    z = [0.0, 0.1, 1.0, 1.96, 2.1, 2.2, 5.0, 12.0, 30.0, 37.0, -3.0]
    rows = spark.createDataFrame([(v,) for v in z], "z double").select("z", special.normal_p_value("z").alias("p"))
    assert "Python" not in plan_of(rows)
    for r in rows.collect():
        assert r.p == pytest.approx(plain.two_sided_normal(r.z), rel=1e-12)
    cases = [(x, k) for k in (1, 2, 3, 4, 7, 12, 39, 199, 200, 2388) for x in (0.01, 0.5, k * 0.5, float(k), k * 1.5, k * 3.0 + 20, 900.0)]
    rows = spark.createDataFrame(cases, "x double, k int").select("*", special.chi_square_p_value("x", "k").alias("p"))
    for r in rows.collect():
        assert r.p == pytest.approx(plain.chi_square_tail(r.x, r.k), rel=1e-10, abs=1e-300), r
    edge = spark.createDataFrame([(None, 3), (0.0, 3), (2.0, 0)], "x double, k int").select(special.chi_square_p_value("x", "k").alias("p"))
    assert [r.p for r in edge.collect()] == [None, 1.0, None]


def test_rank_correlation_column(spark):
    cases = [(rho, n, ties) for n in (3, 4, 8, 9, 10, 50, 200, 1290, 1291, 5000) for rho in (-1.0, -0.6, -0.05, 0.0, 0.2, 0.5, 0.9) for ties in (False, True)]
    rows = spark.createDataFrame(cases, "rho double, n int, ties boolean").select("*", special.spearman_p_value("rho", "n", "ties").alias("p"))
    assert "Python" not in plan_of(rows)
    for r in rows.collect():
        assert r.p == pytest.approx(plain.spearman_p(r.rho, r.n, r.ties), rel=1e-9, abs=1e-290), r


def test_profile_limit_columns(spark):
    from pyspark.sql import functions as F

    cases = [(5, 7, 100, 300), (1, 1, 2, 2), (339435, 2142948, 287850, 1598244), (3, 10**6, 10**5, 10**9), (0, 5, 3, 4)]
    df = spark.createDataFrame([(*map(float, c), flag) for c in cases for flag in (True, False)], "a double, b double, a0 double, b0 double, i boolean")
    limits = df.select("*", special.profile_limits(*map(F.col, ("a", "b", "a0", "b0")), F.col("i")).alias("l"))
    for r in limits.collect():
        expected = plain.profile_interval(r.a, r.b, r.a0, r.b0, r.i)
        if math.isnan(expected[0]):
            assert tuple(r.l) == (None, None)
        else:
            assert tuple(r.l) == pytest.approx(expected, rel=1e-8)


def test_counts_of_a_very_large_forum(spark):
    """Products of such counts do not fit a long."""
    cells = [("a", 10**10, 9 * 10**10, 10**11), ("b", 3 * 10**10, 4 * 10**10, 7 * 10**10)]
    df = spark.createDataFrame(cells, "topic string, n_miscomm long, n_no_miscomm long, n_total long")
    odds = {r.term: r for r in stats.logistic(df).collect()}
    assert odds["topicb"].odds_ratio == pytest.approx(3 / 4 * 9)
    long = df.withColumn("category", F_lit("x")).unionByName(df.withColumn("category", F_lit("y")))
    assert stats.profile_test(long).collect()[0].chi2 == pytest.approx(0, abs=1e-6)


def test_rank_correlation_with_ties(spark):
    scores = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 2.0), ("d", None), ("e", 4.0)], "topic string, concreteness_score double")
    rates = spark.createDataFrame([("a", 0.4), ("b", 0.3), ("c", 0.1), ("d", 0.9), ("e", 0.2)], "topic string, miscomm_rate double")
    row = stats.rank_correlation(scores, rates).collect()[0]
    # ranks 1, 2.5, 2.5, 4 against 4, 3, 1, 2
    assert row.n_topics == 4 and row.rho == pytest.approx(-3 / math.sqrt(4.5 * 5.0))
