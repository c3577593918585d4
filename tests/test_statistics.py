import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.intervals import newcombe, wilson
from tidemark.operators import bootstrap, regression, tables


def long(spark, table, kind="bigint"):
    rows = [("r%d" % i, "c%d" % j, v) for i, line in enumerate(table) for j, v in enumerate(line)]
    return spark.createDataFrame(rows, f"row string, col string, n {kind}")


def test_chi_square_of_counts(spark):
    got = tables.chi_square(long(spark, [[30, 50, 20], [45, 35, 20]])).first()
    assert got.chi2 == pytest.approx(5.6471, abs=1e-4) and got.p_value == pytest.approx(0.0594, abs=1e-4)
    assert (got.dof, got.n, got.min_expected) == (2, 200, 20.0)
    assert got.cramers_v == pytest.approx(math.sqrt(got.chi2 / 200))
    sparse = long(spark, [[30, 50, 0], [45, 35, 20]]).filter("n > 0")
    full = tables.chi_square(long(spark, [[30, 50, 0], [45, 35, 20]])).first()
    assert tables.chi_square(sparse).first().chi2 == pytest.approx(full.chi2)


def test_chi_square_agrees_with_mllib(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import ChiSquareTest

    df = spark.range(900).select((F.col("id") % 2).cast("double").alias("a"),
                                 (F.col("id") * 7 % 13 % 4 + F.col("id") % 2).cast("double").alias("b"))
    ml = ChiSquareTest.test(VectorAssembler(inputCols=["a"], outputCol="v").transform(df), "v", "b").first()
    ours = tables.chi_square(tables.contingency(df, "a", "b")).first()
    assert ours.p_value == pytest.approx(ml.pValues[0], abs=1e-12) and ours.chi2 == pytest.approx(ml.statistics[0])
    assert ours.dof == ml.degreesOfFreedom[0]


def test_chi_square_guards(spark):
    for bad, kind in (([[0.3, 0.7], [0.5, 0.5]], "double"), ([[1, -2], [3, 4]], "bigint"), ([[1, 2]], "bigint"),
                      ([[0, 0], [0, 0]], "bigint")):
        with pytest.raises(tables.NotCountsError):
            tables.chi_square(long(spark, bad, kind))
    assert tables.chi_square(long(spark, [[3.0, 1.0], [2.0, 5.0]], "double")).first().n == 11
    lone = tables.chi_square(long(spark, [[3, 0, 0], [4, 0, 0]])).first()
    assert (lone.chi2, lone.dof, lone.p_value, lone.cramers_v) == (0.0, 0, 1.0, None)


@pytest.mark.parametrize("x, dof, p", [(3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05),
                                       (7.814727903251179, 3, 0.05), (18.307038053275146, 10, 0.05), (24.995790139728616, 15, 0.05)])
def test_chi_square_tail(x, dof, p):
    assert tables.chi_square_tail(x, dof) == pytest.approx(p, abs=1e-12)


def test_contingency_keeps_label_order_and_zeros(spark):
    df = spark.createDataFrame([("pre", "positive"), ("pre", "negative"), ("post", "positive")], "period string, s string")
    labels = ("negative", "neutral", "positive")
    got = {(r.row, r["col"]): r.n for r in tables.contingency(df, "period", "s", labels).collect()}
    assert got == {("pre", "negative"): 1, ("pre", "neutral"): 0, ("pre", "positive"): 1,
                   ("post", "negative"): 0, ("post", "neutral"): 0, ("post", "positive"): 1}
    wide = tables.contingency_wide(df, "period", "s", labels)
    assert wide.columns == ["period", *labels] and wide.filter("period = 'post'").first()[1:] == (0, 0, 1)


def test_intervals(spark):
    df = spark.createDataFrame([(20, 100, 40, 100), (0, 0, 1, 1), (0, 5, 5, 5)], "a int, b int, c int, d int")
    low, high = wilson(F.col("a"), F.col("b"))
    d, d_low, d_high = newcombe(*map(F.col, "abcd"))
    rows = df.select(low, high, d, d_low, d_high).collect()
    assert rows[0][0] < 0.2 < rows[0][1] and rows[0][2] == pytest.approx(0.2) and 0 < rows[0][3] < rows[0][4] < 0.4
    assert rows[1][0] is None and rows[1][1] is None and rows[1][2] is None
    assert rows[2][0] == 0.0


def mix(spark):
    """The rates of both strata are the same before and after; only their sizes change."""
    sizes = {("pre", "tram"): (150, 75), ("post", "tram"): (450, 225), ("pre", "ferry"): (400, 40), ("post", "ferry"): (400, 40)}
    rows = [(period, topic, int(i < hits)) for (period, topic), (n, hits) in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "period string, topic string, negative int")


def test_a_pure_mix_effect_standardizes_to_nothing(spark):
    got = bootstrap.standardized_difference(mix(spark), "negative", "topic", n_boot=100).first()
    assert got.crude_diff > 0.08 and got.standardized_diff == pytest.approx(0, abs=1e-9)
    assert got.ci_low < 0 < got.ci_high and got.ci_high - got.ci_low < 0.3


def plain_bootstrap(rows, n_boot, rng):
    """Row resampling, for the comparison of the interval."""
    parts = {p: np.array([(r.topic == "tram", r.negative) for r in rows if r.period == p]) for p in ("pre", "post")}
    draws = []
    for _ in range(n_boot):
        s = {p: a[rng.integers(0, len(a), len(a))] for p, a in parts.items()}
        total = covered = 0
        for level in (0, 1):
            cut = {p: a[a[:, 0] == level][:, 1] for p, a in s.items()}
            w = sum(map(len, cut.values()))
            total += w * (cut["post"].mean() - cut["pre"].mean())
            covered += w
        draws.append(total / covered)
    return np.quantile(draws, [0.025, 0.975])


def test_bootstrap_matches_row_resampling_and_partitioning(spark):
    df = mix(spark)
    want = plain_bootstrap(df.collect(), 1500, np.random.default_rng(1))
    first = bootstrap.standardized_difference(df, "negative", "topic", n_boot=1500).first()
    assert [first.ci_low, first.ci_high] == pytest.approx(list(want), abs=0.012)
    again = bootstrap.standardized_difference(df.repartition(13), "negative", "topic", n_boot=1500).first()
    assert first == again
    # the same draws when the cells are spread over blocks; only sums of doubles may end otherwise
    blocks = bootstrap.standardized_difference(df, "negative", "topic", n_boot=1500, cells_per_block=2).first()
    assert [blocks.ci_low, blocks.ci_high] == pytest.approx([first.ci_low, first.ci_high], rel=1e-12)


def test_draws_of_a_block_do_not_depend_on_the_blocks(spark):
    """1, 4 and 64 blocks; every replicate draws as many posts of each period as there are."""
    df = spark.createDataFrame([(p, f"t{i}", 0, 3 + i % 7) for p in ("pre", "post") for i in range(60)], "period string, stratum string, outcome int, n long")

    def counts(drawn, cells, first):
        at = np.repeat(np.arange(first, first + len(drawn)), len(cells))
        return pd.DataFrame({"replicate": at, "period": np.tile(cells["period"], len(drawn)), "stratum": np.tile(cells["stratum"], len(drawn)), "n": drawn.ravel()})

    found = [{(r.replicate, r.period, r.stratum): r.n for r in bootstrap._redraw(
        df, counts, "replicate int, period string, stratum string, n double", 130, 3, per_block).collect()} for per_block in (200, 30, 2)]
    assert found[0] == found[1] == found[2] and len(found[0]) == 130 * 120
    for period in ("pre", "post"):
        totals = {sum(n for (r, p, _), n in found[0].items() if r == i and p == period) for i in range(130)}
        assert totals == {sum(3 + i % 7 for i in range(60))}
    # mean and variance of a multinomial count
    cell = np.array([found[0][i, "pre", "t6"] for i in range(130)])
    assert cell.mean() == pytest.approx(9, abs=1.2) and cell.var() == pytest.approx(9 * (1 - 9 / 357), rel=0.5)


def test_intervals_of_each_topic_follow_theory_in_any_number_of_blocks(spark):
    """The difference of two multinomial shares has a known variance; a missing topic is a topic."""
    counts = {("pre", f"t{i}"): 40 + 13 * i for i in range(12)} | {("post", f"t{i}"): 250 - 11 * i for i in range(12)}
    counts |= {("pre", None): 120, ("post", None): 60}
    df = spark.createDataFrame([(p, t, n) for (p, t), n in counts.items()], "period string, topic string, n long")
    size = {p: sum(n for (q, _), n in counts.items() if q == p) for p in ("pre", "post")}
    for cells_per_block in (100, 9, 1):
        rows = bootstrap.topic_prevalence(df, n_boot=2000, n="n", cells_per_block=cells_per_block).collect()
        assert {r.topic for r in rows} == {t for _, t in counts}
        for r in rows:
            share = {p: counts[p, r.topic] / size[p] for p in size}
            error = sum(share[p] * (1 - share[p]) / size[p] for p in size) ** 0.5
            middle = share["post"] - share["pre"]
            assert r.diff == pytest.approx(middle)
            assert [r.diff_low, r.diff_high] == pytest.approx([middle - 1.96 * error, middle + 1.96 * error], abs=0.35 * error)


def test_strata_missing_in_a_period_drop_out(spark):
    rows = [("pre", "a", 1), ("pre", "a", 0), ("post", "a", 1), ("post", "b", 0), ("post", None, 0)]
    df = spark.createDataFrame(rows, "period string, topic string, negative int")
    got = bootstrap.standardized_difference(df, "negative", "topic", n_boot=50).first()
    assert got.standardized_diff == 0.5 and got.crude_diff == pytest.approx(1 / 3 - 0.5)


def test_topic_prevalence(spark):
    got = {r.topic: r for r in bootstrap.topic_prevalence(mix(spark), n_boot=200).collect()}
    tram, change = got["tram"], 450 / 850 - 150 / 550
    assert tram.pre_share == pytest.approx(150 / 550) and tram.post_share == pytest.approx(450 / 850)
    assert tram.diff_low < change < tram.diff_high
    assert got["ferry"].diff == pytest.approx(-change)
    assert bootstrap.topic_prevalence(mix(spark), n_boot=0).columns == ["topic", "pre_share", "post_share", "diff"]


def plain_logit(x, y):
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (y - p))
    return b


@pytest.mark.parametrize("distinct, at_once", [(True, 256), (False, 256), (False, 2)])
def test_logistic_regression(spark, monkeypatch, distinct, at_once):
    monkeypatch.setattr(regression, "SUMS_AT_ONCE", at_once)
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=2000), rng.integers(0, 2, 2000)
    y = (rng.random(2000) < 1 / (1 + np.exp(-(0.5 + 1.2 * a - 0.8 * b)))).astype(int)
    df = spark.createDataFrame([(float(i), int(j), int(k)) for i, j, k in zip(a, b, y)], "a double, b int, y int")
    got = {r.term: r for r in regression.logistic_regression(df, "y", ["a", "b"], distinct_rows=distinct).collect()}
    assert [got[t].coef for t in ("intercept", "a", "b")] == pytest.approx(list(plain_logit(np.column_stack([a, b]), y)), abs=1e-6)
    assert got["a"].p_value < 1e-6 and got["a"].or_ci_low < got["a"].odds_ratio < got["a"].or_ci_high


def test_logistic_regression_agrees_with_mllib(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    df = spark.range(3000).select(
        F.pmod(F.xxhash64("id"), F.lit(2)).alias("u"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3)).alias("v"),
        F.pmod(F.xxhash64("id", F.lit(2)), F.lit(10)).alias("w"))
    df = df.withColumn("y", ((F.col("w") + F.col("u") * 2 - F.col("v")) > 4).cast("int"))
    ml = GeneralizedLinearRegression(family="binomial", labelCol="y").fit(
        VectorAssembler(inputCols=["u", "v"], outputCol="features").transform(df))
    got = regression.logistic_regression(df, "y", ["u", "v"]).collect()
    assert [r.coef for r in got] == pytest.approx([ml.intercept, *ml.coefficients], abs=1e-6)
    errors = ml.summary.coefficientStandardErrors
    assert [r.se for r in got] == pytest.approx([errors[-1], *errors[:-1]], abs=1e-6)


def test_separated_design_stays_finite(spark):
    df = spark.createDataFrame([(0, 0)] * 20 + [(1, 1)] * 20, "x int, y int")
    got = regression.logistic_regression(df, "y", ["x"]).collect()
    assert all(math.isfinite(r.coef) and math.isfinite(r.se) for r in got)


def test_study_regression_hides_topics(spark):
    rows = [(p, t, m, int((i * 7 + t + m * (p == "post")) % 5 < 2)) for p in ("pre", "post") for t in (-1, 0, 1, 10, 2)
            for m in (0, 1) for i in range(25)]
    df = spark.createDataFrame(rows, "period string, topic int, moderation int, negative int")
    assert [r.term for r in regression.study_regression(df).collect()] == ["intercept", "post", "moderation", "post_x_moderation"]


def test_mean_differences(spark):
    rows = [("pre", float(v)) for v in (0, 1, 0, 1)] + [("post", float(v)) for v in (1, 2, 1, 2)]
    df = spark.createDataFrame(rows, "period string, x double")
    got = {r.feature: r.smd for r in tables.mean_differences(df, {"x": F.col("x"), "flat": F.lit(1)}).collect()}
    assert got["x"] > 1 and got["flat"] == 0.0
    assert tables.mean_differences(df.limit(1), {"x": F.col("x")}).first().smd == 0.0


def test_share_difference_needs_both_periods(spark):
    df = mix(spark)
    got = tables.share_difference(df, F.col("negative")).first()
    assert got.diff == pytest.approx(got.post - got.pre) and got.diff_low < got.diff < got.diff_high
    assert tables.share_difference(df.filter("period = 'pre'"), F.col("negative")).count() == 0
