import numpy as np
import pytest

from tidemark.operators.quantiles import exact_quantiles

CUTS = (0.0, 0.025, 0.5, 0.75, 0.975, 1.0)


def found(spark, values, **settings):
    frame = spark.createDataFrame([(g, float(v) if v is not None else None) for g, v in values], "group string, low double")
    return {r.group: (r.n, r.quantiles) for r in exact_quantiles(frame, "low", CUTS, by=["group"], **settings).collect()}


@pytest.mark.parametrize("bins", [16, 4096])
def test_against_numpy(spark, bins):
    draw = np.random.default_rng(bins)
    groups = {
        "even": draw.random(700), "tail": draw.pareto(0.3, 500), "ties": draw.integers(-3, 3, 800), "one": [4.5], "two": [-1.0, 7.0],
        "same": [2.25] * 50, "close": 1 + np.arange(40) * 2**-52, "tiny": np.arange(5) * 5e-324, "wide": [-1.7e308, 0.0, 1.7e308], None: draw.normal(size=300),
    }
    got = found(spark, [(g, v) for g, vs in groups.items() for v in vs], bins=bins)
    assert set(got) == set(groups)
    for group, values in groups.items():
        n, values_found = got[group]
        assert n == len(values)
        if group != "wide":  # neighbours there are further apart than the largest number
            assert values_found == pytest.approx([np.quantile(np.array(values, float), p) for p in CUTS], rel=1e-12, abs=1e-323)
    assert (got["wide"][1][0], got["wide"][1][2], got["wide"][1][5]) == (-1.7e308, 0.0, 1.7e308)


def test_missing_and_infinite_values(spark):
    got = found(spark, [("a", None), ("a", float("nan")), ("b", None), ("b", 1.0), ("b", 3.0), ("c", float("inf")), ("c", 0.0)])
    assert set(got) == {"b", "c"} and got["b"] == (2, pytest.approx([1, 1.05, 2, 2.5, 2.95, 3]))
    assert got["c"][1][0] == 0 and got["c"][1][-1] == pytest.approx(1.7976931348623157e308)
    assert found(spark, []) == {}


def test_whole_table_and_many_ranges(spark, monkeypatch):
    from tidemark.operators import quantiles

    frame = spark.range(1001).selectExpr("cast(id * id as double) AS `a.b`")
    assert exact_quantiles(frame, "a.b", [0.5]).first()["quantiles"] == [250_000.0]
    monkeypatch.setattr(quantiles, "MANY_RANGES", 0)
    assert exact_quantiles(frame, "a.b", [0.25, 0.5]).first()["quantiles"] == [62_500.0, 250_000.0]
    with pytest.raises(ValueError):
        exact_quantiles(frame, "a.b", [1.5])
