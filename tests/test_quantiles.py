"""Exact quantiles against numpy, with ties, gaps and nothing."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.operators.aggregates import describe_numeric
from gristmill.operators.quantiles import exact_quantiles

SHARES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


@pytest.mark.parametrize("few", [3, 200])
def test_equal_numpy(spark, few):
    rng = np.random.default_rng(0)
    data = {"smooth": rng.normal(size=3000), "ties": np.repeat([1.0, 2.0, 7.5], 1000), "skewed": rng.exponential(size=3000) ** 6, "whole": rng.integers(0, 40, 3000).astype(float)}
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*data.values())], ", ".join(f"{c} double" for c in data)).repartition(5)
    df = df.withColumn("none", F.lit(None).cast("double"))
    got = exact_quantiles(df, [*data, "none"], SHARES, few)
    for c, v in data.items():
        assert got[c] == pytest.approx(np.quantile(v, SHARES).tolist(), rel=1e-12), c
    assert got["none"] == [None] * len(SHARES)


def test_describe_is_the_same_either_way(spark):
    df = spark.range(1000).select((F.col("id") % 97).alias("a"), F.sqrt("id").alias("b"), F.when(F.col("id") > 990, F.col("id")).alias("c"))
    assert sorted(map(tuple, describe_numeric(df).collect())) == sorted(map(tuple, describe_numeric(df, one_pass_rows=10).collect()))


def test_medians_of_groups(spark):
    """Odd and even groups, repeats, missing values, NaN, a null key, text numbers, and none at all."""
    import statistics

    from gristmill.operators.aggregates import Measure, aggregate

    nan = float("nan")
    rows = [("a", 1, v) for v in (3.0, 1.0, 2.0)] + [("b", 1, v) for v in (4.0, 4.0, 1.0, 7.0)] + [(None, 2, 5.0), (None, 2, None), ("c", 1, None), ("d", 1, nan), ("d", 1, 2.0), ("a", 2, 9.0), ("a", 2, 10.0)]
    df = spark.createDataFrame([(*r, None if r[2] is None else str(r[2])) for r in rows], "k string, j int, v double, t string")
    measures = [Measure("median", "v", "m"), Measure("count", None, "n"), Measure("median", "t", "mt", coerce=True)]
    got = {(r["k"], r["j"]): (r["m"], r["n"], r["mt"]) for r in aggregate(df, ["k", "j"], measures).collect()}
    want = {}
    for k, j in {(r[0], r[1]) for r in rows}:
        some = [r[2] for r in rows if r[:2] == (k, j) and r[2] is not None and r[2] == r[2]]
        middle = statistics.median(some) if some else None
        want[k, j] = (middle, sum(r[:2] == (k, j) for r in rows), middle)
    assert got == want
    assert aggregate(df, [], measures).first()["m"] == statistics.median(r[2] for r in rows if r[2] is not None and r[2] == r[2])
    empty = aggregate(df.limit(0), [], [Measure("median", "v", "m"), Measure("count", None, "n")]).collect()
    assert [tuple(r) for r in empty] == [(None, 0)] and aggregate(df.limit(0), ["k"], measures).count() == 0
    assert aggregate(df, ["k"], [Measure("median", "v", "k")]).columns == ["k", "k"]


@pytest.mark.parametrize("few", [5, 100_000])
def test_medians_of_a_group_with_most_rows(spark, few):
    """One group has 90 of 100 rows, with outliers, ties and infinities; its range is cut until few values are left."""
    from gristmill.operators.aggregates import Measure, group_medians

    rng = np.random.default_rng(7)
    big = [*rng.exponential(size=2000) ** 9, *rng.normal(size=1600), 1e300, -1e300, float("inf"), float("-inf")] + [0.5] * 50
    rows = [("big", float(v)) for v in big] + [(f"g{i % 30}", float(v)) for i, v in enumerate(rng.normal(size=400))] + [(None, 1.0), (None, 4.0), ("same", 2.0), ("same", 2.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    got = {r["__k0"]: r["m"] for r in group_medians(df, ["k"], Measure("median", "v", "m"), ["__k0"], few).collect()}
    assert got == {k: float(np.median([v for g, v in rows if g == k])) for k in {r[0] for r in rows}}


def test_no_group_is_ranked_whole(spark):
    from gristmill.operators import aggregates as A

    df = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("k"), F.sqrt("id").alias("v"))
    seen = []
    real = A._middle

    def counting(rows, named):
        seen.append(rows.groupBy(*named, "__rank").count().agg(F.max("count")).first()[0] or 0)
        return real(rows, named)

    A._middle = counting
    try:
        got = {r["__k0"]: r["m"] for r in A.group_medians(df, ["k"], A.Measure("median", "v", "m"), ["__k0"], 100).collect()}
    finally:
        A._middle = real
    assert max(seen) <= 100 and set(got) == {"a", "b"}


@pytest.mark.parametrize("few", [5, 100_000])
def test_quantiles_of_ends_that_repeat(spark, few):
    """Infinities and the largest doubles, each many times, and outliers far from all else."""
    data = [float("-inf")] * 40 + [-1.7976931348623157e308] * 40 + [1e300, -1e300, 5e-324, 0.0] + [float(x) for x in np.random.default_rng(3).normal(size=500)] + [float("inf")] * 30
    df = spark.createDataFrame([(v, 1.0) for v in data] + [(float("nan"), None), (None, None)], "a double, same double").repartition(4)
    got = exact_quantiles(df, ["a", "same"], [0.0, 0.03, 0.1, 0.5, 1.0], few)
    ordered = sorted(data)
    assert got["a"][0] == ordered[0] and got["a"][-1] == ordered[-1] and got["a"][3] == pytest.approx(float(np.median(data)), rel=1e-12)
    assert got["a"][1] == float("-inf") and got["a"][2] == -1.7976931348623157e308
    assert got["same"] == [1.0] * 5


def test_a_pass_for_all_ranks_is_one_grouping(spark):
    """Passes do not aggregate each rank of each column apart, which grows with both."""
    df = spark.range(30_000).select(*[F.sqrt(F.col("id") * (i + 1)).alias(f"c{i}") for i in range(4)])
    seen = []
    kind, real = type(df), type(df).agg
    kind.agg = lambda self, *parts: (seen.append(len(parts)), real(self, *parts))[1]
    try:
        exact_quantiles(df, df.columns, [0.25, 0.5, 0.75], 100)
    finally:
        kind.agg = real
    assert max(seen) <= 3 * len(df.columns)
