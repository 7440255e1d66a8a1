import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions.stats import exact_quantiles, pearson_p_value
from strandline.operators import correlation, success


@pytest.mark.parametrize(
    "r,n,p",
    [
        (0.5, 10, 0.14111328125),  # closed form for even degrees of freedom
        (0.0, 10, 1.0),
        (1.0, 10, 0.0),
        (-0.632, 10, 0.0500),
        (0.9, 4, 0.1),
    ],
)
def test_p_values(spark, r, n, p):
    got = spark.createDataFrame([(r, n)], "r double, n long").select(pearson_p_value(F.col("r"), F.col("n")).alias("p")).first()["p"]
    assert got == pytest.approx(p, abs=2e-4)


def test_quantiles_are_exact(spark):
    rng = random.Random(3)
    values = [rng.gauss(0, 1) for _ in range(4001)] + [5.0] * 2000
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    got = exact_quantiles(df, "v", [0.25, 0.5, 0.75, 0.9], accuracy=100)
    assert got == pytest.approx(list(np.quantile(values, [0.25, 0.5, 0.75, 0.9])), abs=1e-12)
    assert exact_quantiles(df.filter("v > 99"), "v", [0.5]) == [None]
    assert exact_quantiles(spark.createDataFrame([(1.0,), (2.0,)], "v double"), "v", [0.0, 0.5, 1.0]) == [1.0, 1.5, 2.0]


def test_success_metrics(spark):
    df = spark.createDataFrame(
        [("a", 100.0, 50.0, 95), ("b", 200.0, 0.0, 80), ("c", 300.0, 100.0, None), ("d", None, 10.0, 50)],
        "id string, revenue double, budget double, score int",
    )
    got = {r["id"]: r for r in success.success_metrics(df, "revenue", "budget", "score").collect()}
    assert got["a"]["roi"] == 1.0 and got["b"]["roi"] is None and got["d"]["roi"] is None
    assert got["d"]["revenue_tier"] == "bottom_quartile" and got["c"]["revenue_tier"] == "top_quartile"
    assert got["c"]["critical_reception_tier"] == "rotten" and got["a"]["critical_reception_tier"] == "certified_fresh"
    assert got["b"]["revenue_zscore"] == 0.0 and got["d"]["has_revenue_data"] is False
    assert got["c"]["composite_success_score"] == 1.0
    # Scores of rows without revenue are standardised by the rows with revenue.
    sd = math.sqrt(((95 - 87.5) ** 2 + (80 - 87.5) ** 2) / 1)
    assert got["d"]["score_zscore"] == round((50 - 87.5) / sd, 4)


def test_pearson_states(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.5), (None, 1.0)], "x double, y double")
    got = correlation.pearson(df, "x", "y").first()
    assert got["n"] == 3 and got["strength"] == "strong" and got["direction"] == "positive" and got["status"] == "ok"
    assert correlation.pearson(df.limit(1), "x", "y", False).first()["status"] == "insufficient_data"
    flat = correlation.pearson(df.withColumn("x", F.lit(1.0)), "x", "y", False).first()
    assert flat["r"] is None and flat["status"] == "undefined"


def test_quantiles_narrow_until_few_values_are_left(spark):
    rng = random.Random(4)
    data = [rng.gauss(0, 1) for _ in range(3000)] + [0.5] * 2000 + [-7.0] * 900
    df = spark.createDataFrame([(x,) for x in data] + [(None,), (float("nan"),)], "x double")
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = exact_quantiles(df, "x", shares, accuracy=50, most=100)
    data.sort()
    for p, g in zip(shares, got):
        r = p * (len(data) - 1)
        lo, hi = data[int(r)], data[min(int(r) + 1, len(data) - 1)]
        assert abs(g - (lo + (hi - lo) * (r - int(r)))) < 1e-12, p
