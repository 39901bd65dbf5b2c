"""Ranks within value ranges: quantiles, nearest ranks and Pareto shares against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.operators import insights, profile
from tabulon.operators import relational as R


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(5)
    rows = [(f"e{rng.randrange(40)}", rng.choice([None, float(rng.randrange(-9, 9)), rng.gauss(0, 1e3)]), 7.0 if k % 3 else None) for k in range(500)]
    return spark.createDataFrame([*rows, ("hot", 3.0, 7.0), *[("hot", 3.0, 7.0)] * 300], "e string, x double, same double")


def test_quantiles_match_brute_force(numbers):
    shares = [0.0, 0.1, 0.25, 0.5, 0.95, 1.0]
    got = {(r["column"], r["share"]): r["value"] for r in R.quantiles(numbers, {c: F.col(c) for c in ("x", "same")}, shares).collect()}
    x = np.array([r["x"] for r in numbers.collect() if r["x"] is not None])
    assert got == pytest.approx({("x", s): np.quantile(x, s) for s in shares} | {("same", s): 7.0 for s in shares})
    near = {r["share"]: r["value"] for r in R.nearest_rank_percentile(numbers, "x", shares).collect()}
    assert near == {s: np.sort(x)[round(s * (len(x) - 1))] for s in shares}


@pytest.mark.parametrize("ranges", [2, 64])
def test_running_totals_match_brute_force(numbers, ranges):
    counts = numbers.filter("x is not null").groupBy("e", "x").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.collect()
    for r in R.running_totals(counts, "e", "x", "n", ranges).collect():
        own = [o for o in rows if o["e"] == r["e"]]
        assert (r["before"], r["total"]) == (sum(o["n"] for o in own if o["x"] < r["x"]), sum(o["n"] for o in own))


def test_concentration_matches_brute_force(numbers):
    totals = {}
    for r in numbers.filter("x is not null").collect():
        totals[r["e"]] = totals.get(r["e"], 0.0) + abs(r["x"])
    best = sorted(totals.values(), reverse=True)
    got = R.concentration(numbers.withColumn("x", F.abs("x")), "e", "x", top=3).first()
    assert got["entities"] == len(best) and got["top_share_pct"] == pytest.approx(100 * sum(best[:3]) / sum(best), abs=0.006)
    assert got["pareto_share_pct"] == pytest.approx(100 * sum(best[: -(-len(best) // 5)]) / sum(best), abs=0.006)


def test_of_nothing(numbers):
    none = numbers.limit(0)
    assert R.quantiles(none, {"x": F.col("x")}, [0.5]).count() == R.nearest_rank_percentile(none, "x", [0.5]).count() == 0
    (s,) = profile.numeric_summary(none, ["x"]).collect()
    assert (s["count"], s["q1"], s["mean"]) == (0, None, None)
    (d,) = insights.distribution_shape(none, "x").collect()
    assert (d["n"], d["median"], d["above_twice_mean"]) == (0, None, 0)
    assert R.concentration(none, "e", "x").first()["entities"] == 0
