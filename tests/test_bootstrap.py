"""The exact bootstrap against its definition."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException

from cuelake.operators import bootstrap as B

SCHEMA = "clip long, substitutions long, insertions long, deletions long, words long"
UNITS = "left_errors long, left_words long, right_errors long, right_words long"


def some_units(n, seed=4, most=40):
    rng = random.Random(seed)
    return [(rng.randrange(4), w, rng.randrange(6), w) for w in (rng.randrange(1, most) for _ in range(n))]


def plain_bootstrap(units, resamples, seed=1):
    """Deltas of resamples drawn unit by unit."""
    x, rng = np.array(units, float), np.random.default_rng(seed)
    sums = np.array([x[rng.integers(0, len(x), len(x))].sum(0) for _ in range(resamples)])
    return np.sort(sums[:, 0] / sums[:, 1] - sums[:, 2] / sums[:, 3])


@pytest.mark.parametrize("blocks", [1, 3])
def test_each_resample_draws_as_many_units_as_there_are(spark, monkeypatch, blocks):
    monkeypatch.setattr(B, "IN_BLOCK", 2**blocks)
    units = some_units(700)
    got = B.resampled(spark.createDataFrame(units, UNITS).repartition(5), "s", 500).collect()
    assert len(got) == 500 and {r.drawn for r in got} == {700}
    x = np.array(units, float)
    for k, c in enumerate(B.FIGURES):
        mean, deviation = np.mean([r[c] for r in got]), np.std([r[c] for r in got])
        assert abs(mean - x[:, k].sum()) < 4 * x[:, k].std() * math.sqrt(700 / 500)
        assert 0.85 < deviation / (x[:, k].std() * math.sqrt(700)) < 1.15


def test_draws_of_blocks_and_figures_add_up():
    totals = [5, 0, 17, 1, 30, 2, 0, 9]
    drawn = [B.block_draws(totals, b, 2000, 7) for b in range(8)]
    assert (np.sum(drawn, 0) == 64).all() and not drawn[1].any()
    for b, k in enumerate(totals):
        assert abs(drawn[b].mean() - k) < 0.5
    # two blocks' counts go against each other as those of a multinomial do
    assert abs(np.cov(drawn[2], drawn[4])[0, 1] + 64 * (17 / 64) * (30 / 64)) < 1.5
    weights = np.array([3, 10, 4])
    parts = list(B.figure_draws(drawn[2], weights, 17, B._random(7, 99)))
    assert (np.sum(parts, 0) == drawn[2]).all() and all(abs(p.mean() - w) < 0.3 for p, w in zip(parts, weights, strict=True))


def test_interval_is_that_of_a_plain_bootstrap(spark):
    units = some_units(400)
    out = B.paired_bootstrap(spark.createDataFrame(units, UNITS), "s").first()
    plain = plain_bootstrap(units, 10_000)
    width = plain[math.ceil(9999 * 0.975)] - plain[math.floor(9999 * 0.025)]
    assert out.resamples == 10_000 and out.n == 400
    for mine, theirs in ((out.low, plain[math.floor(9999 * 0.025)]), (out.high, plain[math.ceil(9999 * 0.975)]), (out.mean_delta, plain.mean())):
        assert abs(mine - theirs) < 0.05 * width
    deltas = [a / b - c / d for a, b, c, d in units]
    assert (out.right_won, out.left_won, out.ties) == (sum(x > 0 for x in deltas), sum(x < 0 for x in deltas), sum(x == 0 for x in deltas))


def test_reruns_agree_whatever_the_partitions(spark):
    rows = spark.createDataFrame(some_units(300), UNITS)
    a, b, other = B.paired_bootstrap(rows, "s", 200).first(), B.paired_bootstrap(rows.repartition(7), "s", 200).first(), B.paired_bootstrap(rows, "t", 200).first()
    assert a == b and a != other


def test_units_that_are_alike_and_none(spark):
    same = B.paired_bootstrap(spark.createDataFrame([(2, 6, 1, 6)] * 50, UNITS), "s", 100).first()
    assert (same.low, same.mean_delta, same.high, same.right_won) == (round(1 / 6, 8),) * 3 + (50,)
    none = B.paired_bootstrap(spark.createDataFrame([], UNITS), "s", 100).first()
    assert (none.resamples, none.low, none.mean_delta, none.n) == (0, None, None, 0)


def test_units_of_one_side_only_fail(spark):
    left = spark.createDataFrame([(1, 1, 0, 0, 3), (2, 0, 1, 0, 5)], SCHEMA)
    right = spark.createDataFrame([(1, 0, 0, 1, 3), (None, 0, 0, 0, 2)], SCHEMA)
    with pytest.raises(PySparkException, match="one side"):
        B.paired_units(left, right, ["clip"]).collect()
    both = B.paired_units(left, left.union(left).distinct(), ["clip"]).orderBy("clip").collect()
    assert [tuple(r) for r in both] == [(1, 1, 3, 1, 3), (2, 1, 5, 1, 5)]
