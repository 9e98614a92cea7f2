"""Exact paired bootstrap of error rates over any number of units.

Each resample draws as many units as there are, with replacement. Units with equal figures can stand for each other, so they are
counted first, and a resample is a multinomial draw over the distinct figures. It is made by splitting: a
binary tree over blocks of figures says by a binomial draw at each node how many of a
resample's draws fall to its left; within a block figure follows figure the same way. So the draws of a
resample sum to the number of units over all partitions, though no task knows what others drew, and no (resample, unit) table exists.

Random numbers are counter-based (Philox): a node's come from the seed and its number, whichever task asks. Reruns agree.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Blocks of figures at most (a power of two): what the driver has to know, a number each.
BLOCKS = 4096
#: Distinct figures in a block while there are fewer blocks.
IN_BLOCK = 256
FIGURES = ["left_errors", "left_words", "right_errors", "right_words"]


def paired_units(left: DataFrame, right: DataFrame, unit: list[str]) -> DataFrame:
    """left and right (unit, substitutions, insertions, deletions, words), a row for each unit, to the unit and its figures. Fails where one of them has a unit that the other has not."""

    def figures(rows: DataFrame, side: str) -> DataFrame:
        errors = F.col("substitutions") + F.col("insertions") + F.col("deletions")
        return rows.select(*[F.col(u).alias(f"{side}_{u}") for u in unit], errors.cast("long").alias(f"{side}_errors"), F.col("words").cast("long").alias(f"{side}_words"))

    a, b = figures(left, "left"), figures(right, "right")
    same = F.lit(True)
    for u in unit:
        same = same & a[f"left_{u}"].eqNullSafe(b[f"right_{u}"])
    both = a.join(b, same, "full_outer")
    alone = F.col("left_errors").isNull() | F.col("right_errors").isNull()
    checked = F.when(alone, F.raise_error(F.lit("a unit has figures on one side only"))).otherwise(F.col("left_errors"))
    return both.select(*[F.coalesce(f"left_{u}", f"right_{u}").alias(u) for u in unit], checked.cast("long").alias("left_errors"), "left_words", "right_errors", "right_words")


def _random(key: int, number: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(key=key, counter=[0, 0, number, 0]))


def _seed(material: str) -> int:
    return int(hashlib.sha256(material.encode()).hexdigest()[:32], 16)


def _split(rest: np.ndarray, weight: int, of: int, random: np.random.Generator) -> np.ndarray:
    """Of so many draws of each resample, those that fall on weight out of a total of it."""
    return rest.copy() if weight == of else random.binomial(rest, weight / of)


def block_draws(totals: list[int], block: int, resamples: int, key: int) -> np.ndarray:
    """How many draws of each resample fall on a block, given the units in each (a power of two of them)."""
    sums = np.concatenate([[0], np.cumsum(totals)])
    drawn, low, high, node = np.full(resamples, int(sums[-1])), 0, len(totals), 1
    while high - low > 1:
        middle = (low + high) // 2
        left, both = int(sums[middle] - sums[low]), int(sums[high] - sums[low])
        to_left = _split(drawn, left, both, _random(key, node)) if both else drawn
        low, high, node, drawn = (low, middle, 2 * node, to_left) if block < middle else (middle, high, 2 * node + 1, drawn - to_left)
    return drawn


def figure_draws(drawn: np.ndarray, weights: np.ndarray, total: int, random: np.random.Generator) -> Iterator[np.ndarray]:
    """How many of a block's draws fall on each of its figures."""
    for weight in weights.tolist():
        mine = _split(drawn, weight, total, random)
        yield mine
        drawn, total = drawn - mine, total - weight


def resampled(units: DataFrame, seed: str, resamples: int) -> DataFrame:
    """resample, drawn (units), and the sums of the figures of each resample."""
    sums = units.groupBy(*FIGURES).agg(F.count("*").alias("k"))
    size = min(BLOCKS, 1 << max(0, math.ceil(math.log2(max(1, sums.count() / IN_BLOCK)))))
    blocked = sums.withColumn("block", F.pmod(F.xxhash64(*FIGURES), F.lit(size)).cast("int"))
    found = dict(blocked.groupBy("block").agg(F.sum("k")).collect())  # BLOCKS rows at most
    totals, key = [int(found.get(b, 0)) for b in range(size)], _seed(seed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_ = np.zeros((resamples, 1 + len(FIGURES)), np.int64)
        now = draws = None
        for pdf in batches:
            for block, rows in pdf.groupby("block", sort=False):
                if block != now:  # sorted by block; one may go on in the next batch
                    now, left = block, totals[block]
                    draws, random = block_draws(totals, block, resamples, key), _random(key, 2 * BLOCKS + int(block))
                figures = rows[FIGURES].to_numpy(np.int64)
                for mine, figure in zip(figure_draws(draws, rows["k"].to_numpy(), left, random), figures, strict=True):
                    all_[:, 0] += mine
                    all_[:, 1:] += mine[:, None] * figure
                    draws = draws - mine
                left -= int(rows["k"].sum())
        yield pd.DataFrame(all_, columns=["drawn", *FIGURES]).assign(resample=np.arange(resamples))

    dealt = blocked.repartition(size, "block").sortWithinPartitions("block", *FIGURES)
    parts = dealt.select("block", "k", *FIGURES).mapInPandas(run, "drawn long, " + ", ".join(f"{f} long" for f in FIGURES) + ", resample long")
    return parts.groupBy("resample").agg(*[F.sum(c).alias(c) for c in ("drawn", *FIGURES)])


def paired_bootstrap(units: DataFrame, seed: str, resamples: int = 10_000) -> DataFrame:
    """units (FIGURES; one row each, none null) to one row: resamples, mean_delta (left less right rate), low, high (95 %, by sorted place), right_won,
    left_won, ties, n. No units: nulls and zeros."""
    rate = lambda side: F.col(f"{side}_errors") / F.greatest(F.col(f"{side}_words"), F.lit(1))
    each = resampled(units, seed, resamples).where("drawn > 0").select((rate("left") - rate("right")).alias("d"))
    deltas = F.sort_array(F.collect_list("d"))  # one for each resample
    low, high = math.floor((resamples - 1) * 0.025), math.ceil((resamples - 1) * 0.975)
    spread = each.agg(F.count("*").cast("int").alias("resamples"), F.round(F.avg("d"), 8).alias("mean_delta"), F.round(F.get(deltas, low), 8).alias("low"), F.round(F.get(deltas, high), 8).alias("high"))
    delta = rate("left") - rate("right")
    won = units.agg(F.count_if(delta > 0).alias("right_won"), F.count_if(delta < 0).alias("left_won"), F.count_if(delta == 0).alias("ties"), F.count("*").alias("n"))
    return spread.crossJoin(won)  # two tables of one row
