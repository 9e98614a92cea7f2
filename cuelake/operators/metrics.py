"""Metrics of tracks and corpora."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from cuelake.functions import similarity as S
from cuelake.functions import text as T
from cuelake.operators.intervals import overlap_pairs
from cuelake.operators.terms import count_terms


def window_quality(cues: DataFrame, windows: DataFrame, group: str = "media_id") -> DataFrame:
    """For each window (pos, start_ms, end_ms): cues, clipped coverage, mean
    confidence, greatest compression, repeats inside the window, suspicious cues, characters."""
    pairs = overlap_pairs(windows.select(group, "pos", "start_ms", "end_ms"), cues, 0, group)
    inside = Window.partitionBy(group, "l_pos").orderBy("r_pos")
    again = F.col("r_text") == F.lag("r_text").over(inside)
    rows = pairs.withColumn("again", F.coalesce(again, F.lit(False)))
    return rows.groupBy(group, F.col("l_pos").alias("pos")).agg(
        F.count("*").alias("n"), F.sum("overlap_ms").alias("covered_ms"), F.avg("r_logprob_milli").alias("mean_logprob"), F.max("r_compression_milli").alias("most_compression"),
        F.count_if("again").alias("n_again"), F.count_if("r_suspicious").alias("n_suspicious"), F.sum(F.length("r_text")).alias("characters"), F.min("r_start_ms").alias("first_ms"), F.max("r_end_ms").alias("last_ms"),
    )


def segmentation(cues: DataFrame, group: str = "media_id") -> DataFrame:
    """Empty spans, overlaps with the running end, gaps, fast and long cues of each group, and a hash of its texts."""
    order = Window.partitionBy(group).orderBy("pos")
    before = F.max("end_ms").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = cues.withColumns({"before": before, "d": F.col("end_ms") - F.col("start_ms"), "longest": F.array_max(F.transform(F.split("text", r"\n"), lambda x: F.length(x)))})
    texts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    return rows.groupBy(group).agg(
        F.count_if(F.col("d") <= 0).alias("n_empty"), F.count_if(F.col("start_ms") < F.col("before")).alias("n_overlap"),
        F.sum(F.greatest(F.lit(0).cast("long"), F.coalesce(F.col("start_ms") - F.col("before"), F.lit(0).cast("long")))).alias("gap_ms"),
        F.count_if((F.col("d") > 0) & (F.length("text") * 1000 > 20 * F.col("d"))).alias("n_fast"), F.count_if(F.col("longest") > 42).alias("n_long_line"),
        F.sha2(F.array_join(texts, "\n"), 256).alias("text_sha256"),
    )


def basic(cues: DataFrame, group: str = "media_id") -> DataFrame:
    d = F.col("end_ms") - F.col("start_ms")
    return cues.groupBy(group).agg(F.count("*").alias("n"), F.sum(d).alias("total_ms"), F.avg(d).alias("mean_ms"), F.min(d).alias("least_ms"), F.max(d).alias("most_ms"))


def rhythm(cues: DataFrame, group: str = "media_id") -> DataFrame:
    """Characters a second (mean, greatest, 95th percentile, median), lines a cue and characters a line."""
    rows = cues.where("end_ms > start_ms").withColumns({"cps": F.length("text") * 1000.0 / (F.col("end_ms") - F.col("start_ms")), "n_lines": F.size(F.split("text", r"\n"))})
    return rows.groupBy(group).agg(
        F.avg("cps").alias("mean_cps"), F.max("cps").alias("most_cps"), F.percentile("cps", 0.95).alias("p95_cps"), F.percentile("cps", 0.5).alias("median_cps"),
        F.avg("n_lines").alias("lines"), (F.sum(F.length("text")) / F.sum("n_lines")).alias("line_length"),
    )


def style_counts(cues: DataFrame, group: str = "media_id") -> DataFrame:
    """Omission marks, annotations in brackets, words in capitals, questions and exclamations of each group."""
    n = lambda p: F.sum(F.regexp_count("text", F.lit(p))).alias
    return cues.groupBy(group).agg(n(r"\.\.\.|…")("omissions"), n(r"\[[^\]]*\]|\([^)]*\)")("annotations"), F.sum(F.size(F.filter(F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), lambda w: w.rlike("^[A-Z]{2,}$"))).cast("long")).alias("capitals"), n(r"\?")("questions"), n(r"!")("exclamations"))


def style_tags(counts: DataFrame) -> DataFrame:
    """counts with tags: questioning, lively, annotated, elliptic, or plain."""
    tags = F.array_compact(F.array(
        F.when(F.col("questions") >= 3, "questioning"), F.when(F.col("exclamations") >= 3, "lively"), F.when(F.col("annotations") >= 2, "annotated"), F.when(F.col("omissions") >= 2, "elliptic"),
    ))
    return counts.withColumn("tags", F.when(F.size(tags) == 0, "plain").otherwise(F.array_join(tags, ",")))


def openings(cues: DataFrame, length: int = 3, most: int = 5, group: str = "media_id") -> DataFrame:
    """The commonest openings of ``length`` characters that come more than once."""
    counts = cues.where(F.length("text") >= length).groupBy(group, F.left("text", F.lit(length)).alias("opening")).agg(F.count("*").alias("n")).where("n > 1")
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "opening"))
    return counts.withColumn("place", rank).where(F.col("place") <= most)


def repetition(cues: DataFrame, least: int = 3, group: str = "media_id") -> DataFrame:
    """Distinct and all words of at least ``least`` letters."""
    words = cues.select(group, F.explode(F.regexp_extract_all(F.lower("text"), F.lit(rf"(\p{{L}}{{{least},}})"), F.lit(1))).alias("w"))
    return words.groupBy(group).agg(F.countDistinct("w").alias("n_distinct"), F.count("*").alias("n_words"))


def adjacent_duplicates(cues: DataFrame, group: str = "media_id") -> DataFrame:
    """Cues equal to the one before, and their share of all cues (not of pairs)."""
    order = Window.partitionBy(group).orderBy("pos")
    rows = cues.withColumn("again", F.coalesce(T.compact(F.col("text")) == F.lag(T.compact(F.col("text"))).over(order), F.lit(False)))
    return rows.groupBy(group).agg(F.count_if("again").alias("n_again"), F.count("*").alias("n")).withColumn("share", F.col("n_again") / F.col("n"))


def adjacent_containment(cues: DataFrame, least: int = 4, group: str = "media_id") -> DataFrame:
    """Neighbours of at least ``least`` characters that are equal or of which one holds the other."""
    order = Window.partitionBy(group).orderBy("pos")
    a = T.word_characters(F.col("text"))
    rows = cues.withColumn("a", a).withColumn("b", F.lag("a").over(order)).where((F.length("a") >= least) & (F.length("b") >= least))
    return rows.groupBy(group).agg(F.count_if(F.contains("a", "b") | F.contains("b", "a")).alias("n"))


def pair_lengths(pairs: DataFrame, group: str = "media_id") -> DataFrame:
    """Of pairs (text, other_text): length ratio's mean, median, least, greatest, and shares of shorter, like and longer."""
    rows = pairs.where("length(text) > 0").withColumn("ratio", F.length("other_text") / F.length("text"))
    return rows.groupBy(group).agg(
        F.count("*").alias("n"), F.avg("ratio").alias("mean_ratio"), F.median("ratio").alias("median_ratio"), F.min("ratio").alias("least_ratio"), F.max("ratio").alias("most_ratio"),
        F.avg((F.col("ratio") < 0.8).cast("int")).alias("shorter"), F.avg(((F.col("ratio") >= 0.8) & (F.col("ratio") <= 1.25)).cast("int")).alias("alike"), F.avg((F.col("ratio") > 1.25).cast("int")).alias("longer"),
    )


def error_rates(rows: DataFrame) -> DataFrame:
    """rows (reference, candidate) with substitutions, insertions, deletions and words."""
    return rows.withColumn("e", S.word_errors(T.normalize_spoken(F.col("reference")), T.normalize_spoken(F.col("candidate")))).select(*rows.columns, "e.*")


def corpus_rates(errors: DataFrame, *by: str) -> DataFrame:
    """Rates of summed errors over summed words, not means of rates."""
    wrong = F.col("substitutions") + F.col("insertions") + F.col("deletions")
    out = errors.groupBy(*by).agg(F.sum(wrong).alias("errors"), F.sum("words").alias("words"), F.max(wrong).alias("most_errors"), F.count("*").alias("n"))
    return out.withColumn("rate", F.when(F.col("words") > 0, F.col("errors") / F.col("words")))


def grouping_levels(samples: DataFrame, value: Column, tags: str = "tags", candidate: str = "candidate") -> DataFrame:
    """Means over all samples, by tag (a sample may have several) and by candidate."""
    mean, n = F.avg(value).alias("mean"), F.count("*").alias("n")
    whole = samples.agg(mean, n).select(F.lit("all").alias("level"), F.lit("").alias("name"), "mean", "n")
    by_tag = samples.select("*", F.explode(tags).alias("name")).groupBy("name").agg(mean, n).select(F.lit("tag").alias("level"), "name", "mean", "n")
    by_candidate = samples.groupBy(F.col(candidate).alias("name")).agg(mean, n).select(F.lit("candidate").alias("level"), "name", "mean", "n")
    return whole.unionByName(by_tag).unionByName(by_candidate)


def term_consistency(source: DataFrame, target: DataFrame, terms: DataFrame) -> DataFrame:
    """For each term (source_term, target_term): how often either track has it, whatever its case, and how far the target falls short."""

    def counted(rows: DataFrame, name: str, out: str) -> DataFrame:
        low = F.lower(name)
        found = count_terms(rows.select(F.lower("text").alias("said")), [], "said", terms.select(low.alias("low")))
        return found.groupBy(F.col("low").alias(name + "_low")).agg(F.sum("n").alias(out))

    a, b = counted(source, "source_term", "n_source"), counted(target, "target_term", "n_target")
    out = terms.withColumns({"source_term_low": F.lower("source_term"), "target_term_low": F.lower("target_term")}).join(a, "source_term_low", "left").join(b, "target_term_low", "left")
    out = out.drop("source_term_low", "target_term_low").fillna(0, ["n_source", "n_target"])
    return out.withColumn("missing", F.greatest(F.lit(0).cast("long"), F.col("n_source") - F.col("n_target")))


@F.pandas_udf(StringType())
def plain_caption(text: pd.Series) -> pd.Series:
    """Case folded, without what is no letter, digit or underscore."""
    return text.map(lambda x: re.sub(r"[^\w\u3400-\u9fff]+", "", x.casefold()) if x is not None else None)


def medoid(texts: list[str], weights: list[int], first: list[int]) -> tuple[int, float, int]:
    """(place, sum of likeness to all, pairs compared) of the text most like all of them by their weights, of equally alike ones the longest, then the first.

    No pair is more alike than the characters that both have, whatever their order. Texts are looked at by what they can reach at
    most, and each is left as soon as it cannot reach the best one any more."""
    alphabet = {c: k for k, c in enumerate(sorted({c for t in texts for c in t}))}
    counts = np.zeros((len(texts), max(1, len(alphabet))), np.int32)
    for k, t in enumerate(texts):
        for c, n in Counter(t).items():
            counts[k, alphabet[c]] = n
    length, w = counts.sum(1), np.array(weights, float)

    def most(k: int) -> np.ndarray:
        both = length + length[k]
        return w * np.where(both > 0, 2.0 * np.minimum(counts, counts[k]).sum(1) / np.maximum(both, 1), 0.0)

    reach = np.array([most(k).sum() for k in range(len(texts))])
    best, compared = None, 0
    for k in np.argsort(-reach, kind="stable").tolist():
        if best and reach[k] < best[0][0] - 1e-8:
            break
        bounds, left = most(k), float(reach[k])
        for j in np.argsort(-bounds, kind="stable").tolist():
            if j == k or not bounds[j]:
                continue  # alike as can be, or not at all
            compared += 1
            left -= bounds[j] - weights[j] * S.likeness(texts[k], texts[j])
            if best and left < best[0][0] - 1e-8:
                break
        else:
            rank = (round(left, 9), len(texts[k]), -first[k])
            if best is None or rank > best[0]:
                best = rank, k
    return best[1], best[0][0], compared


def _medoids(each: DataFrame, group: list[str]) -> DataFrame:
    """group, pos, text, plain, total of each group's medoid; groups come one after the other, and one is held at a time."""
    flat = each.select(*group, "plain", "w", F.col("first.pos").alias("pos"), F.col("first.text").alias("text"))
    kind = StructType([*[each.schema[g] for g in group], StructField("pos", LongType()), StructField("text", StringType()), StructField("plain", StringType()), StructField("total", DoubleType())])

    def best(key: tuple, rows: list[tuple]) -> tuple:
        plain, weights, places, texts = zip(*rows, strict=True)
        at, total, _ = medoid(list(plain), list(weights), list(places)) if len(rows) > 1 else (0, float(weights[0] if plain[0] else 0), 0)
        return (*key, places[at], texts[at], plain[at], total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, kinds = None, [], None
        listed = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=kind.names)
        for batch in batches:
            out = []
            kinds = [*[f.type for f in list(batch.schema)[: len(group)]], pa.int64(), pa.string(), pa.string(), pa.float64()]
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and row[: len(group)] != key:
                    out.append(best(key, held))
                    held = []
                key = row[: len(group)]
                held.append(row[len(group) :])
            if out:
                yield listed(out)
        if held:
            yield listed([best(key, held)])

    return flat.repartition(*group).sortWithinPartitions(*group, "pos", "plain").mapInArrow(run, kind)


def consensus(rows: DataFrame, group: list[str], block: int = 64, whole: int = 2048) -> DataFrame:
    """group, text, stability, n: of each group's texts the one most like all
    of them (then the longest, then the first by pos), and its mean similarity to those that say something; 0.5 for one alone.

    Whole texts; equal ones are compared once and count as often as they come. Groups of up to ``whole`` different texts are
    searched with bounds; the pairs of larger ones are dealt out, ``block`` texts against all at a time."""
    said = rows.select(*group, F.col("pos").cast("long").alias("pos"), F.regexp_replace("text", r"^\s+|\s+$", "").alias("text")).where("text <> ''").withColumn("plain", plain_caption("text"))
    each = said.groupBy(*group, "plain").agg(F.count("*").alias("w"), F.min(F.struct("pos", "text")).alias("first"))
    sizes = each.groupBy(*group).agg(F.sum(F.when(F.col("plain") != "", F.col("w")).otherwise(0)).alias("n"), F.ceil(F.count("*") / block).alias("blocks"), (F.count("*") > whole).alias("large"))
    each = each.join(sizes, group)
    found = _medoids(each.where("not large"), group)
    left = each.where("large").withColumn("part", F.pmod(F.xxhash64("plain"), F.col("blocks")))
    right = each.where("large").select(*group, F.col("plain").alias("other"), F.col("w").alias("times"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("part"))
    both = left.join(right, [*group, "part"]).withColumn("r", S.matching_ratio("plain", "other"))
    sums = both.groupBy(*group, "plain", "first").agg(F.round(F.sum(F.col("times") * F.col("r")), 9).alias("total"))
    best = sums.groupBy(*group).agg(F.max_by(F.struct("first", "plain", "total"), F.struct("total", F.length("plain"), -F.col("first.pos"))).alias("b"))
    found = found.unionByName(best.select(*group, "b.first.pos", "b.first.text", "b.plain", "b.total")).join(sizes.select(*group, "n"), group)
    stability = F.when(F.col("plain") != "", F.when(F.col("n") == 1, 0.5).otherwise(F.round(F.col("total") / F.col("n"), 6)))
    return found.select(*group, "text", stability.alias("stability"), "n")
