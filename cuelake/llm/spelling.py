"""Spelling variants of words (operator 11), by an even-partition pigeonhole join.

Words that differ by one edit (one code point inserted, deleted or replaced) share
one of two halves, since the edit lies in the other. Each word is indexed by its two
halves and its length. A word of the same length, or of one code point more, probes with the
substrings that stand where a half would: the first at the beginning, the second
as far from the end. A pair that meets by both halves counts at the
first one; then one edit is verified. Verification stands in the join itself, so pairs of words that only share a half are never put out.

A half that more than ``HOT`` words share (a common beginning or end) is refined by the same principle: the
rest of the word is halved once more, and words have to share one of those halves too.

Counting is an aggregation by word, which combines on the map side. A word's form
is its near word of largest n, if that is ``TIMES`` its own n or more (ties: the least in
code-point order). So n grows along forms by that factor, there are no cycles, and pointers
that are doubled reach the root of all words in a few rounds.

Null and empty texts have no words; a null id counts as an empty one in the deletion of code points. Rows
that repeat count as often as they are there. Runs of any length are words. Other columns are not read, whatever their names. An empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import BROADCAST_KEYS, materialize

LEAST_POINTS, LEAST_N, TIMES = 6, 5, 5
#: A code point is deleted from runs of which the hash is divided by this.
DELETES = 199
#: Words that share a half before it is refined.
HOT = 200

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, least: int = LEAST_POINTS) -> DataFrame:
    """doc_id, run: maximal runs of letters of at least so many code points, A-Z lower-cased, of docs (doc_id, text)."""
    found = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(rf"([A-Za-zÀ-ÿ]{{{least},}})"), F.lit(1))
    return docs.select("doc_id", F.explode(found).alias("run"))


def damaged(found: DataFrame, deletes: int = DELETES) -> DataFrame:
    """word of each run; some lose one code point, by a hash of id and run."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return found.withColumn("h", h).select(F.when(F.col("h") % deletes == 0, shorter).otherwise(F.col("run")).alias("word"))


def frequent(words: DataFrame, least_points: int = LEAST_POINTS, least_n: int = LEAST_N) -> DataFrame:
    """word, n of words long and frequent enough."""
    return words.where(F.length("word") >= least_points).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def _cut(text: Column, at: Column, skip: int) -> tuple[Column, Column]:
    """text before at, and from at + skip on."""
    return F.substring(text, F.lit(1), at), F.substring(text, at + (skip + 1), F.length(text))


def _entries(words: DataFrame, longer: int) -> DataFrame:
    """word, n, length, part, half, rest of each word: as it is indexed (longer = 0), or as it probes for words shorter by longer."""
    w = F.col("word")
    length = F.length(w) - longer
    at = F.floor(length / 2).cast("int")
    begins, ends = _cut(w, at, longer)
    both = F.array(
        F.struct(F.lit(1).alias("part"), begins.alias("half"), F.substring(w, at + 1, F.length(w)).alias("rest")),
        F.struct(F.lit(2).alias("part"), ends.alias("half"), F.substring(w, F.lit(1), at + longer).alias("rest")),
    )
    return words.select("word", "n", length.alias("length"), F.lit(longer).alias("longer"), F.explode(both).alias("e")).select("word", "n", "length", "longer", "e.*")


def _refined(entries: DataFrame, hot: DataFrame) -> DataFrame:
    """entries with a further key: empty, or for each of the two halves of the rest where the half is hot."""
    at = F.floor((F.length("rest") - F.col("longer")) / 2).cast("int")
    begins = F.substring("rest", F.lit(1), at)
    ends = F.substring(F.col("rest"), at + F.col("longer") + 1, F.length("rest"))
    finer = F.when(F.col("hot").isNull(), F.array(F.struct(F.lit(0).alias("sub"), F.lit("").alias("quarter")))).otherwise(
        F.array(F.struct(F.lit(1).alias("sub"), begins.alias("quarter")), F.struct(F.lit(2).alias("sub"), ends.alias("quarter")))
    )
    marked = entries.join(hot, ["length", "part", "half"], "left")
    return marked.select("word", "n", "longer", "length", "part", "half", F.explode(finer).alias("f"), begins.alias("quarter_1")).select("*", "f.sub", "f.quarter").drop("f")


def near_pairs(words: DataFrame, hot: int = HOT) -> DataFrame:
    """Pairs a, n_a, b, n_b of words (word, n; distinct) that one edit apart, each once; b is the longer one, or the greater."""
    index = _entries(words, 0)
    crowded = materialize(index.groupBy("length", "part", "half").agg(F.count("*").alias("k")).where(F.col("k") > hot).select("length", "part", "half", F.lit(True).alias("hot")), "spelling-hot")
    crowded = F.broadcast(crowded) if crowded.count() <= BROADCAST_KEYS else crowded
    probe = index.unionByName(_entries(words, 1))
    at = F.floor(F.col("length") / 2).cast("int")
    own = _refined(index, crowded).select("length", "part", "half", "sub", "quarter", F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("quarter_1").alias("q_a"))
    other = _refined(probe, crowded).select("length", "part", "half", "sub", "quarter", "longer", F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("quarter_1").alias("q_b"), at.alias("at"))
    # a pair counts at the first half, and the first half of the rest, that both have
    first = ((F.col("part") == 1) | (F.substring("a", F.lit(1), F.col("at")) != F.substring("b", F.lit(1), F.col("at")))) & ((F.col("sub") != 2) | (F.col("q_a") != F.col("q_b")))
    one_edit = F.levenshtein("a", "b", 1) == 1
    once = (F.col("longer") == 1) | (F.col("a") < F.col("b"))
    return own.join(other, ["length", "part", "half", "sub", "quarter"]).where(once & first & one_edit).select("a", "n_a", "b", "n_b")


def forms(words: DataFrame, pairs: DataFrame, times: int = TIMES) -> DataFrame:
    """word, n, n_near, form, form_n of all words."""
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).union(pairs.select("b", "a", "n_a"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    near_n = -F.col("best.less")
    enough = near_n >= times * F.col("n")
    return words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, near_n).alias("form_n")
    )


def with_roots(found: DataFrame) -> DataFrame:
    """found (word, form, others) with root: the last word that forms lead to."""
    steps = materialize(found.where("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        next_ = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = materialize(steps.join(next_, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        steps = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return found.join(steps, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """One row per word of docs (doc_id, text): word, n, n_near, form, form_n, root."""
    words = materialize(frequent(damaged(runs(docs.select("doc_id", "text")))), "spelling-words")
    found = materialize(forms(words, near_pairs(words, hot)), "spelling-forms")
    return with_roots(found).select("word", "form", "root", "n", "n_near", "form_n")
