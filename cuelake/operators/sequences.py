"""Operators over rows in order: sessions, batches, context, and folds.

Windows are partitioned by the group and ordered by ``pos``. What depends on the result for the
row before (folds) is streamed through Python in order, an island of a group after the other: rows up to a gap that no fold goes over."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions.similarity import likeness
from cuelake.sources.files import kept


def _order(group: str) -> Window:
    return Window.partitionBy(group).orderBy("pos")


def scenes(rows: DataFrame, gap_ms: int = 30_000, group: str = "media_id") -> DataFrame:
    """rows with scene (1, 2, ...): another begins where the start is ``gap_ms`` or more after the end before."""
    order = _order(group)
    before = F.lag("end_ms").over(order)
    new = F.when(before.isNull() | (F.col("start_ms") - before >= gap_ms), 1).otherwise(0)
    return rows.withColumn("_new", new).withColumn("scene", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def batches(rows: DataFrame, size: int = 10, group: str = "media_id") -> DataFrame:
    """rows with batch (0, 1, ...) of ``size`` rows each."""
    return rows.withColumn("batch", F.floor((F.row_number().over(_order(group)) - 1) / size))


def context(rows: DataFrame, before: int = 3, after: int = 3, column: str = "text", group: str = "media_id") -> DataFrame:
    """rows with the values of the rows before and after, as arrays."""
    order = _order(group)
    return rows.withColumns({
        "context_before": F.collect_list(column).over(order.rowsBetween(-before, -1)),
        "context_after": F.collect_list(column).over(order.rowsBetween(1, after)),
    })


def batch_context(rows: DataFrame, size: int = 10, around: int = 2, group: str = "media_id") -> DataFrame:
    """A row for each batch: its first and last pos, and the pos of context rows around it."""
    made = batches(rows, size, group).groupBy(group, "batch").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count("*").alias("n"))
    total = rows.groupBy(group).agg(F.max("pos").alias("_top"))
    one = F.lit(1).cast("long")
    return made.join(total, group).select(
        group, "batch", "first_pos", "last_pos", "n",
        (F.col("first_pos") - F.greatest(one, F.col("first_pos") - around)).alias("n_before"), (F.least(F.col("_top"), F.col("last_pos") + around) - F.col("last_pos")).alias("n_after"),
    )


def repair_windows(positions: DataFrame, counts: DataFrame, around: int = 1, group: str = "media_id") -> DataFrame:
    """Flagged positions widened by ``around`` and merged where they touch: group, first_pos, last_pos, n_flagged; counts: group, n."""
    one = F.lit(1).cast("long")
    wide = positions.join(counts, group).select(group, F.greatest(one, F.col("pos") - around).alias("a"), F.least(F.col("n"), F.col("pos") + around).alias("b"))
    order = Window.partitionBy(group).orderBy("a", "b")
    before = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col("a") > before + 1), 1).otherwise(0)
    wide = wide.withColumn("_new", new).withColumn("_w", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return wide.groupBy(group, "_w").agg(F.min("a").alias("first_pos"), F.max("b").alias("last_pos"), F.count("*").alias("n_flagged")).drop("_w")


def retry_spans(rows: DataFrame, flagged: Column, pad_ms: int = 500, group: str = "media_id") -> DataFrame:
    """For each flagged row, from the start of the row before to the end of the row after, padded."""
    order = _order(group)
    start = F.coalesce(F.lag("start_ms").over(order), F.col("start_ms")) - pad_ms
    end = F.coalesce(F.lead("end_ms").over(order), F.col("end_ms")) + pad_ms
    wide = rows.withColumns({"_flag": flagged, "_s": F.greatest(F.lit(0).cast("long"), start), "_e": end}).where("_flag")
    return wide.select(group, "pos", F.col("_s").alias("start_ms"), F.col("_e").alias("end_ms"))


def time_grid(rows: DataFrame, every_ms: int, group: str = "media_id") -> DataFrame:
    """Windows of equal length over each group's span, the last one shortened."""
    span = rows.groupBy(group).agg(F.min("start_ms").alias("t0"), F.max("end_ms").alias("t1")).where("t1 > t0")
    made = span.withColumn("start_ms", F.explode(F.sequence(F.col("t0"), F.col("t1") - 1, F.lit(every_ms).cast("long"))))
    return made.select(group, "start_ms", F.least(F.col("start_ms") + every_ms, F.col("t1")).alias("end_ms"))


def change_midpoints(rows: DataFrame, signature: Column, least_ms: int = 250, group: str = "media_id") -> DataFrame:
    """Midpoints between neighbours that differ in their signature and start more than ``least_ms`` apart."""
    order = _order(group)
    made = rows.withColumn("_sig", signature)
    made = made.withColumns({"_next": F.lead("_sig").over(order), "_at": F.lead("start_ms").over(order)})
    return made.where((F.col("_next") != F.col("_sig")) & (F.col("_at") - F.col("start_ms") > least_ms)).select(group, "pos", F.floor((F.col("start_ms") + F.col("_at")) / 2).alias("mid_ms"))


def equal_runs(rows: DataFrame, key: Column, group: str = "media_id") -> DataFrame:
    """Runs of neighbours with an equal key: group, first_pos, last_pos, n, start_ms, end_ms."""
    order = _order(group)
    made = rows.withColumn("_key", key).withColumn("_was", F.lag("_key").over(order))
    new = F.when(F.col("_was").eqNullSafe(F.col("_key")) & (F.row_number().over(order) > 1), 0).otherwise(1)
    made = made.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return made.groupBy(group, "_run").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count("*").alias("n"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("_run")


def islands(rows: DataFrame, apart: int, group: str = "media_id", order: tuple[str, ...] = ("start_ms", "end_ms", "pos")) -> DataFrame:
    """rows with _island: another begins at a row that starts more than ``apart`` ms after all ends before."""
    by = Window.partitionBy(group).orderBy(*[F.asc_nulls_last(c) for c in order])
    before = F.max("end_ms").over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col("start_ms") - before > apart), 1).otherwise(0)
    return rows.withColumn("_new", new).withColumn("_island", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def speech_blocks(spans: DataFrame, target_ms: int = 45_000, most_ms: int = 60_000, silence_ms: int = 8_000, pad_ms: int = 800, group: str = "media_id") -> DataFrame:
    """Speech spans folded into blocks: a block closes at a silence of
    ``silence_ms``, when the next span would make it longer than ``most_ms``, or once it holds ``target_ms`` of
    speech; padded, not below 0 or above the group's ``total_ms``."""
    state = "struct<done:array<struct<start_ms:bigint,end_ms:bigint,speech_ms:bigint>>,start_ms:bigint,end_ms:bigint,speech_ms:bigint>"
    empty = F.lit(None).cast("bigint")
    begin = F.struct(F.array().cast("array<struct<start_ms:bigint,end_ms:bigint,speech_ms:bigint>>").alias("done"), empty.alias("start_ms"), empty.alias("end_ms"), F.lit(0).cast("bigint").alias("speech_ms")).cast(state)

    def block(acc: Column) -> Column:
        return F.struct(acc["start_ms"].alias("start_ms"), acc["end_ms"].alias("end_ms"), acc["speech_ms"].alias("speech_ms"))

    def step(acc: Column, x: Column) -> Column:
        length = x["end_ms"] - x["start_ms"]
        close = acc["start_ms"].isNotNull() & ((x["start_ms"] - acc["end_ms"] >= silence_ms) | (x["end_ms"] - acc["start_ms"] > most_ms) | (acc["speech_ms"] + length > most_ms) | (acc["speech_ms"] >= target_ms))
        fresh = close | acc["start_ms"].isNull()
        return F.struct(
            F.when(close, F.concat(acc["done"], F.array(block(acc)))).otherwise(acc["done"]).alias("done"),
            F.when(fresh, x["start_ms"]).otherwise(acc["start_ms"]).alias("start_ms"), F.when(fresh, x["end_ms"]).otherwise(F.greatest(acc["end_ms"], x["end_ms"])).alias("end_ms"),
            F.when(fresh, length).otherwise(acc["speech_ms"] + length).alias("speech_ms"),
        ).cast(state)

    done = lambda acc: F.when(acc["start_ms"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(block(acc))))
    ordered = F.array_sort(F.collect_list(F.struct("start_ms", "end_ms")))
    total = spans.groupBy(group).agg(F.max("total_ms").alias("total_ms"))
    cut = islands(spans.select(group, "start_ms", "end_ms"), silence_ms - 1, group, ("start_ms", "end_ms")).groupBy(group, "_island").agg(ordered.alias("s"))
    folded = cut.select(group, "_island", F.posexplode(F.aggregate("s", begin, step, done)).alias("_k", "b")).join(total, group)
    folded = folded.withColumn("k", F.row_number().over(Window.partitionBy(group).orderBy("_island", "_k")) - 1)
    return folded.select(
        group, F.col("k").alias("block"), F.greatest(F.lit(0).cast("long"), F.col("b.start_ms") - pad_ms).alias("start_ms"),
        F.least(F.col("total_ms"), F.col("b.end_ms") + pad_ms).alias("end_ms"), F.col("b.speech_ms").alias("speech_ms"),
    )


#: Rows that a fold keeps of an island at least, before it hands them over.
FOLDED = 10_000


def fold(rows: DataFrame, step: Callable[[list[dict], dict], None], group: str = "media_id", order: tuple[str, ...] = ("start_ms", "end_ms", "pos"), apart: int | None = None) -> DataFrame:
    """A left fold of each group's rows in order: ``step(kept, row)`` changes the last
    of the rows kept so far or adds one (of long islands, only the last rows kept are there). Columns stay; pos counts anew. A step that never joins a row to one
    that ended more than ``apart`` ms before says so: the fold then runs on each island between such gaps alone. Tasks stream their islands in order, however many and long."""
    cut = rows.withColumn("_island", F.lit(0).cast("long")) if apart is None else islands(rows, apart, group, order)
    names = cut.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: list[dict] = []
        kept: list[dict] = []
        now, n = None, 0

        def close(most: int) -> None:
            nonlocal n
            for row in kept[:most]:
                n += 1
                done.append(row | {"pos": n})
            del kept[:most]

        for pdf in batches:
            for row in pdf.to_dict("records"):
                key = (row[group] if row[group] == row[group] else None, row["_island"])  # null may come as NaN
                if key != now:
                    close(len(kept))
                    now, n = key, 0
                step(kept, row)
                if len(kept) > 2 * FOLDED:
                    close(FOLDED)
            if len(done) >= FOLDED:
                yield pd.DataFrame(done, columns=names)
                done.clear()
        close(len(kept))
        yield pd.DataFrame(done, columns=names)

    dealt = cut.repartition(group, "_island").sortWithinPartitions(group, "_island", *[F.asc_nulls_last(c) for c in order])
    made = dealt.mapInPandas(run, cut.schema)
    if apart is None:
        return made.select(*rows.columns)
    pos = F.row_number().over(Window.partitionBy(group).orderBy("_island", "pos")).cast(rows.schema["pos"].dataType)
    return made.withColumn("pos", pos).select(*rows.columns)


def _ratio(a: str, b: str) -> float:
    plain = ["".join(c for c in x.lower() if c.isalnum()) for x in (a or "", b or "")]
    return likeness(*plain) if all(plain) else 0.0


def drop_boundary_duplicates(rows: DataFrame, similarity: float = 0.9, slack_ms: int = 250, group: str = "media_id") -> DataFrame:
    """Neighbours that start within ``slack_ms`` of the end before and read
    alike become one: that of the better logprob_milli, then the longer text; its span is both spans."""

    def step(kept: list[dict], row: dict) -> None:
        last = kept[-1] if kept else None
        if last and row["start_ms"] <= last["end_ms"] + slack_ms and _ratio(last["text"], row["text"]) >= similarity:
            best = max(last, row, key=lambda r: (r["logprob_milli"], len(r["text"] or "")))
            kept[-1] = best | {"start_ms": min(last["start_ms"], row["start_ms"]), "end_ms": max(last["end_ms"], row["end_ms"])}
        else:
            kept.append(row)

    return fold(rows, step, group, apart=slack_ms)


def merge_similar(rows: DataFrame, similarity: float = 0.92, gap_ms: int = 50, group: str = "media_id") -> DataFrame:
    """Similar captions one after the other become one over both spans, of the longer text."""

    def step(kept: list[dict], row: dict) -> None:
        last = kept[-1] if kept else None
        if last and abs(row["start_ms"] - last["end_ms"]) <= gap_ms and _ratio(last["text"], row["text"]) >= similarity:
            best = max(last, row, key=lambda r: len(r["text"] or ""))
            kept[-1] = best | {"start_ms": last["start_ms"], "end_ms": max(last["end_ms"], row["end_ms"])}
        else:
            kept.append(row)

    return fold(rows, step, group, apart=gap_ms)


def merge_segments(rows: DataFrame, gap_ms: int = 2000, most_ms: int = 15_000, least_ms: int = 3000, group: str = "media_id") -> DataFrame:
    """Segments joined until a gap over ``gap_ms`` or a span over ``most_ms``; those of at least ``least_ms`` stay."""

    def step(kept: list[dict], row: dict) -> None:
        last = kept[-1] if kept else None
        if last and row["start_ms"] - last["end_ms"] <= gap_ms and row["end_ms"] - last["start_ms"] <= most_ms:
            last |= {"end_ms": max(last["end_ms"], row["end_ms"]), "text": f"{last['text']} {row['text']}".strip()}
        else:
            kept.append(dict(row))

    return fold(rows, step, group, apart=gap_ms).where(F.col("end_ms") - F.col("start_ms") >= least_ms)


def split_at_largest_gaps(rows: DataFrame, most: int = 20, group: str = "media_id") -> DataFrame:
    """rows with part (0, 1, ...): a run of more than ``most`` rows is cut at its largest gap (of equals, the one nearest to the middle, then the first), again
    and again; a quarter of ``most`` rows, but 8 at most, stay on each side. All runs of all recordings are cut at once, a level at a time."""
    side, order = max(1, min(most // 4, 8)), _order(group)
    made = rows.select(group, "pos", F.row_number().over(order).alias("k"), (F.col("start_ms") - F.lag("end_ms").over(order)).alias("gap")).withColumn("first", F.lit(1))
    while True:
        made = kept(made)
        long = made.groupBy(group, "first").agg(F.count("*").alias("n")).where(F.col("n") > most)
        if long.isEmpty():
            break
        i = F.col("k") - F.col("first")
        able = made.join(long, [group, "first"]).where(F.when(F.col("n") - side > side, i.between(side, F.col("n") - side)).otherwise(i == most))
        cut = able.groupBy(group, "first").agg(F.max_by("k", F.struct("gap", -F.abs(i - F.col("n") / 2), -i)).alias("cut"))
        made = made.join(cut, [group, "first"], "left").select(group, "pos", "k", "gap", F.when(F.col("k") >= F.col("cut"), F.col("cut")).otherwise(F.col("first")).alias("first"))
    part = F.dense_rank().over(Window.partitionBy(group).orderBy("first")) - 1
    return rows.join(made.select(group, "pos", part.alias("part")), [group, "pos"])


#: What ends a cue of words, in ms, reading units and units a second; ends of sentences and of clauses.
LEAST_MS, TARGET_MS, MOST_MS, MOST_UNITS, MOST_RATE = 700, 4500, 6500, 44, 12
SENTENCE_END, CLAUSE_END = r"[。！？!?.]\s*$", r"[，,;；:：]\s*$"


@lru_cache(maxsize=1 << 16)
def _kind(c: str) -> tuple[str, bool]:
    """A character: blank, wide, word (a letter or digit) or other; and whether it is Latin or a digit."""
    kind = "blank" if c.isspace() else "wide" if unicodedata.east_asian_width(c) in "WF" else "word" if c.isalnum() else "other"
    return kind, c.isdigit() or "LATIN" in unicodedata.name(c, "")


def _units(text: str) -> int:
    """Reading units in quarters: wide 4; letters and digits 2, and 2 more at a word's start; white space 0; anything else 1."""
    kinds = [_kind(c)[0] for c in text]
    return sum({"blank": 0, "wide": 4, "word": 2, "other": 1}[k] + 2 * (k == "word" != before) for before, k in zip(["", *kinds], kinds))


@lru_cache(maxsize=1 << 16)
def _token(token: str) -> tuple[str, int, bool, bool, bool, bool, bool, bool, bool, bool]:
    """Of a token: its word; its units; whether it begins and ends with a letter or digit, begins with a blank, is a closing mark, begins and ends Latin, and ends a sentence or a clause."""
    word = token.strip()
    (first, first_latin), (last, last_latin) = (_kind(word[0]), _kind(word[-1])) if word else (("", False), ("", False))
    closing = word != "" and word[0] in ",.;:!?)]}"
    return word, _units(word), first == "word", last == "word", token[0].isspace(), closing, first_latin, last_latin, bool(re.search(SENTENCE_END, token)), bool(re.search(CLAUSE_END, token))


def resegment(words: DataFrame, pause_ms: int = 10_000, group: str = "media_id") -> DataFrame:
    """Timed words (pos, text, start_ms, end_ms) to cues (with n_words). A cue ends with the word that makes it MOST_MS long or MOST_UNITS of reading, or, once it is
    LEAST_MS long, that makes it read faster than MOST_RATE or ends a sentence, or ends a clause from TARGET_MS on. A
    pause of ``pause_ms`` ends one too, so that a recording is folded an island at a time. Blank words go; words without a positive length say nothing of time.
    A word comes after a blank if it begins with one or both sides are Latin, but not if it begins with a closing mark. Units and words of a cue are carried along, so that a word costs the same wherever it stands."""

    def step(kept: list[dict], row: dict) -> None:
        top = kept[-1]["_top"] if kept else row["start_ms"]
        last = kept[-1] if kept and not kept[-1]["_closed"] and row["start_ms"] - top < pause_ms else None
        timed, top = row["end_ms"] > row["start_ms"], max(top, row["end_ms"])
        word, units, begins, goes_on, blank, closing, first_latin, last_latin, sentence, clause = _token(row["text"])
        if last is None:
            # a cue of one word closes with the next one at the earliest
            kept.append(row | {"text": word, "_closed": False, "n_words": 1, "_timed": timed, "_top": top, "_units": units, "_inside": goes_on, "_latin": last_latin})
            return
        if word:
            text = last.pop("text")
            gap = text and not closing and (blank or (last["_latin"] and first_latin))
            last["_units"] += units - 2 * (last["_inside"] and begins and not gap)
            text += " " + word if gap else word  # in place, as the row holds it no more
            last["text"] = text
            last["_inside"], last["_latin"] = goes_on, last_latin
        start = last["start_ms"] if last["_timed"] or not timed else row["start_ms"]
        end = row["end_ms"] if timed else last["end_ms"]
        ms, n = max(1, end - start), last["_units"]
        last["_timed"] = last["_timed"] or timed
        last["_closed"] = last["_timed"] and (ms >= MOST_MS or n >= 4 * MOST_UNITS or (ms >= LEAST_MS and (n * 250 > MOST_RATE * ms or sentence)) or (ms >= TARGET_MS and clause))
        last["start_ms"], last["end_ms"], last["_top"] = start, max(start + 1, end), top
        last["n_words"] += 1

    said = words.where(F.trim(F.coalesce("text", F.lit(""))) != "").select(group, "pos", "text", "start_ms", "end_ms", F.lit(0).alias("n_words"))
    return fold(said, step, group, order=("pos",), apart=pause_ms - 1).select(group, "pos", "text", "start_ms", "end_ms", "n_words")


#: Letters of a group that are hashed at once.
PRINTED = 1024


def _text_print(rows: DataFrame, name: str, group: str) -> DataFrame:
    """group, ``name``: length and a fingerprint of all letters and digits in order, however cut: PRINTED of them at a time are put together and hashed with their place, never all of a group."""
    plain = F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", "")
    at = F.coalesce(F.sum(F.length("p")).over(_order(group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    placed = rows.select(group, "pos", plain.alias("p")).withColumn("at", at).where("p <> ''").withColumn("n", F.length("p"))
    pieces = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / PRINTED), F.floor((F.col("at") + F.col("n") - 1) / PRINTED))))
    start, end = F.greatest("at", F.col("block") * PRINTED), F.least(F.col("at") + F.col("n"), (F.col("block") + 1) * PRINTED)
    pieces = pieces.select(group, "block", start.alias("start"), F.substring("p", (start - F.col("at") + 1).cast("int"), (end - start).cast("int")).alias("piece"))
    blocks = pieces.groupBy(group, "block").agg(F.array_sort(F.collect_list(F.struct("start", "piece"))).alias("s"))
    text = F.array_join(F.transform("s", lambda x: x["piece"]), "")
    return blocks.groupBy(group).agg(F.struct(F.sum(F.length(text)).alias("n"), F.bit_xor(F.xxhash64("block", text)).alias("h")).alias(name))


def resegmented(cues: DataFrame, words: DataFrame, pause_ms: int = 10_000, group: str = "media_id") -> DataFrame:
    """Cues made of their words (``resegment``), or the cues as they were where there are no timed words or the result does not hold: group, pos,
    text, start_ms, end_ms, fallback (null, or the first of no_word_timestamps, empty_resegment, invalid_timestamps, overlap, text_conservation_failed, word_conservation_failed)."""
    made = kept(resegment(words, pause_ms, group))  # read by each of the checks
    before = F.max("end_ms").over(_order(group).rowsBetween(Window.unboundedPreceding, -1))
    checked = made.withColumn("before", before).groupBy(group).agg(
        F.count_if((F.col("start_ms") < 0) | (F.col("end_ms") <= F.col("start_ms"))).alias("n_bad"), F.count_if(F.col("start_ms") < F.col("before")).alias("n_over"), F.sum("n_words").alias("n_made"), F.lit(True).alias("there"),
    )
    given = words.groupBy(group).agg(F.count_if(F.trim(F.coalesce("text", F.lit(""))) != "").alias("n_given"), F.count_if((F.trim(F.coalesce("text", F.lit(""))) != "") & (F.col("end_ms") > F.col("start_ms"))).alias("n_timed"))
    rows = cues.select(group).distinct()
    for side in (given, checked, _text_print(cues, "was", group), _text_print(made, "now", group)):
        rows = rows.join(side, group, "left")
    code = (
        F.when(F.coalesce("n_timed", F.lit(0)) == 0, "no_word_timestamps").when(F.col("there").isNull(), "empty_resegment").when(F.col("n_bad") > 0, "invalid_timestamps").when(F.col("n_over") > 0, "overlap")
        .when(~F.col("was").eqNullSafe(F.col("now")), "text_conservation_failed").when(F.col("n_made") != F.col("n_given"), "word_conservation_failed")
    )
    codes = rows.select(group, code.alias("fallback"))
    columns = [group, "pos", "text", "start_ms", "end_ms"]
    new = made.select(*columns).join(codes.where("fallback is null"), group)
    return new.unionByName(cues.select(*columns).join(codes.where("fallback is not null"), group))
