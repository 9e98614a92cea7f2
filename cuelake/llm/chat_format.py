"""Chat formatting by perspective rotation (operator 7), DataFrame functions only.

For every participant of a conversation, the dialogue is rendered with that
speaker as the assistant and all others as named users; system messages stay
as they are. Masks are the spans of the assistant's contents in the rendered
text, which training learns from.

Turns are in order of their number (null last), then role and text. A row holds the turns of
TURNS turn numbers, or of those without a number, and a piece of TURNS of them where
numbers repeat: a longer dialogue comes in several parts and pieces, in order, so that no conversation
is ever gathered as a whole, however long or hot. Where a part has more than TURNS messages (repeated or missing
numbers, null conversations), equal messages are counted, and all are numbered by a range sort over many tasks. Texts are gathered once into
pieces; participants are joined to pieces, and each perspective is rendered from the piece. System messages are no perspective; nor are
messages without a role (null or empty), which are named ``unknown``. Null texts are
empty; what would open or close a message in a text or name is escaped, and a name is one line. Very long texts are rendered whole, a piece of them in one row. A conversation with no participant gives no row. Messages that repeat are
each rendered. A null conv_id is a conversation of its own. An empty table gives none; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.llm.common import BROADCAST_KEYS, materialize

TURNS = 1024
SYSTEM, NOBODY = "system", "unknown"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
MARK, ESCAPED = "<|im_", "<|_im_"


def escaped(text: Column) -> Column:
    """text without a message's marks."""
    return F.replace(text, F.lit(MARK), F.lit(ESCAPED))


def _spoken(conversations: DataFrame) -> DataFrame:
    """conv_id, part, last, turn, speaker, content of each message; last and what follows is a part's order."""
    speaker = F.when(F.coalesce("role", F.lit("")) == "", F.lit(NOBODY)).otherwise(F.col("role"))
    return conversations.select("conv_id", F.floor(F.col("turn") / TURNS).cast("long").alias("part"), F.col("turn").isNull().alias("last"), "turn", speaker.alias("speaker"), escaped(F.coalesce("text", F.lit(""))).alias("content"))


_MESSAGE = ["last", "turn", "speaker", "content"]


def _same(left: DataFrame, right: DataFrame, *pairs: tuple[str, str]) -> Column:
    out = F.lit(True)
    for a, b in pairs:
        out = out & left[a].eqNullSafe(right[b])
    return out


def _numbered(crowded: DataFrame) -> DataFrame:
    """conv_id, part, piece, m of parts with more than TURNS messages. Each task numbers its range of the order, from where those before it end."""
    equal = crowded.groupBy("conv_id", "part", *_MESSAGE).agg(F.count("*").alias("n"))
    tasks = int(crowded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(materialize(equal, "chat-equal").repartitionByRange(tasks, "conv_id", "part", *_MESSAGE).withColumn("task", F.spark_partition_id()), "chat-dealt")
    totals = dealt.groupBy("conv_id", "part", "task").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id", "part").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select(F.col("conv_id").alias("_c"), F.col("part").alias("_p"), F.col("task").alias("_t"), before.alias("start"))
    rows = dealt.join(starts, _same(dealt, starts, ("conv_id", "_c"), ("part", "_p")) & (dealt["task"] == starts["_t"]))
    inside = Window.partitionBy("conv_id", "part", "task").orderBy(*_MESSAGE).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.col("start") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    piece = lambda at: F.floor(at / TURNS).cast("long")
    rows = rows.withColumn("piece", F.explode(F.sequence(piece(F.col("at")), piece(F.col("at") + F.col("n") - 1))))
    times = F.least(F.col("at") + F.col("n"), (F.col("piece") + 1) * TURNS) - F.greatest("at", F.col("piece") * TURNS)
    listed = F.array_sort(F.collect_list(F.struct(*_MESSAGE, times.cast("int").alias("times"))))
    each = F.transform(listed, lambda x: F.array_repeat(F.struct(*[x[c].alias(c) for c in _MESSAGE]), x["times"]))
    return rows.groupBy("conv_id", "part", "piece").agg(F.flatten(each).alias("m"))


def pieces(conversations: DataFrame) -> DataFrame:
    """conv_id, part, piece, m (messages in order) of conversations."""
    rows = _spoken(conversations)
    crowded = materialize(rows.groupBy(F.col("conv_id").alias("_c"), F.col("part").alias("_p")).agg(F.count("*").alias("n")).where(F.col("n") > TURNS).drop("n"), "chat-crowded")
    gathered = lambda df: df.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct(*_MESSAGE))).alias("m")).select("conv_id", "part", F.lit(0).cast("long").alias("piece"), "m")
    if crowded.isEmpty():
        return gathered(rows)
    crowded = F.broadcast(crowded) if crowded.count() <= BROADCAST_KEYS else crowded
    same = _same(rows, crowded, ("conv_id", "_c"), ("part", "_p"))
    return gathered(rows.join(crowded, same, "left_anti")).unionByName(_numbered(rows.join(crowded, same, "left_semi")))


def rotate(conversations: DataFrame) -> DataFrame:
    """conv_id, perspective, part, piece, n_messages, n_masked (messages of the
    assistant), rendered, mask (spans ``from-to`` in characters, comma-joined)."""
    able = _spoken(conversations).where(~F.col("speaker").isin(SYSTEM, NOBODY)).select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")).distinct()
    able = materialize(able, "chat-participants")
    able = F.broadcast(able) if able.count() <= BROADCAST_KEYS else able
    rows = pieces(conversations)
    rows = rows.join(able, rows["conv_id"].eqNullSafe(able["_conv"]))
    own = lambda x: x["speaker"] == F.col("perspective")

    def header(x: Column) -> Column:
        name = escaped(F.regexp_replace(x["speaker"], r"[\r\n]+", " "))
        role = F.when(x["speaker"] == SYSTEM, F.lit(SYSTEM)).when(own(x), "assistant").otherwise(F.concat(F.lit("user name="), name))
        return F.concat(F.lit(OPEN), role, F.lit("\n"))

    marked = F.transform("m", lambda x: F.struct(own(x).alias("own"), F.length(header(x)).alias("head"), F.length(x["content"]).alias("size")))
    segments = F.transform("m", lambda x: F.concat(header(x), x["content"], F.lit(CLOSE)))

    def step(acc, x):
        start = acc["at"] + x["head"]
        end = start + x["size"]
        spans = F.when(x["own"], F.concat(acc["spans"], F.array(F.concat(start.cast("string"), F.lit("-"), end.cast("string"))))).otherwise(acc["spans"])
        return F.struct((end + F.lit(len(CLOSE))).alias("at"), spans.alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    return rows.select(
        "conv_id", "perspective", "part", "piece", F.size("m").cast("long").alias("n_messages"), F.size(F.filter("m", own)).cast("long").alias("n_masked"),
        F.array_join(segments, "").alias("rendered"), F.array_join(F.aggregate(marked, start, step)["spans"], ",").alias("mask"),
    )
