"""Conversation structure repair (operator 12), a min-plus matrix scan.

Turns are kept (0), given another role (R, 3), deleted (D, 4; the only edit for blank and
repeated turns), and empty ones inserted anywhere (I, 3); a truncated turn that stays adds 3. The
cheapest edits are sought that leave role initials ``(s?(ua)+)?``, of equally cheap
ones those whose initials, in order, are ASCII-least.

1. Rows that are equal become one with a count, so that no row repeats by the million; they are found by hashes, without their texts.
2. Rows are range-sorted by (conversation, turn, role, text): a long conversation is spread over many tasks.
3. Each task folds its rows to *pieces* of at most ``PIECE`` rows or ``PIECE_CHARS`` code points of a conversation. A turn is a
   4x4 matrix: entry (i, j) is the cheapest (cost, edits) that leads from state i to
   state j; insertions before it are part of it. A piece is the product of its turns.
4. Products are associative, so pieces are multiplied ``FAN`` at a time, level by level, until one matrix is left of each conversation.
   The cheapest entry from the start to an accepting state, with insertions after the last turn, is the answer.
5. The edits are cut along the pieces again, each piece writes its repaired texts, and the
   hash runs over these in order, a piece at a time; a conversation of one piece is hashed in place.

(cost, edits) with the lesser of pairs as sum and (addition, joining) as product is a semiring here: joining keeps the
order, since of two lists of edits of one cost neither begins with the other (all have a letter other than I for
each row, so that what one has more is insertions, and these cost).

Null roles and texts are one blank, which is no role to keep and a blank text; in the damage, null ids and turns are one blank too. Null
conversation ids are one conversation. Null turns come first; rows of one turn are in order of role and text. Very long texts are read whole. What a
conversation must have in one place is its edits (a letter a row), as its result has them. Other columns are not read. An empty table gives none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructType

from cuelake.llm.common import BATCH, BROADCAST_KEYS, arrow_task, materialize

PIECE, PIECE_CHARS, FAN = 1024, 1 << 20, 64
#: Edits of all pieces (a byte each) that are sent to all tasks; more are joined by shuffle.
SENT_EDITS = 64 << 20
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
NAMES = {"u": "user", "a": "assistant"}
BLANK = r"[\x20\x09-\x0D]"

#: States: nothing yet, after s, after u, after a. What each initial leads to.
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ACCEPTED = (0, 3)

Path = tuple[int, str]
Matrix = list[list[Path | None]]


def product(x: Matrix, y: Matrix) -> Matrix:
    out: Matrix = [[None] * 4 for _ in range(4)]
    for i in range(4):
        for k in range(4):
            if a := x[i][k]:
                for j in range(4):
                    if b := y[k][j]:
                        p = (a[0] + b[0], a[1] + b[1])
                        if out[i][j] is None or p < out[i][j]:
                            out[i][j] = p
    return out


def _insertions() -> Matrix:
    """The closure of insertions: the cheapest from each state to each other by inserted turns alone."""
    one: Matrix = [[(0, "") if i == j else None for j in range(4)] for i in range(4)]
    for i, steps in enumerate(STEPS):
        for c in "ua":
            if c in steps:
                one[i][steps[c]] = min(p for p in (one[i][steps[c]], (INSERT, "I")) if p)
    return product(product(one, one), one)


INSERTIONS = _insertions()
_known: dict[tuple[str, bool, bool], Matrix] = {}


def turn_matrix(initial: str, cut: bool, must_go: bool) -> Matrix:
    """Insertions, then one turn with this role initial: truncated or not, to be deleted or not."""
    key = (initial if initial in "sua" else "", cut, must_go)
    if key not in _known:
        m: Matrix = [[None] * 4 for _ in range(4)]
        stays = TRUNCATED if cut else 0
        for i, steps in enumerate(STEPS):
            edits = [(i, (DELETE, "D"))]
            if not must_go:
                edits += [(j, (stays, "K")) for c, j in steps.items() if c == initial]
                edits += [(j, (REROLE + stays, "R")) for c, j in steps.items() if c in "ua"]
            for j, p in edits:
                m[i][j] = p if m[i][j] is None else min(m[i][j], p)
        _known[key] = product(INSERTIONS, m)
    return _known[key]


def _power(x: Matrix, n: int) -> Matrix:
    out: Matrix = [[(0, "") if i == j else None for j in range(4)] for i in range(4)]
    while n:
        if n & 1:
            out = product(out, x)
        x, n = product(x, x) if n > 1 else x, n >> 1
    return out


def cheapest(m: Matrix) -> Path:
    """The answer of a whole conversation."""
    last = product([m[0]] + [[None] * 4] * 3, INSERTIONS)[0]
    return min(last[j] for j in ACCEPTED if last[j])


def multiplied(parts: Iterable[Matrix]) -> Matrix:
    """The product as a balanced tree, so that edits are joined in long runs only a few times."""
    level = list(parts)
    while len(level) > 1:
        level = [product(*level[k : k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n (times) of conversations after damage by crc32(conv_id:turn) % 20: 0 the row goes, 1 its text,
    2 its full stops and marks, 3 it is there twice, 4 it becomes the user's."""
    blank = F.lit(" ")
    h = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))) % 20
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    return rows.withColumn("h", h).where("h <> 0").select(
        "conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(role).alias("role"),
        F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(F.col("h") == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def _sent(rows: DataFrame, name: str) -> DataFrame:
    """rows without texts, written; sent to all tasks while they are few, joined by shuffle beyond."""
    rows = materialize(rows, name)
    return F.broadcast(rows) if rows.count() <= BROADCAST_KEYS else rows


def _ordered(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, n), equal ones as one, with again (a row before has its role and text). Both are found by 128-bit hashes; texts are only
    shuffled of rows that there are several of."""
    keyed = rows.withColumn("said", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))))
    stats = materialize(keyed.groupBy("conv_id", "turn", "said").agg(F.sum("n").alias("n"), F.count("*").alias("rows")), "turn-said")
    # of what is said on several turns, the first one; nulls are before all others
    first = stats.groupBy("conv_id", "said").agg(F.min("turn").alias("first"), F.max(F.col("turn").isNull()).alias("early"), F.count("*").alias("k")).where("k > 1")
    first = _sent(first.select(F.col("conv_id").alias("c"), F.col("said").alias("s"), F.when(~F.col("early"), F.col("first")).alias("first")), "turn-first")
    joined = keyed.join(first, keyed["conv_id"].eqNullSafe(first["c"]) & (keyed["said"] == first["s"]), "left")
    joined = joined.select("conv_id", "turn", "role", "text", "n", "said", (F.col("s").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first"))).alias("again"))
    several = _sent(stats.where("rows > 1").select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("said").alias("s"), F.col("n").alias("all")), "turn-several")
    if several.isEmpty():
        return joined.drop("said")
    same = joined["conv_id"].eqNullSafe(several["c"]) & joined["turn"].eqNullSafe(several["t"]) & (joined["said"] == several["s"])
    once = joined.join(several, same).withColumn("n", F.col("all")).select(*joined.columns).dropDuplicates(["conv_id", "turn", "said"])
    return joined.join(several, same, "left_anti").unionByName(once).drop("said")


#: What the pieces of a conversation, or several of them joined, are known by.
FACTS = (
    "costs array<long>, edits array<string>, rows long, blank long, duplicate long, truncated long, illegal long, first_role string, last_role string, "
    "turns long, least_turn long, most_turn long, first_turn long, last_turn long"
)
_NAMES = [f.split()[0] for f in FACTS.split(", ")]


def _flat(m: Matrix) -> tuple[list[int | None], list[str | None]]:
    return [p and p[0] for r in m for p in r], [p and p[1] for r in m for p in r]


def _matrix(costs: Iterable[int | None], edits: Iterable[str | None]) -> Matrix:
    flat = [None if e is None else (int(c), e) for c, e in zip(costs, edits, strict=True)]
    return [flat[k : k + 4] for k in range(0, 16, 4)]


def _bad(a: str, b: str) -> int:
    return int((a, b) not in (("s", "u"), ("u", "a"), ("a", "u")))


def _facts(rows: list[tuple]) -> dict:
    """Of rows (turn, role, text, n, again) in order."""
    out = dict.fromkeys(_NAMES)
    out |= dict.fromkeys(("rows", "blank", "duplicate", "truncated", "illegal", "turns"), 0)
    matrices, before, last_turn = [], None, None
    for turn, role, text, n, again in rows:
        initial, found = role[:1], re.sub(BLANK, "", text[-64:]) or re.sub(BLANK, "", text)
        blank = not found
        cut = not blank and found[-1] not in ".!?"
        out["rows"] += n
        if blank:
            out["blank"] += n
        else:
            out["duplicate"] += n if again else n - 1
            out["truncated"] += int(cut and not again)
        matrices.append(turn_matrix(initial, cut, blank or again))
        if n > 1:
            matrices.append(_power(turn_matrix(initial, cut, True), n - 1))
        if before is not None:
            out["illegal"] += _bad(before, initial)
        out["illegal"] += (n - 1) * _bad(initial, initial)
        out["first_role"] = initial if before is None else out["first_role"]
        before = initial
        if turn is not None:
            out["turns"] += int(turn != last_turn)
            out["first_turn"] = turn if out["first_turn"] is None else out["first_turn"]
            last_turn = turn
    costs, edits = _flat(multiplied(matrices))
    # rows are sorted, so the ends are the least and the most
    return out | {"costs": costs, "edits": edits, "last_role": before, "last_turn": last_turn, "least_turn": out["first_turn"], "most_turn": last_turn}


def _joined(parts: list[dict]) -> dict:
    """The facts of parts that follow each other."""
    out = dict(parts[0])
    for p in parts[1:]:
        for name in ("rows", "blank", "duplicate", "truncated"):
            out[name] += p[name]
        out["illegal"] += p["illegal"] + _bad(out["last_role"], p["first_role"])
        out["last_role"] = p["last_role"]
        if p["turns"]:
            out["turns"] += p["turns"] - int(out["last_turn"] == p["first_turn"])
            for name in ("least_turn", "first_turn"):
                out[name] = p[name] if out[name] is None else out[name]
            out["most_turn"] = out["last_turn"] = p["last_turn"]
    costs, edits = _flat(multiplied(_matrix(p["costs"], p["edits"]) for p in parts))
    return out | {"costs": costs, "edits": edits}


def _pieces(ordered: DataFrame, piece: int) -> DataFrame:
    """conv_id, part, piece, facts and the rows (roles, texts, times) of each piece."""
    id_type = ordered.schema["conv_id"].dataType.simpleString()
    n = int(ordered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["conv_id", "turn", "role", "text"]
    dealt = ordered.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    schema = f"conv_id {id_type}, part int, piece int, {FACTS}, roles array<string>, texts array<string>, times array<long>"
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, conv, waiting, chars, ready, held = TaskContext.get().partitionId(), 0, None, [], 0, [], 0

        def made() -> dict:
            return {"conv_id": conv, "part": part, "piece": number, **_facts(waiting), "roles": [r[1] for r in waiting], "texts": [r[2] for r in waiting], "times": [r[3] for r in waiting]}

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "n", "again")), strict=True):
                if waiting and (row[0] != conv or len(waiting) >= piece or chars >= PIECE_CHARS):
                    ready.append(made())
                    held += chars
                    waiting, chars, number = [], 0, number + 1
                    if len(ready) >= BATCH or held >= PIECE_CHARS:
                        yield pa.RecordBatch.from_pylist(ready, kinds)
                        ready, held = [], 0
                conv = row[0]
                waiting.append(row[1:])
                chars += len(row[3])
        if waiting:
            ready.append(made())
        if ready:
            yield pa.RecordBatch.from_pylist(ready, kinds)

    return dealt.mapInArrow(arrow_task(run), schema)


def _reduced(pieces: DataFrame, fan: int) -> DataFrame:
    """conv_id and the facts of whole conversations: pieces (conv_id, k, facts) multiplied fan at a time."""
    id_type = pieces.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {id_type}, k long, {FACTS}"
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(rows: pa.Table) -> pa.Table:
        parts = sorted(rows.to_pylist(), key=lambda r: r["k"])
        return pa.Table.from_pylist([_joined(parts) | {"k": parts[0]["k"] // fan}], kinds)

    level = pieces.select("conv_id", "k", *_NAMES)
    while True:
        level = level.withColumn("g", F.floor(F.col("k") / fan)).groupBy("conv_id", "g").applyInArrow(lambda rows: run(rows.drop_columns("g")), schema)
        level = materialize(level, "turn-level")
        if level.where("k > 0").isEmpty():
            return level.drop("k")


@F.pandas_udf(StructType().add("cost", "long").add("audit", "string"))
def _answers(costs: pd.Series, edits: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([cheapest(_matrix(c, e)) for c, e in zip(costs, edits, strict=True)], columns=["cost", "audit"])


@F.pandas_udf(ArrayType(StructType().add("part", "integer").add("piece", "integer").add("done", "long").add("edits", "string")))
def _slices(audit: pd.Series, listed: pd.Series) -> pd.Series:
    """A conversation's edits along its pieces (part, piece, rows): each has the insertions before its rows, the last those after too."""

    def one(edits: str, parts: list) -> list[dict]:
        out, at, done = [], 0, 0
        parts = sorted(((p["part"], p["piece"], p["rows"]) for p in parts))
        for part, piece, rows in parts:
            start = at
            while rows:
                rows -= edits[at] != "I"
                at += 1
            if (part, piece) == parts[-1][:2]:
                at = len(edits)
            out.append({"part": part, "piece": piece, "done": done, "edits": edits[start:at]})
            done += at - start - edits.count("D", start, at)
        return out

    return pd.Series([one(a, p) for a, p in zip(audit, listed, strict=True)])


def repaired_turns(roles: list[str], texts: list[str], times: list[int], edits: str, done: int, system: bool) -> Iterator[tuple[str, str]]:
    """(role, text) of what stays or comes, from a piece's rows and edits; done: turns before; system: the first of all is the system's."""
    rows = ((r, t) for r, t, n in zip(roles, texts, times, strict=True) for _ in range(n))
    for e in edits:
        role, text = ("", "") if e == "I" else next(rows)
        if e == "D":
            continue
        wanted = "ua"[(done - system) % 2]
        yield (role if e == "K" else NAMES[wanted]), text
        done += 1


_REPAIRED = ("roles", "texts", "times", "edits", "done", "system")


def _texts(pieces: DataFrame) -> DataFrame:
    """conv_id, part, piece, lines (repaired role:text, newline-joined) of pieces with edits, done, system."""
    id_type = pieces.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = []
            for row in zip(*(batch.column(c).to_pylist() for c in _REPAIRED), strict=True):
                found = [f"{r}:{t}" for r, t in repaired_turns(*row)]
                lines.append("\n".join(found) if found else None)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("part"), batch.column("piece"), pa.array(lines, pa.string())], names=["conv_id", "part", "piece", "lines"])

    return pieces.mapInArrow(arrow_task(run), f"conv_id {id_type}, part int, piece int, lines string")


def _hashes(pieces: DataFrame) -> DataFrame:
    """c (conv_id), repaired_sha256 of pieces with edits, done, system, alone (the only one of its conversation). What is in one piece is hashed where it is; of the
    others, the repaired texts run through the hash in order, one piece at a time."""
    id_type = pieces.schema["conv_id"].dataType.simpleString()
    schema = f"c {id_type}, repaired_sha256 string"

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired_turns(*row)).encode()).hexdigest() for row in zip(*(batch.column(c).to_pylist() for c in _REPAIRED), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(made, pa.string())], names=["c", "repaired_sha256"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def rows() -> Iterator[tuple]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field("conv_id").type
                yield from zip(batch.column("conv_id").to_pylist(), batch.column("lines").to_pylist(), strict=True)

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], kind), pa.array([r[1] for r in out])], names=["c", "repaired_sha256"])

        out: list[tuple] = []
        for conv, group in groupby(rows(), key=lambda r: r[0]):
            digest = hashlib.sha256()
            for k, (_, text) in enumerate(group):
                digest.update(("\n" if k else "").encode() + text.encode())
            out.append((conv, digest.hexdigest()))
            if len(out) >= BATCH:
                yield made()
                out = []
        if out:
            yield made()

    lines = _texts(pieces.where("not alone").drop("alone")).where("lines is not null")
    several = lines.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece").mapInArrow(arrow_task(run), schema)
    return pieces.where("alone").select("conv_id", *_REPAIRED).mapInArrow(arrow_task(alone), schema).unionByName(several)


def repair(rows: DataFrame, piece: int = PIECE, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """Of conversations (conv_id, turn, role, text, n times): one row per conversation with its faults, cost, audit; and its pieces (conv_id, part, piece, roles, texts, times of each
    row) with what repairs them: edits, done (turns before), system, alone (the only piece). ``repaired_turns`` gives a piece's turns."""
    pieces = materialize(_pieces(_ordered(rows), piece), "turn-pieces")
    # a piece's number in its conversation: those of other parts before it, and those before it in its own part
    spread = pieces.groupBy("conv_id", "part").agg(F.min("piece").alias("least"), F.count("*").alias("of"))
    of_one = Window.partitionBy("conv_id")
    before = F.coalesce(F.sum("of").over(of_one.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spread = spread.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), (before - F.col("least")).alias("shift"), F.sum("of").over(of_one).alias("all"))
    numbered = pieces.join(spread, pieces["conv_id"].eqNullSafe(spread["c"]) & (pieces["part"] == spread["p"])).withColumn("k", F.col("piece") + F.col("shift"))
    whole = numbered.where("all = 1").select("conv_id", *_NAMES).unionByName(_reduced(numbered.where("all > 1"), fan))
    found = materialize(whole.withColumn("a", _answers("costs", "edits")).select("conv_id", *[n for n in _NAMES if n not in ("costs", "edits")], "a.cost", "a.audit"), "turn-answers")

    listed = pieces.groupBy(F.col("conv_id").alias("c")).agg(F.collect_list(F.struct("part", "piece", "rows")).alias("listed"))
    cut = found.join(listed, found["conv_id"].eqNullSafe(listed["c"])).select(
        "c", (F.length(F.replace("audit", F.lit("D"), F.lit(""))) % 2 == 1).alias("system"), (F.size("listed") == 1).alias("alone"), F.explode(_slices("audit", "listed")).alias("s")
    )
    cut = materialize(cut.select("c", "system", "alone", F.col("s.part").alias("p"), F.col("s.piece").alias("q"), "s.done", "s.edits"), "turn-edits")
    size = cut.agg(F.count("*"), F.sum(F.length("edits"))).first()
    cut = F.broadcast(cut) if size[0] <= BROADCAST_KEYS and (size[1] or 0) <= SENT_EDITS else cut
    with_edits = pieces.drop("edits").join(cut, pieces["conv_id"].eqNullSafe(cut["c"]) & (pieces["part"] == cut["p"]) & (pieces["piece"] == cut["q"]))
    return found, with_edits.select("conv_id", "part", "piece", *_REPAIRED, "alone")


def _or_none(name: str) -> Column:
    return F.coalesce(name, F.lit(0).cast("long")).alias(name)


def repair_report(conversations: DataFrame, piece: int = PIECE, fan: int = FAN) -> DataFrame:
    """One row per conversation of conversations (conv_id, turn, role, text), damaged first: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    found, pieces = repair(damaged(conversations.select("conv_id", "turn", "role", "text")), piece, fan)
    gaps = F.coalesce(F.col("most_turn") - F.col("least_turn") + 1 - F.col("turns"), F.lit(0).cast("long"))
    found = found.select(F.col("conv_id").alias("f"), gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    ids = conversations.groupBy("conv_id").agg(F.lit(1).alias("_"))
    hashes = _hashes(pieces)
    out = ids.join(found, ids["conv_id"].eqNullSafe(found["f"]), "left").join(hashes, ids["conv_id"].eqNullSafe(hashes["c"]), "left")
    empty = hashlib.sha256().hexdigest()
    return out.select(
        "conv_id", *[_or_none(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"),
    )
