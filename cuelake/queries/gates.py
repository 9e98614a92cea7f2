"""Queries over gates: rounds, proofs, outputs, evaluations and comparisons of strategies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.bridge import CUES_SQL, cues, table
from cuelake.functions.answers import EQUIVALENCE, PROOF
from cuelake.operators import gates as G
from cuelake.queries.registry import query

_FLAGS = (*EQUIVALENCE, *PROOF)

#: Rounds made of orders: most pass, others miss one condition each (in turn by their key), which a case table in Python has by hand.
_ROUND_CASES = [
    ({}, True), ({"complete": None}, False), ({"cue_count_unchanged": False}, False), ({"timeline_unchanged": False}, False), ({"blocking_issue_count": 1}, False), ({"adjacent_overlap_delta": 1}, False),
    ({"adjacent_overlap_delta": -2}, True), ({"adjacent_overlap_delta": None}, False), ({"attempted": 2}, False), ({"accepted": 2, "rejected": 1}, False), ({"judge_requests": 5}, True), ({"judge_requests": None}, False),
    ({"quality_model_unavailable": None}, False), ({"unresolved_count": 1}, False), ({"budget_exhausted": True}, False), ({}, True),
]
_ROUND = {"complete": True, "cue_count_unchanged": True, "timeline_unchanged": True, "blocking_issue_count": 0, "adjacent_overlap_delta": 0, "attempted": 3, "accepted": 3, "rejected": 0, "judge_requests": 3, "quality_model_unavailable": False, "unresolved_count": 0, "budget_exhausted": False}


@query("f30_round_passed", f"SELECT o_orderkey, [{', '.join(str(p).lower() for _, p in _ROUND_CASES)}][o_orderkey % {len(_ROUND_CASES)} + 1] AS passed FROM orders")
def round_passed(spark: SparkSession, d: str) -> DataFrame:
    k = (F.col("o_orderkey") % len(_ROUND_CASES)).cast("int")
    pick = lambda name: F.element_at(F.array(*[F.lit(({**_ROUND, **case})[name]) for case, _ in _ROUND_CASES]), k + 1)
    return table(spark, d, "orders").select("o_orderkey", *[pick(name).alias(name) for name in _ROUND]).select("o_orderkey", G.round_passed(F.lit(3)).alias("passed"))


#: Judgments of the texts that were mended (pos % 3 = 1) or shortened (pos % 3 = 2); some are missing, unsure, of the other side, or lack a flag.
_FINALS = """finals AS (SELECT media_id, pos, CASE pos % 3 WHEN 0 THEN 'initial' WHEN 1 THEN 'repair' ELSE 'shortening' END AS origin FROM cues),
judged AS (SELECT media_id, pos, CASE WHEN (media_id + pos) % 23 = 5 THEN 'low' ELSE 'high' END AS confidence, CASE WHEN silence_milli % 2 = 0 THEN 'A' ELSE 'B' END AS mapped,
  CASE WHEN (media_id * 3 + pos) % 29 = 4 THEN 'TIE' WHEN silence_milli % 2 = 0 THEN 'A' ELSE 'B' END AS choice, (media_id + pos * 5) % 31 <> 7 AS logic, (media_id * 7 + pos) % 17 <> 3 AS no_new_error FROM cues WHERE pos % 3 <> 0 AND (media_id + pos) % 37 <> 1)"""


def finals(rows: DataFrame) -> DataFrame:
    p = F.col("pos") % 3
    return rows.select("media_id", "pos", F.when(p == 0, "initial").when(p == 1, "repair").otherwise("shortening").alias("origin"))


def judgments(rows: DataFrame) -> DataFrame:
    m, p = F.col("media_id"), F.col("pos")
    side = F.when(F.col("silence_milli") % 2 == 0, "A").otherwise("B")
    flags = {name: F.lit(True) for name in _FLAGS} | {"logic": (m + p * 5) % 31 != 7, "no_new_error": (m * 7 + p) % 17 != 3}
    rows = rows.where((p % 3 != 0) & ((m + p) % 37 != 1))
    return rows.select(
        "media_id", "pos", F.when(p % 3 == 1, "repair").otherwise("shortening").alias("origin"), F.when((m + p) % 23 == 5, "low").otherwise("high").alias("confidence"), side.alias("mapped"),
        F.when((m * 3 + p) % 29 == 4, "TIE").otherwise(side).alias("choice"), F.create_map(*[x for name, c in flags.items() for x in (F.lit(name), c)]).alias("flags"),
    )


def _proved(pilot: bool) -> str:
    flags = "(f.origin = 'repair' OR logic)" if pilot else "logic AND no_new_error"
    return f"SELECT f.media_id, bool_and(f.origin = 'initial' OR coalesce(confidence = 'high' AND choice = mapped AND {flags}, false)) AS proved FROM finals f LEFT JOIN judged j ON f.media_id = j.media_id AND f.pos = j.pos GROUP BY f.media_id"


@query("f31_proofs", f"WITH {CUES_SQL}, {_FINALS} {_proved(False)}")
def proofs(spark: SparkSession, d: str) -> DataFrame:
    rows = cues(spark, d)
    return G.proofs(finals(rows), judgments(rows))


@query("f34_outputs_valid", """WITH o AS (SELECT l_orderkey AS k, l_linenumber AS n, l_quantity AS size FROM lineitem)
SELECT o_orderkey AS task_id, o_orderstatus AS status, o_orderstatus = 'F' AND bool_and(EXISTS (SELECT 1 FROM o WHERE o.k = t.o_orderkey AND o.n = t.need AND o.size > 20)) AS valid FROM (SELECT *, unnest(CASE WHEN o_orderkey % 2 = 0 THEN [1, 2] ELSE [1] END) AS need FROM orders) t GROUP BY o_orderkey, o_orderstatus""")
def outputs_valid(spark: SparkSession, d: str) -> DataFrame:
    """Orders as tasks that need one output or two, their lines as outputs, whose quantity over 20 is their size."""
    required = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("1"), F.lit("2"))).otherwise(F.array(F.lit("1")))
    status = F.when(F.col("o_orderstatus") == "F", "completed").otherwise(F.col("o_orderstatus"))
    tasks = table(spark, d, "orders").select(F.col("o_orderkey").alias("task_id"), status.alias("status"), required.alias("required"))
    outputs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").cast("string").alias("name"), (F.col("l_quantity") - 20).alias("size"))
    return G.outputs_valid(tasks, outputs).withColumn("status", F.when(F.col("status") == "completed", "F").otherwise(F.col("status")))


#: What was rendered: a cue in 40 is missing, another is empty, another is moved.
_RENDERED = """rendered AS (SELECT media_id, pos, start_ms + CASE WHEN (media_id * 11 + pos) % 41 = 2 THEN 1 ELSE 0 END AS start_ms, end_ms, CASE WHEN (media_id + pos * 7) % 43 = 3 THEN ' ' ELSE text END AS text FROM cues WHERE (media_id * 5 + pos) % 47 <> 4),
structure AS (SELECT media_id, count(s.pos) AS cue_count, bool_and(s.pos IS NOT DISTINCT FROM r.pos) AS ids_equal, bool_and(s.start_ms IS NOT DISTINCT FROM r.start_ms AND s.end_ms IS NOT DISTINCT FROM r.end_ms) AS times_equal
  FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY pos) AS k FROM cues) s FULL JOIN (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY pos) AS k FROM rendered) r USING (media_id, k) GROUP BY media_id),
hollow AS (SELECT c.media_id, count(*) AS n_empty FROM cues c LEFT JOIN rendered r ON c.media_id = r.media_id AND c.pos = r.pos AND trim(r.text) <> '' WHERE r.pos IS NULL GROUP BY c.media_id)"""


def rendered(rows: DataFrame) -> DataFrame:
    m, p = F.col("media_id"), F.col("pos")
    start = F.col("start_ms") + F.when((m * 11 + p) % 41 == 2, 1).otherwise(0)
    return rows.where((m * 5 + p) % 47 != 4).select("media_id", "pos", start.alias("start_ms"), "end_ms", F.when((m + p * 7) % 43 == 3, " ").otherwise(F.col("text")).alias("text"))


_CHECKS = """checked AS (SELECT c.media_id, c.pos, (contains(t, 'e') OR contains(t, 'zz')) AND NOT contains(t, 'x') AS passed FROM cues c LEFT JOIN (SELECT media_id, pos, text AS t FROM rendered) r USING (media_id, pos) WHERE c.pos = 2)"""


def checks(rows: DataFrame) -> DataFrame:
    one = rows.where("pos = 2")
    return one.select("media_id", "pos", F.lit("letters").alias("name"), F.array(F.lit("zz"), F.lit("e")).alias("required"), F.array(F.lit("x")).alias("forbidden"))


@query("a38_structure_and_checks", f"WITH {CUES_SQL}, {_RENDERED}, {_CHECKS} SELECT s.*, coalesce(n_empty, 0) AS n_empty, coalesce(c.passed, false) AS passed FROM structure s LEFT JOIN hollow USING (media_id) LEFT JOIN checked c USING (media_id)")
def structure_and_checks(spark: SparkSession, d: str) -> DataFrame:
    rows = cues(spark, d)
    known = G.known_checks(rendered(rows), checks(rows)).select("media_id", "passed")
    return G.structure(rows, rendered(rows)).join(known, "media_id", "left").withColumn("passed", F.coalesce("passed", F.lit(False)))


_SAMPLES = """samples AS (SELECT s.*, coalesce(n_empty, 0) AS n_empty, proved, s.media_id % 97 <> 5 AS completed, n_budget, n_errors, n_safe FROM structure s LEFT JOIN hollow USING (media_id) JOIN proved USING (media_id)
  JOIN (SELECT media_id, count(*) FILTER (WHERE pos % 13 = 0) AS n_budget, count(*) FILTER (WHERE pos % 19 = 7 AND turn % 2 = 0) AS n_errors, count(*) FILTER (WHERE pos % 19 = 7 AND turn % 2 = 1) AS n_safe FROM cues GROUP BY media_id) USING (media_id))"""


def samples(rows: DataFrame, pilot: bool) -> DataFrame:
    p = F.col("pos")
    errors = rows.where(p % 19 == 7).select("media_id", F.lit("shortening:3").alias("stage"), F.when(F.col("turn") % 2 == 1, "equivalence was not fully confirmed").otherwise("timeout").alias("error"))
    out = G.structure(rows, rendered(rows)).join(G.proofs(finals(rows), judgments(rows), G.PILOT_FLAGS if pilot else G.ALL_FLAGS), "media_id")
    out = out.join(rows.groupBy("media_id").agg(F.count_if(p % 13 == 0).alias("n_budget")), "media_id").join(G.stage_errors(errors), "media_id", "left").fillna(0, ["n_errors", "n_safe"])
    return out.withColumn("completed", F.col("media_id") % 97 != 5)


def _evaluated(pilot: bool) -> str:
    errors = "sum(n_errors)" if pilot else "sum(n_errors + n_safe)"
    more = " AND budget_violation_count <= 3" if pilot else ""
    return f"""WITH {CUES_SQL}, {_FINALS}, {_RENDERED}, {_CHECKS}, proved AS ({_proved(pilot)}), {_SAMPLES},
w AS (SELECT sum(cue_count)::BIGINT AS cue_count, bool_and(completed AND ids_equal AND times_equal AND n_empty = 0) AS structurally_valid, bool_and(proved) AS proof_gate_passed, {errors}::BIGINT AS stage_error_count, sum(n_budget)::BIGINT AS budget_violation_count FROM samples),
k AS (SELECT bool_and(coalesce(passed, false)) AS known_regressions_passed FROM checked)
SELECT *, CASE WHEN structurally_valid AND proof_gate_passed AND stage_error_count = 0 AND known_regressions_passed{more} THEN 'passed' ELSE 'failed' END AS status FROM w, k"""


@query("a38_evaluated", _evaluated(False))
def evaluated(spark: SparkSession, d: str) -> DataFrame:
    rows = cues(spark, d)
    return G.evaluated(samples(rows, False), G.known_checks(rendered(rows), checks(rows)))


@query("a37_pilot_evaluated", _evaluated(True))
def pilot_evaluated(spark: SparkSession, d: str) -> DataFrame:
    rows = cues(spark, d)
    return G.evaluated(samples(rows, True), G.known_checks(rendered(rows), checks(rows)), requests_used=80, request_limit=144, most_budget=3, safe_errors=True)


def _fast(text: str) -> str:
    return f"count(*) FILTER (WHERE end_ms > start_ms AND length(regexp_replace({text}, '[\\t\\n\\f\\r \\x0b]+', '', 'g')) * 1000 > 20 * (end_ms - start_ms))"


@query("j37_strategies", f"""WITH {CUES_SQL}, {_RENDERED}, f AS (SELECT c.media_id, {_fast('r.text')} AS a, {_fast("r.text || 'x'")} AS b, {_fast('left(r.text, 40)')} AS c
  FROM (SELECT media_id, pos, start_ms, end_ms FROM cues) c JOIN (SELECT media_id, pos, text FROM rendered) r USING (media_id, pos) GROUP BY c.media_id)
SELECT s.*, coalesce(n_empty, 0) AS n_empty, coalesce(a, 0) AS fast_semantic, coalesce(b, 0) AS fast_standard, coalesce(c, 0) AS fast_short, coalesce(a, 0) <= coalesce(b, 0) AS not_worse_than_standard, coalesce(a, 0) <= coalesce(c, 0) AS not_worse_than_short
FROM structure s LEFT JOIN hollow USING (media_id) LEFT JOIN f USING (media_id)""")
def strategies(spark: SparkSession, d: str) -> DataFrame:
    rows = cues(spark, d)
    first = rendered(rows)
    return G.strategies(rows, {"semantic": first, "standard": first.withColumn("text", F.concat("text", F.lit("x"))), "short": first.withColumn("text", F.left("text", F.lit(40)))}, 20)


@query("j13_benchmark", f"""WITH {CUES_SQL}, {_RENDERED}, c AS (SELECT 'same' AS label, * FROM rendered UNION ALL SELECT 'more', media_id, pos, start_ms, end_ms, CASE WHEN pos % 10 = 0 THEN '```json' || text ELSE text END FROM rendered UNION ALL SELECT 'more', media_id, pos + 1000, start_ms, end_ms, text FROM cues WHERE pos = 1),
want AS (SELECT label, media_id, pos, start_ms, end_ms, text FROM cues JOIN (SELECT DISTINCT media_id, label FROM c) USING (media_id)),
b AS (SELECT media_id, label, w.text AS y, c.text AS x, w.pos IS NOT NULL AS w, c.pos IS NOT NULL AS h, w.start_ms IS NOT DISTINCT FROM c.start_ms AND w.end_ms IS NOT DISTINCT FROM c.end_ms AS still FROM want w FULL JOIN c ON w.media_id = c.media_id AND w.label = c.label AND w.pos = c.pos
  CROSS JOIN LATERAL (SELECT coalesce(w.media_id, c.media_id) AS media_id, coalesce(w.label, c.label) AS label)),
t AS (SELECT media_id, sha256(string_agg(text, chr(10) ORDER BY pos)) AS now FROM cues GROUP BY media_id)
SELECT b.media_id, label, count(*) FILTER (WHERE w AND NOT h) AS n_missing, count(*) FILTER (WHERE h AND NOT w) AS n_extra, count(*) FILTER (WHERE w AND NOT still) AS n_moved, count(*) FILTER (WHERE h AND trim(x) = '') AS n_empty,
  count(*) FILTER (WHERE h AND starts_with(x, '```')) AS n_wrapped, n_missing + n_extra + n_moved + n_empty + n_wrapped = 0 AS passed, b.media_id % 3 <> 1 AS source_unchanged FROM b GROUP BY b.media_id, label""".replace(
    "SELECT media_id, label, w.text AS y", "SELECT k.media_id, k.label, w.text AS y").replace("AS media_id, coalesce(w.label, c.label) AS label)),", "AS media_id, coalesce(w.label, c.label) AS label) k),"))
def benchmark(spark: SparkSession, d: str) -> DataFrame:
    """Frozen digests hold of two recordings of three; likeness has a test of its own."""
    rows = cues(spark, d)
    out = rendered(rows)
    more = out.withColumn("text", F.when(F.col("pos") % 10 == 0, F.concat(F.lit("```json"), "text")).otherwise(F.col("text"))).unionByName(rows.where("pos = 1").select("media_id", (F.col("pos") + 1000).alias("pos"), "start_ms", "end_ms", "text"))
    candidates = out.withColumn("label", F.lit("same")).unionByName(more.withColumn("label", F.lit("more")))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    digest = F.when(F.col("media_id") % 3 == 1, "0").when(F.col("media_id") % 3 == 0, F.sha2(F.array_join(texts, "\n"), 256))
    frozen = rows.groupBy("media_id").agg(digest.alias("sha256"))
    return G.benchmark(frozen, rows, rows, candidates).drop("bigram_f1")
