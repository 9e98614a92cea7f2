"""Queries over retries of doubtful stretches: windows, reasons against a candidate, decisions and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.bridge import CUES_SQL, cues
from cuelake.operators import retry as P
from cuelake.queries.registry import query
from cuelake.queries.sequences import _PLAIN, _SUSPECT, _islands

_DOUBT = "(logprob_milli < -1000 OR compression_milli > 2400 OR (silence_milli > 600 AND trim(text) <> ''))"

#: Suspicious cues padded, merged and cut, with how many suspicious cues each has, and what a recording may spend.
_CUT = f"""wide AS (SELECT media_id, greatest(0, start_ms - 1250) AS start_ms, end_ms + 1250 AS end_ms FROM suspect WHERE suspicious), merged AS ({_islands(250, 'wide')}),
cut AS (SELECT media_id, island AS pos, CASE WHEN end_ms - start_ms > 30000 THEN greatest(0, (start_ms + end_ms) // 2 - 15000) ELSE start_ms END AS start_ms,
  CASE WHEN end_ms - start_ms > 30000 THEN (start_ms + end_ms) // 2 + 15000 ELSE end_ms END AS end_ms FROM merged)"""


def _quality(name: str, source: str, windows: str) -> str:
    """Measures of each window, for an SQL engine."""
    return f"""{name} AS (SELECT w.media_id, w.pos, count(c.cp) AS n, coalesce(sum(o), 0)::BIGINT AS covered_ms, avg(logprob_milli) AS mean_logprob, max(compression_milli) AS most_compression,
  count(*) FILTER (WHERE conflict) AS n_conflict, count(*) FILTER (WHERE again) AS n_again, count(*) FILTER (WHERE doubt OR again) AS n_suspicious, coalesce(sum(length(p)), 0)::BIGINT AS letters, min(c.start_ms) AS first_ms, max(c.end_ms) AS last_ms
  FROM {windows} w LEFT JOIN (SELECT *, coalesce(p <> '' AND p = lag(p) OVER (PARTITION BY media_id, pos ORDER BY cp), false) AS again FROM (
    SELECT w.media_id, w.pos, c.pos AS cp, c.start_ms, c.end_ms, c.logprob_milli, c.compression_milli, c.silence_milli > 600 AND trim(c.text) <> '' AS conflict, {_DOUBT} AS doubt, {_PLAIN} AS p, least(w.end_ms, c.end_ms) - greatest(w.start_ms, c.start_ms) AS o
    FROM {windows} w JOIN {source} c ON w.media_id = c.media_id WHERE c.start_ms < w.end_ms AND c.end_ms > w.start_ms)) c ON w.media_id = c.media_id AND w.pos = c.pos GROUP BY w.media_id, w.pos)"""


#: The budget, a row at a time in order.
_GREEDY = f"""{_quality('measured', 'cues', 'cut')},
ranked AS (SELECT c.*, n_suspicious, c.end_ms - c.start_ms AS cost, row_number() OVER (PARTITION BY c.media_id ORDER BY n_suspicious DESC, c.start_ms) AS k FROM cut c JOIN measured USING (media_id, pos)),
spend AS (SELECT media_id, floor(arg_max(end_ms, pos) * 0.1::DOUBLE)::BIGINT AS budget FROM cues GROUP BY media_id),
greedy AS (
  SELECT r.media_id, k, pos, cost, (budget <= 0 OR cost <= budget) AS taken, CASE WHEN budget <= 0 OR cost <= budget THEN cost ELSE 0 END AS used, (budget <= 0 OR cost <= budget)::INT AS n, budget FROM ranked r JOIN spend USING (media_id) WHERE k = 1
  UNION ALL
  SELECT r.media_id, r.k, r.pos, r.cost, g.n < 20 AND (budget <= 0 OR g.used + r.cost <= budget), g.used + CASE WHEN g.n < 20 AND (budget <= 0 OR g.used + r.cost <= budget) THEN r.cost ELSE 0 END, g.n + (g.n < 20 AND (budget <= 0 OR g.used + r.cost <= budget))::INT, budget
  FROM greedy g JOIN ranked r ON r.media_id = g.media_id AND r.k = g.k + 1),
planned AS (SELECT r.media_id, r.pos, r.start_ms, r.end_ms, r.n_suspicious, g.taken FROM ranked r JOIN greedy g USING (media_id, pos))"""
_PLAN = f"WITH RECURSIVE {CUES_SQL}, {_SUSPECT}, {_CUT}, {_GREEDY}"


@query("l01_retry_windows", f"{_PLAN} SELECT * FROM planned")
def retry_windows(spark: SparkSession, d: str) -> DataFrame:
    return P.plan_windows(cues(spark, d))


#: Another decoding of the same recording: cues that touch the one before begin later, every fifth text is doubled, every seventh
#: has a control character, every eleventh cue is missing, and confidences are those of the cue after next.
_CANDIDATE = """candidate AS (SELECT media_id, pos, CASE WHEN pos % 5 = 0 THEN text || ' ' || text WHEN pos % 7 = 0 THEN text || chr(7) ELSE text END AS text,
  greatest(start_ms, coalesce(lag(end_ms) OVER w, 0)) AS start_ms, greatest(end_ms, greatest(start_ms, coalesce(lag(end_ms) OVER w, 0)) + 300) AS end_ms,
  coalesce(lead(logprob_milli, 2) OVER w, -100) AS logprob_milli, coalesce(lead(compression_milli, 2) OVER w, 900) AS compression_milli, coalesce(lead(silence_milli, 2) OVER w, 0) AS silence_milli
  FROM cues WHERE (media_id + pos) % 11 <> 0 WINDOW w AS (PARTITION BY media_id ORDER BY pos))"""


def candidate(rows: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("media_id").orderBy("pos")
    rows = rows.where((F.col("media_id") + F.col("pos")) % 11 != 0)
    text = F.when(F.col("pos") % 5 == 0, F.concat_ws(" ", "text", "text")).when(F.col("pos") % 7 == 0, F.concat("text", F.lit("\x07"))).otherwise(F.col("text"))
    start = F.greatest("start_ms", F.coalesce(F.lag("end_ms").over(w), F.lit(0).cast("long")))
    later = lambda c, default: F.coalesce(F.lead(c, 2).over(w), F.lit(default).cast("long")).alias(c)
    return rows.select("media_id", "pos", text.alias("text"), start.alias("start_ms"), F.greatest(F.col("end_ms"), start + 300).alias("end_ms"), later("logprob_milli", -100), later("compression_milli", 900), later("silence_milli", 0))


def retried(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    rows = cues(spark, d)
    planned = P.plan_windows(rows)
    return rows, candidate(rows), planned, planned.where("taken").select("media_id", "pos", "start_ms", "end_ms")


_BAD = r"regexp_matches(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]')"
_AFTER = rf"""taken AS (SELECT media_id, pos, start_ms, end_ms FROM planned WHERE taken),
merged_after AS (SELECT *, lag(p) OVER w AS was, lag(end_ms) OVER w AS before FROM (SELECT *, {_PLAIN} AS p FROM (
  SELECT w.media_id, w.pos, c.start_ms, c.end_ms, c.text FROM taken w JOIN cues c USING (media_id) WHERE NOT (c.start_ms + c.end_ms) / 2 BETWEEN w.start_ms AND w.end_ms
  UNION ALL SELECT w.media_id, w.pos, c.start_ms, c.end_ms, c.text FROM taken w JOIN candidate c USING (media_id) WHERE c.start_ms < w.end_ms AND c.end_ms > w.start_ms))
  WINDOW w AS (PARTITION BY media_id, pos ORDER BY start_ms, end_ms, text)),
after AS (SELECT t.media_id, t.pos, count(*) FILTER (WHERE p <> '' AND p = was AND m.start_ms <= before + 250) AS n_again,
  count(*) FILTER (WHERE m.start_ms < 0 OR m.end_ms <= m.start_ms OR coalesce(m.start_ms < before, false) OR {_BAD}) AS n_invalid FROM taken t LEFT JOIN merged_after m ON t.media_id = m.media_id AND t.pos = m.pos GROUP BY t.media_id, t.pos)"""


@query("w22_after_replace", f"{_PLAN}, {_CANDIDATE}, {_AFTER} SELECT * FROM after")
def after_replace(spark: SparkSession, d: str) -> DataFrame:
    base, other, _, windows = retried(spark, d)
    return P.after_replace(base, other, windows)


_DECIDED = rf"""{_quality('b', 'cues', 'taken')}, {_quality('c', 'candidate', 'taken')},
broken AS (SELECT DISTINCT media_id FROM (SELECT media_id, start_ms < 0 OR end_ms <= start_ms OR {_BAD} OR coalesce(start_ms < lag(end_ms) OVER (PARTITION BY media_id ORDER BY pos), false) AS bad FROM candidate) WHERE bad),
control AS (SELECT DISTINCT t.media_id, t.pos FROM taken t JOIN candidate x ON t.media_id = x.media_id AND x.start_ms < t.end_ms AND x.end_ms > t.start_ms WHERE {_BAD}),
coded AS (SELECT media_id, pos, list_filter([
    CASE WHEN c.n = 0 AND b.n > 0 THEN 'empty_candidate' END, CASE WHEN c.first_ms IS NULL OR c.last_ms <= c.first_ms THEN 'invalid_candidate_timeline' END, CASE WHEN c.most_compression > 2800 THEN 'compression_hard_limit' END,
    CASE WHEN c.n_conflict > b.n_conflict THEN 'no_speech_regressed' END, CASE WHEN c.n_again > b.n_again THEN 'duplicate_regressed' END,
    CASE WHEN b.covered_ms > 0 AND NOT c.covered_ms::DOUBLE / b.covered_ms BETWEEN 0.75 AND 1.25 THEN 'coverage_out_of_range' END, CASE WHEN b.letters > 0 AND NOT c.letters::DOUBLE / b.letters BETWEEN 0.5 AND 1.8 THEN 'text_length_out_of_range' END,
    CASE WHEN media_id IN (SELECT media_id FROM broken) THEN 'candidate_artifact_invalid' END, CASE WHEN a.n_again > 0 OR a.n_invalid > 0 THEN 'adjacent_duplicate_regressed' END,
    CASE WHEN k.pos IS NOT NULL THEN 'control_text_detected' END], lambda x: x IS NOT NULL) AS codes,
  round(greatest(0, coalesce(c.mean_logprob - b.mean_logprob, 0)) / 1000 + greatest(0, coalesce(b.most_compression - c.most_compression, 0)) / 1000::DOUBLE * 0.5::DOUBLE + greatest(0, b.n_again - c.n_again) * 0.5::DOUBLE
    + greatest(0, b.n_conflict - c.n_conflict) * 0.5::DOUBLE + greatest(0, b.n_suspicious - c.n_suspicious) * 0.25::DOUBLE, 6) AS score,
  c.n_suspicious < b.n_suspicious OR c.n_again < b.n_again OR c.n_conflict < b.n_conflict OR coalesce(c.most_compression < b.most_compression, false) AS mended
  FROM b JOIN c USING (media_id, pos) JOIN after a USING (media_id, pos) LEFT JOIN control k USING (media_id, pos)),
decided AS (SELECT media_id, pos, len(codes) = 0 AND mended AND score >= 0.2 AS accepted, CASE WHEN len(codes) = 0 AND mended AND score >= 0.2 THEN 'accepted' WHEN len(codes) = 0 THEN 'no_clear_improvement' ELSE array_to_string(codes, ',') END AS reasons, score FROM coded)"""
_DECIDE = f"{_PLAN}, {_CANDIDATE}, {_AFTER}, {_DECIDED}"


@query("f21_m21_decided_windows", f"{_DECIDE} SELECT * FROM decided")
def decided(spark: SparkSession, d: str) -> DataFrame:
    base, other, _, windows = retried(spark, d)
    return P.decide(base, other, windows)


@query("a36_retry_counts", f"""{_DECIDE} SELECT p.media_id, count(*) AS n_planned, count(*) FILTER (WHERE taken) AS n_executed, count(*) FILTER (WHERE accepted) AS n_accepted, count(*) FILTER (WHERE taken AND NOT accepted) AS n_rejected, count(*) FILTER (WHERE NOT taken) AS n_skipped
FROM planned p LEFT JOIN decided d ON p.media_id = d.media_id AND p.pos = d.pos GROUP BY p.media_id""")
def retry_counts(spark: SparkSession, d: str) -> DataFrame:
    base, other, planned, windows = retried(spark, d)
    return P.report(planned, P.decide(base, other, windows))


#: What the stand-in hears in a window: two halves; nothing where the window's number is divisible by three, and absolute times where it leaves one by four.
_AGAIN = """heard AS (
  SELECT media_id, pos, start_ms AS low, end_ms AS high, CASE WHEN pos % 4 = 1 THEN start_ms ELSE 0 END + k * ((end_ms - start_ms) // 2) AS s, CASE WHEN pos % 4 = 1 THEN start_ms ELSE 0 END + (k + 1) * ((end_ms - start_ms) // 2) AS e, k
  FROM (SELECT *, unnest([0, 1]) AS k FROM planned WHERE taken AND pos % 3 <> 0)),
moved AS (SELECT *, CASE WHEN max(e) OVER w <= high - low + 2000 AND min(s) OVER w < greatest(500, low - 100) THEN low ELSE 0 END AS shift FROM heard WINDOW w AS (PARTITION BY media_id, pos)),
candidate AS (
  SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, end_ms, text) AS pos, text, start_ms, end_ms, -100 AS logprob_milli, 900 AS compression_milli, 0 AS silence_milli
  FROM (SELECT media_id, low, high, greatest(0, s + shift) AS start_ms, greatest(s + shift + 1, e + shift) AS end_ms, 'what was said in part ' || k || ' of window ' || pos AS text FROM moved) WHERE start_ms < high AND end_ms > low)"""


def listener():
    """A stand-in for recognition."""

    def hear(window: dict) -> list[dict]:
        pos, low, half = window["pos"], window["start_ms"], (window["end_ms"] - window["start_ms"]) // 2
        if pos % 3 == 0:
            raise ValueError("nothing heard")
        at = low if pos % 4 == 1 else 0
        return [{"start_ms": at + k * half, "end_ms": at + (k + 1) * half, "text": f"what was said in part {k} of window {pos}", "logprob_milli": -100, "compression_milli": 900, "silence_milli": 0} for k in (0, 1)]

    return hear


_REPORT = "SELECT p.media_id, p.pos, p.start_ms, p.end_ms, p.n_suspicious, p.taken, {accepted} AS accepted, CASE WHEN NOT p.taken THEN 'skipped' ELSE reasons{dry} END AS reasons, d.score FROM planned p LEFT JOIN decided d ON p.media_id = d.media_id AND p.pos = d.pos"


@query("w24_retry_applied", f"{_PLAN}, {_AGAIN}, {_AFTER}, {_DECIDED} {_REPORT.format(accepted='coalesce(accepted, false) AND p.taken', dry='')}")
def retry_applied(spark: SparkSession, d: str) -> DataFrame:
    """Windows decoded again, and what is decided of each."""
    return P.controlled(cues(spark, d), listener, "apply")[0]


@query("w24_retry_dry_run", f"{_PLAN}, {_AGAIN}, {_AFTER}, {_DECIDED} {_REPORT.format(accepted='false', dry=f" || ',dry_run'")}")
def retry_dry_run(spark: SparkSession, d: str) -> DataFrame:
    return P.controlled(cues(spark, d), listener, "dry_run")[0]
