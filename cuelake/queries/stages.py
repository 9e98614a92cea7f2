"""Queries over staged translation, with a stand-in for a model that follows simple rules, right and wrong answers alike.

The stand-in's rules, which the SQL states again: a first translation is "la" and the source's words in capitals; answers of a batch that holds a text with "zz" or
whose first id is divisible by 7 are unsound unless strictly asked (the former always)."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.bridge import CUES_SQL, cues
from cuelake.functions.answers import EQUIVALENCE, PROOF
from cuelake.plans import stages as P
from cuelake.plans.strategy import second
from cuelake.queries.registry import query

#: Cues with short texts: the role and the first 24 characters, and "zz" in each 13th.
_SHORT = "short AS (SELECT media_id, pos, start_ms, end_ms, role || CASE WHEN pos % 13 = 0 THEN ' zz ' ELSE ' ' END || regexp_replace(left(text, 24), '[^A-Za-z ]', '', 'g') AS text FROM cues)"


def short(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat("role", F.when(F.col("pos") % 13 == 0, " zz ").otherwise(" "), F.regexp_replace(F.left("text", F.lit(24)), "[^A-Za-z ]", ""))
    return cues(spark, d).select("media_id", "pos", "start_ms", "end_ms", text.alias("text"))


def stand_in() -> Callable[[str, dict], str]:
    def say(stage: str, q: dict) -> str:
        items = q.get("items", [])
        if any("zz" in x["text"] for x in items) and stage == "initial":
            raise ValueError("no answer")
        if items and stage not in ("analysis", "review", "consistency") and items[0]["id"] % 7 == 0 and not q.get("strict"):
            return "not json"
        new = {
            "initial": lambda x: "la " + x["text"].upper(), "reflection": lambda x: "fine" if x["id"] % 2 else "warmer", "final": lambda x: x["now"] + (" !" if x["thought"] == "warmer" else ""),
            "compression": lambda x: x["now"][: x["most"]] if x["id"] % 3 else x["now"], "repair": lambda x: f"{x['text'].upper()} MENDED" if x["id"] % 5 else "", "shortening": lambda x: x["now"][: x["most"]],
        }.get(stage)
        if new:
            return json.dumps({"items": [{"id": x["id"], "translation": new(x) or "-"} for x in items]})
        if stage == "analysis":
            return json.dumps({"scene_summary": f"scene of {len(items)}", "speakers": [], "typed_glossary": [], "suspected_asr_errors": []})
        if stage == "review":
            issue = {"type": "missing", "severity": "severe", "confidence": "high", "detail": "d", "suggestion": "s", "evidence": "e"}
            return json.dumps({"items": [{"id": x["id"], "issues": [issue] if x["id"] % 10 == 4 else []} for x in items]})
        if stage == "consistency":
            return json.dumps({"issues": [{"id": x["id"], "type": "person", "detail": "named otherwise", "related_ids": []} for x in items if x["id"] % 17 == 3]})
        better = "A" if len(q["A"]) > len(q["B"]) else "B"
        if stage == "shortening_judge":
            flags = dict.fromkeys((*EQUIVALENCE, *PROOF), True) | {"logic": q["id"] % 4 != 1}
            return json.dumps({"id": q["id"], "choice": "B" if better == "A" else "A", "confidence": "high"} | flags)
        return json.dumps({"id": q["id"], "choice": better, "confidence": "low" if q["id"] % 6 == 5 else "high"})

    return say


#: Of the stand-in, what a cue's first translation is: none where it holds "zz" (it is asked alone in the end, and not answered).
_FIRST = f"{_SHORT}, first AS (SELECT *, CASE WHEN contains(text, 'zz') THEN NULL ELSE trim('la ' || upper(text)) END AS a FROM short)"


@query("u01_u05_u06_adaptive", f"WITH {CUES_SQL}, {_FIRST} SELECT media_id, pos, a AS translation, CASE WHEN a IS NULL THEN 'failed' END AS error FROM first")
def adaptive(spark: SparkSession, d: str) -> DataFrame:
    return P.translated(short(spark, d).withColumn("scene", F.lit(1)), stand_in)


@query("u02_three_pass", f"""WITH {CUES_SQL}, {_FIRST}, last AS (SELECT *, CASE WHEN pos % 2 = 1 THEN a ELSE a || ' !' END AS b FROM first)
SELECT media_id, pos, CASE WHEN a IS NULL THEN text WHEN length(b) > 28 AND pos % 3 <> 0 THEN trim(left(b, 28)) ELSE b END AS translation, CASE WHEN a IS NULL THEN 'source' WHEN length(b) > 28 AND pos % 3 <> 0 THEN 'short' ELSE 'final' END AS origin FROM last""")
def three_pass(spark: SparkSession, d: str) -> DataFrame:
    return P.three_pass(short(spark, d), stand_in, F.lit(28))


#: Windows about faults (pos % 10 = 4, or nothing translated), candidates that a judge prefers, and short texts that are found equivalent.
_REVIEWED = f"""{_FIRST}, 
w AS (SELECT DISTINCT f.media_id, x.pos FROM (SELECT media_id, pos FROM first WHERE a IS NULL OR pos % 10 = 4) f JOIN first x ON x.media_id = f.media_id AND abs(x.pos - f.pos) <= 1),
m AS (SELECT f.*, CASE WHEN w.pos IS NOT NULL THEN CASE WHEN f.pos % 5 <> 0 THEN upper(text) || ' MENDED' ELSE '-' END END AS c FROM first f LEFT JOIN w ON w.media_id = f.media_id AND w.pos = f.pos),
r AS (SELECT *, c IS NOT NULL AND pos % 6 <> 5 AND length(c) > length(coalesce(a, '')) AS mended FROM m),
t AS (SELECT *, CASE WHEN mended THEN c ELSE a END AS b FROM r),
s AS (SELECT *, b IS NOT NULL AND length(b) > 34 AND pos % 4 <> 1 AS cut FROM t),
z AS (SELECT *, CASE WHEN cut THEN trim(left(b, 34)) ELSE b END AS final FROM s)"""


@query("u03_u04_u07_u08_u09_u10_reviewed", f"""WITH {CUES_SQL}, {_REVIEWED} SELECT media_id, pos, coalesce(final, text) AS translation, CASE WHEN cut THEN 'shortening' WHEN mended THEN 'repair' WHEN a IS NULL THEN 'source' ELSE 'initial' END AS origin,
  CASE WHEN final IS NULL THEN 'empty' WHEN regexp_replace(lower(final), '[^a-z]', '', 'g') = regexp_replace(lower(text), '[^a-z]', '', 'g') AND length(regexp_replace(lower(text), '[^a-z]', '', 'g')) >= 4 THEN 'identical' ELSE '' END AS blocking, length(coalesce(final, text)) > 34 AS over_budget FROM z""")
def reviewed(spark: SparkSession, d: str) -> DataFrame:
    return P.reviewed(short(spark, d), stand_in, F.lit(34), {"han": r"[\x{4e00}-\x{9fff}]"})[0]


@query("u03_u04_consistency", f"WITH {CUES_SQL}, {_REVIEWED} SELECT media_id, pos, 'person' AS type, 'named otherwise' AS detail FROM z WHERE final IS NOT NULL AND pos % 17 = 3")
def consistency(spark: SparkSession, d: str) -> DataFrame:
    return P.reviewed(short(spark, d), stand_in, F.lit(34), {"han": r"[\x{4e00}-\x{9fff}]"})[1]


#: Cues with whole texts in one line, behind their role; "zz" in each 13th, and a quarter without their last full stops.
_WHOLE = r"""whole AS (SELECT media_id, pos, start_ms, end_ms, CASE WHEN pos % 4 = 1 THEN regexp_replace(t, '[.!?]+$', '') ELSE t END AS text FROM (
  SELECT *, role || CASE WHEN pos % 13 = 0 THEN ' zz ' ELSE ' ' END || trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g')) AS t FROM cues))"""


def whole(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("pos")
    text = F.concat("role", F.when(p % 13 == 0, " zz ").otherwise(" "), F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")))
    text = F.when(p % 4 == 1, F.regexp_replace(text, r"[.!?]+$", "")).otherwise(text)
    return cues(spark, d).select("media_id", "pos", "start_ms", "end_ms", text.alias("text"))


def second_stand_in() -> Callable[[str, dict], str]:
    """The first cue of a scene that names a role gives a term; translations carry terms; a judge likes longer mends and shorter texts."""

    def say(stage: str, q: dict) -> str:
        items = q.get("items", [])
        if stage == "initial" and any("zz" in x["text"] for x in items):
            raise ValueError("no answer")
        if stage in ("initial", "repair", "shortening") and items[0]["id"] % 7 == 0 and not q.get("strict"):
            return "not json"
        new = {
            "initial": lambda x: f"la {x['text']}" + "".join(f" [{t['target']}]" for t in x["terms"]), "repair": lambda x: f"{x['text']} MENDED NOW" if x["id"] % 5 else "-", "shortening": lambda x: x["now"][: x["most"]],
        }.get(stage)
        if new:
            return json.dumps({"items": [{"id": x["id"], "translation": new(x)} for x in items]})
        if stage == "survey":
            terms = []
            for word in ("user", "assistant"):
                if at := next((x["id"] for x in items if word in x["text"].lower()), None):
                    target, sure = (f"T{at % 3}", "low" if at % 2 else "high") if word == "user" else ("A", "medium")
                    terms.append({"source": word.title(), "target": target, "type": "person", "confidence": sure, "evidence_ids": [at]})
            return json.dumps({"video_summary": "talk", "typed_glossary": terms})
        if stage in ("review", "cross_line"):
            kind, step, at = ("missing", 10, 4) if stage == "review" else ("continuity", 3, 0)
            sure = lambda k: ("high" if k % 20 == 4 else "medium") if stage == "review" else "low" if k % 2 else "high"
            return json.dumps({"issues": [{"id": x["id"], "type": kind, "confidence": sure(x["id"]), "detail": "d"} for x in items if x["id"] % step == at]})
        if stage == "variants":
            return json.dumps({"groups": [{"term_type": g["type"], "classification": "definite_error" if len(g["variants"]) == 2 else "acceptable_variant", "variants": [{"ids": v["ids"]} for v in g["variants"]]} for g in q["groups"]]})
        longer = "A" if len(q["A"]) > len(q["B"]) else "B"
        flags = dict.fromkeys((*EQUIVALENCE, *PROOF), True)
        if stage == "shortening_judge":
            return json.dumps({"id": q["id"], "choice": "B" if longer == "A" else "A", "confidence": "high"} | flags | {"logic": q["id"] % 4 != 1})
        return json.dumps({"id": q["id"], "choice": longer, "confidence": "low" if q["id"] % 6 == 5 else "high"} | flags)

    return say


_SECOND = rf"""{_WHOLE},
scened AS (SELECT *, sum(new) OVER (PARTITION BY media_id ORDER BY pos) AS scene FROM (SELECT *, CASE WHEN start_ms - lag(end_ms) OVER (PARTITION BY media_id ORDER BY pos) < 30000 THEN 0 ELSE 1 END AS new, contains(text, 'zz') AS zz,
  NOT regexp_matches(lag(text) OVER (PARTITION BY media_id ORDER BY pos), '[.!?…。！？]["''”’)]*[\t\n\f\r ]*$') AND regexp_matches(text, '^[\t\n\f\r ]*\p{{Ll}}') AS runs_on FROM whole)),
named AS (SELECT media_id, scene, min(pos) FILTER (WHERE contains(lower(text), 'user')) AS u, min(pos) FILTER (WHERE contains(lower(text), 'assistant')) AS a FROM scened GROUP BY ALL),
forms AS (
  SELECT media_id, 'user' AS low, 'T' || u % 3 AS target, min(CASE WHEN u % 2 = 0 THEN 1 ELSE 3 END) AS rank, list(u) AS ids FROM named WHERE u IS NOT NULL GROUP BY media_id, u % 3
  UNION ALL SELECT media_id, 'assistant', 'A', 2, list(a) FROM named WHERE a IS NOT NULL GROUP BY media_id),
canon AS (SELECT media_id, low, first(target ORDER BY rank, len(ids) DESC, target) AS target FROM forms GROUP BY ALL),
carried AS (SELECT media_id, pos, string_agg(' [' || target || ']', '' ORDER BY low) AS carried FROM scened JOIN canon USING (media_id) WHERE contains(lower(text), low) GROUP BY ALL),
first AS (SELECT s.*, CASE WHEN NOT zz THEN trim('la ' || text || coalesce(carried, '')) END AS a FROM scened s LEFT JOIN carried USING (media_id, pos)),
across AS (SELECT DISTINCT media_id, unnest([pos - 1, pos]) AS pos FROM first WHERE runs_on),
issues AS (
  SELECT media_id, pos, 'issue' AS origin, 'missing' AS type, CASE WHEN pos % 20 = 4 THEN 0 ELSE 1 END AS priority FROM first WHERE a IS NOT NULL AND pos % 10 = 4
  UNION ALL SELECT media_id, pos, 'cross_line', 'continuity', 0 FROM first JOIN across USING (media_id, pos) WHERE a IS NOT NULL AND pos % 6 = 0),
covered AS (SELECT DISTINCT f.media_id, f.pos FROM first f JOIN issues i ON i.media_id = f.media_id AND abs(i.pos - f.pos) <= 1),
islands AS (SELECT *, pos - row_number() OVER (PARTITION BY media_id ORDER BY pos) AS island FROM covered),
windows AS (SELECT c.media_id, island, min(c.pos) AS first_pos, count(DISTINCT c.pos) AS n, min(priority) AS priority FROM islands c LEFT JOIN issues i ON i.media_id = c.media_id AND i.pos = c.pos GROUP BY c.media_id, island),
budget AS (SELECT *, sum(n) OVER (PARTITION BY media_id ORDER BY priority, first_pos ROWS UNBOUNDED PRECEDING) <= 20 AS taken FROM windows),
mended AS (
  SELECT f.*, coalesce(taken, false) AND a IS NOT NULL AND f.pos % 5 <> 0 AND f.pos % 6 <> 5 AND length(text) + 11 > length(a) AS mended
  FROM first f LEFT JOIN islands i ON i.media_id = f.media_id AND i.pos = f.pos LEFT JOIN budget b ON b.media_id = i.media_id AND b.island = i.island),
b AS (SELECT *, CASE WHEN mended THEN text || ' MENDED NOW' ELSE a END AS b FROM mended),
z AS (SELECT *, length(b) > 200 AND pos % 4 <> 1 AS cut, CASE WHEN length(b) > 200 AND pos % 4 <> 1 THEN trim(left(b, 200)) ELSE b END AS final FROM b)"""


def _second(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return second(whole(spark, d), second_stand_in, 200, 20, {"han": r"[\x{4e00}-\x{9fff}]"})


@query("u04_second_strategy", f"""WITH {CUES_SQL}, {_SECOND} SELECT media_id, pos, coalesce(final, text) AS translation, CASE WHEN coalesce(cut, false) THEN 'shortening' WHEN mended THEN 'repair' WHEN a IS NULL THEN 'source' ELSE 'initial' END AS origin,
  length(coalesce(final, text)) > 200 AS over_budget FROM z""")
def second_strategy(spark: SparkSession, d: str) -> DataFrame:
    return _second(spark, d)[0]


@query("u04_n19_second_review", f"""WITH {CUES_SQL}, {_SECOND}
SELECT media_id, pos, origin AS category, type AS reason FROM issues JOIN z USING (media_id, pos) WHERE NOT mended AND NOT coalesce(cut, false)
UNION ALL SELECT media_id, pos, 'unresolved_budget', 'shortening_not_proven' FROM z WHERE length(coalesce(final, text)) > 200
UNION ALL SELECT DISTINCT media_id, unnest(ids), 'variant', 'definite_error' FROM forms WHERE (media_id, low) IN (SELECT (media_id, low) FROM forms GROUP BY media_id, low HAVING count(*) = 2)""")
def second_review(spark: SparkSession, d: str) -> DataFrame:
    return _second(spark, d)[1]
