"""Queries over model answers: each schema over answers that keep to it or break it in one way each.

An answer is one of a list of texts with the event's id put in; beside each stands what the schema has to say of it,
worked out by hand: the error, or what is kept. The SQL is that list."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.bridge import table
from cuelake.functions import answers as S
from cuelake.queries.registry import query

#: Stands for the event's id in a text; allowed ids are it and the next one.
ID = 987650001


def _sql(cases: list[tuple[object, str | None, str | None]]) -> str:
    cell = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    pick = lambda k: f"replace([{', '.join(cell(c[k]) for c in cases)}][event_id % {len(cases)} + 1], '{ID}', event_id::VARCHAR)"
    return f"SELECT event_id, {pick(1)} AS error, {pick(2)} AS kept FROM events"


def _schema(name: str, check: Callable[[Column, Column], Column], cases: list[tuple[object, str | None, str | None]]) -> None:
    texts = [x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x, *_ in cases]

    def run(spark: SparkSession, d: str) -> DataFrame:
        k = F.col("event_id")
        text = F.replace(F.element_at(F.array(*[F.lit(x) for x in texts]), (k % len(texts) + 1).cast("int")), F.lit(str(ID)), k.cast("string"))
        rows = table(spark, d, "events").select("event_id", check(text, F.array(k, k + 1)).alias("a"))
        return rows.select("event_id", F.col("a.error").alias("error"), F.array_join("a.kept", "|").alias("kept"))

    query(name, _sql(cases))(run)


_ann = {"name": " Ann ", "gender": "female", "evidence_ids": [ID, str(ID)]}
_schema("n20_speakers", S.speakers, [
    ({"speakers": [_ann, {"name": " "}, {"name": "Bob"}]}, None, "Ann:female|Bob:unknown"),
    ({"speakers": []}, None, ""),
    ({"speakers": "Ann"}, "speakers", None),
    ({"speakers": ["Ann"]}, "speaker", None),
    ({"speakers": [{"name": "Ann", "evidence_ids": [1000]}]}, "evidence", None),
    ({"speakers": [{"name": "Ann", "evidence_ids": [True]}]}, "evidence", None),
    ({"speakers": [{"name": "", "evidence_ids": [1000]}]}, None, ""),
    ("[]", "not_json", None),
    ({}, "speakers", None),
])

_quay = {"source": "quay", "target": "Kai", "type": "Location", "confidence": 0.83, "evidence_ids": [ID]}
_schema("n21_typed_glossary", S.typed_glossary, [
    ({"typed_glossary": [_quay, {"source": ""}, {"source": "orb", "type": "proper noun", "confidence": "Strong"}, {"source": "x", "type": "odd"}]}, None, "quay:place:high|orb:other:high|x:other:low"),
    ({"typed_glossary": [_quay | {"confidence": "sure"}]}, "confidence", None),
    ({"typed_glossary": [_quay | {"confidence": 0.5}, _quay | {"confidence": 0.1}]}, None, "quay:place:medium|quay:place:low"),
    ({"typed_glossary": [_quay | {"evidence_ids": ["b"]}]}, "evidence", None),
    ({"typed_glossary": None}, "typed_glossary", None),
    ({"typed_glossary": [3]}, "term", None),
    ("{", "not_json", None),
])

_tin = {"token": "tin", "reason": "no such word", "confidence": "uncertain", "evidence_ids": []}
_schema("n22_suspected_errors", S.suspected_errors, [
    ({"suspected_asr_errors": [_tin, {"token": "  "}]}, None, "tin:low"),
    ({"suspected_asr_errors": [_tin | {"reason": ""}]}, "doubt", None),
    ({"suspected_asr_errors": [_tin | {"confidence": None}]}, None, "tin:low"),
    ({"suspected_asr_errors": [_tin | {"confidence": "often"}]}, "doubt", None),
    ({"suspected_asr_errors": [_tin | {"evidence_ids": [-1]}]}, "evidence", None),
    ({"suspected_asr_errors": {}}, "suspected_asr_errors", None),
])

_video = {"video_summary": " A walk ", "speakers": [_ann], "typed_glossary": [_quay], "suspected_asr_errors": [_tin]}
_schema("n11_video_analysis", S.video_analysis, [
    (_video, None, "A walk|Ann|quay|tin"),
    (_video | {"video_summary": "s" * 2500}, None, "s" * 2400 + "|Ann|quay|tin"),
    (_video | {"video_summary": " "}, "video_summary", None),
    (_video | {"speakers": 1}, "speakers", None),
    (_video | {"typed_glossary": [_quay | {"evidence_ids": [0]}]}, "evidence", None),
    (_video | {"suspected_asr_errors": [7]}, "doubt", None),
    ("null", "not_json", None),
])

_issue = {"type": "added", "severity": "Severe", "confidence": 0.6, "detail": "d", "suggestion": "s", "evidence": "e"}
_both = {"items": [{"id": ID, "issues": [_issue]}, {"id": ID, "issues": []}]}

# the expected set is the event's id alone here
_schema("n12_semantic_review", lambda text, allowed: S.semantic_review(text, F.slice(allowed, 1, 1)), [
    ({"items": [{"id": str(ID), "issues": [_issue, _issue]}]}, None, f"{ID}:2"),
    ({"items": [{"id": ID, "issues": []}]}, None, f"{ID}:0"),
    (_both, "id", None),
    ({"items": []}, "ids", None),
    ({"items": [{"id": -5000000, "issues": []}]}, "ids", None),
    ({"items": [{"id": ID, "issues": [_issue | {"type": "style"}]}]}, "type", None),
    ({"items": [{"id": ID, "issues": [_issue | {"severity": "minor"}]}]}, "severity", None),
    ({"items": [{"id": ID, "issues": [_issue | {"confidence": ""}]}]}, "confidence", None),
    ({"items": [{"id": ID, "issues": [_issue | {"evidence": " "}]}]}, "evidence", None),
    ({"items": [{"id": ID, "issues": [_issue | {"suggestion": None}]}]}, "suggestion", None),
    ({"items": [{"id": ID}]}, "id", None),
    ({"items": "none"}, "items", None),
])

_name = {"id": ID, "type": "person", "detail": "two names", "related_ids": [str(ID), ID]}
_schema("n14_consistency", S.consistency, [
    ({"issues": [_name]}, None, f"{ID}:person:{ID}"),
    ({"issues": []}, None, ""),
    ({"issues": [_name | {"id": 0}]}, "id", None),
    ({"issues": [_name | {"type": "style"}]}, "type", None),
    ({"issues": [_name | {"detail": ""}]}, "detail", None),
    ({"issues": [_name | {"related_ids": [ID, 0]}]}, "related_ids", None),
    ({"issues": ["x"]}, "issue", None),
    ({"problems": []}, "issues", None),
])

_work = {"source": "Ode", "target": "Ode", "type": "work", "confidence": "high", "evidence_ids": [ID]}
_warning = {"category": "context_conflict", "id": ID, "confidence": "low"}
_analysis = {"video_summary": " Talk. ", "discourse_style": "speech", "scene_summaries": ["a"], "typed_glossary": [_work], "asr_warnings": [_warning, _warning]}
_schema("n15_analysis", S.analysis, [
    (_analysis, None, "Talk.|speech|1|2"),
    ({"video_summary": ""}, None, "|unknown|0|0"),
    (_analysis | {"video_summary": 4}, "video_summary", None),
    (_analysis | {"discourse_style": "song"}, "discourse_style", None),
    (_analysis | {"scene_summaries": "a"}, "scene_summaries", None),
    (_analysis | {"typed_glossary": [_work | {"type": "technical_term"}]}, "type", None),
    (_analysis | {"typed_glossary": [_work | {"evidence_ids": []}]}, "evidence", None),
    (_analysis | {"typed_glossary": [_work | {"target": ""}]}, "target", None),
    (_analysis | {"typed_glossary": [_work | {"confidence": "High"}]}, "confidence", None),
    (_analysis | {"asr_warnings": [_warning | {"category": "noise"}]}, "category", None),
    (_analysis | {"asr_warnings": [_warning | {"id": "x"}]}, "id", None),
])

_added = {"id": ID, "type": "added", "confidence": "medium", "detail": "d"}
_schema("n17_review", S.review, [
    ({"issues": [_added], "terms": [_work]}, None, f"{ID}:added|Ode=Ode"),
    ({}, None, ""),
    ({"issues": [_added | {"id": -3000000}]}, "id", None),
    ({"issues": [_added | {"type": "severe"}]}, "type", None),
    ({"issues": [_added | {"detail": None}]}, "detail", None),
    ({"issues": [_added | {"confidence": 0.9}]}, "confidence", None),
    ({"terms": [_work | {"source": " "}]}, "source", None),
    ({"terms": [_work | {"evidence_ids": [ID, -5]}]}, "evidence", None),
    ("", "not_json", None),
])

_flags = dict.fromkeys((*S.EQUIVALENCE, *S.PROOF), True)
_choice = {"id": ID, "choice": "B", "confidence": "high"} | _flags
_schema("n18_judgment", lambda text, allowed: S.judgment(text, F.get(allowed, F.lit(0)), equivalence=True, strict=True), [
    (_choice, None, "B|high" + "|true" * 8),
    (_choice | {"logic": False, "no_new_error": False}, None, "B|high|true|true|true|true|true|false|true|false"),
    (_choice | {"id": 0}, "id", None),
    (_choice | {"choice": "b"}, "choice", None),
    (_choice | {"confidence": 1}, "confidence", None),
    (_choice | {"numbers": "true"}, "numbers", None),
    (_choice | {"issue_resolved": None}, "issue_resolved", None),
])

_group = {"term_type": "place", "classification": "definite_error", "variants": [{"text": "a", "ids": [ID]}, {"text": "b", "ids": []}]}
_schema("n19_variants", S.variants, [
    ({"groups": [_group, _group | {"classification": "acceptable_variant", "variants": []}]}, None, "place:definite_error:2|place:acceptable_variant:0"),
    ({"groups": [_group | {"term_type": "other"}]}, "term_type", None),
    ({"groups": [_group | {"classification": "error"}]}, "classification", None),
    ({"groups": [_group | {"variants": {}}]}, "variants", None),
    ({"groups": [_group | {"variants": [{"ids": [0]}]}]}, "variant_ids", None),
    ({"groups": [None]}, "group", None),
    ({"groups": None}, "groups", None),
])
