"""Schemas of a model's answers: what is wrong with one, and what of it is kept.

Each schema is a function of the answer's text and of the ids that it may name; it gives a struct of
``error`` (null if there is none) and ``kept``, a row for each part that the schema keeps. Answers are parsed once,
as VARIANT; ids are whole numbers or strings of digits, never booleans. Nulls and empty texts are not_json."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the fields of answers may hold.
CONFIDENCE = ("high", "medium", "low")
SEVERITY = ("severe", "moderate")
ISSUES = ("missing", "added", "mistranslation", "terminology", "pronoun", "continuity")
CONSISTENCY_ISSUES = ("terminology", "person", "pronoun", "continuity", "common_word")
TERM_TYPES = ("person", "place", "organization", "technical_term", "work_title", "common_term", "other")
STRICT_TERM_TYPES = ("person", "place", "organization", "work", "technical")
WARNINGS = ("low_confidence_name", "grammatically_impossible", "context_conflict")
STYLES = ("interview", "explanation", "speech", "dialogue", "mixed", "unknown")
CLASSES = ("definite_error", "acceptable_variant")
EQUIVALENCE = ("facts", "negation", "numbers", "entities", "references", "logic")
PROOF = ("issue_resolved", "no_new_error")

#: Other names of term types and confidences.
TERM_ALIASES = {
    "people": "person", "speaker": "person", "character": "person", "location": "place", "org": "organization", "company": "organization", "institution": "organization",
    "technical": "technical_term", "term": "technical_term", "concept": "technical_term", "title": "work_title", "book": "work_title", "film": "work_title",
    "common_word": "common_term", "common_noun": "common_term", "ordinary_word": "common_term", "proper_noun": "other",
}
CONFIDENCE_ALIASES = {"certain": "high", "strong": "high", "uncertain": "low", "weak": "low"}


def _let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of`` the value, which is evaluated once however often it is named: expressions inside array functions are run anew at each place."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def kind(v: Column) -> Column:
    """BIGINT, STRING, BOOLEAN, OBJECT..., ARRAY...; null without a value."""
    return F.schema_of_variant(v)


def is_object(v: Column) -> Column:
    return F.coalesce(kind(v).startswith("OBJECT"), F.lit(False))


def said(v: Column, name: str) -> Column:
    """A field as trimmed text; empty without one."""
    return F.trim(F.coalesce(F.try_variant_get(v, f"$.{name}", "string"), F.lit("")))


def rows(v: Column, name: str) -> Column:
    """A field that is an array; null if it is none."""
    return F.when(kind(field(v, name)).startswith("ARRAY"), F.try_variant_get(v, f"$.{name}", "array<variant>"))


def number(v: Column) -> Column:
    """An id; null if it is none."""
    text = F.trim(F.try_variant_get(v, "$", "string"))
    return F.when(kind(v).isin("BIGINT", "STRING") & text.rlike(r"^-?\d+$"), text.try_cast("bigint"))


def ids(v: Column, name: str) -> Column:
    """The ids of an array, null where one is none; without the field, none."""
    found = F.transform(rows(v, name), number)
    return F.when(field(v, name).isNull(), F.array().cast("array<bigint>")).otherwise(found)


def allowed_only(found: Column, allowed: Column) -> Column:
    return F.coalesce(F.forall(found, lambda x: F.coalesce(F.array_contains(allowed, x), F.lit(False))), F.lit(False))


def _aliased(word: Column, names: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, word), word)


def confidence(v: Column, default: str = "") -> Column:
    """A word, or a number: high from 0.8, medium from 0.5."""
    is_number = kind(field(v, "confidence")).rlike("^(BIGINT|DOUBLE|DECIMAL)")
    number_ = _let(F.try_variant_get(v, "$.confidence", "double"), lambda n: F.when(n >= 0.8, "high").when(n >= 0.5, "medium").otherwise("low"))
    word = F.replace(F.lower(said(v, "confidence")), F.lit("-"), F.lit("_"))
    return F.when(is_number, number_).otherwise(_let(word, lambda w: F.when(w == "", default).otherwise(_aliased(w, CONFIDENCE_ALIASES))))


def term_type(v: Column) -> Column:
    word = F.regexp_replace(F.lower(said(v, "type")), "[- ]", "_")
    return _let(_let(word, lambda w: _aliased(w, TERM_ALIASES)), lambda name: F.when(name.isin(*TERM_TYPES), name).otherwise("other"))


def _first(errors: Column) -> Column:
    return F.get(F.filter(errors, lambda e: e.isNotNull()), F.lit(0))


def _wrong(**conditions: Column) -> Column:
    """The name of the first condition that holds."""
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(True)), name) for name, c in conditions.items()])


def _answer(text: Column, error: Callable[[Column], Column], kept: Callable[[Column], Column]) -> Column:
    def checked(v: Column) -> Column:
        return _let(F.when(~is_object(v), "not_json").otherwise(error(v)), lambda found: F.struct(found.alias("error"), F.when(found.isNull(), kept(v)).alias("kept")))

    return _let(F.try_parse_json(text), checked)


# parts of analyses


def _speaker_error(x: Column, allowed: Column) -> Column:
    return F.when(~is_object(x), "speaker").when((said(x, "name") != "") & ~allowed_only(ids(x, "evidence_ids"), allowed), "evidence")


def _term_error(x: Column, allowed: Column) -> Column:
    named = said(x, "source") != ""
    return F.when(~is_object(x), "term").when(named & ~confidence(x, "low").isin(*CONFIDENCE), "confidence").when(named & ~allowed_only(ids(x, "evidence_ids"), allowed), "evidence")


def _doubt_error(x: Column, allowed: Column) -> Column:
    named = said(x, "token") != ""
    return F.when(~is_object(x), "doubt").when(named & ((said(x, "reason") == "") | ~confidence(x, "low").isin(*CONFIDENCE)), "doubt").when(named & ~allowed_only(ids(x, "evidence_ids"), allowed), "evidence")


def _listed(v: Column, name: str, of: Callable[[Column], Column]) -> Column:
    """The field must be an array, and none of its rows wrong."""
    return _let(rows(v, name), lambda found: F.when(found.isNull(), name).otherwise(_first(F.transform(found, of))))


def _part(name: str, of: Callable[[Column, Column], Column], key: str, shown: Callable[[Column], Column]) -> Callable[[Column, Column], Column]:
    def checked(text: Column, allowed: Column) -> Column:
        keep = lambda v: F.transform(F.filter(rows(v, name), lambda x: said(x, key) != ""), shown)
        return _answer(text, lambda v: _listed(v, name, lambda x: of(x, allowed)), keep)

    return checked


#: Speakers with a name, and their gender.
speakers = _part("speakers", _speaker_error, "name", lambda x: F.concat_ws(":", said(x, "name"), F.when(said(x, "gender") == "", "unknown").otherwise(said(x, "gender"))))
#: Terms with a source, their type and confidence.
typed_glossary = _part("typed_glossary", _term_error, "source", lambda x: F.concat_ws(":", said(x, "source"), term_type(x), confidence(x, "low")))
#: Tokens that recognition may have got wrong, and how sure that is.
suspected_errors = _part("suspected_asr_errors", _doubt_error, "token", lambda x: F.concat_ws(":", said(x, "token"), confidence(x, "low")))


def summarized(text: Column, allowed: Column, summary: str, most: int) -> Column:
    """An analysis of a scene or video: a summary (kept to ``most`` characters), speakers, terms and doubts."""

    def error(v: Column) -> Column:
        return F.coalesce(
            F.when(said(v, summary) == "", summary), _listed(v, "speakers", lambda x: _speaker_error(x, allowed)),
            _listed(v, "typed_glossary", lambda x: _term_error(x, allowed)), _listed(v, "suspected_asr_errors", lambda x: _doubt_error(x, allowed)),
        )

    named = lambda v, name, key: F.transform(F.filter(rows(v, name), lambda x: said(x, key) != ""), lambda x: said(x, key))
    return _answer(text, error, lambda v: F.concat(F.array(F.left(said(v, summary), F.lit(most))), named(v, "speakers", "name"), named(v, "typed_glossary", "source"), named(v, "suspected_asr_errors", "token")))


def video_analysis(text: Column, allowed: Column) -> Column:
    return summarized(text, allowed, "video_summary", 2400)


def semantic_review(text: Column, expected: Column) -> Column:
    """Issues by item; each expected id exactly once."""

    def issue(x: Column) -> Column:
        return F.when(~is_object(x), "issue").otherwise(_wrong(
            type=~said(x, "type").isin(*ISSUES), severity=~F.lower(said(x, "severity")).isin(*SEVERITY), confidence=~confidence(x).isin(*CONFIDENCE),
            detail=said(x, "detail") == "", suggestion=said(x, "suggestion") == "", evidence=said(x, "evidence") == "",
        ))

    def item(x: Column) -> Column:
        return F.when(~is_object(x), "item").when(number(field(x, "id")).isNull() | rows(x, "issues").isNull(), "id").otherwise(_first(F.transform(rows(x, "issues"), issue)))

    def error(v: Column) -> Column:
        found = F.transform(rows(v, "items"), lambda x: number(field(x, "id")))
        exact = (F.size(F.array_except(found, expected)) == 0) & (F.size(F.array_except(expected, found)) == 0)
        return F.coalesce(_listed(v, "items", item), F.when(F.size(F.array_distinct(found)) < F.size(found), "id"), F.when(~exact, "ids"))

    return _answer(text, error, lambda v: F.transform(rows(v, "items"), lambda x: F.concat_ws(":", number(field(x, "id")).cast("string"), F.size(rows(x, "issues")).cast("string"))))


def consistency(text: Column, allowed: Column) -> Column:
    """Issues of one item and those related to it."""

    def issue(x: Column) -> Column:
        return F.when(~is_object(x), "issue").otherwise(_wrong(
            related_ids=~allowed_only(ids(x, "related_ids"), allowed), id=~F.array_contains(allowed, number(field(x, "id"))), type=~said(x, "type").isin(*CONSISTENCY_ISSUES), detail=said(x, "detail") == "",
        ))

    shown = lambda x: F.concat_ws(":", number(field(x, "id")).cast("string"), said(x, "type"), F.array_join(F.array_distinct(ids(x, "related_ids")).cast("array<string>"), "+"))
    return _answer(text, lambda v: _listed(v, "issues", issue), lambda v: F.transform(rows(v, "issues"), shown))


def _strict_term(x: Column, allowed: Column) -> Column:
    evidence = ids(x, "evidence_ids")
    return F.when(~is_object(x), "term").otherwise(_wrong(
        type=~said(x, "type").isin(*STRICT_TERM_TYPES), evidence=(F.size(evidence) == 0) | ~allowed_only(evidence, allowed), source=said(x, "source") == "",
        target=said(x, "target") == "", confidence=~said(x, "confidence").isin(*CONFIDENCE),
    ))


def _optional(v: Column, name: str, of: Callable[[Column], Column]) -> Column:
    return F.when(field(v, name).isNotNull(), _listed(v, name, of))


def analysis(text: Column, allowed: Column) -> Column:
    """A summary, a style, scenes, terms with evidence and warnings of one item each."""

    def warning(x: Column) -> Column:
        return F.when(~is_object(x), "warning").otherwise(_wrong(
            category=~said(x, "category").isin(*WARNINGS), id=~F.array_contains(allowed, number(field(x, "id"))), confidence=~said(x, "confidence").isin(*CONFIDENCE),
        ))

    def style(v: Column) -> Column:
        return F.when(said(v, "discourse_style") == "", "unknown").otherwise(said(v, "discourse_style"))

    def error(v: Column) -> Column:
        return F.coalesce(
            F.when(F.coalesce(kind(field(v, "video_summary")) != "STRING", F.lit(True)), "video_summary"), F.when(~style(v).isin(*STYLES), "discourse_style"),
            _optional(v, "scene_summaries", lambda x: F.lit(None).cast("string")), _optional(v, "typed_glossary", lambda x: _strict_term(x, allowed)), _optional(v, "asr_warnings", warning),
        )

    size = lambda v, name: F.coalesce(F.size(rows(v, name)), F.lit(0)).cast("string")
    return _answer(text, error, lambda v: F.array(F.left(said(v, "video_summary"), F.lit(4000)), style(v), size(v, "typed_glossary"), size(v, "asr_warnings")))


def review(text: Column, allowed: Column) -> Column:
    """Issues of items, and terms with evidence; both may be left out."""

    def issue(x: Column) -> Column:
        return F.when(~is_object(x), "issue").otherwise(_wrong(
            id=~F.array_contains(allowed, number(field(x, "id"))), type=~said(x, "type").isin(*ISSUES), confidence=~said(x, "confidence").isin(*CONFIDENCE), detail=said(x, "detail") == "",
        ))

    def error(v: Column) -> Column:
        return F.coalesce(_optional(v, "issues", issue), _optional(v, "terms", lambda x: _strict_term(x, allowed)))

    none = F.array().cast("array<string>")
    issues = lambda v: F.coalesce(F.transform(rows(v, "issues"), lambda x: F.concat_ws(":", number(field(x, "id")).cast("string"), said(x, "type"))), none)
    terms = lambda v: F.coalesce(F.transform(rows(v, "terms"), lambda x: F.concat_ws("=", said(x, "source"), said(x, "target"))), none)
    return _answer(text, error, lambda v: F.concat(issues(v), terms(v)))


def judgment(text: Column, item: Column, equivalence: bool = False, strict: bool = False) -> Column:
    """A choice between A and B; with ``equivalence`` six booleans, with ``strict`` two more."""
    flags = [*(EQUIVALENCE if equivalence or strict else ()), *(PROOF if strict else ())]

    def error(v: Column) -> Column:
        return _wrong(
            id=~number(field(v, "id")).eqNullSafe(item), choice=~said(v, "choice").isin("A", "B", "TIE"), confidence=~said(v, "confidence").isin(*CONFIDENCE),
            **{name: kind(field(v, name)) != "BOOLEAN" for name in flags},
        )

    return _answer(text, error, lambda v: F.array(said(v, "choice"), said(v, "confidence"), *[said(v, name) for name in flags]))


def variants(text: Column, allowed: Column) -> Column:
    """Groups of variants of a term, each an error or acceptable."""

    def variant(x: Column) -> Column:
        return F.when(~is_object(x) | ~allowed_only(ids(x, "ids"), allowed), "variant_ids")

    def group(x: Column) -> Column:
        return F.when(~is_object(x), "group").otherwise(F.coalesce(
            _wrong(term_type=~said(x, "term_type").isin(*STRICT_TERM_TYPES), classification=~said(x, "classification").isin(*CLASSES)), _listed(x, "variants", variant),
        ))

    shown = lambda x: F.concat_ws(":", said(x, "term_type"), said(x, "classification"), F.size(rows(x, "variants")).cast("string"))
    return _answer(text, lambda v: _listed(v, "groups", group), lambda v: F.transform(rows(v, "groups"), shown))
