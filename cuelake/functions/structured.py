"""JSON and nested values: parsing of model answers and checks of their ids."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def unwrap_fence(text: Column) -> Column:
    """The text inside a code fence, or the trimmed text."""
    inner = F.regexp_extract(text, r"(?s)^\s*```[A-Za-z]*\s*\n?(.*?)\n?\s*```\s*$", 1)
    return F.when(inner != "", F.trim(inner)).otherwise(F.trim(text))


def json_object(text: Column) -> Column:
    """The unfenced text if it is a JSON object; otherwise null."""
    t = unwrap_fence(text)
    return F.when(F.schema_of_variant(F.try_parse_json(t)).startswith("OBJECT"), t)


def first_string(text: Column, *keys: str) -> Column:
    """The first of the keys that holds a string."""
    return F.coalesce(*[F.get_json_object(text, f"$.{k}") for k in keys])


def answer_text(text: Column) -> Column:
    """The answer's text in either common shape of chat responses."""
    return F.coalesce(F.get_json_object(text, "$.choices[0].message.content"), F.get_json_object(text, "$.message.content"), F.get_json_object(text, "$.response"))


def id_set_error(returned: Column, expected: Column) -> Column:
    """duplicate, missing or unexpected; null if the ids are exactly the expected ones."""
    return (
        F.when(F.size(returned) != F.size(F.array_distinct(returned)), "duplicate").when(F.size(F.array_except(expected, returned)) > 0, "missing")
        .when(F.size(F.array_except(returned, expected)) > 0, "unexpected")
    )


def evidence(ids: Column, allowed: Column) -> Column:
    """Distinct ids in order; null if one is not allowed."""
    return F.when(F.size(F.array_except(ids, allowed)) == 0, F.array_distinct(ids))


def confidence(value: Column) -> Column:
    """high from 0.8, medium from 0.5, otherwise low; words are taken as they are."""
    number = value.try_cast("double")
    word = F.lower(F.trim(value))
    return F.when(word.isin("high", "medium", "low"), word).when(number >= 0.8, "high").when(number >= 0.5, "medium").when(number.isNotNull(), "low")


def drop_secrets(values: Column) -> Column:
    """A map without keys that look like secrets."""
    return F.map_filter(values, lambda k, v: ~F.lower(k).rlike(r"key|token|secret|password|authorization"))


def _loose(text: str | None) -> str | None:
    if text is None:
        return None
    body = re.sub(r"^\s*```\w*\s*|\s*```\s*$", "", text)
    outside = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*', lambda m: m[1] or "", body)
    first, last = outside.find("{"), outside.rfind("}")
    for part in (outside, outside[first : last + 1] if 0 <= first < last else ""):
        try:
            return json.dumps(json.loads(part), ensure_ascii=False, sort_keys=True)
        except ValueError:
            pass
    # a quote that begins or ends a string has a separator before or after it, blanks aside
    body = outside[first : last + 1]
    mended = re.sub(r'"', lambda m: m[0] if re.search(r'[\[{:,\\]\s*$', body[: m.start()]) or re.match(r"\s*[\]}:,]", body[m.end() :]) else r"\"", body)
    try:
        return json.dumps(json.loads(mended), ensure_ascii=False, sort_keys=True)
    except ValueError:
        return None


@F.pandas_udf(StringType())
def loose_json(text: pd.Series) -> pd.Series:
    """JSON with sorted keys from text with fences, line comments, words around
    it or unescaped inner quotes; null if it cannot be read."""
    return text.map(_loose)


def request_body(model: str, prompt: Column, texts: Column, temperature: float = 0.2) -> Column:
    """A chat request of a batch of texts as JSON."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.to_json(F.struct(F.lit(model).alias("model"), F.lit(temperature).alias("temperature"), F.array(message("system", prompt), message("user", F.to_json(texts))).alias("messages")))


def entries(text: Column) -> Column:
    """id to text of a model's answer in any of its shapes: a list of objects,
    such a list in a wrapper, or an object with ids as keys."""
    item = "array<struct<id:string,translation:string,text:string>>"
    inner = F.when(F.trim(text).startswith("["), text).otherwise(F.coalesce(F.get_json_object(text, "$.translations"), F.get_json_object(text, "$.items")))
    listed = F.transform(F.filter(F.from_json(inner, item), lambda x: x["id"].isNotNull()), lambda x: F.struct(x["id"], F.coalesce(x["translation"], x["text"])))
    return F.when(inner.isNotNull(), F.map_from_entries(listed)).otherwise(F.from_json(text, "map<string,string>"))


def checked(text: Column, schema: str, enums: dict[str, tuple[str, ...]], ids: str, allowed: Column) -> Column:
    """What is wrong with a model's JSON: not_json, a field's name (missing or
    not one of its values), or ids; null if nothing is."""
    value = F.from_json(text, schema)
    error = F.when(F.try_parse_json(text).isNull(), "not_json")
    for field, values in enums.items():
        error = error.when(F.coalesce(~value[field].isin(*values), F.lit(True)), field)
    return error.when(value[ids].isNull() | (F.size(F.array_except(value[ids], allowed)) > 0), "ids")
