"""Text scalars as columns. Classes of characters are Unicode (``\\p{L}``), in Java's and RE2's syntax alike."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

HAN = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]"
KANA = r"[\x{3040}-\x{30ff}]"
HANGUL = r"[\x{ac00}-\x{d7af}]"


def fold(text: Column) -> Column:
    """Lower case with sharp s as ss."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def letters_only(text: Column) -> Column:
    """Folded, letters and digits alone."""
    return F.regexp_replace(fold(text), r"[^\p{L}\p{N}]+", "")


def word_characters(text: Column) -> Column:
    """Folded, letters, digits and underscores."""
    return F.regexp_replace(fold(text), r"[^\p{L}\p{N}_]+", "")


def compact(text: Column) -> Column:
    """Folded, without white space."""
    return F.regexp_replace(fold(text), r"[\s\x{a0}\x{3000}]+", "")


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def normalize_spoken(text: Column, unicode: bool = True) -> Column:
    """Text for word error rates: compatibility forms, folded, quotes and
    dashes unified, hyphens inside words as blanks, apostrophes only inside words."""
    t = fold(nfkc(text) if unicode else text)
    t = F.translate(t, "’‘ʼ´`", "'''''")
    t = F.regexp_replace(t, r"[\x{2010}-\x{2015}-]", " ")
    t = F.regexp_replace(t, r"[^\p{L}\p{N}' ]+", " ")
    t = F.regexp_replace(t, r"(^|[^\p{L}\p{N}])'+", "$1")
    t = F.regexp_replace(t, r"'+([^\p{L}\p{N}]|$)", "$1")
    return F.trim(F.regexp_replace(t, r" +", " "))


def lines(text: Column) -> Column:
    """Non-empty trimmed lines."""
    return F.filter(F.transform(F.split(text, r"\n"), lambda x: F.trim(x)), lambda x: x != "")


def han_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(HAN))


def target_length(text: Column, wide: str = HAN) -> Column:
    """Characters of the wide script if there are any, otherwise all but white space."""
    n = F.regexp_count(text, F.lit(wide))
    return F.when(n > 0, n).otherwise(F.length(F.regexp_replace(text, r"\s+", "")))


def reading_units(text: Column) -> Column:
    """Weighted length in quarters: wide 4; letters and digits 2, and 2 more at
    a word's start; white space 0; anything else 1."""
    wide = F.regexp_count(text, F.lit(rf"{HAN}|{KANA}|{HANGUL}"))
    rest = F.regexp_replace(text, rf"{HAN}|{KANA}|{HANGUL}", "\u0001")
    alnum, starts = F.regexp_count(rest, F.lit(r"[\p{L}\p{N}]")), F.regexp_count(rest, F.lit(r"[\p{L}\p{N}]+"))
    blank = F.regexp_count(rest, F.lit(r"\s"))
    other = F.length(rest) - wide - alnum - blank
    return wide * 4 + alnum * 2 + starts * 2 + other


def join_tokens(tokens: Column) -> Column:
    """Speech tokens as text: a blank only between Latin or digit neighbours,
    and where a token begins with white space."""
    def step(acc: Column, raw: Column) -> Column:
        t = F.trim(raw)
        gap = (acc != "") & (t != "") & (raw.rlike(r"^\s") | (acc.rlike(r"[\p{IsLatin}\p{N}]$") & t.rlike(r"^[\p{IsLatin}\p{N}]")))
        return F.concat(acc, F.when(gap & ~t.rlike(r"^[\.,!?;:%\)\]]"), F.lit(" ")).otherwise(F.lit("")), t)

    return F.aggregate(tokens, F.lit(""), step)


def detect_script(text: Column, share: float = 0.3) -> Column:
    """zh, ja, ko by their share of characters, in that order; mixed if any Han; otherwise latin."""
    n = F.greatest(F.length(text), F.lit(1))
    han, kana, hangul = (F.regexp_count(text, F.lit(p)) for p in (HAN, KANA, HANGUL))
    return F.when(han / n > share, "zh").when(kana / n > share, "ja").when(hangul / n > share, "ko").when(han + kana + hangul > 0, "mixed").otherwise("latin")


def wide_lines_only(text: Column, wide: str = HAN) -> Column:
    """Of two or more lines, those with the wide script; otherwise the text."""
    all_lines = lines(text)
    return F.when(F.size(all_lines) >= 2, F.array_join(F.filter(all_lines, lambda x: x.rlike(wide)), "\n")).otherwise(text)


def strip_source(source: Column, rendered: Column) -> Column:
    """What follows the source and a line break; empty if both are equal; otherwise the text."""
    prefix = F.concat(source, F.lit("\n"))
    return F.when(rendered == source, "").when(F.startswith(rendered, prefix), F.substr(rendered, F.length(prefix) + 1)).otherwise(rendered)


def best_line(all_lines: Column, wide: str | None = None) -> Column:
    """The line with most characters of the wide script, or the longest with
    three letters; the first of equals; empty if none."""
    score = (lambda x: F.regexp_count(x, F.lit(wide))) if wide else (lambda x: F.when(F.regexp_count(x, F.lit(r"\p{L}")) >= 3, F.length(x)).otherwise(0))
    ranked = F.transform(all_lines, lambda x, i: F.struct(score(x).alias("s"), (-i).alias("i"), x.alias("x")))
    return F.coalesce(F.array_max(F.filter(ranked, lambda r: r["s"] > 0))["x"], F.lit(""))


def redact(text: Column, limit: int = 1000) -> Column:
    """Secrets, tokens and absolute paths masked, at most ``limit`` characters."""
    t = F.regexp_replace(text, r"(?i)(api[_-]?key|token|secret|password|authorization)(\s*[=:]\s*)\S+", "$1$2[redacted]")
    t = F.regexp_replace(t, r"(?i)bearer\s+\S+", "Bearer [redacted]")
    t = F.regexp_replace(t, r"([A-Za-z]:\\|/(home|Users|root|tmp)/)\S*", "[path]")
    return F.left(t, F.lit(limit))


def mask_key(key: Column) -> Column:
    """First three and last four characters; short keys wholly masked."""
    return F.when(F.length(key) <= 8, "***").otherwise(F.concat(F.left(key, F.lit(3)), F.lit("..."), F.right(key, F.lit(4))))


def safe_name(name: Column, limit: int = 72) -> Column:
    """A file name part: illegal characters and blanks as single hyphens, trimmed; ``media`` if nothing is left."""
    t = F.regexp_replace(name, r"[<>:\"/\\|?*\x00-\x1f]+", "-")
    t = F.regexp_replace(F.regexp_replace(t, r"\s+", "-"), r"-{2,}", "-")
    t = F.regexp_replace(F.left(F.regexp_replace(t, r"^[-.]+|[-.]+$", ""), F.lit(limit)), r"[-.]+$", "")
    return F.when(t == "", "media").otherwise(t)


def human_bytes(size: Column) -> Column:
    """B, KB, MB, GB, TB by 1024, one decimal above bytes."""
    out = F.when(size < 1024, F.concat(size.cast("long").cast("string"), F.lit(" B")))
    for k, unit in enumerate(["KB", "MB", "GB"], 1):
        out = out.when(size < 1024 ** (k + 1), F.concat(F.format_string("%.1f", F.bround(size / float(1024**k), 1)), F.lit(f" {unit}")))
    return out.otherwise(F.concat(F.format_string("%.1f", F.bround(size / float(1024**4), 1)), F.lit(" TB")))


def distinct_terms(text: Column, limit: int = 512) -> Column:
    """Comma-separated terms, the first of those equal but for case, joined within ``limit`` characters."""
    terms = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    first = F.filter(terms, lambda x, i: ~F.exists(F.slice(terms, F.lit(1), i), lambda y: fold(y) == fold(x)))
    return F.left(F.array_join(first, ", "), F.lit(limit))


def repeated_phrase(text: Column) -> Column:
    """A phrase of three to five words comes twice in a row."""
    words = F.filter(F.split(fold(text), r"\s+"), lambda x: x != "")

    def at(w: Column, n: int) -> Column:
        # n words in a row that are each the same as the n-th after them
        size = F.size(w)
        same = F.zip_with(F.slice(w, F.lit(1), F.greatest(size - n, F.lit(0))), F.slice(w, F.lit(n + 1), F.greatest(size - n, F.lit(0))), lambda x, y: x == y)
        return F.aggregate(same, F.lit(0), lambda run, x: F.when(run == n, n).when(x, run + 1).otherwise(0)) == n

    # the words are made once, as the element of an array
    return F.coalesce(F.exists(F.array(words), lambda w: at(w, 3) | at(w, 4) | at(w, 5)), F.lit(False))


def _wrapped(text: str | None, width: int) -> str | None:
    if text is None:
        return None
    t = re.sub(r"\s+", " ", text).strip()
    if re.search(r"[\u3400-\u9fff]", t):
        t = t.translate(str.maketrans(",!?:;", "，！？：；"))
    t = re.sub(r"([，。！？：；,.!?:;])\1+", r"\1", t)
    lines = []
    while len(t) > width:
        part = t[: width + 1]
        # after the last mark, else at the last blank, else anywhere
        cut = max((m.end() for m in re.finditer(r"[，。！？：；,.!?:;]", part[:width])), default=0) or part.rfind(" ") or width
        cut = cut if cut > 0 else width
        lines.append(t[:cut].strip())
        t = t[cut:].strip()
    return "\n".join([*lines, t] if t else lines)


@F.pandas_udf(StringType())
def wrapped(text: pd.Series, width: pd.Series) -> pd.Series:
    """White space and repeated marks collapsed, full-width marks in Han text, lines of at most ``width`` characters."""
    return pd.Series([_wrapped(t, int(w)) for t, w in zip(text, width, strict=True)])


#: Marks of Latin texts and their full-width forms; marks after which a line may end.
HALF_WIDTH, FULL_WIDTH, ENDS = ",.!?;:", "，。！？；：", "，。！？；：、"


def _formatted(text: str, width: int) -> str:
    t = re.sub(r"\s*\n\s*", "", re.sub(r"[ \t\u3000]+", " ", text).strip())
    if re.search(r"[\u3400-\u9fff]", t):
        t = t.translate(str.maketrans(HALF_WIDTH, FULL_WIDTH))
    t = re.sub(f"([{ENDS}])\\1+", r"\1", t)
    lines, at = [], 0
    while 0 < width < len(t) - at:
        last = max(t.rfind(mark, at, at + width + 1) for mark in ENDS)
        size = last + 1 - at if last + 1 - at >= max(4, width // 2) else width
        lines.append(t[at : at + size])
        at += size
    return "\n".join([*lines, t[at:]] if at < len(t) or not lines else lines)


@F.pandas_udf(StringType())
def formatted(text: pd.Series, width: pd.Series) -> pd.Series:
    """One line of text in lines of at most ``width`` characters, that end at the last full-width mark if one is in their second half; marks are
    full-width beside Han characters and not repeated. Null texts are empty; no width leaves one line."""
    return pd.Series([_formatted(t or "", int(w)) for t, w in zip(text, width, strict=True)])


def language_of_path(path: Column) -> Column:
    """A language code between dots or hyphens at a file name's end; null if none."""
    code = F.regexp_extract(path, r"[._-]([a-z]{2,3}(?:-[A-Za-z]{2,4})?)\.[A-Za-z0-9]+$", 1)
    return F.when(code != "", code)


def prompt(style: Column, custom: Column, terms: Column) -> Column:
    """Instructions of a translation: style, the user's own, and a line for each term (struct source, target)."""
    lines = F.transform(terms, lambda t: F.concat(F.lit("- "), t["source"], F.lit(" = "), t["target"]))
    return F.concat_ws("\n", F.when(style != "", style), F.when(custom != "", custom), F.when(F.size(terms) > 0, F.concat(F.lit("Terms:\n"), F.array_join(lines, "\n"))))


def subtitle_formats(value: Column, supported: tuple[str, ...] = ("srt", "ass")) -> Column:
    """The formats of a list like "srt; ASS", each once, in order; "srt" is put first if it is not among them. Others fail."""
    asked = F.transform(F.split(F.coalesce(value, F.lit("")), "[,;]"), lambda x: F.lower(F.regexp_replace(x, r"^\s+|\s+$", "")))
    asked = F.array_distinct(F.filter(asked, lambda x: x != ""))
    bad = F.filter(asked, lambda x: ~x.isin(*supported))
    formats = F.when(F.array_contains(asked, "srt"), asked).otherwise(F.concat(F.array(F.lit("srt")), asked))
    return F.when(F.size(bad) == 0, formats).otherwise(F.raise_error(F.concat(F.lit("Unsupported subtitle format: "), F.get(bad, F.lit(0)))).cast("array<string>"))


#: Suffixes of the source language's files, the kind of references that scores may use, keys and endings that reports must not have.
SOURCE_LANGUAGES = ("english", "eng", "en")
FORMAL = "gold_verbatim"
FORBIDDEN_KEYS = ("path", "transcript", "prompt", "api_key", "authorization", "source_srt", "reference_srt", "candidate_srt", "input")
SECRET_KEYS = r"(?i)key|token|secret|password|authorization"
PRIVATE_PATH = r"(?:[A-Za-z]:[\\/]|/Users/|/home/|\\\\)"


def is_source_language(filename: Column) -> Column:
    """Whether a subtitle file's language suffix is one of the source language's."""
    return F.regexp_extract(F.lower(filename), r"\.([a-z]{2,6})\.(srt|ass|ssa|sub)$", 1).isin(*SOURCE_LANGUAGES)


def is_formal_reference(kind: Column) -> Column:
    return F.coalesce(kind == FORMAL, F.lit(False))


def safe_member(name: Column) -> Column:
    """An archive member's name with forward slashes; null if it is empty, absolute, with a drive, or has a part that is empty, . or .. ."""
    path = F.replace(name, F.lit("\\"), F.lit("/"))
    bad = path.startswith("/") | path.rlike("^[A-Za-z]:") | F.exists(F.split(path, "/"), lambda p: p.isin("", ".", ".."))
    return F.when(~bad, path)


def target_language(translated: Column, bilingual: Column) -> Column:
    """The language in the first path that has one; empty without."""
    found = [F.regexp_extract(F.coalesce(c, F.lit("")), r"\.(?:translated|bilingual)\.([A-Za-z]{2}(?:-[A-Za-z0-9]+)?)\.srt$", 1) for c in (translated, bilingual)]
    return F.when(found[0] != "", found[0]).otherwise(found[1])


def source_groups(members: DataFrame, member: str = "member") -> DataFrame:
    """members with source_group: the folder where members are in three folders or more, else the name without the segment or number at its end.
    Null for names that are ids, or have no such end."""
    parent, stem = F.regexp_extract(member, r"^(.*)/[^/]*$", 1), F.regexp_replace(F.regexp_extract(member, r"([^/]*)$", 1), r"\.[^.]*$", "")
    folders = members.select(parent.alias("p")).distinct().limit(3).count()  # three are enough to know
    is_id = stem.rlike(r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
    cut = F.regexp_replace(F.regexp_replace(stem, r"(?i)(?:[-_.](?:clip|segment|seg|chunk|part|utt))?[-_.]?\d+(?:[-_.]\d+)?$", ""), r"^[-_.]+|[-_.]+$", "")
    by_name = F.when(~is_id & (cut != "") & (cut != stem), cut)
    return members.withColumn("source_group", F.when(F.lit(folders >= 3) & (parent != ""), parent).otherwise(by_name))


def _visited(value: object) -> object:
    if isinstance(value, dict):
        return {k: "[redacted]" if re.search(SECRET_KEYS, k) else _visited(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_visited(v) for v in value]
    return re.sub(r"(?:[A-Za-z]:\\|/(?:home|Users|root|tmp)/)\S*", "[path]", value) if isinstance(value, str) else value


@F.pandas_udf(StringType())
def sanitized(document: pd.Series) -> pd.Series:
    """A JSON document of any depth with secrets and absolute paths masked; null if it cannot be read."""

    def one(text: str | None) -> str | None:
        try:
            return json.dumps(_visited(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
        except (TypeError, ValueError):
            return None

    return document.map(one)


def _problem(value: object) -> str | None:
    if isinstance(value, dict):
        for key, item in value.items():
            low = key.casefold()
            if low.endswith("_text") or any(x in low for x in FORBIDDEN_KEYS):
                return "forbidden_key"
            if found := _problem(item):
                return found
    elif isinstance(value, list):
        return next((found for item in value if (found := _problem(item))), None)
    elif isinstance(value, str) and not re.match("(?i)https?://", value) and re.search(PRIVATE_PATH, value):
        return "private_path"
    return None


@F.pandas_udf(StringType())
def public_safe(document: pd.Series) -> pd.Series:
    """What must not be public in a JSON document: forbidden_key, private_path or not_json; null if nothing."""

    def one(text: str | None) -> str | None:
        try:
            return _problem(json.loads(text))
        except (TypeError, ValueError):
            return "not_json"

    return document.map(one)


def two_lines(text: Column) -> Column:
    """source, target, error of a text of exactly two lines that are not empty."""
    found = lines(F.coalesce(text, F.lit("")))
    ok = F.size(found) == 2
    return F.struct(F.when(ok, F.get(found, F.lit(0))).alias("source"), F.when(ok, F.get(found, F.lit(1))).alias("target"), F.when(~ok, "two lines are needed").alias("error"))
