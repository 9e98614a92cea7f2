"""Similarity, hashes, boxes and safe arithmetic."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType


#: Pairs of characters from which a common substring is looked for by its sequences of so many characters first.
_SEQUENCES = ((400_000, 8), (20_000, 5), (1_000, 3), (0, 1))


def _longest_match(a: str, b: str, k: int) -> tuple[int, int, int]:
    """(place in a, place in b, length) of the longest common substring of k characters at least, of equals the first in a, then in b; length 0: none."""
    places: dict[str, list[int]] = {}
    for j in range(len(b) - k + 1):
        places.setdefault(b[j : j + k], []).append(j)
    best, at, runs = 0, (0, 0), {}
    for i in range(len(a) - k + 1):
        found = places.get(a[i : i + k])
        if found is None:
            runs = {}
            continue
        now = {}
        for j in found:
            n = now[j] = runs.get(j - 1, 0) + 1
            if n > best:
                best, at = n, (i - n + 1, j - n + 1)
        runs = now
    return (*at, best + k - 1) if best else (0, 0, 0)


def matched_characters(a: str, b: str) -> int:
    """Characters in the matching blocks of Ratcliff-Obershelp: the longest common substring, and those on both sides of it, again and again.

    Long texts are searched by sequences of several characters, which few places share; only where no such sequence is common by shorter ones."""
    out, todo = 0, [(a, b)]
    while todo:
        a, b = todo.pop()
        if not a or not b:
            continue
        if a in b or b in a:  # the longest match is all of one side
            out += min(len(a), len(b))
            continue
        for pairs, k in _SEQUENCES:
            if len(a) * len(b) >= pairs:
                i, j, n = _longest_match(a, b, k)
                if n:
                    out += n
                    todo += [(a[:i], b[:j]), (a[i + n :], b[j + n :])]
                    break
    return out


def likeness(a: str, b: str) -> float:
    """Ratcliff-Obershelp ratio without the popularity heuristic, as of ``difflib.SequenceMatcher(None, a, b, autojunk=False)``."""
    return 2.0 * matched_characters(a, b) / (len(a) + len(b)) if a or b else 1.0


def alike(a: str, b: str, least: float) -> bool:
    """Whether the likeness is ``least`` or more; texts whose lengths or characters forbid it are not compared."""
    if a == b:
        return True
    both = len(a) + len(b)
    if 2.0 * min(len(a), len(b)) / both < least or 2.0 * (Counter(a) & Counter(b)).total() / both < least:
        return False
    return likeness(a, b) >= least


@F.pandas_udf(DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio without the popularity heuristic; 0 if a side is empty."""
    return pd.Series([likeness(x, y) if x and y else 0.0 for x, y in zip(a, b, strict=True)])


#: Columns of the table between two that are kept.
_KEPT = 256


def _column_deltas(masks: dict, rows: int, up: int, down: int, columns: Sequence) -> Iterator[tuple[int, int]]:
    """For each column of the table of edit distances the rows, as bits, where the distance is one more, and one less, than in the row above."""
    full = (1 << rows) - 1
    for c in columns:
        same = masks.get(c, 0)
        level = (((same & up) + up) ^ up) | same
        right_more, right_less = down | (full & ~(level | up)), up & level
        right_more, right_less = ((right_more << 1) | 1) & full, (right_less << 1) & full
        up, down = right_less | (full & ~(same | down | right_more)), right_more & (same | down)
        yield up, down


def _masks(items: Sequence) -> dict:
    out: dict = {}
    for k, x in enumerate(items):
        out[x] = out.get(x, 0) | 1 << k
    return out


def edit_distance_of(a: Sequence, b: Sequence) -> int:
    """Edit distance of two sequences, all rows of a column of its table at once: bits of one long number."""
    if len(a) < len(b):
        a, b = b, a
    up, down = (1 << len(a)) - 1, 0
    for up, down in _column_deltas(_masks(a), len(a), up, down, b):  # noqa: B007
        pass
    return len(b) + up.bit_count() - down.bit_count()


def edit_counts(reference: list, candidate: list) -> tuple[int, int, int]:
    """(substitutions, insertions, deletions) of a least-cost alignment; of equal costs a substitution, then a deletion, comes first. What both
    begin and end with is left out of the table. The way back needs a column's bits; each _KEPT-th is kept, those between are made again."""
    a, b = 0, 0
    while a < len(reference) and a < len(candidate) and reference[a] == candidate[a]:
        a += 1
    while b < len(reference) - a and b < len(candidate) - a and reference[-1 - b] == candidate[-1 - b]:
        b += 1
    reference, candidate = reference[a : len(reference) - b], candidate[a : len(candidate) - b]
    i, j = len(reference), len(candidate)
    masks, state = _masks(reference), ((1 << i) - 1, 0)
    kept = [state]
    for k, state in enumerate(_column_deltas(masks, i, *state, candidate), 1):
        if k % _KEPT == 0:
            kept.append(state)
    cost = j + state[0].bit_count() - state[1].bit_count()
    s = n = d = 0
    block, columns = -1, []
    while i and j:
        if reference[i - 1] == candidate[j - 1]:
            i, j = i - 1, j - 1
            continue
        if (j - 1) // _KEPT != block:
            block = (j - 1) // _KEPT
            columns = [kept[block], *_column_deltas(masks, len(reference), *kept[block], candidate[block * _KEPT : (block + 1) * _KEPT])]
        (up, down), above = columns[j - 1 - block * _KEPT], (1 << (i - 1)) - 1
        if j - 1 + (up & above).bit_count() - (down & above).bit_count() + 1 == cost:
            s, i, j = s + 1, i - 1, j - 1
        elif columns[j - block * _KEPT][0] >> (i - 1) & 1:
            d, i = d + 1, i - 1
        else:
            n, j = n + 1, j - 1
        cost -= 1
    return s, n + j, d + i


@F.pandas_udf(IntegerType())
def _long_edit_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else edit_distance_of(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def edit_distance(a: Column, b: Column, short: int = 128) -> Column:
    """Edit distance in code points: of short texts in the plan itself, of long ones by bits, whatever their length."""
    small = (F.length(a) <= short) & (F.length(b) <= short)
    return F.when(small, F.levenshtein(a, b)).otherwise(_long_edit_distance(F.when(~small, a), F.when(~small, b)))


@F.pandas_udf(StructType([StructField("substitutions", IntegerType()), StructField("insertions", IntegerType()), StructField("deletions", IntegerType()), StructField("words", IntegerType())]))
def word_errors(reference: pd.Series, candidate: pd.Series) -> pd.DataFrame:
    """Word errors of normalised texts."""
    out = []
    for r, c in zip(reference, candidate, strict=True):
        words = (r or "").split()
        out.append((*edit_counts(words, (c or "").split()), len(words)))
    return pd.DataFrame(out, columns=["substitutions", "insertions", "deletions", "words"])


@F.pandas_udf(StructType([StructField("errors", IntegerType()), StructField("characters", IntegerType())]))
def character_errors(reference: pd.Series, candidate: pd.Series) -> pd.DataFrame:
    out = []
    for r, c in zip(reference, candidate, strict=True):
        a, b = (r or "").replace(" ", ""), (c or "").replace(" ", "")
        out.append((sum(edit_counts(list(a), list(b))), len(a)))
    return pd.DataFrame(out, columns=["errors", "characters"])


def ngrams(text: Column, n: int = 2) -> Column:
    """All character n-grams in order, with repeats."""
    k = F.length(text) - (n - 1)
    return F.when(k >= 1, F.transform(F.sequence(F.lit(1), k), lambda i: F.substr(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def ngram_f1(candidate: Column, reference: Column, n: int = 2) -> Column:
    """F1 of the multisets of character n-grams; 1 if both are empty."""
    a, b = ngrams(candidate, n), ngrams(reference, n)
    count = lambda grams, g: F.size(F.filter(grams, lambda x: x == g))
    common = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda t, g: t + F.least(count(a, g), count(b, g)))
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * common / total)


def box_iou(a: Column, b: Column) -> Column:
    """Intersection over union of struct(left, top, width, height); 0 without an area."""
    w = F.least(a["left"] + a["width"], b["left"] + b["width"]) - F.greatest(a["left"], b["left"])
    h = F.least(a["top"] + a["height"], b["top"] + b["height"]) - F.greatest(a["top"], b["top"])
    both = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    union = a["width"] * a["height"] + b["width"] * b["height"] - both
    return F.when(union > 0, both / union).otherwise(0.0)


def hash_side(*parts: Column) -> Column:
    """0 or 1 by the parity of the first byte of the parts' SHA-256."""
    return (F.conv(F.left(F.sha2(F.concat_ws(":", *parts), 256), F.lit(2)), 16, 10).cast("int") % 2).cast("int")


def safe_rate(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator > 0, F.round(numerator / denominator, 6)).otherwise(0.0)


def finite_mean(value: Column) -> Column:
    """Mean of what is neither null, NaN nor infinite."""
    return F.avg(F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value))


def text_budget(duration_ms: Column, per_second: int, most: int) -> Column:
    """Characters that can be read in a duration: at least 1, at most ``most``."""
    return F.least(F.lit(most).cast("long"), F.greatest(F.lit(1).cast("long"), F.floor(duration_ms * per_second / F.lit(1000))))


#: Rows whose n-grams are counted together.
GRAM_ROWS = 64


def gram_hits(left: list, right: list, most: int) -> np.ndarray:
    """For n from 1 to ``most`` and each row, how many n-grams (of a list's items or a text's characters) both sides have, as often as the rarer side has them.
    All rows are counted by one sort for each n; grams are numbered anew before their numbers get too large, so that equal numbers mean equal grams."""
    number: dict = {}
    items = np.array([number.setdefault(x, len(number)) for row in (*left, *right) for x in row], np.int64)
    sizes = np.array([len(row) for row in (*left, *right)], np.int64)
    n_rows, kinds, hits = len(left), max(1, len(number)), np.zeros((most, len(left)), np.int64)
    row = np.repeat(np.arange(2 * n_rows), sizes)
    rest = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(items))  # items from here to the row's end
    start, ids, high = np.arange(len(items)), (row % n_rows) * kinds + items if n_rows else items, n_rows * kinds
    for n in range(1, most + 1):
        if n > 1:
            whole = rest[start] >= n
            start, ids = start[whole], ids[whole]
            if high * kinds >= 1 << 61:
                found, ids = np.unique(ids, return_inverse=True)
                high = len(found)
            ids, high = ids * kinds + items[start + n - 1], high * kinds
        if not len(ids):
            break
        # sorted by gram, and by row as the row comes first in a gram's number; the last bit is the side
        keys = np.sort(ids * 2 + (row[start] >= n_rows))
        first = np.flatnonzero(np.concatenate([[True], keys[1:] >> 1 != keys[:-1] >> 1]))
        ones = np.add.reduceat(keys & 1, first)
        both = np.minimum(ones, np.diff(np.append(first, len(keys))) - ones)
        hits[n - 1] = np.bincount(np.sort(row[start] % n_rows)[first], weights=both, minlength=n_rows).astype(np.int64)
    return hits


def bleu_chrf(rows: DataFrame, candidate: str = "candidate", reference: str = "reference") -> DataFrame:
    """rows with bleu (4-grams of words, brevity penalty, add-one smoothing
    above unigrams) and chrf (6-grams of characters, beta 2), each 0 to 100."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bleu, chrf = [], []
            for at in range(0, len(pdf), GRAM_ROWS):
                cs, rs = (pdf[x].iloc[at : at + GRAM_ROWS].fillna("").tolist() for x in (candidate, reference))
                cws, rws = [c.split() for c in cs], [r.split() for r in rs]
                words, letters = gram_hits(cws, rws, 4), gram_hits(*([x.replace(" ", "") for x in xs] for xs in (cs, rs)), 6)
                for i, (cw, rw) in enumerate(zip(cws, rws, strict=True)):
                    logs = []
                    for n in range(1, 5):
                        hit, total = int(words[n - 1, i]), max(0, len(cw) - n + 1)
                        logs.append(np.log((hit + (n > 1)) / (total + (n > 1))) if hit + (n > 1) > 0 and total + (n > 1) > 0 else -np.inf)
                    penalty = min(1.0, np.exp(1 - len(rw) / len(cw))) if cw else 0.0
                    bleu.append(100 * penalty * float(np.exp(np.mean(logs))))
                    nc, nr = (len(x[i]) - x[i].count(" ") for x in (cs, rs))
                    scores = []
                    for n in range(1, 7):
                        na, nb = max(0, nc - n + 1), max(0, nr - n + 1)
                        if na and nb:
                            p, q = int(letters[n - 1, i]) / na, int(letters[n - 1, i]) / nb
                            scores.append(5 * p * q / (4 * p + q) if p + q else 0.0)
                    chrf.append(100 * float(np.mean(scores)) if scores else 0.0)
            yield pdf.assign(bleu=bleu, chrf=chrf)

    return rows.mapInPandas(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema.fields)}, bleu double, chrf double")
