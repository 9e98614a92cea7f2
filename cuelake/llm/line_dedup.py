"""Line deduplication by site-relative frequency (operator 10), DataFrame functions only.

A page's lines are what its block tags and line breaks separate (scripts,
styles and comments left out, other tags removed, blanks around stripped,
empty lines dropped). A line is boilerplate of a host if more than ``ratio`` of the
host's pages hold it, and at least ``least`` do; boilerplate lines go, the
others stay in order.

Counting is an aggregation by (host, line), which combines on the map side, so that a host
with a third of all pages is spread over all tasks. A host has fewer boilerplate lines
than ``1 / ratio`` times its mean page has lines, so its list is short; texts are not shuffled
while all lists together are within LISTED.

Null html has no lines. A page without a host (null or other urls) keeps all
its lines. Pages that repeat count as often as they are there. Ids are only
carried along. Lines on fewer than ``least`` pages stay, so that hosts of one or two pages lose none. Very long pages and lines are
read whole; other columns are not read, whatever their names. An empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import materialize

RATIO, LEAST = 0.5, 3
#: Boilerplate lines of all hosts (8 bytes each) that are sent to all tasks; more are joined by shuffle.
LISTED = 2_000_000

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
HIDDEN = r"(?is)<!--.*?-->|<script[\x09-\x0D\x20/>].*?</script[\x09-\x0D\x20]*>|<style[\x09-\x0D\x20/>].*?</style[\x09-\x0D\x20]*>"
#: Tags that end a line.
BREAKING = (
    r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|td|th|title|tr|ul)"
    r"(?:[\x09-\x0D\x20/][^>]*)?>"
)
TAG = r"<[^>]*>"
AROUND = r"^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$"


def host_of(url: str = "url") -> Column:
    """The url's host in lower case; empty if it has none."""
    return F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def lines_of(html: str = "html") -> Column:
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, ""), BREAKING, "\n"), TAG, "")
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, AROUND, "")), lambda x: x != "")


def boilerplate(rows: DataFrame, ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """host, line (its hash), n (pages that hold it) of boilerplate; rows: host, keys (line hashes of a page)."""
    pages = rows.where("host <> ''").groupBy("host").agg(F.count("*").alias("pages"))
    counts = rows.where("host <> ''").select("host", F.explode(F.array_distinct("keys")).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return counts.join(pages, "host").where(F.col("n") > ratio * F.col("pages")).select("host", "line", "n")


def dedup_lines(pages: DataFrame, ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """pages (page_id, url, html) to page_id, host, n_lines, n_dropped, text."""
    rows = pages.select("page_id", host_of().alias("host"), lines_of().alias("lines"))
    rows = materialize(rows, "line-dedup").withColumn("keys", F.transform("lines", lambda x: F.xxhash64(x)))
    found = materialize(boilerplate(rows, ratio, least), "line-dedup-found")
    listed = found.groupBy("host").agg(F.collect_list("line").alias("_drop"))
    listed = F.broadcast(listed) if found.count() <= LISTED else listed
    rows = rows.drop("keys").join(listed, "host", "left")
    kept = F.when(F.col("_drop").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains("_drop", F.xxhash64(x))))
    rows = rows.withColumn("kept", kept)
    n = F.size("lines").cast("long")
    return rows.select("page_id", "host", n.alias("n_lines"), (n - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("text"))
