"""Plans over files, states and configurations: what is new, reused, rebuilt or skipped."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions import text as T

#: Stages whose signatures depend on those before; fixed values.
CHAIN = ("input", "audio", "asr", "translation", "quality", "final")


def signature(stage: str, config: Column, upstream: Column) -> Column:
    """A stage's SHA-256 over its name, its configuration and the stage before."""
    return F.sha2(F.concat_ws("|", F.lit(stage), config, upstream), 256)


def signatures(files: DataFrame, config: dict[str, str], fingerprint: str = "fingerprint") -> DataFrame:
    """files with sig_<stage> for each stage; a change shows in all stages after it."""
    out, upstream = files, F.col(fingerprint)
    for stage in CHAIN:
        out = out.withColumn(f"sig_{stage}", signature(stage, F.lit(config.get(stage, "")), upstream))
        upstream = F.col(f"sig_{stage}")
    return out


def task_identity(path: Column) -> Column:
    """The stem and 12 digits of the hash of the lower-case path."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")
    return F.concat(stem, F.lit("-"), F.left(F.sha2(F.lower(path), 256), F.lit(12)))


def plan(files: DataFrame, states: DataFrame) -> DataFrame:
    """files (task_id, sig_*) against states (task_id, status, sig_*): category
    new, skip (complete and unchanged), reuse (some stages hold) or rebuild, and the first stage to run."""
    old = states.select("task_id", "status", *[F.col(f"sig_{s}").alias(f"old_{s}") for s in CHAIN])
    rows = files.join(old, "task_id", "left")
    first = F.coalesce(*[F.when(~F.col(f"sig_{s}").eqNullSafe(F.col(f"old_{s}")), s) for s in CHAIN])
    category = F.when(F.col("status").isNull(), "new").when(first.isNull() & (F.col("status") == "completed"), "skip").when(first.isNull() | (first != CHAIN[0]), "reuse").otherwise("rebuild")
    return rows.select("task_id", category.alias("category"), F.when(F.col("status").isNull(), CHAIN[0]).otherwise(first).alias("first_stage"))


def retry_plan(states: DataFrame, allowed: DataFrame) -> DataFrame:
    """Failed tasks that may be retried, the others with why not."""
    marked = states.join(allowed.select("task_id", F.lit(True).alias("ok")), "task_id", "left")
    why = F.when(F.col("status") != "failed", "not_failed").when(F.col("ok").isNull(), "not_allowed")
    return marked.select("task_id", why.isNull().alias("retry"), why.alias("reason"))


def resolve(defaults: dict[str, str], *layers: DataFrame) -> DataFrame:
    """Values by name: the last layer (name, value) that has one wins; with its origin (default, layer_1, ...)."""
    spark = layers[0].sparkSession
    out = spark.createDataFrame(list(defaults.items()), "name string, value string").withColumn("origin", F.lit("default"))
    for k, layer in enumerate(layers, 1):
        new = layer.where("value is not null").select("name", F.col("value").alias("_v"))
        out = out.join(new, "name", "left").select("name", F.coalesce("_v", "value").alias("value"), F.when(F.col("_v").isNotNull(), f"layer_{k}").otherwise(F.col("origin")).alias("origin"))
    return out


def merge_profiles(builtin: DataFrame, local: DataFrame) -> DataFrame:
    """Profiles (id, value) by id, the local one before the built-in; with origin."""
    b, x = builtin.select("id", F.col("value").alias("b")), local.select("id", F.col("value").alias("x"))
    return b.join(x, "id", "full").select("id", F.coalesce("x", "b").alias("value"), F.when(F.col("x").isNotNull(), "local").otherwise("builtin").alias("origin"))


def config_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Keys (name, value) whose values differ, or that only one side has."""
    a, b = left.select("name", F.col("value").alias("left_value")), right.select("name", F.col("value").alias("right_value"))
    return a.join(b, "name", "full").where(~F.col("left_value").eqNullSafe(F.col("right_value")))


def contract(scenarios: DataFrame, profiles: DataFrame) -> DataFrame:
    """A run for each scenario and profile, both fixed short lists; run_id is a hash of them."""
    return scenarios.crossJoin(F.broadcast(profiles)).withColumn("run_id", F.left(F.sha2(F.concat_ws(":", "scenario", "profile"), 256), F.lit(12)))


def coverage(contracted: DataFrame, reports: DataFrame) -> DataFrame:
    """Runs that lack a report, and reports of no run."""
    a, b = contracted.select("run_id", F.lit(1).alias("c")), reports.select("run_id", F.lit(1).alias("r"))
    return a.join(b, "run_id", "full").where("c is null or r is null").select("run_id", F.when(F.col("c").isNull(), "unexpected").otherwise("missing").alias("problem"))


def pair_by_stem(files: DataFrame) -> DataFrame:
    """files (path) whose names differ only by a language suffix: base, n, languages."""
    name = F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1)
    rows = files.select(F.lower(F.regexp_extract(name, r"^(.*?)(?:[._-]([A-Za-z]{2,3}))?$", 1)).alias("base"), F.lower(F.regexp_extract(name, r"^(.*?)(?:[._-]([A-Za-z]{2,3}))?$", 2)).alias("language"))
    return rows.groupBy("base").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"))


#: Words of file names that tell a genre, in order.
GENRES = {
    "drama": ("drama",), "action": ("action", "adventure"), "comedy": ("comedy", "funny"), "animation": ("animation", "anime", "cartoon"), "horror": ("horror", "thriller", "scary"),
    "scifi": ("sci.fi", "science", "fiction", "space"), "romance": ("romance", "romantic", "love"), "documentary": ("documentary", "doc"),
}
_SUFFIX = r"(?i)\.([a-z]{2,6})\.(srt|ass|ssa|sub)$"


def collected(files: DataFrame, languages: dict[str, str], wanted: list[str], genre: str = "unknown") -> DataFrame:
    """A row for each translated subtitle file of files (path): base, name, language (a value of languages, by suffix), genre (by its name, or the given one), place
    (language/genre/name), taken (its language is among the wanted, if any; of files with one place the first), sources (names of the same base in the source's language, comma-joined).
    Files that are neither subtitles nor of a known language are left out."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    rows = files.select("path", name.alias("name")).where(F.col("name").rlike(r"(?i)\.(srt|ass|ssa|sub)$"))
    known = F.create_map(*[F.lit(x) for pair in languages.items() for x in pair])
    rows = rows.withColumns({"base": F.regexp_replace("name", _SUFFIX, ""), "is_source": T.is_source_language(F.col("name")), "language": known[F.lower(F.regexp_extract("name", _SUFFIX, 1))]})
    low, found = F.lower("name"), F.lit(None).cast("string")
    for g, words in GENRES.items():
        for w in words:
            found = F.coalesce(found, F.when(F.contains(low, F.lit(w)), g))
    targets = rows.where("not is_source and language is not null").withColumn("genre", F.coalesce(found, F.lit(genre)))
    targets = targets.withColumn("place", F.concat_ws("/", "language", "genre", "name"))
    first = F.row_number().over(Window.partitionBy("place").orderBy("path")) == 1
    taken = first & (F.col("language").isin(*[w.lower() for w in wanted]) if wanted else F.lit(True))
    sources = rows.where("is_source").groupBy("base").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("sources"))
    return targets.withColumn("taken", taken).join(sources, "base", "left").select("path", "base", "name", "language", "genre", "place", "taken", "sources")


def by_language(rows: DataFrame) -> DataFrame:
    """language, genre, n, n_taken, n_paired, n_skipped of collected files."""
    return rows.groupBy("language", "genre").agg(
        F.count("*").alias("n"), F.count_if("taken").alias("n_taken"), F.count_if(F.col("taken") & F.col("sources").isNotNull()).alias("n_paired"), F.count_if(~F.col("taken")).alias("n_skipped")
    )


def altered(before: DataFrame, after: DataFrame, fixed: list[str]) -> DataFrame:
    """Rows of fixed columns that only one side has, as often as it has more of them, with side (before or after): none if nothing was altered."""
    both = before.select(*fixed, F.lit(1).alias("_n")).unionByName(after.select(*fixed, F.lit(-1).alias("_n")))
    more = both.groupBy(*fixed).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    each = more.withColumns({"side": F.when(F.col("_n") > 0, "before").otherwise("after"), "_n": F.explode(F.sequence(F.lit(1).cast("long"), F.abs("_n")))})
    return each.select(*fixed, "side")


def translate(batches: DataFrame, translator: Callable[[], Callable[[list[str]], list[str]]], cache: DataFrame, retries: int = 2) -> DataFrame:
    """batches (key, texts array) with translations: what the cache (key,
    translations) has is not asked again; a batch that fails is halved, and a
    text that fails alone stays as it is. ``translator`` makes the model once for each task."""
    known = batches.join(cache, "key").select("key", "texts", "translations", F.lit("cache").alias("origin"))
    todo = batches.join(cache.select("key"), "key", "left_anti").select("key", "texts")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = translator()

        def halved(texts: list[str]) -> list[str]:
            for _ in range(retries):
                try:
                    out = ask(texts)
                    if len(out) == len(texts):
                        return out
                except ValueError:
                    pass
            if len(texts) == 1:
                return texts
            return halved(texts[: len(texts) // 2]) + halved(texts[len(texts) // 2 :])

        for pdf in parts:
            done = [halved(list(t)) if len(t) else [] for t in pdf["texts"]]
            yield pd.DataFrame({"key": pdf["key"], "texts": pdf["texts"], "translations": done, "origin": ["model"] * len(pdf)})

    schema = f"key {dict(batches.dtypes)['key']}, texts array<string>, translations array<string>, origin string"
    return known.unionByName(todo.mapInPandas(run, schema))


def stub_translator() -> Callable[[list[str]], list[str]]:
    """A translator without a model: words in reverse order."""
    return lambda texts: [" ".join(reversed(x.split())) for x in texts]


def best_terms(terms: DataFrame) -> DataFrame:
    """terms (source, target, origin, confidence): for each source the
    profile's, else the newest high-confidence one."""
    rank = F.when(F.col("origin") == "profile", 0).when(F.col("origin") == "dynamic", 1).otherwise(2)
    usable = terms.where((F.col("origin") == "profile") | (F.col("confidence") == "high"))
    best = F.min(F.struct(rank.alias("r"), "target", "origin"))
    return usable.groupBy(F.lower(F.trim("source")).alias("source")).agg(best.alias("b")).select("source", "b.target", "b.origin")


#: Statuses of runs that end them.
ENDED = ("completed", "failed", "stale", "aborted_plan_changed")


def worker_lost(records: DataFrame, lost: DataFrame) -> DataFrame:
    """Run records (run_id, status) with status, failure_reason and worker_returncode after workers were lost (run_id, returncode: null is 1): a run that has not ended is stale; others stay."""
    rows = records.join(lost.select("run_id", F.coalesce("returncode", F.lit(1)).cast("int").alias("_code")), "run_id", "left")
    hit = F.col("_code").isNotNull() & ~F.coalesce(F.col("status").isin(*ENDED), F.lit(False))
    return rows.select("run_id", F.when(hit, "stale").otherwise(F.col("status")).alias("status"), F.when(hit, "worker_process_not_alive").alias("failure_reason"), F.when(hit, F.col("_code")).alias("worker_returncode"))


def run_tasks(planned: DataFrame, stages: Callable[[], dict[str, Callable[[str], str]]]) -> DataFrame:
    """Planned tasks (task_id, first_stage, payload; null first_stage: nothing to do) run from their first stage on: task_id, status (completed or failed), ran (stages, comma-joined),
    payload and error (stage: message). A task that fails leaves the others alone. ``stages`` makes, once for each task of Spark's, a function for each stage of CHAIN that takes and
    gives the payload, or raises ValueError."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = stages()
        for pdf in parts:
            out = []
            for task, first, payload in zip(pdf["task_id"], pdf["first_stage"], pdf["payload"], strict=True):
                ran, error = [], None
                for stage in CHAIN[CHAIN.index(first) :] if first else ():
                    try:
                        payload = made[stage](payload) if stage in made else payload
                        ran.append(stage)
                    except ValueError as e:
                        error = f"{stage}: {e}"
                        break
                out.append((task, "failed" if error else "completed", ",".join(ran), payload, error))
            yield pd.DataFrame(out, columns=["task_id", "status", "ran", "payload", "error"])

    return planned.select("task_id", "first_stage", "payload").mapInPandas(run, f"task_id {dict(planned.dtypes)['task_id']}, status string, ran string, payload string, error string")
