"""Queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm import cap_filters, chat_format, decontamination, jaccard_join, language_id, license_scan, line_dedup, mixing, spelling, substring_dedup, token_files, toxicity, turn_repair
from cuelake.llm.common import shared_dir, table

VOCABULARY = "word_bpe_49k.json"


def op1_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_filters.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w FROM s),
b AS (
  SELECT *, (sum(w) OVER ())::BIGINT AS all_w, (sum(source_size) OVER ())::BIGINT AS all_size,
         coalesce(sum(w) OVER f, 0)::BIGINT AS w_before, coalesce(sum(source_size) OVER f, 0)::BIGINT AS size_before
  FROM w WINDOW f AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, 4::DOUBLE * source_size * (all_w - w_before) <= w::DOUBLE * (3 * all_size - 4 * size_before) AS is_full FROM b),
r AS (
  SELECT *, (sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ())::BIGINT AS rest_w,
         3 * all_size - 4 * (sum(CASE WHEN is_full THEN source_size ELSE 0 END) OVER ())::BIGINT AS rest
  FROM f),
t AS (
  SELECT source, source_size, CASE WHEN is_full THEN (2 * source_size)::DOUBLE ELSE (w * rest)::DOUBLE / (2 * rest_w)::DOUBLE END AS target FROM r),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS run
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - run)))::BIGINT AS taken
FROM e
"""


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def write_tokens(docs: DataFrame) -> DataFrame:
    """Token files of docs in the shared folder, and their report."""
    folder = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    return token_files.token_report(token_files.write(docs, vocabulary(), folder))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_tokens(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_report(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files source/thousand/hundred/id.txt; of those that speak of a licence, each fourth is the LICENSE or COPYING file of an upper folder. Lines, blocks, headers and whole licence files are compared."""
    k = F.col("doc_id")
    top = F.coalesce("source", F.lit("none"))
    middle = F.concat_ws("/", top, F.floor(k / 1000).cast("string"))
    chosen = F.coalesce(F.col("text").rlike(license_scan.KEYWORDS), F.lit(False)) & (k % 4 == 0)
    name = k.cast("string")
    path = (
        F.when(chosen & (k % 8 == 0), F.concat(middle, F.lit("/LICENSE."), name)).when(chosen, F.concat(top, F.lit("/COPYING."), name))
        .otherwise(F.concat_ws("/", middle, F.floor(k / 100).cast("string"), F.concat(name, F.lit(".txt"))))
    )
    return license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text"))


def _license_sql() -> str:
    quoted = ", ".join("({}, '{}', '{}')".format(k, a, b.replace("'", "''")) for k, (a, b) in enumerate(license_scan.NOTICES))
    mark, bare = (x.replace("'", "''") for x in (license_scan.MARK, license_scan.BARE))
    return rf"""
WITH g AS (
  SELECT doc_id, text, coalesce(source, 'none') AS top, coalesce(source, 'none') || '/' || (doc_id // 1000) AS middle, coalesce(regexp_matches(text, '{license_scan.KEYWORDS}'), false) AS speaks FROM documents),
f AS (
  SELECT doc_id, text, speaks, CASE WHEN speaks AND doc_id % 8 = 0 THEN middle WHEN speaks AND doc_id % 4 = 0 THEN top ELSE middle || '/' || (doc_id // 100) END AS dir,
         CASE WHEN speaks AND doc_id % 8 = 0 THEN 'LICENSE.' || doc_id WHEN speaks AND doc_id % 4 = 0 THEN 'COPYING.' || doc_id ELSE doc_id || '.txt' END AS name FROM g),
e AS (SELECT *, dir || '/' || name AS path, regexp_matches(name, '{license_scan.LICENSE_FILE}') AS is_license FROM f),
r AS (SELECT path, is_license, string_split(text, chr(10)) AS raw FROM e WHERE text IS NOT NULL AND (is_license OR speaks)),
q AS (
  SELECT path, is_license, list_transform(raw, lambda x: regexp_replace(x, '{bare}', '', 'g')) AS plain,
         coalesce(list_position(list_transform(raw, lambda x: regexp_matches(x, '{mark}') OR regexp_matches(x, '^\s*$')), false), 0) AS code FROM r),
y AS (
  SELECT path, is_license, list_concat(list_concat(plain, string_split_regex(array_to_string(plain, chr(10)), '
{{2,}}')), list_concat(
    [array_to_string(CASE WHEN code > 0 THEN plain[:code - 1] ELSE plain END, chr(10))], CASE WHEN is_license THEN [array_to_string(plain, chr(10))] ELSE [] END)) AS every FROM q),
p AS (SELECT row_number() OVER () AS id, * FROM (SELECT DISTINCT path, line FROM (SELECT path, is_license, unnest(every) AS line FROM y) WHERE is_license OR regexp_matches(line, '{license_scan.KEYWORDS}'))),
tf AS (
  SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(regexp_extract_all(lower(line), '{license_scan.TERM}')) AS term FROM p) GROUP BY ALL),
n AS (SELECT count(DISTINCT id)::DOUBLE AS n FROM tf),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
t AS (SELECT template, license, term, count(*) AS tf FROM (
  SELECT template, license, unnest(regexp_extract_all(lower(text), '{license_scan.TERM}')) AS term FROM (VALUES {quoted}) v(template, license, text)) GROUP BY ALL),
w AS (SELECT template, license, term, tf * (ln((n + 1) / (coalesce(df, 0) + 1)) + 1) AS wt FROM t LEFT JOIN df USING (term), n),
wn AS (SELECT *, sqrt(sum(wt * wt) OVER (PARTITION BY template)) AS nt FROM w),
m AS (SELECT id, term, tf * (ln((n + 1) / (df + 1)) + 1) AS wp FROM tf JOIN df USING (term), n),
l AS (SELECT id, sqrt(sum(wp * wp)) AS np FROM m GROUP BY id),
s AS (SELECT id, license, round(sum(wp * wt) / any_value(nt) / any_value(np), 6) AS score FROM m JOIN wn USING (term) JOIN l USING (id) GROUP BY id, template, license),
o AS (
  SELECT path, license, score FROM s JOIN p USING (id) WHERE score >= {license_scan.LEAST}
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, license) = 1),
d AS (
  SELECT dir, license FROM o JOIN e USING (path) WHERE is_license
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, path, license) = 1),
u AS (
  SELECT x.dir, d.dir AS up, d.license FROM (SELECT DISTINCT dir FROM e) x JOIN d ON x.dir = d.dir OR starts_with(x.dir, d.dir || '/')
  QUALIFY row_number() OVER (PARTITION BY x.dir ORDER BY length(d.dir) DESC) = 1)
SELECT e.doc_id, e.path, coalesce(o.license, u.license) AS license, o.score, CASE WHEN o.license IS NOT NULL THEN 'own' WHEN u.license IS NOT NULL THEN 'inherited' END AS origin,
       CASE WHEN o.license IS NULL THEN u.up END AS inherited_from
FROM e LEFT JOIN o USING (path) LEFT JOIN u ON e.dir = u.dir
"""


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.rotate(table(spark, sf_dir, "conversations"))


OP7_SQL = r"""
WITH c AS (
  SELECT *, (row_number() OVER (PARTITION BY conv_id, part ORDER BY turn NULLS LAST, speaker, content) - 1) // 1024 AS piece FROM (
    SELECT conv_id, turn, turn // 1024 AS part, CASE WHEN coalesce(role, '') = '' THEN 'unknown' ELSE role END AS speaker, replace(coalesce(text, ''), '<|im_', '<|_im_') AS content FROM conversations)),
w AS (SELECT DISTINCT conv_id, speaker AS perspective FROM c WHERE speaker NOT IN ('system', 'unknown')),
m AS (
  SELECT c.conv_id, w.perspective, c.turn, c.part, c.piece, c.speaker, c.content,
         CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role
  FROM c JOIN w ON c.conv_id IS NOT DISTINCT FROM w.conv_id),
h AS (SELECT *, '<|im_start|>' || role || CASE WHEN role = 'user' THEN ' name=' || replace(regexp_replace(speaker, '[\r\n]+', ' ', 'g'), '<|im_', '<|_im_') ELSE '' END || chr(10) AS header FROM m),
o AS (
  SELECT *, row_number() OVER v AS k,
         coalesce(sum(length(header) + length(content) + 11) OVER (v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + length(header) AS begins
  FROM h WINDOW v AS (PARTITION BY conv_id, perspective, part, piece ORDER BY turn NULLS LAST, speaker, content))
SELECT conv_id, perspective, part, piece, count(*) AS n_messages, count(*) FILTER (WHERE role = 'assistant') AS n_masked,
       string_agg(header || content || '<|im_end|>' || chr(10), '' ORDER BY k) AS rendered,
       coalesce(string_agg(begins || '-' || (begins + length(content)), ',' ORDER BY k) FILTER (WHERE role = 'assistant'), '') AS mask
FROM o GROUP BY conv_id, perspective, part, piece
"""


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_report(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP9_SQL = r"""
WITH i AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, array_to_string(w[p:p + 9], ' ') AS win, least(len(w), 10) AS size
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS p FROM i WHERE len(w) > 0)),
d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
z AS (SELECT DISTINCT size FROM iw),
dw AS (
  SELECT doc_id, p, size, array_to_string(w[p:p + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS p FROM d, z)),
h AS (SELECT dw.doc_id, dw.p, dw.size, iw.item_id FROM dw JOIN iw USING (win, size)),
n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + size - 1)) AS q FROM (SELECT DISTINCT doc_id, p, size FROM h)) GROUP BY doc_id),
g AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n.n_hit, 0)::BIGINT AS n_hit, coalesce(g.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(g.items, '')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN g USING (doc_id)
"""

def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "pages"))


OP10_SQL = rf"""
WITH r AS (
  SELECT row_number() OVER () AS id, page_id, lower(regexp_extract(coalesce(url, ''), '{line_dedup.HOST}', 1)) AS host,
         regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{line_dedup.HIDDEN}', '', 'g'), '{line_dedup.BREAKING}', chr(10), 'g'), '{line_dedup.TAG}', '', 'g') AS body
  FROM pages),
l AS (SELECT id, host, generate_subscripts(x, 1) AS k, unnest(x) AS line
      FROM (SELECT id, host, list_filter(list_transform(string_split(body, chr(10)), lambda x: regexp_replace(x, '{line_dedup.AROUND}', '', 'g')), lambda x: x <> '') AS x FROM r)),
h AS (SELECT host, count(*) AS pages FROM r WHERE host <> '' GROUP BY host),
b AS (
  SELECT host, line FROM (SELECT host, line, count(DISTINCT id) AS n FROM l WHERE host <> '' GROUP BY host, line) JOIN h USING (host)
  WHERE n >= {line_dedup.LEAST} AND n > {line_dedup.RATIO} * pages),
k AS (
  SELECT l.id, count(*) AS n_lines, count(b.line) AS n_dropped, string_agg(l.line, chr(10) ORDER BY k) FILTER (WHERE b.line IS NULL) AS text
  FROM l LEFT JOIN b ON l.host = b.host AND l.line = b.line GROUP BY l.id)
SELECT r.page_id, r.host, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, coalesce(text, '') AS text FROM r LEFT JOIN k USING (id)
"""


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


_CRC_TABLE = """c AS (SELECT list(v ORDER BY k) AS t FROM (
  SELECT k, list_reduce(list_prepend(k, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(3988292384::BIGINT, x >> 1) ELSE x >> 1 END) AS v FROM range(256) r(k)))"""


def _crc(hex_text: str) -> str:
    """The CRC-32 of bytes in hexadecimal, with the table t of c."""
    bytes_ = f"list_transform(range(length({hex_text}) // 2), lambda i: ('0x' || substr({hex_text}, (2 * i + 1)::INT, 2))::BIGINT)"
    return f"xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda s, b: xor(s >> 8, t[xor(s & 255, b) + 1])))"


#: The hash is the CRC-32 of IEEE 802.3, a byte at a time by its table; near words share a text with one code point left open (replaced) or taken out (deleted).
OP11_SQL = rf"""
WITH RECURSIVE {_CRC_TABLE},
r AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{00C0}}-\x{{00FF}}]{{6,}}')) AS run
  FROM documents),
u AS (SELECT id, run, count(*) AS k, hex(encode(id || ':' || run)) AS x FROM r GROUP BY id, run),
h AS (
  SELECT run, k, {_crc('x')} AS h
  FROM u, c),
w AS (
  SELECT word, sum(k)::BIGINT AS n
  FROM (SELECT k, CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM h)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
o AS (SELECT word, n, left(word, i - 1) || '*' || substr(word, i + 1) AS pat, left(word, i - 1) || substr(word, i + 1) AS del FROM (SELECT word, n, unnest(generate_series(1, length(word))) AS i FROM w)),
d AS (SELECT DISTINCT word, n, del FROM o),
p AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM o a JOIN o b ON a.pat = b.pat AND a.word <> b.word
  UNION ALL SELECT d.word, w.word, w.n FROM d JOIN w ON d.del = w.word
  UNION ALL SELECT w.word, d.word, d.n FROM d JOIN w ON d.del = w.word),
b AS (SELECT word, count(*) AS n_near, max(near_n) AS best_n FROM p GROUP BY word),
m AS (SELECT p.word, min(near) AS near FROM p JOIN b ON p.word = b.word AND near_n = best_n GROUP BY p.word),
f AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best_n >= 5 * n THEN near END AS form, CASE WHEN best_n >= 5 * n THEN best_n END AS form_n
  FROM w LEFT JOIN b USING (word) LEFT JOIN m USING (word)),
g(word, last) AS (SELECT word, word FROM f UNION ALL SELECT g.word, f.form FROM g JOIN f ON g.last = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, g.last AS root, f.n, f.n_near, f.form_n FROM f JOIN g USING (word) JOIN f e ON e.word = g.last WHERE e.form IS NULL
"""


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair_report(table(spark, sf_dir, "conversations"))


def _edit(path: str, cost: object, letters: str) -> str:
    """A path (12 digits of cost, then its edits) with one edit more; the least text is the cheapest path."""
    return f"(lpad((left({path}, 12)::BIGINT + {cost})::VARCHAR, 12, '0') || substr({path}, 13) || '{letters}')"


def _inserted(prefix: str = "s") -> str:
    s0, s1, s2, s3 = (f"{prefix}{k}" for k in range(4))
    u = ", ".join([s2, *[_edit(x, 3, "I") for x in (s0, s1, s3)]])
    a = ", ".join([s3, *[_edit(x, 6, "II") for x in (s0, s1)], _edit(s2, 3, "I")])
    return f"{s0} AS t0, {s1} AS t1, least({u}) AS t2, least({a}) AS t3"


def _turned() -> str:
    """States after a turn: deleted, kept, or given another role."""
    kept = lambda source, initial: f"CASE WHEN NOT must_go AND initial = '{initial}' THEN {_edit(source, 'more', 'K')} END"
    other = lambda source: f"CASE WHEN NOT must_go THEN {_edit(source, '3 + more', 'R')} END"
    gone = [_edit(f"t{k}", 4, "D") for k in range(4)]
    u = ", ".join([gone[2], *[f(x) for x in ("t0", "t1", "t3") for f in (lambda x: kept(x, "u"), other)]])
    return f"{gone[0]} AS s0, least({gone[1]}, {kept('t0', 's')}) AS s1, least({u}) AS s2, least({gone[3]}, {kept('t2', 'a')}, {other('t2')}) AS s3"


#: Turns one after the other, with the cheapest path to each of the four states.
OP12_SQL = rf"""
WITH RECURSIVE {_CRC_TABLE},
n AS (SELECT DISTINCT coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations),
h AS (SELECT s, {_crc('x')} % 20 AS h FROM (SELECT s, hex(encode(s)) AS x FROM n), c),
d AS (
  SELECT coalesce(conv_id::VARCHAR, '') AS conv, turn, CASE WHEN h = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
         CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS twice
  FROM conversations JOIN h ON s = coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') WHERE h <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 AS again FROM (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, twice) AS i FROM d)),
f AS (
  SELECT *, blank OR again AS must_go, NOT blank AND again AS duplicate, NOT blank AND NOT again AND cut AS truncated, CASE WHEN NOT blank AND NOT again AND cut THEN 3 ELSE 0 END AS more,
         lag(initial) OVER (PARTITION BY conv ORDER BY i) || initial AS step
  FROM (SELECT *, NOT regexp_matches(text, '[^ 	-
]') AS blank, NOT contains('.!?', regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1)) AS cut, left(role, 1) AS initial FROM o)),
g(conv, i, s0, s1, s2, s3) AS (
  SELECT DISTINCT conv, 0::BIGINT, '000000000000', NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR FROM f
  UNION ALL SELECT conv, i, {_turned()} FROM (SELECT g.conv, f.i, f.initial, f.must_go, f.more, {_inserted()} FROM g JOIN f ON g.conv = f.conv AND f.i = g.i + 1)),
b AS (SELECT conv, left(p, 12)::BIGINT AS cost, substr(p, 13) AS audit FROM (SELECT conv, least(t0, t3) AS p FROM (SELECT conv, {_inserted()} FROM g QUALIFY row_number() OVER (PARTITION BY conv ORDER BY i DESC) = 1))),
l AS (SELECT conv, generate_subscripts(x, 1) AS l, unnest(x) AS e FROM (SELECT conv, string_split(audit, '') AS x FROM b WHERE audit <> '')),
m AS (
  SELECT *, sum((e <> 'I')::INT) OVER (PARTITION BY conv ORDER BY l) AS i, sum((e <> 'D')::INT) OVER (PARTITION BY conv ORDER BY l) - 1 AS k, sum((e <> 'D')::INT) OVER (PARTITION BY conv) % 2 AS odd FROM l),
r AS (
  SELECT m.conv, string_agg(CASE WHEN e = 'K' THEN role WHEN (k - odd) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY l) AS lines
  FROM m LEFT JOIN f ON f.conv = m.conv AND f.i = m.i WHERE e <> 'D' GROUP BY m.conv),
a AS (
  SELECT conv, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate, count(*) FILTER (WHERE truncated) AS truncated,
         count(*) FILTER (WHERE step IS NOT NULL AND step NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv)
SELECT q.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, '') AS conv FROM conversations) q LEFT JOIN a USING (conv) LEFT JOIN b USING (conv) LEFT JOIN r USING (conv)
"""


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeats_report(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
v AS (SELECT k, doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS win FROM (SELECT k, doc_id, w, unnest(generate_series(1, len(w) - 49)) AS p FROM d WHERE len(w) >= 50)),
f AS (SELECT win, min(doc_id) AS lo FROM v GROUP BY win HAVING count(*) > 1),
r AS (SELECT DISTINCT k, unnest(generate_series(p, p + 49)) AS p FROM v JOIN f USING (win) WHERE lo < doc_id),
g AS (SELECT k, list(p) AS gone FROM r GROUP BY k),
e AS (
  SELECT k, string_agg(x, ' ' ORDER BY p) AS kept
  FROM (SELECT k, generate_subscripts(w, 1) AS p, unnest(w) AS x FROM d) a ANTI JOIN r USING (k, p) GROUP BY k)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (k) LEFT JOIN e USING (k)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_cap_filters": op1_cap_filters,
    "op2_mix_sources": op2_mix_sources,
    "op3_token_files": op3_token_files,
    "op4_language_id": op4_language_id,
    "op5_toxicity": op5_toxicity,
    "op6_license_scan": op6_license_scan,
    "op7_chat_format": op7_chat_format,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_decontaminate": op9_decontaminate,
    "op10_line_dedup": op10_line_dedup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_turn_repair": op12_turn_repair,
    "op13_substring_dedup": op13_substring_dedup,
}

SQL: dict[str, str] = {
    "op2_mix_sources": OP2_SQL,
    "op6_license_scan": _license_sql(),
    "op7_chat_format": OP7_SQL,
    "op9_decontaminate": OP9_SQL,
    "op10_line_dedup": OP10_SQL,
    "op11_spelling_variants": OP11_SQL,
    "op12_turn_repair": OP12_SQL,
    "op13_substring_dedup": OP13_SQL,
}
