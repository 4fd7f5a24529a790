"""The registered queries of this subpackage: one for each operator, and the pipeline."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm import decontaminate, jaccard_join, language_id, license_scan, mixing, quality, repetition, reply_trees, resampling, sharding, token_orc, toxicity, turn_repair
from folioscope.llm.common import table


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN_WORD = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'"
_SPACED_WORD = "'[^\\x20\\x09-\\x0D]+'"


def template_regex(wording: str) -> str:
    """A template as a pattern over a text's words, each with a space before it."""
    out = []
    for part in re.findall(r"\[\[|\]\]|\{\{\w+:\d+\}\}|[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", wording.lower()):
        if part in ("[[", "]]"):
            out.append("(?:" if part == "[[" else ")?")
        elif part[0] == "{":
            out.append("(?: [^ ]+){0,%s}" % part.strip("{}").split(":")[1])
        else:
            out.append(f" {part}")
    return "".join(out) + "(?: |$)"


def _op1_sql() -> str:
    places = " UNION ALL ".join(
        f"SELECT doc_id, i, '{label}' AS label FROM (SELECT doc_id, w, unnest(range(0, len(w) - {len(p.split())} + 1)) AS i FROM d) WHERE w[i + 1 : i + {len(p.split())}] = {p.split()}" for p, label in license_scan.PHRASES
    )
    templates = " UNION ALL ".join(f"SELECT doc_id, '{label}' AS label FROM d WHERE regexp_matches(t, '{template_regex(wording)}')" for label, wording in license_scan.TEMPLATES)
    return f"""
WITH d AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') AS t FROM (SELECT doc_id, regexp_extract_all({_LOWERED}, {_PLAIN_WORD}) AS w FROM documents)),
p AS ({places}), m AS ({templates}),
b AS (SELECT doc_id, count(*) AS n, min(i) AS lo, max(i) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM p GROUP BY doc_id),
a AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM p UNION SELECT doc_id, label FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(lo AS BIGINT) AS first_word, CAST(hi AS BIGINT) AS last_word, coalesce(b.labels, '') AS base_labels,
  coalesce(a.labels, '') AS labels, CAST(CASE WHEN d.doc_id IN (SELECT doc_id FROM m) THEN 1 WHEN n > 0 THEN 0.5 ELSE 0 END AS DOUBLE) AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id)"""


OP3_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, {_SPACED_WORD}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 5], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS seen FROM d UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(seen) AS component_id FROM r GROUP BY node) USING (doc_id)
"""

OP10_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_SPACED_WORD}) AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 5], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, greatest(0, len(w) - 4))) AS i FROM d)),
r AS (SELECT doc_id, i, g FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
p AS (SELECT DISTINCT doc_id, i + k AS i FROM r, range(0, 5) t(k)),
c AS (SELECT doc_id, count(*) AS n_repeat_words, sum(length(w[i + 1])) AS chars FROM p JOIN d USING (doc_id) GROUP BY doc_id),
x AS (
  SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda y: length(y))), 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(list_filter(string_split(text, chr(10)), lambda y: regexp_matches(y, {_SPACED_WORD}))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda y: regexp_matches(y, {_SPACED_WORD})))) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(chars, 0) AS chars FROM d LEFT JOIN c USING (doc_id)
), f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM x),
-- pairs of equal windows one after the other, at one distance, are one longer repeat
q AS (SELECT a.doc_id, a.i, b.i - a.i AS apart FROM r a JOIN f ON f.doc_id = a.doc_id AND NOT base_failed JOIN r b ON b.doc_id = a.doc_id AND b.g = a.g AND b.i > a.i),
o AS (SELECT doc_id, max(n) + 4 AS longest FROM (SELECT doc_id, apart, run, count(*) AS n FROM (SELECT doc_id, apart, i - row_number() OVER (PARTITION BY doc_id, apart ORDER BY i) AS run FROM q) GROUP BY 1, 2, 3) GROUP BY doc_id)
SELECT f.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND chars <= {repetition.MAX_COVERED} * word_chars AND NOT (coalesce(longest, 0) > {repetition.MAX_REPEAT_WORDS} AND coalesce(longest, 0) > {repetition.MAX_REPEAT_SHARE} * n_words) AS kept
FROM f LEFT JOIN o USING (doc_id)
"""

OP8_SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark
), bw AS (
  SELECT item_id, least(len(w), 10) AS n, unnest(range(0, len(w) - least(len(w), 10) + 1)) AS i, w FROM b WHERE len(w) > 0
), bx AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i + 1 : i + n], ' ') AS t FROM bw
), lengths AS (
  SELECT DISTINCT n FROM bx
), dw AS (
  SELECT doc_id, n, unnest(range(0, len(w) - n + 1)) AS i, w FROM d, lengths WHERE len(w) >= n
), hits AS (
  SELECT doc_id, dw.n, i, item_id FROM dw JOIN bx ON bx.n = dw.n AND array_to_string(w[i + 1 : i + dw.n], ' ') = bx.t
), places AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits
), counted AS (
  SELECT doc_id, count(*) AS n_hit FROM places GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN counted USING (doc_id) LEFT JOIN found USING (doc_id)
"""


#: crc32 of text: its table, and a list of byte values as a checksum.
_CRC_TABLE = "SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab"
_BYTES = "list_transform(range(0, CAST(length(hex(encode({0}))) / 2 AS BIGINT)), lambda i: CAST('0x' || substr(hex(encode({0})), 2 * i + 1, 2) AS BIGINT))"
_CRC = "xor(list_reduce([4294967295] || {0}, lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"
_NEVER = 1 << 50


def _edit(state: str, cost: str, letter: str) -> str:
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || {letter}}}"


def _put(state: str) -> str:
    return _edit(state, str(turn_repair.INSERT), "'I'")


def _op11_sql() -> str:
    drop = lambda s: _edit(s, str(turn_repair.DELETE), "'D'")
    user, assistant = (lambda s: _edit(s, "uc", "ue")), (lambda s: _edit(s, "ac", "ae"))
    begin = lambda cost, audit: f"{{'c': CAST({cost} AS BIGINT), 'a': '{audit}'}}"
    first = f"{begin(0, '')} AS s0, {begin(_NEVER, '')} AS s1, {begin(turn_repair.INSERT, 'I')} AS s2, {begin(2 * turn_repair.INSERT, 'II')} AS s3"
    return f"""
WITH RECURSIVE t AS ({_CRC_TABLE}),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC.format(_BYTES.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"))} % 20 AS what FROM conversations, t),
d AS (SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role, CASE WHEN what = 1 THEN '' WHEN what = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(0, CASE WHEN what = 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE what <> 0),
o AS (SELECT *, substr(role, 1, 1) AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM d),
f AS (SELECT *, coalesce(lag(x) OVER (PARTITION BY conv_id ORDER BY i) || x NOT IN ('su', 'ua', 'au'), false) AS illegal,
  CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' END AS fault FROM o),
e AS (SELECT *, coalesce(fault IN ('blank', 'duplicate'), false) AS dead, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS cut FROM f),
g AS (SELECT *, CASE WHEN dead OR x <> 's' THEN {_NEVER} ELSE cut END AS sc, CASE WHEN dead THEN {_NEVER} WHEN x = 'u' THEN cut ELSE cut + 2 END AS uc, CASE WHEN x = 'u' THEN 'K' ELSE 'R' END AS ue,
  CASE WHEN dead THEN {_NEVER} WHEN x = 'a' THEN cut ELSE cut + 2 END AS ac, CASE WHEN x = 'a' THEN 'K' ELSE 'R' END AS ae FROM e),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (illegal) AS illegal, count(*) AS n FROM g GROUP BY conv_id),
r AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {first} FROM c
  UNION ALL
  SELECT conv_id, i, s0, s1, u AS s2, least(s3, {_put("u")}) AS s3 FROM (
    SELECT conv_id, i, s0, s1, least(s2, {_put("s0")}, {_put("s1")}, {_put("s3")}) AS u, s3 FROM (
      SELECT r.conv_id, g.i, {drop("s0")} AS s0, least({drop("s1")}, {_edit("s0", "sc", "'K'")}) AS s1, least({drop("s2")}, {user("s0")}, {user("s1")}, {user("s3")}) AS s2, least({drop("s3")}, {assistant("s2")}) AS s3
      FROM r JOIN g ON g.conv_id IS NOT DISTINCT FROM r.conv_id AND g.i = r.i + 1))
), b AS (SELECT c.*, least(s0, s3).c AS cost, least(s0, s3).a AS audit FROM r JOIN c ON c.conv_id IS NOT DISTINCT FROM r.conv_id AND c.n = r.i),
-- the letters of the audit: which turn each is about, and which place its turn has in the repaired conversation
l AS (SELECT conv_id, p, substr(audit, p, 1) AS e FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM b)),
m AS (SELECT *, count(*) FILTER (e <> 'I') OVER w AS i, count(*) FILTER (e <> 'D') OVER w AS j FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
q AS (SELECT m.conv_id, j, e, CASE WHEN e = 'K' THEN g.role END AS role, CASE WHEN e = 'I' THEN '' ELSE g.text END AS text FROM m LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM m.conv_id AND g.i = m.i WHERE e <> 'D'),
h AS (SELECT *, max(CASE WHEN j = 1 AND substr(role, 1, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS sys FROM q),
z AS (SELECT conv_id, sha256(string_agg(coalesce(role, CASE WHEN (j - 1 - sys) % 2 = 0 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY j)) AS repaired_sha256 FROM h GROUP BY conv_id)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM a.conv_id"""


OP12_SQL = f"""
WITH t AS ({_CRC_TABLE}),
d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, {_PLAIN_WORD}) AS w FROM documents), u AS (SELECT doc_id, unnest(w) AS f FROM d),
v AS (SELECT unnest(regexp_extract_all({_LOWERED}, {_PLAIN_WORD})) AS f FROM benchmark),
k AS (SELECT f, {_CRC.format(_BYTES.format("f"))} % 10000 AS bucket FROM (SELECT f FROM u UNION SELECT f FROM v), t),
s AS (SELECT bucket, count(*) AS s FROM u JOIN k USING (f) GROUP BY bucket), r AS (SELECT bucket, count(*) AS t FROM v JOIN k USING (f) GROUP BY bucket),
g AS (SELECT b.bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1) * CAST((SELECT count(*) FROM u) + 10000 AS DOUBLE) / ((coalesce(s, 0) + 1) * CAST((SELECT count(*) FROM v) + 10000 AS DOUBLE)))) AS BIGINT) AS gain
  FROM (SELECT unnest(range(0, 10000)) AS bucket) b LEFT JOIN s USING (bucket) LEFT JOIN r USING (bucket)),
w AS (SELECT doc_id, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM u JOIN k USING (f) JOIN g USING (bucket) GROUP BY doc_id),
x AS (SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN w USING (doc_id)),
y AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM x),
e AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM y WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM y LEFT JOIN e USING (doc_id)
"""

OP13_SQL = r"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, i, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)),
e AS (SELECT *, replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t') AS body FROM c)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(length('### ' || role || ': ' || body || '</turn>') + 1) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).drop("n_templates")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicate_components(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_query(table(spark, sf_dir, "documents"))


def op5_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), n_shards=24)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_orc.token_query(table(spark, sf_dir, "documents"))


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op10_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repetition.repetition_rules(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair_query(table(spark, sf_dir, "conversations"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_trees.chat_query(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_license_scan, op2_toxicity, op3_ngram_jaccard, op4_language_id, op5_jump_sharding,
        op6_quality, op7_token_orc, op8_winnowing, op9_pivotal_mixing, op10_repetition_rules, op11_turn_repair, op12_importance_resampling, op13_reply_trees, pipeline,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": _op1_sql(), "op3_ngram_jaccard": OP3_SQL, "op8_winnowing": OP8_SQL, "op10_repetition_rules": OP10_SQL, "op11_turn_repair": _op11_sql(), "op12_importance_resampling": OP12_SQL, "op13_reply_trees": OP13_SQL}
