"""Versions of a labelled set: a chain of content hashes, and what a later version did to earlier rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Hex digits of each quarter of a row's hash: 60 bits, so a quarter fits a long and a sum of 2^60 of them a decimal.
_QUARTER = 15


def row_hash(*columns: str) -> Column:
    """SHA-256 of the columns as text, each with its length before it and null as ``-``, so no two rows read alike."""
    parts = [F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat_ws("|", *parts), 256)


def chain(rows: DataFrame, version: str, content: list[str]) -> DataFrame:
    """(version, rows, content_hash, chain_hash), versions in ascending order.

    A version's content hash is that of four sums over its rows' hashes: it depends on the rows and how
    often each stands there, not on their order, and it adds up in parts before the shuffle. The chain
    hash covers the version before it, so a change in an old version shows in every later one.
    Versions are few: their chain is one row's fold. Rows of a null version are left out.
    """
    h = rows.where(F.col(version).isNotNull()).select(version, row_hash(*content).alias("_h"))
    quarters = [F.conv(F.substring("_h", 1 + i * _QUARTER, _QUARTER), 16, 10).cast("decimal(20,0)") for i in range(4)]
    sums = h.groupBy(version).agg(F.count(F.lit(1)).alias("rows"), *[F.sum(q).cast("string").alias(f"_s{i}") for i, q in enumerate(quarters)])
    own = sums.select(version, "rows", F.sha2(F.concat_ws("/", F.col("rows").cast("string"), *[f"_s{i}" for i in range(4)]), 256).alias("content_hash"))
    # the list holds one short row for each version, in order
    one = own.groupBy().agg(F.array_sort(F.collect_list(F.struct(version, "rows", "content_hash"))).alias("v"))
    entry = f"named_struct('{version}', x.{version}, 'rows', x.rows, 'content_hash', x.content_hash, 'chain_hash', sha2(concat(coalesce(element_at(a, -1).chain_hash, ''), '>', x.content_hash), 256))"
    empty = f"cast(array() as array<struct<{version}:{rows.schema[version].dataType.simpleString()},rows:bigint,content_hash:string,chain_hash:string>>)"
    # try_element_at of an empty list is null, where element_at fails
    folded = F.expr(f"aggregate(v, {empty}, (a, x) -> array_append(a, {entry.replace('element_at(', 'try_element_at(')}))")
    return one.select(F.explode(folded).alias("r")).select("r.*")


def faults(rows: DataFrame, version: str, key: str, content: list[str]) -> DataFrame:
    """(version, key, fault) for what the next version did to a version's rows; ``version`` is the later one.

    ``lost``: the key is gone. ``altered``: its content is another. ``repeated``: the key stands there
    more than once (told once for each version). A set that only grows has none. Null keys are ``keyless``.
    """
    h = rows.where(F.col(version).isNotNull()).select(version, key, row_hash(*content).alias("_h"))
    keyless = h.where(F.col(key).isNull()).select(version, key, F.lit("keyless").alias("fault")).distinct()
    per = h.where(F.col(key).isNotNull()).groupBy(version, key).agg(F.count(F.lit(1)).alias("_n"), F.min("_h").alias("_h"))
    repeated = per.where("_n > 1").select(version, key, F.lit("repeated").alias("fault"))
    # each version with the one after it: a table as long as there are versions
    versions = h.select(version).distinct()
    after = versions.withColumn("_next", F.lead(version).over(W.partitionBy(F.lit(0)).orderBy(version))).where("_next is not null")
    old = per.join(after, version).select(F.col("_next").alias(version), key, F.col("_h").alias("_old"))
    kept = old.join(per.select(version, key, "_h"), [version, key], "left")
    fault = F.when(F.col("_h").isNull(), "lost").when(F.col("_h") != F.col("_old"), "altered")
    return kept.select(version, key, fault.alias("fault")).where("fault is not null").unionByName(repeated).unionByName(keyless)


def template_faults(sheet: DataFrame, template: DataFrame, key: str, fixed: list[str]) -> DataFrame:
    """(key, fault, fields) where a filled-in sheet departs from its template in the columns a reviewer must not touch.

    ``missing``, ``unexpected``, or ``changed`` with the names of the changed columns. Keys are unique in both.
    """
    s = sheet.select(key, *[F.col(c).alias(f"_s_{c}") for c in fixed], F.lit(True).alias("_in_sheet"))
    t = template.select(key, *[F.col(c).alias(f"_t_{c}") for c in fixed], F.lit(True).alias("_in_template"))
    changed = F.filter(F.array(*[F.when(~F.col(f"_s_{c}").eqNullSafe(F.col(f"_t_{c}")), c) for c in fixed]), lambda c: c.isNotNull())
    both = s.join(t, key, "full_outer")
    fault = F.when(F.col("_in_sheet").isNull(), "missing").when(F.col("_in_template").isNull(), "unexpected").when(F.size(changed) > 0, "changed")
    return both.select(key, fault.alias("fault"), F.when(fault == "changed", F.array_join(changed, ",")).alias("fields")).where("fault is not null")


_VERSIONS_SQL = """
WITH v AS (SELECT version, doc_id, quality, CASE WHEN doc_id % 37 = 0 AND version >= 3 THEN 1 - toxic ELSE toxic END AS toxic FROM labels, range(1, 6) r(version)
  WHERE doc_id % 5 < version AND NOT (doc_id % 41 = 0 AND version = 4)),
h AS (SELECT version, doc_id, sha256(concat_ws('|', coalesce(len(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(len(quality::VARCHAR) || ':' || quality, '-'), coalesce(len(toxic::VARCHAR) || ':' || toxic, '-'))) AS h FROM v)"""

CHAIN_SQL = (
    _VERSIONS_SQL.replace("WITH v", "WITH RECURSIVE v")
    + """,
s AS (SELECT version, count(*) AS rows, sum(('0x' || substr(h, 1, 15))::BIGINT)::VARCHAR AS a, sum(('0x' || substr(h, 16, 15))::BIGINT)::VARCHAR AS b, sum(('0x' || substr(h, 31, 15))::BIGINT)::VARCHAR AS c, sum(('0x' || substr(h, 46, 15))::BIGINT)::VARCHAR AS d FROM h GROUP BY version),
o AS (SELECT version, rows, sha256(concat_ws('/', rows::VARCHAR, a, b, c, d)) AS content_hash FROM s),
k AS (SELECT version, rows, content_hash, sha256('>' || content_hash) AS chain_hash FROM o WHERE version = 1
  UNION ALL SELECT o.version, o.rows, o.content_hash, sha256(k.chain_hash || '>' || o.content_hash) FROM k JOIN o ON o.version = k.version + 1)
SELECT version, rows, content_hash, chain_hash FROM k"""
)
FAULTS_SQL = (
    _VERSIONS_SQL
    + """
SELECT a.version + 1 AS version, a.doc_id, CASE WHEN b.h IS NULL THEN 'lost' ELSE 'altered' END AS fault
FROM (SELECT DISTINCT version, doc_id, h FROM h WHERE version < 5) a LEFT JOIN (SELECT DISTINCT version, doc_id, h FROM h) b ON b.version = a.version + 1 AND b.doc_id = a.doc_id
WHERE b.h IS NULL OR b.h <> a.h"""
)
