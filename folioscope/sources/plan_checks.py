"""Checks of candidate plans: nested JSON documents, judged as rows of violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of a plan's fields and what they must hold.
INTEGERS = ("selected_total", "target_min", "target_max")
ID_FIELDS = ("openalex_id", "id")
YEAR_FIELDS = ("year", "publication_year")
SECRET_FIELDS = ("api_key", "mailto", "contact", "contact_email", "email")
SECRET_ENDINGS = ("_api_key", "_mailto")
EMAIL = r"[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"

# A key in the JSON text: its opening quote isn't escaped. An empty string, null or false is no secret.
_SECRET = r'(?i)(?<!\\)"(?:' + "|".join(SECRET_FIELDS) + r'|[^"\\]*(?:' + "|".join(SECRET_ENDINGS) + r'))"\s*+:\s*+(?!null|false|"")'
_CONTACT = r'(?i)(?<!\\)"[^"\\]*(?:mailto|contact|email)[^"\\]*"\s*+:\s*+(?:\[[^\]]*)?"[^"]*' + EMAIL


def _part(document: Column, field: str) -> Column:
    return F.try_variant_get(document, f"$.{field}", "variant")


def _kind(part: Column) -> Column:
    """The type's first word: BIGINT, STRING, BOOLEAN, ARRAY, OBJECT, VOID for a JSON null; null where absent."""
    return F.regexp_extract(F.schema_of_variant(part), "^([A-Z]+)", 1)


def _text(document: Column, field: str) -> Column:
    return F.try_variant_get(document, f"$.{field}", "string")


def _blank(text: Column) -> Column:
    """Whether there is nothing but white space, of any script."""
    return ~text.rlike(r"(?U)\S")


def _first_given(document: Column, fields: tuple[str, ...]) -> Column:
    """(kind, text) of the first field that holds anything but null, false, 0 or the empty string; else null."""
    each = [F.when(~F.coalesce(_text(document, f), F.lit("")).isin("", "false", "0"), F.struct(_kind(_part(document, f)).alias("kind"), _text(document, f).alias("text"))) for f in fields]
    return F.coalesce(*each)


def _broken(rules: list[tuple[str, Column]]) -> Column:
    return F.filter(F.array(*[F.when(F.coalesce(broken, F.lit(True)), name) for name, broken in rules]), lambda r: r.isNotNull())


def violations(plans: DataFrame, key: str, body: str) -> DataFrame:
    """(key, position, rule) for every broken rule; a plan without a row is valid.

    ``position`` counts candidates from 1 and is null for rules of the whole plan. A text that is no JSON
    (null and empty ones too), or no object, breaks only ``not_json`` or ``not_object``. A rule on two
    fields is judged only where both have their type. Secrets are looked for at every depth of the
    text; contact addresses in values of keys that name a contact, or in a list right below one.
    """
    parsed = plans.select(key, F.col(body).alias("_body"), F.try_parse_json(F.col(body)).alias("_v"))
    v = F.col("_v")
    for f in INTEGERS:
        parsed = parsed.withColumn(f"_{f}", F.when(_kind(_part(v, f)) == "BIGINT", F.try_variant_get(v, f"$.{f}", "bigint")))
    parsed = parsed.withColumn("_rows", F.when(_kind(_part(v, "selected_candidates")) == "ARRAY", F.try_variant_get(v, "$.selected_candidates", "array<variant>")))
    total, low, high, rows = F.col("_selected_total"), F.col("_target_min"), F.col("_target_max"), F.col("_rows")
    caveats = F.when(_kind(_part(v, "caveats")) == "ARRAY", F.lower(_text(v, "caveats")))
    no = F.lit(False)
    rules = [(f"{f}_not_integer", F.col(f"_{f}").isNull()) for f in INTEGERS]
    rules += [
        ("selected_total_not_positive", F.coalesce(total <= 0, no)),
        ("candidates_not_list", rows.isNull()),
        ("candidates_count", F.coalesce(F.size(rows) != total, no) & rows.isNotNull()),
        ("target_range_reversed", F.coalesce(high < low, no)),
        ("outside_target_range", F.coalesce((total < low) | (total > high), no)),
        ("auth_mode", (_kind(_part(v, "auth_mode")) != "STRING") | (_text(v, "auth_mode") != "api_key")),
        ("key_not_provided", (_kind(_part(v, "api_key_provided")) != "BOOLEAN") | (_text(v, "api_key_provided") != "true")),
        ("caveats_not_list", caveats.isNull()),
        ("caveats_without_dry_run", F.coalesce(~(caveats.contains("dry-run") & (caveats.contains("no postgres") | caveats.contains("no database"))), no)),
        ("secret_field", F.regexp_like("_body", F.lit(_SECRET))),
        ("contact_address", F.regexp_like("_body", F.lit(_CONTACT))),
    ]
    kind = _kind(v)
    found = F.when(v.isNull(), F.array(F.lit("not_json"))).when(kind != "OBJECT", F.array(F.lit("not_object"))).otherwise(_broken(rules))
    whole = parsed.select(key, F.lit(None).cast("int").alias("position"), F.explode(found).alias("rule"))
    one = parsed.where(kind == "OBJECT").select(key, F.posexplode("_rows").alias("_at", "_c"))
    c = F.col("_c")
    item, year = _first_given(c, ID_FIELDS), _first_given(c, YEAR_FIELDS)
    row_rules = [
        ("candidate_without_id", (item["kind"] != "STRING") | _blank(item["text"])),
        ("candidate_without_title", _blank(F.coalesce(_text(c, "title"), F.lit("")))),
        ("candidate_year_not_integer", year["kind"] != "BIGINT"),
    ]
    of_row = F.when(_kind(c) != "OBJECT", F.array(F.lit("candidate_not_object"))).otherwise(_broken(row_rules))
    return whole.unionByName(one.select(key, (F.col("_at") + 1).alias("position"), F.explode(of_row).alias("rule")))


VIOLATIONS_SQL = """
WITH o AS (SELECT o_custkey AS k, o_orderkey AS w, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS position FROM orders),
p AS (SELECT k, count(*) AS n, count(*) + CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END AS total FROM o GROUP BY k)
SELECT k AS plan_id, NULL::INTEGER AS position, 'not_json' AS rule FROM p WHERE k % 7 = 0
UNION ALL SELECT k, NULL, 'candidates_count' FROM p WHERE k % 7 <> 0 AND total <> n
UNION ALL SELECT k, NULL, 'outside_target_range' FROM p WHERE k % 7 <> 0 AND (total < 5 OR total > 25)
UNION ALL SELECT k, NULL, 'auth_mode' FROM p WHERE k % 7 <> 0 AND k % 13 = 0
UNION ALL SELECT k, NULL, 'secret_field' FROM p WHERE k % 7 <> 0 AND k % 23 = 0
UNION ALL SELECT k, position::INTEGER, 'candidate_without_title' FROM o WHERE k % 7 <> 0 AND w % 17 = 0
UNION ALL SELECT k, position::INTEGER, 'candidate_year_not_integer' FROM o WHERE k % 7 <> 0 AND w % 19 = 0"""
