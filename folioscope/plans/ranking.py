"""Per-family ranking scores over a candidate set, and the views on a finished run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions.numeric import clamp01, exact_score, millionths, score6
from folioscope.operators.bridges import overlap
from folioscope.operators.ranks import numbered
from folioscope.plans.catalog import POOL_SQL, in_low_cite_pool, top_topics
from folioscope.session import stored
from folioscope.sources.corpus import Corpus

FAMILIES = ("emerging", "bridge", "undercited")
MAX_BRIDGE_WEIGHT = 0.25


@dataclass(frozen=True)
class Weights:
    semantic: float
    velocity: float
    growth: float
    bridge: float
    penalty: float


#: The weights of each family.
WEIGHTS = {
    "emerging": Weights(0.0, 0.60, 0.40, 0.0, 0.05),
    "bridge": Weights(0.0, 0.35, 0.65, 0.0, 0.20),
    "undercited": Weights(0.0, 0.30, 0.70, 0.0, 0.25),
}
SEMANTIC_EMERGING = Weights(0.2, 0.5, 0.3, 0.0, 0.05)


def family_weights(bridge_weight: float = 0.0, semantic: bool = False) -> dict[str, Weights]:
    """The weights of a run; the bridge weight is bounded so that a slip stays small."""
    if not 0.0 <= bridge_weight <= MAX_BRIDGE_WEIGHT:
        raise ValueError(f"the bridge weight lies in [0, {MAX_BRIDGE_WEIGHT}]: {bridge_weight}")
    b = WEIGHTS["bridge"]
    return WEIGHTS | {"bridge": Weights(b.semantic, b.velocity, b.growth, bridge_weight, b.penalty)} | ({"emerging": SEMANTIC_EMERGING} if semantic else {})


def partial_score(weights: Weights, semantic: Column, velocity: Column, growth: Column, bridge: Column, penalty: Column) -> Column:
    """Weighted mean of the signals that are not null, less the weighted penalty; 0 without signals or weight."""
    parts = [(weights.semantic, semantic), (weights.velocity, velocity), (weights.growth, growth), (weights.bridge, bridge)]
    weight = sum((F.when(x.isNotNull(), w).otherwise(0.0) for w, x in parts), F.lit(0.0))
    # each share first, then the sum, as the scores are defined
    total = sum((F.coalesce(F.lit(w) / weight * x, F.lit(0.0)) for w, x in parts), F.lit(0.0))
    return F.when(weight > 0, total).otherwise(0.0) - weights.penalty * F.coalesce(penalty, F.lit(0.0))


def _hundredths(weight: float) -> int:
    return round(100 * weight)


def final_score(weights: Weights, semantic: Column, velocity: Column, growth: Column, bridge: Column, penalty: Column) -> Column:
    """``partial_score`` of signals kept to six places, to six places, in whole numbers; halves go away from zero."""
    parts = [(_hundredths(w), x) for w, x in ((weights.semantic, semantic), (weights.velocity, velocity), (weights.growth, growth), (weights.bridge, bridge))]
    weight = sum((F.when(x.isNotNull(), w).otherwise(0) for w, x in parts), F.lit(0)).cast("long")
    total = sum((F.coalesce(w * millionths(x), F.lit(0)) for w, x in parts), F.lit(0).cast("long"))
    less = _hundredths(weights.penalty) * F.coalesce(millionths(penalty), F.lit(0))
    return F.when(weight > 0, exact_score(100 * total - less * weight, 100.0 * weight)).otherwise(exact_score(-less, F.lit(100.0)))


def candidates(c: Corpus) -> DataFrame:
    """Included works with their distinct topic ids."""
    topics = c.work_topics.groupBy("work_id").agg(F.collect_set("topic_id").alias("topic_ids"))
    return c.included.join(topics, "work_id", "left").withColumn("topic_ids", F.coalesce("topic_ids", F.array().cast("array<int>")))


def signals(works: DataFrame) -> DataFrame:
    """Adds velocity, growth, breadth_penalty, in_pool and popularity_penalty.

    All maxima hold for the candidate set, and the popularity maximum for pool members only.
    They come from one aggregate row each, joined back, so no window gathers all rows.
    """
    span = works.agg(F.max("year").alias("last"), F.min("year").alias("first"), F.max(F.size("topic_ids")).alias("most_topics"))
    w = works.crossJoin(F.broadcast(span)).withColumn("in_pool", in_low_cite_pool())
    w = w.withColumn("per_year", F.col("citation_count") / F.greatest(F.lit(1), F.col("last") - F.col("year") + 1).cast("double"))
    w = w.withColumn("log_cites", F.log1p("citation_count"))
    top = w.agg(F.max("per_year").alias("top_rate"), F.max(F.when(F.col("in_pool"), F.col("log_cites"))).alias("top_log"))
    w = w.crossJoin(F.broadcast(top))
    recent = F.col("year") >= F.greatest(F.col("last") - 1, F.col("first"))
    each = w.select("work_id", recent.alias("recent"), F.explode("topic_ids").alias("topic_id"))
    share = each.groupBy("topic_id").agg((F.sum(F.col("recent").cast("int")) / F.count(F.lit(1))).alias("share"))
    growth = each.join(share, "topic_id").groupBy("work_id").agg(score6(F.avg("share")).alias("growth"))
    breadth = clamp01(F.size("topic_ids") / F.col("most_topics").cast("double"))
    return w.join(growth, "work_id", "left").select(
        *works.columns,
        "in_pool",
        F.when(F.col("top_rate") > 0, score6(F.col("per_year") / F.col("top_rate"))).otherwise(0.0).alias("velocity"),
        F.coalesce("growth", F.lit(0.0)).alias("growth"),
        F.when(F.col("most_topics") > 0, score6(1.0 - breadth)).otherwise(1.0).alias("breadth_penalty"),
        F.when(F.col("in_pool"), F.when(F.col("top_log") > 0, score6(F.col("log_cites") / F.col("top_log"))).otherwise(0.0)).alias("popularity_penalty"),
    )


#: Reasons shown with a score.
REASONS = {
    "emerging": "Recent paper with citation momentum in active topics; semantic and bridge not yet modeled.",
    "bridge": "Multi-topic paper in active topics; no cluster_version on this run so bridge_score was not computed.",
    "undercited": "Low-cite candidate pool: core corpus, recency floor, citation ceiling, title+abstract gate; popularity penalty among pool members only.",
}


def paper_scores(c: Corpus, bridge: DataFrame | None = None, semantic: DataFrame | None = None, bridge_weight: float = 0.0) -> DataFrame:
    """One row for each work and family: emerging and bridge for all candidates, undercited for the pool.

    ``bridge`` may give (work_id, bridge_score, bridge_eligible), ``semantic`` (work_id, semantic_score).
    The families come from one pass over the signals, as an array of structs.
    """
    weights = family_weights(bridge_weight, semantic is not None)
    # the candidates are read several times: for the maxima, the topic shares and the scores
    s = signals(stored(candidates(c), "candidates"))
    none = F.lit(None).cast("double")
    s = s.join(bridge, "work_id", "left") if bridge is not None else s.withColumns({"bridge_score": none, "bridge_eligible": F.lit(None).cast("boolean")})
    s = s.join(semantic, "work_id", "left") if semantic is not None else s.withColumn("semantic_score", none)
    penalty = {"emerging": F.lit(0.0), "bridge": F.col("breadth_penalty"), "undercited": F.col("popularity_penalty")}

    def row(family: str) -> Column:
        sem = F.col("semantic_score") if family == "emerging" else none
        bri = F.col("bridge_score") if family == "bridge" else none
        eligible = F.col("bridge_eligible") if family == "bridge" else F.lit(None).cast("boolean")
        final = final_score(weights[family], sem, F.col("velocity"), F.col("growth"), bri, penalty[family])
        return F.struct(
            F.lit(family).alias("family"), score6(sem).alias("semantic"), F.col("velocity").alias("velocity"), F.col("growth").alias("growth"), score6(bri).alias("bridge"),
            score6(penalty[family]).alias("penalty"), F.coalesce(final, F.lit(0.0)).alias("final_score"), eligible.alias("eligible"), F.lit(REASONS[family]).alias("reason"),
        )

    rows = F.array(row("emerging"), row("bridge"), F.when(F.col("in_pool"), row("undercited")))
    return s.select("work_id", F.explode(F.array_compact(rows)).alias("r")).select("work_id", "r.*")


SCORES_CTE = f"""
, cand AS (
  SELECT w.*, coalesce(n, 0) AS n_topics FROM included w LEFT JOIN (SELECT work_id, count(DISTINCT topic_id) AS n FROM work_topics GROUP BY work_id) USING (work_id)
), span AS (SELECT max(year) AS last, min(year) AS first, max(n_topics) AS most FROM cand),
rate AS (SELECT cand.*, citation_count / CAST(greatest(1, last - year + 1) AS DOUBLE) AS r, year >= greatest(last - 1, first) AS recent, most, ({POOL_SQL}) AS in_pool FROM cand, span),
share AS (SELECT topic_id, sum(recent::INT) / count(*)::DOUBLE AS share FROM rate JOIN work_topics USING (work_id) GROUP BY topic_id),
growth AS (SELECT work_id, round(avg(share), 6) AS growth FROM work_topics JOIN share USING (topic_id) GROUP BY work_id),
sig AS (
  SELECT rate.*, round(r / max(r) OVER (), 6) AS velocity, coalesce(g.growth, 0.0) AS growth, round(1.0 - n_topics / most::DOUBLE, 6) AS breadth,
    round(ln(1 + citation_count) / max(CASE WHEN in_pool THEN ln(1 + citation_count) END) OVER (), 6) AS popularity
  FROM rate LEFT JOIN growth g USING (work_id)
), parts AS (
  SELECT *, CAST(round(velocity * 1000000) AS BIGINT) AS v, CAST(round(growth * 1000000) AS BIGINT) AS g, CAST(round(breadth * 1000000) AS BIGINT) AS b, CAST(round(popularity * 1000000) AS BIGINT) AS p FROM sig
), scores AS (
  SELECT work_id, 'emerging' AS family, velocity, growth, 0.0::DOUBLE AS penalty, round((60 * v + 40 * g) / 100.0::DOUBLE) / 1000000.0::DOUBLE AS final_score FROM parts
  UNION ALL SELECT work_id, 'bridge', velocity, growth, breadth, round((35 * v + 65 * g - 20 * b) / 100.0::DOUBLE) / 1000000.0::DOUBLE FROM parts
  UNION ALL SELECT work_id, 'undercited', velocity, growth, popularity, round((30 * v + 70 * g - 25 * p) / 100.0::DOUBLE) / 1000000.0::DOUBLE FROM parts WHERE in_pool
)"""


def score_view(c: Corpus) -> DataFrame:
    """Scores and the signals they come from."""
    return paper_scores(c).select("work_id", "family", "velocity", "growth", "penalty", (F.col("final_score") + 0.0).alias("final_score"))


SCORE_VIEW_SQL = SCORES_CTE + " SELECT work_id, family, velocity, growth, penalty, final_score + 0.0 AS final_score FROM scores"


def ranked_list(c: Corpus, scores: DataFrame, family: str, limit: int, eligible_only: bool = False) -> DataFrame:
    """The head of one family, with work data and topics."""
    head = scores.where(F.col("family") == family)
    if eligible_only:
        head = head.where(F.col("eligible").eqNullSafe(F.lit(True)))
    head = head.orderBy(F.desc("final_score"), "work_id").limit(limit).withColumn("rank", F.row_number().over(W.orderBy(F.desc("final_score"), "work_id")))
    full = head.join(c.works.select("work_id", "paper_id", "year", "citation_count"), "work_id").join(top_topics(c.work_topics), "work_id", "left")
    return full.select("rank", "paper_id", "year", "citation_count", F.coalesce("topics", F.lit("")).alias("topics"))


RANKED_LIST_SQL = SCORES_CTE + """
SELECT CAST(row_number() OVER (ORDER BY final_score DESC, work_id) AS INTEGER) AS rank, paper_id, year, citation_count, coalesce(topics, '') AS topics
FROM (SELECT * FROM scores WHERE family = 'emerging' ORDER BY final_score DESC, work_id LIMIT 50) JOIN works USING (work_id) LEFT JOIN top_topics USING (work_id)"""


def family_ranks(scores: DataFrame, works: DataFrame, of_score: tuple[str, ...] = (), of_work: tuple[str, ...] = ()) -> DataFrame:
    """Exactly one row for each given work and family: its rank there, or null; with further columns of the score and of the work."""
    ranked = numbered(scores.select("work_id", "family", "final_score"), [F.desc("final_score"), F.asc("work_id")], by=("family",))
    families = F.explode(F.array(*[F.lit(f) for f in FAMILIES])).alias("family")
    wanted = works.select("work_id", families, *of_work)
    order = F.array_position(F.array(*[F.lit(f) for f in FAMILIES]), F.col("family")).cast("int")
    return wanted.join(ranked.select("work_id", "family", "rank", *of_score), ["work_id", "family"], "left").select("work_id", "family", order.alias("family_order"), "rank", *of_score, *of_work)


FAMILY_RANKS_SQL = SCORES_CTE + """
, ranked AS (SELECT work_id, family, CAST(rank() OVER (PARTITION BY family ORDER BY final_score DESC, work_id) AS INTEGER) AS rank FROM scores)
SELECT w.work_id, f.family, CAST(f.o AS INTEGER) AS family_order, rank FROM (SELECT work_id FROM included) w
CROSS JOIN (VALUES ('emerging', 1), ('bridge', 2), ('undercited', 3)) f(family, o) LEFT JOIN ranked ON ranked.work_id = w.work_id AND ranked.family = f.family"""


def explanations(scores: DataFrame) -> DataFrame:
    """One row for each score and signal: its role, value, contribution to the final score, and strength.

    A null signal is not computed and its weight goes to the others; a signal without weight is
    measured only; the penalty counts against the score.
    """
    names = ("semantic", "velocity", "growth", "bridge")

    def weight(name: str) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for f in FAMILIES for x in (f, getattr(WEIGHTS[f], name))]), F.col("family"))

    def whole(w: Column) -> Column:
        return F.round(w * 100).cast("long")

    total = sum((F.when(F.col(n).isNotNull(), weight(n)).otherwise(0.0) for n in names), F.lit(0.0))

    def strength(x: Column) -> Column:
        return F.when(x >= 0.66, "high").when(x >= 0.33, "medium").when(x.isNotNull(), "low")

    parts = []
    for n in names:
        x, w = F.col(n), weight(n)
        role = F.when(x.isNull(), "not_computed").when(w > 0, "used").otherwise("measured")
        parts.append(F.struct(F.lit(n).alias("signal"), role.alias("role"), x.alias("value"), F.when(x.isNotNull(), F.when(total > 0, exact_score(whole(w) * millionths(x), 100.0 * total)).otherwise(0.0)).alias("contribution"), strength(x).alias("strength")))
    penalty = F.coalesce("penalty", F.lit(0.0))
    parts.append(F.struct(F.lit("penalty").alias("signal"), F.lit("penalty").alias("role"), penalty.alias("value"), exact_score(-whole(weight("penalty")) * millionths(penalty), F.lit(100.0)).alias("contribution"), strength(penalty).alias("strength")))
    each = scores.select("work_id", "family", F.explode(F.array(*parts)).alias("s")).select("work_id", "family", "s.*")
    return each.withColumn("contribution", F.col("contribution") + 0.0)


EXPLANATIONS_SQL = SCORES_CTE + """
, w AS (SELECT * FROM (VALUES ('emerging', 60, 40, 5), ('bridge', 35, 65, 20), ('undercited', 30, 70, 25)) t(family, v, g, p)),
s AS (SELECT work_id, scores.family, velocity, growth, penalty, v, g, p FROM scores JOIN w ON w.family = scores.family),
x AS (SELECT work_id, family, 'velocity' AS signal, 'used' AS role, velocity AS value, v * CAST(round(velocity * 1000000) AS BIGINT) AS c FROM s UNION ALL SELECT work_id, family, 'growth', 'used', growth, g * CAST(round(growth * 1000000) AS BIGINT) FROM s
  UNION ALL SELECT work_id, family, 'penalty', 'penalty', penalty, -p * CAST(round(penalty * 1000000) AS BIGINT) FROM s
  UNION ALL SELECT work_id, family, 'semantic', 'not_computed', NULL, NULL FROM s UNION ALL SELECT work_id, family, 'bridge', 'not_computed', NULL, NULL FROM s)
SELECT work_id, family, signal, role, value, round(c / 100.0::DOUBLE) / 1000000.0::DOUBLE + 0.0 AS contribution, CASE WHEN value >= 0.66 THEN 'high' WHEN value >= 0.33 THEN 'medium' WHEN value IS NOT NULL THEN 'low' END AS strength FROM x"""


def evaluation_arms(c: Corpus, scores: DataFrame, family: str = "undercited", k: int = 50) -> DataFrame:
    """Three orderings of one pool, compared: by score, by citations and by date.

    Recency, citation and topic measures of each arm's first k works, its five most common topics, and
    the Jaccard similarity of its topics with those of each arm.
    """
    pool = c.included.where(in_low_cite_pool()) if family == "undercited" else c.included
    own = scores.where(F.col("family") == family).select("work_id", "final_score")
    pool = stored(pool.select("work_id", "paper_id", "year", "citation_count").join(own, "work_id", "left"), "pool")
    heads = {
        "ranked": pool.where("final_score is not null").orderBy(F.desc("final_score"), "work_id").limit(k),
        "citation": pool.orderBy(F.desc("citation_count"), F.desc("year"), "paper_id").limit(k),
        "date": pool.orderBy(F.desc("year"), "paper_id").limit(k),
    }
    arms = None
    for name, head in heads.items():
        part = head.select(F.lit(name).alias("arm"), "work_id", "year", "citation_count")
        arms = part if arms is None else arms.unionByName(part)
    # 3 k rows
    arms = stored(arms, "arms")
    newest = arms.groupBy("arm").agg(F.max("year").alias("max_year"))
    measured = arms.join(newest, "arm").groupBy("arm").agg(
        F.avg("year").alias("mean_year"),
        F.min("year").alias("min_year"),
        F.max("year").alias("max_year"),
        F.round(F.avg((F.col("year") >= F.col("max_year") - 1).cast("double")), 4).alias("share_in_latest_two_years"),
        F.round(F.avg("citation_count"), 4).alias("mean_citations"),
        F.median("citation_count").alias("median_citations"),
    )
    named = stored(c.work_topics.join(arms.select("arm", "work_id"), "work_id").groupBy("arm", "topic_name").agg(F.count(F.lit(1)).alias("n")), "arm-topics")
    common = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "topic_name")))
    topics = named.groupBy("arm").agg(F.count(F.lit(1)).alias("unique_topics"), F.array_join(F.transform(F.slice(common, 1, 5), lambda x: x["topic_name"]), "|").alias("top_topics"), F.collect_list("topic_name").alias("names"))
    sets = topics.select("arm", "names").groupBy().pivot("arm", list(heads)).agg(F.first("names"))
    with_sets = measured.join(topics, "arm", "left").crossJoin(F.broadcast(sets))
    similar = [F.round(overlap(F.coalesce("names", F.array().cast("array<string>")), F.coalesce(a, F.array().cast("array<string>")))["jaccard"], 4).alias(f"jaccard_{a}") for a in heads]
    return with_sets.select(*measured.columns, "unique_topics", "top_topics", *similar)


EVALUATION_SQL = SCORES_CTE + f"""
, pool AS (SELECT * FROM included WHERE {POOL_SQL}), arms AS (
  SELECT 'ranked' AS arm, work_id, year, citation_count FROM (SELECT pool.*, final_score FROM pool JOIN scores USING (work_id) WHERE family = 'undercited' ORDER BY final_score DESC, work_id LIMIT 50)
  UNION ALL SELECT 'citation', work_id, year, citation_count FROM (SELECT * FROM pool ORDER BY citation_count DESC, year DESC, paper_id LIMIT 50)
  UNION ALL SELECT 'date', work_id, year, citation_count FROM (SELECT * FROM pool ORDER BY year DESC, paper_id LIMIT 50)
), m AS (SELECT arm, max(year) AS max_year FROM arms GROUP BY arm), n AS (SELECT arm, topic_name, count(*) AS n FROM arms JOIN work_topics USING (work_id) GROUP BY 1, 2),
u AS (SELECT arm, count(*) AS unique_topics, array_to_string(list_slice(list(topic_name ORDER BY n DESC, topic_name), 1, 5), '|') AS top_topics, list(topic_name) AS names FROM n GROUP BY arm),
o AS (SELECT x.arm, y.arm AS other, round(len(list_intersect(x.names, y.names)) / len(list_distinct(list_concat(x.names, y.names)))::DOUBLE, 4) AS j FROM u x, u y)
SELECT arm, avg(year) AS mean_year, min(year) AS min_year, max(year) AS max_year, round(avg((year >= m.max_year - 1)::INT::DOUBLE), 4) AS share_in_latest_two_years,
  round(avg(citation_count), 4) AS mean_citations, median(citation_count)::DOUBLE AS median_citations, any_value(u.unique_topics) AS unique_topics, any_value(u.top_topics) AS top_topics,
  (SELECT j FROM o WHERE o.arm = arms.arm AND other = 'ranked') AS jaccard_ranked, (SELECT j FROM o WHERE o.arm = arms.arm AND other = 'citation') AS jaccard_citation, (SELECT j FROM o WHERE o.arm = arms.arm AND other = 'date') AS jaccard_date
FROM arms JOIN m USING (arm) LEFT JOIN u USING (arm) GROUP BY arm"""
