"""Bridge diagnostics: overlap of heads, eligibility variants, residual objectives, churn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.operators.neighbors import bridge_boundary, nearest
from folioscope.operators.ranks import before
from folioscope.session import stored


def overlap(a: Column, b: Column, empty: float | None = 1.0) -> Column:
    """struct(shared, jaccard) of two arrays as sets; two empty ones have ``empty``."""
    shared, both = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.struct(shared.alias("shared"), F.when(both > 0, F.round(shared / both, 6)).otherwise(F.lit(empty).cast("double")).alias("jaccard"))


def head_ids(df: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """One row with the ids of the first k rows."""
    head = df.where(F.col(score).isNotNull()).orderBy(F.desc(score), key).limit(k)
    return head.agg(F.array_sort(F.collect_list(key)).alias("ids"))


def mix_signals(vectors: DataFrame, k: int = 15) -> DataFrame:
    """(work_id, n, same_share, cross_share, distinct_clusters) from the k nearest works."""
    near = nearest(vectors, vectors, k).withColumnRenamed("cluster_id", "their_cluster")
    own = vectors.select(F.col("work_id").alias("query_id"), "cluster_id")
    same = (F.col("their_cluster") == F.col("cluster_id")).cast("double")
    return near.join(own, "query_id").groupBy(F.col("query_id").alias("work_id")).agg(F.count(F.lit(1)).alias("n"), F.avg(same).alias("same_share"), (1 - F.avg(same)).alias("cross_share"), F.count_distinct("their_cluster").alias("distinct_clusters"))


def bridge_rows(vectors: DataFrame, k: int = 15) -> DataFrame:
    """(work_id, bridge_score, n, same_share, cross_share, distinct_clusters); stored, as the neighbour search is behind every row."""
    score = bridge_boundary(vectors).select("work_id", F.round("boundary", 6).alias("bridge_score"))
    return stored(score.join(mix_signals(vectors, k), "work_id", "left"), "bridge-signals")


def top_half_cutoff(rows: DataFrame) -> DataFrame:
    """One row: the score at place (n + 1) div 2 from the top, as the top-half eligibility takes it."""
    counted = rows.where("bridge_score is not null").groupBy("bridge_score").agg(F.count(F.lit(1)).alias("ties"))
    n = counted.agg(F.sum("ties").alias("n"))
    placed = before(counted, [], [F.desc("bridge_score")], {"above": F.col("ties")}).crossJoin(F.broadcast(n))  # one row
    return placed.where(F.col("above") + F.col("ties") >= F.greatest(F.lit(1), F.floor((F.col("n") + 1) / 2))).agg(F.max("bridge_score").alias("cutoff"))


def eligibility(rows: DataFrame, k: int = 15, cross_min: float = 0.40, excluded_ids: tuple[int, ...] = ()) -> DataFrame:
    """Adds ``eligible`` (enough neighbours, upper half of the scores, cross share) for every work."""
    ok = (F.coalesce("n", F.lit(0)) >= k) & (F.col("bridge_score") >= F.col("cutoff")) & (F.col("cross_share") >= cross_min)
    if excluded_ids:
        ok = ok & ~F.col("work_id").isin(*excluded_ids)
    return rows.crossJoin(F.broadcast(top_half_cutoff(rows))).withColumn("eligible", F.coalesce(ok, F.lit(False))).drop("cutoff")


def top_percent_cutoff(rows: DataFrame, percents: tuple[float, ...]) -> DataFrame:
    """One row with a column p<percent> for each: the score at place max(1, n x percent) from the top, half to even."""
    counted = rows.where("bridge_score is not null").groupBy("bridge_score").agg(F.count(F.lit(1)).alias("ties"))
    n = counted.agg(F.sum("ties").alias("n"))
    placed = before(counted, [], [F.desc("bridge_score")], {"above": F.col("ties")}).crossJoin(F.broadcast(n))
    place = lambda p: F.greatest(F.lit(1), F.bround(F.col("n") * F.lit(p)).cast("long"))
    return placed.agg(*[F.max(F.when(F.col("above") + F.col("ties") >= place(p), F.col("bridge_score"))).alias(f"p{round(100 * p)}") for p in percents])


#: The variants of the sensitivity grid, with the condition of each.
VARIANTS = (
    ("existing_bridge_eligible", "eligible"),
    ("bridge_score_top_75pct", "bridge_score >= p75"), ("bridge_score_top_50pct", "bridge_score >= p50"), ("bridge_score_top_25pct", "bridge_score >= p25"),
    ("distinct_neighbor_clusters_gte_2", "distinct_clusters >= 2"), ("distinct_neighbor_clusters_gte_3", "distinct_clusters >= 3"),
    ("same_cluster_share_lte_0_75", "same_share <= 0.75"), ("same_cluster_share_lte_0_6", "same_share <= 0.6"), ("same_cluster_share_lte_0_5", "same_share <= 0.5"),
    ("cross_cluster_share_gte_0_25", "cross_share >= 0.25"), ("cross_cluster_share_gte_0_4", "cross_share >= 0.4"), ("cross_cluster_share_gte_0_5", "cross_share >= 0.5"),
    ("top50_and_cross_cluster_gte_0_40", "bridge_score >= p50 AND cross_share >= 0.4"), ("top50_and_same_cluster_lte_0_60", "bridge_score >= p50 AND same_share <= 0.6"),
    ("top25_and_cross_cluster_gte_0_40", "bridge_score >= p25 AND cross_share >= 0.4"),
)


def sensitivity(rows: DataFrame, emerging: DataFrame, k: int = 20) -> DataFrame:
    """For each variant: eligible works, head size, overlap of its head with the emerging head, and verdicts.

    ``rows`` are those of ``eligibility``, ``emerging`` has work_id and score. The grid is a small
    table; works are compared to it once. A variant without a work has no row.
    """
    rows = stored(rows, "bridge-rows")
    cut = rows.crossJoin(F.broadcast(top_percent_cutoff(rows, (0.75, 0.50, 0.25))))
    tests = F.array(*[F.when(F.expr(condition), F.lit(v)) for v, condition in VARIANTS])
    each = cut.select("work_id", "bridge_score", F.explode(F.array_compact(tests)).alias("variant"))
    size = each.groupBy("variant").agg(F.count(F.lit(1)).alias("eligible_total"), F.round(F.median("bridge_score"), 6).alias("median_bridge_score"))
    best = F.array_sort(F.collect_list(F.struct((-F.col("bridge_score")).alias("s"), "work_id")))
    # the best k of each part of the table, and then of these
    part = F.row_number().over(W.partitionBy("variant", F.pmod(F.xxhash64("work_id"), F.lit(64))).orderBy(F.desc("bridge_score"), "work_id"))
    heads = each.withColumn("nth", part).where(F.col("nth") <= k).groupBy("variant").agg(F.transform(F.slice(best, 1, k), lambda x: x["work_id"]).alias("head"))
    full = head_ids(rows, "bridge_score", "work_id", k).withColumnRenamed("ids", "full")
    other = head_ids(emerging, "score", "work_id", k).withColumnRenamed("ids", "emerging")
    o = size.join(heads, "variant").crossJoin(F.broadcast(full)).crossJoin(F.broadcast(other))
    with_emerging, base = overlap(F.col("head"), F.col("emerging")), overlap(F.col("full"), F.col("emerging"))
    delta = F.round(base["jaccard"] - with_emerging["jaccard"], 6)
    enough = (F.size("head") >= k) & (F.col("eligible_total") >= max(30, 2 * k))
    return o.select(
        "variant", "eligible_total", F.size("head").alias("head_size"), overlap(F.col("full"), F.col("head"))["jaccard"].alias("vs_full_jaccard"), with_emerging["jaccard"].alias("vs_emerging_jaccard"),
        with_emerging["shared"].alias("vs_emerging_shared"), delta.alias("delta"), "median_bridge_score", (delta >= 0.10).alias("improves"), ((delta >= 0.10) & enough).alias("candidate"),
    )


def residual_head(rows: DataFrame, emerging: DataFrame, penalty: float, k: int = 20) -> DataFrame:
    """The first k works by bridge score less ``penalty`` times the emerging score."""
    both = rows.join(emerging.select("work_id", F.col("score").alias("other")), "work_id", "left")
    objective = F.round(F.col("bridge_score") - penalty * F.coalesce("other", F.lit(0.0)), 5)
    return both.withColumn("objective", objective).where("objective is not null").orderBy(F.desc("objective"), "work_id").limit(k).select("work_id", "objective")


#: Penalties of the redesign simulation.
PENALTIES = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)


def redesign(rows: DataFrame, emerging: DataFrame, penalties: tuple[float, ...] = PENALTIES, k: int = 20) -> DataFrame:
    """For each penalty, over all works and over eligible ones: the head by bridge score less penalty times emerging score.

    All objectives are scored in one pass; a limit on places keeps k rows of each in every task before the shuffle.
    Says how much of the head the emerging head and the unpenalised head share, its mean scores, and whether the
    mean emerging score falls (or stays) as the penalty grows, as it must.
    """
    both = rows.select("work_id", "bridge_score", "eligible").where("bridge_score is not null").join(emerging.select("work_id", F.coalesce("score", F.lit(0.0)).alias("other")), "work_id", "left").fillna(0.0, ["other"])
    pools = F.array(F.lit("all"), F.when(F.col("eligible"), F.lit("eligible")))
    each = both.withColumn("pool", F.explode(F.array_compact(pools))).withColumn("penalty", F.explode(F.array(*[F.lit(p) for p in penalties])))
    each = each.withColumn("objective", F.round(F.col("bridge_score") - F.col("penalty") * F.col("other"), 5))
    nth = F.row_number().over(W.partitionBy("pool", "penalty").orderBy(F.desc("objective"), "work_id"))
    heads = each.withColumn("nth", nth).where(F.col("nth") <= k).groupBy("pool", "penalty")
    heads = heads.agg(F.array_sort(F.collect_list("work_id")).alias("ids"), F.round(F.avg("bridge_score"), 5).alias("mean_bridge"), F.round(F.avg("other"), 5).alias("mean_emerging"), F.round(F.min("objective"), 5).alias("least_objective"))
    heads = stored(heads, "heads")  # a row for each pool and penalty
    plain = heads.where(F.col("penalty") == min(penalties)).select("pool", F.col("ids").alias("plain"))
    other = head_ids(emerging, "score", "work_id", k).withColumnRenamed("ids", "emerging")
    met = heads.join(plain, "pool").crossJoin(F.broadcast(other))  # one row
    fell = F.col("mean_emerging") <= F.lag("mean_emerging").over(W.partitionBy("pool").orderBy("penalty"))
    return met.select(
        "pool", "penalty", F.size("ids").alias("head_size"), overlap(F.col("ids"), F.col("emerging"))["jaccard"].alias("vs_emerging_jaccard"), overlap(F.col("ids"), F.col("plain"))["jaccard"].alias("vs_plain_jaccard"),
        "mean_bridge", "mean_emerging", "least_objective", F.coalesce(fell, F.lit(True)).alias("monotone"),
    )


#: Variants of the grid that tighten one condition step by step, loosest first.
LADDERS = {
    "top_percent": ("bridge_score_top_75pct", "bridge_score_top_50pct", "bridge_score_top_25pct"),
    "distinct_clusters": ("distinct_neighbor_clusters_gte_2", "distinct_neighbor_clusters_gte_3"),
    "same_share": ("same_cluster_share_lte_0_75", "same_cluster_share_lte_0_6", "same_cluster_share_lte_0_5"),
    "cross_share": ("cross_cluster_share_gte_0_25", "cross_cluster_share_gte_0_4", "cross_cluster_share_gte_0_5"),
}


def failure_analysis(grid: DataFrame) -> DataFrame:
    """For each ladder of the sensitivity grid: whether tightening it leaves fewer works, and moves the head away from the emerging one.

    ``grid`` has a row for each variant. A variant without a work has none: its step is skipped and ``steps`` counts those there are.
    """
    steps = [F.struct(F.lit(name).alias("ladder"), F.lit(i).alias("step"), F.lit(v).alias("variant")) for name, variants in LADDERS.items() for i, v in enumerate(variants)]
    place = F.explode(F.filter(F.array(*steps), lambda s: s["variant"] == F.col("variant"))).alias("s")
    each = grid.select("eligible_total", "vs_emerging_jaccard", "candidate", place).select("s.ladder", "s.step", "eligible_total", "vs_emerging_jaccard", "candidate")
    before_it = W.partitionBy("ladder").orderBy("step")
    fewer = F.coalesce(F.col("eligible_total") <= F.lag("eligible_total").over(before_it), F.lit(True))
    away = F.coalesce(F.col("vs_emerging_jaccard") <= F.lag("vs_emerging_jaccard").over(before_it), F.lit(True))
    marked = each.withColumn("fewer", fewer).withColumn("away", away)
    return marked.groupBy("ladder").agg(F.count(F.lit(1)).alias("steps"), F.bool_and("fewer").alias("works_monotone"), F.bool_and("away").alias("jaccard_monotone"), F.bool_or("candidate").alias("any_candidate"), F.min("vs_emerging_jaccard").alias("least_jaccard"))


def churn(old: DataFrame, new: DataFrame, k: int) -> DataFrame:
    """How the head changes between two ranked runs (work_id, rank): entering, dropped and moved works."""
    a = old.where(F.col("rank") <= k).select("work_id", F.col("rank").alias("old_rank"))
    b = new.where(F.col("rank") <= k).select("work_id", F.col("rank").alias("new_rank"))
    change = F.when(F.col("old_rank").isNull(), "entering").when(F.col("new_rank").isNull(), "dropped").otherwise("shared")
    return a.join(b, "work_id", "full_outer").select("work_id", "old_rank", "new_rank", change.alias("change"), (F.col("old_rank") - F.col("new_rank")).alias("gain"))


CHURN_SQL = """
, a AS (SELECT work_id, CAST(row_number() OVER (ORDER BY citation_count DESC, work_id) AS INTEGER) AS old_rank FROM included QUALIFY old_rank <= 200),
b AS (SELECT work_id, CAST(row_number() OVER (ORDER BY year DESC, citation_count DESC, work_id) AS INTEGER) AS new_rank FROM included QUALIFY new_rank <= 200)
SELECT work_id, old_rank, new_rank, CASE WHEN old_rank IS NULL THEN 'entering' WHEN new_rank IS NULL THEN 'dropped' ELSE 'shared' END AS change, old_rank - new_rank AS gain
FROM a FULL OUTER JOIN b USING (work_id)"""

BRIDGE_CTE = """
WITH e AS (SELECT vec_id AS work_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM embeddings),
c AS (SELECT label AS cl, i, avg(x) AS m FROM e GROUP BY label, i),
d AS (SELECT work_id, label, cl, sum((x - m) * (x - m)) AS d FROM e JOIN c USING (i) GROUP BY work_id, label, cl),
bs AS (SELECT work_id, round(greatest(0.0, least(1.0, min(d) FILTER (WHERE cl = label) / greatest(min(d) FILTER (WHERE cl <> label), 1e-12))), 6) AS bridge_score FROM d GROUP BY work_id),
p AS (SELECT a.vec_id AS work_id, b.label, a.label = b.label AS same, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS nth
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
mix AS (SELECT work_id, count(*) AS n, avg(same::INT::DOUBLE) AS same_share, 1 - avg(same::INT::DOUBLE) AS cross_share, count(DISTINCT label) AS distinct_clusters FROM p WHERE nth <= 15 GROUP BY work_id),
rows_ AS (SELECT * FROM bs LEFT JOIN mix USING (work_id)),
em AS (SELECT vec_id AS work_id, (vec_id * 37 % 101) / 101.0::DOUBLE AS score FROM embeddings)"""
ELIGIBILITY_SQL = BRIDGE_CTE + """
, cut AS (SELECT bridge_score AS cutoff FROM (SELECT bridge_score, row_number() OVER (ORDER BY bridge_score DESC) AS rn, count(*) OVER () AS n FROM rows_ WHERE bridge_score IS NOT NULL) WHERE rn = greatest(1, (n + 1) // 2))
SELECT work_id, bridge_score, round(cross_share, 6) AS cross_share, coalesce(n >= 15 AND bridge_score >= cutoff AND cross_share >= 0.4, false) AS eligible FROM rows_, cut"""
RESIDUAL_SQL = BRIDGE_CTE + " SELECT work_id, round(bridge_score - 0.5 * score, 5) AS objective FROM rows_ JOIN em USING (work_id) ORDER BY objective DESC, work_id LIMIT 20"
_CASES = " ".join(f"WHEN '{v}' THEN {c}" for v, c in VARIANTS)
SENSITIVITY_SQL = BRIDGE_CTE + f"""
, ranked AS (SELECT bridge_score, row_number() OVER (ORDER BY bridge_score DESC) AS rn, count(*) OVER () AS n FROM rows_ WHERE bridge_score IS NOT NULL),
cuts AS (SELECT max(bridge_score) FILTER (WHERE rn = greatest(1, round_even(n * 0.75, 0))) AS p75, max(bridge_score) FILTER (WHERE rn = greatest(1, round_even(n * 0.5, 0))) AS p50,
  max(bridge_score) FILTER (WHERE rn = greatest(1, round_even(n * 0.25, 0))) AS p25, max(bridge_score) FILTER (WHERE rn = greatest(1, (n + 1) // 2)) AS half FROM ranked),
marked AS (SELECT *, coalesce(n >= 15 AND bridge_score >= half AND cross_share >= 0.4, false) AS eligible FROM rows_, cuts),
v AS (SELECT * FROM (VALUES {', '.join(f"('{v}')" for v, _ in VARIANTS)}) t(variant)),
each_ AS (SELECT variant, work_id, bridge_score, row_number() OVER (PARTITION BY variant ORDER BY bridge_score DESC, work_id) AS nth FROM v, marked WHERE CASE variant {_CASES} END),
"""+"""f AS (SELECT list(work_id) AS l FROM (SELECT work_id FROM rows_ ORDER BY bridge_score DESC, work_id LIMIT 20)),
g AS (SELECT list(work_id) AS l FROM (SELECT work_id FROM em ORDER BY score DESC, work_id LIMIT 20)),
h AS (SELECT variant, count(*) AS eligible_total, round(median(bridge_score), 6) AS median_bridge_score, list(work_id) FILTER (WHERE nth <= 20) AS head FROM each_ GROUP BY variant),
j AS (SELECT h.*, len(list_intersect(head, f.l)) AS hf, len(list_intersect(head, g.l)) AS hg, len(list_intersect(f.l, g.l)) AS fg, len(f.l) AS nf, len(g.l) AS ng, len(head) AS nh FROM h, f, g),
k AS (SELECT *, round(hf / (nh + nf - hf)::DOUBLE, 6) AS jf, round(hg / (nh + ng - hg)::DOUBLE, 6) AS jg, round(fg / (nf + ng - fg)::DOUBLE, 6) AS jb FROM j)
SELECT variant, eligible_total, CAST(nh AS INTEGER) AS head_size, jf AS vs_full_jaccard, jg AS vs_emerging_jaccard, CAST(hg AS INTEGER) AS vs_emerging_shared, round(jb - jg, 6) AS delta, median_bridge_score,
  round(jb - jg, 6) >= 0.1 AS improves, round(jb - jg, 6) >= 0.1 AND nh >= 20 AND eligible_total >= 40 AS candidate FROM k"""

_LADDER_ROWS = ", ".join(f"('{name}', {i}, '{v}')" for name, variants in LADDERS.items() for i, v in enumerate(variants))
FAILURE_SQL = f"""
SELECT ladder, count(*) AS steps, bool_and(fewer) AS works_monotone, bool_and(away) AS jaccard_monotone, bool_or(candidate) AS any_candidate, min(vs_emerging_jaccard) AS least_jaccard
FROM (SELECT ladder, candidate, vs_emerging_jaccard, coalesce(eligible_total <= lag(eligible_total) OVER w, true) AS fewer, coalesce(vs_emerging_jaccard <= lag(vs_emerging_jaccard) OVER w, true) AS away
  FROM ({SENSITIVITY_SQL}) s JOIN (VALUES {_LADDER_ROWS}) l(ladder, step, variant) USING (variant) WINDOW w AS (PARTITION BY ladder ORDER BY step)) GROUP BY ladder"""
REDESIGN_SQL = BRIDGE_CTE + f"""
, cut AS (SELECT bridge_score AS cutoff FROM (SELECT bridge_score, row_number() OVER (ORDER BY bridge_score DESC) AS rn, count(*) OVER () AS n FROM rows_ WHERE bridge_score IS NOT NULL) WHERE rn = greatest(1, (n + 1) // 2)),
o AS (SELECT pool, penalty, work_id, bridge_score, score, round(bridge_score - penalty * score, 5) AS objective FROM rows_ JOIN em USING (work_id), cut, (VALUES {', '.join(f'({p}::DOUBLE)' for p in PENALTIES)}) l(penalty), (VALUES ('all'), ('eligible')) q(pool)
  WHERE pool = 'all' OR coalesce(n >= 15 AND bridge_score >= cutoff AND cross_share >= 0.4, false)),
t AS (SELECT *, row_number() OVER (PARTITION BY pool, penalty ORDER BY objective DESC, work_id) AS nth FROM o QUALIFY nth <= 20),
u AS (SELECT pool, penalty, list(work_id) AS ids, round(avg(bridge_score), 5) AS mean_bridge, round(avg(score), 5) AS mean_emerging, round(min(objective), 5) AS least_objective FROM t GROUP BY pool, penalty),
g AS (SELECT list(work_id) AS l FROM (SELECT work_id FROM em ORDER BY score DESC, work_id LIMIT 20)),
j AS (SELECT u.*, len(list_intersect(u.ids, g.l)) AS a, len(g.l) AS na, len(list_intersect(u.ids, p.ids)) AS b, len(p.ids) AS nb, len(u.ids) AS n FROM u JOIN u p ON p.pool = u.pool AND p.penalty = 0, g)
SELECT pool, penalty, CAST(n AS INTEGER) AS head_size, round(a / (n + na - a)::DOUBLE, 6) AS vs_emerging_jaccard, round(b / (n + nb - b)::DOUBLE, 6) AS vs_plain_jaccard, mean_bridge, mean_emerging, least_objective,
  coalesce(mean_emerging <= lag(mean_emerging) OVER (PARTITION BY pool ORDER BY penalty), true) AS monotone FROM j"""
