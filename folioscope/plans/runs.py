"""Versioned runs: a log of what started and how it ended, and results in partitions of their run."""

from __future__ import annotations

import json
from dataclasses import asdict
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.operators.bridges import bridge_rows, eligibility
from folioscope.operators.neighbors import kmeans, slice_fit
from folioscope.plans.ranking import family_weights, paper_scores
from folioscope.sources.corpus import Corpus
from folioscope.sources.upsert import latest, replace_partitions

LOG_DDL = "run_id string, kind string, version string, status string, at timestamp, config string, counts string, error string"
STATES = ("running", "succeeded", "failed")


class RunStore:
    """Run log and results under one folder. The log only grows; a run's state is its last entry."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _append(self, run_id: str, kind: str, version: str, status: str, config: dict | None = None, counts: dict | None = None, error: str | None = None) -> None:
        if status not in STATES:
            raise ValueError(f"unknown state {status}")
        row = (run_id, kind, version, status, datetime.now(UTC).replace(tzinfo=None), json.dumps(config, sort_keys=True) if config is not None else None, json.dumps(counts, sort_keys=True) if counts is not None else None, error)
        self.spark.createDataFrame([row], LOG_DDL).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def runs(self) -> DataFrame:
        """The last state of each run, with its configuration."""
        log = self.spark.read.schema(LOG_DDL).parquet(f"{self.path}/log")
        config = log.where("config is not null").groupBy("run_id").agg(F.first("config").alias("run_config"))
        return latest(log, ["run_id"], "at").join(config, "run_id", "left").withColumn("config", F.col("run_config")).drop("run_config")

    def newest(self, kind: str, version: str | None = None) -> str | None:
        """Id of the newest succeeded run of a kind (and version); ties by the larger id."""
        done = self.runs().where((F.col("kind") == kind) & (F.col("status") == "succeeded"))
        if version is not None:
            done = done.where(F.col("version") == version)
        row = done.orderBy(F.desc("at"), F.desc("run_id")).select("run_id").first()
        return row[0] if row else None

    def results(self, kind: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{kind}")

    def execute(self, run_id: str, kind: str, version: str, config: dict, make, by: list[str] = ()) -> dict:
        """Log the start, write what ``make()`` returns into the run's partitions, count it, and log the end.

        Results are complete before the run counts as succeeded; an error is logged and raised again.
        """
        self._append(run_id, kind, version, "running", config)
        try:
            df = make().withColumn("run_id", F.lit(run_id))
            replace_partitions(df, f"{self.path}/{kind}", ["run_id", *by])
            stored = self.results(kind).where(F.col("run_id") == run_id)
            groups = stored.groupBy(*by).count().collect() if by else []
            counts = {"rows": stored.count()} | {"_".join(str(r[c]) for c in by): r["count"] for r in groups}
        except Exception as e:
            self._append(run_id, kind, version, "failed", error=str(e)[:500])
            raise
        self._append(run_id, kind, version, "succeeded", counts=counts)
        return counts


def ranking_config(bridge_weight: float, semantic: bool, clustered: bool, min_year: int, max_citations: int) -> dict:
    """What a ranking run records about itself."""
    return {
        "family_weights": {f: asdict(w) for f, w in family_weights(bridge_weight, semantic).items()},
        "bridge_policy": "cluster_boundary_ratio_v0" if clustered else "null_until_clusters_or_neighbor_features",
        "semantic_policy": "emerging_slice_centroid_cosine_v1" if semantic else "null_until_embeddings",
        "undercited_pool": {"min_year": min_year, "max_citations": max_citations},
        "recent_topic_year_window": 2,
    }


def ranking_run(store: RunStore, c: Corpus, run_id: str, version: str, clustered: bool = False, semantic: bool = False, bridge_weight: float = 0.0, min_year: int = 1999, max_citations: int = 30) -> dict:
    """Scores of all families, stored by run and family; with clusters also the bridge signal and eligibility."""

    def make() -> DataFrame:
        bridge = fit = None
        if clustered:
            bridge = eligibility(bridge_rows(c.vectors)).select("work_id", "bridge_score", F.col("eligible").alias("bridge_eligible"))
        if semantic:
            fit = slice_fit(c.vectors).select("work_id", F.col("fit").alias("semantic_score"))
        return paper_scores(c, bridge, fit, bridge_weight)

    return store.execute(run_id, "scores", version, ranking_config(bridge_weight, semantic, clustered, min_year, max_citations), make, ["family"])


def clustering_run(store: RunStore, vectors: DataFrame, run_id: str, version: str, k: int = 12) -> dict:
    """k-means labels of all vectors, stored by run."""
    return store.execute(run_id, "clusters", version, {"algorithm": "kmeans-l2-v0", "k": k}, lambda: kmeans(vectors, k))


def served(store: RunStore, family: str, limit: int, version: str | None = None) -> DataFrame:
    """The head of a family in the newest succeeded run; LookupError without one. Reads that partition only."""
    run = store.newest("scores", version)
    if run is None:
        raise LookupError("no succeeded run")
    head = store.results("scores").where((F.col("run_id") == run) & (F.col("family") == family)).orderBy(F.desc("final_score"), "work_id").limit(limit)
    return head.withColumn("rank", F.row_number().over(W.orderBy(F.desc("final_score"), "work_id")))
