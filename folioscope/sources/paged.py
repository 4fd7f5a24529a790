"""A paged service as a Spark data source: one task for each source, which follows its cursor.

The fetcher is injected: ``fetch(source_slug, params, cursor)`` gives a page as a dict with ``meta``
(``next_cursor``) and ``results``. Cursors make the pages of a source a chain, so sources, not pages,
run side by side. A page goes from the task that fetched it straight into the plan; none passes
through the driver. A lost task asks for its source's pages again.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from folioscope.sources.files import PagePlan

Fetch = Callable[[str, dict, str], dict]
SCHEMA = "source_slug string, page_index int, page_cursor string, next_cursor string, works int, payload string, content_hash string"


def pages_of(source: str, params: dict, cursor: str, first: int, most: int | None, fetch: Fetch) -> Iterator[tuple]:
    """Pages from ``cursor`` on, until ``most`` of them, a page without a next cursor, or one without results.

    The page that ends the chain is given too. A cursor that comes back unchanged would never end: ValueError.
    """
    index = first
    while most is None or index - first < most:
        page = fetch(source, params, cursor)
        meta, results = page.get("meta"), page.get("results")
        after = meta.get("next_cursor") if isinstance(meta, dict) else None
        count = len(results) if isinstance(results, list) else 0
        payload = json.dumps(page, sort_keys=True, ensure_ascii=False)
        yield source, index, cursor, str(after) if after else None, count, payload, hashlib.sha256(payload.encode()).hexdigest()
        if not after or not count:
            return
        if str(after) == cursor:
            raise ValueError(f"{source}: the cursor does not move")
        cursor, index = str(after), index + 1


def read_paged(spark: SparkSession, plans: dict[str, PagePlan], fetch: Fetch, max_pages: int | None = None, watermarks: DataFrame | None = None) -> DataFrame:
    """Pages of every source (``SCHEMA``), lazily.

    ``watermarks`` (from ``cursors``) resume an earlier run: a source goes on at its cursor and page number,
    and one that had come to its end is left out. A source without a watermark starts anew.
    """
    at = {r["source_slug"]: (r["next_cursor"], r["pages"]) for r in watermarks.collect()} if watermarks is not None else {}
    starts = []
    for source, plan in sorted(plans.items()):
        cursor, first = at.get(source, (plan.cursor, 0))
        if cursor:
            starts.append((source, {**plan.filters, "per_page": plan.per_page, "sort": plan.sort}, cursor, first))

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            # no partition at all would be read as one without a value
            return [InputPartition(s) for s in starts] or [InputPartition(None)]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            if partition.value is not None:
                source, params, cursor, first = partition.value
                yield from pages_of(source, params, cursor, first, max_pages, fetch)

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return "paged_works"

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
            return Reader()

    spark.dataSource.register(Paged)
    return spark.read.format("paged_works").load()


def cursors(pages: DataFrame) -> DataFrame:
    """(source_slug, next_cursor, pages) for each source: where to go on, null at the end of a source.

    A last page without works ends its source, whatever cursor it names.
    """
    last = pages.groupBy("source_slug").agg(F.max_by(F.struct(F.when(F.col("works") > 0, F.col("next_cursor")).alias("next_cursor"), (F.col("page_index") + 1).alias("pages")), "page_index").alias("l"))
    return last.select("source_slug", "l.next_cursor", "l.pages")
