"""Crawls as streams: pages arrive as files, links go to tables, the next URLs come from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import frontier as P
from ..operators import links as L

PAGE = "page_id long, url string, html string"
LINK = "url string, parent_url string, node_weight double, label string, prob double"


def pages(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """Page files as a stream, `files` to a batch: the pace. What is done is known by the query's checkpoint."""
    return spark.readStream.schema(PAGE).option("maxFilesPerTrigger", files).parquet(path)


def crawl(stream: DataFrame, score, out: str, checkpoint: str, limit: int | None = None) -> StreamingQuery:
    """Each batch appends its pages' URLs to out/visited and its links, scored by `score` (links -> LINK), to out/links, in a
    folder for each batch that a repeated batch overwrites. With a limit, pages of greater numbers are left out."""

    def batch(df: DataFrame, n: int) -> None:
        p = df if limit is None else df.where(F.col("page_id") <= limit)
        p.select("url").write.mode("overwrite").parquet(f"{out}/visited/batch={n}")
        score(L.extract(p)).select("url", "parent_url", "node_weight", "label", "prob").write.mode("overwrite").parquet(f"{out}/links/batch={n}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def frontier(spark: SparkSession, out: str) -> DataFrame:
    """The frontier of what crawl() has written: links to pages that weren't visited."""
    links = spark.read.schema(LINK + ", batch int").parquet(f"{out}/links")
    visited = spark.read.parquet(f"{out}/visited").select("url").distinct()
    return P.levels(P.upsert(links.join(visited, "url", "left_anti")))


def unique(stream: DataFrame, key: str = "url", time: str = "ts", late: str = "1 hour") -> DataFrame:
    """First of equal keys within the watermark; state is bounded by it."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windows(events: DataFrame, time: str = "ts", size: str = "1 day", late: str = "1 hour", value: str = "value", by: str = "event_type") -> DataFrame:
    """Counts and sums by tumbling window; time must be an instant."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")
