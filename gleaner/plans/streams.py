"""Streams that run to their end over the given files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import frontier as P
from ..operators.graph import shared_path
from ..session import table
from ..streaming import replay as R
from . import query
from .votes import _LEV, label, pseudo


def _score(links: DataFrame) -> DataFrame:
    a = links.withColumnRenamed("anchor_text", "anchor")
    r = a.select("parent_url", "url", pseudo("w", "page_id").alias("node_weight"), P.relevance(label("u", "url"), pseudo("up", "url"), label("a", "anchor", "url"), pseudo("ap", "anchor", "url")).alias("v"))
    return r.where("v is not null").select("parent_url", "url", "node_weight", "v.label", "v.prob")


@query(f"WITH {_LEV.replace('WHERE label IS NOT NULL', 'WHERE label IS NOT NULL AND url NOT IN (SELECT url FROM pages)')} SELECT url, level, priority FROM lev")
def stream_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages replayed as a stream; the frontier that is left."""
    out = shared_path(spark, "stream")
    R.crawl(R.pages(spark, f"{sf_dir}/pages.parquet*"), _score, out, f"{out}/checkpoint").awaitTermination()
    return R.frontier(spark, out).select("url", "level", F.round("priority", 9).alias("priority"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows that streaming.replay.windows keeps, over the whole table at once."""
    w = R.windows(table(spark, sf_dir, "events"))
    return w.select(F.date_format("start", "yyyy-MM-dd").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
