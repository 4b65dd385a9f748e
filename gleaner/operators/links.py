"""Links of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import urls as U


def extract(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> (page_id, parent_url, href, url, anchor_text, neigb_text, label, prob, pos): the
    links of each cleaned (so lower-case) page, resolved and normalised, a URL once for each page (where it first stands).

    Short and fragment-only references are left out. Without a model, label is '1' and prob 0."""
    one = pages.select("page_id", F.col("url").alias("parent_url"), F.posexplode(H.anchors(H.clean(F.col("html")))).alias("pos", "a"))
    one = one.select("page_id", "parent_url", "pos", U.trim(F.col("a.href")).alias("href"), F.col("a.anchor").alias("anchor"))
    one = one.where((F.length("href") >= 2) & ~F.col("href").startswith("#")).withColumn("url", U.normalized(F.col("href"), F.col("parent_url")))
    # The first of equal ones by a pre-aggregated minimum, not by a window over a page's links.
    first = one.groupBy("page_id", "url").agg(F.min(F.struct("pos", "parent_url", "href", "anchor")).alias("f"))
    return first.select("page_id", "f.parent_url", "f.href", "url", H.normalize(H.unescape(H.strip_tags(F.col("f.anchor")))).alias("anchor_text"), F.lit("").alias("neigb_text"), F.lit("1").alias("label"), F.lit(0.0).alias("prob"), "f.pos")


def in_scope(links: DataFrame) -> DataFrame:
    return links.where(U.in_scope(F.col("href"), F.col("url"), F.col("parent_url")))


def unseen(links: DataFrame, visited: DataFrame) -> DataFrame:
    """links whose URL is not in visited (url): exact, whatever its size."""
    return links.join(visited.select("url").distinct(), "url", "left_anti")
