"""Page trees: nodes, titles, density, records. No SQL builds trees; tests hold these against small trees worked by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as T
from ..functions.stem import breaker, stems
from ..functions import urls as U
from ..operators import density as C
from ..operators import dom as D
from ..operators import evaluate as E
from ..operators import records as W
from ..session import table
from . import query


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def _dom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built once where more than one step reads it."""
    from ..operators.graph import checkpointed

    return checkpointed(D.nodes(_pages(spark, sf_dir)))


@query()
def dom_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.nodes(_pages(spark, sf_dir))


@query()
def dom_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.paths(_pages(spark, sf_dir))


@query()
def dom_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _dom(spark, sf_dir)
    return D.flags(d).join(D.structure(_pages(spark, sf_dir)).drop("xpath"), ["page_id", "node_id"]).join(D.own_text(d), ["page_id", "node_id"]).drop("attrs")


@query()
def title_node_lcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.title_nodes(_dom(spark, sf_dir))


@query()
def neighbour_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.neighbour_text(_dom(spark, sf_dir))


@query()
def node_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.marked(_pages(spark, sf_dir))


@query()
def article_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.article(_pages(spark, sf_dir))


for _v in W.VARIANTS:
    query(name=f"record_clusters_{_v}")(lambda spark, sf_dir, _v=_v: W.measured(_pages(spark, sf_dir), _v))


@query()
def article_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.article(_pages(spark, sf_dir))


@query()
def page_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.documents(_pages(spark, sf_dir))


@query()
def page_documents_no_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.documents(_pages(spark, sf_dir), skip_hubs=True)


@query()
def extraction_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three extractors side by side."""
    return W.compared(_pages(spark, sf_dir))


@query()
def lcs_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted articles against the text of <article>."""
    gold = T.words(H.strip_tags(F.regexp_extract(H.clean(F.col("html")), "(?s)<article>(.*?)</article>", 1)))
    got = C.article(_pages(spark, sf_dir).select("page_id", "html", gold.alias("gold")), ("gold",)).withColumn("candidate", T.words(F.col("para")))
    return E.lcs_score(got).select("page_id", "p", "r", "f1", "score")


@query()
def extraction_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the scores of the density extractor against the text of <article>."""
    p = _pages(spark, sf_dir)
    gold = p.select("page_id", H.strip_tags(F.regexp_extract(H.clean(F.col("html")), "(?s)<article>(.*?)</article>", 1)).alias("gold"))
    return E.checked(C.article(p), gold, T.words)


@query()
def record_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.links(_pages(spark, sf_dir))


# Densities and gaps over counts that a table has: lines of an order are the nodes of a page.
_NODES = "n AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity * 7 AS BIGINT) % 90 AS c, CAST(l_quantity AS BIGINT) % 4 AS t, CAST(l_quantity * 5 AS BIGINT) % 40 AS lc, CAST(l_linenumber AS BIGINT) % 3 AS lt, l_discount * 4 AS ratio FROM lineitem)"


@query(f"WITH {_NODES}, o AS (SELECT *, greatest(t, 1)::DOUBLE AS t1, greatest(lc, 1)::DOUBLE AS lc1, greatest(lt, 1)::DOUBLE AS lt1, greatest(c - lc, 1)::DOUBLE AS u FROM n) SELECT l_orderkey, l_linenumber, round(CASE WHEN c = 0 THEN 0.0 ELSE c / t1 * ln((c / lc1) * (t1 / lt1)) / ln(ln(c * lc1 / u + ratio * c + exp(1.0))) END, 6) AS density, round(CASE WHEN c > 0 AND ratio > 0 THEN coalesce(c * ln(c) / nullif(ln(ln(ratio * c + exp(1.0))), 0), 0.0) ELSE 0.0 END, 6) AS gap FROM o")
def density_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, n = F.col("l_quantity"), F.col("l_linenumber").cast("long")
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ((q * 7).cast("long") % 90).alias("c"), (q.cast("long") % 4).alias("t"), ((q * 5).cast("long") % 40).alias("lc"), (n % 3).alias("lt"), (F.col("l_discount") * 4).alias("ratio"))
    return t.select("l_orderkey", "l_linenumber", F.round(C.density(*(F.col(x) for x in ("c", "t", "lc", "lt", "ratio"))), 6).alias("density"), F.round(C.gap(F.col("c"), F.col("ratio")), 6).alias("gap"))


@query()
def porter_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(stems(T.words(F.col("text"))), " ").alias("stems"))


@query()
def url_word_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs' words parted by a dictionary file: the words of the pages' titles."""
    from ..operators.graph import shared_path
    from ..sources.files import read_dictionary, write_lines

    path, pages = shared_path(spark, "dictionary"), _pages(spark, sf_dir)
    write_lines(pages.select(F.explode(T.title_words(H.title(F.col("html"))))).distinct(), path)
    known = read_dictionary(spark, path).where(F.length("term") > 1)
    b = breaker(frozenset(r["term"] for r in known.toLocalIterator()))
    return pages.select("page_id", F.array_join(b(U.tokens(F.col("url"))), " ").alias("tokens"))
