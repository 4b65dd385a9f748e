"""Files of pages, corpora, dictionaries, graphs and features."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty


@F.pandas_udf(Ty.StringType())
def _by_name(raw: pd.Series, encoding: pd.Series) -> pd.Series:
    """Bytes by the encoding named, else UTF-8, else GBK, else null: the JVM's function knows neither."""

    def one(b: bytes | None, name: str | None) -> str | None:
        for e in (name, "utf-8", "gb2312", "gbk") if b is not None else ():
            try:
                return bytes(b).decode(e or "gbk")
            except (LookupError, UnicodeDecodeError):
                pass

    return pd.Series([one(b, e) for b, e in zip(raw, encoding)], dtype=object)


def decode(raw: Column, encoding: Column | None = None) -> Column:
    """Bytes as text: by the encoding named, if one is, else UTF-8 if they are, else GBK (which holds GB2312), else null. What
    is UTF-8 and names nothing else stays in the JVM."""
    named = F.lit(None).cast("string") if encoding is None else encoding
    plain = F.is_valid_utf8(raw.cast("string")) & F.coalesce(F.lower(named).isin("utf-8", "utf8", "ascii", "us-ascii"), F.lit(True))
    return F.when(plain, raw.cast("string")).otherwise(_by_name(F.when(~plain, raw), named))


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files, by the ladder of encodings."""
    return read_bytes(spark, path).select("path", decode(F.col("content")).alias("text"))


def read_pages(spark: SparkSession, path: str, done: DataFrame | None = None) -> DataFrame:
    """(path, number, url, html) of page files: first line URL, rest HTML; number is that of the file's name. Files in done (path) are skipped."""
    p = read_text(spark, path)
    if done is not None:
        p = p.join(done.select("path"), "path", "left_anti")
    parts = F.split("text", "\n", 2)
    return p.select("path", F.regexp_extract("path", r"([0-9]+)[^/]*$", 1).try_cast("long").alias("number"), parts[0].alias("url"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("html"))


def write_pages(pages: DataFrame, path: str) -> None:
    """A row's file form as one JSON-free record: URL line and HTML, parted by a NUL for many pages to a file."""
    pages.select(F.concat_ws("\n", "url", "html").alias("value")).write.mode("overwrite").option("lineSep", "\0").text(path)


def read_packed_pages(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split("value", "\n", 2)
    return spark.read.option("lineSep", "\0").text(path).select(parts[0].alias("url"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("html"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(label, text) of tab-separated lines; lines of fewer fields are left out."""
    parts = F.split("value", "\t", 2)
    return spark.read.text(path).where(F.size(parts) == 2).select(parts[0].alias("label"), parts[1].alias("text"))


def write_corpus(corpus: DataFrame, path: str, mode: str = "overwrite") -> None:
    clean = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[\t\r\n]+", " ")
    corpus.select(F.concat_ws("\t", F.col("label").cast("string"), clean(F.col("text"))).alias("value")).write.mode(mode).text(path)


def corpus_round_trip(corpus: DataFrame) -> DataFrame:
    """corpus (label, text) written to the shared folder as lines and read back."""
    from ..operators.graph import shared_path

    path = shared_path(corpus.sparkSession, "corpus")
    write_corpus(corpus, path)
    return read_corpus(corpus.sparkSession, path)


def write_lines(values: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One column as lines."""
    values.toDF("value").select(F.col("value").cast("string")).write.mode(mode).text(path)


DOCUMENT = "title string, meta string, url string, div string"


def write_documents(docs: DataFrame, path: str) -> None:
    docs.select("title", "meta", "url", "div").write.mode("overwrite").json(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DOCUMENT).json(path)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("term")).where("term <> ''").distinct()


def read_graph(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """lines (value): two tab-separated fields are a node's weight, three an edge's -> nodes (nid, weight), edges (src, dst, weight). Any number of lines."""
    f = F.split("value", "\t")
    nodes = lines.where(F.size(f) == 2).select(f[0].alias("nid"), f[1].try_cast("double").alias("weight"))
    edges = lines.where(F.size(f) == 3).select(f[0].alias("src"), f[1].alias("dst"), f[2].try_cast("double").alias("weight"))
    return nodes, edges


def read_seeds(lines: DataFrame) -> DataFrame:
    """(line, nid) of lines (line, value) of node ids parted by blanks."""
    return lines.select("line", F.explode(F.split(F.trim("value"), " +")).alias("nid")).where("nid <> ''")


def libsvm_line(label: Column, pairs: Column) -> Column:
    """'label id:value ...' of an array of (id, value), ids rising."""
    return F.concat_ws(" ", label.cast("string"), F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(p["id"].cast("string"), F.lit(":"), p["value"].cast("string"))), " "))


def write_libsvm(features: DataFrame, path: str) -> None:
    """features (doc_id, label, id, value) with numeric labels."""
    features.groupBy("doc_id", "label").agg(libsvm_line(F.col("label"), F.collect_list(F.struct("id", "value"))).alias("value")).select("value").write.mode("overwrite").text(path)


def read_libsvm(spark: SparkSession, path: str, features: int | None = None) -> DataFrame:
    r = spark.read.format("libsvm")
    return (r.option("numFeatures", features) if features else r).load(path)


LINKS = Ty.StructType([Ty.StructField(n, t) for n, t in (("count", Ty.LongType()), ("parent_url", Ty.StringType()), ("url", Ty.StringType()), ("anchor_text", Ty.StringType()), ("label", Ty.StringType()), ("precision", Ty.DoubleType()))])


def append_links(links: DataFrame, path: str) -> None:
    """Scored links as tab-separated lines, scores with three places."""
    links.select("count", "parent_url", "url", "anchor_text", "label", F.format_string("%.3f", "precision").alias("precision")).write.mode("append").option("sep", "\t").csv(path)


def read_links(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LINKS).option("sep", "\t").csv(path)


def from_database(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A query of a database with a JDBC driver on the class path, split over tasks if options name partition bounds."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def create_tables(spark: SparkSession) -> None:
    spark.sql("CREATE TABLE IF NOT EXISTS raw_pages (row_id BIGINT, base_url STRING, raw_content STRING, time TIMESTAMP) USING parquet")
    spark.sql("CREATE TABLE IF NOT EXISTS seed_urls (row_id BIGINT, url STRING, description STRING, catagory INT) USING parquet")


def insert(rows: DataFrame, name: str) -> None:
    rows.write.mode("append").insertInto(name)


def clear(spark: SparkSession, *names: str) -> None:
    for n in names:
        spark.sql(f"TRUNCATE TABLE {n}")


def drop(spark: SparkSession, *names: str) -> None:
    for n in names:
        spark.sql(f"DROP TABLE IF EXISTS {n}")
