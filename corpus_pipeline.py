"""A training corpus from `documents`: clean texts, one of each group of near copies, nothing of the benchmark, no
personal data, and sources in their target proportions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import decontamination, mixing, pii, simhash, toxicity
from gleaner.llm.common import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those whose most toxic window scores 0.5 or more. Null and empty texts score as a window without
    words does; repeated rows, null ids and ties share one fate with their text; an empty table stays empty."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id; of rows that repeat an id all stay if that
    id does. Null, empty and wordless texts are one group; rows without an id stay; an empty table stays empty."""
    return simhash.deduplicated(docs)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the rows whose text holds half of a benchmark item or more. It goes by rows: another row of the same
    id stays if its own text is clean, and a row without an id goes if its text isn't. Null and empty texts stay."""
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with personal data in their texts replaced by its kind; n_chars follows the text. Null and empty texts stay as
    they are, and so does every other column of every row."""
    return pii.redacted(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each piece of a text that a shard drew, with that piece as its text, as often as it was drawn.

    Sources stand in their target proportions; rows lie by shard, in a shuffled order within it. Texts without words
    yield no rows; null sources are one source; an empty table yields none. Long texts are cut where blocks end."""
    return mixing.shards_of(docs, keep=("lang",)).withColumn("n_chars", F.length("text").cast("long"))


STAGES = [("toxicity", clean), ("simhash_dedup", distinct), ("decontamination", unseen), ("pii", private), ("mixing", mix)]

#: A network's scores and fingerprints' components are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
