"""From raw documents to sharded training data: five stages, each written as Parquet before the next reads it.

A stage takes (spark, docs, sf_dir), where docs is all that its predecessor kept, and returns a DataFrame; all but
the last return the columns of ``docs``, whatever others it has beside those of ``documents``.

What holds for each stage: a null text is an empty one; a null doc_id, source or other value is kept as it is; rows are
judged whole, however long their texts; an empty table stays empty. Names that begin with two underscores are the stages' own.
Near-copies are found by SimHash and checked on the sets of shingles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lamina.llm.common import saved, ship, table
from lamina.llm.decontamination import drop_contaminated
from lamina.llm.mixing import mixed
from lamina.llm.quality import drop_rejected
from lamina.llm.sharding import assign
from lamina.llm.simhash import drop_similar

SHARDS = 40


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go, each row by its own text; empty texts are judged like any other."""
    return drop_rejected(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (shingles of five words, similarity 0.8) stays: that with the least doc_id.

    Rows that repeat a doc_id stay or go together, rows with a null one stay. Texts without words are copies of each other.
    """
    ship(spark)
    return drop_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go; empty texts have none."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source gets its share of words; a document may go or stand up to three times. A null source is one, one without words keeps its rows."""
    return mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row gets its ``shard``, and ``grown_shard``, where it would be with one shard more; columns of these names are replaced. A null doc_id counts as 0."""
    return assign(docs, SHARDS)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: SQL expresses neither the classifier nor the near-duplicates; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
