"""A corpus from raw documents to token digests, in stages.

Each stage reads what its predecessor kept, written as Parquet. Decisions are taken on rows, not on ids: a row goes because of its own text, whatever other
rows have its id, and rows without id are judged like others. The statistics and models of a stage come from the documents that it is given.

Defined cases: texts that are null or empty are judged like others by the classifiers, have no near copies and no benchmark passages, and give no tokens.
Of a group of near copies one row stays, of the smallest id (rows without id last), the first of equal rows; repeated rows are copies. Very long texts are
judged whole. An empty table gives an empty table. Columns beyond COLUMNS are not carried on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm import bpe, decontaminate, neardup, quality, toxicity
from statloom.llm.common import table
from statloom.llm.queries import token_digests, vocabulary_path
from statloom.session import cut, fresh_path, scratch, settled

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _judged(docs: DataFrame, classify, labels: DataFrame) -> DataFrame:
    """Rows with what a classifier says about them; it is given their text as `text` and carries their columns along."""
    carried = docs.select(*COLUMNS).withColumn("_whole", F.col("text"))
    out = classify(carried, labels, ["doc_id", "_whole", "lang", "source", "n_chars"])
    return out.withColumnRenamed("_whole", "text").select(*COLUMNS, "predicted")


def good_quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return _judged(docs, quality.classify, table(spark, folder, "labels")).filter("predicted = 1").select(*COLUMNS)


def not_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return _judged(docs, toxicity.classify, table(spark, folder, "labels")).filter("predicted = 0").select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One row of every class stays. Rows are numbered and written first, so that a number means the same row throughout."""
    rows = cut(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("first")

    def choose():
        found = neardup.classes(rows.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "class_id")
        of = rows.select("doc_id", "_row").join(found.hint("merge"), "_row")
        return of.groupBy("class_id").agg(first).select(F.col("first._row").alias("_row"))

    # what stays grows with the input: this join never broadcasts, so the plan is the same at every size
    return rows.join(settled(spark, "kept", choose).hint("merge"), "_row", "left_semi").select(*COLUMNS)


def uncontaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, folder, "benchmark"), COLUMNS).filter("NOT contaminated").select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return token_digests(docs, bpe.build_lexicon(docs, vocabulary_path()))


STAGES = [
    ("quality", good_quality), ("toxicity", not_toxic), ("near_duplicates", one_of_each), ("decontamination", uncontaminated), ("encoding", encoded),
]

# SQL cannot express the classifiers, the sketches and the encoding; tests hold the stages against plain Python.
ORACLE_SQL = None


def kept_by(spark: SparkSession, name: str, stage, docs: DataFrame, folder: str) -> DataFrame:
    """What a stage keeps, written; the stage's own intermediate tables give their space back."""
    with scratch(spark):
        made = stage(spark, docs, folder)
        path = fresh_path(spark, name)
        made.write.parquet(path)
    return spark.read.schema(made.schema).parquet(path)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = kept_by(spark, name, stage, docs, sf_dir)
    return STAGES[-1][1](spark, docs, sf_dir)
