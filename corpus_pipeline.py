"""A corpus pipeline: each stage's documents are written and read again by the next.

Every stage but the last returns the columns of its input. Null, empty and repeated rows,
empty tables and further columns are treated as the operators define it; see the modules of
paneloom.llm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paneloom.catalog.fixtures import Query, table
from paneloom.llm import bpe, decontamination, jaccard, line_dedup, quality
from paneloom.llm.queries import VOCABULARY
from paneloom.session import new_shared_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned list accept."""
    rules = quality.learn_from_labels(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, rules).filter("kept").select("row.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that ten or more of them share. A null text stays null;
    n_chars, where there is one, follows the text."""
    cut = line_dedup.drop_shared_lines(docs, min_docs=10)
    columns = []
    for name in docs.columns:
        value = F.col("row").getField(name)
        if name == "text":
            value = F.when(value.isNotNull(), F.col("kept_text"))
        elif name == "n_chars":
            changed = F.length("kept_text").cast(docs.schema[name].dataType)
            value = F.when(F.col("n_dropped") > 0, changed).otherwise(value)
        columns.append(value.alias(name))
    return cut.select(columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of near copies."""
    return jaccard.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passages, or too little of them."""
    return decontamination.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decodes): token ids, and whether they decode to the text."""
    return bpe.round_trip(docs, VOCABULARY, carry=["doc_id", "text"]).select(
        "row.doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        (F.col("decoded") == F.coalesce("row.text", F.lit(""))).alias("decodes"),
    )


STAGES = [
    ("quality rules", keep_good),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", drop_benchmark),
    ("BPE encoding and decoding", encode),
]

ORACLE_SQL = None  # the rules are learned


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_shared_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERY = Query(run, ORACLE_SQL)
