"""A training corpus from the ``documents`` table: quality, repeated lines, near duplicates, benchmark, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import decontaminate, line_dedup, ngram_join, packing, quality
from siltstone.llm.storage import Scratch
from siltstone.shipping import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at one half or more.

    Null text is scored as empty text; rows are scored one by one, so repeated rows and ids stay or go alike; an empty
    table stays empty, and without labels the constant score of one half keeps all.
    """
    ship(spark)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.with_score(docs, model, name="__score").where(F.col("__score") >= 0.5).select(*COLUMNS)


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated three-line windows are cut out; ``n_chars`` follows the text.

    Null text becomes empty; rows with a null id and rows equal in id and text keep their lines; every row stays.
    """
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group linked by five-word shingles at 0.8 or more.

    Documents without words stay, and so do rows with a null id. Rows of one id are one document: they stay or go together;
    of those that are equal in text, too, the first by language, source and length stays. An empty table stays empty.
    """
    ship(spark)
    scratch = Scratch(spark, "near")
    groups = scratch.save(ngram_join.jaccard_components(docs, n=5, num=80, den=100), "groups")
    kept = docs.select(*COLUMNS).join(groups.where("doc_id != component_id").select("doc_id").distinct(), "doc_id", "left_anti")
    # a written table, so Spark knows that it is small, or empty
    repeated = scratch.save(groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return kept.select(*COLUMNS)
    others = [c for c in COLUMNS if c not in ("doc_id", "text")]
    first = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*others)).alias("m"))
    return kept.join(repeated, "doc_id", "left_anti").select(*COLUMNS).unionByName(first.select("doc_id", "text", *[f"m.{c}" for c in others]))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null text holds none; repeated rows and ids stay or go by their own text; an empty benchmark keeps all.
    """
    ship(spark)
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), short_items=True).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, each with its sequence and its place there.

    Null text is the separator alone; repeated rows and null ids are packed row by row; an empty table gives no piece.
    """
    ship(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality", good_quality),
    ("lines", distinct_lines),
    ("near_duplicates", near_duplicates),
    ("benchmark", without_benchmark),
    ("packing", packed),
]

#: Classifier, tiling and packing cannot be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
