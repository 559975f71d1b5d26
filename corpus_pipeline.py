"""Training-corpus pipeline over `documents`: each stage works on all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from marketloom.llm._store import discard, small_batches, stored
from marketloom.llm.decontamination import decontaminate
from marketloom.llm.jaccard_join import near_duplicates
from marketloom.llm.secrets import redact
from marketloom.llm.sentencepiece import encode, public_model
from marketloom.llm.toxicity import THRESHOLD, fit, score


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the model learns from the labels of learnable ids. Null and empty texts stay."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    mark = "_toxicity"
    while mark in docs.columns:
        mark = f"_{mark}"
    return score(docs, model, mark).where((F.col(mark) < THRESHOLD) | F.coalesce(F.trim("text") == "", F.lit(True))).drop(mark)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near copies. Texts without words and rows without an id stay; rows with one id are one document."""
    drop = near_duplicates(docs).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(drop, "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words fewer than one in twenty lie in windows of the benchmark."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with secrets replaced by a mark; n_chars follows a changed text."""
    out = redact(docs)
    return out.withColumn("n_chars", F.coalesce(F.char_length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else out


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every whole text with begin and end ids, ready for training, beside the document's id and origin."""
    keep = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    return encode(docs.select(*keep, "text"), public_model()).select(*keep, F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("secrets", redact_secrets), ("tokenize", tokenize)]
#: The first stage is a trained model, which SQL cannot express; tests/llm checks the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with small_batches(spark):  # whole rows pass through Python
            docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return docs
