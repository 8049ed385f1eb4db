"""A cleaning pipeline over documents: each stage works on all that its predecessor kept.

toxicity: documents scored toxic go; line dedup: recurring lines go from all but their first
document, and documents of nothing else go; near duplicates: one document of each group stays; decontamination: documents with
benchmark passages go; encoding: what is left becomes tokens.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.llm.bpe import bpe_encode
from lettermill.llm.common import scratch, shared_dir
from lettermill.llm.decontaminate import decontaminate
from lettermill.llm.lines import drop_recurring_lines
from lettermill.llm.neardup import near_duplicates
from lettermill.llm.queries import VOCAB, table
from lettermill.llm.toxicity import fit, score_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't scored toxic. Null and empty texts are scored as such and stay; without labels of both kinds all stay; rows are judged one by one."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).where("predicted = 0").drop("score", "predicted")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines. Null and empty texts stay; a document is an id with a text, see ``drop_recurring_lines``; n_chars follows the text."""
    # what lost all of its text was a copy of lines that other documents keep
    left = drop_recurring_lines(docs, min_tokens=1).where("n_dropped = 0 or trim(text) <> ''").drop("n_lines", "n_dropped")
    return left.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"])).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the least id. Null and empty texts and rows without an id stay; rows that repeat an id are kept or dropped together."""
    extra = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("copy"))
    return docs.join(extra, docs["doc_id"] == extra["copy"], "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated, judged row by row; null and empty texts stay, and so does all without items."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each row, with digests of ids and decoded text; a null text has none."""
    return bpe_encode(docs, VOCAB, with_decoded=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("encoding", encode),
]

#: SQL can't express the stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each on what the one before left, written to the shared folder between; an empty table passes through.

    What a stage stores on its way is deleted once its result is written; the results of stages stay.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
