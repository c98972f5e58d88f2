"""The corpus pipeline: five stages over documents, each written as Parquet and read again.

Toxic documents go, one document of each SimHash component stays, documents that hold a benchmark
item go, personal data is replaced by its kind in brackets, and what is left is encoded and decoded
by byte-level BPE. Each stage works on all that the one before kept; all but the last return the
columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfield.llm import bpe, decontaminate, pii, simhash, toxicity
from lumenfield.llm.tables import read
from lumenfield.plans.scratch import materialize
from lumenfield.session import ship_package


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under the threshold; learned from the labels of documents of two folds of three."""
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3, F.lit(-1))
    model = toxicity.fit(toxicity.labelled(docs, read(spark, sf_dir, "labels"), fold, 1))
    scored = toxicity.score(docs, model)
    return scored.filter(F.col("toxicity") < toxicity.LEAST).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document by doc_id of each SimHash component; of repeated rows one.

    Documents with no word have equal fingerprints and are copies of each other like any others.
    """
    names = docs.columns
    numbered = materialize(docs.withColumn("row_number_", F.monotonically_increasing_id()), "numbered")
    found = simhash.near_duplicates(numbered.select(F.col("row_number_").alias("doc_id"), "text"))
    groups = found.select(F.col("doc_id").alias("row_number_"), F.col("component_id").alias("group_"))
    # the row to keep of each group by (doc_id, row number), nulls last
    keyed = numbered.select("row_number_", "doc_id").join(groups, "row_number_")
    first = keyed.groupBy("group_").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row_number_").alias("r"))).alias("k"))
    kept = first.select(F.col("k.r").alias("row_number_"))
    return numbered.join(kept, "row_number_", "left_semi").select(names)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    found = decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))
    return found.filter(~F.col("contaminated")).select(docs.columns)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced; n_chars follows the text."""
    out = pii.redact(docs, pii.fit(docs))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(dict(docs.dtypes)["n_chars"])))
    return out.select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of each document's token ids, and the digest of the text decoded from them."""
    ship_package(spark)
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact_pii),
    ("bpe", encode),
]

#: Trained models and fingerprints cannot be put in SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
