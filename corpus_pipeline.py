"""The corpus pipeline: documents through five operators, each stage written and read again.

Stages take (spark, docs, sf_dir). All but the last return the columns of
``documents``; the last adds each row's place in the mix.

Defined results: a null text fails the quality rules; empty, blank and very short
texts do too; very long ones are read whole by every stage; repeated rows are copies
of each other, of which one stays; rows without a doc_id can't be told apart and stay
until a stage judges their text; further columns of any name come through unchanged,
but that mix_* columns are the last stage's; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from assayer.llm.common import Written, read, with_checkpoints
from assayer.llm.decontaminate import leaky_removed
from assayer.llm.mixing import mix
from assayer.llm.quality_rules import rejected_removed
from assayer.llm.secrets import secrets_masked
from assayer.llm.simhash import near_copies_removed


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return rejected_removed(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group of near copies: five-word shingles, Jaccard similarity of 0.8 or more."""
    return near_copies_removed(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return leaky_removed(docs, read(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts masked."""
    return secrets_masked(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the columns mix_*, their place in the mix; an existing column of such a name gives way."""
    m = mix(docs)
    added = {f"mix_{c}": m[c] for c in ("position", "slot", "place", "phase", "block", "release", "deadline")}
    kept = [m["row"].getField(c).alias(c) for c in docs.columns if c.lower() not in added]
    return m.select(*kept, *[c.alias(k) for k, c in added.items()])


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", deduplicate),
    ("benchmark_decontamination", decontaminate),
    ("secret_scans", mask_secrets),
    ("source_mixing", mix_sources),
]

#: Hash fingerprints, windowed retrieval and the schedule are beyond SQL; tests/llm checks run() by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each through a Parquet table in the shared folder.

    A stage's table goes when the next one's is written; the last one's, which the
    result reads, goes with the application.
    """
    with_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, table = read(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        table = table.next(out, f"{folder}/{k}-{name}") if table else Written(out, f"{folder}/{k}-{name}")
        docs = table.frame
    return docs
