"""The corpus pipeline: documents go through five operators, each on all that its predecessor kept.

``run`` writes every stage's rows to the shared folder and reads them for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.llm.common import LlmQuery, crc_bucket, documents
from trialspark.llm.decontaminate import decontaminate
from trialspark.llm.lines import remove_repeated_lines
from trialspark.llm.pieces import encode_decode
from trialspark.llm.similar import drop_similar
from trialspark.llm.toxicity import drop_toxic, train
from trialspark.shared import finished, in_few_files, materialize


def _recounted(after: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, with ``n_chars`` of the text as it is now (NULL texts keep theirs)."""
    return after.select(*[F.coalesce(F.length("text").cast("long"), F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without toxic ones; learnt from the labels outside the held-out quarter."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), crc_bucket("doc_id", 4) != 2)
    return drop_toxic(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of lines or sentences that stood before; no document is dropped."""
    aside = {c: f"__own_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}  # the operator adds and replaces columns
    cut = remove_repeated_lines(docs.withColumnsRenamed(aside)).select("doc_id", "text", *aside.values())
    return in_few_files(_recounted(cut.withColumnsRenamed({v: k for k, v in aside.items()}), docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: op5's fingerprints and pivot tables, MinHash for what they miss, an exact check."""
    return in_few_files(drop_similar(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages cut out; those of nothing else go."""
    return _recounted(decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text that is left, and the digest of what they decode to."""
    return encode_decode(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

ORACLE_SQL = None  # trained scores, fingerprints and tokens are beyond SQL; see tests/llm/test_pipeline.py


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written result of all stages; what they wrote on the way is deleted."""

    def build() -> dict[str, DataFrame]:
        docs = documents(spark, sf_dir)
        for _, stage in STAGES[:-1]:
            docs = materialize(stage(spark, docs, sf_dir))
        return {"pipeline": STAGES[-1][1](spark, docs, sf_dir)}

    return finished(spark, build)["pipeline"]


QUERY = LlmQuery("pipeline", run, ORACLE_SQL)
