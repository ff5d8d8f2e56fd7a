"""A corpus pipeline: five stages, each over all that its predecessor kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written and read again as the next one's docs.
All but the last return the columns of documents.

1. quality: documents whose quality score is below 0.7 go.
2. line_dedup: lines that many documents repeat stay in one of them; every
   document stays, if only with an empty text.
3. near_duplicates: of the documents that five-word shingles link at a Jaccard
   similarity of 0.8 or more, the one with the smallest id stays.
4. decontamination: documents that hold a benchmark item go.
5. encode: byte-level BPE ids of each text; the last stage adds them.

Nulls: a null text counts as empty in every stage. Rows without an id take part
in stages 1, 2, 4 and 5, and stay in stage 3 if nothing links to them. Rows
that share an id share their fate. An empty table passes through empty. Columns
of documents that are named like an operator's own pass through as they came.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, decontam, jaccard, linededup, quality
from quarry.llm.common import durable, table

THRESHOLD = 0.7


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts; it learns from the same folds of labels as the query does."""
    model = quality.train(docs, quality.learnable(table(spark, sf_dir, "labels")))
    return quality.score(docs, model, "__score").where(F.col("__score") >= THRESHOLD).drop("__score")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the lines that they repeat; n_chars, where there is one, follows the text."""
    out = linededup.dedup_lines(_aside(docs, "n_lines", "n_dropped"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return _back(out, docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, the one with the smallest id."""
    found = jaccard.jaccard_components(docs, width=5, top=80)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id").cast("bigint") == F.col("__gone"), "left_anti")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    out = decontam.find_leaks(_aside(docs, "leaks"), table(spark, sf_dir, "benchmark"))
    return _back(out.where(F.size("leaks") == 0), docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and n_tokens of each document."""
    import public_tokenizers

    return bpe.encode(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).select("doc_id", "ids", "n_tokens")


def _aside(docs: DataFrame, *names: str) -> DataFrame:
    """docs with the caller's columns of these names (in any case) under others, so that an operator's own do not replace them."""
    return docs.withColumnsRenamed({c: f"__own_{c}" for c in docs.columns if c.lower() in names})


def _back(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again, in their order."""
    return out.select([F.col(f"`__own_{c}`").alias(c) if f"__own_{c}" in out.columns else F.col(f"`{c}`") for c in docs.columns])


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("encode", encode_stage),
]

#: SQL expresses neither the classifier nor the encoder; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
