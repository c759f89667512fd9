"""A training corpus from raw documents: quality, language, exact copies, near copies, packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.llm import language, packing, quality
from scorewright.llm.common import Scratch
from scorewright.llm.exact_dedup import keep_first
from scorewright.llm.near_dedup import keep_one

#: SQL can express neither the learnt stages nor the packing.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier, learnt from all labels of these documents, scores at the threshold or above.

    A null or empty text is scored like any text. Rows with a null id or without a label are scored, but don't teach. Without labels of
    either kind all documents have one score. Ties and repeated rows: equal texts stay or go together. Texts of any length are compressed whole.
    Columns of any names pass through. Empty table: no rows."""
    model, _ = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    return quality.keep_good(docs, model)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told without ambiguity.

    Null and empty texts, and texts without a letter, go. Rows with a null lang are judged, but don't teach; without any lang all go.
    Ties between languages are ambiguous, so such documents go. Repeated rows stay or go together. Texts of any length are read whole.
    Columns of any names pass through. Empty table: no rows."""
    return language.keep_known(docs, language.learn(docs, F.lit(True)))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: that of the smallest doc_id, and one row of it if it is repeated.

    A null text is the empty text; a null doc_id stays only if its group has no other. Rows that share a doc_id but not the text are
    documents of their own. Texts of any length are hashed whole. Columns of any names pass through. Empty table: no rows."""
    return keep_first(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the smallest doc_id, and one row of it if it is repeated.

    Texts without words stay. A null doc_id stays only if its group has no other. Rows that share a doc_id are told apart by their
    texts. Texts of any length are compared whole. Columns of any names pass through. Empty table: no rows."""
    return keep_one(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens (the columns of the packing query).

    A null or empty text is its end id alone. Null or repeated doc_ids: each row is a document. Documents of any length are cut
    into whole sequences and a rest; equal lengths are ranked in the order they were written. Other columns are ignored. Empty table: no rows."""
    import public_tokenizers

    return packing.digest(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 0))


STAGES = [("quality", quality_stage), ("language", language_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir's documents."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
