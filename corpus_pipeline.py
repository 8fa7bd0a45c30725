"""The corpus pipeline: quality, near duplicates, benchmark passages, secrets, pieces.

Each stage takes the documents that the stage before kept and returns them with its decisions applied; all but the last
return the columns of ``documents``.  ``run`` applies them to the table, writing each stage's rows to the shared folder.

Null ids and texts, empty texts, repeated rows and extra columns are handled as each operator's module says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm.decontaminate import without_contaminated
from sheaf.llm.learning import remainder
from sheaf.llm.near_dedup import one_of_each
from sheaf.llm.quality import score_quality, train
from sheaf.llm.queries import table, tokenizer_file
from sheaf.llm.secrets import redact
from sheaf.llm.sentencepiece_codec import encode, with_counts
from sheaf.llm.tables import written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (score >= 0.5)."""
    model = train(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 3) != 1)
    return score_quality(docs, model, threshold=0.5).filter("predicted = 1").select(*docs.columns)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return one_of_each(docs, shingle=5, percent=75)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which fewer than one word in twenty belongs to benchmark passages."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"), share=20)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked."""
    return redact(docs)


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with ids, n_pieces and whether the pieces decode to the text."""
    return with_counts(encode(docs, tokenizer_file("piece_bpe_32k.model"), verify=True))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("sentencepiece_encoding", sentencepiece_encoding),
]

# Compression, sketches and Viterbi have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
