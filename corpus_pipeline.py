"""The corpus pipeline: stages over documents, each working on all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Null texts, empty tables and repeated rows are handled as the operators say; extra columns stay until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timepoint.llm import decontaminate, quality, secrets, simhash
from timepoint.llm.common import column, columns_of, free_name, table, written
from timepoint.llm.queries import encoded_digests, vocabulary


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return simhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go, whole: what stands around a passage gives it away."""
    found = free_name(docs, "found")
    marked = decontaminate.with_findings(docs, table(spark, sf_dir, "benchmark"), found)
    return columns_of(marked.where(F.size(column(marked, found)["first"]) == 0), docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark, and n_chars follows; texts without one stay as they are."""
    secret = free_name(docs, "secret")
    found = secrets.with_secrets(docs, secret, mark=secrets.MARK)
    redacted = column(found, secret)["redacted"]
    n_chars = F.length(redacted).cast(docs.schema["n_chars"].dataType)
    cut = found.withColumns({"text": F.coalesce(redacted, column(found, "text")), "n_chars": F.coalesce(n_chars, column(found, "n_chars"))})
    return columns_of(cut, docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of each text, with digests of them and of what they decode to."""
    return encoded_digests(docs, vocabulary())


STAGES = [
    ("quality rules", good_quality),
    ("simhash near-dedup", one_of_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("secret scan", without_secrets),
    ("bpe encoding", encode),
]

#: Near-duplicate hashes, inferred automata and the vocabulary's merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = written(docs, "stage")
    return docs
