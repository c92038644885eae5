"""Helpers that the operators of this package share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timepoint.session import new_scratch

# ASCII letters in lower case, ASCII digits and every byte above 127 make words; other ASCII bytes part them.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
#: The same words in the text as it stands, for offsets.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def plain_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower case, in UTF-8; none of null."""
    return text.encode().translate(_WORD_BYTES).split() if text else []


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows, once computed, from a table in the folder that all executors share.

    Cuts the lineage: what was written is read again, also after an executor is lost.
    """
    path = new_scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores before it until no column of the frame has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def column(df: DataFrame, name: str) -> Column:
    """A column by its exact name, whatever characters are in it."""
    return df[f"`{name.replace('`', '``')}`"]


def columns_of(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns that ``like`` has, in its order."""
    return df.select(*[column(df, c) for c in like.columns])


def joined_digest(items: Column) -> Column:
    """SHA-256 in lower-case hex of the strings joined by commas."""
    return F.sha2(F.concat_ws(",", items), 256)


def read_text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def released(made: pa.Array) -> pa.Array:
    """The array, with what Arrow holds beside it given back: a worker lives on between tasks."""
    pa.default_memory_pool().release_unused()
    return made
