"""Small helpers of the corpus operators."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Key of a document row: its id and a hash of its text, so that rows which share an id but not a
#: text stay apart and equal rows behave alike.  ``<=>`` keeps null ids.
KEY = ("__id", "__th")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def text_column(name: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def keyed(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` cut to ``__id``, ``__th`` and ``__text``; other columns and their names do not matter."""
    body = text_column(text)
    return docs.select(F.col(id_col).alias("__id"), F.xxhash64(body).alias("__th"), body.alias("__text"))


def same_key(left: DataFrame, right: DataFrame) -> Column:
    return left["__id"].eqNullSafe(right["__id"]) & (left["__th"] == right["__th"])


#: A stored table of at most so many rows of a few numbers is broadcast (some 50 MB); a larger one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def sized(stored: DataFrame) -> DataFrame:
    """A stored narrow table, marked for broadcast if its counted size allows it."""
    return F.broadcast(stored) if stored.count() <= BROADCAST_ROWS else stored


def let(value: Column, use) -> Column:
    """``use(v)`` where ``v`` stands for ``value`` computed once a row.

    An expression that is put into a lambda is otherwise worked out again for each element.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


#: Bytes of UTF-8 text: A-Z to a-z, every other ASCII character but digits and letters to a blank.
_WORD_BYTES = bytes(
    b if b >= 128 or chr(b) in string.digits + string.ascii_lowercase else b + 32 if chr(b) in string.ascii_uppercase else 32 for b in range(256)
)


def byte_words(text: bytes) -> list[bytes]:
    """Runs of digits, letters and characters beyond ASCII of a UTF-8 text, only A-Z lower-cased.

    The time is linear in the text; a byte of 128 or more is always part of such a character.
    """
    return text.translate(_WORD_BYTES).split()
