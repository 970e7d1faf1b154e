"""Given tables, row keys and scratch tables of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skuflow.session import checkpointed

__all__ = ["checkpointed", "crc_of", "documents", "doc_key", "first_by_hash", "free_names", "labels", "read_table", "shuffle_partitions"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "labels")


def free_names(taken: list[str], *names: str) -> list[str]:
    """The names, with underscores behind them as far as needed to differ from all taken ones and from each other.

    Spark doesn't tell upper and lower case apart in names.
    """
    held, out = {n.lower() for n in taken}, []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def crc_of(doc_id: Column | str, modulus: int) -> Column:
    """The fold of a document: crc32 of its id as text; null where the id is null."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(modulus)).cast("int")


def first_by_hash(hashed: Column, rows: int, limit: int) -> Column:
    """Whether a row's hash is among the lowest share of all hashes that holds ``limit`` of ``rows`` rows, and a fifth more.

    A sample is cut down by this where its rows lie, so that no task gathers more than a few limits of them.
    """
    share = 1.2 * limit / max(rows, 1)
    return F.lit(True) if share >= 1 else hashed < F.lit(int(-(1 << 63) + share * (1 << 64)))


def doc_key(doc_id: str, text: str) -> Column:
    """Tells rows apart by id and text, so that rows which share an id keep their own results."""
    return F.xxhash64(F.col(doc_id).isNull(), F.col(doc_id), F.col(text).isNull(), F.col(text))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
