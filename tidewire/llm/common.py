"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.scratch import SMALL, Scratch, sized  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns the operators read, under fixed names: other columns can't clash."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def joined_where_needed(rows: DataFrame, key: str, found: DataFrame, same: Column, scratch: Scratch) -> DataFrame:
    """rows left join found on ``same``; ``found`` has ``found_id`` (long), which equals the rows' column ``key`` where they join.

    If found's ids are ``SMALL`` in number, only the rows that have one are exchanged, and all others stay where they lie.
    """
    ids, _ = scratch.save(found.select(F.col("found_id").alias("_touched")).distinct())
    if ids.count() > SMALL:
        return rows.join(found, same, "left")
    on, ids = rows[key] == F.col("_touched"), F.broadcast(ids)
    return rows.join(ids, on, "left_semi").join(found, same, "left").unionByName(rows.join(ids, on, "left_anti"), allowMissingColumns=True)


def release() -> None:
    """Gives memory that a finished task has freed back to the system: workers live on between stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


#: A-Z to a-z; every other byte stays.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection on 64-bit words."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x
