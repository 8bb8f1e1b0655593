"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.storage import remove, shared_base

#: ASCII white space: space and tab to carriage return.
BLANK = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that driver and executors share."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends there."""
    path = shared_folder(df.sparkSession, name)
    for noted in _noted.get()[-1:]:
        noted.append(path)
    return _kept(df, path)


#: Of the running thread: one list of paths for each open block.
_noted: ContextVar[tuple[list[str], ...]] = ContextVar("noted", default=())


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Whatever is :func:`stored` within the block is deleted at its end; results must have been written by then."""
    paths: list[str] = []
    token = _noted.set((*_noted.get(), paths))
    try:
        yield
    finally:
        _noted.reset(token)
        for path in paths:
            remove(spark, path)


def _kept(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """A folder for one operator's intermediate tables, deleted when its block ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.tables = spark, shared_folder(spark, name), 0

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        self.tables += 1
        return _kept(df, f"{self.path}/{self.tables}-{name}")

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        remove(self.spark, self.path)


def whole(text: str | Column) -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def crc_fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts


def identity(id_col: str, *others: str) -> list[Column]:
    """Two columns, ``_k1`` and ``_k2``, that tell rows apart by id and content; never null."""
    return [
        F.coalesce(F.col(id_col).cast("string"), F.lit("\x00")).alias("_k1"),
        F.xxhash64(*[F.col(c) for c in others]).alias("_k2"),
    ]
