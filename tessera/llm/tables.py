"""What the operators share in reading tables, in sending them to Python and in joining them with sets of ids."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tessera.sources.tables import dropped, scratch, shared_dir, table, written

__all__ = ["BATCH_BYTES", "BITMAP_BITS", "BROADCAST_IDS", "among", "batched", "bitmap", "bits", "dropped", "few", "free", "held", "looked_up", "observed", "only", "scratch", "shared_dir", "table", "without", "written"]

#: Bytes of an Arrow batch. Whole texts go to Python in batches of this size, so that a worker's memory doesn't depend on their length.
BATCH_BYTES = 4 << 20
#: Up to so many ids (8 bytes each) go to every executor.
BROADCAST_IDS = 2_000_000
#: The largest bitmap has 2 to this power bits (64 MB); with more members than that more rows pass it in vain.
BITMAP_BITS = 29
_WORD = 1 << 15
#: A key with more rows than this is looked up without a shuffle.
HOT_ROWS = 100_000


def batched(df: DataFrame) -> DataFrame:
    """``df``, which goes to Python in batches of at most ``BATCH_BYTES`` from now on."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def free(name: str, df: DataFrame) -> str:
    """``name``, with underscores before it while ``df`` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def observed(df: DataFrame, name: str, **facts: Column) -> tuple[DataFrame, dict]:
    """``df`` as a written table, and aggregates of its rows that the same job counts."""
    seen = Observation()
    made = written(df.observe(seen, *(c.alias(k) for k, c in facts.items())), name)
    return made, seen.get


def few(ids: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """A table of ids, to be broadcast in a join if it has at most ``limit`` rows; beyond that the join shuffles."""
    return F.broadcast(ids) if ids.limit(limit + 1).count() <= limit else ids


def bits(n: int, most: int = BITMAP_BITS) -> int:
    """The power of two whose bitmap has 16 bits for each of ``n`` members, as far as that is allowed."""
    return int(min(most, max(15, (16 * n).bit_length())))


def bitmap(values: DataFrame, power: int) -> DataFrame:
    """(bucket, marks): the lowest ``power`` bits of the only column's longs, marked in pieces of 32,768 bits; the pieces are made where the values are and then united."""
    place = F.col(values.columns[0]).bitwiseAND((1 << power) - 1) + 1
    return values.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("at")).groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("marks"))


def held(pieces: DataFrame, power: int) -> np.ndarray:
    """A bitmap in the driver, of one byte for 8 members: at most 64 MB."""
    marks = np.zeros(1 << power >> 3, np.uint8)
    for r in pieces.toLocalIterator():
        lo = (r.bucket - 1) * (_WORD >> 3)
        marks[lo : lo + (_WORD >> 3)] = np.frombuffer(r.marks, np.uint8)[: len(marks) - lo]
    return marks


def among(marks: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each of the longs may be a member."""
    at = values.view(np.uint64) & np.uint64(len(marks) * 8 - 1)
    return (marks[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _marked(df: DataFrame, column: str, ids: DataFrame, power: int, name: str) -> DataFrame:
    """``df`` with ``name``: whether the bitmap of ``ids`` leaves it open that the row's id is one of them. Nothing of ``df`` is shuffled."""
    bucket, marks = free("_bucket", df), free("_marks", df)
    pieces = bitmap(ids.select(F.xxhash64(ids.columns[0]).alias("v")), power).select(F.col("bucket").alias(bucket), F.col("marks").alias(marks))
    place = F.xxhash64(column).bitwiseAND((1 << power) - 1) + 1
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(marks, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, (at % 8).cast("int"))
    marked = df.withColumn(bucket, F.bitmap_bucket_number(place)).join(F.broadcast(pieces), bucket, "left")
    return marked.select(*df.columns, F.coalesce(bit.bitwiseAND(1) == 1, F.lit(False)).alias(name))


def only(df: DataFrame, column: str, ids: DataFrame, limit: int = BROADCAST_IDS, exact: bool = True) -> DataFrame:
    """The rows of ``df`` whose ``column`` is among the only column of ``ids``; of large sets a bitmap decides first which rows are shuffled.

    Not ``exact``, some other rows may be there too, and nothing of ``df`` is shuffled.
    """
    ids, name = _ids(df, column, ids)
    if (n := ids.count()) <= limit:
        return df.join(F.broadcast(ids), column, "left_semi").select(df.columns)
    maybe = _marked(df, column, ids, bits(n), name).where(F.col(name)).drop(name)
    return maybe.join(ids, column, "left_semi").select(df.columns) if exact else maybe


def without(df: DataFrame, column: str, ids: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """The other rows of ``df``, those with a null included; rows that the bitmap rules out aren't shuffled."""
    ids, name = _ids(df, column, ids)
    if (n := ids.count()) <= limit:
        return df.join(F.broadcast(ids), column, "left_anti").select(df.columns)
    marked = _marked(df, column, ids, bits(n), name)
    maybe, sure = marked.where(F.col(name)).drop(name), marked.where(~F.col(name)).drop(name)
    return sure.unionByName(maybe.join(ids, column, "left_anti").select(df.columns))


def _ids(df: DataFrame, column: str, ids: DataFrame) -> tuple[DataFrame, str]:
    return ids.select(F.col(ids.columns[0]).alias(column)).distinct(), free("_maybe", df)


def looked_up(rows: DataFrame, key: str, facts: DataFrame, n: str, hot: int = HOT_ROWS) -> DataFrame:
    """``rows`` with the ``facts`` of their ``key``, one row for each key that also counts its rows in ``n``.

    Facts of keys with more than ``hot`` rows go to every executor, so that such a key's rows stay
    where they are; there can't be more of these keys than one for ``hot`` rows. The others join by
    shuffle. Both tables are read twice and should be written ones.
    """
    many = F.broadcast(facts.where(F.col(n) > hot))
    rest = rows.join(many.select(key), key, "left_anti").join(facts.where(F.col(n) <= hot), key)
    return rows.join(many, key).unionByName(rest)
