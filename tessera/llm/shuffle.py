"""Uniform shuffle into shards of exact sizes.

How many rows of partition p go to shard s is drawn before any row moves: the matrix of counts has
the partitions' sizes as row sums, the shards' sizes as column sums, and is hypergeometric, as it is
for a uniform permutation of all rows. Each task draws its own row of the matrix: from the root of
a binary tree over the partitions down to its leaf it splits the columns' totals between the
halves, by generators that the nodes seed, so that all tasks agree on a matrix that nobody holds.
A task deals its rows to the shards by a random permutation of its counts, the rows are exchanged,
and each shard is put in the order of random keys that were drawn with the deal. The exchange goes
to *blocks* of a shard, ranges of the keys with about ``block_rows`` rows, so that no task sorts a
whole shard. Deal and keys depend on the counts alone: how many rows each block gets, and thus
where its positions begin, is found by drawing them once more without the rows.

The first of two passes counts the rows of each partition (a scan without columns), and the second
stops with an error should a partition hold another number. A table whose plan shuffles, so that its
partitions needn't come out the same twice, is first written to the shared folder.

Result: all columns of the table, then ``shard`` and ``position`` (from 0 on). Columns of these names
in the table are replaced.

Defined results: every row is dealt once, whatever it holds, nulls and repeated rows too; shard
sizes differ by one at most; an empty table gives no rows; with more shards than rows some shards
are empty. The result depends on the seed and on how the table falls into partitions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.tables import batched, table, written

SHARDS = 16
SEED = 20
BLOCK_ROWS = 1 << 12
#: Blocks are larger where there would be more than about so many, since each has a row in the driver.
MOST_BLOCKS = 1 << 20
_EXACT = 10**9 - 1


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """How many of ``sample`` drawn from good and bad are good; numpy's where it goes, else by ratio of uniforms."""
    if max(good, bad) <= _EXACT:
        return int(rng.hypergeometric(good, bad, sample))
    low, high = max(0, sample - bad), min(good, sample)
    if low == high:
        return low
    total = good + bad
    lg = math.lgamma
    log_p = lambda k: -(lg(k + 1) + lg(good - k + 1) + lg(sample - k + 1) + lg(bad - sample + k + 1))
    mode = min(high, max(low, (sample + 1) * (good + 1) // (total + 2)))
    top = log_p(mode)
    mean = sample * good / total
    width = math.sqrt(max(mean * (bad / total) * ((total - sample) / max(total - 1, 1)), 0.0) + 0.5) * 1.7155277699214135 + 0.8989161620588988
    while True:
        u, v = rng.random(), rng.random()
        k = math.floor(mean + 0.5 + width * (v - 0.5) / u) if u > 0 else -1
        if low <= k <= high and 2 * math.log(u) <= log_p(k) - top:
            return k


def split(rng: np.random.Generator, totals: np.ndarray, sample: int) -> np.ndarray:
    """Of each column how many fall among ``sample`` of all: multivariate hypergeometric."""
    out, rest, left = np.zeros(len(totals), np.int64), int(totals.sum()), int(sample)
    for k, n in enumerate(totals.tolist()):
        if not left:
            break
        rest -= n
        out[k] = hypergeometric(rng, n, rest, left)
        left -= int(out[k])
    return out


def row_of(sizes: np.ndarray, shards: np.ndarray, p: int, seed: int) -> np.ndarray:
    """Row p of the communication matrix."""
    lo, hi, node, column = 0, len(sizes), 1, shards.astype(np.int64)
    before = np.concatenate([[0], np.cumsum(sizes)])
    while hi - lo > 1:
        mid = (lo + hi) // 2
        first = split(np.random.default_rng([seed, node]), column, int(before[mid] - before[lo]))
        if p < mid:
            hi, node, column = mid, 2 * node, first
        else:
            lo, node, column = mid, 2 * node + 1, column - first
    return column


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    return np.full(shards, rows // shards, np.int64) + (np.arange(shards) < rows % shards)


def _drawn(sizes: np.ndarray, per_shard: np.ndarray, p: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, key) of each row of partition p."""
    size = int(sizes[p]) if p < len(sizes) else 0
    counts = row_of(sizes, per_shard, p, seed) if size else np.zeros(len(per_shard), np.int64)
    rng = np.random.default_rng([seed, 0, p])
    return rng.permutation(np.repeat(np.arange(len(per_shard), dtype=np.int32), counts)), rng.integers(0, 2**63, size)


def _begins(spark: SparkSession, handle, partitions: int, shards: int, power: int, seed: int) -> DataFrame:
    """(shard, block, before): the first position of each of the ``2 ** power`` blocks of each shard; a row for each block."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():
                shard, key = _drawn(*handle.value, p, seed)
                cell, n = np.unique((shard.astype(np.int64) << power) + (key >> (63 - power)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], ["cell", "n"])

    counted = spark.range(0, partitions, 1, max(1, min(partitions, 4 * spark.sparkContext.defaultParallelism))).mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros((shards, 1 << power), np.int64)
    n.ravel()[counted.column("cell").to_numpy()] = counted.column("n").to_numpy()
    cells = pa.table({"shard": np.repeat(np.arange(shards, dtype=np.int32), 1 << power), "block": np.tile(np.arange(1 << power, dtype=np.int32), shards), "before": (n.cumsum(1) - n).ravel()})
    return spark.createDataFrame(cells)


def shuffled(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``docs`` with ``shard`` and ``position``; see the module."""
    docs = docs.drop("shard", "position")
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        docs = written(docs, "rows")
    counted = docs.select(F.spark_partition_id().alias("p")).groupBy("p").count().toArrow()
    sizes = np.zeros(int(max(counted.column("p").to_pylist(), default=-1)) + 1, np.int64)
    sizes[counted.column("p").to_numpy()] = counted.column("count").to_numpy()
    handle = docs.sparkSession.sparkContext.broadcast((sizes, shard_sizes(int(sizes.sum()), shards)))
    names = [f"c{k}" for k in range(len(docs.columns))]
    rows = max(block_rows, int(sizes.sum()) / MOST_BLOCKS)
    power = max(0, math.ceil(math.log2(max(1, int(sizes.sum()) / shards / rows))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, at = TaskContext.get().partitionId(), 0
        shard, key = _drawn(*handle.value, p, seed)
        for batch in batches:
            n = batch.num_rows
            if at + n > len(shard):
                raise RuntimeError(f"partition {p} has more rows than the {len(shard)} that were counted")
            here = key[at : at + n]
            place = np.arange(at, at + n) + (p << 40)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard[at : at + n]), pa.array((here >> (63 - power)).astype(np.int32)), pa.array(here), pa.array(place)], [*names, "shard", "block", "key", "place"])
            at += n
        if at != len(shard):
            raise RuntimeError(f"partition {p} has {at} rows, {len(shard)} were counted")

    fields = [T.StructField(n, f.dataType) for n, f in zip(names, docs.schema.fields)]
    added = [T.StructField("shard", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("place", T.LongType())]
    dealt = batched(docs.toDF(*names)).mapInArrow(deal, T.StructType([*fields, *added]))
    turn = F.row_number().over(Window.partitionBy("shard", "block").orderBy("key", "place")) - 1
    if power:
        begins = F.broadcast(_begins(docs.sparkSession, handle, len(sizes), shards, power, seed))
        dealt = dealt.withColumn("turn", turn).join(begins, ["shard", "block"])
        position = F.col("turn") + F.col("before")
    else:
        position = turn.cast("long")
    return dealt.select(*names, "shard", position.alias("position")).toDF(*docs.columns, "shard", "position")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, dealt to shards."""
    return shuffled(table(spark, sf_dir, "documents"))


QUERIES = {"op7_sharding": op7_sharding}
ORACLE_SQL: dict[str, str] = {}
