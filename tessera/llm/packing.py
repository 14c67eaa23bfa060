"""Training sequences by power-of-two decomposition.

A document of n tokens falls into pieces whose lengths are the powers of two of n's binary digits,
longest first, with as many of the longest length ``2 ** largest`` as fit. No piece crosses
documents, no token is dropped or padded, and pieces of one length form a bucket. Within a bucket
a task numbers its pieces into batches of ``batch_tokens`` tokens (of one piece, where a piece is
longer), so that a training step reads (length, part, batch); the last batch of a length in a task
may be smaller. Nothing is shuffled; ``write_buckets`` lays the buckets out as folders.

Defined results: null and empty texts have no pieces; repeated rows and rows with a null id are
packed each for itself; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.encoding import RANKS, encoded
from tessera.llm.tables import batched, table

LARGEST = 13
BATCH_TOKENS = 1 << 16
_SCHEMA = "doc_id long, piece int, begin int, length int, part int, batch int, tokens array<int>"


def pieces(n: np.ndarray, largest: int = LARGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, begin, length) of the pieces of documents with ``n`` tokens, in order."""
    n = np.asarray(n, np.int64)
    bits = np.arange(largest - 1, -1, -1)
    count = np.concatenate([(n >> largest)[:, None], (n[:, None] >> bits) & 1], 1)
    sizes = np.concatenate([[1 << largest], 1 << bits])
    doc = np.repeat(np.arange(len(n)), count.sum(1))
    length = np.repeat(np.tile(sizes, len(n)), count.ravel())
    end = np.cumsum(length)
    return doc, end - length - np.concatenate([[0], np.cumsum(n)])[doc], length


def packed(docs: DataFrame, text: str = "text", key: str = "doc_id", tokenizer: str = RANKS, largest: int = LARGEST, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """(doc_id, piece, begin, length, part, batch, tokens) of every piece; see the module."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(largest + 1, np.int64)
        for batch in batches:
            ids, first = encoded(batch.column(1), tokenizer)
            doc, begin, length = pieces(np.diff(first), largest)
            if not len(doc):
                continue
            place = np.arange(len(doc)) - np.searchsorted(doc, doc)
            bucket = np.log2(length).astype(np.int64)
            turn = np.empty(len(doc), np.int64)
            for k in np.unique(bucket):
                at = np.flatnonzero(bucket == k)
                turn[at] = seen[k] + np.arange(len(at))
                seen[k] += len(at)
            step = turn // np.maximum(1, batch_tokens // length)
            small = lambda x: pa.array(x.astype(np.int32))
            tokens = pa.ListArray.from_arrays(small(np.append(np.cumsum(length) - length, length.sum())), small(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), small(place), small(begin), small(length), small(np.full(len(doc), part)), small(step), tokens], ["doc_id", "piece", "begin", "length", "part", "batch", "tokens"])

    return batched(docs).select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, _SCHEMA)


def write_buckets(sequences: DataFrame, path: str) -> None:
    """One folder for each length; every task writes into the folders that it has pieces of."""
    sequences.write.partitionBy("length").parquet(path)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents."""
    return packed(table(spark, sf_dir, "documents"))


QUERIES = {"op9_packing": op9_packing}
ORACLE_SQL: dict[str, str] = {}
