"""Lines of files and of addresses, in batch and in streams, and key and title from them."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.request import urlopen

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def keyed_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """(key, title): the key reaches to the first blank or comma, the title is what follows it, trimmed.

    Lines without a key, blank ones among them, have an empty key and an empty title.
    """
    line = F.rtrim(F.coalesce(F.col(column), F.lit("")), F.lit("\r"))
    key = F.regexp_extract(line, r"^([^\s,]*)", 1)
    title = F.btrim(F.substring(line, F.length(key) + 2, F.length(line)), F.lit(" \t\n\r\f\v"))
    return lines.select(key.alias("key"), F.when(key == "", F.lit("")).otherwise(title).alias("title"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return keyed_lines(spark.read.text(path))


def stream_lines(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """As ``read_lines``, of the files that appear in a folder; ``files_per_batch`` bounds a micro-batch."""
    return keyed_lines(spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path))


def fetched_lines(urls: DataFrame, column: str = "url", chunk: int = 1 << 20, timeout: float = 60.0) -> DataFrame:
    """(url, line, value): the lines behind each address, without line ends; ``urls`` may be a stream of addresses.

    A task reads an address a chunk at a time and hands its lines on as they come, so that it holds
    little of a long answer. Null addresses have no lines; bytes that aren't UTF-8 become U+FFFD.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(url: str, lines: list[bytes], at: int) -> pa.RecordBatch:
            values = [x.removesuffix(b"\r").decode("utf-8", "replace") for x in lines]
            return pa.RecordBatch.from_arrays([pa.array([url] * len(values), pa.string()), pa.array(range(at, at + len(values)), pa.int64()), pa.array(values, pa.string())], ["url", "line", "value"])

        for batch in batches:
            for url in filter(None, batch.column(0).to_pylist()):
                at, rest = 0, b""
                with urlopen(url, timeout=timeout) as answer:
                    while data := answer.read(chunk):
                        *lines, rest = (rest + data).split(b"\n")
                        if lines:
                            yield rows(url, lines, at)
                            at += len(lines)
                if rest:
                    yield rows(url, [rest], at)

    return urls.select(urls[column].cast("string").alias("url")).mapInArrow(run, "url string, line long, value string")
