"""A tree of files as a table of paths, and the search for a file by its name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import SearchConfig
from tessera.functions.text import text_of
from tessera.operators.heatmap import heatmap, highlighted
from tessera.operators.index import build
from tessera.operators.search import find


def file_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, name) of all files under ``root``; contents aren't read."""
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    return paths.withColumn("name", F.element_at(F.split("path", "/"), -1))


def find_files(files: DataFrame, name: str, config: SearchConfig = SearchConfig()) -> DataFrame:
    """(path, score, shown): files of exactly this name (score null), or else the best suggestions with their matches coloured.

    Only where no name is equal is anything indexed. Files of one name in several folders are several suggestions.
    """
    exact = files.where(F.col("name") == name).select("path", F.lit(None).cast("double").alias("score"), F.col("name").alias("shown"))
    if not exact.isEmpty():
        return exact
    index = build(files.withColumn("_key", F.col("path")), "name", "_key", config)
    queries = files.sparkSession.createDataFrame([(0, name)], "query_id int, query string")
    found = find(index, queries).select("doc_id", "score", F.lit(name).alias("query"))
    paths = index.docs.select("doc_id", F.col("key").alias("path"))
    return heatmap(index, found).join(paths, "doc_id").select("path", "score", F.coalesce(highlighted(F.col("chars")), text_of(F.col("doc_id"))).alias("shown"))
