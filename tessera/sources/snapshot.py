"""Snapshots of an index as lines of JSON: the settings, then the vocabulary with its vectors, then the documents.

Each line is one record with its kind in ``type``: ``metadata``, ``vocab``, ``payload`` (a stored
source row with its tokens) or ``token_payload`` (an identity with its tokens). A reader takes lines
as well as one JSON array. Restoring takes vectors as they are and computes none.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.config import RECORD_NAMES, SearchConfig
from tessera.functions.text import doc_id, key_of, text_of
from tessera.operators.index import SearchIndex, _column, free_name, with_ids

_SETTINGS = {name: {"bool": "boolean", "int": "int", "float": "float", "str": "string"}[str(SearchConfig.__dataclass_fields__[k].type)] for k, name in RECORD_NAMES.items()}
_RECORD = "type string, " + ", ".join(f"{n} {t}" for n, t in _SETTINGS.items()) + ", token string, vector struct<features:array<string>,weights:array<float>>, docId string, tokens array<string>"


def nested_vectors(vectors: DataFrame) -> DataFrame:
    """(token, vector): each token's features in order, with the weights beside them."""
    pairs = F.sort_array(F.collect_list(F.struct("feature", F.col("w").cast("float").alias("w"))))
    return vectors.groupBy("token").agg(pairs.alias("p")).select("token", F.struct(F.col("p.feature").alias("features"), F.col("p.w").alias("weights")).alias("vector"))


def records(index: SearchIndex) -> DataFrame:
    """(section, name, line) of all records; sections in the order of a snapshot."""
    spark = index.docs.sparkSession
    head = spark.createDataFrame([(0, "", json.dumps({"type": "metadata"} | index.config.record()))], "section int, name string, line string")
    vocab = nested_vectors(index.vectors).select(F.lit(1).alias("section"), F.col("token").alias("name"), F.to_json(F.struct(F.lit("vocab").alias("type"), "token", "vector")).alias("line"))
    if index.config.have_store:
        body = F.struct(F.lit("payload").alias("type"), "item", "tokens")
    else:
        body = F.struct(F.lit("token_payload").alias("type"), F.col("doc_id").alias("docId"), "tokens")
    docs = index.docs.select(F.lit(2).alias("section"), F.col("doc_id").alias("name"), F.to_json(body, {"ignoreNullFields": "false"}).alias("line"))
    return head.unionByName(vocab).unionByName(docs)


def export(index: SearchIndex, path: str, single_file: bool = False) -> None:
    """Writes the records as text; files in the order of their names are the snapshot, ``single_file`` makes it one."""
    ordered = records(index).orderBy("section", "name")
    (ordered.coalesce(1) if single_file else ordered).select("line").write.text(path)


def read_records(spark: SparkSession, path: str, item: T.StructType | str | None = None) -> DataFrame:
    """The records of lines or of one array; the type of ``item`` is inferred where it isn't given."""
    lines = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    reader = spark.read.option("multiLine", bool(lines) and lines[0].value.lstrip().startswith("["))
    if item is None:
        found = reader.json(path).schema
        item = found["item"].dataType if "item" in found.names else T.StructType([T.StructField("nothing", T.StringType())])
    schema = T.StructType([*T._parse_datatype_string(_RECORD).fields, T.StructField("item", T._parse_datatype_string(item) if isinstance(item, str) else item)])
    return reader.schema(schema).json(path)


def restore(spark: SparkSession, path: str, text: str | Column = "text", key: str | Column = "key", item: T.StructType | str | None = None) -> SearchIndex:
    """The index of a snapshot, with its settings, vectors and (where it has one) store."""
    rows = read_records(spark, path, item)
    head = rows.where("type = 'metadata'").select(*_SETTINGS).first()
    config = SearchConfig.of_record(head.asDict()) if head else SearchConfig()
    bare = rows.where("type = 'token_payload'").select(F.col("docId").alias("doc_id"), "tokens", "item")
    docs = bare.select("doc_id", text_of(F.col("doc_id")).alias("text"), key_of(F.col("doc_id")).alias("key"), "tokens", "item")
    if config.have_store:
        fields = [f.name for f in rows.schema["item"].dataType.fields]
        words, whole = free_name("_tokens", fields), free_name("_item", fields)  # an item may have columns of any name
        stored = rows.where("type = 'payload'").select(F.col("tokens").alias(words), F.col("item").alias(whole), "item.*")
        docs = docs.unionByName(stored.select(doc_id(_column(text), _column(key)).alias("doc_id"), F.coalesce(_column(text), F.lit("")).alias("text"), F.coalesce(_column(key).cast("string"), F.lit("")).alias("key"), F.col(words).alias("tokens"), F.col(whole).alias("item")))
    once = docs.withColumn("seq", F.monotonically_increasing_id()).groupBy("doc_id").agg(F.max_by(F.struct("text", "key", "tokens", "item"), "seq").alias("d")).select("doc_id", "d.*")
    docs = with_ids(once)
    long = rows.where("type = 'vocab'").select("token", F.explode(F.arrays_zip(F.col("vector.features").alias("feature"), F.col("vector.weights").alias("w"))).alias("f"))
    vectors = long.select("token", F.col("f.feature").alias("feature"), F.col("f.w").cast("double").alias("w"))
    # as in any index, the vocabulary is that of the documents that are there
    live = docs.select(F.explode("tokens").alias("token")).distinct()
    return SearchIndex(docs, config, text, key, vectors_table=vectors.join(live, "token", "left_semi"))
