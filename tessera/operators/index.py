"""A search index as three tables: documents, postings and the vocabulary's vectors.

An index is a value: adding and removing documents give a new one, and the old one stays as it was.
All tables are plans until ``saved`` writes them. Written postings and vectors are carried on: what
is added is embedded by itself, and what is removed is taken out of them.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import SearchConfig
from tessera.functions.features import vectors
from tessera.functions.text import doc_id, short_id, tie, tokens

#: Columns of ``SearchIndex.docs``.
DOCS = ("uid", "kid", "tie", "doc_id", "text", "key", "tokens", "n_tokens", "item")


def _column(of: str | Column) -> Column:
    return F.expr(of) if isinstance(of, str) else of


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores before it while a column has that name already."""
    while name.lower() in {t.lower() for t in taken}:
        name = f"_{name}"
    return name


@dataclass(frozen=True)
class SearchIndex:
    """``docs``: one row for each text and key; ``item`` is the source row, or null without a store.

    ``uid`` and ``kid`` are short ids of text and key together and of the key, ``tie`` orders
    documents of equal scores. ``vectors_table`` and ``postings_table`` are set where they were
    written; else they are derived.
    """

    docs: DataFrame
    config: SearchConfig = SearchConfig()
    text: str | Column = "text"
    key: str | Column = "key"
    postings_table: DataFrame | None = None
    vectors_table: DataFrame | None = None

    @property
    def postings(self) -> DataFrame:
        """(token, uid, pos): places count distinct tokens."""
        return self.postings_table if self.postings_table is not None else postings_of(self.docs)

    @property
    def vocabulary(self) -> DataFrame:
        """Distinct tokens of the documents that are there."""
        return self.postings.select("token").distinct()

    @property
    def vectors(self) -> DataFrame:
        return self.vectors_table if self.vectors_table is not None else vectors(self.vocabulary, self.config)

    def size(self) -> DataFrame:
        """One row with the number of documents."""
        return self.docs.agg(F.count("*").alias("size"))

    def items(self) -> DataFrame:
        """The stored source rows; none without a store."""
        return self.docs.where("item is not null").select("item.*") if self.config.have_store else self.docs.limit(0).select("item")

    def _with(self, kept: DataFrame, postings: DataFrame | None, fresh: DataFrame, fresh_vectors: DataFrame | None = None) -> SearchIndex:
        """``kept`` documents with their postings, and ``fresh`` ones, of whose tokens only those without a vector get one."""
        docs = kept.select(*DOCS).unionByName(fresh.select(*DOCS))
        if self.vectors_table is None or postings is None:
            return replace(self, docs=docs, postings_table=None, vectors_table=None)
        more = postings_of(fresh)
        known = self.vectors_table.select("token").distinct()
        if fresh_vectors is None:
            new = vectors(more.select("token").distinct().join(known, "token", "left_anti"), self.config)
        else:
            new = fresh_vectors.join(known, "token", "left_anti")
        return replace(self, docs=docs, postings_table=postings.unionByName(more), vectors_table=self.vectors_table.unionByName(new))

    def added(self, items: DataFrame, seq: str | None = None) -> SearchIndex:
        """With further items; of a text and key that are there already the present document stays."""
        new = documents(items, self.text, self.key, self.config, seq)
        return self._with(self.docs, self.postings_table, new.join(self.docs.select("uid"), "uid", "left_anti"))

    def removed(self, items: DataFrame) -> SearchIndex:
        """Without the documents of the items; tokens that no document has any more leave the vocabulary."""
        gone = identities(items, self.text, self.key)
        docs = self.docs.join(gone, "uid", "left_anti").select(*DOCS)
        if self.vectors_table is None or self.postings_table is None:
            return replace(self, docs=docs, postings_table=None, vectors_table=None)
        left, dead = without_documents(self.postings_table, gone)
        return replace(self, docs=docs, postings_table=left, vectors_table=self.vectors_table.join(dead, "token", "left_anti"))

    def cleared(self) -> SearchIndex:
        return replace(self, docs=self.docs.limit(0), postings_table=None, vectors_table=None)

    def merged(self, other: SearchIndex) -> SearchIndex:
        """With another index's documents, which replace equal ones; all settings of the two have to be equal."""
        if other.config != self.config:
            raise ValueError("indexes of different settings can't be merged")
        ids = other.docs.select("uid")
        postings = self.postings_table.join(ids, "uid", "left_anti").select("token", "uid", "pos") if self.postings_table is not None else None
        return self._with(self.docs.join(ids, "uid", "left_anti"), postings, other.docs, other.vectors_table)

    def contains(self, items: DataFrame) -> DataFrame:
        """The items whose document is there."""
        name = free_name("_uid", items.columns)
        found = self.docs.select(F.col("uid").alias(name))
        return items.withColumn(name, uid(self.text, self.key)).join(found, name, "left_semi").drop(name)

    def saved(self, path: str) -> SearchIndex:
        """Written as Parquet and read back: documents, postings and the vocabulary (or vectors that were given).

        Each task writes the postings of the documents that it reads, in the order of tokens, so that
        lookups skip pages and nothing is shuffled. They name documents by numbers, which take some
        13 bits; a short id takes 16 bytes. Vectors are made from the vocabulary as they are read.
        """
        spark = self.docs.sparkSession

        def kept(rows: DataFrame, name: str) -> DataFrame:
            rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
            return spark.read.parquet(f"{path}/{name}")

        docs = kept(self.docs.drop("doc_id").withColumn("num", F.monotonically_increasing_id()), "docs")
        numbered = kept(docs.select("num", F.posexplode("tokens").alias("pos", "token")).select("token", "num", "pos").sortWithinPartitions("token", "num"), "postings")
        postings = numbered.join(docs.select("num", "uid"), "num", "left").select("token", "uid", "pos")
        if self.vectors_table is not None:
            made = kept(self.vectors_table, "vectors")
        else:
            made = vectors(kept(numbered.select("token").distinct(), "vocabulary").repartition("token"), self.config)
        return replace(self, docs=with_doc_id(docs), postings_table=postings, vectors_table=made)


def postings_of(docs: DataFrame) -> DataFrame:
    return docs.select("uid", F.posexplode("tokens").alias("pos", "token")).select("token", "uid", "pos")


def sorted_postings(postings: DataFrame) -> DataFrame:
    """Each task's postings in the order of tokens, so that pages without a token are skipped; nothing is shuffled."""
    return postings.sortWithinPartitions("token")


def without_documents(postings: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The postings that stay, and the tokens that only documents of ``gone(uid)`` had."""
    left = postings.join(gone, "uid", "left_anti").select("token", "uid", "pos")
    touched = postings.join(gone, "uid", "left_semi").select("token").distinct()
    return left, touched.join(left.select("token"), "token", "left_anti")


def uid(text: str | Column, key: str | Column) -> Column:
    return short_id(doc_id(_column(text), _column(key)))


def identities(items: DataFrame, text: str | Column, key: str | Column) -> DataFrame:
    return items.select(uid(text, key).alias("uid")).distinct()


def with_ids(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, key, tokens, item)`` with all columns of an index's documents."""
    named = docs.withColumns({"uid": short_id(F.col("doc_id")), "kid": short_id(F.col("key")), "tie": tie(F.col("text"), F.col("key")), "n_tokens": F.size("tokens")})
    return named.select(*DOCS)


def with_doc_id(docs: DataFrame) -> DataFrame:
    """Documents as they were written, which leaves the identity out: it is their text and key."""
    return docs.withColumn("doc_id", doc_id(F.col("text"), F.col("key"))).select(*DOCS)


def documents(items: DataFrame, text: str | Column, key: str | Column, config: SearchConfig = SearchConfig(), seq: str | None = None) -> DataFrame:
    """One document for each text and key: the first in the order of ``seq`` (or of the rows as they are read).

    Only where several rows share an identity are rows compared; the aggregation takes the least
    ``seq`` on the map side already.
    """
    item = F.struct(*[items[c] for c in items.columns]) if config.have_store else F.lit(None).cast("struct<nothing:string>")
    order = F.expr(seq) if seq else F.monotonically_increasing_id()
    rows = items.select(uid(text, key).alias("uid"), F.coalesce(_column(text), F.lit("")).alias("text"), F.coalesce(_column(key).cast("string"), F.lit("")).alias("key"), item.alias("item"), order.alias("seq"))
    if config.have_store:
        first = rows.groupBy("uid").agg(F.min_by(F.struct("text", "key", "item"), "seq").alias("d")).select("d.*")
    else:  # rows of one identity are equal then
        first = rows.groupBy("uid").agg(F.first("text").alias("text"), F.first("key").alias("key"), F.first("item").alias("item")).drop("uid")
    return with_ids(first.withColumns({"doc_id": doc_id(F.col("text"), F.col("key")), "tokens": tokens(F.col("text"), config)}))


def build(items: DataFrame, text: str | Column = "text", key: str | Column | None = None, config: SearchConfig = SearchConfig(), seq: str | None = None) -> SearchIndex:
    """An index of a table; without ``key`` the text is its own key."""
    key = text if key is None else key
    return SearchIndex(documents(items, text, key, config, seq), config, text, key)


def empty(spark: SparkSession, config: SearchConfig = SearchConfig()) -> SearchIndex:
    return build(spark.createDataFrame([], "text string, key string"), "text", "key", config)
