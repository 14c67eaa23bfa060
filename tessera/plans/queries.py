"""Queries over the shared tables, one for each operator or step, and the flagship searches."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import SearchConfig
from tessera.functions.features import cosines, raw_features, vectors
from tessera.functions.text import doc_id, key_of, query_tokens, text_of, tokens
from tessera.operators.heatmap import heatmap, highlighted, word_heatmap
from tessera.operators.index import SearchIndex, build
from tessera.operators.search import best_matches, best_tokens, by_token, candidate_ranges, candidates, find, find_items, length_penalty, proximity, query_terms, scored_tokens, scores, token_cosines
from tessera.sources.files import file_tree
from tessera.sources.lines import keyed_lines, read_lines
from tessera.sources.snapshot import export, restore
from tessera.sources.tables import fresh_path, table, written
from tessera.streaming.live import LiveIndex, search_stream, without_repeats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TYPOS = {"typos": "sml blu widgit", "swapped": "gdaget reg", "partial": "lar gre"}
WORDS = {"phrase": "small blue widget", "reordered": "widget blue", "two": "red gadget", "long": "large green gizmo part thing extra words"}
TERMS = {"nation": "nation 7", "prefix": "natoin", "number": "1"}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def asked(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """Queries as rows of the plan, for which no Python worker starts."""
    return spark.createDataFrame(pa.table([pa.array(c, pa.string()) for c in zip(*texts.items())], names=["query_id", "query"]))


def parts(spark: SparkSession, sf_dir: str, **settings) -> SearchIndex:
    return build(table(spark, sf_dir, "part"), "p_name", "p_partkey", SearchConfig(**settings), seq="p_partkey")


def shown(found: DataFrame) -> DataFrame:
    """Results without the arrays and the U+0000 that engines print differently."""
    id_ = F.col("doc_id")
    return found.select("query_id", "rank", text_of(id_).alias("text"), key_of(id_).alias("key"), F.array_join("tokens", " ").alias("tokens"), "score")


def part_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).vocabulary


@query
def tokenize_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct tokens of every part name, in order."""
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(tokens(F.col("p_name")), " ").alias("tokens"), F.size(tokens(F.col("p_name"))).alias("n_tokens"))


@query
def tokenize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct tokens of every document, in order."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(tokens(F.col("text")), " ").alias("tokens"), F.size(tokens(F.col("text"))).alias("n_tokens"))


@query
def query_tokenization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of each document as a query: the first five."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(query_tokens(F.col("text")), " ").alias("tokens"))


@query
def doc_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and key out of the composite identity."""
    id_ = doc_id(F.col("p_name"), F.col("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", text_of(id_).alias("text"), key_of(id_).alias("key"), F.length(id_).alias("size"))


@query
def postings_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverted index of part names."""
    index = parts(spark, sf_dir)
    return index.postings.join(index.docs.select("uid", "key"), "uid").select("token", "key", "pos")


@query
def vocabulary_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocabulary of all documents with the number of documents of each token."""
    return build(table(spark, sf_dir, "documents"), "text", "doc_id").postings.groupBy("token").agg(F.count("*").alias("n_docs"), F.min("pos").alias("first_pos"))


@query
def char_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit vectors of the vocabulary of part names and nations."""
    both = part_tokens(spark, sf_dir).union(build(table(spark, sf_dir, "nation"), "n_name", "n_nationkey").vocabulary).distinct()
    return vectors(both).select("token", "feature", F.round("w", 9).alias("w"))


@query
def raw_char_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of part types before accumulation, as a multiset."""
    words = build(table(spark, sf_dir, "part"), "p_type", "p_partkey").vocabulary
    return words.select("token", F.inline(raw_features(F.col("token")))).groupBy("token", "feature", "w").agg(F.count("*").alias("times"))


@query
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Norm and number of features of each vector."""
    return vectors(part_tokens(spark, sf_dir)).groupBy("token").agg(F.round(F.sqrt(F.sum(F.col("w") * F.col("w"))), 9).alias("norm"), F.count("*").alias("n_features"))


@query
def token_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosines of all pairs of tokens of part names."""
    v = vectors(part_tokens(spark, sf_dir))
    return cosines(v, v).select("a", "b", F.round("cos", 9).alias("cos"))


class _Steps:
    """The steps of a search over parts; each is made once, when it is first asked for, and what later steps read again is written."""

    def __init__(self, spark: SparkSession, sf_dir: str, texts: dict[str, str]) -> None:
        self.index = parts(spark, sf_dir).saved(fresh_path(spark, "index"))
        self.terms = F.broadcast(query_terms(asked(spark, texts), self.index.config))
        self.keys = self.index.docs.select("uid", "key")

    @cached_property
    def near(self) -> DataFrame:
        return written(token_cosines(self.index, self.terms), "cosines")

    @cached_property
    def best(self) -> DataFrame:
        return written(best_tokens(self.index, self.terms, self.near), "best")

    @cached_property
    def ranges(self) -> DataFrame:
        return written(candidate_ranges(self.index, self.terms, self.best), "candidates")

    @cached_property
    def docs(self) -> DataFrame:
        pairs = self.terms.join(self.best, "qtoken").select("query_id", "token").distinct().collect()
        return candidates(self.index, self.ranges, sorted((r.query_id, r.token) for r in pairs))

    @cached_property
    def scored(self) -> DataFrame:
        return written(scored_tokens(self.index, self.terms, self.near, self.docs), "scored")

    @cached_property
    def matches(self) -> DataFrame:
        return best_matches(self.docs, by_token(self.scored))


@query
def vocabulary_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best vocabulary tokens of each query token."""
    return _Steps(spark, sf_dir, TYPOS).best.select("qtoken", "token", "cos", "rank")


@query
def candidate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with the range of places of their hits."""
    s = _Steps(spark, sf_dir, TYPOS)
    return s.ranges.join(s.keys, "uid").select("query_id", "key", "lo", "hi")


@query
def scored_window_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that count for a query, with their cosines."""
    s = _Steps(spark, sf_dir, TYPOS)
    return s.scored.join(s.terms.select("query_id", "j", "qtoken"), ["query_id", "j"]).select("query_id", "token", "qtoken", "cos")


@query
def best_token_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best token of each candidate for each query token."""
    s = _Steps(spark, sf_dir, TYPOS)
    matches = s.matches.join(s.keys, "uid").select("query_id", "key", F.inline("matches"))
    return matches.join(s.terms.select("query_id", "j", "qtoken"), ["query_id", "j"]).select("query_id", "key", "qtoken", "cos", "pos")


@query
def candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all candidates, before any ranking."""
    s = _Steps(spark, sf_dir, WORDS)
    return scores(s.matches, s.terms, SearchConfig()).join(s.keys, "uid").select("query_id", "key", "score")


@query
def find_single_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single words over part names."""
    return shown(find(parts(spark, sf_dir), asked(spark, {"exact": "widget", "typo": "gizom", "letter": "g", "nothing": "???", "blank": "  "})))


@query
def find_multi_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several words over part names; of more than five the first five count."""
    return shown(find(parts(spark, sf_dir), asked(spark, WORDS)))


@query
def find_typos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: misspelt queries of several words over part names."""
    return shown(find(parts(spark, sf_dir), asked(spark, TYPOS)))


@query
def find_multi_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part name of every brand as a query against nation names: a batch of queries in one plan."""
    index = build(table(spark, sf_dir, "nation"), "n_name", "n_nationkey")
    queries = table(spark, sf_dir, "part").select(F.col("p_name").alias("query_id"), F.col("p_name").alias("query")).distinct().union(asked(spark, TERMS))
    return shown(find(index, queries))


@query
def find_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A large vocabulary of numbers."""
    index = build(table(spark, sf_dir, "customer"), "c_name", "c_custkey")
    return shown(find(index, asked(spark, {"number": "customer 000000017", "typo": "custmer 00000099", "cut": "cust"})))


@query
def find_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents: long token lists, many positions and the penalty of length."""
    index = build(table(spark, sf_dir, "documents"), "text", "doc_id").saved(fresh_path(spark, "index"))
    found = find(index, asked(spark, {"en": "th the oution", "de": "der einung", "typo": "licnsed unter", "one": "worthles"}))
    return found.select("query_id", "rank", key_of(F.col("doc_id")).alias("key"), "score")


@query
def late_dedup_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many texts of one key: a result has the best of each key."""
    return shown(find(build(table(spark, sf_dir, "part"), "p_name", "p_brand"), asked(spark, TYPOS)))


@query
def find_with_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other weights, sizes and separators than the defaults."""
    index = parts(spark, sf_dir, max_results=3, window_slack=0, adjacency_bonus=0.9, char_bag_weight=0.0, max_ngram=2)
    return shown(find(index, asked(spark, WORDS)))


@query
def find_stored_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results with the stored source rows."""
    return find_items(parts(spark, sf_dir, have_store=True), asked(spark, TYPOS)).select("query_id", "rank", "score", "p_partkey", "p_name", "p_brand", "p_size")


@query
def first_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several rows with one text and key the first is stored."""
    index = build(table(spark, sf_dir, "part"), "p_name", "p_brand", SearchConfig(have_store=True), seq="p_partkey")
    return index.items().select("p_name", "p_brand", "p_partkey", "p_size")


@query
def add_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large parts added to small ones: documents that are there already stay as they are."""
    rows = table(spark, sf_dir, "part")
    config = SearchConfig(have_store=True)
    index = build(rows.where("p_size <= 25"), "p_name", "p_brand", config, seq="p_partkey").added(rows.where("p_size > 10"), seq="p_partkey")
    return index.items().select("p_name", "p_brand", "p_partkey")


@query
def contains_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose text and key an index of small parts has."""
    rows = table(spark, sf_dir, "part")
    return build(rows.where("p_size <= 10"), "p_name", "p_brand").contains(rows).select("p_partkey")


@query
def remove_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings after large parts were removed."""
    rows = table(spark, sf_dir, "part")
    index = build(rows, "p_name", "p_partkey").removed(rows.where("p_size > 10"))
    return index.postings.groupBy("token").agg(F.count("*").alias("n_docs"))


@query
def clear_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cleared index to which small parts are added."""
    rows = table(spark, sf_dir, "part")
    index = build(rows, "p_name", "p_partkey").cleared().added(rows.where("p_size < 5"))
    return index.docs.select("text", "key", "n_tokens")


@query
def index_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, postings and vocabulary of all documents and of part names by brand."""
    one = build(table(spark, sf_dir, "documents"), "text", "doc_id")
    two = build(table(spark, sf_dir, "part"), "p_name", "p_brand")
    row = lambda name, i: i.docs.select(F.lit(name).alias("name"), F.size("tokens").alias("n"), F.explode_outer("tokens").alias("token"), "uid").agg(F.lit(name).alias("name"), F.count_distinct("uid").alias("docs"), F.count("token").alias("postings"), F.count_distinct("token").alias("vocabulary"))
    return row("documents", one).union(row("parts", two))


@query
def merge_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index merged with another, whose documents replace equal ones."""
    rows = table(spark, sf_dir, "part")
    config = SearchConfig(have_store=True)
    of = lambda some: build(some, "p_name", "p_brand", config, seq="p_partkey")
    return of(rows.where("p_size <= 25")).merged(of(rows.where("p_size > 10"))).items().select("p_name", "p_brand", "p_partkey")


@query
def length_penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Penalty of the number of distinct tokens."""
    return table(spark, sf_dir, "documents").select("doc_id", F.round(length_penalty(F.size(tokens(F.col("text")))), 9).alias("penalty"))


def _places() -> Column:
    return F.array_sort(F.transform(F.filter(F.split("props", ""), lambda c: c != ""), lambda c: F.ascii(c)))


@query
def proximity_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearness of sorted places; here the places are the codes of each event's properties."""
    rows = table(spark, sf_dir, "events").where("props is not null")
    return rows.select("event_id", F.round(proximity(_places(), F.lit(3)), 9).alias("near"))


@query
def query_token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that each part's name shares with its type's or has beyond it."""
    name, kind = tokens(F.col("p_name")), tokens(F.concat_ws(" ", "p_type", F.lit("small red widget")))
    join = lambda a: F.array_join(F.array_sort(a), " ")
    return table(spark, sf_dir, "part").select("p_partkey", join(F.array_intersect(name, kind)).alias("shared"), join(F.array_except(name, kind)).alias("only_name"), join(F.array_except(kind, name)).alias("only_type"))


@query
def snapshot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index written as lines of JSON, restored and listed."""
    path = fresh_path(spark, "snapshot")
    export(parts(spark, sf_dir, have_store=True), path)
    return restore(spark, path, "p_name", "p_partkey").docs.select("text", "key", F.array_join("tokens", " ").alias("tokens"), F.col("item.p_size").alias("p_size"))


@query
def snapshot_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of a restored index without a store."""
    path = fresh_path(spark, "snapshot")
    export(parts(spark, sf_dir), path)
    return restore(spark, path).vectors.select("token", "feature", F.round("w", 4).alias("w"))


@query
def snapshot_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searching a restored index; its vectors come from the snapshot, as single-precision numbers."""
    path = fresh_path(spark, "snapshot")
    export(parts(spark, sf_dir), path)
    return shown(find(restore(spark, path), asked(spark, TYPOS))).withColumn("score", F.round("score", 3))


@query
def snapshot_self_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of texts that are their own keys, written, restored and searched."""
    path = fresh_path(spark, "snapshot")
    export(build(table(spark, sf_dir, "part"), "p_name", config=SearchConfig(have_store=True), seq="p_partkey"), path)
    back = restore(spark, path, "p_name", "p_name")
    return back.docs.select("text", "key", F.col("item.p_partkey").alias("p_partkey"))


@query
def find_self_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are their own keys: an empty index to which names are added."""
    index = build(table(spark, sf_dir, "part").limit(0), "p_name").added(table(spark, sf_dir, "part"))
    return shown(find(index, asked(spark, TYPOS)))


@query
def tsv_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key and title from lines, here from all lines of all documents."""
    lines = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("value"))
    return keyed_lines(lines).groupBy("key").agg(F.count("*").alias("n"), F.min("title").alias("least"), F.max("title").alias("most"))


@query
def read_keyed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines out of files of text."""
    path = fresh_path(spark, "lines")
    table(spark, sf_dir, "part").select(F.concat("p_partkey", F.lit("\t"), "p_name", F.lit(" \r"))).repartition(3).write.text(path)
    return read_lines(spark, path)


@query
def crawl_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the files of a tree, found by an inexact name."""
    path = fresh_path(spark, "tree")
    table(spark, sf_dir, "nation").select("n_name", "n_regionkey", "n_nationkey").repartition(2).write.partitionBy("n_regionkey", "n_nationkey").text(path)
    tree = file_tree(spark, path).where("name like 'part-%'")
    return tree.select(F.regexp_extract("path", "n_nationkey=([0-9]+)", 1).cast("int").alias("n_nationkey"), F.regexp_extract("path", "n_regionkey=([0-9]+)", 1).cast("int").alias("n_regionkey")).distinct()


@query
def word_heatmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which characters of each part's brand its type explains."""
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(word_heatmap(F.col("p_type"), F.col("p_brand")), lambda x: x["tier"].cast("string")), ",").alias("tiers"))


@query
def heatmap_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which characters of each part's name the misspelt queries explain."""
    index = parts(spark, sf_dir)
    pairs = index.docs.select("doc_id").crossJoin(F.broadcast(asked(spark, TYPOS)))
    return heatmap(index, pairs).select("query_id", key_of(F.col("doc_id")).alias("key"), F.array_join(F.transform("chars", lambda x: x["tier"].cast("string")), ",").alias("tiers"))


@query
def highlight_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results with coloured matches."""
    index = parts(spark, sf_dir)
    queries = asked(spark, TYPOS)
    found = find(index, queries).join(queries, "query_id")
    return heatmap(index, found.select("query_id", "rank", "query", "doc_id")).select("query_id", "rank", highlighted(F.col("chars")).alias("shown"))


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream of several files, so that there are several micro-batches."""
    rows = table(spark, sf_dir, name)
    path = fresh_path(spark, name)
    rows.repartition(4).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(path)


@query
def streaming_index_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index that a stream fills, with standing queries; equals the batch search."""
    path = fresh_path(spark, "live")
    live = LiveIndex(spark, path, "p_name", "p_partkey")
    live.ask(asked(spark, TYPOS))
    live.start(_stream(spark, sf_dir, "part"), f"{path}-checkpoint").awaitTermination()
    return shown(live.results())


@query
def streaming_remove_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream fills an index of texts that are their own keys, then the parts beyond a size are taken out; equals an index without them."""
    path = fresh_path(spark, "live")
    live = LiveIndex(spark, path, "p_name", "p_name")
    live.start(_stream(spark, sf_dir, "part"), f"{path}-checkpoint").awaitTermination()
    live.remove(table(spark, sf_dir, "part").where("p_name like '%e'"))
    live.ask(asked(spark, TYPOS))
    return shown(live.results())


@query
def streaming_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of queries (nation names) against an index that stays."""
    path = fresh_path(spark, "answers")
    index = build(table(spark, sf_dir, "region"), "r_name", "r_regionkey")
    stream = _stream(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("query_id"), F.col("n_name").alias("query"))
    search_stream(index, stream, path, f"{path}-checkpoint").awaitTermination()
    return shown(spark.read.parquet(path).drop("batch"))


@query
def streaming_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream without identities that it had before."""
    path = fresh_path(spark, "once")
    rows = without_repeats(_stream(spark, sf_dir, "part"), "p_name", "p_brand").select("p_name", "p_brand")
    rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path)
