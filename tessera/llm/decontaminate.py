"""Documents that contain test items, by greedy string tiling.

Words are lower-cased and hashed. Every run of ``match`` words of a document is looked up among
those of the benchmark by its Karp-Rabin hash; hits on one diagonal (document place minus item
place) that follow each other are one match. The longest match of a document with an item is
marked first, what is left of the others is cut at the marks, and so on until no unmarked match
of ``match`` words is left. An item is contained where the marked tiles cover at least
``threshold`` of its words, in whatever order they stand in the document.

Items of fewer than ``match`` words are looked up as wholes. Up to ``broadcast_seeds`` hashes of the
benchmark go to every executor; beyond that only their bitmap does, and the runs of documents that
it lets through meet the benchmark's in a join on the hash, with equal results.

Defined results: rows with null id or text, and items with null id or text or without a word, match
nothing; an item text under several ids is reported for each; rows that share an id, of documents
or of items, are tiled each for itself, and the pair gets the best of them; an empty table gives no
rows; other columns are not read. Between equally long matches the one that starts first in the item, then in the document, is
marked first.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import short_id
from tessera.llm.tables import among, batched, bitmap, bits, free, held, table, without, written
from tessera.llm.words import chunked, mix, words

MATCH = 5
THRESHOLD = 0.5
BROADCAST_SEEDS = 4_000_000
_P = 0x9E3779B97F4A7C15 | 1


def runs(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of every run of ``n`` words that lies within one text, by a rolling polynomial over word hashes."""
    if len(hashes) < n:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    total = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        total = total * np.uint64(_P) + hashes[k : len(hashes) - n + 1 + k]
    inside = np.ones(len(total), bool)
    for k in range(1, n):
        cut = first[1:-1] - k
        inside[cut[(cut >= 0) & (cut < len(inside))]] = False
    at = np.flatnonzero(inside)
    return at, mix(total[at] + np.uint64(n))


def tiles(i: np.ndarray, j: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """(item place, document place, length) of the tiles, from hits ``i[k], j[k]`` of runs of ``n`` words."""
    order = np.lexsort((i, j - i))
    i, j = i[order], j[order]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(i) != 1) | (np.diff(j) != 1)]))
    length = np.diff(np.append(new, len(i))) + n - 1
    queue = [(-int(m), int(a), int(b)) for m, a, b in zip(length, i[new], j[new])]
    heapq.heapify(queue)
    item, doc, found = set(), set(), []
    while queue:
        m, a, b = heapq.heappop(queue)
        free = [a + k not in item and b + k not in doc for k in range(-m)]
        if all(free):
            found.append((a, b, -m))
            item.update(range(a, a - m))
            doc.update(range(b, b - m))
            continue
        start = None
        for k, is_free in enumerate([*free, False]):
            if is_free and start is None:
                start = k
            elif not is_free and start is not None:
                if k - start >= n:
                    heapq.heappush(queue, (start - k, a + start, b + start))
                start = None
    return found


def _judged(i: np.ndarray, j: np.ndarray, n: int, size: int, threshold: float) -> tuple[float, int, int] | None:
    """(coverage, tiles, longest) if the tiles cover enough of an item of ``size`` words."""
    if len(np.unique((np.unique(i)[:, None] + np.arange(n)).ravel())) < threshold * size - 1e-9:
        return None
    found = tiles(i, j, n)
    covered = sum(t[2] for t in found) / size
    return (round(covered, 6), len(found), max(t[2] for t in found)) if covered >= threshold - 1e-9 else None


def _seeds(match: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunked(batch.column(1)):
                w = words(data, offsets)
                size = np.diff(w.first)
                for n in np.unique(np.minimum(size, match)):
                    if n:
                        at, seed = runs(w.hash, w.first, int(n))
                        owner = np.searchsorted(w.first, at, "right") - 1
                        keep = np.minimum(size[owner], match) == n
                        owner, at, seed = owner[keep], at[keep], seed[keep]
                        ids, forms = (batch.column(c).slice(lo, hi - lo).take(pa.array(owner)) for c in (0, 2))
                        yield pa.RecordBatch.from_arrays([ids, forms, pa.array(seed.view(np.int64)), pa.array(at - w.first[owner]), pa.array(size[owner]), pa.array(np.full(len(at), n, np.int64))], ["item_id", "form", "seed", "i", "size", "n"])

    return run


def item_seeds(benchmark: DataFrame, match: int = MATCH, text: str = "text", key: str = "item_id") -> DataFrame:
    """(item_id, form, seed, i, size, n): the hash of every run of n words at place i of an item of ``size`` words; ``form`` tells the texts of an id apart."""
    items = benchmark.select(benchmark[key].cast("long").alias("item_id"), benchmark[text].alias("text")).where("item_id is not null and text is not null")
    texts = items.distinct().withColumn("form", F.xxhash64("text"))
    return batched(texts).mapInArrow(_seeds(match), "item_id long, form long, seed long, i long, size long, n long")


def _lookup(spark: SparkSession, seeds: pa.Table, threshold: float) -> Callable[[], Callable[[pa.Array], list[tuple[int, int, float, int, int]]]]:
    """What a worker starts to get a function from a column of texts to (row, item, coverage, tiles, longest) of the items in them."""
    seed = seeds.column("seed").to_numpy().view(np.uint64)
    order = np.argsort(seed, kind="stable")
    seed = seed[order]
    item, form, place, size, n_of = (seeds.column(c).to_numpy()[order] for c in ("item_id", "form", "i", "size", "n"))
    lengths = [int(n) for n in np.unique(n_of)]
    handle = spark.sparkContext.broadcast((seed, item, form, place, size, n_of))

    def start() -> Callable:
        seed, item, form, place, size, n_of = handle.value
        bits = max(16, int(len(seed)).bit_length() + 4)
        there = np.zeros(1 << bits, bool)
        there[(seed >> np.uint64(64 - bits)).astype(np.int64)] = True

        def look(texts: pa.Array) -> list[tuple[int, int, float, int, int]]:
            rows = []
            for lo, _, data, offsets in chunked(texts):
                w = words(data, offsets)
                for n in lengths:
                    at, hashes = runs(w.hash, w.first, n)
                    maybe = there[(hashes >> np.uint64(64 - bits)).astype(np.int64)]
                    at, hashes = at[maybe], hashes[maybe]
                    left, right = np.searchsorted(seed, hashes), np.searchsorted(seed, hashes, "right")
                    some = right > left
                    at, left, count = at[some], left[some], (right - left)[some]
                    if not len(at):
                        continue
                    which = np.repeat(left - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                    at = np.repeat(at, count)
                    owner = np.searchsorted(w.first, at, "right") - 1
                    order = np.lexsort((form[which], item[which], owner))
                    owner, at, which = owner[order], at[order], which[order]
                    cut = np.flatnonzero(np.concatenate([[True], (np.diff(owner) != 0) | (np.diff(item[which]) != 0) | (np.diff(form[which]) != 0), [True]]))
                    for a, b in zip(cut[:-1], cut[1:]):
                        k = which[a]
                        if n_of[k] == n and (found := _judged(place[which[a:b]], at[a:b] - w.first[owner[a]], n, int(size[k]), threshold)):
                            rows.append((lo + int(owner[a]), int(item[k]), *found))
            return rows

        return look

    return start


def _pairs_by_lookup(docs: DataFrame, seeds: pa.Table, threshold: float) -> DataFrame:
    start = _lookup(docs.sparkSession, seeds, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = start()
        for batch in batches:
            if rows := look(batch.column(1)):
                doc, *rest = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc, pa.int64())), pa.array(rest[0], pa.int64()), pa.array(rest[1], pa.float64()), pa.array(rest[2], pa.int32()), pa.array(rest[3], pa.int32())], ["doc_id", "item_id", "coverage", "tiles", "longest"])

    return docs.mapInArrow(run, _PAIR)


_PAIR = "doc_id long, item_id long, coverage double, tiles int, longest int"


def _lengths(seeds: DataFrame) -> list[int]:
    return [r.n for r in seeds.select("n").distinct().orderBy("n").collect()]


def _pairs_by_join(docs: DataFrame, seeds: DataFrame, lengths: list[int], threshold: float) -> DataFrame:
    """The pairs of ``docs``, whose ``doc_id`` may be a long or a binary digest."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    id_type = pa.binary() if kind == "binary" else pa.int64()
    known = seeds.select("seed").distinct()
    power = bits(known.count())
    marks = docs.sparkSession.sparkContext.broadcast(held(bitmap(known, power), power))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunked(batch.column(1)):
                w = words(data, offsets)
                # rows that share an id stay apart by a digest of all their words
                own = np.add.reduceat(np.append(mix(w.hash * np.uint64(3) + np.arange(len(w.hash), dtype=np.uint64) - np.repeat(w.first[:-1], np.diff(w.first)).astype(np.uint64)), np.uint64(0)), np.minimum(w.first[:-1], len(w.hash)))
                for n in lengths:
                    at, seed = runs(w.hash, w.first, n)
                    maybe = among(marks.value, seed)
                    at, seed = at[maybe], seed[maybe]
                    owner = np.searchsorted(w.first, at, "right") - 1
                    ids = batch.column(0).slice(lo, hi - lo).take(pa.array(owner))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(own[owner].view(np.int64)), pa.array(seed.view(np.int64)), pa.array(at - w.first[owner]), pa.array(np.full(len(at), n, np.int64))], ["doc_id", "row", "seed", "j", "n"])

    hits = docs.mapInArrow(run, f"doc_id {kind}, row long, seed long, j long, n long").join(seeds, ["seed", "n"])
    grouped = hits.groupBy("doc_id", "row", "item_id", "form").agg(F.first("n").alias("n"), F.first("size").alias("size"), F.collect_set(F.struct("i", "j")).alias("hits"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, hits = [], batch.column(4)
            first = hits.offsets.to_numpy() - hits.offsets[0].as_py()
            i, j = (hits.flatten().field(k).to_numpy() for k in range(2))
            for k, (doc, item, n, size) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)))):
                if found := _judged(i[first[k] : first[k + 1]], j[first[k] : first[k + 1]], n, size, threshold):
                    rows.append((doc, item, *found))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (id_type, pa.int64(), pa.float64(), pa.int32(), pa.int32()))], ["doc_id", "item_id", "coverage", "tiles", "longest"])

    return grouped.select("doc_id", "item_id", "n", "size", "hits").mapInArrow(judge, _PAIR.replace("doc_id long", f"doc_id {kind}"))


def contained_items(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", match: int = MATCH, threshold: float = THRESHOLD, broadcast_seeds: int = BROADCAST_SEEDS
) -> DataFrame:
    """(doc_id, item_id, coverage, tiles, longest) of every document that contains a test item."""
    docs = batched(docs).select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")).where("doc_id is not null and text is not null")
    seeds = item_seeds(benchmark, match)
    own = seeds.limit(broadcast_seeds + 1).toArrow()
    if own.num_rows <= broadcast_seeds:
        pairs = _pairs_by_lookup(docs, own, threshold)
    else:
        pairs = _pairs_by_join(docs, seeds, _lengths(seeds), threshold)
    best = F.max(F.struct("coverage", -F.col("tiles"), "longest")).alias("best")
    return pairs.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.coverage", (-F.col("best.col2")).alias("tiles"), "best.longest")


def without_contained(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", match: int = MATCH, threshold: float = THRESHOLD, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """The rows whose text contains no test item, whatever their id; in one pass and without a join.

    Where the benchmark is too large to broadcast, the texts that contain an item are joined to the
    rows by a 128-bit digest, so that the same rows stay.
    """
    seeds = item_seeds(benchmark, match)
    own = seeds.limit(broadcast_seeds + 1).toArrow()
    if own.num_rows > broadcast_seeds:
        name, digest = free("_digest", docs), short_id(F.col(text))
        texts = batched(docs).select(digest.alias("doc_id"), F.col(text).alias("text")).where("text is not null")
        gone = written(_pairs_by_join(texts, seeds, _lengths(seeds), threshold).select("doc_id").distinct(), "contained")
        return without(docs.withColumn(name, digest), name, gone).select(docs.columns)
    start, place = _lookup(docs.sparkSession, own, threshold), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = start()
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[[r[0] for r in look(batch.column(place))]] = False
            yield batch.filter(pa.array(keep))

    return batched(docs).mapInArrow(run, docs.schema)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test items in all documents."""
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op10_decontaminate": op10_decontaminate}
ORACLE_SQL: dict[str, str] = {}
