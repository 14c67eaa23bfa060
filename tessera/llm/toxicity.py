"""Toxic documents by a counterfactually regularised linear classifier.

A document is the set of its lower-cased words and of the first 4, 5 and 6 bytes of longer words.
Logistic regression over the features that mark toxic rows of the labelled sample is trained with
a further penalty: wherever a labelled document names a group (``IDENTITY``), the name is swapped
for each other name of its kind and for none, and the squared change of the score is added to the loss. Names
of groups thus can't carry the blame for the company they keep in the labels.

The labelled sample is the only thing that is bounded: ``SAMPLE`` texts of either label in the order
of a hash of their ids, and of these whole texts until half of ``SAMPLE_BYTES``; texts of more than
a thirty-second of ``SAMPLE_BYTES`` aren't sampled, so that a few can't take the place of all.
Every document is scored, over its whole text.

Defined results: null and empty texts score as the empty set and are kept; labels that are null or
of unknown documents are ignored; a document labelled both ways counts as toxic; of rows that share
a labelled id each text is a sample of its own, repeated ones once; where the labels lack one of the two classes nothing is toxic; repeated rows score alike; other columns are not
read. A row with a null id is scored like any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.llm.tables import batched, table
from tessera.llm.words import Words, chunked, words, words_of

SAMPLE = 3000
SAMPLE_BYTES = 48 << 20
FEATURES = 3000
MIN_TOXIC = 3
THRESHOLD = 0.5
PENALTY = 4.0
RIDGE = 1e-3
PREFIXES = (4, 5, 6)
IDENTITY = (
    ("women", "men", "girls", "boys", "mothers", "fathers", "woman", "man"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "sikhs"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "sikh"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("black", "white", "asian", "latino", "indigenous", "arab", "african", "european"),
    ("immigrants", "refugees", "natives", "foreigners", "citizens"),
    ("deaf", "blind", "disabled", "autistic"),
    ("young", "old", "elderly", "teenagers"),
    ("frauen", "männer", "juden", "muslime", "christen"),
    ("mujeres", "hombres", "judíos", "musulmanes", "cristianos"),
    ("femmes", "hommes", "juifs", "musulmans", "chrétiens"),
)
_BUCKETS = 1 << 18


def _keys(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Every (text, feature); repeated ones too."""
    owner = w.owner()
    heads = [h != 0 for h in w.heads]
    return np.concatenate([owner, *(owner[k] for k in heads)]), np.concatenate([w.hash, *(h[k] for h, k in zip(w.heads, heads))])


def _distinct(owner: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort((owner.astype(np.uint64) << np.uint64(40)) | (key >> np.uint64(24)))
    owner, key = owner[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], key[new]


@dataclass
class Model:
    """Sorted feature hashes with their weights."""

    keys: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    bias: float = -np.inf

    def __post_init__(self) -> None:
        self.there = np.zeros(_BUCKETS, bool)
        self.there[(self.keys % np.uint64(_BUCKETS)).astype(np.int64)] = True

    def places(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, place of the feature) of the features that the model knows."""
        owner, key = [], []
        for hashes in (w.hash, *w.heads):
            at = np.flatnonzero(self.there[(hashes % np.uint64(_BUCKETS)).astype(np.int64)])
            owner.append(np.searchsorted(w.first, at, "right") - 1)
            key.append(hashes[at])
        owner, key = np.concatenate(owner), np.concatenate(key)
        place = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        known = self.keys[place] == key if len(self.keys) else np.zeros(len(key), bool)
        pairs = np.unique(owner[known] * np.int64(len(self.keys) + 1) + place[known])
        return pairs // (len(self.keys) + 1), pairs % (len(self.keys) + 1)

    def score(self, w: Words) -> np.ndarray:
        owner, place = self.places(w)
        logit = self.bias + np.bincount(owner, self.weights[place] if len(place) else None, len(w.first) - 1).astype(float)
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40))) if np.isfinite(self.bias) else np.zeros(len(w.first) - 1)


def _select(chunks: list[tuple[Words, np.ndarray]], features: int) -> np.ndarray:
    """Features that hold for toxic documents far more often than for others, by the likelihood ratio."""
    total = {k: max(1, sum(int((y == k).sum()) for _, y in chunks)) for k in (True, False)}

    def counted(label: bool, among: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        found = [np.empty(0, np.uint64)]
        for w, y in chunks:
            owner, key = _keys(w)
            some = y[owner] == label
            owner, key = owner[some], key[some]
            if among is not None:
                some = np.isin(key, among)
                owner, key = owner[some], key[some]
            found.append(_distinct(owner, key)[1])
        return np.unique(np.concatenate(found), return_counts=True)

    toxic, n = counted(True, None)
    toxic, n = toxic[n >= MIN_TOXIC], n[n >= MIN_TOXIC]
    if not len(toxic):
        return toxic
    other, times = counted(False, toxic)
    m = np.zeros(len(toxic), np.int64)
    m[np.searchsorted(toxic, other)] = times
    p, q = (n + 0.5) / (total[True] + 1), (m + 0.5) / (total[False] + 1)
    gain = 2 * (n * np.log(p / q) + (total[True] - n) * np.log((1 - np.minimum(p, 1 - 1e-9)) / (1 - np.minimum(q, 1 - 1e-9))))
    good = np.flatnonzero((p > 2 * q) & (gain > 8))
    return np.sort(toxic[good[np.argsort(-gain[good], kind="stable")[:features]]])


def _swaps(identity: tuple[tuple[str, ...], ...]) -> dict[int, list[tuple[list[int], list[list[int]]]]]:
    """Word hash of each name -> its features and those of each other name of its kind, or of no name."""
    swaps: dict[int, list] = {}
    for kind in identity:
        w = words_of(list(kind), PREFIXES)
        each = [[int(w.hash[k]), *(int(h[k]) for h in w.heads if h[k])] for k in range(len(kind))]
        for k, own in enumerate(each):
            swaps.setdefault(own[0], []).append((own, [*each[:k], *each[k + 1 :], []]))
    return swaps


def train(texts: list[str] | pa.Array, toxic: list[int], penalty: float = PENALTY, identity: tuple[tuple[str, ...], ...] = IDENTITY, features: int = FEATURES, steps: int = 400) -> Model:
    """The classifier of labelled texts; without both labels, one that finds nothing."""
    y = np.array(toxic, bool)
    if not y.any() or y.all():
        return Model()
    chunks = []
    for lo, hi, data, offsets in chunked(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())):
        w = words(data, offsets, PREFIXES)
        w.data = w.start = w.end = np.empty(0)  # only hashes are needed from here on
        chunks.append((w, y[lo:hi]))
    swaps = _swaps(identity)
    named = np.array(sorted(swaps), np.uint64)
    mentions = [named[k] for w, _ in chunks for k in np.flatnonzero(np.isin(named, w.hash))]
    keys = _select(chunks, features)
    forced = [k for m in {int(x) for x in mentions} for own, others in swaps[m] for f in [own, *others] for k in f]
    model = Model(np.union1d(keys, np.array(forced, np.uint64)), np.empty(0), 0.0)
    if not len(model.keys):
        return Model()
    rows, places, base, change = [], [], 0, []
    for w, _ in chunks:
        owner, place = model.places(w)
        rows.append(owner + base)
        places.append(place)
        base += len(w.first) - 1
        here = np.flatnonzero(np.isin(w.hash, named))
        names, often = np.unique(_distinct(np.searchsorted(w.first, here, "right") - 1, w.hash[here])[1], return_counts=True)
        change += [(n / len(others), own, other) for name, n in zip(names.tolist(), often) for own, others in swaps[name] for other in others]
    rows, places, k = np.concatenate(rows), np.concatenate(places), len(model.keys)
    # rows of the counterfactual matrix: the features that a swap takes away and those that it brings
    find = lambda f: np.searchsorted(model.keys, np.array(f, np.uint64))
    swap_row = np.concatenate([np.full(len(a) + len(b), r) for r, (_, a, b) in enumerate(change)]) if change else np.empty(0, np.int64)
    swap_place = np.concatenate([np.concatenate([find(a), find(b)]) for _, a, b in change]) if change else np.empty(0, np.int64)
    swap_sign = np.concatenate([np.concatenate([np.ones(len(a)), -np.ones(len(b))]) for _, a, b in change]) if change else np.empty(0)
    often = np.array([n for n, _, _ in change])
    sample = np.where(y, 0.5 / y.sum(), 0.5 / (~y).sum())
    w, b = np.zeros(k), 0.0
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(rows, w[places], len(y)), -40, 40)))
        err = sample * (p - y)
        grad = np.append(np.bincount(places, err[rows], k) + 2 * RIDGE * w, err.sum())
        if change:
            delta = np.bincount(swap_row, swap_sign * w[swap_place], len(change)) * often / often.sum()
            grad[:k] += 2 * penalty * np.bincount(swap_place, swap_sign * delta[swap_row], k)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - move[:k], b - move[k]
    return Model(model.keys, w, float(b))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, **settings) -> Model:
    """The classifier of a bounded sample of labelled documents; ``sample`` is per label."""
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("_toxic")).where("_id is not null and _toxic in (0, 1)").groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    order = [F.xxhash64("_id"), F.col("_id")]
    chosen = known.where("_toxic = 1").orderBy(*order).limit(sample).unionByName(known.where("_toxic = 0").orderBy(*order).limit(sample))
    texts = docs.select(docs[key].cast("long").alias("_id"), docs[text].alias("_text")).where("_text is not null").where(F.octet_length("_text") <= sample_bytes // 32).join(F.broadcast(chosen), "_id").distinct()
    order.append(F.xxhash64("_text"))
    first = texts.where("_toxic = 1").orderBy(*order).limit(sample).unionByName(texts.where("_toxic = 0").orderBy(*order).limit(sample))
    so_far = F.sum(F.octet_length("_text").cast("long")).over(Window.partitionBy("_toxic").orderBy(*order))
    rows = first.withColumn("_bytes", so_far).where(F.col("_bytes") <= sample_bytes // 2).orderBy(*order).select("_toxic", "_text").toArrow()
    return train(rows.column(1).combine_chunks().cast(pa.large_string()) if rows.num_rows else [], rows.column(0).to_pylist(), **settings)


def scores(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunked(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.round(model.score(words(data, offsets, PREFIXES)), 6))], ["doc_id", "score"])

    return batched(docs).select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, "doc_id long, score double")


def toxic_documents(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD, **settings) -> DataFrame:
    """(doc_id, score) of the documents that the classifier rejects."""
    return scores(docs, fit(docs, labels, text, key, **settings), text, key).where(F.col("score") >= threshold)


def without_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD, **settings) -> DataFrame:
    """The rows that the classifier doesn't reject, in one pass over the table and without a join."""
    model = fit(docs, labels, text, key, **settings)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [model.score(words(data, offsets, PREFIXES)).round(6) < threshold for _, _, data, offsets in chunked(batch.column(place))]
            yield batch.filter(pa.array(np.concatenate(keep))) if keep else batch

    return batched(docs).mapInArrow(run, docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic documents of the whole table."""
    return toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op3_toxicity": op3_toxicity}
ORACLE_SQL: dict[str, str] = {}
