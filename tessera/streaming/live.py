"""A search index that a stream fills and that answers standing queries after every micro-batch.

The index lies in a folder: one part for each micro-batch (documents, postings and the vectors of
tokens that no earlier part has), and *states*. A state is a small file that names the parts and the
results that belong together. Parts are written first, under names of their own, and the state is
put in place by a rename: who reads sees the whole of a change or nothing of it. A batch that is run
again after a failure replaces its own part and nothing else. After ``COMPACT`` batches the earlier
parts are written as one.
"""

from __future__ import annotations

import json
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.config import SearchConfig
from tessera.functions.features import vectors
from tessera.operators.index import SearchIndex, documents, free_name, identities, postings_of, sorted_postings, uid, with_doc_id, without_documents
from tessera.operators.search import find
from tessera.sources.tables import delete, scratch

COMPACT = 32
#: So many states stay, with their parts, for those who still read them.
KEPT = 3
_TABLES = ("docs", "postings", "vectors")


class LiveIndex:
    """The folder of an index, and what is asked of it.

    ``queries(query_id, query)`` may be replaced at any time (``ask``) and are answered at once, and
    again after each batch; only the latest ones are. Without ``seq`` the first row of an identity
    within a batch is any of them. One process writes to a folder at a time.
    """

    def __init__(self, spark: SparkSession, path: str, text: str | Column = "text", key: str | Column = "key", config: SearchConfig = SearchConfig(), seq: str | None = None) -> None:
        self.spark, self.path, self.text, self.key, self.config, self.seq = spark, path, text, key, config, seq
        self.queries: DataFrame | None = None
        self._lock = threading.RLock()

    def ask(self, queries: DataFrame | None) -> None:
        """Replaces the standing queries; with an index there, their results are there when this returns."""
        with self._lock:
            self.queries = queries
            state = self._state()
            if state["parts"]:
                self._publish(state)

    # states ---------------------------------------------------------------------------------------

    def _fs(self):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/states")
        return folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        folder, fs = self._fs()
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n) for n in names if n.isdigit())

    def _state(self, version: int | None = None) -> dict:
        """{version, parts: {batch: {table: path}}, results: path}; the latest one, if none is named."""
        if version is None:
            versions = self._versions()
            if not versions:
                return {"version": -1, "parts": {}, "results": None}
            version = versions[-1]
        folder, fs = self._fs()
        stream = fs.open(self.spark._jvm.org.apache.hadoop.fs.Path(folder, str(version)))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _publish(self, state: dict) -> None:
        """Answers the standing queries from the parts of ``state`` and makes it the latest one."""
        state = {"version": state["version"] + 1, "parts": state["parts"], "results": None}
        if self.queries is not None:
            with scratch(self.spark):
                state["results"] = self._write(find(self._index(state), self.queries), "results")
        folder, fs = self._fs()
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        hidden = path(folder, f".{uuid.uuid4().hex}")
        out = fs.create(hidden, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not fs.rename(hidden, path(folder, str(state["version"]))):
            raise RuntimeError(f"state {state['version']} is there already: another process writes to {self.path}")
        self._clean()

    def _clean(self) -> None:
        """Deletes states that nobody should read any more, and what only they name."""
        versions = self._versions()
        old, kept = versions[:-KEPT], versions[-KEPT:]
        named = lambda s: {p for part in s["parts"].values() for p in part.values()} | ({s["results"]} if s["results"] else set())
        live = set().union(*(named(self._state(v)) for v in kept)) if old else set()
        for v in old:
            for p in named(self._state(v)) - live:
                delete(self.spark, p)
            delete(self.spark, f"{self.path}/states/{v}")

    def _write(self, rows: DataFrame, name: str) -> str:
        path = f"{self.path}/{name}/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return path

    def _table(self, state: dict, name: str, without: str | None = None) -> DataFrame | None:
        paths = [part[name] for batch, part in state["parts"].items() if batch != without]
        return self.spark.read.parquet(*paths) if paths else None

    # what is there --------------------------------------------------------------------------------

    def _index(self, state: dict) -> SearchIndex | None:
        docs = self._table(state, "docs")
        if docs is None:
            return None
        return SearchIndex(with_doc_id(docs), self.config, self.text, self.key, self._table(state, "postings"), self._table(state, "vectors"))

    def index(self) -> SearchIndex | None:
        """The index as it is; None before the first batch."""
        return self._index(self._state())

    def results(self) -> DataFrame | None:
        """The answers of the latest state; None where nothing was asked or is there."""
        path = self._state()["results"]
        return self.spark.read.parquet(path) if path else None

    # changes --------------------------------------------------------------------------------------

    def add(self, items: DataFrame, batch: int) -> None:
        """One micro-batch: new documents (the first of an identity stays for ever), their postings, and vectors of new tokens.

        Of earlier parts only short ids and tokens are read.
        """
        with self._lock:
            state, name = self._state(), str(batch)
            new = documents(items, self.text, self.key, self.config, self.seq)
            if (before := self._table(state, "docs", name)) is not None:
                new = new.join(before.select("uid"), "uid", "left_anti")
            part = {"docs": self._write(new.drop("doc_id"), "docs")}
            part["postings"] = self._write(sorted_postings(postings_of(self.spark.read.parquet(part["docs"]))), "postings")
            tokens = self.spark.read.parquet(part["postings"]).select("token").distinct()
            if (known := self._table(state, "vectors", name)) is not None:
                tokens = tokens.join(known.select("token").distinct(), "token", "left_anti")
            part["vectors"] = self._write(vectors(tokens, self.config), "vectors")
            state["parts"][name] = part
            if len(state["parts"]) > COMPACT:  # all but this batch, which may be run again
                rest = [b for b in state["parts"] if b != name]
                whole = {t: self._write(self._table(state, t, name), t) for t in _TABLES}
                state["parts"] = {f"to {rest[-1]}": whole, name: part}
            self._publish(state)

    def remove(self, items: DataFrame) -> None:
        """Takes documents out: parts that hold them, or tokens that nothing else has, are written anew without them."""
        with self._lock, scratch(self.spark):
            state = self._state()
            if not state["parts"]:
                return
            gone = identities(items, self.text, self.key)
            _, dead = without_documents(self._table(state, "postings"), gone)
            parts = {}
            for batch, part in state["parts"].items():
                old = {t: self.spark.read.parquet(p) for t, p in part.items()}
                parts[batch] = dict(part)
                if not old["docs"].join(gone, "uid", "left_semi").isEmpty():
                    parts[batch] |= {t: self._write(old[t].join(gone, "uid", "left_anti"), t) for t in ("docs", "postings")}
                if not old["vectors"].join(dead, "token", "left_semi").isEmpty():
                    parts[batch]["vectors"] = self._write(old["vectors"].join(dead, "token", "left_anti"), "vectors")
            self._publish(state | {"parts": parts})

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Starts to fill the index from a stream; batches are answered one after the other, stale answers never follow newer ones."""
        return stream.writeStream.foreachBatch(lambda rows, batch: self.add(rows, batch)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def loaded(query: StreamingQuery, expected: int | None = None) -> tuple[int, float | None]:
    """Rows that a running load has taken in so far (of the progress reports that Spark keeps), and their share of the expected ones."""
    rows = sum(p.numInputRows for p in query.recentProgress)
    return rows, min(1.0, rows / expected) if expected else None


def search_stream(index: SearchIndex, stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Answers a stream of queries ``(query_id, query)`` from an index that stays as it is; of a query id's texts in a batch the last counts."""

    def answer(rows: DataFrame, batch: int) -> None:
        latest = rows.where(F.trim(F.coalesce("query", F.lit(""))) != "").withColumn("seq", F.monotonically_increasing_id()).groupBy("query_id").agg(F.max_by("query", "seq").alias("query"))
        with scratch(rows.sparkSession):
            find(index, latest).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return stream.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def without_repeats(stream: DataFrame, text: str | Column, key: str | Column) -> DataFrame:
    """A stream without documents that it had before, with its own columns; the state grows by 16 bytes for each identity."""
    name = free_name("_uid", stream.columns)
    return stream.withColumn(name, uid(text, key)).dropDuplicates([name]).drop(name)
