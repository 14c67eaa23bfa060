"""Ranked, typo-tolerant search for a table of queries at once.

``find`` answers ``queries(query_id, query)``: query tokens meet the vocabulary on shared features,
the best vocabulary tokens lead through the postings to candidates, and each candidate's tokens are
scored by the harmonic mean of the best cosines, how close the matches lie, and the document's
length. Steps are functions of their own, so that each can be queried by itself.

Documents go by short ids through joins and rankings; their texts and token lists are looked up for
the results alone. Queries with the same tokens are answered once.

Cosines are rounded to 9 digits before they are compared and scores to 6; ties fall to the lesser
token, and among documents to the lesser beginning of text and key and then to the lesser short id.
The result doesn't depend on the order of summation.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import QUERY_TOKENS, SearchConfig
from tessera.functions.features import vectors
from tessera.functions.text import nul, query_tokens
from tessera.operators.index import SearchIndex, free_name
from tessera.sources.tables import written

#: Up to so many queries of different tokens are read into the plan as literals, so that their number needs no further job.
LOCAL_QUERIES = 4_000
#: Up to so many distinct query tokens are sent to every executor (some 50 features each); more meet the vocabulary in a shuffled join.
BROADCAST_TOKENS = 20_000
#: Up to so many tokens go to the scan of the postings as a list, so that it skips what has none of them.
PUSHED_TOKENS = 2_000
#: Up to so many (query, token) or (query, document) are sent to every executor.
BROADCAST_PAIRS = 300_000
#: Cosines are counted in bands of this width to find the thresholds of ``heads``.
BANDS = 1_000
_PLACE = (1 << 31) - 1


def small(df: DataFrame, limit: int) -> DataFrame:
    """``df``, to be broadcast in a join if it has at most ``limit`` rows; ``df`` should be cheap to count."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def query_terms(queries: DataFrame, config: SearchConfig) -> DataFrame:
    """(query_id, n, j, qtoken): the tokens of each query and how many it has; blank queries have none."""
    split = queries.select("query_id", query_tokens(F.col("query"), config).alias("qtokens"))
    return split.select("query_id", F.size("qtokens").alias("n"), F.posexplode("qtokens").alias("j", "qtoken"))


def token_cosines(index: SearchIndex, terms: DataFrame, few: bool = False) -> DataFrame:
    """(qtoken, token, cos) of every vocabulary token that shares a feature with a query token.

    Vectors lie token by token, so that the sums are complete, or nearly so, before anything is
    shuffled. (In the order of features a scan could skip some, but the common ones are in most
    queries, and every sum would be shuffled feature by feature.)
    """
    distinct = terms.select(F.col("qtoken").alias("token")).distinct()
    query = vectors(distinct, index.config).select(F.col("token").alias("qtoken"), "feature", F.col("w").alias("qw"))
    if few or distinct.limit(BROADCAST_TOKENS + 1).count() <= BROADCAST_TOKENS:
        query = F.broadcast(query)
    joined = index.vectors.join(query, "feature")
    return joined.groupBy("qtoken", "token").agg(F.round(F.sum(F.col("w") * F.col("qw")), 9).alias("cos"))


def best_tokens(index: SearchIndex, terms: DataFrame, cosines: DataFrame, fill: bool = True) -> DataFrame:
    """(qtoken, token, cos, rank): the ``max_results`` best vocabulary tokens of each query token.

    With ``fill`` tokens without a common feature count with cosine 0. Only the first tokens of the
    vocabulary can be needed for that: as many as are wanted, and of these some may be there already.
    """
    k = index.config.max_results
    either = cosines
    if fill:
        first = F.broadcast(index.vocabulary.orderBy("token").limit(k))
        zero = terms.select("qtoken").distinct().crossJoin(first).withColumn("cos", F.lit(0.0))
        either = cosines.unionByName(zero).groupBy("qtoken", "token").agg(F.max("cos").alias("cos"))
    rank = F.row_number().over(Window.partitionBy("qtoken").orderBy(F.desc("cos"), "token"))
    return either.withColumn("rank", rank).where(F.col("rank") <= k)


def _short_of_tokens(terms: DataFrame, cosines: DataFrame, k: int) -> bool:
    """Whether some query token has fewer than ``k`` vocabulary tokens with a cosine of 0 or more."""
    full = cosines.where("cos >= 0").groupBy("qtoken").count().where(F.col("count") >= k)
    return not terms.select("qtoken").distinct().join(full, "qtoken", "left_anti").isEmpty()


def _best_pairs(index: SearchIndex, terms: list[tuple[str, str]], cosines: DataFrame) -> list[tuple[str, str]]:
    """(query_id, token) as ``best_tokens`` would have them, for few (query_id, qtoken)."""
    k, best = index.config.max_results, {q: {} for _, q in terms}
    for r in best_tokens(index, None, cosines, fill=False).collect():
        best[r.qtoken][r.token] = r.cos
    if any(sum(c >= 0 for c in found.values()) < k for found in best.values()):
        first = [r.token for r in index.vocabulary.orderBy("token").limit(k).collect()]
        for q, found in best.items():
            either = {t: max(found.get(t, 0.0), 0.0) if t in first else found[t] for t in {*found, *first}}
            best[q] = dict(sorted(either.items(), key=lambda x: (-x[1], x[0].encode()))[:k])
    return sorted({(query, token) for query, q in terms for token in best[q]})


def candidate_ranges(index: SearchIndex, terms: DataFrame, best: DataFrame) -> DataFrame:
    """(query_id, uid, lo, hi): documents with one of the best tokens, and the first and last place of these."""
    return _ranges(index.postings, small(terms.select("query_id", "qtoken").join(best.select("qtoken", "token"), "qtoken").select("query_id", "token").distinct(), BROADCAST_PAIRS))


def _ranges(postings: DataFrame, hits: DataFrame) -> DataFrame:
    return postings.join(hits, "token").groupBy("query_id", "uid").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))


def pushed(postings: DataFrame, tokens: list[str]) -> DataFrame:
    """The postings of a few tokens, which the scan is told."""
    postings.sparkSession.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", PUSHED_TOKENS)
    return postings.where(F.col("token").isin(tokens))


def candidates(index: SearchIndex, ranges: DataFrame, pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """The ranges with what scoring needs of their documents; ``ranges`` are broadcast if they are few.

    With the (query_id, token) of ``pairs`` the ranges of many documents are found again where the
    documents are read, so that no token list is shuffled; if most documents are no candidates, the
    shuffle of ``ranges`` is less work.
    """
    docs = index.docs.select("uid", "kid", "tie", "n_tokens", "tokens")
    few = small(ranges, BROADCAST_PAIRS)
    queries = {query for query, _ in pairs or ()}
    if few is not ranges or not queries or len(queries) * index.docs.count() > 8 * ranges.count():
        return docs.join(few, "uid")
    hits = [(query, [t for q, t in pairs if q == query]) for query in sorted(queries)]
    asked = docs.sparkSession.createDataFrame(pa.table([pa.array([q for q, _ in hits], pa.string()), pa.array([t for _, t in hits], pa.list_(pa.string()))], names=["query_id", "hits"]))
    places = F.filter(F.transform("hits", lambda t: F.array_position("tokens", t)), lambda p: p > 0)
    found = docs.crossJoin(F.broadcast(asked)).withColumn("places", places).where(F.size("places") > 0)
    return found.select(*docs.columns, "query_id", (F.array_min("places") - 1).cast("int").alias("lo"), (F.array_max("places") - 1).cast("int").alias("hi"))


def scored_tokens(index: SearchIndex, terms: DataFrame, cosines: DataFrame, docs: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(query_id, token, j, cos) of the tokens that count for the j-th token of a query; of those in ``only(query_id, token)``.

    A token counts for a query where some candidate has it in its range, widened by
    ``window_slack``; elsewhere its cosine is taken as 0, even if it has one.
    """
    slack = index.config.window_slack
    lo = F.greatest(F.col("lo") - slack, F.lit(0))
    window = F.slice("tokens", lo + 1, F.least(F.col("hi") + slack + 1, F.col("n_tokens")) - lo)
    inside = docs.select("query_id", F.explode(window).alias("token"))
    inside = (inside if only is None else inside.join(only, ["query_id", "token"], "left_semi")).distinct()
    positive = cosines.where("cos > 0").join(terms.select("query_id", "j", "qtoken"), "qtoken")
    return positive.join(inside, ["query_id", "token"]).select("query_id", "token", "j", "cos")


def by_token(scored: DataFrame) -> DataFrame:
    """(query_id, token, c0 ... c4): the tokens that count, with 10**9 times their cosines for each token of the query."""
    digits = F.round(F.col("cos") * 1e9).cast("long")
    return scored.groupBy("query_id", "token").agg(*(F.max(F.when(F.col("j") == j, digits)).alias(f"c{j}") for j in range(QUERY_TOKENS)))


def best_matches(docs: DataFrame, by_token: DataFrame, rest: DataFrame | None = None) -> DataFrame:
    """(query_id, uid, kid, tie, n_tokens, matches): for each query token that has one, the best token of the candidate, the first of equal ones.

    Tokens that ``by_token`` lacks are looked up in ``rest``. ``matches`` holds (j, cos, pos). A cosine of 9 digits and a place fit one number, whose
    maximum is the match, so that a candidate is one row of a hash aggregation.
    """
    each = range(QUERY_TOKENS)
    long = docs.select("query_id", "uid", "kid", "tie", "n_tokens", F.posexplode("tokens").alias("pos", "token"))
    packed = lambda j: F.max(F.shiftleft(F.col(f"c{j}"), 32) + (_PLACE - F.col("pos"))).alias(f"m{j}")
    pair, head = ["query_id", "token"], small(by_token, BROADCAST_PAIRS)
    there = F.coalesce(*(F.col(f"c{j}") for j in each)).isNotNull()
    met = long.join(head, pair, "left")
    if rest is not None:
        met = met.where(there).unionByName(long.join(head, pair, "left_anti").join(small(rest, BROADCAST_PAIRS), pair, "left"))
    met = met.where(there | (F.col("pos") == 0))  # the first place, so that every candidate has a row
    best = met.groupBy("query_id", "uid", "kid", "tie", "n_tokens").agg(*map(packed, each))
    match = lambda j: F.when(F.col(f"m{j}").isNotNull(), F.struct(F.lit(j).alias("j"), (F.shiftright(F.col(f"m{j}"), 32) / 1e9).alias("cos"), (_PLACE - F.col(f"m{j}").bitwiseAND(0xFFFFFFFF)).cast("int").alias("pos")))
    return best.select("query_id", "uid", "kid", "tie", "n_tokens", F.filter(F.array(*map(match, each)), lambda m: m.isNotNull()).alias("matches"))


def _decay(gap: Column) -> Column:
    """1 / 2 ** (gap + 1) with the wrap of a 32-bit shift, so that the 31st place after counts like a neighbour."""
    shift = (gap + 1) % 32
    return F.when(shift == 31, F.lit(-1.0 / (1 << 31))).otherwise(1.0 / F.pow(F.lit(2.0), shift))


def proximity(places: Column, n: Column) -> Column:
    """Nearness of sorted places: 1 where all adjoin, halved with every token between; 0 for one match of several query tokens."""
    steps = F.zip_with(F.slice(places, 2, F.greatest(F.size(places) - 1, F.lit(0))), F.slice(places, 1, F.greatest(F.size(places) - 1, F.lit(0))), lambda b, a: F.greatest(b - a - 1, F.lit(0)))
    total = F.aggregate(steps, F.lit(0.0), lambda sum_, gap: sum_ + _decay(gap))
    return F.when(F.size(places) >= 2, total / ((F.size(places) - 1) * 0.5)).when((F.size(places) == 1) & (n > 1), 0.0).otherwise(1.0)


def length_penalty(n_tokens: Column) -> Column:
    return F.greatest(F.lit(0.5), 1 - 0.1 * F.log10(F.greatest(n_tokens, F.lit(1)).cast("double")))


def harmonic(cos: Column, n: Column) -> Column:
    """Harmonic mean of the cosines of ``n`` query tokens, of which those without a match count as next to 0."""
    parts = F.aggregate(cos, F.lit(0.0), lambda total, c: total + 1 / F.greatest(c, F.lit(1e-6)))
    return F.when(n == 1, F.coalesce(F.array_max(cos), F.lit(0.0))).otherwise(n / (parts + (n - F.size(cos)) * 1e6))


def scores(matches: DataFrame, terms: DataFrame, config: SearchConfig) -> DataFrame:
    """(query_id, uid, kid, tie, score) of every candidate."""
    joined = matches.join(terms.select("query_id", "n").distinct(), "query_id")
    n = F.col("n")
    base = harmonic(F.col("matches.cos"), n)
    near = 1 - config.adjacency_bonus * (1 - proximity(F.array_sort(F.col("matches.pos")), n))
    score = F.least(F.greatest(base * near * length_penalty(F.col("n_tokens")), F.lit(0.0)), F.lit(1.0))
    return joined.select("query_id", "uid", "kid", "tie", F.round(score, 6).alias("score"))


def ranked(scored: DataFrame, limit: int) -> DataFrame:
    """(query_id, rank, uid, score): the best document of each key, and of these the best ``limit``; both cut before they shuffle."""
    order = [F.desc("score"), "tie", "uid"]
    one = scored.withColumn("copy", F.row_number().over(Window.partitionBy("query_id", "kid").orderBy(*order))).where("copy = 1")
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= limit).select("query_id", "rank", "uid", "score")


def _terms(index: SearchIndex, asked: DataFrame) -> tuple[DataFrame, list[tuple[str, str]] | None]:
    """(query_id, n, j, qtoken) of the distinct texts, which are the ids; and (query_id, qtoken), if they are few."""
    texts = [r._text for r in asked.select("_text").distinct().limit(LOCAL_QUERIES + 1).collect()]
    if len(texts) > LOCAL_QUERIES:
        split = asked.select("_text").distinct().select(F.col("_text").alias("query_id"), F.split("_text", "\0").alias("q"))
        return split.select("query_id", F.size("q").alias("n"), F.posexplode("q").alias("j", "qtoken")), None
    rows = [(text, len(q), j, token) for text in texts for q in [text.split("\0")] for j, token in enumerate(q)]
    columns = zip(*rows) if rows else ((), (), (), ())
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.string())
    local = pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=["query_id", "n", "j", "qtoken"])
    return asked.sparkSession.createDataFrame(local), [(r[0], r[3]) for r in rows]


def _found(index: SearchIndex, queries: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """(query_id, _text) of the queries that have tokens, (_text, rank, uid, score) of their results, and whether these have a bound."""
    config = index.config
    asked = queries.select("query_id", F.array_join(query_tokens(F.col("query"), config), "\0").alias("_text")).where("_text <> ''")
    terms, few = _terms(index, asked)
    cosines = written(token_cosines(index, terms, few is not None), "cosines")
    local, pairs = few is not None and len({q for _, q in few}) * config.max_results <= PUSHED_TOKENS, None
    if local:
        pairs = _best_pairs(index, few, cosines)
        hits = asked.sparkSession.createDataFrame(pa.table([pa.array(c, pa.string()) for c in (zip(*pairs) if pairs else ((), ()))], names=["query_id", "token"]))
        ranges = _ranges(pushed(index.postings, sorted({t for _, t in pairs})), F.broadcast(hits))
    else:
        ranges = candidate_ranges(index, terms, best_tokens(index, terms, cosines, fill=_short_of_tokens(terms, cosines, config.max_results)))
    docs = candidates(index, written(ranges, "candidates"), pairs)
    terms = F.broadcast(terms) if few is not None else terms
    floors = heads(terms, cosines) if local else {}
    if any(floors.values()):
        scored = _scored_in_parts(index, terms, cosines, docs, floors)
    else:
        scored = scores(best_matches(docs, written(by_token(scored_tokens(index, terms, cosines, docs)), "words")), terms, config)
    best = ranked(scored, config.max_results)
    return asked, best.withColumnRenamed("query_id", "_text"), few is not None and LOCAL_QUERIES * config.max_results <= BROADCAST_PAIRS


def heads(terms: DataFrame, cosines: DataFrame) -> dict[str, float]:
    """For each of few query tokens the cosine from which on its vocabulary tokens can be sent to every executor; 0 if all can."""
    asked = terms.groupBy("qtoken").agg(F.count("*").alias("times")).collect()
    room = BROADCAST_PAIRS // max(sum(r.times for r in asked), 1)
    bands = {r.qtoken: {} for r in asked}
    for r in cosines.where("cos > 0").groupBy("qtoken", F.floor(F.col("cos") * BANDS).alias("band")).count().collect():
        bands[r.qtoken][r.band] = r["count"]
    floors = {}
    for token, counts in bands.items():
        floors[token], total = 0.0, 0
        for band in sorted(counts, reverse=True):
            total += counts[band]
            if total > room:
                floors[token] = (band + 1) / BANDS
                break
    return floors


def _scored_in_parts(index: SearchIndex, terms: DataFrame, cosines: DataFrame, docs: DataFrame, floors: dict[str, float]) -> DataFrame:
    """``scores`` of all candidates that can be among the results, where the tokens with a cosine are too many to broadcast.

    The tokens nearest to the query tokens go to every executor. A candidate that has one of them for
    each query token has its final score, since all others are less near. The other candidates' scores
    are bounded by the thresholds; only where the bound reaches the last of the best ``max_results``
    final scores, all other tokens are looked up too.
    """
    config, spark = index.config, docs.sparkSession
    least = F.broadcast(spark.createDataFrame(pa.table([pa.array(list(floors), pa.string()), pa.array(list(floors.values()), pa.float64())], names=["qtoken", "floor"])))
    pair = ["query_id", "token"]
    near = cosines.where("cos > 0").join(least, "qtoken").where("cos >= floor").join(terms.select("query_id", "qtoken"), "qtoken")
    head = F.broadcast(written(near.select(*pair).distinct(), "head"))
    words = written(by_token(scored_tokens(index, terms, cosines.join(F.broadcast(head.select("token").distinct()), "token", "left_semi"), docs, head)), "words")
    limits = F.broadcast(terms.join(least, "qtoken").groupBy("query_id", "n").agg(F.array_sort(F.collect_list(F.struct("j", "floor"))).alias("floors")))
    of = lambda f: F.filter("matches", lambda m: (m["j"] == f["j"]) & (m["cos"] >= f["floor"]))
    first = best_matches(docs, words).join(limits, "query_id")
    first = first.withColumn("final", F.forall("floors", lambda f: (f["floor"] <= 0) | (F.size(of(f)) > 0)))
    at_most = F.transform(F.filter("floors", lambda f: (f["floor"] > 0) | (F.size(of(f)) > 0)), lambda f: F.coalesce(F.array_max(F.transform(of(f), lambda m: m["cos"])), f["floor"]))
    bound = F.least(harmonic(at_most, F.col("n")) * length_penalty(F.col("n_tokens")), F.lit(1.0)) if 0 <= config.adjacency_bonus <= 1 else F.lit(1.0)
    first = written(first.withColumn("bound", F.when(~F.col("final"), bound)).drop("floors", "n"), "matches")
    done = scores(first.where("final"), terms, config)
    last = ranked(done, config.max_results).groupBy("query_id").agg(F.count("*").alias("found"), F.min("score").alias("last")).where(F.col("found") >= config.max_results)
    lasts = [(r.query_id, r.last) for r in last.collect()]
    known = F.broadcast(spark.createDataFrame(lasts, "query_id string, last double"))
    left = written(first.where("not final").join(known, "query_id", "left").where("last is null or bound + 2e-6 >= last").select("query_id", "uid"), "open")
    if left.isEmpty():
        return done
    open_ = docs.join(small(left, BROADCAST_PAIRS), ["query_id", "uid"], "left_semi")
    further = small(written(open_.select("query_id", F.explode("tokens").alias("token")).join(head, pair, "left_anti").distinct(), "further"), BROADCAST_PAIRS)
    rest = written(by_token(scored_tokens(index, terms, cosines, docs, further)), "rest")
    return done.unionByName(scores(best_matches(open_, words, rest), terms, config))


def find(index: SearchIndex, queries: DataFrame) -> DataFrame:
    """(query_id, rank, doc_id, tokens, score) for all ``queries(query_id, query)``; see the module.

    Cosines, candidates and the tokens that count are written to the shared folder once: later
    steps read them several times, and a lost executor doesn't lose them. The ranking is a plan.
    Rows of ``queries`` that share an id are answered each by itself.
    """
    return _looked_up(index, queries, "doc_id", "tokens").select("query_id", "rank", "doc_id", "tokens", "score")


def _looked_up(index: SearchIndex, queries: DataFrame, *columns: str) -> DataFrame:
    asked, hits, bounded = _found(index, queries)
    results = F.broadcast(hits) if bounded else small(written(hits, "hits"), BROADCAST_PAIRS)
    return asked.join(index.docs.select("uid", *columns).join(results, "uid"), "_text")


def find_items(index: SearchIndex, queries: DataFrame) -> DataFrame | None:
    """Results with the columns of the stored source rows; None where the index has no store.

    Columns that are named like one of the result's get ``item_`` before their names.
    """
    if not index.config.have_store:
        return None
    own = ["query_id", "rank", "score"]
    columns, names = list(own), [f.name for f in index.docs.schema["item"].dataType.fields]
    for name in names:
        columns.append(free_name(f"item_{name}", columns + names) if name.lower() in own else name)
    return _looked_up(index, queries, "item").select(*own, *(F.col("item")[old].alias(new) for old, new in zip(names, columns[len(own) :])))
