"""Character features of tokens as unit vectors in long form: (token, feature, w)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import PREFIX_CAP, SearchConfig


def _places(first: Column | int, last: Column) -> Column:
    """first..last, and nothing where last is less (``sequence`` would count down)."""
    first = F.lit(first)
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def raw_features(token: Column, config: SearchConfig = SearchConfig()) -> Column:
    """All (feature, weight) of a token before accumulation, as an array of structs."""
    size = F.length(token)
    entry = lambda name, weight: F.struct(name.alias("feature"), weight.cast("double").alias("w"))
    first, last, head = F.left(token, F.lit(1)), F.right(token, F.lit(1)), F.least(size, F.lit(PREFIX_CAP))
    sorted_rest = lambda i: F.array_join(F.array_sort(F.split(F.substring(token, F.lit(2), i - 1), "")), "")
    grams = lambda n: F.transform(_places(1, size - (n - 1)), lambda i: entry(F.substring(token, i, F.lit(n)), F.lit(n * config.floating_weight)))
    groups = [
        F.array(entry(F.concat(F.lit("A_"), first), F.lit(config.anchor_weight))),
        F.transform(_places(2, F.least(size, F.lit(2))), lambda _: entry(F.concat_ws("_", F.lit("G"), first, size.cast("string"), last), F.lit(config.gestalt_weight))),
        F.transform(_places(1, head), lambda i: entry(F.concat(F.lit("P_"), F.substring(token, F.lit(1), i)), i * F.lit(config.prefix_weight))),
        F.transform(_places(2, head), lambda i: entry(F.concat(F.lit("F_"), first, F.lit("_"), sorted_rest(i)), i * F.lit(config.fuzzy_weight))),
        F.transform(_places(1, size - 2), lambda i: entry(F.concat(F.substring(token, i, F.lit(1)), F.substring(token, i + 2, F.lit(1))), F.lit(config.skip_weight))),
    ]
    if config.char_bag_weight > 0:
        groups.append(F.transform(F.array_distinct(F.filter(F.split(token, ""), lambda c: c != "")), lambda c: entry(F.concat(F.lit("CB_"), c), F.lit(config.char_bag_weight))))
    for n in range(2, config.max_ngram + 1):
        groups.append(grams(n))
    return F.when(size > 0, F.concat(*groups)).otherwise(F.array().cast("array<struct<feature:string,w:double>>"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once for a row, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def unit_features(raw: Column) -> Column:
    """(feature, w) of raw features, each feature once, with unit length; null where the length is next to nothing."""

    def summed(s: Column) -> Column:
        name = lambda i: F.get(s, i)["feature"]
        starts = F.filter(_places(0, F.size(s) - 1), lambda i: ~name(i).eqNullSafe(name(i - 1)))
        run = lambda b, e: F.aggregate(F.slice(s, b + 1, e - b), F.lit(0.0), lambda total, f: total + f["w"])
        return _let(starts, lambda p: F.transform(p, lambda b, k: F.struct(name(b).alias("feature"), run(b, F.coalesce(F.get(p, k + 1), F.size(s))).alias("w"))))

    def normed(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda total, f: total + f["w"] * f["w"]))
        return _let(norm, lambda n: F.when(n >= 1e-7, F.transform(v, lambda f: F.struct(f["feature"].alias("feature"), (f["w"] / n).alias("w")))))

    return _let(_let(F.sort_array(raw), summed), normed)


def vectors(vocabulary: DataFrame, config: SearchConfig = SearchConfig()) -> DataFrame:
    """(token, feature, w) of a table of distinct tokens, with unit length for each token.

    A vector is made within the row of its token: nothing is shuffled, sorted or held for other
    tokens, and the table stays placed as the vocabulary was.
    """
    return vocabulary.select("token", F.inline(unit_features(raw_features(F.col("token"), config))))


def cosines(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, cos) of all pairs of tokens of two vector tables that share a feature."""
    a = left.select(F.col("token").alias("a"), "feature", F.col("w").alias("wa"))
    b = right.select(F.col("token").alias("b"), "feature", F.col("w").alias("wb"))
    return a.join(b, "feature").groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cos"))
