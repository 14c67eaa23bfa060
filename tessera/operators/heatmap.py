"""Which characters of documents a query explains, for tables of (query, document)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import SearchConfig
from tessera.functions.matching import BLOCK, EXACT, SINGLE, text_tiers, word_tiers
from tessera.functions.text import short_id, text_of
from tessera.operators.index import SearchIndex, free_name

_CHARS = "array<struct<ch:string,tier:int>>"
RESET, BRIGHT, YELLOW, CYAN, GRAY = "\x1b[0m", "\x1b[93m", "\x1b[33m", "\x1b[36m", "\x1b[90m"


def _mapped(function) -> callable:
    @F.pandas_udf("array<int>")
    def tiers(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for queries, texts in pairs:
            known: dict[tuple[str, str], list[int] | None] = {}
            for pair in zip(queries, texts):
                if pair not in known:
                    known[pair] = None if pair[0] is None or pair[1] is None else function(*pair)
            yield pd.Series([known[p] for p in zip(queries, texts)], dtype=object)

    return tiers


def _joined(text: Column, tiers: Column) -> Column:
    characters = F.filter(F.split(text, ""), lambda c: c != "")
    return F.when(tiers.isNotNull(), F.arrays_zip(characters.alias("ch"), tiers.alias("tier")).cast(_CHARS))


def word_heatmap(query: Column, target: Column, ignore_case: bool = True) -> Column:
    """Characters of ``target`` with their tiers, both texts taken as one word."""
    return _joined(target, _mapped(lambda q, t: word_tiers(q, t, ignore_case))(query, target))


def heatmap(index: SearchIndex, pairs: DataFrame) -> DataFrame:
    """``pairs(query, doc_id)`` with ``chars``; null for a blank query, and no row for a document that isn't there."""
    config: SearchConfig = index.config
    known = index.docs.select(F.col("uid").alias(name := free_name("_uid", pairs.columns)))
    there = pairs.withColumn(name, short_id(F.col("doc_id"))).join(known, name, "left_semi").drop(name)
    text = text_of(F.col("doc_id"))
    return there.withColumn("chars", _joined(text, _mapped(lambda q, t: text_tiers(q, t, config))(F.col("query"), text)))


def highlighted(chars: Column, reset: str = RESET, bright: str = BRIGHT, yellow: str = YELLOW, cyan: str = CYAN, gray: str = GRAY) -> Column:
    """Each character between the colour of its tier and ``reset``."""
    colour = lambda t: F.when(t == EXACT, F.lit(bright)).when(t == BLOCK, F.lit(yellow)).when(t == SINGLE, F.lit(cyan)).otherwise(F.lit(gray))
    return F.array_join(F.transform(chars, lambda x: F.concat(colour(x["tier"]), x["ch"], F.lit(reset))), "")
