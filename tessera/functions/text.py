"""Tokens and document ids as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.config import QUERY_TOKENS, SearchConfig

#: Characters of a text and of a key that decide the order of documents with equal scores.
TIE = 64


def nul() -> Column:
    """U+0000."""
    return F.char(F.lit(0))


def tokens(text: Column, config: SearchConfig = SearchConfig()) -> Column:
    """Distinct tokens in the order of their first place; none for null."""
    words = F.transform(F.split(F.coalesce(text, F.lit("")), config.separator), lambda w: F.lower(F.btrim(w, F.lit(" \t\n\r\f\v"))))
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def query_tokens(text: Column, config: SearchConfig = SearchConfig()) -> Column:
    """The tokens of a query that count: the first five."""
    return F.slice(tokens(text, config), 1, QUERY_TOKENS)


def doc_id(text: Column, key: Column) -> Column:
    """Identity of a document: its text and its key, with U+0000 between them."""
    return F.concat(F.coalesce(text, F.lit("")), nul(), F.coalesce(key.cast("string"), F.lit("")))


def short_id(of: Column) -> Column:
    """16 bytes that stand for a string in joins and groups, so that whole texts don't move."""
    return F.unhex(F.left(F.sha2(of, 256), F.lit(32)))


def tie(text: Column, key: Column) -> Column:
    """What orders documents of equal scores: the beginnings of text and key."""
    return F.concat(F.left(text, F.lit(TIE)), nul(), F.left(key, F.lit(TIE)))


def text_of(id_: Column) -> Column:
    return F.call_function("substring_index", id_, nul(), F.lit(1))


def key_of(id_: Column) -> Column:
    """What stands after the first U+0000."""
    return F.substring(id_, F.call_function("instr", id_, nul()) + 1, F.length(id_))
