"""Conversations as token ids with a training mask.

A conversation is rendered as one text: for every turn a header with the role, the turn's text and
an end mark. The text is encoded once; a byte-level vocabulary spells it without loss, so that the
running sum of the tokens' lengths gives the place of each. The turns of ``trained`` roles are spans
of the text (from the first byte after the header to the end of the mark). A token is trained where
[its begin, its end) and a span have a byte in common: a binary search over the spans' sorted ends
finds for all tokens at once the first span that ends after the token's begin. A token that lies
across the border of a span, as line breaks at both sides of it do, is thus trained. The template's
marks are encoded as the text that they are.

Defined results: turns are in the order of their number (unknown ones first), of equal numbers in
the order of role and text; rows that repeat exactly count once; a null role is an untrained turn
with an empty header, a null text an empty turn; rows with a null ``conv_id`` belong to no
conversation; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.encoding import RANKS, encoder, token_ids
from tessera.llm.tables import batched, table

HEADER, END = "<|im_start|>{role}\n", "<|im_end|>\n"
TRAINED = ("assistant",)


@lru_cache(maxsize=2)
def lengths(path: str = RANKS) -> np.ndarray:
    """How many bytes each token stands for."""
    found = encoder(path)
    size = np.zeros(found.n_vocab, np.int64)
    for token in range(found.n_vocab):
        try:
            size[token] = len(found.decode_single_token_bytes(token))
        except KeyError:
            continue  # an id that nothing has
    return size


def rendered(turns: list[tuple[str | None, str | None]], trained: tuple[str, ...] = TRAINED, header: str = HEADER, end: str = END) -> tuple[str, np.ndarray, np.ndarray]:
    """The text, and the sorted begins and ends of its trained spans, in bytes."""
    parts, begins, ends, at = [], [], [], 0
    for role, text in turns:
        head, body = header.replace("{role}", role or ""), (text or "") + end
        first = at + len(head.encode())
        at = first + len(body.encode())
        if role in trained:
            begins.append(first)
            ends.append(at)
        parts += [head, body]
    return "".join(parts), np.array(begins, np.int64), np.array(ends, np.int64)


def masked(size: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each of the tokens of ``size`` bytes that follow each other shares a byte with one of the spans."""
    if not len(begins):
        return np.zeros(len(size), bool)
    last = np.cumsum(size)
    span = np.searchsorted(ends, last - size, "right")
    return (span < len(begins)) & (begins[np.minimum(span, len(begins) - 1)] < last)


def training_rows(conversations: DataFrame, path: str = RANKS, trained: tuple[str, ...] = TRAINED, header: str = HEADER, end: str = END) -> DataFrame:
    """(conv_id, turns, n_tokens, n_trained, tokens, mask) of every conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = lengths(path)
        for batch in batches:
            turns = batch.column(1)
            roles, texts = (turns.flatten().field(k).to_pylist() for k in (1, 2))
            first = turns.offsets.to_numpy() - turns.offsets[0].as_py()
            ids, masks = [], []
            for lo, hi in zip(first[:-1], first[1:]):
                text, begins, ends = rendered(list(zip(roles[lo:hi], texts[lo:hi])), trained, header, end)
                ids.append(token_ids(text, path))
                masks.append(masked(size[ids[-1]], begins, ends))
            n = [len(x) for x in ids]
            offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            flat = lambda parts, kind: pa.array(np.concatenate(parts).astype(kind) if parts else np.empty(0, kind))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(first).astype(np.int32)), pa.array(n, pa.int32()), pa.array([int(m.sum()) for m in masks], pa.int32()), pa.ListArray.from_arrays(offsets, flat(ids, np.int32)), pa.ListArray.from_arrays(offsets, flat(masks, np.int8))], ["conv_id", "turns", "n_tokens", "n_trained", "tokens", "mask"])

    turn = F.struct(conversations["turn"].cast("long").alias("turn"), conversations["role"].cast("string").alias("role"), conversations["text"].cast("string").alias("text"))
    whole = conversations.select(conversations["conv_id"].alias("conv_id"), turn.alias("turn")).where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_set("turn")).alias("turns"))
    return batched(whole).mapInArrow(run, f"conv_id {whole.schema['conv_id'].dataType.simpleString()}, turns int, n_tokens int, n_trained int, tokens array<int>, mask array<tinyint>")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows of all conversations."""
    return training_rows(table(spark, sf_dir, "conversations"))


QUERIES = {"op4_chat": op4_chat}
ORACLE_SQL: dict[str, str] = {}
