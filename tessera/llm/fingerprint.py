"""Exact copies by a canonical digest.

The canonical form of a text is its NFC normalisation in small letters, with every run of white
space as one blank and none at the ends. Documents are grouped by the 128-bit xxHash of the form;
within a group of several, the forms themselves are compared byte by byte, so that a collision of
the hash can't join two texts. A bitmap of the digests that repeat tells which forms have to be
compared; equal forms become one row in each task before any are shuffled, so that a page with
very many copies goes over the network once for each task that read it. Small letters are those of
the Unicode lower-case mapping: ``ß`` and ``ss`` stay different.

Every document with a text has a row with the least id of its group (``canonical_id``) and the
group's number of rows (``copies``).

Defined results: null texts have no row; empty texts and those of white space alone are copies of
each other; repeated rows count each for itself; a row with a null id counts as a copy and has a
row, but gives no least id unless the group has no other; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.tables import among, batched, bitmap, bits, held, looked_up, table, written

Digest = Callable[[pa.Buffer], bytes]
FORM = "NFC"
_FORM = "doc_id long, digest binary, form binary"
_BLANK = r"[\t\n\v\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def canonical(texts: pa.Array, form: str = FORM) -> pa.Array:
    folded = pc.utf8_lower(pc.utf8_normalize(texts.cast(pa.large_string()), form))
    return pc.utf8_trim(pc.replace_substring_regex(folded, _BLANK, " "), " ")


def _digests(form: str, digest: Digest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [digest(x.as_buffer()) for x in canonical(batch.column(1), form)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary())], ["doc_id", "digest"])

    return run


def _heads(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8] for d in digests), ">i8").astype(np.int64)


def _forms(form: str, digest: Digest, marks):
    """Forms of the documents whose digest may be one of those that are marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = canonical(batch.column(1), form)
            digests = [digest(x.as_buffer()) for x in texts]
            keep = pa.array(np.flatnonzero(among(marks.value, _heads(digests))))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), pa.array(digests, pa.binary()).take(keep), texts.take(keep).cast(pa.large_binary()).cast(pa.binary())], ["doc_id", "digest", "form"])

    return run


def exact_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", form: str = FORM, digest: Digest = xxhash.xxh3_128_digest, hot: int | None = None) -> DataFrame:
    """(doc_id, canonical_id, copies) of every document with a text."""
    rows = batched(docs).select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")).where("text is not null")
    digests = written(rows.mapInArrow(_digests(form, digest), "doc_id long, digest binary"), "digests")
    counted = written(digests.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("canonical_id")), "counted")
    alone = counted.where("n = 1").select(F.col("canonical_id").alias("doc_id"), "canonical_id", F.col("n").alias("copies"))
    several = counted.where("n > 1").select("digest", "n")
    found = several.count()
    if not found:
        return alone
    forms = _forms_of(rows, several, found, form, digest)
    texts = forms.groupBy("digest", "form").agg(F.count("*").alias("n"), F.min("doc_id").alias("canonical_id"))
    facts = written(texts.groupBy("digest").agg(F.count("*").alias("forms"), F.sum("n").alias("n"), F.min("canonical_id").alias("canonical_id")).where("n > 1"), "facts")
    settings = {"hot": hot} if hot else {}
    equal = looked_up(digests, "digest", facts.where("forms = 1").select("digest", "n", "canonical_id"), "n", **settings).select("doc_id", "canonical_id", F.col("n").alias("copies"))
    unequal = facts.where("forms > 1").select("digest", "n")
    if (collided := unequal.count()) == 0:
        return alone.unionByName(equal)
    # texts of one digest that differ: their forms are told apart by themselves
    forms = written(_forms_of(rows, unequal, collided, form, digest).join(unequal.select("digest"), "digest", "left_semi"), "forms")
    each = forms.groupBy("digest", "form").agg(F.count("*").alias("copies"), F.min("doc_id").alias("canonical_id"))
    return alone.unionByName(equal).unionByName(forms.join(each, ["digest", "form"]).select("doc_id", "canonical_id", "copies"))


def _forms_of(rows: DataFrame, wanted: DataFrame, n: int, form: str, digest: Digest) -> DataFrame:
    """(doc_id, digest, form) of all documents with one of the wanted digests, and of few others."""
    power = bits(n)
    heads = wanted.select(F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long").alias("head"))
    marks = rows.sparkSession.sparkContext.broadcast(held(bitmap(heads, power), power))
    return rows.mapInArrow(_forms(form, digest, marks), _FORM)


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies among all documents."""
    return exact_copies(table(spark, sf_dir, "documents"))


QUERIES = {"op8_fingerprint": op8_fingerprint}
ORACLE_SQL = {
    "op8_fingerprint": r"""
    SELECT doc_id, min(doc_id) OVER (PARTITION BY form) AS canonical_id, count(*) OVER (PARTITION BY form) AS copies
    FROM (SELECT doc_id, trim(regexp_replace(lower(nfc_normalize(text)), '[\t\n\v\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'), ' ') AS form
          FROM documents WHERE text IS NOT NULL)
    """
}
