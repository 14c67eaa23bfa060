import duckdb
import pandas as pd
import pytest

from tessera.llm import fingerprint as fp

TEXTS = ["Same text", " same  TEXT\n", "same text!", "café", "café", "CAFÉ ", "", "  \t", None, "one of a kind", "İx", "a b", "A B", "long word " * 50000, "LONG word  " * 50000]


@pytest.mark.parametrize("hot", [None, 2])
def test_groups(spark, hot):
    rows = [(k, t, b"d", 7) for k, t in enumerate(TEXTS)] + [(0, "Same text", b"d", 7), (None, "same text", b"d", 7), (None, "no id", b"d", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest binary, n int")
    found = sorted((str(r.doc_id), str(r.canonical_id), r.copies) for r in fp.exact_copies(docs, hot=hot).collect())
    frame = pd.DataFrame([r[:2] for r in rows], columns=["doc_id", "text"]).astype({"doc_id": "Int64"})
    con = duckdb.connect()
    con.register("documents", frame)
    want = sorted((str(a), str(b), n) for a, b, n in con.sql(fp.ORACLE_SQL["op8_fingerprint"]).fetchall())
    assert found == want and ("1", "0", 4) in found and ("None", "None", 1) in found and ("7", "6", 2) in found and ("14", "13", 2) in found


def test_equal_digests_of_unequal_texts_stay_apart(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "A "), (4, "c")], "doc_id long, text string")
    found = fp.exact_copies(docs, digest=lambda form: b"0" * 16)
    assert sorted((r.doc_id, r.canonical_id, r.copies) for r in found.collect()) == [(1, 1, 2), (2, 2, 1), (3, 1, 2), (4, 4, 1)]


def test_empty_table(spark):
    assert fp.exact_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_some_digests_collide_and_others_repeat(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c c"), (4, "C  c"), (5, "c c"), (6, "d")], "doc_id long, text string")
    found = fp.exact_copies(docs, digest=lambda form: bytes(form)[:1].translate(bytes.maketrans(b"b", b"a")) * 16)
    assert sorted((r.doc_id, r.canonical_id, r.copies) for r in found.collect()) == [(1, 1, 1), (2, 2, 1), (3, 3, 3), (4, 3, 3), (5, 3, 3), (6, 6, 1)]
