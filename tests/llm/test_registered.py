"""Every registered query of the subpackage runs over the shared tables and gives what its module says of whole tables."""

import os
from collections import Counter

import pytest

import __spark_entry__ as entry
from tessera.llm.encoding import token_ids

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the shared tables")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").collect()


def _rows(spark, name, folder=FOLDER):
    return entry.queries()[name](spark, folder).collect()


def test_ten_operators_and_the_pipeline_are_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in entry.queries()


def test_spans_are_places_of_the_text(spark):
    folder = FOLDER.replace("sf0.001", "sf0.01")  # the smallest tables have no secret
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for name, value in (("op1_secrets", "secret"), ("op2_pii", "value")):
        found = _rows(spark, name, folder)
        assert found and all(text[r.doc_id][r.begin : r.end] == r[value] for r in found)


def test_every_token_is_stored_and_packed(spark, docs):
    want = {r.doc_id: len(token_ids(r.text or "")) for r in docs}
    packed = Counter()
    for r in _rows(spark, "op9_packing"):
        packed[r.doc_id] += len(r.tokens)
    assert dict(packed) == {d: n for d, n in want.items() if n}
    assert {r.doc_id: r.n_tokens for r in _rows(spark, "op6_token_store") if r.kind == "document"} == want


def test_every_document_has_a_place(spark, docs):
    placed = _rows(spark, "op7_sharding")
    assert sorted(r.doc_id for r in placed) == sorted(r.doc_id for r in docs) and len({(r.shard, r.position) for r in placed}) == len(docs)
    assert len(_rows(spark, "op8_fingerprint")) == len(docs)


def test_groups_and_pairs_name_documents(spark, docs):
    ids = {r.doc_id for r in docs}
    groups = _rows(spark, "op5_minhash_near_dup")
    sizes = Counter(r.group_id for r in groups)
    assert groups and all(r.doc_id in ids and r.n_docs == sizes[r.group_id] > 1 and r.group_id <= r.doc_id for r in groups)
    copies = {(r.canonical_id, r.doc_id) for r in _rows(spark, "op8_fingerprint") if r.copies > 1}
    group = {r.doc_id: r.group_id for r in groups}
    text = {r.doc_id: r.text for r in docs}
    assert all(group[a] == group[b] for a, b in copies if any(c.isalnum() for c in text[a])), "equal texts are near copies"
    assert {r.doc_id for r in _rows(spark, "op3_toxicity")} <= ids and {r.doc_id for r in _rows(spark, "op10_decontaminate")} <= ids


def test_conversations_are_spelled(spark):
    turns = {}
    for r in sorted(spark.read.parquet(f"{FOLDER}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn)):
        turns.setdefault(r.conv_id, []).append(r)
    found = {r.conv_id: r for r in _rows(spark, "op4_chat")}
    assert found.keys() == turns.keys()
    for c, rows in turns.items():
        text = "".join(f"<|im_start|>{r.role}\n{r.text}<|im_end|>\n" for r in rows)
        assert found[c].tokens == token_ids(text).tolist() and found[c].n_trained == sum(found[c].mask)
