import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tessera.llm import encoding, packing, token_store as ts


@given(st.lists(st.integers(0, 5000), max_size=12), st.integers(0, 9))
@settings(deadline=None, max_examples=60)
def test_pieces_are_binary(sizes, largest):
    doc, begin, length = packing.pieces(np.array(sizes, np.int64), largest)
    for k, n in enumerate(sizes):
        own = list(zip(begin[doc == k].tolist(), length[doc == k].tolist()))
        want, at = [], 0
        for bit in range(largest, -1, -1):
            while n - at >= 1 << bit:
                want.append((at, 1 << bit))
                at += 1 << bit
        assert own == want and at == n


def test_blank_runs_do_not_change_pieces():
    for text in ("a" + " " * 5000 + "b", "x\n" * 3 + "\n" * 4000 + "y z", " " * 3000, "q" + " \n" * 2000 + " w", ""):
        assert encoding.token_ids(text).tolist() == encoding.encoder().encode_ordinary(text)
    assert len(encoding.token_ids(" " * 1_000_000 + "a")) and len(encoding.token_ids("z" * 3_000_000)) and len(encoding.token_ids("a\n" + "\t" * 900_000))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice(["the", "token", "of", "a", "stór", "binary", "\n"]) for _ in range(rng.randint(0, 300))), "x", 1) for k in range(200)]
    rows += [(500, None, "x", 1), (501, "", "x", 1), (None, "no id", "x", 1), (3, "again", "x", 1), (3, "again", "x", 1), (502, "long text " * 30000, "x", 1), (503, "<|endoftext|>", "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, kind string, part int").repartition(3).cache()


def _truth(docs):
    return sorted((str(r.doc_id), tuple(encoding.token_ids(r.text).tolist())) for r in docs.collect() if r.text)


def test_packing_keeps_every_token(docs):
    rows = packing.packed(docs, batch_tokens=256).collect()
    runs, batches = {}, {}
    for r in rows:
        assert len(r.tokens) == r.length and r.length & (r.length - 1) == 0
        if r.piece == 0:
            runs.setdefault(str(r.doc_id), []).append([])
        assert sum(map(len, runs[str(r.doc_id)][-1])) == r.begin
        runs[str(r.doc_id)][-1].append(r.tokens)
        batches.setdefault((r.length, r.part, r.batch), []).append(r.length)
    assert sorted((d, tuple(sum(run, []))) for d, all_ in runs.items() for run in all_) == _truth(docs)
    assert all(sum(b) <= max(256, b[0]) for b in batches.values())
    last = {k[:2]: max(x[2] for x in batches if x[:2] == k[:2]) for k in batches}
    assert all(sum(b) == max(256, b[0]) for k, b in batches.items() if k[2] < last[k[:2]])


def test_packing_writes_buckets(docs, tmp_path):
    packing.write_buckets(packing.packed(docs), str(tmp_path / "b"))
    back = docs.sparkSession.read.parquet(str(tmp_path / "b"))
    assert back.where("length <> size(tokens)").count() == 0 and back.count() == packing.packed(docs).count()
    assert packing.packed(docs.where("doc_id > 9999")).count() == 0


@pytest.mark.parametrize("size", [1024, 64 << 10])
def test_store_round_trip(docs, size):
    store = ts.stored(docs, size=size).cache()
    held = store.where("kind = 'dictionary'").collect()
    assert len(held) == 1 and ts.named(bytes(held[0].frame)) == held[0].dictionary
    assert sorted((str(r.doc_id), tuple(r.tokens)) for r in ts.restored(store).collect() if r.tokens) == _truth(docs)
    rows = store.where("kind = 'document'").collect()
    assert len(rows) == docs.count() and {r.dictionary for r in rows} == {held[0].dictionary}
    by = {r.doc_id: r for r in rows}
    assert by[500].frame is None and by[500].n_tokens is None and by[501].n_tokens == 0 and by[501].size > 0
    for shard in {r.shard for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.shard == shard), key=lambda r: (r.offset, r.size)):
            assert r.offset == at and r.size == len(r.frame or b"")
            at += r.size


def test_blobs(docs, tmp_path):
    store = ts.stored(docs, size=1024)
    path = f"file://{tmp_path}/blobs"
    index = ts.write_blobs(store, path).collect()
    truth = dict(_truth(docs))
    for r in index:
        if r.n_tokens and r.doc_id != 3:
            assert tuple(ts.fetch(path, r.file, r.offset, r.size, r.dictionary).tolist()) == truth[str(r.doc_id)]


def test_a_small_table_has_a_small_dictionary(docs):
    some = docs.where("doc_id < 40")
    store = ts.stored(some)
    held = store.where("kind = 'dictionary'").collect()
    assert len(held) == 1 and 256 <= held[0].size < 16 << 10
    assert sorted((str(r.doc_id), tuple(r.tokens)) for r in ts.restored(store).collect() if r.tokens) == _truth(some)


def test_too_little_to_train_on(spark, docs):
    few = spark.createDataFrame([(1, "a b"), (2, None), (None, "c")], "doc_id long, text string")
    store = ts.stored(few)
    assert store.where("kind = 'dictionary'").count() == 0 and store.where("dictionary is not null").count() == 0
    assert sorted(str(r.doc_id) for r in ts.restored(store).collect() if r.tokens) == ["1", "None"]
    assert ts.stored(docs.where("doc_id > 9999")).count() == 0
