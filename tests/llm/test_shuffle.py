import numpy as np
import pytest

from tessera.llm import shuffle as sh


def test_rows_and_columns_of_the_matrix_add_up():
    rng = np.random.default_rng(1)
    for _ in range(40):
        sizes = rng.integers(0, 50, rng.integers(1, 12))
        shards = sh.shard_sizes(int(sizes.sum()), int(rng.integers(1, 9)))
        matrix = np.stack([sh.row_of(sizes, shards, p, 3) for p in range(len(sizes))])
        assert (matrix >= 0).all() and matrix.sum(1).tolist() == sizes.tolist() and matrix.sum(0).tolist() == shards.tolist()


def test_matrix_is_hypergeometric():
    sizes, shards = np.array([6, 3, 5, 4]), np.array([7, 5, 6])
    drawn = np.stack([np.stack([sh.row_of(sizes, shards, p, seed) for p in range(4)]) for seed in range(4000)])
    assert np.allclose(drawn.mean(0), np.outer(sizes, shards) / 18, atol=0.06)
    n = 18
    var = np.outer(sizes, shards) * np.outer(n - sizes, n - shards) / (n * n * (n - 1))
    assert np.allclose(drawn.var(0), var, rtol=0.1)


def test_large_draws_agree_with_the_exact_ones(monkeypatch):
    args = (400, 900, 300)
    rng = np.random.default_rng(5)
    exact = rng.hypergeometric(*args, 20000)
    monkeypatch.setattr(sh, "_EXACT", 10)
    own = np.array([sh.hypergeometric(rng, *args) for _ in range(20000)])
    assert abs(own.mean() - exact.mean()) < 0.3 and abs(own.std() / exact.std() - 1) < 0.03
    assert np.abs(np.bincount(own, minlength=200)[:200] - np.bincount(exact, minlength=200)[:200]).max() < 250
    assert all(sh.hypergeometric(rng, a, b, c) == d for a, b, c, d in ((0, 20, 5, 0), (20, 0, 5, 5), (12, 13, 25, 12), (12, 13, 0, 0)))
    assert abs(sh.hypergeometric(rng, 3 * 10**10, 7 * 10**10, 10**9) / 3e8 - 1) < 0.001


@pytest.mark.parametrize("shards, block_rows", [(1, 8), (4, sh.BLOCK_ROWS), (4, 9), (300, 1)])
def test_every_row_once(spark, shards, block_rows):
    rows = [(k % 90, None if k % 7 == 0 else f"t{k % 50}", "old", 1) for k in range(200)] + [(None, "", "old", 1), (5, "x" * 300000, "old", 1)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 5), "doc_id long, text string, shard string, key int")
    out = sh.shuffled(docs, shards, block_rows=block_rows)
    assert out.columns == ["doc_id", "text", "key", "shard", "position"]
    got = out.collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(r[0]), str(r[1])) for r in rows)
    sizes = [sum(r.shard == s for r in got) for s in range(shards)]
    assert sizes == sh.shard_sizes(202, shards).tolist()
    assert all(sorted(r.position for r in got if r.shard == s) == list(range(sizes[s])) for s in range(shards))
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, got), key=str)


def test_blocks_change_nothing(spark):
    docs = spark.range(1000, numPartitions=7)
    one, many = (sorted(map(tuple, sh.shuffled(docs, 3, block_rows=n).collect())) for n in (1 << 20, 10))
    assert one == many


def test_rows_meet_every_place_equally_often(spark):
    docs = spark.range(12, numPartitions=3)
    place = np.zeros((12, 12))
    for seed in range(60):
        for r in sh.shuffled(docs, 3, seed).collect():
            place[r.id, r.shard * 4 + r.position] += 1
    assert place.sum(0).tolist() == [60] * 12 and ((place - 5) ** 2 / 5).sum() < 190


def test_shuffled_input_and_empty_table(spark):
    docs = spark.range(100).repartition(4, "id")
    assert sorted(r.id for r in sh.shuffled(docs, 3).collect()) == list(range(100))
    assert sh.shuffled(docs.where("id > 999"), 3).count() == 0
