import random

import numpy as np
import pytest

from tessera.llm import decontaminate as dc


def _tiling(a, b, least):
    """Plain greedy string tiling over word lists."""
    used_a, used_b, found = [False] * len(a), [False] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not used_a[i + k] and not used_b[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < min(least, len(a)):
            return found
        found.append((i, j, k))
        used_a[i : i + k] = used_b[j : j + k] = [True] * k


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(60)]
    pick = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [pick(rng.randint(2, 30)) for _ in range(25)]
    docs = []
    for k in range(120):
        doc = pick(rng.randint(0, 60))
        if k % 2:
            item = items[rng.randrange(len(items))]
            cut = rng.randint(0, len(item))
            doc[len(doc) // 2 : len(doc) // 2] = rng.choice([item, item[cut:] + ["x"] + item[:cut], item[: cut + 3], item * 3])
        docs.append(doc)
    return items, docs


def _frames(spark, items, docs):
    return (
        spark.createDataFrame([(i, " ".join(d), "z", 1) for i, d in enumerate(docs)], "doc_id long, text string, seed string, item_id int"),
        spark.createDataFrame([(100 + i, " ".join(t).upper(), "q") for i, t in enumerate(items)], "item_id long, text string, doc_id string"),
    )


@pytest.mark.parametrize("limit", [dc.BROADCAST_SEEDS, 0])
def test_against_brute_force(spark, corpus, limit):
    items, docs = corpus
    found = {(r.doc_id, r.item_id - 100): r for r in dc.contained_items(*_frames(spark, items, docs), broadcast_seeds=limit).collect()}
    for d, doc in enumerate(docs):
        for t, item in enumerate(items):
            tiling = _tiling(item, doc, dc.MATCH)
            covered = sum(k for _, _, k in tiling) / len(item)
            assert ((d, t) in found) == (covered >= dc.THRESHOLD), (d, t)
            if (d, t) in found:
                r = found[d, t]
                assert (r.coverage, r.tiles, r.longest) == (round(covered, 6), len(tiling), max(k for _, _, k in tiling))
    assert len(found) > 45


def test_reordered_passage_is_caught(spark):
    words = [f"t{k}" for k in range(40)]
    docs = [["a"] * 30 + words[25:] + ["b"] * 9 + words[10:25] + ["c"] + words[:10], [w for w in words for _ in (0, 1)]]
    assert [(r.doc_id, r.coverage, r.tiles) for r in dc.contained_items(*_frames(spark, [words], docs)).collect()] == [(0, 1.0, 3)]


def test_edge_cases(spark):
    item = "one two three four five six seven"
    long = "pad " * 150000 + item
    docs = spark.createDataFrame([(1, item), (1, item), (1, "else"), (2, None), (None, item), (3, ""), (4, long), (5, "One, two; three-four five six... SEVEN!"), (6, "short thing")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, item), (3, None), (None, item), (4, ""), (5, "short thing"), (5, "short thing")], "item_id long, text string")
    for limit in (dc.BROADCAST_SEEDS, 0):
        found = sorted((r.doc_id, r.item_id) for r in dc.contained_items(docs, bench, broadcast_seeds=limit).collect())
        assert found == [(1, 1), (1, 2), (4, 1), (4, 2), (5, 1), (5, 2), (6, 5)]
        kept = dc.without_contained(docs, bench, broadcast_seeds=limit)
        assert kept.columns == docs.columns and sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == [("1", "else"), ("2", "None"), ("3", "")], "rows go by their texts, however large the benchmark"
    assert dc.contained_items(docs, bench.where("item_id < 0")).count() == 0
    assert dc.contained_items(docs.where("doc_id < 0"), bench).count() == 0


def test_runs_stay_within_texts():
    at, _ = dc.runs(np.arange(10, dtype=np.uint64), np.array([0, 4, 4, 10]), 3)
    assert at.tolist() == [0, 1, 4, 5, 6, 7]


@pytest.mark.parametrize("limit", [dc.BROADCAST_SEEDS, 0])
def test_all_texts_of_an_item_are_searched(spark, limit):
    texts = ["alpha beta gamma delta epsilon zeta", "one two three four five six seven", "two words"]
    docs = spark.createDataFrame([(k, f"pad {t} pad") for k, t in enumerate(texts)] + [(3, "pad"), (4, " ".join(texts[:2]))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, t) for t in texts], "item_id long, text string")
    found = sorted(tuple(r) for r in dc.contained_items(docs, bench, broadcast_seeds=limit).collect())
    assert found == [(0, 1, 1.0, 1, 6), (1, 1, 1.0, 1, 7), (2, 1, 1.0, 1, 2), (4, 1, 1.0, 1, 7)]
    assert [r.doc_id for r in dc.without_contained(docs, bench, broadcast_seeds=limit).collect()] == [3]


def test_both_ways_keep_the_same_rows(spark):
    item = "one two three four five six seven"
    docs = spark.createDataFrame([(1, item), (1, item), (1, "else"), (2, None), (None, item), (None, "clean"), (3, ""), (None, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    for limit in (dc.BROADCAST_SEEDS, 0):
        kept = dc.without_contained(docs, bench, broadcast_seeds=limit)
        assert kept.columns == docs.columns
        assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == [("1", "else"), ("2", "None"), ("3", ""), ("None", "None"), ("None", "clean")], limit
