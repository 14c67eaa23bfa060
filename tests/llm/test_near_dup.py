import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import near_dup as nd
from tessera.llm import tables
from tessera.llm.words import words_of

SCHEMA = "doc_id long, text string, sig string, rep long, a long"


def _sets(texts):
    w = words_of(texts)
    h, first = nd._sorted_sets(*nd.shingles(w.hash, w.first))
    return [set(h[s:e].tolist()) for s, e in zip(first, first[1:])]


def _brute(rows, threshold):
    ids, sets = [r[0] for r in rows], _sets([r[1] for r in rows])
    for i in range(len(ids)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                    yield ids[j], ids[i]


def _groups(spark, rows, **settings):
    df = spark.createDataFrame([(*r, "x", 5, 6) for r in rows], SCHEMA)
    groups = {}
    for r in nd.near_duplicate_groups(df, **settings).collect():
        groups.setdefault(r.group_id, []).append((r.doc_id, r.n_docs))
    assert all(g == min(members)[0] and {n for _, n in members} == {len(members)} for g, members in groups.items())
    return [sorted(d for d, _ in members) for members in groups.values()]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 120))]
        for _ in range(rng.choice([1, 2, 3, 6])):
            words = [w if rng.random() > 0.06 else rng.choice(vocabulary) for w in base]
            rows.append((len(rows), " ".join(words)))
    hot = [rng.choice(vocabulary) for _ in range(80)]
    for _ in range(60):
        rows.append((len(rows), " ".join(w if rng.random() > 0.04 else rng.choice(vocabulary) for w in hot)))
    return rows


@pytest.mark.parametrize("settings", [{"leaf": 8}, {}, {"leaf": 8, "node_rows": 20}, {"leaf": 4, "node_rows": 12, "max_depth": 2}])
def test_recall_against_brute_force(spark, corpus, settings):
    groups = _groups(spark, corpus, **settings)
    at = {d: k for k, g in enumerate(groups) for d in g}
    truth = list(_brute(corpus, nd.THRESHOLD))
    found = sum(at.get(a, -1) == at.get(b, -2) for a, b in truth)
    assert len(truth) > 500 and found >= 0.97 * len(truth)
    linked = {d for p in truth for d in p}
    assert set(at) <= linked, "a document without a near copy is left alone"
    # a group holds no more than the components of brute force
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in truth:
        root[find(a)] = find(b)
    assert all(len({find(d) for d in g}) == 1 for g in groups)


def test_edge_cases(spark):
    long = " ".join(f"t{i % 977} u{i}" for i in range(60000))
    rows = [(1, None), (2, ""), (3, " ,;! "), (4, "Same text here"), (5, "same  TEXT, here"), (5, "same  TEXT, here"), (None, "same text here"), (6, "word"), (7, "word"), (8, long), (9, long + " end"), (10, "lonely words only"), (11, ""), (4, "Same text here")]
    groups = sorted(_groups(spark, rows))
    assert groups == [[4, 5], [6, 7], [8, 9]]


def test_empty_table(spark):
    assert _groups(spark, []) == []


def test_dropping_copies_keeps_one(spark):
    rows = [(1, "alpha beta gamma"), (2, "alpha beta gamma"), (3, "other text entirely"), (3, "other text entirely"), (None, "alpha beta gamma"), (4, None), (4, "x y z"), (9, "")]
    df = spark.createDataFrame([(*r, "x", 5, 6) for r in rows], SCHEMA)
    out = nd.without_near_duplicates(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in out.collect()) == [(False, 1, "alpha beta gamma"), (False, 3, "other text entirely"), (False, 4, ""), (False, 4, "x y z"), (False, 9, ""), (True, 0, "alpha beta gamma")]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(70)] + [(200, 201), (201, 200), (300, 300)], "a long, b long")
    roots = {r.v: r.root for r in nd.components(edges).collect()}
    assert roots == {**{i: 0 for i in range(1, 71)}, 201: 200}


def test_large_node_gives_up_its_clusters():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 65536, nd.SIGNATURE, dtype=np.uint16)
    sig = rng.integers(0, 65536, (400, nd.SIGNATURE), dtype=np.uint16)
    sig[:200] = base
    sig[np.arange(200), rng.integers(0, nd.SIGNATURE, 200)] += 1
    *pairs, stay = nd._clusters(sig, 50, nd.THRESHOLD)
    assert set(stay.tolist()) == set(range(200, 400)) and {int(x) for p in pairs for x in p[1]} | {int(p[0][0]) for p in pairs if len(p[0])} == set(range(200))


def _false_pair(rng):
    """Two texts of a shared template whose signatures agree as sure pairs do, though their Jaccard similarity is below the threshold."""
    base = [f"b{k}" for k in range(120)]
    texts = [" ".join(base + [f"x{rng.getrandbits(60)}" for _ in range(43)]) for _ in range(400)]
    sets = _sets(texts)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    sig = nd._matrix(pa.concat_arrays([b.column(2) for b in nd._signatures(iter([batch]))]))
    for i in range(len(texts)):
        for j in np.flatnonzero((sig == sig[i]).sum(1) >= (nd.THRESHOLD + nd.SLACK) * nd.SIGNATURE):
            if j != i and len(sets[i] & sets[j]) < (nd.THRESHOLD - 0.01) * len(sets[i] | sets[j]):
                return texts[i], texts[j]


def test_cells_look_at_all_pairs_of_a_large_node(spark):
    rng = np.random.default_rng(2)
    sig = rng.integers(0, 65536, (300, nd.SIGNATURE), dtype=np.uint16)
    for k in range(120):  # chains of rows that agree, most of them far from any leader's cluster
        sig[k + 1, : 40 + k % 20] = sig[k, : 40 + k % 20]
    rows = [(1 + (k >= 250), k, bytearray(sig[k].tobytes())) for k in range(300)]
    frame = spark.createDataFrame(rows, "node long, rep long, sig binary").selectExpr("*", "if(node = 1, 250L, 50L) as n")
    pairs, _ = nd._large_nodes(frame, 4, nd.THRESHOLD, True, 16)
    rows, bundles = pairs.collect(), {}
    for r in rows:
        if r.bundle is not None:
            bundles.setdefault(r.bundle, set()).update((r.a, r.b))
    got = {(r.a, r.b) for r in rows}
    near = {(a, b) for a in range(250) for b in range(a + 1, 250) if (sig[a] == sig[b]).sum() >= (nd.THRESHOLD - nd.SLACK) * nd.SIGNATURE}
    assert near and got <= near and all(any({a, b} <= members for members in bundles.values()) for a, b in near - got)


def test_repeated_rows_are_no_group(spark):
    assert _groups(spark, [(1, "one text here"), (1, "one text here"), (2, "another one there")]) == []


def test_links_count_verified_pairs(spark):
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h i"), (3, "a b c d e f g h"), (4, "x y")]
    df = spark.createDataFrame([(*r, "x", 5, 6) for r in rows], SCHEMA)
    assert sorted(tuple(r) for r in nd.near_duplicate_groups(df).collect()) == [(1, 1, 3, 1), (2, 1, 3, 1), (3, 1, 3, 1)]


def test_sure_signatures_are_verified(spark):
    one, other = _false_pair(random.Random(4))
    assert _groups(spark, [(1, one), (2, other), (3, one + " end")]) == [[1, 3]]


@pytest.mark.parametrize("cell_rows", [2, nd.CELL_ROWS])
def test_pairs_that_a_false_pair_stood_for_are_compared(spark, cell_rows):
    sig = np.zeros((7, nd.SIGNATURE), np.uint16)
    sig[4] = 9
    reps = spark.createDataFrame([(k + 1, bytearray(sig[k].tobytes())) for k in range(7)], "digest long, sig binary")
    pairs = spark.createDataFrame([(1, 2, 70), (1, 3, 70), (1, 5, 70), (1, 6, 70), (1, 7, 70), (3, 4, 71), (2, 4, None)], "a long, b long, bundle long")
    checked = spark.createDataFrame([(1, 3), (3, 4), (1, 6), (1, 7)], "a long, b long")
    found = nd.left_out(pairs, checked, nd.components(checked), reps, nd.THRESHOLD, cell_rows)
    assert {(r.a, r.b) for r in found.collect()} == {(2, 3), (2, 6), (2, 7)}, "2 and 5 fell off; 5 agrees with none, 4 is of a bundle that holds"


def test_rows_that_share_an_id_go_by_their_text(spark):
    x, y, clean = "alpha beta gamma delta", "one two three four", "text of its own here"
    rows = [(3, x, "s"), (7, x, "s"), (7, y, "s"), (9, y, "s"), (7, clean, "s"), (8, "a b c d e f g h i j", "s"), (8, "a b c d e f g h i j k", "s"), (5, "same words", "t"), (5, "same  WORDS", "s"), (5, "", "s"), (6, None, "s"), (None, x, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [tuple(r) for r in nd.without_near_duplicates(df).collect()]
    eight = [r for r in got if r[0] == 8]
    assert len(eight) == 1 and eight[0] in rows
    assert sorted((r for r in got if r[0] != 8), key=str) == sorted([(3, x, "s"), (7, y, "s"), (7, clean, "s"), (5, "same  WORDS", "s"), (5, "", "s"), (6, None, "s"), (None, x, "s")], key=str)


@pytest.mark.parametrize("limit", [0, 100])
def test_sets_of_ids_too_large_to_broadcast(spark, limit):
    rows = spark.createDataFrame([(k, None if k % 10 == 0 else k % 37, "x") for k in range(300)], "n long, _maybe long, marks string")
    ids = spark.createDataFrame([(k,) for k in (1, 5, 5, 36, 400)], "id long")
    inside = {k for k in range(300) if k % 10 and k % 37 in (1, 5, 36)}
    assert {r.n for r in tables.only(rows, "_maybe", ids, limit).collect()} == inside
    rest = tables.without(rows, "_maybe", ids, limit)
    assert sorted(r.n for r in rest.collect()) == sorted(set(range(300)) - inside) and rest.columns == rows.columns
    assert inside <= {r.n for r in tables.only(rows, "_maybe", ids, limit, exact=False).collect()}


def test_bitmap_in_the_driver(spark):
    values = np.random.default_rng(3).integers(-(2**62), 2**62, 500)
    power = tables.bits(500)
    marks = tables.held(tables.bitmap(spark.createDataFrame([(int(v),) for v in values], "v long"), power), power)
    assert tables.among(marks, values).all() and tables.among(marks, values * 31 + 7).mean() < 0.15


def test_facts_of_hot_keys(spark):
    rows = tables.written(spark.createDataFrame([(k % 3, k) for k in range(30)] + [(9, 99)], "key int, v int"), "rows")
    facts = tables.written(spark.createDataFrame([(0, 10, "a"), (1, 3, "b"), (9, 1, "c")], "key int, n long, fact string"), "facts")
    got = tables.looked_up(rows, "key", facts, "n", hot=5)
    assert sorted((r.v, r.fact) for r in got.collect()) == sorted([(k, "ab"[k % 3]) for k in range(30) if k % 3 < 2] + [(99, "c")])
