import pytest
from pyspark.sql import functions as F

from tessera.config import SearchConfig
from tessera.functions.matching import cosine, vector
from tessera.operators.index import build
from tessera.operators.search import best_tokens, find, find_items, query_terms, token_cosines


def search(spark, rows, query, **settings):
    """[(text, score)] of a query over texts, or over (text, key)."""
    rows = [r if isinstance(r, tuple) else (r, r) for r in rows]
    index = build(spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "text string, key string, seq int"), "text", "key", SearchConfig(**settings), "seq")
    found = find(index, spark.createDataFrame([(1, query)], "query_id int, query string")).orderBy("rank").collect()
    return [(r.doc_id.split("\0")[0], r.score) for r in found]


@pytest.mark.parametrize(
    "texts, query, want",
    [
        (["Apple", "Banana", "Apple", "Apricot"], "Ap", [("Apple", 0.4334), ("Apricot", 0.2912), ("Banana", 0.1205)]),
        (["South Korea", "South Africa", "North Korea", "South Sudan"], "South Korea", [("South Korea", 0.9699)]),
        (["New York Travel Guide", "The New Comprehensive York County Guide"], "New York", [("New York Travel Guide", 0.9398), ("The New Comprehensive York County Guide", 0.6916)]),
        (["Tom is in a Drama with Hanks", "Tom Hanks Drama"], "Tom Hanks", [("Tom Hanks Drama", 0.9523), ("Tom is in a Drama with Hanks", 0.4720)]),
        (["Bulgaria", "Bulgaria is a beautiful country located in the Balkans"], "Bulgaria", [("Bulgaria", 1.0), ("Bulgaria is a beautiful country located in the Balkans", 0.9046)]),
        (["United Kingdom", "United States of America", "United Arab Emirates"], "Untied Kingdom", [("United Kingdom", 0.6609)]),
        (["United Kingdom", "United States of America", "United Arab Emirates"], "United Ki", [("United Kingdom", 0.4375)]),
        (["Canada", "Chad", "Panama", "Cuba"], "Cnada", [("Canada", 0.5091)]),
        (["Kotlin", "Kotlin Multiplatform Mobile Development Guide for Beginners"], "Kotlin", [("Kotlin", 1.0), ("Kotlin Multiplatform Mobile Development Guide for Beginners", 0.9155)]),
    ],
)
def test_rankings_and_scores(spark, texts, query, want):
    got = search(spark, texts, query)
    assert [t for t, _ in got[: len(want)]] == [t for t, _ in want]
    assert [s for _, s in got[: len(want)]] == pytest.approx([s for _, s in want], abs=6e-5)


def test_blank_and_tokenless_queries_and_texts(spark):
    assert search(spark, ["Apple"], "") == search(spark, ["Apple"], " ") == search(spark, ["Apple"], "---") == search(spark, [], "x") == []
    assert search(spark, ["---", "Alpha", None], "alpha") == [("Alpha", 1.0)]


def test_a_small_vocabulary_answers_even_without_a_common_feature(spark):
    assert search(spark, ["Alpha", "Beta", "Gamma"], "Zzzzz") == [("Alpha", 0.0), ("Beta", 0.0), ("Gamma", 0.0)]


def test_one_result_for_each_key(spark):
    rows = [("Bulgaria", "BG"), ("България", "BG"), ("Bulgarien", "DE"), ("Deutschland", "DE")]
    got = search(spark, rows, "Bulg")
    assert len(got) == 2 and got[0][0] == "Bulgaria" and len(search(spark, [(f"item {k}", str(k)) for k in range(30)], "item", max_results=7)) == 7


def test_query_tokens_beyond_five_do_not_count(spark):
    assert search(spark, ["a b c d e", "f g"], "a b c d e f g") == search(spark, ["a b c d e", "f g"], "a b c d e")


def _plain(texts, query, config=SearchConfig()):
    """The search of the module's text, one document after the other."""
    import math
    import re

    split = lambda t: list(dict.fromkeys(w for w in re.split(r"[\W_]+", t.lower()) if w))
    docs = {t: split(t) for t in texts}
    wanted = split(query)[:5]
    vocabulary = sorted({w for d in docs.values() for w in d})
    cos = {(q, w): round(cosine(vector(q, config), vector(w, config)), 9) for q in wanted for w in vocabulary}
    best = {q: sorted(vocabulary, key=lambda w: (-cos[q, w], w))[: config.max_results] for q in wanted}
    ranges = {}
    for t, words in docs.items():
        hits = [k for k, w in enumerate(words) if any(w in best[q] for q in wanted)]
        if hits:
            ranges[t] = (max(hits[0] - config.window_slack, 0), hits[-1] + config.window_slack + 1)
    inside = {w for t, (lo, hi) in ranges.items() for w in docs[t][lo:hi]}
    out = []
    for t in ranges:
        scores, places = [], []
        for q in wanted:
            value, place = 0.0, None
            for k, w in enumerate(docs[t]):
                if w in inside and cos[q, w] > value:
                    value, place = cos[q, w], k
            scores.append(value)
            places += [place] if place is not None else []
        base = scores[0] if len(wanted) == 1 else len(wanted) / sum(1 / max(s, 1e-6) for s in scores)
        places.sort()
        near = sum(1 / 2 ** (max(b - a - 1, 0) + 1) for a, b in zip(places, places[1:])) / ((len(places) - 1) * 0.5) if len(places) > 1 else 0.0 if len(places) == 1 and len(wanted) > 1 else 1.0
        score = base * (1 - config.adjacency_bonus * (1 - near)) * max(0.5, 1 - 0.1 * math.log10(len(docs[t])))
        out.append((t, round(min(max(score, 0), 1), 6)))
    return sorted(out, key=lambda r: (-r[1], r[0]))[: config.max_results]


def test_against_plain_python(spark):
    import random

    rng = random.Random(4)
    words = "red green blue widget gadget gizmo large small medium fast slow kotlin spark table chair lamp".split()
    texts = sorted({" ".join(rng.choice(words) + rng.choice(["", "", "s", "er"]) for _ in range(rng.randint(1, 14))) for _ in range(60)})
    queries = ["red widgte", "smal lamp tabel", "kotln", "fast slow medium chair gizmos extra", "zzz"]
    config = SearchConfig(max_results=6, window_slack=1)
    index = build(spark.createDataFrame([(t,) for t in texts], "text string"), "text", config=config)
    got = {}
    for r in find(index, spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id.split("\0")[0], r.score))
    for k, q in enumerate(queries):
        want = _plain(texts, q, config)
        assert [t for t, _ in got[k]] == [t for t, _ in want] and [s for _, s in got[k]] == pytest.approx([s for _, s in want], abs=2e-6), q


def test_items_come_with_results_only_from_a_store(spark):
    rows = spark.createDataFrame([(1, "Red lamp", 9.5), (2, "Blue chair", 7.0)], "id int, name string, price double")
    queries = spark.createDataFrame([("q", "lamp")], "query_id string, query string")
    assert find_items(build(rows, "name", "id"), queries) is None
    got = find_items(build(rows, "name", "id", SearchConfig(have_store=True)), queries).where("rank = 1").first()
    assert (got.id, got.price) == (1, 9.5)


def test_plan_has_no_python_and_broadcasts_the_query(spark):
    index = build(spark.createDataFrame([("a b", "1")], "text string, key string"))
    queries = spark.createDataFrame([(1, "a")], "query_id int, query string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    near = token_cosines(index, query_terms(queries, index.config))
    assert "BroadcastHashJoin" in plan(near) and "Python" not in plan(near) + plan(find(index, queries)) + plan(best_tokens(index, query_terms(queries, index.config), near))


def test_search_moves_no_texts_and_skips_postings(spark, tmp_path):
    from tessera.operators.search import pushed

    index = build(spark.createDataFrame([("red lamp", "1"), ("blue chair", "2")], "text string, key string")).saved(str(tmp_path / "i"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(token" in plan(pushed(index.postings, ["red", "lamp"]))
    final = plan(find(index, spark.createDataFrame([(1, "rde")], "query_id int, query string")))
    moved = [line for line in final.splitlines() if "Exchange hashpartitioning" in line or "Window" in line]
    assert moved and not any(name in line for line in moved for name in (" tokens#", " doc_id#", " text#", "(tokens#", "(doc_id#"))


def test_queries_of_equal_tokens_are_answered_each(spark):
    index = build(spark.createDataFrame([("red lamp", "1")], "text string, key string"))
    queries = spark.createDataFrame([(1, "Red"), (2, "red "), (2, "lamp"), (3, ""), (4, None)], "query_id int, query string")
    assert sorted((r.query_id, r.score) for r in find(index, queries).collect()) == sorted([(1, 0.969897)] * 1 + [(2, 0.969897)] * 2)


def test_text_functions(spark):
    from tessera.functions.text import doc_id, key_of, text_of, tokens

    row = spark.createDataFrame([("Congo (Congo-Brazzaville) 2 über", 5)], "t string, k int").select(tokens(F.col("t")).alias("a"), text_of(doc_id(F.col("t"), F.col("k"))).alias("b"), key_of(doc_id(F.col("t"), F.col("k"))).alias("c")).first()
    assert row.a == ["congo", "brazzaville", "2", "über"] and row.b.startswith("Congo (") and row.c == "5"


@pytest.mark.parametrize("limit", [4, 24])
def test_few_broadcast_tokens_give_equal_results(spark, monkeypatch, limit):
    """where the tokens with a cosine are too many to broadcast, the nearest ones and bounds lead to the same ranking."""
    import random

    from tessera.operators import search as s

    rng = random.Random(7)
    words = ["".join(rng.choice("abcdeinrst") for _ in range(rng.randint(2, 7))) for _ in range(60)] + ["alpha"]
    texts = sorted({" ".join(rng.sample(words, rng.randint(1, 6)) + ["alpha"] * (k % 3 == 0)) for k in range(70)})
    config = SearchConfig(max_results=4, window_slack=0)
    index = build(spark.createDataFrame([(t, t[:3]) for t in texts], "text string, key string"), config=config)
    queries = spark.createDataFrame(list(enumerate([words[3][:-1] + " alpha", words[5] + "x " + words[9], "alpa"])), "query_id int, query string")
    rows = lambda: sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in find(index, queries).collect())
    want, floors = rows(), []
    monkeypatch.setattr(s, "BROADCAST_PAIRS", limit)
    heads = s.heads
    monkeypatch.setattr(s, "heads", lambda *a: floors.append(heads(*a)) or floors[-1])
    assert rows() == want and len(want) == 12 and any(floors[0].values())


def test_written_postings_name_documents_by_number_and_nothing_is_shuffled(spark, tmp_path):
    """a saved index takes less disk than the texts that it moved before."""
    index = build(spark.createDataFrame([("red lamp", "1"), ("blue lamp", "2")], "text string, key string")).saved(str(tmp_path / "i"))
    assert dict(spark.read.parquet(str(tmp_path / "i" / "postings")).dtypes) == {"token": "string", "num": "bigint", "pos": "int"} and not (tmp_path / "i" / "vectors").exists()
    assert sorted((r.token, r.pos) for r in index.postings.collect()) == [("blue", 0), ("lamp", 1), ("lamp", 1), ("red", 0)]
    from tessera.functions.features import vectors

    plan = vectors(spark.createDataFrame([("lamp",)], "token string"))._jdf.queryExecution().executedPlan().toString()
    assert not any(step in plan for step in ("Exchange", "Window", "Aggregate", "Sort ["))


def test_steps_read_what_was_written(spark, tmp_path):
    """the last step doesn't derive documents, cosines and candidates from the table again; the ranges of many candidates are found where documents are read."""
    from tessera.operators import search as s
    from tessera.plans.queries import QUERIES

    names = ["small blue widget", "large green gizmo", "red gadget", "smal bolt"]
    spark.createDataFrame([(k, names[k % 4], "Brand#1", "SMALL", k) for k in range(24)], "p_partkey int, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    rows = lambda: sorted(map(tuple, QUERIES["best_token_match"](spark, str(tmp_path)).collect()))
    want, limit = rows(), s.BROADCAST_PAIRS
    assert "part.parquet" not in QUERIES["best_token_match"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    try:
        s.BROADCAST_PAIRS = 10
        assert rows() == want and len(want) > 24
    finally:
        s.BROADCAST_PAIRS = limit


def test_a_large_vocabulary_is_embedded_row_by_row(spark):
    """no task sorts or gathers the features of its tokens; before, a window and an aggregation held them all."""
    index = build(spark.createDataFrame([("Customer#000000017", "17")], "text string, key string"))
    plan = token_cosines(index, query_terms(spark.createDataFrame([(1, "000000017")], "query_id int, query string"), index.config))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and not any("Aggregate(keys=[token" in line and "feature" in line.split("functions")[0] for line in plan.splitlines())
