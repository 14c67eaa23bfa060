import pytest

from tessera.config import SearchConfig
from tessera.functions.features import vectors
from tessera.functions.matching import vector
from tessera.operators.index import build, empty
from tessera.operators.search import find, find_items
from tessera.sources.snapshot import export, restore
from tessera.streaming.live import without_repeats


def _docs(spark, *rows):
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "docId string, title string, version int, seq int")


def _index(spark, *rows, store=True):
    return build(_docs(spark, *rows), "title", "docId", SearchConfig(have_store=store), "seq")


def _size(index):
    return index.size().first()[0]


def test_first_write_wins(spark):
    index = _index(spark, ("1", "Same", 1), ("1", "Same", 2))
    assert _size(index) == 1 and index.items().first().version == 1
    again = index.added(_docs(spark, ("1", "Same", 3), ("2", "Same", 4)), "seq")
    assert sorted(r.version for r in again.items().collect()) == [1, 4] and _size(index) == 1


def test_removal_and_reinsertion(spark):
    index = _index(spark, ("1", "Same", 1))
    gone = index.removed(_docs(spark, ("1", "Same", 9)))
    assert _size(gone) == 0 and gone.added(_docs(spark, ("1", "Same", 2))).items().first().version == 2


def test_texts_and_keys_make_an_identity(spark):
    assert _size(_index(spark, ("BG", "Bulgaria", 1), ("BG", "България", 1), ("BG", "Bulgarien", 1))) == 3
    hello = _index(spark, ("0", "hello", 1), ("5", "hello", 1), ("0", "hello", 2), ("10", "world", 1))
    assert _size(hello) == 3
    left = hello.removed(_docs(spark, ("5", "hello", 1)))
    assert sorted(r.key for r in left.docs.collect()) == ["0", "10"]
    assert _size(_index(spark, ("1", "", 1), ("1", "Bulgaria", 1), ("1", None, 2))) == 2


def test_postings_and_vocabulary(spark):
    index = _index(spark, ("1", "Kotlin Multiplatform", 1), ("2", "Kotlin Coroutines", 1), ("3", "Java Concurrency", 1), ("4", "New York New Jersey", 1), ("5", "---", 1))
    assert {(r.token, r.pos) for r in index.postings.join(index.docs.where("key = '4'").select("uid"), "uid").collect()} == {("new", 0), ("york", 1), ("jersey", 2)}
    assert index.vocabulary.count() == 8 and _size(index) == 5
    left = index.removed(_docs(spark, ("1", "Kotlin Multiplatform", 1)))
    assert {r.token for r in left.vocabulary.collect()} == {r.token for r in index.vocabulary.collect()} - {"multiplatform"}
    assert left.postings.where("token = 'kotlin'").count() == 1


def test_contains_clear_merge(spark):
    index = _index(spark, ("1", "One", 1), ("2", "Two", 1))
    probe = _docs(spark, ("1", "One", 7), ("1", "Two", 7), ("2", "Two", 8))
    assert sorted(r.version for r in index.contains(probe).collect()) == [7, 8]
    assert _size(index.cleared()) == 0 and index.cleared().items().count() == 0
    merged = index.merged(_index(spark, ("2", "Two", 5), ("3", "Three", 5)))
    assert sorted((r.docId, r.version) for r in merged.items().collect()) == [("1", 1), ("2", 5), ("3", 5)]
    with pytest.raises(ValueError):
        index.merged(build(probe, "title", "docId", SearchConfig(have_store=True, max_ngram=3)))
    with pytest.raises(ValueError):
        index.merged(build(probe, "title", "docId", SearchConfig(have_store=False)))


def test_written_tables_are_carried_on(spark, tmp_path):
    """Changes of a saved index give what building anew gives, and embed new tokens alone."""
    rows = [("1", "Red lamp", 1), ("2", "Blue chair", 1), ("3", "Red chair", 1)]
    saved = _index(spark, *rows).saved(str(tmp_path / "a"))
    other = _index(spark, ("3", "Red chair", 5), ("4", "Green sofa", 5)).saved(str(tmp_path / "b"))
    changed = {
        "added": (saved.added(_docs(spark, ("5", "Green lamp", 1), ("1", "Red lamp", 2)), "seq"), [*rows, ("5", "Green lamp", 1)]),
        "removed": (saved.removed(_docs(spark, ("2", "Blue chair", 1))), [rows[0], rows[2]]),
        "merged": (saved.merged(other), [rows[0], rows[1], ("3", "Red chair", 5), ("4", "Green sofa", 5)]),
        "both": (saved.removed(_docs(spark, rows[1])).added(_docs(spark, ("6", "Blue moon", 1))), [rows[0], rows[2], ("6", "Blue moon", 1)]),
    }
    queries = spark.createDataFrame([(1, "rde chiar"), (2, "green")], "query_id int, query string")
    plain = lambda df: sorted(map(str, df.collect()))
    for name, (index, want) in changed.items():
        fresh = _index(spark, *want)
        assert index.vectors_table is not None and plain(find(index, queries)) == plain(find(fresh, queries)), name
        assert plain(index.items().drop("seq")) == plain(fresh.items().drop("seq")) and plain(index.postings) == plain(fresh.postings) and index.docs.columns == fresh.docs.columns, name
        rounded = lambda v: sorted((r.token, r.feature, round(r.w, 9)) for r in v.collect())
        assert rounded(index.vectors) == rounded(fresh.vectors), name


def test_columns_of_clashing_names(spark, tmp_path):
    rows = spark.createDataFrame([(1, "Red lamp", 7, "a", 9, ["x"]), (2, "Blue chair", 8, "b", 9, ["y"])], "id int, name string, rank int, _uid string, score int, tokens array<string>")
    index = build(rows, "name", "id", SearchConfig(have_store=True))
    assert sorted(r._uid for r in index.contains(rows).collect()) == ["a", "b"]
    got = find_items(index, spark.createDataFrame([(1, "lamp")], "query_id int, query string")).where("rank = 1")
    assert got.columns == ["query_id", "rank", "score", "id", "name", "item_rank", "_uid", "item_score", "tokens"] and got.first().item_rank == 7
    export(index, str(tmp_path / "s"))
    back = restore(spark, str(tmp_path / "s"), "name", "id")
    assert sorted(r.tokens[0] for r in back.items().collect()) == ["x", "y"] and back.docs.where("key = '1'").first().tokens == ["red", "lamp"]
    path = str(tmp_path / "rows")
    rows.withColumn("doc_id", rows.id).write.parquet(path)
    stream = without_repeats(spark.readStream.schema(spark.read.parquet(path).schema).parquet(path), "name", "id")
    assert stream.columns == [*rows.columns, "doc_id"] and dict(stream.dtypes)["doc_id"] == "int"


def test_without_store_there_are_no_items(spark):
    index = _index(spark, ("1", "One", 1), store=False)
    assert _size(index) == 1 and index.items().count() == 0


def test_empty_index(spark):
    index = empty(spark)
    queries = spark.createDataFrame([(1, "x")], "query_id int, query string")
    assert _size(index) == 0 and find(index, queries).count() == 0
    assert find(index.added(spark.createDataFrame([("x y", "1")], "text string, key string")), queries).count() == 1


def test_saved_index_answers_alike(spark, tmp_path):
    index = _index(spark, ("1", "Red lamp", 1), ("2", "Blue chair", 1), ("3", "Red chair", 1))
    queries = spark.createDataFrame([(1, "rde chiar")], "query_id int, query string")
    saved = index.saved(str(tmp_path / "i"))
    assert sorted(find(saved, queries).collect()) == sorted(find(index, queries).collect())
    assert saved.postings_table.count() == 6 and saved.items().count() == 3


@pytest.mark.parametrize("settings", [{}, {"max_ngram": 2, "char_bag_weight": 0.0, "prefix_weight": 2.0}])
def test_vectors(spark, settings):
    config = SearchConfig(**settings)
    words = ["can", "a", "aba", "bulgaria", "mississippi", "щастие", "ab"]
    got = {}
    for r in vectors(spark.createDataFrame([(w,) for w in words], "token string"), config).collect():
        got.setdefault(r.token, {})[r.feature] = r.w
    for w in words:
        want = vector(w, config)
        assert got[w].keys() == want.keys() and all(abs(got[w][f] - x) < 1e-12 for f, x in want.items())


def test_known_vector():
    raw = {"A_c": 1, "G_c_3_n": 1, "P_c": 1, "P_ca": 2, "P_can": 3, "F_c_a": 2, "F_c_an": 3, "CB_c": 4, "CB_a": 4, "CB_n": 4, "ca": 2, "an": 2, "can": 3, "cn": 1}
    assert vector("can", SearchConfig()) == pytest.approx({f: w / 95**0.5 for f, w in raw.items()})
