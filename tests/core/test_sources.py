import json

import pytest

from tessera.config import SearchConfig
from tessera.operators.index import build
from tessera.operators.search import find
from tessera.sources.files import file_tree, find_files
from tessera.sources.lines import fetched_lines, keyed_lines, read_lines, stream_lines
from tessera.sources.snapshot import export, restore
from tessera.streaming.live import LiveIndex, loaded, search_stream


def _rows(spark):
    return spark.createDataFrame([(1, "Red lamp", "EU"), (2, "Blue chair", "US"), (3, "---", "US")], "id int, name string, market string")


def _queries(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")


@pytest.mark.parametrize("store", [True, False])
@pytest.mark.parametrize("form", ["lines", "array"])
def test_snapshot(spark, tmp_path, store, form):
    config = SearchConfig(have_store=store, max_ngram=3, adjacency_bonus=0.25)
    index = build(_rows(spark), "name", "id", config)
    path = str(tmp_path / "snapshot")
    export(index, path, single_file=True)
    lines = [json.loads(r.value) for r in spark.read.text(path).collect()]
    assert [r["type"] for r in lines][0] == "metadata" and {r["type"] for r in lines[1:5]} == {"vocab"} and {r["type"] for r in lines[5:]} == {"payload" if store else "token_payload"}
    assert lines[0]["maxNgramSize"] == 3 and lines[1]["vector"]["features"] == sorted(lines[1]["vector"]["features"])
    if form == "array":
        path = str(tmp_path / "array.json")
        (tmp_path / "array.json").write_text(json.dumps(lines, indent=1))
    back = restore(spark, path, "name", "id")
    assert back.config == config
    assert sorted((r.doc_id, tuple(r.tokens)) for r in back.docs.collect()) == sorted((r.doc_id, tuple(r.tokens)) for r in index.docs.collect())
    assert sorted(r.name for r in back.items().collect()) == (["---", "Blue chair", "Red lamp"] if store else [])
    got, want = (sorted((r.doc_id, r.score) for r in find(i, _queries(spark, "rde lapm")).collect()) for i in (back, index))
    assert [g[0] for g in got] == [w[0] for w in want] and [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=1e-4)


def test_lines(spark, tmp_path):
    lines = ["tt1\tCarmen  City ", "tt2,Blue, with comma", "tt3 One\r", "", "   ", ",no key", "alone", "x  two blanks"]
    got = [(r.key, r.title) for r in keyed_lines(spark.createDataFrame([(x,) for x in [*lines, None]], "value string")).collect()]
    assert got == [("tt1", "Carmen  City"), ("tt2", "Blue, with comma"), ("tt3", "One"), ("", ""), ("", ""), ("", ""), ("alone", ""), ("x", "two blanks"), ("", "")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("k1 Title one\nk2\tTitle two\n")
    assert read_lines(spark, str(tmp_path / "in")).count() == 2
    stream = stream_lines(spark, str(tmp_path / "in"))
    q = stream.writeStream.format("memory").queryName("lines").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.title for r in spark.table("lines").collect()) == ["Title one", "Title two"]


def test_lines_of_addresses(spark, tmp_path):
    import functools
    import http.server
    import threading

    (tmp_path / "a.txt").write_bytes("tt1\tCarmen ñ\r\ntt2,Blue\n\nlast".encode() + b"\xff")
    (tmp_path / "b.txt").write_text("x 1\n" * 5000)
    (tmp_path / "empty.txt").write_text("")
    quiet = type("Quiet", (http.server.SimpleHTTPRequestHandler,), {"log_message": lambda *_: None})
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), functools.partial(quiet, directory=str(tmp_path)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        address = f"http://127.0.0.1:{server.server_port}"
        urls = spark.createDataFrame([(f"{address}/{n}.txt",) for n in ("a", "b", "empty")] + [(None,)], "url string")
        got = fetched_lines(urls, chunk=1000)
        first = got.where(got.url.endswith("a.txt")).orderBy("line")
        assert [r.value for r in first.collect()] == ["tt1\tCarmen ñ", "tt2,Blue", "", "last\ufffd"]
        assert [(r.key, r.title) for r in keyed_lines(first).collect()][:2] == [("tt1", "Carmen ñ"), ("tt2", "Blue")]
        assert got.where(got.url.endswith("b.txt")).count() == 5000 and got.count() == 5004
        urls.write.parquet(str(tmp_path / "urls"))
        stream = fetched_lines(spark.readStream.schema("url string").parquet(str(tmp_path / "urls")))
        stream.writeStream.format("memory").queryName("fetched").trigger(availableNow=True).start().awaitTermination()
        assert spark.table("fetched").count() == 5004
    finally:
        server.shutdown()


def test_files(spark, tmp_path):
    for name in ("a/report.txt", "a/b/summary.md", "c/report.txt", "c/reprot-old.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    tree = file_tree(spark, str(tmp_path))
    assert sorted(r.name for r in tree.collect()) == ["report.txt", "report.txt", "reprot-old.txt", "summary.md"]
    exact = find_files(tree, "report.txt").collect()
    assert len(exact) == 2 and all(r.score is None and r.path.endswith("report.txt") for r in exact)
    close = find_files(tree, "sumary.md").orderBy("score", ascending=False).first()
    assert close.path.endswith("summary.md") and "\x1b[93ms\x1b[0m" in close.shown


def test_live_index(spark, tmp_path):
    live = LiveIndex(spark, str(tmp_path / "live"), "name", "id", seq="id")
    assert live.index() is None and live.results() is None
    live.ask(_queries(spark, "red lamp"))
    live.add(_rows(spark), 0)
    first = live.results().collect()
    live.add(spark.createDataFrame([(4, "Red lamps", "EU"), (1, "Red lamp", "AS")], "id int, name string, market string"), 1)
    batch = find(build(_rows(spark).union(spark.createDataFrame([(4, "Red lamps", "EU")])), "name", "id"), _queries(spark, "red lamp"))
    assert sorted(live.results().collect()) == sorted(batch.collect()) != sorted(first)
    live.add(spark.createDataFrame([(4, "Red lamps", "EU"), (1, "Red lamp", "AS")], "id int, name string, market string"), 1)
    assert live.index().docs.count() == 4 and sorted(live.results().collect()) == sorted(batch.collect())
    live.remove(_rows(spark).where("id = 1"))
    assert sorted(r.key for r in live.index().docs.collect()) == ["2", "3", "4"] and live.index().postings.join(live.index().docs, "uid", "left_anti").count() == 0
    before = live.results().collect()
    live.ask(_queries(spark, "blue chair"))  # no batch is needed
    assert live.results().where("rank = 1").first().doc_id == "Blue chair\x002" and before
    live.ask(None)
    assert live.results() is None


def test_live_index_forgets_tokens_of_removed_documents(spark, tmp_path):
    rows = [(1, "kotlin"), (2, "kotlim alpha"), (3, "other")]
    frame = lambda some: spark.createDataFrame(some, "id int, name string")
    config = SearchConfig(max_results=1)
    live = LiveIndex(spark, str(tmp_path / "live"), "name", "id", config)
    live.ask(_queries(spark, "kotlin"))
    for batch, row in enumerate(rows):
        live.add(frame([row]), batch)
    index = build(frame(rows), "name", "id", config)
    live.remove(frame(rows[:1]))
    rebuilt = find(build(frame(rows[1:]), "name", "id", config), _queries(spark, "kotlin")).collect()
    assert rebuilt[0].doc_id.startswith("kotlim") and live.results().collect() == rebuilt == find(index.removed(frame(rows[:1])), _queries(spark, "kotlin")).collect()
    saved = index.saved(str(tmp_path / "index")).removed(frame(rows[:1]))
    assert find(saved, _queries(spark, "kotlin")).collect() == rebuilt and saved.vectors.where("token = 'kotlin'").count() == 0
    path = str(tmp_path / "snapshot")
    export(index, path, single_file=True)
    lines = [r.value for r in spark.read.text(path).collect() if '"docId":"kotlin' not in r.value]
    (tmp_path / "without.json").write_text("\n".join(lines))
    assert [r.doc_id for r in find(restore(spark, str(tmp_path / "without.json")), _queries(spark, "kotlin")).collect()] == [r.doc_id for r in rebuilt]


def test_live_index_states(spark, tmp_path, monkeypatch):
    from tessera.streaming import live as module

    monkeypatch.setattr(module, "COMPACT", 3)
    frame = lambda k: spark.createDataFrame([(k, f"name {k}")], "id int, name string")
    live = LiveIndex(spark, str(tmp_path / "live"), "name", "id")
    for k in range(6):
        live.add(frame(k), k)
    live.add(frame(5), 5)
    assert sorted(r.key for r in live.index().docs.collect()) == list("012345")
    assert len(live._state()["parts"]) <= 4 and len(live._versions()) == module.KEPT
    assert live.index().vectors.groupBy("token").count().where("token = 'name'").count() == 1
    # a change that ends before its state is in place changes nothing
    monkeypatch.setattr(live, "_publish", lambda state: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        live.add(frame(9), 6)
    assert sorted(r.key for r in live.index().docs.collect()) == list("012345")


def test_streams(spark, tmp_path):
    _rows(spark).repartition(3).write.parquet(str(tmp_path / "rows"))
    stream = spark.readStream.schema("id int, name string, market string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "rows"))
    live = LiveIndex(spark, str(tmp_path / "live"), "name", "id")
    live.ask(_queries(spark, "blue char"))
    load = live.start(stream, str(tmp_path / "check"))
    load.awaitTermination()
    assert loaded(load, 6) == (3, 0.5)
    assert sorted(live.results().collect()) == sorted(find(build(_rows(spark), "name", "id"), _queries(spark, "blue char")).collect())
    _queries(spark, "lamp", "", "chair").write.parquet(str(tmp_path / "asked"))
    asked = spark.readStream.schema("query_id int, query string").parquet(str(tmp_path / "asked"))
    search_stream(live.index(), asked, str(tmp_path / "answers"), str(tmp_path / "check2")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "answers")).where("rank = 1").collect()
    assert {r.query_id: r.doc_id.split("\0")[0] for r in got} == {0: "Red lamp", 2: "Blue chair"}


def test_settings_round_trip():
    config = SearchConfig(max_results=3, separator="x", have_store=True, char_bag_weight=0.5)
    assert SearchConfig.of_record(config.record()) == config and SearchConfig.of_record({"unknown": 1}) == SearchConfig()


def test_report(spark, tmp_path):
    from tessera.__main__ import main, report

    (tmp_path / "notes.txt").write_text("x")
    tree = file_tree(spark, str(tmp_path))
    assert report(find_files(tree, "notes.txt").collect()).startswith("1 of this name:")
    assert "suggestions" in report(find_files(tree, "nots.txt").collect()) and report([]) == "No files." and main([]) == 2
