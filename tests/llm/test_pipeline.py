"""The pipeline over a small corpus with planted cases, against what plain Python expects of each stage."""

import random

import pytest

import corpus_pipeline
from tessera.llm.encoding import token_ids

AKIA = "AKIA" + "Q7ZB3KXW5MPL2RTD"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    vocabulary = [a + b + c for a in "ka lo mi nu pra sto vi ber".split() for b in "nd rt sh lk mp".split() for c in ("a", "e", "on", "is")]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    docs, labels, kind = [], [], {}

    def add(text, what):
        kind[len(docs)] = what
        docs.append((len(docs), text, "en", "s", len(text)))

    items = [prose(25) for _ in range(8)]
    for k in range(240):
        add(prose(rng.randint(20, 120)), "clean")
    for k in range(60):
        words = prose(60).split()
        words[rng.randrange(60)] = rng.choice(["vermin", "rotter"])
        add(" ".join(words), "toxic")
    for d, *_ in docs:
        labels.append((d, 1, int(kind[d] == "toxic")))
    for k in range(12):
        words = prose(80).split()
        words[5] = "vermin"
        add(" ".join(words), "toxic")
    for k in range(10):
        base = prose(100).split()
        for n in range(rng.randint(2, 4)):
            copy = list(base)
            for at in rng.sample(range(100), 3 * (n > 0)):
                copy[at] = "changed"
            add(" ".join(copy), "first" if n == 0 else "copy")
    for item in items:
        words = item.split()
        add(f"{prose(30)} {' '.join(words[12:])} {prose(5)} {' '.join(words[:12])} {prose(20)}", "leak")
    for k in range(6):
        add(f"{prose(20)} {AKIA[:-1]}{'ABCDEF'[k]} {prose(20)}", "secret")
    add("", "empty")
    path = tmp_path_factory.mktemp("corpus")
    rows = docs + [(None, "a document without an id", "en", "s", 24), (9000, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, kind


def test_each_stage_takes_effect(spark, folder):
    path, rows, kind = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    gone = {"toxicity": {"toxic"}, "near_duplicates": {"copy"}, "decontamination": {"leak"}, "secret_scan": set()}
    want = {r[0]: r[1] for r in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, path), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        want = {d: t for d, t in want.items() if kind.get(d) not in gone[name]}
        if name == "secret_scan":
            want = {d: f"{t[: t.index('AKIA')]}<SECRET>{t[t.index('AKIA') + 20 :]}" if kind.get(d) == "secret" else t for d, t in want.items()}
        got = docs.collect()
        assert {r.doc_id: r.text for r in got} == want and len(got) == len(want), name
        assert all(r.n_chars == len(r.text) for r in got if r.text is not None)
    pieces = {}
    for r in corpus_pipeline.run(spark, path).orderBy("doc_id", "piece").collect():
        pieces.setdefault(r.doc_id, []).extend(r.tokens)
    assert pieces == {d: token_ids(t).tolist() for d, t in want.items() if t}


def test_empty_table(spark, folder, tmp_path):
    path = folder[0]
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
