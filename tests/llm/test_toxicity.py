import random

import numpy as np
import pytest

from tessera.llm import toxicity as tox
from tessera.llm.words import words_of

BAD = ["scoundrel", "rotter", "blighter", "vermin"]


def _labelled(n, seed, identity=0.0):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "ba ke lo mi nu pra sto vi".split() for b in "nd rt sh lk mp ty ru ga".split()]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 60))]
        toxic = int(rng.random() < 0.3)
        if toxic and rng.random() >= identity / 2:
            words[rng.randrange(len(words))] = rng.choice(BAD) + rng.choice(["", "s", "ly"])
        if rng.random() < (identity if toxic else 0.02):
            words.insert(0, "muslims")
        rows.append((i, " ".join(words), toxic))
    return rows


def _score(model, texts):
    return model.score(words_of(texts, tox.PREFIXES))


def test_held_out_accuracy():
    rows, held = _labelled(600, 1), _labelled(400, 2)
    model = tox.train([r[1] for r in rows], [r[2] for r in rows])
    found = _score(model, [r[1] for r in held]) >= tox.THRESHOLD
    truth = np.array([r[2] for r in held], bool)
    assert (found == truth).mean() > 0.98


def test_length_does_not_hide_or_make_toxicity():
    rows = _labelled(600, 1)
    model = tox.train([r[1] for r in rows], [r[2] for r in rows])
    clean = " ".join(r[1] for r in _labelled(2000, 3) if not r[2])
    long, short = _score(model, [clean, clean + " rotter"])
    assert long < tox.THRESHOLD <= short


def test_swaps_bring_neutral_mentions_down():
    rows = _labelled(800, 4, identity=0.9)
    texts, labels = [r[1] for r in rows], [r[2] for r in rows]
    neutral = [f"muslims {t[1]}" for t in _labelled(300, 5) if not t[2]]
    swapped = [t.replace("muslims", "christians") for t in neutral]
    plain, fair = (tox.train(texts, labels, penalty=p) for p in (0.0, tox.PENALTY))
    gap = {name: np.abs(_score(m, neutral) - _score(m, swapped)).mean() for name, m in (("plain", plain), ("fair", fair))}
    assert gap["plain"] > 0.3 and gap["fair"] < 0.1 * gap["plain"]
    assert (_score(fair, neutral) >= tox.THRESHOLD).mean() < 0.02 < (_score(plain, neutral) >= tox.THRESHOLD).mean()
    held = _labelled(300, 6)
    assert ((_score(fair, [r[1] for r in held]) >= tox.THRESHOLD) == np.array([r[2] for r in held], bool)).mean() > 0.97


def test_scores_against_a_plain_sum():
    """Each text's words and their first bytes, looked up one after the other."""
    import math
    import re

    rows = _labelled(400, 11)
    model = tox.train([r[1] for r in rows], [r[2] for r in rows])
    weight = dict(zip(model.keys.tolist(), model.weights.tolist()))
    hashes = lambda w: [int(x) for x in (words_of([w], tox.PREFIXES).hash, *words_of([w], tox.PREFIXES).heads) for x in x if x]
    texts = [r[1] for r in _labelled(60, 12)] + ["", "Rotter rotter, rotters!", "muslims and women", "ROTTERLY x"]
    got = _score(model, texts)
    for text, score in zip(texts, got):
        found = {h for w in re.findall(r"[^\W_]+", text.lower()) for h in hashes(w)}
        assert score == pytest.approx(1 / (1 + math.exp(-(model.bias + sum(weight.get(h, 0.0) for h in found)))), abs=1e-9)


def test_training_reaches_the_least_loss():
    """The gradient of the loss, written down once more without matrices, is small at the weights found, and far from small at others."""
    import math

    texts, y = ["a rotter here", "a rotter muslims", "plain muslims here", "plain words", "other words here", "rotter words"] * 4, [1, 1, 0, 0, 0, 1] * 4
    model = tox.train(texts, y, steps=3000)
    keys = {int(k): n for n, k in enumerate(model.keys)}
    sets = [{keys[int(h)] for hs in (w.hash, *w.heads) for h in hs if int(h) in keys} for w in (words_of([t], tox.PREFIXES) for t in texts)]
    swaps = [(t, [{keys[f] for f in side if f in keys} for side in (own, other)], len(others)) for t in range(len(texts)) if "muslims" in texts[t] for own, others in tox._swaps(tox.IDENTITY)[int(words_of(["muslims"]).hash[0])] for other in others]

    def loss(w, b):
        total = sum(0.5 / y.count(v) * (math.log(1 + math.exp(-s)) if v else math.log(1 + math.exp(s))) for v, s in ((v, b + sum(w[k] for k in found)) for v, found in zip(y, sets)))
        pull = sum((sum(w[k] for k in a) - sum(w[k] for k in c)) ** 2 / n for _, (a, c), n in swaps) / sum(1 / n for _, _, n in swaps)
        return total + tox.RIDGE * sum(x * x for x in w) + tox.PENALTY * pull

    w, b = model.weights.tolist(), model.bias
    least = loss(w, b)
    slope = lambda k, h=1e-4: (loss([x + h * (n == k) for n, x in enumerate(w)], b + h * (k < 0)) - loss([x - h * (n == k) for n, x in enumerate(w)], b - h * (k < 0))) / (2 * h)
    assert least < 0.5 * loss([0.0] * len(w), 0.0) and max(abs(slope(k)) for k in range(-1, len(w))) < 5e-3


def test_texts_that_share_a_labelled_id_and_long_ones(spark):
    rows = [(r[0], r[1]) for r in _labelled(200, 13)]
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in _labelled(200, 13)], "doc_id long, quality int, toxic int")
    extra = [(0, "second text of an id"), (0, "second text of an id"), (1, "x" * 4000)]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string")
    seen = []
    import unittest.mock

    with unittest.mock.patch.object(tox, "train", lambda texts, toxic, **_: seen.append(texts.to_pylist()) or tox.Model()):
        tox.fit(docs, labels)
        tox.fit(docs, labels, sample_bytes=4000 * 31)
        tox.fit(docs, labels, sample=3)
    assert sorted(seen[0]) == sorted({t for _, t in rows + extra}) and sorted(seen[1]) == sorted({t for _, t in rows + extra} - {"x" * 4000})
    assert len(seen[2]) == 6


def test_edge_cases(spark):
    rows = _labelled(300, 7)
    texts = [(i, t, 1.0, 2) for i, t, _ in rows] + [(900, None, 0.0, 1), (901, "", 0.0, 1), (None, "such a rotter", 0.0, 1), (902, "such a rotter", 0.0, 1), (902, "such a rotter", 0.0, 1), (903, "plain words " * 60000 + "vermin", 0.0, 1)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, score double, toxic int")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (0, 1, None), (5555, 0, 1), (901, 0, 0)], "doc_id long, quality int, toxic int")
    found = [r.doc_id for r in tox.toxic_documents(docs, labels).collect()]
    assert found.count(902) == 2 and 903 in found and None in found and 900 not in found and 901 not in found
    assert {i for i, _, y in rows if y} == {i for i in found if i is not None and i < 900}
    kept = tox.without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == docs.count() - len(found)


@pytest.mark.parametrize("labels", [[], [(0, 1, 0), (1, 1, 0)], [(0, 1, 1)]])
def test_one_class_or_no_labels(spark, labels):
    docs = spark.createDataFrame([(0, "a b"), (1, "c d")], "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert tox.toxic_documents(docs, labels).count() == 0
    assert tox.without_toxic(docs, labels).count() == 2
    assert tox.toxic_documents(docs.where("doc_id < 0"), labels).count() == 0
