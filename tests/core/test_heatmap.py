import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.config import SearchConfig
from tessera.functions.matching import cosine, text_tiers, vector, word_tiers
from tessera.operators.heatmap import heatmap, highlighted, word_heatmap
from tessera.operators.index import build


@pytest.mark.parametrize(
    "query, target, want",
    [
        ("blugaria", "Bulgaria", [0, 2, 2, 0, 0, 0, 0, 0]),
        ("Bulgaria", "bulgira ", [0, 0, 0, 0, 2, 0, 2, -1]),
        ("Sfoia", "Sofia", [0, 2, 2, 0, 0]),
        ("gariabul", "Bulgaria", [1, 1, 1, 2, 0, 1, 1, 2]),
        ("", "abc", [-1, -1, -1]),
        ("abc", "", []),
    ],
)
def test_word_tiers(query, target, want):
    assert word_tiers(query, target) == want


def test_case_counts_only_if_asked():
    assert word_tiers("ABC", "abc", ignore_case=False) == [-1, -1, -1]


def test_texts():
    config = SearchConfig()
    tiers = text_tiers("sfoia blugaria", "Sofia Bulgaria", config)
    assert len(tiers) == 14 and tiers[5] == -1 and tiers[:5] == [0, 2, 2, 0, 0] and tiers[6] == 0
    assert text_tiers("kotlin coroutines", "Kotlin Multiplatform", config)[:6] == [0] * 6
    african = text_tiers("african", "Central African Republic", config)
    assert african[:8] == [-1] * 8 and african[8:15] == [0] * 7
    assert text_tiers(" ", "Sofia", config) is None
    assert text_tiers("one two", "---", config) == [-1] * 3


def test_assignment_is_one_to_one():
    tiers = text_tiers("sofai sofiq", "Sofia Sofib", SearchConfig())
    assert all(t >= 0 for t in tiers[:4] + tiers[6:10])


def test_columns(spark):
    index = build(spark.createDataFrame([("Sofia Bulgaria", "1"), ("Kotlin", "2")], "text string, key string"), "text", "key")
    ids = {r.key: r.doc_id for r in index.docs.collect()}
    pairs = spark.createDataFrame([("sfoia blugaria", ids["1"]), ("  ", ids["2"]), (None, ids["2"]), ("x", "not\0there")], "query string, doc_id string")
    got = {(r.query, r.doc_id): r.chars for r in heatmap(index, pairs).collect()}
    assert len(got) == 3 and got["  ", ids["2"]] is None and got[None, ids["2"]] is None
    chars = got["sfoia blugaria", ids["1"]]
    assert "".join(c.ch for c in chars) == "Sofia Bulgaria" and chars[5].tier == -1
    shown = spark.createDataFrame([("ab", "axb")], "q string, t string").select(highlighted(word_heatmap(F.col("q"), F.col("t"))).alias("s")).first().s
    assert shown == "\x1b[93ma\x1b[0m\x1b[90mx\x1b[0m\x1b[36mb\x1b[0m"


def _plain_word(query, target):
    """The tiers of a word once more; taken characters turn to None."""
    q, t = list(query.lower()), list(target.lower())
    out = [-1] * len(t)
    for k in range(min(len(q), len(t))):
        if q[k] == t[k]:
            q[k] = t[k] = None
            out[k] = 0
    for i in range(len(q)):
        runs = [next((n for n in range(len(q)) if i + n >= len(q) or j + n >= len(t) or q[i + n] is None or q[i + n] != t[j + n]), len(q)) for j in range(len(t))]
        if runs and max(runs) >= 2:
            j, n = runs.index(max(runs)), max(runs)
            q[i : i + n], t[j : j + n], out[j : j + n] = [None] * n, [None] * n, [1] * n
    for i, c in enumerate(q):
        if c is not None and c in t:
            j = t.index(c)
            q[i], t[j], out[j] = None, None, 2
    return out


def _plain_text(query, text, config):
    """The tiers of a text once more: every assignment of the words that aren't equal is tried."""
    words = [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text)]
    wanted, there = list(dict.fromkeys(w.lower() for w in re.findall(r"[^\W_]+", query))), list(dict.fromkeys(w for w, _, _ in words))
    if len(wanted) == len(there) == 1:
        return _plain_word(query, text)
    equal = [w for w in wanted if w in there]
    rest = [w for w in wanted if w not in there]
    options = []
    for w in rest:
        near = [(cosine(vector(w, config), vector(t, config)), t) for t in there if t not in equal] if w in wanted[:5] else []
        near = sorted([x for x in near if x[0] > 0], key=lambda x: (-round(x[0], 9), there.index(x[1])))[: config.window_slack]
        options.append([*near, None])
    best, chosen = (-1, -1.0), ()
    for choice in itertools.product(*options):
        taken = [c for c in choice if c]
        if len({t for _, t in taken}) < len(taken):
            continue
        places = sorted(there.index(t) for t in [*equal, *(t for _, t in taken)])
        near = sum(1 / 2 ** (max(b - a - 1, 0) + 1) for a, b in zip(places, places[1:])) / ((len(places) - 1) / 2) if len(places) > 1 else 1.0
        value = (len(taken) / sum(1 / max(c, 1e-6) for c, _ in taken) if taken else 0.0) * (1 - config.adjacency_bonus * (1 - near))
        if (len(taken), value) > best:
            best, chosen = (len(taken), value), choice
    out = [-1] * len(text)
    for w, target in [(w, w) for w in equal] + [(w, c[1]) for w, c in zip(rest, chosen) if c]:
        begin, end = next((a, b) for t, a, b in words if t == target)
        out[begin:end] = _plain_word(w, text[begin:end])
    return out


def test_words_against_a_plain_version():
    rng = random.Random(5)
    for _ in range(3000):
        q, t = ("".join(rng.choice("abcA ") for _ in range(rng.randint(0, 9))) for _ in range(2))
        assert word_tiers(q, t) == _plain_word(q, t), (q, t)


def test_texts_against_a_plain_version():
    rng = random.Random(6)
    words = "red rde green gren blue bleu widget widgit small smal lamp lapm a b".split()
    config = SearchConfig()
    for _ in range(600):
        query, text = (" ".join(rng.choice(words) for _ in range(rng.randint(1, n))) for n in (5, 6))
        assert text_tiers(query, text, config) == _plain_text(query, text, config), (query, text)
