"""Word weights of the toxicity operator: exact counts of any vocabulary, against plain numpy."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from cohortlens.llm import toxicity
from cohortlens.llm.common import split_words

DOCS = "text string, label int"


def expected_weights(rows, cut):
    """Shrunk log-odds from the definition, over all words (or stems) of all rows."""
    every, toxic, clean = Counter(), Counter(), Counter()
    for text, label in rows:
        here = {w[:cut] for w in split_words(text)}
        every.update(here)
        if label is not None:
            (toxic if label else clean).update(here)
    words = sorted(every)
    n, t, c = (np.array([counter[w] for w in words], float) for counter in (every, toxic, clean))
    share = t.sum() / (t.sum() + c.sum())
    prior = 1 + toxicity.PRIOR * n / n.sum()
    t, c = t + share * prior, c + (1 - share) * prior
    ratio = np.log(t / t.sum()) - np.log(c / c.sum())
    size = np.maximum(0, np.abs(ratio) - toxicity.SHRINK * np.sqrt(1 / t + 1 / c))
    return dict(zip(words, np.sign(ratio) * np.minimum(size, toxicity.CAP), strict=True))


@pytest.fixture(scope="module")
def rows():
    """Some labelled texts, odd ones, and words over 64 bytes."""
    rng = random.Random(3)
    out = [(None, 1), ("", 0), (None, None), ("!!! ???", 1), ("слово " * 4, 0), ("x" * 300 + " end", 1), ("x" * 300 + " end", 1)]
    for i in range(400):
        words = [f"w{rng.randrange(120)}" for _ in range(rng.randrange(1, 30))]
        if i % 9 == 0:
            words += ["vile", "vilest", f"rot{rng.randrange(3)}"]
        out.append((" ".join(words), None if i % 4 == 2 else int(i % 9 == 0)))
    return out


def test_weights_equal_the_definition(spark, rows):
    for parts in (1, 7):
        model = toxicity.fit_model(spark.createDataFrame(rows, DOCS).repartition(parts))
        for kind, cut in ((toxicity.WORD, None), (toxicity.STEMMED, toxicity.STEM)):
            want = {toxicity._key(w): x for w, x in expected_weights(rows, cut).items() if round(abs(x) * toxicity.GRID) >= 1}
            got = model.weights[kind]
            assert got.keys() == want.keys() and len(want) > 3
            assert all(math.isclose(got[w][0], want[w], rel_tol=1e-9) for w in want)
            assert all(clean >= whole >= toxic for whole, clean, toxic in got.values())


def test_counts_handed_on_early_are_the_same(spark, rows, monkeypatch):
    want = Counter(toxicity._count(iter(rows)))
    total = Counter()
    monkeypatch.setattr(toxicity, "HELD_COUNTS", 10)
    for kind, group, word, n in toxicity._count(iter(rows)):
        total[kind, group, word] += n
    assert total == Counter({(kind, group, word): n for kind, group, word, n in want})


def test_the_strongest_weights_stay_where_not_all_fit(spark, rows):
    table = spark.createDataFrame(rows, DOCS)
    every = toxicity.fit_model(table).weights
    few = toxicity.fit_model(table, most=6).weights
    kept = {(k, w): abs(x[0]) for k in (0, 1) for w, x in few[k].items()}
    left = {(k, w): abs(x[0]) for k in (0, 1) for w, x in every[k].items()}
    assert 0 < len(kept) <= 6 and kept.items() <= left.items()
    assert min(kept.values()) >= max(x for at, x in left.items() if at not in kept)
    assert toxicity.fit_model(table, most=0).weights == ({}, {})


def test_a_rare_toxic_word_among_more_words_than_a_fixed_table_holds(spark):
    """400,000 words, each in one text; one word stands in 12 toxic texts and no other, at unlike places."""
    clean = [(i, " ".join(f"q{(i * 100 + j) * 7919:x}" for j in range(100)), "x") for i in range(4_000)]
    rng = random.Random(8)
    bad = []
    for i in range(4_000, 4_024):
        words = [f"q{rng.randrange(400_000) * 7919:x}" for _ in range(100)]
        words[rng.randrange(100)] = "zugglewort"
        bad.append((i, " ".join(words), "x"))
    docs = spark.createDataFrame(clean + bad, "doc_id bigint, text string, score string").repartition(4)
    # Every second toxic text and most clean ones have no label: they are judged by what the others teach.
    labels = spark.createDataFrame([(i, int(i >= 4_000)) for i, *_ in clean[::20] + bad[::2]], "doc_id bigint, toxic int")
    scored = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, labels, held_out=False).collect()}
    assert len(scored) == 4_024
    assert all(scored[i] >= toxicity.THRESHOLD for i, *_ in bad)
    assert sum(scored[i] >= toxicity.THRESHOLD for i, *_ in clean) == 0
    assert sum(1 for _ in toxicity.count_words(docs.selectExpr("text", "CAST(NULL AS int) AS label")).where("kind = 0").toLocalIterator()) > 1 << 18


def test_repeated_words_count_less_each_time():
    weights = ({b"bad": (2.0, 2.5, 0.0), b"fine": (-1.0, 0.0, -2.0), b"stemword": (0.5, 0.5, 0.5)}, {b"stemw": (3.0, 3.0, 0.1)})
    strongest = toxicity.Strongest(weights)
    got = toxicity.word_scores([b"bad", b"fine", b"bad", b"stemword", b"other", b"bad"], strongest)
    assert np.allclose(got + toxicity.DRIFT, [2, -1, 1, 3, 0, 2 / 3])
    without = toxicity.word_scores([b"bad", b"fine", b"stemword"], toxicity.Strongest(weights, toxicity.TOXIC))
    assert np.allclose(without + toxicity.DRIFT, [0, -2, 0.5])
