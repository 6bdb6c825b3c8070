"""Toxic passages by maximum-scoring segments over token log-odds.

Every word gets a log-odds weight between toxic and clean labelled texts that hold it, under a Dirichlet
prior that follows the number of all documents that hold it, and shrunk towards zero by its standard error.  Leading
stems get weights too and stand in where a word has none or a weaker one.  Words and stems are counted as they are, in a
Spark table with one row each, however many there are; only weights other than zero, which words of the training
rows alone can have, are sent to the tasks.  A linear scan finds every maximal segment of a text.  Segment
scores become p-values by the extreme-value law of random texts with the clean word
frequencies, and a logistic curve over those turns a document's best evidence into a score.  The curve is fitted to
training rows scored by weights that leave the row itself out, so it does not take what the weights learnt by heart
for evidence.

Only the classifier is fitted on a bounded sample of labelled rows (``TRAIN_ROWS``, the curve ``CURVE_ROWS``) and has a bounded number of
weights (``WEIGHTS``, the strongest; the weakest ones give way beyond it); the counts, the extreme-value law's word
frequencies and all scores cover every document in full.

Defined cases: null and empty texts have no segment and get the score of no evidence; a label
without a document or a document without a label is no training row; several labels of one id: toxic if
any is; without toxic or without clean training rows all weights are zero and every score is the
share of toxic labels (0 without labels); repeated rows get equal scores; very long texts are scanned whole, words of
over 64 bytes are known by their digest; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import map_rows, split_words
from cohortlens.runtime import materialise

TRAIN_ROWS = 200_000  # labelled rows the classifier is fitted on, at most
CURVE_ROWS = 20_000  # of these, rows that the logistic curve is fitted on, at most
WEIGHTS = 1 << 20  # words and stems with a weight, at most
HELD_COUNTS = 400_000  # counts that a task holds before it hands them on
STEM = 5  # bytes of a stem
PRIOR = 2_000.0  # weight of the Dirichlet prior's background part, in words
SHRINK = 1.65  # standard errors taken off a weight
DRIFT = 0.5  # taken off every word, so that neutral text lowers a segment's sum
CAP = 6.0  # bound of a weight's size
GRID = 64  # steps per unit in the histogram of weights
LEAST_EVIDENCE = -20.0  # of texts without a segment
SIGNIFICANT = 0.01  # expected number of such segments in a clean text
HELD_OUT = 2  # rows whose crc32(doc_id) mod 4 is this are never learnt from
THRESHOLD = 0.3


WORD, STEMMED = 0, 1  # kinds of counted things
REST, CLEAN, TOXIC = 0, 1, 2  # classes of texts: unlabelled or not learnt from, clean, toxic


#: Word -> weight and stem -> weight, each weight also as it is without one clean and without one toxic text.
Weights = tuple[dict[bytes, tuple[float, float, float]], dict[bytes, tuple[float, float, float]]]
NONE = (0.0, 0.0, 0.0)


def _key(word: bytes) -> bytes:
    """A word as it is counted; a digest stands for words longer than any real one."""
    return word if len(word) <= 64 else b"\0" + hashlib.sha256(word).digest()


def _count(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Numbers of texts of each class that hold a word or stem, summed up within the task as far as memory allows."""
    counts = {(kind, group): Counter() for kind in (WORD, STEMMED) for group in (REST, CLEAN, TOXIC)}

    def held() -> Iterator[tuple]:
        for (kind, group), counter in counts.items():
            for word, n in counter.items():
                yield kind, group, word, n
            counter.clear()

    for text, label in rows:
        words = set(split_words(text))
        group = REST if label is None else TOXIC if label else CLEAN
        counts[WORD, group].update(map(_key, words))
        counts[STEMMED, group].update({w[:STEM] for w in words})
        if sum(map(len, counts.values())) > HELD_COUNTS:
            yield from held()
    yield from held()


class Strongest(dict):
    """Word -> the stronger of its own weight and its stem's; forgets when it grows.

    ``without`` is the class of a training row that the weights leave out, ``REST`` for none.
    """

    def __init__(self, weights: Weights, without: int = REST):
        self.words, self.stems = weights
        self.without = without

    def __missing__(self, word: bytes) -> float:
        if len(self) > 400_000:
            self.clear()
        own, stem = self.words.get(_key(word), NONE)[self.without], self.stems.get(word[:STEM], NONE)[self.without]
        self[word] = best = own if abs(own) >= abs(stem) else stem
        return best


@dataclass(frozen=True)
class Model:
    """Weights of words and of stems, and the extreme-value law of clean text."""

    weights: Weights
    decay: float  # lambda
    scale: float  # K


def word_scores(words: list[bytes], strongest: Strongest) -> np.ndarray:
    """Weight of every word less the drift.  A word that a text repeats is weaker evidence each time: its k-th place counts one k-th."""
    best = np.fromiter((strongest[w] for w in words), np.float64, len(words))
    seen: Counter = Counter()
    for at in np.flatnonzero(best > 0).tolist():
        seen[words[at]] += 1
        best[at] /= seen[words[at]]
    return best - DRIFT


def log_odds(toxic: Column, clean: Column, everywhere: Column, n_toxic: float, n_clean: float, n_all: float) -> Column:
    """Shrunk log-odds ratio under a Dirichlet prior proportional to the counts in all texts.

    The prior is split by the share of the toxic counts ``n_toxic / (n_toxic + n_clean)``, so it alone gives a ratio of
    zero, and both classes' totals stand in the ratio of that share: the size of the vocabulary does not enter.
    """
    if not n_toxic or not n_clean:
        return F.lit(0.0)
    share = n_toxic / (n_toxic + n_clean)
    prior = 1 + PRIOR * everywhere / n_all
    t, c = toxic + share * prior, clean + (1 - share) * prior
    ratio = F.log(t / c) - math.log(share / (1 - share))
    sure = F.greatest(F.lit(0.0), F.abs(ratio) - SHRINK * F.sqrt(1 / t + 1 / c))
    return F.signum(ratio) * F.least(F.lit(CAP), sure)


def extreme_value_law(values: np.ndarray, share: np.ndarray) -> tuple[float, float]:
    """Decay and scale for random texts whose words score ``values`` with frequencies ``share``.

    The decay solves sum(share * exp(decay * value)) = 1; the scale is the usual bound for
    segments that end at a rare positive word.
    """
    if not (values > 0).any() or (values * share).sum() >= 0:
        return 1.0, 1.0
    low, high = 1e-6, 1.0
    grow = lambda x: float((share * np.exp(np.minimum(x * values, 700))).sum())
    while grow(high) < 1:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if grow(mid) < 1 else (low, mid)
    positive = values > 0
    return low, float(max((share[positive] * np.exp(low * values[positive])).sum(), 1e-12))


def count_words(labelled: DataFrame) -> DataFrame:
    """One row per word and per stem: ``kind``, ``word``, ``n_all``, ``n_toxic``, ``n_clean`` documents that hold it."""
    rows = map_rows(labelled.select("text", "label"), _count, "kind int, class int, word binary, n bigint",
                    [pa.int32(), pa.int32(), pa.binary(), pa.int64()])
    of = lambda group: F.sum(F.when(F.col("class") == group, F.col("n")).otherwise(0))
    return rows.groupBy("kind", "word").agg(F.sum("n").alias("n_all"), of(TOXIC).alias("n_toxic"), of(CLEAN).alias("n_clean"))


def fit_model(labelled: DataFrame, most: int = WEIGHTS) -> Model:
    """``labelled``: all documents as (text, label), with a label on training rows only.

    The driver sees three sums per kind, a histogram of weights in steps of 1 / GRID and at most ``most`` weights.
    """
    counts = materialise(count_words(labelled), "words")
    sums = {r["kind"]: (r["t"], r["c"], r["a"]) for r in counts.groupBy("kind").agg(
        F.sum("n_toxic").alias("t"), F.sum("n_clean").alias("c"), F.sum("n_all").alias("a")).collect()}
    if not sums:
        return Model(({}, {}), 1.0, 1.0)

    def weight(without: int) -> Column:
        toxic, clean = (F.greatest(F.col(c) - int(without == group), F.lit(0)) for c, group in (("n_toxic", TOXIC), ("n_clean", CLEAN)))
        word, stem = (log_odds(toxic, clean, F.col("n_all"), *sums[kind]) for kind in (WORD, STEMMED))
        return F.when(F.col("kind") == WORD, word).otherwise(stem)

    weighted = counts.withColumn("step", F.round(weight(REST) * GRID).cast("int"))
    table = weighted.groupBy("kind", "step").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("n_all") - F.col("n_toxic")).alias("clean")).toArrow()
    kind, step, n, clean = (np.asarray(table[c], np.int64) for c in ("kind", "step", "n", "clean"))
    # The smallest size of a weight, at least one step, from which on no more than ``most`` weights are left.
    least = next(cut for cut in range(1, int(CAP * GRID) + 2) if n[np.abs(step) >= cut].sum() <= most)
    word = kind == WORD
    values = np.where(np.abs(step) >= least, step, 0)[word] / GRID - DRIFT
    decay, scale = extreme_value_law(values, clean[word] / max(clean[word].sum(), 1))
    strong = weighted.where(F.abs("step") >= least).select("kind", "word", *[weight(g).alias(f"w{g}") for g in (REST, CLEAN, TOXIC)]).toArrow()
    weights: Weights = ({}, {})
    for kind_, word_, *three in zip(*(c.to_pylist() for c in strong.columns), strict=True):
        weights[kind_][word_] = tuple(three)
    return Model(weights, decay, scale)


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(start, end, sum)`` in linear time, sums positive.

    Only positive words open or extend a segment, so the scan visits those alone and reads the sums
    between them from one running total.
    """
    sums = np.concatenate(([0.0], np.cumsum(scores, dtype=np.float64)))
    out: list[list] = []  # start, end, total before, total after, previous segment with a lower total before
    for at in np.flatnonzero(scores > 0).tolist():
        start, end, left, right = at, at + 1, sums[at], sums[at + 1]
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= left:
                j = out[j][4]
            if j < 0 or out[j][3] >= right:
                out.append([start, end, left, right, j])
                break
            start, left = out[j][0], out[j][2]
            del out[j:]
    return [(a, b, float(r - l)) for a, b, l, r, _ in out]


def _scan(model: Model):
    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        strongest = [Strongest(model.weights, without) for without in (REST, CLEAN, TOXIC)]

        def found(words: list[bytes], without: int) -> list[tuple[int, int, float]]:
            """Segments with their evidence: less the log of the number expected in a clean text of this length."""
            if not words:
                return []
            log_kn = math.log(max(model.scale * len(words), 1e-9))
            return [(a, b, model.decay * s - log_kn) for a, b, s in maximal_segments(word_scores(words, strongest[without]))]

        def top(segments: list[tuple[int, int, float]]) -> float:
            return max((e for *_, e in segments), default=LEAST_EVIDENCE)

        for doc_id, curve_label, text, key in rows:
            words = split_words(text)
            segments = found(words, REST)
            unseen = None if curve_label is None else top(found(words, TOXIC if curve_label else CLEAN))
            strong = [{"start": a, "end": b, "evidence": e} for a, b, e in segments if e >= -math.log(SIGNIFICANT)]
            yield doc_id, curve_label, key, len(words), max(top(segments), LEAST_EVIDENCE), unseen, strong

    return run


def _curve(pairs: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Logistic intercept and slope on evidence, from counts ``(evidence, rows, toxic rows)``."""
    x, n, y = (np.array(v, float) for v in zip(*pairs, strict=True))
    a, b = math.log((y.sum() + 0.5) / (n.sum() - y.sum() + 0.5)), 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = n * p * (1 - p)
        g = np.array([(y - n * p).sum(), ((y - n * p) * x).sum() - 0.01 * b])
        h = np.array([[w.sum() + 1e-6, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 0.01]])
        step = np.linalg.solve(h, g)
        size = np.abs(step).max()
        a, b = np.array([a, b]) + step / max(1.0, size)
        if size < 1e-9:
            break
    return float(a), float(max(b, 0.0))


def training_labels(labels: DataFrame, held_out: bool = True, rows: int = TRAIN_ROWS) -> DataFrame:
    """``(__id, label)`` of at most ``rows`` labelled ids, those with the smallest hashes."""
    one = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("__id")).agg(
        F.max("toxic").cast("int").alias("label")
    )
    if held_out:
        one = one.where(F.pmod(F.crc32(F.col("__id").cast("string").cast("binary")), F.lit(4)) != HELD_OUT)
    return one.orderBy(F.xxhash64("__id"), "__id").limit(rows)


def score_documents(docs: DataFrame, labels: DataFrame, held_out: bool = True, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per document: ``doc_id``, ``score``, ``evidence``, ``n_words``, ``passages``, ``text_key``.

    ``passages`` are the significant segments in words from 0 with their evidence.
    """
    train = materialise(training_labels(labels, held_out, train_rows), "train")
    order = F.xxhash64("__id")
    last = train.orderBy(order).limit(CURVE_ROWS).agg(F.max(order)).first()[0]
    train = train.withColumn("curve_label", F.when(order <= last, F.col("label")) if last is not None else F.lit(None).cast("int"))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # At most train_rows rows of three numbers: a bounded broadcast.
    both = source.join(F.broadcast(train), source["doc_id"] == train["__id"], "left")
    model = fit_model(both)
    evidence = ("doc_id bigint, curve_label int, text_key bigint, n_words bigint, evidence double, unseen double, "
                "passages array<struct<start:bigint,end:bigint,evidence:double>>")
    passage = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("evidence", pa.float64())]))
    scanned = materialise(
        map_rows(
            both.select("doc_id", "curve_label", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")),
            _scan(model), evidence, [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), passage],
        ),
        "evidence",
    )
    step = F.round(F.greatest(F.least(F.col("unseen"), F.lit(80.0)), F.lit(LEAST_EVIDENCE)) * 4) / 4
    found = scanned.where("curve_label IS NOT NULL").groupBy(step.alias("e")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("curve_label").alias("y")).collect()
    a, b = _curve([(r["e"], r["n"], r["y"]) for r in found]) if found else (-math.inf, 0.0)
    p = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("evidence")))) if found else F.lit(0.0)
    return scanned.select("doc_id", p.alias("score"), "evidence", "n_words", "passages", "text_key")


def keep_below(docs: DataFrame, labels: DataFrame, limit: float = THRESHOLD) -> DataFrame:
    """Documents with a score below ``limit``, with all their columns; rows without an id are judged by text."""
    bad = score_documents(docs, labels).where(F.col("score") >= limit).select("doc_id", "text_key").distinct()
    bad = bad.withColumnsRenamed({"doc_id": "__id", "text_key": "__key"})
    key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["__id"]) & (key == bad["__key"]), "left_anti")
