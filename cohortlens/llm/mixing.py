"""Mixing sources to target weights by pivotal dependent rounding.

Every source has a target number of words; the mix repeats a document ``target / size of its source`` times on average.
The whole part of that rate is certain, the fraction is a copy probability.  Probabilities are rounded in pairs: words
of probability move from one document to the other, up or down at random, until one of the two is 0 or 1.  The
expected copies of a document and the words of its source stay exact in every step.

Rounding is a reduction tree.  Documents of a source, ordered by size so that partners are alike, are cut into runs
of ``CHUNK``; a run is rounded in one task until ``KEEP`` documents are left open; the open ones of
``CHUNK / KEEP`` neighbouring runs meet in the next level, until a source has one run.  Documents far larger than the
others of their run go first, and in the last run all open ones go from the largest to the smallest, each paired with all
smaller ones together: what cannot be rounded exactly is at the end the size of a small document.  Only
open rows go on; settled ones are written once.

Random numbers are hashes of the seed, the level and the two documents, so reruns agree, however the data is partitioned.

Defined cases: a null text has no words, so whatever its copies none are taken; rows without a source form the last source; rows
that repeat id and text are interchangeable and each is rounded; a source without words has target 0; an empty
table gives an empty result; texts of any length are counted whole; other columns are not looked at.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.placing import place, with_groups
from cohortlens.runtime import materialise

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)  # repeating over the sources in order
MOST = 3  # times a source, and so a document, may be repeated
CHUNK = 1_024  # documents that one task rounds at once
KEEP = 32  # documents that a run leaves open for the next level
SPREAD = 4.0  # a document larger than so many medians of its run is settled before the pairs
SEED = 20_240_919
_CLOSE = 1e-9  # a probability this near to 0 or 1 is taken as it


def words(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(groups: DataFrame, most: int = MOST) -> DataFrame:
    """Add ``target`` and ``rate`` to sources with ``words`` and ``weight``.

    The words of all sources are shared by weight; a source stops at ``most`` times its own, and the excess is shared again
    among the others until none is above.  A round is one aggregate over the sources; sums are exact integers.
    """
    cap = F.col("words").cast("decimal(38,0)") * most
    sums = groups.agg(F.sum(F.col("words").cast("decimal(38,0)")), F.sum("weight")).first()
    total, all_weights = (int(v or 0) for v in sums)
    rest, weights, capped, known = total, all_weights, F.lit(False), 0
    while weights:
        # 38 digits hold the products: words of a source times summed weights
        above = cap * F.lit(Decimal(weights)) < F.col("weight") * F.lit(Decimal(rest))
        n, held, theirs = groups.where(above).agg(F.count(F.lit(1)), F.sum(cap), F.sum("weight")).first()
        if n == known:
            break
        capped, known, rest, weights = above, n, total - int(held), all_weights - int(theirs)
    share = F.col("weight").cast("double") * float(rest) / float(weights or 1)
    target = F.when(capped, F.col("words").cast("double") * most).otherwise(share)
    rate = F.when(F.col("words") > 0, F.least(target / F.col("words"), F.lit(float(most)))).otherwise(0.0)
    return groups.withColumns({"target": target, "rate": F.when(capped & (F.col("words") > 0), float(most)).otherwise(rate)})


def _draws(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """Uniform numbers in [0, 1) from two keys and a salt (splitmix64)."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ np.uint64(salt)) * np.uint64(0xD1B54A32D192ED03)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def _snap(p: np.ndarray, at: np.ndarray) -> None:
    v = p[at]
    p[at] = np.where(v < _CLOSE, 0.0, np.where(v > 1 - _CLOSE, 1.0, v))


def _open(p: np.ndarray) -> np.ndarray:
    return np.flatnonzero((p > 0) & (p < 1))


def pair_off(p: np.ndarray, size: np.ndarray, key: np.ndarray, salt: int, keep: int) -> None:
    """Round neighbours in pairs until at most ``keep`` probabilities are open; p times size keeps its sum."""
    turn = 0
    while len(left := _open(p)) > keep:
        pairs = min(len(left) // 2, len(left) - keep)
        i, j = left[0:2 * pairs:2], left[1:2 * pairs:2]
        up = np.minimum((1 - p[i]) * size[i], p[j] * size[j])  # words that can move from j to i
        down = np.minimum(p[i] * size[i], (1 - p[j]) * size[j])
        moved = np.where(_draws(key[i], key[j], salt + turn) * (up + down) < down, up, -down)
        p[i] += moved / size[i]
        p[j] -= moved / size[j]
        _snap(p, left)
        turn += 1


def settle(p: np.ndarray, size: np.ndarray, key: np.ndarray, salt: int, spread: float = 0.0, last: bool = True) -> None:
    """Round the open probabilities of documents that are larger than ``spread`` medians; rows come from the largest to the smallest.

    The largest open document is paired with all smaller ones, which move together, each by its own
    p (1 - p); a step closes the large one or one of the small ones.  With ``spread`` 0 all are rounded, and the last,
    a small one, is drawn on its own.  With a ``spread``, in a source's ``last`` run, a document so large that the
    others can offset it one way only goes that way, not at random: else its source would miss its target by
    most of it.
    """
    turn = 0
    while len(left := _open(p)) > 1 and size[left[0]] > spread * size[left[len(left) // 2]]:
        i, rest = left[:1], left[1:]
        way = p[rest] * (1 - p[rest])
        mass = float((way * size[rest]).sum())
        out, back = mass * (1 / (1 - p[rest])).min(), mass * (1 / p[rest]).min()  # words the small ones can give, take
        up, down = (1 - p[i[0]]) * size[i[0]], p[i[0]] * size[i[0]]
        if spread and not last and (up > out or down > back):
            break  # more partners may come in the next run
        if spread and (up > out) != (down > back):
            moved = up if up <= out else -down
        else:
            up, down = min(up, out), min(down, back)
            draw = _draws(key[i], key[rest[:1]], salt + turn)[0]
            moved = up if draw * (up + down) < down else -down
        p[i] += moved / size[i]
        p[rest] -= moved / mass * way
        _snap(p, left)
        turn += 1
    if not spread:
        for i in _open(p):
            p[i] = float(_draws(key[i:i + 1], key[i:i + 1], salt + turn)[0] < p[i])


def _level(rows: DataFrame, level: int, seed: int, keep: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("key", "ascending"), ("doc_id", "ascending")])
        p = table.column("p").to_numpy().copy()
        size = table.column("size").to_numpy().astype(np.float64)
        key = table.column("key").to_numpy().view(np.uint64)
        salt = (seed << 20) + (level << 14)
        last = table.column("runs")[0].as_py() == 1
        settle(p, size, key, salt, SPREAD, last)
        pair_off(p, size, key, salt + (1 << 12), keep)
        if last:
            settle(p, size, key, salt + (1 << 13))
        return table.set_column(table.schema.get_field_index("p"), "p", pa.array(p))

    return rows.groupBy("rank", "run").applyInArrow(run, rows.schema)


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED, chunk: int = CHUNK, keep: int = KEEP
) -> DataFrame:
    """Copies per document: doc_id, source, size, source_size, target (of the source), copies."""
    sized = docs.select("doc_id", "source", words("text").alias("size"), F.xxhash64("doc_id", "text").alias("key"))
    order = [F.col("size").desc(), "key", "doc_id"]
    placed = place(sized, "source", order, chunk, nulls_first=False, totals={"words": "size"})
    cycle = F.array(*[F.lit(w).cast("bigint") for w in weights])
    groups = placed.groups.withColumn("weight", F.get(cycle, (F.col("rank") % len(weights)).cast("int")))
    placed = placed._replace(groups=materialise(targets(groups, most), "targets"))
    longest = placed.groups.agg(F.max("n")).first()[0] or 0
    rows = with_groups(placed, "source").select(
        "doc_id", "source", "size", "key", "rank", F.col("words").alias("source_size"), "target",
        F.floor("rate").alias("whole"),
        F.when(F.col("size") > 0, F.col("rate") - F.floor("rate")).otherwise(0.0).alias("p"),
        F.floor((F.col("at") - F.col("start")) / chunk).alias("run"), F.ceil(F.col("n") / chunk).alias("runs"),
    )
    settled, runs, level = [], -(-longest // chunk), 0
    while True:
        done = materialise(_level(rows, level, seed, keep), "rounded")
        settled.append(done.where("p IN (0, 1)"))
        if runs <= 1:
            break
        fan = chunk // keep
        rows = done.where("p > 0 AND p < 1").withColumns(
            {"run": F.floor(F.col("run") / fan), "runs": F.ceil(F.col("runs") / fan)}
        )
        runs, level = -(-runs // fan), level + 1
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out.select(
        "doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.col("p").cast("bigint")).alias("copies")
    )


def words_taken(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
