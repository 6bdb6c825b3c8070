"""Benchmark decontamination by spaced-seed hashing, with built-in functions only.

A seed is the hash of the words at the fixed places of a mask; the other places may hold any word.
All benchmark windows are hashed.  A document's window is hashed only where its first two words
occur as a pair at the start of a benchmark window, which loses nothing because every mask reads
both.  Seeds meet the benchmark's in an equi-join, and the words around each hit are compared one by
one: a run of ``RUN`` aligned words (the whole item if it is shorter) with at least ``SHARE``
equal ones counts as an overlap.

The masks hit every run of ``RUN`` words with any two of them changed.  Items shorter than a run are cut into
one piece more than words may differ, so that one piece is always whole, and their pieces are looked up.

Defined cases: null or empty texts have no windows; items of fewer than five words are not
searched; items of five to twelve words are compared whole; null ids share one name in
``overlaps`` (``drop_contaminated`` goes by id and text); repeated rows give one row; an empty documents or
benchmark table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import word_arrays
from cohortlens.runtime import materialise

#: Places of the words that a mask reads.
MASKS = ((0, 1, 3, 5, 6, 7), (0, 1, 2, 5, 6, 8))
PIECES = ((0, 1), (0, 1, 2), (0, 1, 2, 3), (0, 1, 2, 3, 4))  # of items shorter than a run only
LEAST = 5  # words of the shortest item searched
SPAN = 1 + max(max(m) for m in MASKS)
RUN, SHARE = 13, 0.8
AROUND = RUN  # words compared on either side of a hit
STRETCH = SPAN + 2 * AROUND
BROADCAST_SEEDS = 2_000_000  # more seeds than this (three numbers each) are joined by a shuffle


def _seed(words: Column, at: Column, mask: int) -> Column:
    places = [*MASKS, *PIECES][mask]
    return F.xxhash64(F.lit(mask), *[F.get(words, at + p) for p in places])


def pieces(n: int) -> list[tuple[int, int]]:
    """``(first word, words)`` of the pieces of an item of ``n`` words: more pieces than words may differ."""
    count = n - math.ceil(n * SHARE - 1e-9) + 1
    ends = [n * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


def _short_windows(n: Column) -> Column:
    """Places and masks of the pieces of an item shorter than a run."""
    out = F.lit(None)
    for size in range(LEAST, RUN):
        here = [F.struct(F.lit(a).alias("at"), F.lit(len(MASKS) + k - len(PIECES[0])).alias("mask")) for a, k in pieces(size)]
        out = F.when(n == size, F.array(*here)).otherwise(out)
    return out


def _around(words: Column, at: Column) -> Column:
    """The words around a hit; places outside the text are null."""
    return F.array(*[F.get(words, at - AROUND + j) for j in range(STRETCH)])


def _equal_places(left: str, right: str) -> Column:
    """One bit per place at which both stretches hold the same word."""
    bits = [F.when(F.get(left, F.lit(j)) == F.get(right, F.lit(j)), F.lit(1 << j)).otherwise(F.lit(0)) for j in range(STRETCH)]
    out = bits[0].cast("long")
    for bit in bits[1:]:
        out = out.bitwiseOR(bit.cast("long"))
    return out


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per contaminated (``doc_id``, ``item_id``): first word, words compared and words equal."""
    return _overlaps(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, ["doc_id"])


def _overlaps(docs: DataFrame, benchmark: DataFrame, by: list[str]) -> DataFrame:
    """The same for documents named by the columns ``by``."""
    items = materialise(
        benchmark.select(F.col("item_id"), word_arrays(F.col("text")).alias("words")).withColumn("n", F.size("words")).where(F.col("n") >= LEAST),
        "items",
    )
    words, at, n = F.col("words"), F.col("at"), F.col("n")
    starts = items.where(n >= RUN).select("item_id", "n", "words", F.explode(F.sequence(F.lit(0), n - 1 - min(max(m) for m in MASKS))).alias("at"))
    fits = F.array(*[F.when(at + max(m) < n, F.lit(i)) for i, m in enumerate(MASKS)])
    long = starts.select("item_id", "words", "at", F.explode(fits).alias("mask")).where("mask IS NOT NULL")
    short = items.where(n < RUN).select("item_id", "words", F.explode(_short_windows(n)).alias("piece"))
    windows = long.unionByName(short.select("item_id", "words", "piece.at", "piece.mask"))
    every = range(len(MASKS) + len(PIECES))
    seeds = materialise(
        windows.select(
            "item_id", "at", "mask", F.xxhash64(F.get(words, at), F.get(words, at + 1)).alias("pair"),
            F.coalesce(*[F.when(F.col("mask") == m, _seed(words, at, m)) for m in every]).alias("seed"),
        ), "seeds",
    )
    used = sorted(r["mask"] for r in seeds.select("mask").distinct().collect()) or [0]
    pairs, right = seeds.select("pair").distinct(), seeds.select("item_id", F.col("at").alias("item_at"), "seed")
    if seeds.count() <= BROADCAST_SEEDS:
        pairs, right = F.broadcast(pairs), F.broadcast(right)

    # One row per pair of neighbouring words; the array of words stays a reference inside the stage's
    # generated code.  The outer form implies no filter: one on a computed array, pushed below the
    # projection, would repeat the split.
    texts = docs.select(*by, word_arrays(F.col("text")).alias("words"))
    following = F.slice("words", 2, 2**31 - 1).alias("following")
    placed = texts.select(*by, "words", F.posexplode_outer(F.arrays_zip("words", following)).alias("at", "two"))
    gated = placed.where("two.following IS NOT NULL").withColumn("pair", F.xxhash64("two.words", "two.following")).join(
        pairs, "pair", "left_semi"
    )
    hashed = gated.select(*by, "at", "words", F.explode(F.array(*[_seed(words, at, m) for m in used])).alias("seed"))
    hits = hashed.join(right, "seed").select(*by, "at", "item_id", "item_at", _around(words, at).alias("doc_words"))
    whole = items.select("item_id", "n", F.col("words").alias("item"))
    found = hits.join(whole, "item_id").withColumn("item_words", _around(F.col("item"), F.col("item_at")))
    compared = found.select(*by, "item_id", "at", "item_at", "n", _equal_places("doc_words", "item_words").alias("equal"))
    # Runs lie inside the item, which fills the places from AROUND - item_at on.  The best run is the one
    # with most equal words, the first of those; both are read from one number.
    run = F.least(F.lit(RUN), F.col("n"))
    first = AROUND - F.col("item_at")
    scored = [
        F.when(
            (first <= s) & (first + F.col("n") >= run + s),
            64 * F.bit_count(F.shiftright("equal", s).bitwiseAND(F.expr("shiftleft(1L, least({}, n)) - 1".format(RUN)))) + (63 - s),
        )
        for s in range(STRETCH)
    ]
    best = compared.select(*by, "item_id", "at", run.alias("run"), F.greatest(*scored).alias("code"))
    same = F.floor(F.col("code") / 64)
    enough = same >= SHARE * F.col("run")
    return best.groupBy(*by, "item_id").agg(
        F.min(F.when(enough, F.col("at") - AROUND + 63 - F.col("code") % 64)).alias("first_word"),
        F.max("run").alias("n_compared"), F.max(same).alias("n_equal"),
    ).where("first_word IS NOT NULL")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any overlap, with all their columns; each row is judged by its own text."""
    key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    named = docs.select(docs["doc_id"].cast("long").alias("__id"), key.alias("__key"), "text")
    bad = _overlaps(named, benchmark, ["__id", "__key"]).select("__id", "__key").distinct()
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["__id"]) & (key == bad["__key"]), "left_anti")
