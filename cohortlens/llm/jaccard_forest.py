"""N-gram Jaccard self-join by banded MinHash LSH with exact verification.

Every document becomes its set of hashed five-word shingles.  Documents with equal sets form one
class, so copies are never compared.  A class gets one key per tree: the hash of a prefix of the tree's MinHash
values; classes that share a key are the candidates of that node.  The prefix has one fixed length, the longest at
which a pair at the threshold still meets in some tree with the target probability (plain banding): pairs that
share a longer prefix share this one too.

Nodes are compared in blocks: a node of more than ``BLOCK`` classes is cut, and each pair of blocks
is one task group, so no task holds more than two blocks and no pair leaves a task.  A group computes
all its intersections exactly and returns, per class, its number of links and the root of its
local component.  A pair that meets in several nodes counts in the first one only.

Defined cases: fewer than five words make one shingle of all words; no words at all: documents are
alike only if their texts are equal; null text is empty; repeated rows belong to one class; an
empty table gives an empty result; null ids stay null and name a class only if it has no other id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import map_rows, split_words
from cohortlens.llm.components import components
from cohortlens.runtime import materialise

WORDS, THRESHOLD = 5, 0.8
TREES, LABEL, RECALL = 16, 8, 0.999
BLOCK = 256  # classes per block
BLOCK_SHINGLES = 1_000_000  # shingles per block
CELLS = 16_000_000  # cells of one slice of a membership matrix

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def prefix_depth(trees: int = TREES, label: int = LABEL, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """Longest prefix at which a pair at the threshold still meets with the wanted probability."""
    depth = label
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


class Shingler:
    """Hashed shingle sets; remembers the hashes of words it has met."""

    def __init__(self, words: int = WORDS) -> None:
        self.words, self.seen = words, {}

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the runs of five words."""
        words = split_words(text)
        if len(self.seen) > 500_000:
            self.seen = {}
        seen = self.seen
        for w in set(words).difference(seen):
            seen[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter((seen[w] for w in words), np.uint64, len(words))
        if not len(h):
            return h
        k = min(self.words, len(h))
        n = len(h) - k + 1
        code = h[:n].copy()
        for i in range(1, k):
            code *= _MULTIPLIER
            code ^= code >> np.uint64(31)
            code += h[i : i + n]
        return np.unique(code)


class Labels:
    """One prefix key per tree: the MinHash values of the tree's prefix, hashed together."""

    def __init__(self, trees: int, depth: int) -> None:
        rng = np.random.default_rng(20_011)
        self.trees, self.depth = trees, depth
        self.factors = rng.integers(1, 2**63, trees * depth, np.uint64) | np.uint64(1)
        self.shifts = rng.integers(0, 2**63, trees * depth, np.uint64)

    def keys(self, shingles: np.ndarray) -> list[int]:
        least = np.full(self.trees * self.depth, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(shingles), 1024):
            x = shingles[at : at + 1024, None] ^ self.shifts
            x *= self.factors
            x ^= x >> np.uint64(32)
            np.minimum(least, x.min(0), out=least)
        rows = least.reshape(self.trees, self.depth)
        return [xxhash.xxh64_intdigest(rows[t].tobytes(), t) - 2**63 for t in range(self.trees)]


def _sketch(trees: int, depth: int):
    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        shingler, labels = Shingler(), Labels(trees, depth)
        for doc_id, text, text_key in rows:
            s = shingler.shingles(text)
            if len(s):
                yield doc_id, text_key, xxhash.xxh3_128_digest(s.tobytes()), len(s), labels.keys(s)
            else:
                yield doc_id, text_key, text_key, 0, None

    return run


def sketches(docs: DataFrame, trees: int = TREES, depth: int | None = None) -> DataFrame:
    """Per document: id, text key, key of its shingle set, set size, one prefix key per tree."""
    depth = depth or prefix_depth(trees)
    return map_rows(
        docs.select(F.col("doc_id").cast("long"), "text", _text_key().alias("text_key")), _sketch(trees, depth),
        "doc_id bigint, text_key binary, set_key binary, n int, keys array<bigint>",
        [pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.list_(pa.int64())],
    )


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of exact intersection sizes, by products of slices of the membership matrix."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1  # a shingle of one set only adds nothing
    order = np.argsort(column[shared], kind="stable")
    owner, column = owner[shared][order], column[shared][order]
    column = np.unique(column, return_inverse=True)[1]
    out, width = np.zeros((n, n), np.float64), max(1, CELLS // n)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [lo, lo + width])
        part = np.zeros((n, min(width, int(column[-1]) + 1 - lo)), np.float32)
        part[owner[a:b], column[a:b] - lo] = 1
        out += part @ part.T
    return out


def _links(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        tree, lo, hi = (table.column(c)[0].as_py() for c in ("tree", "lo", "hi"))
        cid, blk, texts = (np.asarray(table.column(c)) for c in ("cid", "block", "texts"))
        kept = np.array([[-1 if k is None else k for k in row] for row in table.column("kept").to_pylist()], np.int64)
        missing = np.array([[k is None for k in row] for row in table.column("kept").to_pylist()])
        shingler = Shingler()
        sets = [shingler.shingles(t) for t in table.column("text").to_pylist()]
        size = np.array([len(s) for s in sets], np.float64)
        common = _intersections(sets)
        near = common >= threshold * (size[:, None] + size[None, :] - common) - 1e-9
        np.fill_diagonal(near, False)
        if lo != hi:
            near &= blk[:, None] != blk[None, :]
        for t in range(tree):  # met before
            same = (kept[:, t][:, None] == kept[:, t][None, :]) & ~missing[:, t][:, None]
            near &= ~same
        parent = np.arange(len(cid))
        order = np.argsort(cid)
        while True:  # smallest reachable class
            linked = np.where(near, cid[parent][None, :], np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max)
            best = np.minimum(cid[parent], linked)
            new = order[np.searchsorted(cid[order], best)]
            if (new == parent).all():
                break
            parent = new
        found = near.any(1)
        return pa.table({
            "cid": pa.array(cid[found]), "root": pa.array(cid[parent][found]),
            "links": pa.array((near @ texts.astype(np.int64))[found].astype(np.int64)),
        })

    return run


def near_duplicates(
    docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, depth: int | None = None, block: int = BLOCK
) -> DataFrame:
    """One row per document: ``doc_id``, ``class_id`` (smallest id of its group), ``n_links``, ``group_size``.

    ``n_links`` counts the different texts other than its own that are at least ``threshold``
    similar; groups are the connected components of those links.
    """
    rows, groups = _groups(docs, threshold, trees, depth, block)
    return rows.select("doc_id", "set_key").join(groups.drop("keep"), "set_key").select("doc_id", "class_id", "n_links", "group_size")


def _groups(
    docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, depth: int | None = None, block: int = BLOCK
) -> tuple[DataFrame, DataFrame]:
    """All rows with ``set_key`` and ``text_key``, and per ``set_key`` its group and the (id, text) that the group keeps."""
    depth = depth or prefix_depth(trees, LABEL, threshold)
    rows = materialise(sketches(docs, trees, depth), "sketches")
    texts = rows.groupBy("set_key", "text_key").agg(
        F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("rows"), F.first("n").alias("n"), F.first("keys").alias("keys")
    )
    classes = texts.groupBy("set_key").agg(
        F.min("first_id").alias("first_id"), F.sum("rows").alias("rows"), F.count(F.lit(1)).cast("int").alias("texts"),
        F.first("n").alias("n"), F.first("keys").alias("keys"), F.min(F.struct("first_id", "text_key")).alias("at"),
        F.min(F.struct(F.col("first_id").isNull().alias("unnamed"), "first_id", "text_key")).alias("keep"),
    )
    classes = materialise(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")

    # Trie nodes with at least two classes; of nodes with the same members the first tree's stays.
    labels = classes.where("keys IS NOT NULL").select("cid", "n", F.posexplode("keys").alias("tree", "key"))
    nodes = labels.groupBy("tree", "key").agg(
        F.count(F.lit(1)).alias("m"), F.sum("n").alias("load"), F.bit_xor(F.xxhash64("cid")).alias("x"),
        F.sum(F.xxhash64("cid", F.lit(1)).cast("decimal(20,0)")).alias("s"),
    ).where("m > 1")
    kept = nodes.groupBy("m", "x", "s").agg(
        F.min(F.struct("tree", "key")).alias("at"), F.first("load").alias("load")
    ).select("at.tree", "at.key", "m", "load")
    members = materialise(labels.join(kept, ["tree", "key"]).select("cid", "tree", "key", "m", "load"), "members")

    # Text of each class that has a partner, and all its kept nodes.
    at_tree = F.map_from_entries(F.collect_list(F.struct("tree", "key")))
    nodes_of = members.groupBy("cid").agg(at_tree.alias("by_tree")).select(
        "cid", F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.try_element_at("by_tree", t)).alias("kept")
    )
    sources = materialise(_texts_of(docs, nodes_of.join(classes.select("cid", "texts", "at"), "cid")), "sources")
    cuts = F.ceil(F.greatest(F.col("m") / block, F.col("load") / BLOCK_SHINGLES)).cast("int")
    placed = members.withColumn("cuts", cuts).withColumn("block", F.pmod(F.xxhash64("cid", F.lit(7)), "cuts").cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).select(
        "cid", "tree", "key", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")
    )
    found = spread.join(sources, "cid").groupBy("tree", "key", "lo", "hi").applyInArrow(
        _links(threshold), "cid bigint, root bigint, links bigint"
    )
    found = materialise(found, "found")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))

    known = classes.join(links, "cid", "left").join(roots.withColumnRenamed("node", "cid"), "cid", "left")
    known = materialise(known.select(
        "set_key", F.coalesce("root", "cid").alias("root"), "first_id", "rows", "keep",
        (F.coalesce("links", F.lit(0)) + F.col("texts") - 1).alias("n_links"),
    ), "known")
    groups = known.groupBy("root").agg(F.min("first_id").alias("class_id"), F.sum("rows").alias("group_size"), F.min("keep").alias("keep"))
    return rows, known.select("root", "set_key", "n_links").join(groups, "root").drop("root")


def _text_key() -> Column:
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` with the text of each class, looked up by one of its documents and that text's key."""
    at = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_key().alias("key"), "text")
    found = at.join(wanted, at["doc_id"].eqNullSafe(wanted["at"]["first_id"]) & (at["key"] == wanted["at"]["text_key"]))
    return found.groupBy("cid").agg(F.first("texts").alias("texts"), F.first("kept").alias("kept"), F.first("text").alias("text"))


def keep_one(docs: DataFrame, **options: int) -> DataFrame:
    """One document of each group, with all columns: the one with the smallest id, if any has one.

    Each row is judged by its id and text: of rows that share the smallest id, or of a group without ids,
    the text with the smallest key stays.  Rows that repeat both id and text are one document.
    """
    rows, groups = _groups(docs, **options)
    kept = F.col("doc_id").eqNullSafe(F.col("keep.first_id")) & (F.col("text_key") == F.col("keep.text_key"))
    losers = rows.select("doc_id", "set_key", "text_key").join(groups.select("set_key", "keep"), "set_key").where(~kept).select(
        F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")
    ).distinct()
    return docs.join(losers, docs["doc_id"].cast("long").eqNullSafe(losers["__id"]) & (_text_key() == losers["__key"]), "left_anti")
