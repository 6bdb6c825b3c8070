"""Merkle dataset manifest with octopus multiproofs.

Every row is a leaf: the SHA-256 of its fields.  Leaves of a group ascend by key; sixteen consecutive nodes become
one parent until one node is left, the group's subroot; subroots, ordered by group, likewise give the root.
``build`` writes the tree level by level, one narrow shuffle per level of a sixteenth of the rows each.

Proofs are made per block of consecutive leaves (``BLOCK`` rows of the whole order, whatever the groups).  For each
block the union of the node coordinates that it cannot derive itself is computed from its spans: at each level only the
siblings left and right of the span, however many leaves need them.  These are fetched by one join with the
nodes; inside the block every shared interior node is hashed once, and each leaf's proof is cut out of
the runs.  No block sees more than its own rows and a few dozen fetched nodes per level.

Defined cases: a null field is ``-``; rows without a group form a group of their own, the first; rows that
share a key (or have none: these come first) are ordered by their digest, so equal rows are interchangeable and each keeps
its own leaf; texts of any length are hashed whole; an empty table has no root and an empty result; other columns
are not looked at.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import lower_ascii
from cohortlens.llm.placing import place, with_groups
from cohortlens.runtime import materialise, null_safe_join

BITS = 4
ARITY = 1 << BITS
BLOCK = 2_048  # leaves per block
HEX = 64  # characters of a digest
TOP = -1  # the tree over the subroots; a group's own tree has the group's rank
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_PROOF = "array<struct<left:string,right:string>>"


class Manifest(NamedTuple):
    """``leaves`` with tree, place, width and block; ``nodes`` (tree, level, place, width, digest); ``spans`` of the
    blocks in the trees; the root (None for an empty table) and the number of groups."""

    leaves: DataFrame
    nodes: DataFrame
    spans: DataFrame
    root: str | None
    trees: int


def digest(fields: list[Column]) -> Column:
    """SHA-256 of the fields, each as byte count, colon and value, or ``-`` if null."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[
        F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts
    ]), 256)


def _layers(level0: DataFrame, widest: int) -> list[DataFrame]:
    """All levels above ``level0`` (tree, place, width, digest), each written."""
    layers = [level0.withColumn("level", F.lit(0))]
    while widest > 1:
        run = F.array_sort(F.collect_list(F.struct("place", "digest")))  # at most ARITY nodes
        joined = F.array_join(F.transform(run, lambda node: node["digest"]), "")
        above = (
            layers[-1].where("width > 1")
            .groupBy("tree", "width", F.shiftright("place", BITS).alias("place")).agg(F.sha2(joined, 256).alias("digest"))
            .select("tree", "place", (F.shiftright(F.col("width") - 1, BITS) + 1).alias("width"), "digest")
        )
        layers.append(materialise(above, "nodes").withColumn("level", F.lit(len(layers))))
        widest = (widest - 1 >> BITS) + 1
    return layers


def _union(layers: list[DataFrame]) -> DataFrame:
    out = layers[0]
    for layer in layers[1:]:
        out = out.unionByName(layer)
    return out


def build(leaves: DataFrame, group: str, key: str, leaf: str = "leaf", block: int = BLOCK) -> Manifest:
    """Tree over ``leaves``; their other columns are carried along."""
    placed = place(leaves, group, [F.col(key).asc_nulls_first(), leaf], block)
    size = placed.groups.agg(F.max("n"), F.count(F.lit(1))).first()
    widest, trees = size[0] or 0, size[1]
    rows = materialise(
        with_groups(placed, group)
        .withColumns({"tree": F.col("rank"), "place": F.col("at") - F.col("start"), "width": F.col("n")})
        .drop("rank", "at", "start", "n"), "leaves",
    )
    own = _layers(rows.select("tree", "place", "width", F.col(leaf).alias("digest")), widest)
    subroots = materialise(
        _union(own).where("width = 1")
        .select(F.lit(TOP).cast("bigint").alias("tree"), F.col("tree").alias("place"), F.lit(trees).cast("bigint").alias("width"), "digest"),
        "subroots",
    )
    top = _layers(subroots, trees)
    root = top[-1].where("width = 1").select("digest").first()
    facts = null_safe_join(placed.spans, placed.groups, [group]).select(
        "block", F.col("rank").alias("tree"), (F.col("lo") - F.col("start")).alias("first"),
        (F.col("hi") - F.col("start")).alias("last"), F.col("n").alias("width"),
    )
    over = facts.groupBy("block").agg(F.min("tree").alias("first"), F.max("tree").alias("last")).select(
        "block", F.lit(TOP).cast("bigint").alias("tree"), "first", "last", F.lit(trees).cast("bigint").alias("width")
    )
    return Manifest(rows, _union(own + top), facts.unionByName(over), root[0] if root else None, trees)


def missing(spans: DataFrame) -> DataFrame:
    """Coordinates (block, tree, level, place) that the blocks need and cannot derive: per level of a span the
    siblings before its first and after its last node.  A whole tree needs none."""
    levels = spans.withColumn("level", F.explode(F.expr(f"filter(sequence(0, 15), k -> shiftright(width - 1, {BITS} * k) > 0)")))
    ends = levels.select("block", "tree", "level", *[
        F.expr(f"shiftright({c}, {BITS} * level)").alias(name)
        for name, c in (("a", "first"), ("b", "last"), ("end", "width - 1"))
    ])
    before = F.expr(f"if(a % {ARITY} > 0, sequence(a - a % {ARITY}, a - 1), array())")
    last = F.expr(f"least(b - b % {ARITY} + {ARITY - 1}, end)")
    after = F.when(F.col("b") < last, F.sequence(F.col("b") + 1, last)).otherwise(F.expr("cast(array() as array<bigint>)"))
    return ends.select("block", "tree", "level", F.explode(F.concat(before, after)).alias("place"))


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def climb(first: int, width: int, own: list[str], fetched: dict[tuple[int, int], str]) -> tuple[list[tuple[int, list[str]]], str]:
    """Derive all ancestors of the consecutive nodes ``own`` that start at place ``first``.

    Returns per level the number of the first run and the runs (joined digests of up to sixteen
    siblings), and the topmost digest.
    """
    levels: list[tuple[int, list[str]]] = []
    while width > 1:
        level, last = len(levels), first + len(own) - 1
        start, stop = first - first % ARITY, min(last - last % ARITY + ARITY, width)
        row = [fetched[level, p] for p in range(start, first)] + own + [fetched[level, p] for p in range(last + 1, stop)]
        runs = ["".join(row[i:i + ARITY]) for i in range(0, len(row), ARITY)]
        first, width = start >> BITS, (width - 1 >> BITS) + 1
        levels.append((first, runs))
        own = [_hash(run) for run in runs]
    return levels, own[0]


def _steps(place: int, levels: list[tuple[int, list[str]]], left: list[str], right: list[str]) -> None:
    """Append the siblings left and right of a node's ancestors, level by level."""
    for start, runs in levels:
        inside, place = HEX * (place % ARITY), place >> BITS
        run = runs[place - start]
        left.append(run[:inside])
        right.append(run[inside + HEX:])


def multiproof(manifest: Manifest, leaf: str = "leaf") -> DataFrame:
    """The leaves with ``subroot``, ``top`` (the root as derived in the block) and ``proof``: one pair of joined
    sibling digests, left and right of the leaf's ancestor, per level up to the root."""
    trees = manifest.trees
    wanted = missing(manifest.spans)
    fetched = wanted.join(manifest.nodes.select("tree", "level", "place", "digest"), ["tree", "level", "place"])

    def expand(rows: pa.Table, nodes: pa.Table) -> pa.Table:
        rows = rows.sort_by([("tree", "ascending"), ("place", "ascending")])
        known: dict[int, dict[tuple[int, int], str]] = defaultdict(dict)
        for t, k, p, d in zip(*(nodes.column(c).to_pylist() for c in ("tree", "level", "place", "digest")), strict=True):
            known[t][k, p] = d
        tree, at, width, digests = (rows.column(c).to_pylist() for c in ("tree", "place", "width", leaf))
        cuts = [i for i in range(len(tree)) if not i or tree[i] != tree[i - 1]] + [len(tree)]
        climbed = [climb(at[a], width[a], digests[a:b], known[tree[a]]) for a, b in zip(cuts, cuts[1:])]
        above, root = climb(tree[0], trees, [subroot for _, subroot in climbed], known[TOP])
        left: list[str] = []
        right: list[str] = []
        ends, subroots = [0], []
        for (a, b), (levels, subroot) in zip(zip(cuts, cuts[1:]), climbed, strict=True):
            over_left: list[str] = []
            over_right: list[str] = []
            _steps(tree[a], above, over_left, over_right)
            for i in range(a, b):
                _steps(at[i], levels, left, right)
                left += over_left
                right += over_right
                ends.append(len(left))
                subroots.append(subroot)
        pairs = pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], ["left", "right"])
        return (
            rows.append_column("subroot", pa.array(subroots, pa.string()))
            .append_column("top", pa.array([root] * len(tree), pa.string()))
            .append_column("proof", pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs))
        )

    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in manifest.leaves.schema)
    return manifest.leaves.groupBy("block").cogroup(fetched.groupBy("block")).applyInArrow(
        expand, f"{plain}, subroot string, top string, proof {_PROOF}"
    )


def fold(leaf: Column | str, proof: Column | str) -> Column:
    """The root that a leaf and its proof lead to."""
    start = F.col(leaf) if isinstance(leaf, str) else leaf
    return F.aggregate(proof, start, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def proof_digest(proof: Column | str) -> Column:
    """SHA-256 of all siblings of a proof in order."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def audit(docs: DataFrame, every: int = 5, block: int = BLOCK) -> DataFrame:
    """Manifest of documents, and for each row whether its proof still verifies after tampering.

    Rows where ``every`` divides the CRC-32 of the decimal doc_id are shown with their text's A-Z lower-cased; the others
    as they are.  Rows without an id are not tampered with.
    """
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0, F.lit(False))
    fields = [F.col(c) for c in FIELDS]
    shown = F.when(hit, digest([*fields[:-1], lower_ascii(fields[-1])])).otherwise(digest(fields))
    leaves = docs.select("doc_id", "source", digest(fields).alias("leaf"), shown.alias("shown"))
    manifest = build(leaves, "source", "doc_id", block=block)
    root = F.lit(manifest.root).cast("string")
    proven = multiproof(manifest).select(
        "doc_id", "leaf", "subroot", root.alias("root"), proof_digest("proof").alias("proof_sha256"),
        fold("shown", "proof").alias("folded_root"),
    )
    return proven.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql(source_levels: int = 5, top_levels: int = 4) -> str:
    """DuckDB SQL of ``audit`` with as many levels as stated: for sources of up to 16^5 rows and up to 16^4 sources."""
    def enc(c: str) -> str:
        return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"

    def leaf(text: str) -> str:
        return f"sha256({' || '.join(map(enc, ('doc_id', 'source', 'lang', 'n_chars', text)))})"

    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    ctes = [
        """bits AS (SELECT *, CAST(doc_id AS VARCHAR) AS d FROM documents)""",
        """checked AS (SELECT *, xor(list_reduce([CAST(4294967295 AS BIGINT)] ||
            [CAST((ascii(substr(d, CAST(1 + i // 8 AS INTEGER), 1)) >> CAST(i % 8 AS INTEGER)) & 1 AS BIGINT) FOR i IN range(0, 8 * strlen(d))],
            lambda c, b: xor(c >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295) % 5 = 0 AS hit FROM bits)""",
        f"""seen AS (SELECT doc_id, source, {leaf('text')} AS leaf,
            CASE WHEN hit THEN {leaf(f"translate(text, '{upper}', '{upper.lower()}')")} ELSE {leaf('text')} END AS shown FROM checked)""",
        """p0 AS (SELECT *, row_number() OVER w - 1 AS place, count(*) OVER (PARTITION BY source) AS width,
            leaf AS node, shown AS acc, '' AS sib FROM seen
            WINDOW w AS (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf))""",
    ]
    def rise(name: str, below: str, tree: str) -> str:
        # one row per leaf all the way up; a run's string is gathered from its distinct nodes
        return f"""{name}_runs AS (SELECT tree, place // 16 AS run, string_agg(node, '' ORDER BY place) AS text
              FROM (SELECT DISTINCT {tree} AS tree, place, node FROM {below} WHERE width > 1) GROUP BY ALL),
            {name} AS (SELECT b.* EXCLUDE (place, width, node, acc, sib),
              CASE WHEN width > 1 THEN place // 16 ELSE place END AS place, (width + 15) // 16 AS width,
              CASE WHEN width > 1 THEN sha256(r.text) ELSE node END AS node,
              CASE WHEN width > 1 THEN sha256(substr(r.text, 1, 64 * (place % 16)) || acc || substr(r.text, 64 * (place % 16) + 65)) ELSE acc END AS acc,
              CASE WHEN width > 1 THEN sib || substr(r.text, 1, 64 * (place % 16)) || substr(r.text, 64 * (place % 16) + 65) ELSE sib END AS sib
              FROM {below} b LEFT JOIN {name}_runs r ON {tree} IS NOT DISTINCT FROM r.tree AND b.width > 1 AND b.place // 16 = r.run)"""
    for k in range(source_levels):
        ctes.append(rise(f"p{k + 1}", f"p{k}", "source"))
    ctes.append(
        f"""t0 AS (SELECT * EXCLUDE (place, width), node AS subroot, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS place,
            (SELECT count(*) FROM (SELECT DISTINCT source FROM documents)) AS width FROM p{source_levels})"""
    )
    for k in range(top_levels):
        ctes.append(rise(f"t{k + 1}", f"t{k}", "0"))
    return f"""WITH {', '.join(ctes)}
    SELECT doc_id, leaf, subroot, node AS root, sha256(sib) AS proof_sha256, acc AS folded_root, acc = node AS verified FROM t{top_levels}"""


SQL = _sql()
