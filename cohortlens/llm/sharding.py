"""Balanced sharding by label propagation under capacity quotas.

Documents with equal texts are linked: each to the head of its chunk, and chunk heads to the group's
first head; a group larger than a chunk is cut, so no node gets more links than a chunk has rows.
Every document starts in a hashed shard, and a chunk takes the most frequent shard of its rows; from then on it
moves as one.  In each round the chunks of a section (as many as a shard holds) ask for the shard
most of the section's rows are in that has room for the chunk, or else, together, for another with room.  Places are granted by a
running total of sizes against the room left, whole chunks before small groups; the driver sees only the room of 24 shards.
At the end every shard gives up what it has above its quota, unlinked documents first, then chunks
without a granted place, so counts differ by one at most (law ``rows``).

Defined cases: a null text has size 0 + 8 and links to other null and empty texts; repeated rows are
documents of their own; null ids stay null; an empty table gives an empty result; other columns
are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.ordering import number_rows, running_total
from cohortlens.runtime import materialise

SHARDS = 24
ROUNDS = 5
CHUNKS_PER_SHARD = 8  # a chunk of equal texts holds at most this part of a shard


def equal_text_units(vertices: DataFrame, key: str, shards: int = SHARDS) -> DataFrame:
    """``(uid, unit, root, section)`` of the vertices ``(uid, key)`` that share their key with another.

    A unit is a chunk of a group, named by its smallest vertex; a section is as many chunks as a shard holds.
    """
    chunk = _chunk(vertices.count(), shards)
    groups = vertices.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("uid").alias("root")).where("n > 1")
    members = vertices.select("uid", key).join(groups, key).withColumn(
        "chunk", F.pmod(F.xxhash64("uid"), F.ceil(F.col("n") / chunk)).cast("int")
    )
    members = materialise(members.select("uid", key, "chunk", "root"), "members")
    heads = members.groupBy(key, "chunk").agg(F.min("uid").alias("unit"))
    section = F.floor(F.col("chunk") / CHUNKS_PER_SHARD).cast("int").alias("section")
    return materialise(members.join(heads, [key, "chunk"]).select("uid", "unit", "root", section), "units")


def equal_text_links(units: DataFrame) -> DataFrame:
    """Links ``(src, dst)`` of those vertices, as a star of stars."""
    return units.select(F.col("uid").alias("src"), F.when(F.col("uid") == F.col("unit"), F.col("root")).otherwise(F.col("unit")).alias("dst")).where(
        "src <> dst"
    )


def _chunk(total: int, shards: int) -> int:
    return max(1, total // (shards * CHUNKS_PER_SHARD))


def _quota(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def _pick(values: list[int], shard: str) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col(shard) + 1)


def _case(pairs: list[tuple[Column, Column]], other: Column) -> Column:
    out = other
    for condition, value in pairs:
        out = F.when(condition, value).otherwise(out)
    return out


def _spill(room: list[int], chunk: int, turn: int) -> Column:
    """A shard for a whole section, hashed in proportion to the room of the shards that hold a chunk."""
    weights = [r if r >= chunk else 0 for r in room]
    weights = weights if any(weights) else room
    at = F.pmod(F.xxhash64("root", "section", F.lit(turn)), F.lit(max(1, sum(weights))))
    ends = [sum(weights[: j + 1]) for j in range(len(room))]
    return _case([(at < end, F.lit(j)) for j, end in reversed(list(enumerate(ends)))], F.lit(0))


def propagate(vertices: DataFrame, units: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``(uid, unit, late, shard)`` after label propagation; ``late`` is 0 for rows with a granted place, 2 without links."""
    total = vertices.count()
    chunk, room = _chunk(total, shards), _quota(total, shards)
    start = F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int")
    heads = units.groupBy("unit", "root", "section", start.alias("at")).agg(F.count(F.lit(1)).alias("votes"))
    state = heads.groupBy("unit", "root", "section").agg(
        F.sum("votes").alias("size"), F.max(F.struct("votes", F.xxhash64("at", "unit").alias("h"), "at")).alias("best")
    ).select("unit", "root", "section", "size", F.col("best.at").alias("shard"), F.lit(1).alias("late"))
    state = materialise(state, "shards")
    for turn in range(rounds):
        waiting = state.where("late = 1")
        large = waiting.where(F.col("size") * 2 >= chunk)
        if turn < rounds - 2 and not large.isEmpty():
            waiting = large  # small groups would take the room for whole chunks
        if waiting.isEmpty():
            break
        votes = state.groupBy("root", "section", F.col("shard").alias("at")).agg(F.sum("size").alias("votes"))
        wants = waiting.join(votes, ["root", "section"]).where(_pick(room, "at") >= F.col("size")).groupBy("unit").agg(
            F.max(F.struct("votes", F.xxhash64("at", "root", "section").alias("h"), "at")).alias("best")
        )
        asking = waiting.join(wants, "unit", "left").select(
            "unit", "root", "section", "size", (F.col("size") * 2 < chunk).alias("small"),
            F.coalesce("best.at", _spill(room, chunk, turn)).alias("shard"),
        )
        asked = running_total(asking, ["shard"], ["small", "root", "section", "unit"], "size")
        late = F.when(F.col("running") <= _pick(room, "shard"), F.lit(0)).otherwise(F.lit(1))
        columns = ["unit", "root", "section", "size", "shard"]
        others = state.join(waiting.select("unit"), "unit", "left_anti")
        state = materialise(others.unionByName(asked.select(*columns, late.alias("late"))), "shards")
        held = {r["shard"]: r["n"] for r in state.where("late = 0").groupBy("shard").agg(F.sum("size").alias("n")).collect()}
        room = [q - held.get(j, 0) for j, q in enumerate(_quota(total, shards))]
    moved = units.select("uid", "unit").join(state.select("unit", "late", "shard"), "unit")
    return materialise(vertices.select("uid").join(moved, "uid", "left").select(
        "uid", F.coalesce("unit", "uid").alias("unit"), F.coalesce("late", F.lit(2)).alias("late"), F.coalesce("shard", start).alias("shard")
    ), "shards")


def settle(state: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Exact quotas: ``(uid, shard, slot)`` with slots from 0 without gaps."""
    counts = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    have = [counts.get(j, 0) for j in range(shards)]
    total = sum(have)
    if not total:
        return state.select("uid", "shard", F.lit(0).cast("long").alias("slot"))
    quota = _quota(total, shards)
    starts, before, spare, room = [], 0, 0, 0
    surplus, gaps = [], []
    for j in range(shards):
        starts.append(before)
        surplus.append(spare)
        before += have[j]
        spare += max(0, have[j] - quota[j])
        if quota[j] > have[j]:
            gaps.append((room, room + quota[j] - have[j], j, have[j]))
            room += quota[j] - have[j]
    # Rows of a unit lie next to each other here and in the gaps, so a unit that must move is hardly cut.
    rows = number_rows(state.select("uid", "unit", "shard", "late"), ["shard", "late", "unit", "uid"], "row")
    pick = lambda values: _pick(values, "shard")
    placed = rows.select("uid", "shard", (F.col("row") - 1 - pick(starts)).alias("r"), pick(quota).alias("q"), pick(surplus).alias("s"))
    placed = placed.withColumn("over", F.when(F.col("r") >= F.col("q"), F.col("s") + F.col("r") - F.col("q")))
    inside = lambda lo, hi: (F.col("over") >= lo) & (F.col("over") < hi)
    shard = _case([(inside(lo, hi), F.lit(j)) for lo, hi, j, _ in gaps], F.col("shard"))
    slot = _case([(inside(lo, hi), F.col("over") - lo + n) for lo, hi, _, n in gaps], F.col("r"))
    return placed.select("uid", shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: id, size, text checksum, law, shard and slot."""
    text = F.coalesce(F.col("text"), F.lit(""))
    vertices = materialise(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text)).alias("key"), F.monotonically_increasing_id().alias("uid"),
    ), "vertices")
    units = equal_text_units(vertices, "key", shards)
    placed = settle(propagate(vertices, units, shards, rounds), shards)
    return vertices.join(placed, "uid").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
