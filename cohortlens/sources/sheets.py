"""Workbook sheets landed as text tables, stacked into one table.

A landed book is a folder of parquet partitioned by ``sheet``: the row number ``row`` (from 1) and
the cells ``c0, c1, ...`` as text.  The header may sit in row 1 or row 2.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlens.runtime import materialise

HEADER_ROWS = 2


def read_book(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def unique_names(names: Sequence[str | None]) -> list[str | None]:
    """Header texts with ``.1``, ``.2`` added to repeats; a missing header stays None."""
    seen: dict[str, int] = {}
    out: list[str | None] = []
    for name in names:
        if name is None:
            out.append(None)
            continue
        out.append(name if name not in seen else f"{name}.{seen[name]}")
        seen[name] = seen.get(name, 0) + 1
    return out


def headers(book: DataFrame, sheets: Sequence[str]) -> dict[str, Row]:
    """The header row of every sheet: the first row whose first cell is filled, of the top rows.

    One job for all sheets; the filters are pushed to the scan and one row per sheet reaches the
    driver, however often a row number is repeated.
    """
    top = book.where(F.col("sheet").isin(*sheets) & (F.col("row") <= HEADER_ROWS) & F.col("c0").isNotNull())
    cells = F.struct(*[F.col(c) for c in book.columns])
    first = top.groupBy("sheet").agg(F.min_by(cells, "row").alias("h")).select("h.*")
    found: dict[str, Row] = {row["sheet"]: row for row in first.collect()}
    for name in sheets:
        if name not in found:
            raise ValueError(f"sheet {name!r} has no header in its first {HEADER_ROWS} rows")
    return found


def sheet(book: DataFrame, name: str, header: Row | None = None) -> DataFrame:
    """One sheet with its header texts as column names, without the header rows."""
    header = header or headers(book, [name])[name]
    cells = [c for c in book.columns if c not in ("sheet", "row")]
    named = zip(cells, unique_names([header[c] for c in cells]), strict=True)
    kept = {c: n for c, n in named if n is not None}
    body = book.where((F.col("sheet") == name) & (F.col("row") > header["row"]))
    return body.select(*kept).toDF(*kept.values())


@dataclass(frozen=True)
class HeaderRules:
    """How header texts become canonical names, in this order: repeats get ``.1``, ``.2``; ``synonyms`` are replaced;
    ``rewrites`` (pattern, replacement) are applied; headers that match ``listed[0]`` get the names ``listed[1]`` from left to
    right.  Only ``columns`` are kept; a sheet must have all of ``required``."""

    columns: Sequence[str]
    required: Sequence[str] = ()
    synonyms: dict[str, str] = field(default_factory=dict)
    rewrites: Sequence[tuple[str, str]] = ()
    listed: tuple[str, Sequence[str]] | None = None


def _cells(book: DataFrame) -> list[str]:
    return [c for c in book.columns if c not in ("sheet", "row")]


def header_table(book: DataFrame, rules: HeaderRules) -> DataFrame:
    """One row per sheet: the header's row, ``places`` (canonical name -> cell number) and how many headers were ``listed``.

    All sheets are handled by the same few expressions over a table of header cells; no header text reaches
    the driver.  Windows run over the headers of one sheet.
    """
    top = book.where((F.col("row") <= HEADER_ROWS) & F.col("c0").isNotNull())
    first = top.groupBy("sheet").agg(F.min_by(F.struct("row", F.array(*_cells(book)).alias("texts")), "row").alias("h"))
    cells = first.select("sheet", F.col("h.row").alias("header_row"), F.posexplode("h.texts").alias("place", "text")).where("text IS NOT NULL")
    repeat = F.row_number().over(W.partitionBy("sheet", "text").orderBy("place")) - 1
    name = F.when(repeat == 0, F.col("text")).otherwise(F.concat("text", F.lit("."), repeat.cast("string")))
    named = cells.withColumn("name", name)
    if rules.synonyms:
        known = F.create_map(*[F.lit(t) for pair in rules.synonyms.items() for t in pair])
        named = named.withColumn("name", F.coalesce(known[F.col("name")], "name"))
    for pattern, replacement in rules.rewrites:
        named = named.withColumn("name", F.regexp_replace("name", pattern, replacement))
    hit = F.col("name").rlike(rules.listed[0]) if rules.listed else F.lit(False)
    named = named.withColumn("hit", hit)
    if rules.listed:
        order = F.row_number().over(W.partitionBy("sheet", "hit").orderBy("place"))
        names = F.array(*[F.lit(n) for n in rules.listed[1]])
        named = named.withColumn("name", F.when(F.col("hit"), F.get(names, order - 1)).otherwise(F.col("name")))
    kept = F.when(F.col("name").isin(*rules.columns), F.struct("name", "place"))
    return named.groupBy("sheet", "header_row").agg(
        F.map_from_entries(F.collect_list(kept)).alias("places"), F.count_if("hit").alias("listed"))


def _checked(found: DataFrame, sheets: Sequence[str], rules: HeaderRules) -> DataFrame:
    """The header table, once every sheet has a header and the columns it needs; one job, one row to the driver."""
    lacking = F.array_except(F.array(*[F.lit(c) for c in rules.required]), F.map_keys("places"))
    wrong = ~F.col("listed").isin(0, len(rules.listed[1])) if rules.listed else F.lit(False)
    n, no_columns, miscounted = found.agg(
        F.count(F.lit(1)), F.min(F.when(F.size(lacking) > 0, F.struct("sheet", lacking.alias("lacking")))),
        F.min(F.when(wrong, F.struct("sheet", "listed")))).first()
    if n < len(set(sheets)):
        name = min(set(sheets) - {r[0] for r in found.select("sheet").collect()})
        raise ValueError(f"sheet {name!r} has no header in its first {HEADER_ROWS} rows")
    if miscounted:
        raise ValueError(f"{miscounted[1]} columns match {rules.listed[0]!r} in sheet {miscounted[0]!r}, {len(rules.listed[1])} names given")
    if no_columns:
        raise ValueError(f"sheet {no_columns[0]!r} lacks the columns {sorted(no_columns[1])}")
    return found


def harmonised(book: DataFrame, sheets: Sequence[str], rules: HeaderRules) -> DataFrame:
    """The body rows of all ``sheets``: ``sheet`` and the canonical columns as text, NULL where a sheet has no such column.

    A row picks its cells by the places that its sheet's header gives, so the plan has one branch however many
    sheets there are.
    """
    wanted = book.where(F.col("sheet").isin(*sheets))
    found = _checked(materialise(header_table(wanted, rules), "headers"), sheets, rules)
    cells = F.array(*[F.col(c) for c in _cells(book)])

    def value(name: str) -> Column:
        return F.get("cells", F.col("places")[name]).alias(name)

    # The header table is a file of one row per sheet: its measured size decides how it is joined.
    body = wanted.join(found, "sheet").where(F.col("row") > F.col("header_row"))
    return body.select("sheet", "places", cells.alias("cells")).select("sheet", *[value(c) for c in rules.columns])
