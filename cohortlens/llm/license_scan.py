"""License scan: ordered signature rules with a keyword gate and suppression by containment.

A text is normalised to its words.  One pass of a keyword automaton tells which rules can match at all;
only those regexes run.  Detections are taken in order of priority, then length; one whose words
lie inside those of a detection taken before is suppressed.  A grant that the text denies ("not licensed under")
suppresses likewise and gives nothing itself.  What stays gives the labels, and
one minus the product of the doubts of the different labels gives the score.

Defined cases: null and empty texts have no words, no labels and score 0; repeated rows give equal
rows; an empty table gives an empty result; texts of any length are read whole; other columns are not
looked at.  Base phrases are counted at every place, whether suppressed or not, and their labels stay.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import map_rows, split_words
from cohortlens.llm.license_rules import Rule, all_rules


@dataclass(frozen=True)
class Detection:
    start: int  # characters of the normalised text
    end: int
    rule: Rule


class Cover:
    """Intervals that contain no other of theirs, in order; tells whether one of them holds a given one."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def holds(self, start: int, end: int) -> bool:
        at = bisect.bisect_right(self.starts, start) - 1
        return at >= 0 and self.ends[at] >= end

    def add(self, start: int, end: int) -> None:
        lo, hi = bisect.bisect_left(self.starts, start), bisect.bisect_right(self.ends, end)
        self.starts[lo:max(lo, hi)] = [start]
        self.ends[lo:max(lo, hi)] = [end]


class Scanner:
    def __init__(self) -> None:
        self.rules = all_rules()
        self.gate = ahocorasick.Automaton()
        by_keyword = defaultdict(list)
        for i, rule in enumerate(self.rules):
            for key in rule.keywords:
                by_keyword[key].append(i)
        for key, members in by_keyword.items():
            self.gate.add_word(key, members)
        self.gate.make_automaton()

    def detections(self, text: str) -> list[Detection]:
        """Every match of every rule that passes the gate; matches of one rule may overlap."""
        gated = set()
        for _, members in self.gate.iter(text):
            gated.update(members)
        out = []
        for i in sorted(gated):
            rule, at = self.rules[i], 0
            while found := rule.pattern.search(text, at):
                out.append(Detection(found.start(), found.end(), rule))
                at = found.start() + 1
        return out


def suppress(found: list[Detection]) -> list[Detection]:
    """Detections that no other one of better priority, or of equal priority and greater length, contains."""
    cover, kept = Cover(), []
    for d in sorted(found, key=lambda d: (d.rule.priority, d.start - d.end, d.start, d.rule.label)):
        if not cover.holds(d.start, d.end):
            cover.add(d.start, d.end)
            kept.append(d)
    return sorted(kept, key=lambda d: (d.start, d.end))


def _scan(rows: Iterator[tuple]) -> Iterator[tuple]:
    scanner = Scanner()
    for doc_id, text in rows:
        words = split_words(text)
        plain = b" ".join(words).decode("utf-8", "replace")
        found = scanner.detections(plain)
        base = sorted(d.start for d in found if d.rule.base)
        spaces = [m.start() for m in re.finditer(" ", plain)] if found else []
        word_at = lambda place: bisect.bisect_left(spaces, place)
        kept = [d for d in suppress(found) if d.rule.label]
        doubt: dict[str, float] = {}
        for d in kept:
            doubt[d.rule.label] = min(doubt.get(d.rule.label, 1.0), 1 - d.rule.weight)
        base_labels = {d.rule.label for d in found if d.rule.base}
        spans = [{"start": word_at(d.start), "end": word_at(d.end) + 1, "label": d.rule.label} for d in kept]
        yield (
            doc_id, len(words), len(base), word_at(base[0]) if base else None, word_at(base[-1]) if base else None,
            ",".join(sorted(base_labels)), ",".join(sorted(base_labels | doubt.keys())), 1 - math.prod(doubt.values()), spans,
        )


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document: words, base phrases, labels, score and the kept detections as word spans."""
    schema = (
        "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
        "labels string, score double, detections array<struct<start:bigint,end:bigint,label:string>>"
    )
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))
    types = [*[pa.int64()] * 5, pa.string(), pa.string(), pa.float64(), span]
    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), _scan, schema, types)
