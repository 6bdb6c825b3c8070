"""Personal data replaced by keyed surrogates.

Entities are found in tasks: e-mail addresses, phone numbers, IPv4 addresses, payment cards, access
keys, passwords, tokens, account numbers, and names after a title or from a list of given names.  Every
different entity gets one surrogate by HMAC over its type and canonical form, so all its mentions,
in whatever format, change alike.  A surrogate keeps type, length, separators, case, script and, for names,
gender.  Collisions are found by joins: of entities that chose the same surrogate, or one that is
itself an entity of the corpus, all but the smallest choose again with the next attempt.  Late attempts
lengthen the surrogate, so that rounds end where every value of a shape is taken.  A calling code stays.

Defined cases: null and empty texts have no entity; documents without entities are not in the
result; overlapping finds: the earlier, then longer one counts; repeated rows are rewritten alike; an
empty table gives an empty result; null ids stay null; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import map_rows
from cohortlens.runtime import materialise

KEY = "surrogates-1"  # a deployment passes its own secret

#: Given names by script and gender, surnames by script.
GIVEN = {
    ("latin", "f"): ("Anna", "Clara", "Elena", "Julia", "Laura", "Maria", "Nora", "Paula", "Sofia", "Teresa", "Vera", "Emma"),
    ("latin", "m"): ("Adrian", "Bruno", "David", "Felix", "Hugo", "Jonas", "Martin", "Oscar", "Peter", "Robert", "Simon", "Victor"),
    ("cyrillic", "f"): ("Анна", "Вера", "Елена", "Ирина", "Мария", "Ольга", "Софья", "Татьяна"),
    ("cyrillic", "m"): ("Антон", "Борис", "Виктор", "Иван", "Михаил", "Олег", "Павел", "Сергей"),
    ("greek", "f"): ("Άννα", "Ελένη", "Μαρία", "Σοφία"),
    ("greek", "m"): ("Γιώργος", "Νίκος", "Πέτρος", "Κώστας"),
}
SURNAMES = {
    "latin": ("Alder", "Becker", "Carver", "Duval", "Ferrer", "Garner", "Holm", "Keller", "Laurent", "Moreno", "Novak", "Olsen", "Prieto", "Roth", "Sander", "Weber"),
    "cyrillic": ("Белов", "Громов", "Зимин", "Котов", "Лавров", "Орлов", "Соколов", "Титов"),
    "greek": ("Γεωργίου", "Δημητρίου", "Ιωάννου", "Νικολάου"),
}
#: Titles by gender; "" leaves it open.
TITLES = {
    "m": ("Mr", "Herr", "Señor", "Sr", "Monsieur", "Господин"), "f": ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Mme", "Madame", "Госпожа"),
    "": ("Dr", "Prof"),
}

_ALL_GIVEN = {n: k for k, names in GIVEN.items() for n in names}
_TITLE = "|".join(t for ts in TITLES.values() for t in ts)
_NAME = r"[^\W\d_a-zß-öø-ÿа-яά-ώ][^\W\d_]+"

#: Type, text that must be present for the pattern to run, pattern.  Group 1, if any, is the entity.
DETECTORS = (
    ("email", "@", re.compile(r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+")),
    ("secret", "AKIA", re.compile(r"\b(AKIA[0-9A-Z]{16})\b")),
    ("secret", "", re.compile(r"(?i:password|passwd|pwd|secret|token|api[_-]?key)[\"']?\s*[=:]\s*[\"']?([^\s\"',;]{6,})")),
    ("iban", "", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")),
    ("ssn", "-", re.compile(r"\b\d{3}-\d{2}-\d{4}\b")),
    ("card", "", re.compile(r"\b(?:\d{4}[ -]?){3}\d{1,7}\b")),
    ("ip", ".", re.compile(r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b(?!\.\d)")),
    ("phone", "", re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}\b|(?<!\w)\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}\b")),
    ("name", "", re.compile(rf"\b(?:{_TITLE})\.? ({_NAME}(?: {_NAME})?)")),
    ("name", "", re.compile(rf"\b((?:{'|'.join(_ALL_GIVEN)}) {_NAME})")),
)
#: Country calling codes by their first digits; the rest have three digits.
CALLING = re.compile(r"\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}|)")
LENGTHEN = 8  # numbers keep their length for so many attempts
_DIGIT, _TITLES = re.compile(r"\d"), re.compile(rf"(?:{_TITLE}|{'|'.join(_ALL_GIVEN)})\b")
_ASSIGN = re.compile(r"(?i)passw|pwd|secret|token|key")


def canonical(kind: str, value: str) -> str:
    if kind in ("phone", "card", "ssn"):
        return ("+" if value[:1] == "+" else "") + re.sub(r"\D", "", value)
    if kind == "iban":
        return value.replace(" ", "")
    return value.lower() if kind == "email" else value


def find_entities(text: str) -> list[tuple[int, int, str, str]]:
    """Spans ``(start, end, type, extra)`` without overlaps; extra is a name's gender."""
    digits, found = bool(_DIGIT.search(text)), []
    for rank, (kind, need, pattern) in enumerate(DETECTORS):
        if need and need not in text or kind in ("iban", "ssn", "card", "ip", "phone") and not digits:
            continue
        if kind == "name" and not _TITLES.search(text) or kind == "secret" and not need and not _ASSIGN.search(text):
            continue
        for m in pattern.finditer(text):
            group = 1 if pattern.groups else 0
            start, end = m.span(group)
            if kind == "card" and not 13 <= len(canonical("card", text[start:end])) <= 19:
                continue
            gender = ""
            if kind == "name":
                first = text[start:end].split()[0]
                title = text[m.start() : start].strip(" .")
                gender = _ALL_GIVEN[first][1] if first in _ALL_GIVEN else next((g for g, ts in TITLES.items() if title in ts), "")
            found.append((start, -end, rank, kind, gender))
    out, at = [], 0
    for start, end, _, kind, gender in sorted(found):
        if start >= at:
            out.append((start, -end, kind, gender))
            at = -end
    return out


class Stream:
    """Keyed pseudo-random numbers for one entity and attempt."""

    def __init__(self, key: str, *parts: object) -> None:
        self.seed, self.block, self.held = hmac.new(key.encode(), "\x1f".join(map(str, parts)).encode("utf-8", "replace"), hashlib.sha256).digest(), 0, b""

    def below(self, n: int) -> int:
        while len(self.held) < 4:
            self.held += hashlib.sha256(self.seed + self.block.to_bytes(4, "big")).digest()
            self.block += 1
        value, self.held = int.from_bytes(self.held[:4], "big"), self.held[4:]
        return value % n


def _same_shape(text: str, stream: Stream, hexadecimal: bool = False) -> str:
    """Digits for digits and letters for letters of the same case; other characters stay."""
    out = []
    for c in text:
        if "0" <= c <= "9":
            out.append(str(stream.below(10)))
        elif c.isalpha():
            letter = "abcdef"[stream.below(6)] if hexadecimal else "abcdefghijklmnopqrstuvwxyz"[stream.below(26)]
            out.append(letter.upper() if c.isupper() else letter)
        else:
            out.append(c)
    return "".join(out)


def _luhn(digits: str) -> str:
    """The digits with their last one made the check digit."""
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(digits[:-1])))
    return digits[:-1] + str(-total % 10)


def script_of(text: str) -> str:
    for c in text:
        if "Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῾":
            return "greek"
        if "Ѐ" <= c <= "ӿ":
            return "cyrillic"
    return "latin"


def surrogate(key: str, kind: str, value: str, gender: str, attempt: int) -> str:
    """Surrogate of a canonical value; another one for every attempt."""
    stream = Stream(key, kind, value, attempt)
    # What has few others of its shape grows with later attempts.
    letters, digits = max(0, attempt - 3), max(0, attempt - LENGTHEN + 1)

    def number(length: int) -> str:
        return "".join(str(stream.below(10)) for _ in range(length))

    if kind == "email":
        local, _, domain = value.partition("@")
        host, _, top = domain.rpartition(".")
        return _same_shape(local + "x" * letters, stream) + "@" + _same_shape(host, Stream(key, "domain", host)) + "." + top
    if kind == "ip":
        inner = [str(stream.below(256)) for _ in range(2 + digits)]
        return ".".join([str(1 + stream.below(223)), *inner, str(1 + stream.below(254))])
    if kind == "card":
        return _luhn(value[0] + number(len(value) - 1 + digits))
    if kind == "iban":
        return value[:2] + _same_shape(value[2:] + "0" * digits, stream)
    if kind == "secret":
        head = "AKIA" if value.startswith("AKIA") else ""
        return head + _same_shape(value[len(head) :] + "x" * letters, stream, bool(re.fullmatch(r"[0-9a-fA-F]+", value)))
    if kind == "name":
        script = script_of(value)
        given = GIVEN[script, gender or "fm"[stream.below(2)]]
        words = [given[stream.below(len(given))]] if " " in value or value in _ALL_GIVEN else []
        family = SURNAMES[script][stream.below(len(SURNAMES[script]))]
        if len(words) + 1 <= len(value.split()):
            # Later attempts draw from a larger space: a surname of two parts, then of more.
            more = [SURNAMES[script][stream.below(len(SURNAMES[script]))] for _ in range(attempt)]
            words.append("-".join([family, *more]))
        return " ".join(words)
    code = CALLING.match(value)
    kept = code.group() if code else ""
    return kept + number(len(value) - len(kept) + digits)


def render(kind: str, mention: str, replacement: str) -> str:
    """The replacement in the format of this mention; what is longer than the mention follows it."""
    if kind not in ("phone", "card", "ssn", "iban"):
        return replacement
    signs = iter(replacement.removeprefix("+"))
    shown = [next(signs) if c.isalnum() else c for c in mention]
    return "".join([*shown, *signs])


_FOUND = "doc_id bigint, uid bigint, text string, spans array<struct<start:int,end:int,kind:string,gender:string,value:string>>"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("gender", pa.string()), ("value", pa.string())]))


def _detect(rows: Iterator[tuple]) -> Iterator[tuple]:
    for doc_id, uid, text in rows:
        spans = find_entities(text) if text else []
        if spans:
            yield doc_id, uid, text, [
                {"start": a, "end": b, "kind": k, "gender": g, "value": canonical(k, text[a:b])} for a, b, k, g in spans
            ]


def _choose(key: str):
    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for kind, value, gender, attempt in rows:
            yield kind, value, gender, attempt, surrogate(key, kind, value, gender, attempt)

    return run


def assign_surrogates(entities: DataFrame, key: str = KEY) -> DataFrame:
    """``(kind, value, new)`` with different surrogates for different entities ``(kind, value, gender)``.

    No surrogate equals an entity of the corpus.  Rounds end because each draws anew, from a space that grows.
    """
    schema = "kind string, value string, gender string, attempt int, new string"
    types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()]
    real = entities.select("kind", F.col("value").alias("new")).distinct()
    left, done, attempt = entities.select("kind", "value", "gender"), None, 0
    while True:
        drawn = materialise(map_rows(left.withColumn("attempt", F.lit(attempt)), _choose(key), schema, types), "drawn")
        free = drawn.join(real, ["kind", "new"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", "new"), ["kind", "new"], "left_anti")
        won = free.groupBy("kind", "new").agg(F.min(F.struct("value", "gender")).alias("w")).select("kind", "w.value", "new")
        done = materialise(won if done is None else done.unionByName(won), "surrogates")
        left = materialise(drawn.join(done, ["kind", "value"], "left_anti").select("kind", "value", "gender"), "undecided")
        if left.isEmpty():
            return done
        attempt += 1


def _rewrite(rows: Iterator[tuple]) -> Iterator[tuple]:
    for doc_id, text, spans in rows:
        out, at, kinds = [], 0, set()
        spans = sorted(spans, key=lambda s: s["start"])
        for s in spans:
            new = render(s["kind"], text[s["start"] : s["end"]], s["new"])
            out += [text[at : s["start"]], new]
            at = s["end"]
            kinds.add(s["kind"])
        yield doc_id, len(spans), ",".join(sorted(kinds)), "".join([*out, text[at:]])


def replace_entities(docs: DataFrame, key: str = KEY) -> DataFrame:
    """Documents with entities: ``doc_id``, ``n_entities``, ``kinds``, ``text`` with surrogates."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("uid"), "text")
    found = materialise(map_rows(source, _detect, _FOUND, [pa.int64(), pa.int64(), pa.string(), _SPAN]), "entities")
    mentions = found.select("uid", F.explode("spans").alias("s")).select("uid", "s.*")
    # One gender per name: a mention with a title tells more than one without.
    entities = mentions.groupBy("kind", "value").agg(F.max("gender").alias("gender"))
    chosen = assign_surrogates(materialise(entities, "distinct"), key)
    ready = mentions.join(chosen, ["kind", "value"]).groupBy("uid").agg(
        F.collect_list(F.struct("start", "end", "kind", "new")).alias("spans")
    )
    full = found.select("uid", "doc_id", "text").join(ready, "uid").select("doc_id", "text", "spans")
    return map_rows(
        full, _rewrite, "doc_id bigint, n_entities int, kinds string, text string", [pa.int64(), pa.int32(), pa.string(), pa.string()]
    )
