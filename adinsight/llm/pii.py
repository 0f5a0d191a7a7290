"""Personal data replaced by keyed surrogates.

Detected entities get replacements of their own kind: e-mail addresses, phone numbers, payment cards, IBANs, social
security numbers, IP addresses, and names of persons after a title. A replacement is drawn from an HMAC of the secret
key, the kind and the entity in its canonical form, so an entity reads the same in all documents (coreference), and
it has the form of what it replaces: digits stay digits between the same separators, check digits are right where
they were right, case is kept, names keep their script and gender.

Draws are checked in Spark over all entities of the corpus: no two entities of a kind may share a surrogate, and no
surrogate may be an entity that occurs. Who loses a place draws again, until there is no clash. Every third attempt
widens the form, so that rounds end where a form has too few places: names get syllables, local parts letters, numbers
digits at their end, IP addresses digits in their groups, and after ``RESERVED`` attempts an address of 2001:db8::/32.

Nulls: a null text stays null and has no entities. Rows with the same id, or the same row twice, are replaced alike.
An empty table gives no rows. All columns of the input are kept; only the text changes.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import sys
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adinsight.llm.common import packed, table, unpacked, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Titles by gender (f, m, x for either).
TITLES = {
    "f": "Mrs Ms Miss Madam Mme Mlle Madame Frau Señora Señorita Sra Srta Doña Signora Г-жа Госпожа Κυρία".split(),
    "m": "Mr Mister Sir M Monsieur Herr Señor Sr Don Signor Г-н Господин Κύριος".split(),
    "x": "Dr Prof Professor Doctor Доктор".split(),
}
_GENDER = {t.casefold(): g for g, words in TITLES.items() for t in words}
_NAME = r"[^\W\d_][^\W\d_]+(?:[-'’][^\W\d_]+)*"
_PERSON = re.compile(rf"(?<!\w)({'|'.join(sorted((t for w in TITLES.values() for t in w), key=len, reverse=True))})(\.?)[  ]({_NAME})(?:[  ]({_NAME}))?")
_DOMAIN = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}(?![A-Za-z0-9])")
_NUMBERS = (
    ("ip", re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)")),
    ("phone", re.compile(r"(?<![\w+])\+\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{2,14}){1,5}(?!\w)")),
    ("phone", re.compile(r"(?<!\w)\(\d{2,5}\)[ .-]?\d{2,5}(?:[ .-]?\d{2,5}){1,3}(?!\w)")),
    ("phone", re.compile(r"(?<![\w.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\w-])")),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("card", re.compile(r"(?<![\w-])(?<!\d\.)(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5})(?![\w-]|\.\d)")),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
    ("ip6", re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f:]*:[0-9A-Fa-f:]*:)[0-9A-Fa-f:]{3,39}(?![\w:])")),
)
_LOCAL = frozenset("._%+-")
#: Attempts after which an IP address is drawn from the range reserved for documentation.
RESERVED = 12


class Entity(NamedTuple):
    start: int
    end: int
    kind: str
    canonical: str


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _iban(text: str) -> bool:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _number(kind: str, text: str) -> tuple[str, str] | None:
    """Kind and canonical form of a candidate, or None if it is none."""
    if kind == "ip":
        return (kind, text) if all(int(x) < 256 for x in text.split(".")) else None
    if kind == "ip6":
        try:
            ipaddress.IPv6Address(text)
        except ValueError:
            return None
        return kind, text.lower()
    if kind == "iban":
        plain = text.replace(" ", "")
        return (kind, plain) if 15 <= len(plain) <= 34 and _iban(plain) else None
    digits = "".join(c for c in text if c.isdigit())
    if not digits.isascii():
        return None
    if kind == "card":
        shape = re.sub(r"\d", "9", text)
        sure = shape in ("9" * 16, "9999 9999 9999 9999", "9999-9999-9999-9999", "9999 999999 99999", "9999-999999-99999")
        return (kind, digits) if sure or _luhn(digits) else None
    if kind == "phone":
        return (kind, ("+" if text[0] == "+" else "") + digits) if 7 <= len(digits) <= 15 else None
    return kind, digits


def detect(text: str) -> list[Entity]:
    """Entities of a text, leftmost and longest first, without overlaps."""
    found: list[Entity] = []
    at = text.find("@")
    while at >= 0:
        start = at
        while start and (text[start - 1].isalnum() or text[start - 1] in _LOCAL or unicodedata.category(text[start - 1])[0] == "M"):
            start -= 1
        while start < at and not text[start].isalnum():
            start += 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append(Entity(start, m.end(), "email", unicodedata.normalize("NFC", text[start : m.end()]).casefold()))
        at = text.find("@", at + 1)
    if re.search(r"\d", text):
        for kind, pattern in _NUMBERS:
            for m in pattern.finditer(text):
                if known := _number(kind, m[0]):
                    found.append(Entity(m.start(), m.end(), *known))
    people: dict[str, str] = {}
    for m in _PERSON.finditer(text):
        names = [(k, m[k]) for k in (3, 4) if m[k] and m[k][0].isupper()]
        if not names or not (m[2] or m[1] not in ("M", "Sr")):
            continue
        gender = _GENDER[m[1].casefold()]
        kinds = ["surname"] if len(names) == 1 else [f"given-{gender}", "surname"]
        for (k, name), kind in zip(names, kinds):
            canonical = unicodedata.normalize("NFC", name).casefold()
            people.setdefault(name, kind)
            found.append(Entity(m.start(k), m.end(k), kind, canonical))
    if people:  # later mentions without the title
        for m in re.finditer(r"(?<!\w)(?:%s)(?!\w)" % "|".join(map(re.escape, sorted(people, key=len, reverse=True))), text):
            found.append(Entity(m.start(), m.end(), people[m[0]], unicodedata.normalize("NFC", m[0]).casefold()))
    out: list[Entity] = []
    for e in sorted(found, key=lambda e: (e.start, -e.end)):
        if not out or e.start >= out[-1].end:
            out.append(e)
    return out


# --- surrogates ----------------------------------------------------------------------------------------------------

class Draw:
    """Numbers from an HMAC of the key."""

    def __init__(self, key: bytes, *parts: object):
        self.key, self.name, self.block, self.pool = key, "\x1f".join(map(str, parts)).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 8:
            self.pool += hmac.new(self.key, self.name + b"\x1f%d" % self.block, hashlib.sha256).digest()
            self.block += 1
        value, self.pool = int.from_bytes(self.pool[:8], "big"), self.pool[8:]
        return value % n

    def one(self, items):
        return items[self.below(len(items))]

    def digits(self, n: int) -> str:
        return "".join(str(self.below(10)) for _ in range(n))


# Syllables and name endings by script and gender.
_SYLLABLES = {
    "LATIN": "ba be da do fa ga ka ke la le li lo ma me mi mo na ne no pa ra re ri ro sa se si ta te ti to va ve vi za".split(),
    "CYRILLIC": "ба бе да до га ка ла ле ли ло ма ме ми мо на не но па ра ре ри ро са се си та те ти то ва ве ви за".split(),
    "GREEK": "βα βε δα δο γα κα λα λε λι λο μα με μι μο να νε νο πα ρα ρε ρι ρο σα σε σι τα τε τι το φα φε φι ζα".split(),
}
_ENDINGS = {
    ("LATIN", "f"): ["na", "la", "ra", "lia", "nia"], ("LATIN", "m"): ["n", "r", "s", "l", "d"], ("LATIN", "x"): ["ley", "ry", "in", "an"],
    ("CYRILLIC", "f"): ["на", "ла", "ра", "ия"], ("CYRILLIC", "m"): ["н", "р", "с", "л", "д"], ("CYRILLIC", "x"): ["ля", "ша", "ня"],
    ("GREEK", "f"): ["να", "λα", "ρα", "ια"], ("GREEK", "m"): ["ος", "ης", "ας"], ("GREEK", "x"): ["ι", "ω"],
    ("LATIN", "surname"): ["man", "ker", "sen", "ton", "ard", "ez", "eau"], ("CYRILLIC", "surname"): ["ко", "ич", "юк", "ян"], ("GREEK", "surname"): ["ου", "άκη", "ίδη"],
}


def _script(text: str) -> str:
    return unicodedata.name(text[0], "").split(" ")[0]


def _letter(draw: Draw, letter: str) -> str:
    """A letter of the same script and case as one of a canonical form, from the same row of the code chart."""
    row = ord(letter) & ~63
    near = [x for x in map(chr, range(row, row + 64)) if unicodedata.category(x) == unicodedata.category(letter)
            and _script(x) == _script(letter) and unicodedata.normalize("NFC", x).casefold() == x]
    return draw.one(near or letter)


def _name(draw: Draw, kind: str, canonical: str, attempt: int) -> str:
    script = _script(canonical)
    if script not in _SYLLABLES:  # letters of the same rows of the code chart
        letters = []
        for c in canonical:
            row = ord(c) & ~63
            near = [x for x in map(chr, range(row, row + 64)) if unicodedata.category(x) == unicodedata.category(c)]
            letters.append(draw.one(near) if c.isalpha() else c)
        return "".join(letters + [_letter(draw, letters[0]) for _ in range(attempt // 3)])
    count = max(1, min(4, len(canonical) // 3)) + attempt // 3
    return "".join(draw.one(_SYLLABLES[script]) for _ in range(count)) + draw.one(_ENDINGS[script, kind.removeprefix("given-")])


def surrogate(key: bytes, kind: str, canonical: str, attempt: int) -> str:
    """The canonical form of draw number ``attempt`` for an entity."""
    draw, wider = Draw(key, kind, canonical, attempt), attempt // 3
    if kind in ("ip", "ip6") and attempt >= RESERVED:
        return "2001:db8:" + ":".join("".join(draw.one("123456789abcdef") for _ in range(4)) for _ in range(6))
    if kind == "email":
        local = canonical.split("@")[0]
        local = "".join(draw.digits(1) if c.isdigit() else draw.one("abcdefghijklmnopqrstuvwxyz") if c.isascii() and c.isalpha()
                        else _letter(draw, c) if c.isalpha() else c for c in local)
        local += "".join(draw.one("abcdefghijklmnopqrstuvwxyz") for _ in range(wider))
        host = Draw(key, "domain", canonical.split("@")[1], 0)  # one domain, one replacement, all under reserved names
        return f"{local}@{''.join(host.one('bcdfghklmnprstvwz') + host.one('aeiou') for _ in range(3))}.example.{host.one(['com', 'net', 'org'])}"
    if kind == "ip":
        octets = []
        for octet in canonical.split("."):
            size = len(str(int(octet)))
            low = (0, 10, 100)[size - 1] if not wider else 0
            high = (9, 99, 255)[min(3, size + wider) - 1]
            octets.append(str(low + draw.below(high - low + 1)).rjust(len(octet), "0"))
        return ".".join(octets)
    if kind == "ip6":
        sized = (len(group) and min(4, len(group) + wider) for group in canonical.split(":"))
        return ":".join("".join(draw.one("123456789abcdef") for _ in range(size)) for size in sized)
    if kind == "iban":
        body = "".join(draw.digits(1) if c.isdigit() else draw.one("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for c in canonical[4:]) + draw.digits(wider)
        rest = 98 - int("".join(str(int(c, 36)) for c in body + canonical[:2] + "00")) % 97
        return f"{canonical[:2]}{rest:02d}{body}"
    if kind == "card":
        digits = canonical[0] + draw.digits(len(canonical) - 2 + wider)
        last = next(d for d in "0123456789" if _luhn(digits + d))
        return digits + (last if _luhn(canonical) else str((int(last) + 1 + draw.below(9)) % 10))
    if kind == "phone":
        code = 1 if canonical[0] != "+" else 2 if canonical[1] in "17" else 3  # the sign and the country's digits stay
        return canonical[:code] * (canonical[0] == "+") + draw.digits(len(canonical) - code * (canonical[0] == "+") + wider)
    if kind == "ssn":
        return draw.digits(len(canonical) + wider)
    return _name(draw, kind, canonical, attempt)


def dressed(kind: str, original: str, canonical: str) -> str:
    """A surrogate's canonical form with the separators and the case of what it replaces."""
    if kind in ("card", "phone", "ssn"):
        digits = iter(canonical.lstrip("+"))
        return "".join(next(digits) if c.isdigit() else c for c in original) + "".join(digits)
    if kind == "iban":
        letters = iter(canonical)
        return "".join(c if c == " " else next(letters) for c in original) + "".join(letters)
    if original.isupper():
        return canonical.upper()
    if kind.startswith(("given", "surname")) and original[:1].isupper():
        return canonical[:1].upper() + canonical[1:]
    return canonical


_ENTITY = "kind string, canonical string"


def _drawn(entities: DataFrame, key: bytes) -> DataFrame:
    """Rows (kind, canonical, attempt) with their draw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [surrogate(key, *row) for row in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.string())], names=["kind", "canonical", "attempt", "surrogate"])

    return entities.select("kind", "canonical", "attempt").mapInArrow(run, f"{_ENTITY}, attempt int, surrogate string")


def assign(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, canonical, surrogate) for distinct entities, without clashes.

    A given name has one surrogate, whatever titles it stands after: of the gender that they state, or of none if they
    state none or both.
    """
    found = written(entities.select("kind", "canonical").distinct(), "pii-entities")
    stated = F.array_remove(F.collect_set("kind"), "given-x")  # at most two
    gender = found.filter(F.col("kind").startswith("given-")).groupBy("canonical").agg(stated.alias("stated")).select(
        "canonical", F.when(F.size("stated") == 1, F.col("stated")[0]).otherwise("given-x").alias("settled"))
    settled = F.when(F.col("kind").startswith("given-"), F.col("settled")).otherwise(F.col("kind"))
    found = written(found.join(gender, "canonical", "left").select("kind", "canonical", settled.alias("settled")), "pii-settled")
    drawn = _settled(found.select(F.col("settled").alias("kind"), "canonical").distinct(), key)
    return found.join(drawn.withColumnRenamed("kind", "settled"), ["settled", "canonical"]).select("kind", "canonical", "surrogate")


def _settled(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, canonical, surrogate) of distinct entities: losers of a clash are drawn again until there is none."""
    entities = written(entities, "pii-distinct")
    real = entities.select("kind", F.col("canonical").alias("surrogate"), F.lit(True).alias("real"))
    now = written(_drawn(entities.withColumn("attempt", F.lit(0)), key), "pii-draws")
    while True:
        first = now.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "canonical")).alias("first"), F.count(F.lit(1)).alias("n"))
        marked = now.join(first, ["kind", "surrogate"]).join(real, ["kind", "surrogate"], "left").withColumn(
            "loses", F.col("real").isNotNull() | (F.col("canonical") != F.col("first.canonical")))
        if not marked.filter("loses").limit(1).count():
            return now.select("kind", "canonical", "surrogate")
        stay = marked.filter(~F.col("loses")).select("kind", "canonical", "attempt", "surrogate")
        again = marked.filter("loses").select("kind", "canonical", (F.col("attempt") + 1).alias("attempt"))
        now = written(stay.union(_drawn(again, key)), "pii-draws")


#: What no text with an entity lacks.
_MAYBE = r"[@0-9:]|(?:^|\W)(?:%s)\b" % "|".join(t for w in TITLES.values() for t in w)


def replace(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """``docs`` with its text replaced, and a column __entities (kind, start, end in the old text, replacement)."""
    docs, given = packed(docs, text_col), docs
    place = F.xxhash64("text")
    maybe = F.coalesce(F.col("text").rlike(_MAYBE), F.lit(False))
    span = "array<struct<start:int,end:int,kind:string,canonical:string,original:string>>"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("canonical", pa.string()), ("original", pa.string())]))
        for batch in batches:
            rows = [[e._asdict() | {"original": t[e.start : e.end]} for e in detect(t)] for t in batch.column(1).to_pylist()]
            keep = [i for i, r in enumerate(rows) if r]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array([rows[i] for i in keep], kind)], names=["place", "found"])

    # Texts are told apart by a hash of 64 bits and the spans' own strings: a span that does not fit is not applied.
    found = docs.filter(maybe).select(place.alias("place"), "text").mapInArrow(find, f"place long, found {span}")
    found = written(found, "pii-spans").dropDuplicates(["place"])  # copies are looked at once
    spans = found.select("place", F.explode("found").alias("e")).select("place", "e.*")
    names = assign(spans, key)
    told = spans.join(names, ["kind", "canonical"]).groupBy("place").agg(
        F.sort_array(F.collect_list(F.struct("start", "end", "kind", "original", "surrogate"))).alias("swaps"))
    joined = docs.filter(maybe).withColumn("place", place).join(told, "place", "left").drop("place")
    entity = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                           T.StructField("replacement", T.StringType())])
    schema = T.StructType([*docs.schema, T.StructField("entities", T.ArrayType(entity))])
    at = docs.columns.index("text")

    def swap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            texts, lists = [], []
            for text, swaps in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                done, parts, last = [], [], 0
                for s in swaps or ():
                    if text[s["start"] : s["end"]] == s["original"]:
                        new = dressed(s["kind"], s["original"], s["surrogate"])
                        parts += [text[last : s["start"]], new]
                        last = s["end"]
                        done.append({"kind": s["kind"], "start": s["start"], "end": s["end"], "replacement": new})
                texts.append("".join([*parts, text[last:]]) if parts else text)
                lists.append(done)
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, arrow.field(at).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lists, arrow.field(len(columns)).type)], schema=arrow)

    changed = joined.mapInArrow(swap, schema)
    both = changed.union(docs.filter(~maybe).withColumn("entities", F.array().cast(T.ArrayType(entity))))
    return both.select(*unpacked(both, given, text_col), F.col("entities").alias("__entities"))


#: The key of the registered query and of the pipeline; a user brings one of their own.
DEMO_KEY = b"adinsight demonstration key"


def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates for personal data, and how many of each document were replaced."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace(docs, DEMO_KEY).select("doc_id", "text", F.size("__entities").cast("long").alias("n_entities"),
                                          F.array_join(F.transform("__entities", lambda e: e["kind"]), ",").alias("kinds"))
