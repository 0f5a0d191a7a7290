"""Secret scans: keywords first, regular expressions at their hits, checksums last.

An Aho-Corasick automaton over all keywords and token prefixes reads a text once. Each hit anchors one regular
expression at its place, so no expression ever searches a text; only long hexadecimal runs, which have no keyword,
are looked for in all of it. Spans of kinds with an embedded checksum are kept only if the checksum is right.

Kinds ``assign``, ``access`` and ``hex`` are the base ones: leftmost, non-overlapping within the kind, never dropped
for a checksum. The others are additions: ``github`` and ``npm`` tokens (CRC-32 in base 62 at the end), ``jwt``
(three parts, the first two JSON objects), ``stripe``, ``slack`` and ``google`` keys (no checksum, fixed shape) and
``pem`` private key blocks (base64 body).

Positions are code points, ends exclusive. Nulls: a null text is an empty one, without spans. Rows with the same id
are documents of their own, an empty table gives no rows, further columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import sys
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adinsight.llm.common import table, whole, worker_cache

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62_crc(token: str, body: str) -> bool:
    """The last six characters are the base-62 CRC-32 of ``body``."""
    value = zlib.crc32(body.encode())
    digits = ""
    while value:
        value, digit = divmod(value, 62)
        digits = _BASE62[digit] + digits
    return token[-6:] == digits.rjust(6, "0")


def _github(token: str) -> bool:
    return base62_crc(token, token[4:-6])


def _jwt(token: str) -> bool:
    try:
        parts = [json.loads(base64.urlsafe_b64decode(p + "=" * (-len(p) % 4))) for p in token.split(".")[:2]]
    except (ValueError, binascii.Error, RecursionError):
        return False
    return all(isinstance(p, dict) for p in parts) and "alg" in parts[0]


def _pem(block: str) -> bool:
    body = "".join(block.split("-----")[2].split())
    try:
        return len(base64.b64decode(body, validate=True)) > 0
    except binascii.Error:
        return False


class Kind(NamedTuple):
    """One kind of secret; ``least`` is the shortest length of ``group``."""

    name: str
    keywords: tuple[str, ...]
    pattern: str
    group: int = 0
    least: int = 1
    valid: Callable[[str], bool] | None = None
    any_case: bool = False
    run: str | None = None  # where what follows a run decides, a refused hit rules out the later ones in it


# The contract's expressions and the published shapes of the added kinds, in order of their names in ties.
KINDS = (
    Kind("assign", ("password", "passwd", "secret", "token", "apikey", "api_key"),
         r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, None, True),
    Kind("access", ("AKIA",), r"AKIA[A-Z0-9]+", 0, 16),
    Kind("hex", (), r"[0-9a-f]+", 0, 32),
    Kind("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])", 0, 1, _github),
    Kind("npm", ("npm_",), r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])", 0, 1, _github),
    Kind("jwt", ("eyJ",), r"eyJ[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++", 0, 1, _jwt, run=r"[A-Za-z0-9_-]+"),
    Kind("stripe", ("sk_live_", "rk_live_"), r"[sr]k_live_[A-Za-z0-9]{24,}"),
    Kind("slack", ("xoxb-", "xoxp-", "xoxa-", "xoxr-", "xoxs-"), r"xox[abprs]-[0-9]+-[0-9]+-[A-Za-z0-9-]+"),
    Kind("google", ("AIza",), r"AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])"),
    Kind("pem", ("-----BEGIN",), r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----", 0, 1, _pem),
)
BASE = ("assign", "access", "hex")


class Scanner:
    """All kinds over one text at a time."""

    def __init__(self, kinds: tuple[Kind, ...] = KINDS):
        import ahocorasick

        self.kinds = kinds
        self.patterns = [re.compile(k.pattern) for k in kinds]
        self.runs = [k.run and re.compile(k.run) for k in kinds]
        self.automaton = ahocorasick.Automaton()
        words: dict[str, list[int]] = {}
        for n, kind in enumerate(kinds):
            for word in kind.keywords:
                words.setdefault(word.lower(), []).append(n)
        for word, owners in words.items():
            self.automaton.add_word(word, (len(word), owners))
        self.automaton.make_automaton()
        self.searched = [n for n, k in enumerate(kinds) if not k.keywords]
        self.long_runs = {n: re.compile(rf"{kinds[n].pattern[:-1]}{{{kinds[n].least},}}") for n in self.searched}
        self.lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) by start, then kind as listed."""
        lowered = text.lower() if text.isascii() else text.translate(self.lower)  # as long as the text, place by place
        free = [0] * len(self.kinds)  # where the next match of a kind may begin
        found = []
        starts: dict[int, set[int]] = {}
        for end, (size, owners) in self.automaton.iter(lowered):
            for n in owners:
                starts.setdefault(n, set()).add(end + 1 - size)
        for n, places in starts.items():
            kind, pattern = self.kinds[n], self.patterns[n]
            for at in sorted(places):
                if at < free[n]:
                    continue
                if not (m := pattern.match(text, at)):
                    if self.runs[n]:  # what follows the run refused this hit and would refuse every later one in it
                        free[n] = self.runs[n].match(text, at).end()
                    continue
                free[n] = m.end()
                if m.end(kind.group) - m.start(kind.group) >= kind.least and (kind.valid is None or kind.valid(m[0])):
                    found.append((at, n, m.end()))
        for n in self.searched:
            found += [(m.start(), n, m.end()) for m in self.long_runs[n].finditer(text)]
        return [(self.kinds[n].name, start, end) for start, n, end in sorted(found)]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Per row: its id and ``spans``, an array of (kind, start, end)."""
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = T.StructType([docs.schema[id_col], T.StructField("spans", T.ArrayType(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        scanner = worker_cache("secrets", lambda: Scanner(kinds), repr([k[:5] for k in kinds]))
        kind_of = to_arrow_schema(schema).field(1).type
        for batch in batches:
            rows = [[{"kind": k, "start": s, "end": e} for k, s, e in scanner.spans(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind_of)], names=schema.names)

    return docs.select(F.col(id_col), whole(text_col)).mapInArrow(run, schema)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents: counts and digests of the base kinds, all spans as text."""
    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))

    def count(kind: str) -> F.Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans: F.Column | str) -> F.Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select("doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))
