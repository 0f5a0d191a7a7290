"""Advertising report exports as DataFrames.

An export is a CSV file: a title line, a window line, a header line, data rows
(cells may hold quoted line breaks) and total rows.  :class:`ReportSource` only
turns bytes into cells, streaming record by record; typing, slugs, detection and
cleaning are Column expressions on its output.

A file beyond ``split_bytes`` is read by several tasks.  A byte range may begin
anywhere inside a quoted cell, so two passes find the record starts first: every
block is read once for each state it may begin in (:func:`scan_block`), the states
are chained from block to block, and each range then begins behind the first line
break that ends a record.  The second pass counts the records of the ranges, so
that rows carry the numbers that one task would have given them.

Files in a store that only Spark opens come as contents from its binary file reader,
one task a file of any size that reader takes (2 GB).
"""

from __future__ import annotations

import csv
import io
import itertools
import json
import re
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from adinsight.functions.dates import window_bounds
from adinsight.functions.matching import GEO_COLUMNS
from adinsight.functions.numbers import clean_cell, col, parse_number

# A column that identifies a report, checked in this order.
DETECTION = (
    ("search_term", "search_terms"),
    ("search_keyword", "search_keyword_qs"),
    ("performance_max_placement", "pmax_placements"),
    ("landing_page", "landing_pages"),
    ("hour_of_the_day", "schedule_dow_hod"),
    ("audience_segment", "audiences"),
    ("item_id_sold", "products_sold"),
    ("product_title_sold", "products_sold"),
    ("distance_from_location_assets", "distance_from_location"),
    ("state_matched", "geographic"),
    ("headline_1", "ads_performance"),
    ("keywords_active", "ad_group_performance"),
)

# The column that names the entity of a report, and its date column.
ENTITY_COLUMNS = {
    "search_terms": "search_term",
    "keyword_geo": "search_keyword",
    "search_keyword_qs": "search_keyword",
    "ad_group_performance": "ad_group",
    "campaign_performance": "campaign",
    "ads_performance": "ad_name",
    "landing_pages": "landing_page",
    "pmax_placements": "performance_max_placement",
    "geographic": "state_matched",
    "audiences": "audience_segment",
    "products_sold": "product_title_sold",
    "distance_from_location": "distance_from_location_assets",
}
DATE_COLUMNS = {"campaign_performance": "month", "schedule_dow_hod": "day"}
METRICS = {"clicks": "clicks", "impr": "impressions", "cost": "cost", "conversions": "conversions",
           "conv_value": "conv_value"}

FORMAT = "ad_report"
CELLS = "file string, row_index bigint, window_raw string, cells array<string>"
HEADER_ROW = -1
BATCH_ROWS = 8192
SPLIT_BYTES = 64 << 20  # files up to this size are read by one task
SPLIT_TASKS = 10_000  # tasks of a pass over blocks; beyond, a task takes several
CHUNK_BYTES = 1 << 16

# What a byte of a file may follow: the start of a cell, plain text of a cell, quoted
# text, or a quotation mark inside quoted text (its end, or the first of a pair).
CELL_START, PLAIN, QUOTED, AFTER_QUOTE = range(4)
_PLAIN = re.compile(rb"[^,\r\n]*+")
_QUOTED = re.compile(rb'(?:[^"]++|"")*+')
_CELL = rb'(?:"(?:[^"]++|"")*+"[^,\r\n]*+|(?!")[^,\r\n]*+)'
_CELLS = re.compile(rb"(?:" + _CELL + rb"[,\r\n])*+")
_RECORD = re.compile(rb"(?:" + _CELL + rb",)*+" + _CELL + rb"[\r\n]")

# The reader travels to the workers by value, so they need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
CELL_CHARACTERS = 1 << 30  # a report's cell may be longer than the csv module's default


# --- reading ------------------------------------------------------------------------


def open_filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The filesystem of a path, and the path within it."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def opens(path: str) -> bool:
    """Whether Arrow knows the filesystem of a path; if not, only Spark's readers reach it."""
    try:
        open_filesystem(path)
    except (pa.ArrowException, OSError):
        return False
    return True


def _contents(spark: SparkSession, paths: list[str], recursive: bool = False) -> DataFrame:
    """(path, content) of CSV files, by Spark's reader; the names are no patterns."""
    literal = [re.sub(r"([\\*?\[\]{}])", r"\\\1", p) for p in paths]
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", recursive)
    return reader.load(literal).select("path", "content")


def list_reports(folder: str, recursive: bool = False) -> list[str]:
    """CSV files inside a folder (any filesystem that Arrow or Spark can open), by name."""
    if not opens(folder):
        names = [r["path"] for r in _contents(SparkSession.active(), [folder], True).select("path").collect()]
        depth = folder.rstrip("/").count("/") + 1
        return sorted(n for n in names if recursive or n.count("/") == depth)
    fs, root = open_filesystem(folder)
    found = fs.get_file_info(pafs.FileSelector(root, recursive=recursive))
    names = sorted(i.path for i in found if i.type == pafs.FileType.File and i.path.endswith(".csv"))
    scheme = folder.split("://", 1)[0] + "://" if "://" in folder else ""
    return names if scheme in ("", "file://") else [scheme + n for n in names]


def window_text(line: str) -> str:
    """The window cell of the second line, which may be quoted and followed by others."""
    first = next(csv.reader([line.strip()]), [""])
    bare = line.strip()
    return (first[0] if bare.startswith('"') and first else bare).strip('"')


@dataclass
class Piece(InputPartition):
    """A file, or the records of one between two record starts; ``first`` is the number of its first row."""

    path: str
    start: int | None = None
    end: int | None = None
    first: int = 0


def _opened(path: str, content: pa.Buffer | None = None) -> pa.NativeFile:
    """A file, or its content where that is given."""
    if content is not None:
        return pa.BufferReader(content)
    fs, inner = open_filesystem(path)
    return fs.open_input_file(inner)


def _head(file: pa.NativeFile) -> tuple[list[str], int]:
    """The first lines of a file, four at most, and where the fourth begins."""
    found = b""
    while chunk := file.read(CHUNK_BYTES):
        found += chunk
        if len(re.findall(rb"\r\n?|\n", found[:-1])) > 3:
            break
    breaks = [m.end() for m in re.finditer(rb"\r\n?|\n", found)]
    start = breaks[2] if len(breaks) > 2 else len(found)
    text = io.TextIOWrapper(io.BytesIO(found[:start]), encoding="utf-8-sig")
    return list(text) + (["..."] if start < len(found) else []), start


def _data_start(path: str, preamble: bool) -> int | None:
    """Where the records of a file begin; None where it has none."""
    with _opened(path) as file:
        if preamble:
            lines, start = _head(file)
            return start if len(lines) == 4 else None
        return 3 if file.read(3) == b"\xef\xbb\xbf" else 0


def _kept(cells: list[str], preamble: bool) -> bool:
    blank = all(not c.strip() for c in cells)
    return not blank and not (preamble and cells[0].strip().lower() == "total")


def _records(piece: Piece, preamble: bool, headers_only: bool, content: pa.Buffer | None = None) -> Iterator[tuple]:
    """(row_index, window_raw, cells) of a piece; the header comes as row -1."""
    csv.field_size_limit(CELL_CHARACTERS)
    window = ""
    start = piece.start
    with _opened(piece.path, content) as file:
        if preamble:
            lines, begin = _head(file)
            if len(lines) < 4:
                return
            window = window_text(lines[1])
            if headers_only:
                yield HEADER_ROW, window, next(csv.reader([lines[2]]), [])
                return
            start = begin if start is None else start
        end = file.size() if piece.end is None else piece.end
        with file.get_stream(start or 0, end - (start or 0)) as raw, \
                io.TextIOWrapper(io.BufferedReader(raw), encoding="utf-8" if start else "utf-8-sig") as text:
            kept = (cells for cells in csv.reader(text) if _kept(cells, preamble))
            for index, cells in enumerate(kept, piece.first):
                yield index, window, cells


def _batches(path: str, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """The rows of a file as batches of CELLS."""
    schema = pa.schema([("file", pa.string()), ("row_index", pa.int64()), ("window_raw", pa.string()),
                        ("cells", pa.list_(pa.string()))])
    while batch := list(itertools.islice(rows, BATCH_ROWS)):
        index, window, cells = zip(*batch)
        yield pa.RecordBatch.from_arrays(
            [pa.array([path] * len(batch)), pa.array(index, pa.int64()), pa.array(window, pa.string()),
             pa.array(cells, pa.list_(pa.string()))], schema=schema)


def _parsed(files: DataFrame, preamble: bool, headers_only: bool) -> DataFrame:
    """Cells of the files (path, content), a null content for one that Arrow opens; works on streams, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from _batches(path, _records(Piece(path), preamble, headers_only, content.as_buffer()))

    return files.select("path", "content").mapInArrow(run, CELLS)


class ReportReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.pieces = [Piece(*p) for p in json.loads(options.get("pieces", "[]"))]
        self.preamble = options.get("preamble", "true") == "true"
        self.part = options.get("part", "rows")

    def partitions(self) -> list[Piece]:
        return self.pieces

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return _batches(partition.path, _records(partition, self.preamble, self.part == "headers"))


class ReportSource(DataSource):
    """``part=headers`` yields one row per file, ``part=rows`` its data rows."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return CELLS

    def reader(self, schema: object) -> ReportReader:
        return ReportReader(dict(self.options))


# --- splitting ----------------------------------------------------------------------


def _from_cell(block: bytes, at: int) -> tuple[int, int | None]:
    end = _CELLS.match(block, at).end()
    record = _RECORD.match(block, at)
    if end == len(block):
        state = CELL_START
    elif block[end:end + 1] != b'"':
        state = PLAIN
    else:
        mark = _QUOTED.match(block, end + 1).end()
        left = len(block) - mark
        state = QUOTED if left == 0 else AFTER_QUOTE if left == 1 else PLAIN
    return state, record.end() if record else None


def _from_plain(block: bytes, at: int) -> tuple[int, int | None]:
    end = _PLAIN.match(block, at).end()
    if end == len(block):
        return PLAIN, None
    state, cut = _from_cell(block, end + 1)
    return state, cut if block[end:end + 1] == b"," else end + 1


def _from_quoted(block: bytes, at: int) -> tuple[int, int | None]:
    end = _QUOTED.match(block, at).end()
    if end == len(block):
        return QUOTED, None
    return _from_plain(block, end + 1) if end + 1 < len(block) else (AFTER_QUOTE, None)


def scan_block(block: bytes) -> list[tuple[int, int | None]]:
    """For each state the block may begin in: the state behind it, and the end of its first record, if any.

    The states are those of the csv module, so a quotation mark inside plain text
    does not open a quotation, as it would if marks were merely counted.
    """
    after = _from_quoted(block, 1) if block[:1] == b'"' else _from_plain(block, 0)
    return [_from_cell(block, 0), _from_plain(block, 0), _from_quoted(block, 0), after]


def _over_pieces(spark: SparkSession, pieces: list[Piece], found: Callable[[Piece], list[int]]) -> list:
    """One result per piece, computed by tasks; the rows come back in the order of file and start."""
    schema = "path string, start bigint, end bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([{**row, "found": found(Piece(**row))}], schema=out)

    out = pa.schema([("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("found", pa.list_(pa.int64()))])
    frame = spark.createDataFrame([(p.path, p.start, p.end) for p in pieces], schema)
    rows = frame.repartition(min(len(pieces), SPLIT_TASKS)).mapInArrow(run, schema + ", found array<bigint>").collect()
    return sorted(rows, key=lambda r: (r["path"], r["start"]))


def split_files(spark: SparkSession, paths: list[str], preamble: bool, split_bytes: int) -> list[Piece]:
    """Files as pieces of about ``split_bytes`` that begin at record starts.

    Whole files up to that size cost nothing but the listing.  Of larger ones a row
    per block reaches the driver, which keeps the list of input partitions anyway.
    """
    sizes = {p: fs.get_file_info(inner).size for p in paths for fs, inner in [open_filesystem(p)]}
    large = {p: _data_start(p, preamble) for p in sorted(set(paths)) if sizes[p] > split_bytes}
    blocks = [Piece(p, at, min(at + split_bytes, sizes[p])) for p, start in large.items() if start is not None
              for at in range(start, sizes[p], split_bytes)]
    if not blocks:
        return [Piece(p) for p in paths]

    def scanned(piece: Piece) -> list[int]:
        fs, inner = open_filesystem(piece.path)
        with fs.open_input_file(inner) as file:
            pairs = scan_block(file.read_at(piece.end - piece.start, piece.start))
        return [x for state, cut in pairs for x in (state, -1 if cut is None else piece.start + cut)]

    def counted(piece: Piece) -> list[int]:
        return [sum(1 for _ in _records(piece, preamble, False))]

    starts = {p: [start] for p, start in large.items() if start is not None}
    path, state = None, CELL_START
    for row in _over_pieces(spark, blocks, scanned):
        begins = row["path"] != path
        path, state = row["path"], CELL_START if begins else state
        state, cut = row["found"][2 * state:2 * state + 2]
        if not begins and starts[path][-1] < cut < sizes[path]:
            starts[path].append(cut)
    ranges = [Piece(p, a, b) for p, found in starts.items() for a, b in zip(found, [*found[1:], sizes[p]])]
    numbered: dict[str, list[Piece]] = {p: [] for p in starts}
    first = 0
    for row in _over_pieces(spark, ranges, counted):
        first = first if numbered[row["path"]] else 0
        numbered[row["path"]].append(Piece(row["path"], row["start"], row["end"], first))
        first += row["found"][0]
    return [piece for p in paths for piece in numbered.get(p, [Piece(p)])]


def read_cells(spark: SparkSession, paths: list[str], part: str = "rows", preamble: bool = True,
               split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Cells of the files; no paths give an empty frame."""
    if not paths:
        return spark.createDataFrame([], CELLS)
    if apart := [p for p in paths if not opens(p)]:
        cells = _parsed(_contents(spark, apart), preamble, part == "headers")
        rest = [p for p in paths if p not in set(apart)]
        return cells.unionByName(read_cells(spark, rest, part, preamble, split_bytes)) if rest else cells
    spark.dataSource.register(ReportSource)
    pieces = [Piece(p) for p in paths] if part == "headers" else split_files(spark, paths, preamble, split_bytes)
    listed = json.dumps([(p.path, p.start, p.end, p.first) for p in pieces])
    reader = spark.read.format(FORMAT).option("pieces", listed).option("part", part)
    return reader.option("preamble", str(preamble).lower()).load()


# --- header expressions ---------------------------------------------------------------


def slug(c: Column | str) -> Column:
    """Lower-case, every other run of characters to one underscore, ``col`` when empty."""
    text = F.regexp_replace(F.lower(F.trim(col(c))), r"[^a-z0-9]+", "_")
    bare = F.regexp_replace(text, r"^_+|_+$", "")
    return F.when(bare == "", "col").otherwise(bare)


def header_slugs(header: Column | str) -> Column:
    """Slugs of a header array: trailing blank cells dropped, repeats numbered from 1."""
    cells = col(header)
    last = F.array_max(F.transform(cells, lambda x, i: F.when(F.trim(x) != "", i + 1).otherwise(F.lit(0))))
    slugs = F.transform(F.slice(cells, F.lit(1), F.coalesce(last, F.lit(0))), slug)

    def numbered(x: Column, i: Column) -> Column:
        seen = F.size(F.filter(F.slice(slugs, F.lit(1), i), lambda y: y == x))
        return F.when(seen > 0, F.concat_ws("_", x, seen)).otherwise(x)

    return F.transform(slugs, numbered)


def detect_report(slugs: Column | str) -> Column:
    """Report type of a slug array, null when unknown."""
    names = col(slugs)
    has = lambda name: F.array_contains(names, name)
    geo = F.arrays_overlap(names, F.array(*[F.lit(c) for c in GEO_COLUMNS]))
    chain = F.when(has("search_keyword") & geo, "keyword_geo")
    for needle, report in DETECTION:
        chain = chain.when(has(needle), report)
    return chain.when(has("campaign") & has("campaign_type") & ~has("ad_group"), "campaign_performance")


def headers_of(files: DataFrame) -> DataFrame:
    """The header row of each file named in column ``file``, read from ``content`` if there is such a column; works on streams, too.

    Rows are as those of :func:`read_cells` for headers; a file that is too short gives none.
    """
    content = F.col("content") if "content" in files.columns else F.lit(None).cast("binary").alias("content")
    return _parsed(files.select(F.col("file").alias("path"), content), True, True)


# --- report frames ----------------------------------------------------------------------


def describe_files(headers: DataFrame) -> DataFrame:
    """One row per file: slugs, report type and window dates.

    ``keys`` and ``positions`` say which cell feeds which field; where a numbered
    slug meets a genuine one, the last cell wins.
    """
    files = headers.select("file", "window_raw", header_slugs("cells").alias("slugs"))
    size = F.size("slugs")
    kept = F.filter(
        F.sequence(F.lit(0), size - 1),
        lambda i: ~F.array_contains(F.slice(F.col("slugs"), i + 2, size), F.get(F.col("slugs"), i)),
    )
    described = files.filter(size > 0).withColumn("positions", kept)
    return described.select(
        "file", F.regexp_extract("file", r"([^/]+)$", 1).alias("source_file"), "window_raw", "slugs", "positions",
        F.transform("positions", lambda i: F.get(F.col("slugs"), i)).alias("keys"),
        detect_report("slugs").alias("report_type"), window_bounds("window_raw").alias("w"),
    ).select("*", "w.*").drop("w")


def records(rows: DataFrame, files: DataFrame, one_a_type: bool = False) -> DataFrame:
    """Data rows as cleaned ``record`` maps with their file's report type.

    ``one_a_type`` says that the descriptions hold a file or a few per report type, so they are broadcast.
    """
    side = files.select("file", "source_file", "report_type", "keys", "positions")
    if one_a_type:
        side = F.broadcast(side)
    cells = F.transform("positions", lambda i: clean_cell(F.get(F.col("cells"), i)))
    return rows.join(side, "file").select("file", "source_file", "report_type", "row_index",
                                          F.map_from_arrays("keys", cells).alias("record"))


def numeric_columns(rows: DataFrame, keys: list[str], share: float = 0.8) -> DataFrame:
    """Fields of which at least ``share`` of the present values are numbers."""
    cells = rows.select(*keys, F.explode("record").alias("column", "value")).filter(F.col("value").isNotNull())
    sums = cells.groupBy(*keys, "column").agg(F.count("*").alias("present"), F.count(parse_number("value")).alias("numeric"))
    return sums.select(*keys, "column", "present", "numeric",
                       (F.col("numeric") >= F.lit(share) * F.col("present")).alias("is_numeric"))


def _per_type(columns: dict[str, str]) -> Column:
    """The record field that a report type designates."""
    pairs = [F.lit(x) for pair in columns.items() for x in pair]
    return F.try_element_at(F.col("record"), F.create_map(*pairs)[F.col("report_type")])


def land_rows(rows: DataFrame) -> DataFrame:
    """Landing facts: campaign, ad group, entity, date, five typed metrics, full record."""
    field = lambda name: F.try_element_at(F.col("record"), F.lit(name))
    keep = [c for c in ("client_id", "source_file", "report_type") if c in rows.columns]
    return rows.select(
        *keep, "row_index", field("campaign").alias("campaign"), field("ad_group").alias("ad_group"),
        _per_type(ENTITY_COLUMNS).alias("entity"), _per_type(DATE_COLUMNS).alias("date"),
        *[parse_number(field(source)).alias(name) for source, name in METRICS.items()], "record",
    )
