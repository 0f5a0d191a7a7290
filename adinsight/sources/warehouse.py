"""The landing warehouse: snapshot replacement, preserved scores, ledger and coverage.

Both tables are Parquet.  A load first writes its rows below a version of its own,
where no reader looks, and then appends its ledger rows, which name that version, as
one file.  That file is the commit: the newest ledger row of a client and report type
says which version holds its rows.  A load that is lost on the way leaves the earlier
snapshot and its ledger as they were, loading twice equals loading once, other clients
are never touched, and a report that arrives without data rows replaces the earlier one.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from adinsight.sources.report_files import describe_files, land_rows, list_reports, open_filesystem, read_cells, records

# The reports expected of an account, and the fields a re-load keeps.
EXPECTED_REPORTS = (
    "campaign_performance", "ad_group_performance", "search_keyword_qs", "search_terms", "ads_performance",
    "landing_pages", "schedule_dow_hod", "audiences", "geographic", "pmax_placements", "distance_from_location",
    "products_sold",
)
PRESERVED_FIELDS = ("quality_score", "exp_ctr", "ad_relevance", "landing_page_exp")
PRESERVED_REPORT = "search_keyword_qs"
KEYWORD_KEY = ("search_keyword", "search_keyword_match_type", "campaign", "ad_group")

NO_TABLE_YET = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")  # no folder, or one without files
SNAPSHOT = ("client_id", "report_type")
PARTITIONS = (*SNAPSHOT, "version")
ROWS_SCHEMA = (
    "source_file string, row_index bigint, campaign string, ad_group string, entity string, date string, clicks double, "
    "impressions double, cost double, conversions double, conv_value double, record map<string,string>, "
    "client_id string, report_type string, version string"
)
UPLOADS_SCHEMA = (
    "upload_id bigint, source_file string, window_raw string, window_start date, window_end date, row_count bigint, "
    "uploaded_at timestamp, report_type string, version string, commit bigint, client_id string"
)


@dataclass(frozen=True)
class Warehouse:
    """Locations of the two tables below a shared root folder."""

    spark: SparkSession
    root: str

    @property
    def rows_path(self) -> str:
        return f"{self.root.rstrip('/')}/raw_rows"

    @property
    def uploads_path(self) -> str:
        return f"{self.root.rstrip('/')}/uploads"

    def _read(self, path: str, schema: str) -> DataFrame:
        try:
            self.spark.read.parquet(path)
        except AnalysisException as failure:
            if failure.getCondition() not in NO_TABLE_YET:
                raise
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def _ledger(self) -> DataFrame:
        """The newest ledger row per client and report type."""
        every = self._read(self.uploads_path, UPLOADS_SCHEMA)
        fields = F.struct(*[c for c in every.columns if c not in SNAPSHOT])
        newest = every.groupBy(*SNAPSHOT).agg(F.max_by(fields, F.struct("commit", "version")).alias("newest"))
        return newest.select("newest.*", *SNAPSHOT)

    def rows(self) -> DataFrame:
        """Rows of the committed snapshots.  The broadcast versions, one a client and report type, prune the scan."""
        stored = self._read(self.rows_path, ROWS_SCHEMA)
        committed = F.broadcast(self._ledger().select(*PARTITIONS))
        return stored.join(committed, list(PARTITIONS), "left_semi").select(*[c for c in stored.columns if c != "version"])

    def uploads(self) -> DataFrame:
        ledger = self._ledger()
        return ledger.drop("version", "commit")

    def stage(self, rows: DataFrame) -> str:
        """Write rows below a new version, which no reader sees before it is published."""
        version = uuid.uuid4().hex
        staged = rows.withColumn("version", F.lit(version))
        staged.write.mode("append").partitionBy(*PARTITIONS).parquet(self.rows_path)
        return version

    def publish(self, client_id: str, version: str, files: DataFrame) -> DataFrame:
        """Commit a staged version for the report types of ``files``; returns its ledger rows.

        All rows of the commit go into one file, so they appear together or not at all.
        """
        staged = self._read(self.rows_path, ROWS_SCHEMA).filter((F.col("client_id") == client_id) & (F.col("version") == version))
        counts = staged.groupBy("report_type").agg(F.count("*").alias("row_count"))
        mine = self._read(self.uploads_path, UPLOADS_SCHEMA).filter(F.col("client_id") == client_id)
        commit = mine.agg(F.coalesce(F.max("commit"), F.lit(0))).first()[0] + 1
        now = F.current_timestamp()
        ledger = files.join(counts, "report_type", "left").select(
            F.xxhash64(F.lit(client_id), "report_type", now).alias("upload_id"), "source_file", "window_raw", "window_start",
            "window_end", F.coalesce("row_count", F.lit(0)).alias("row_count"), now.alias("uploaded_at"), "report_type",
            F.lit(version).alias("version"), F.lit(commit).cast("bigint").alias("commit"), F.lit(client_id).alias("client_id"),
        )
        ledger.coalesce(1).write.mode("append").partitionBy("client_id").parquet(self.uploads_path)
        return self._ledger().filter((F.col("client_id") == client_id) & (F.col("version") == version)).drop("version", "commit")

    def vacuum(self, client_id: str) -> int:
        """Delete a client's replaced and unpublished versions; returns how many.  No load of the client may be running."""
        fs, root = open_filesystem(f"{self.rows_path}/client_id={client_id}")
        ledger = self._ledger().filter(F.col("client_id") == client_id)
        keep = {(f"report_type={r['report_type']}", f"version={r['version']}") for r in ledger.collect()}  # a row a report type
        found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True, recursive=True))
        parts = [(i.path, tuple(i.path.split("/")[-2:])) for i in found if i.type == pafs.FileType.Directory]
        stale = [path for path, names in parts if names[1].startswith("version=") and names not in keep]
        for path in stale:
            fs.delete_dir(path)
        return len(stale)


def preserve_scores(new: DataFrame, old: DataFrame) -> DataFrame:
    """Carry earlier measured scores over a re-load.

    For each keyword key (null-safe) the last old row with any score field wins;
    its non-null fields override the new values.  Old rows are reduced to one per
    key first, so the join cannot multiply rows.
    """
    key = [F.try_element_at(F.col("record"), F.lit(k)).alias(k) for k in KEYWORD_KEY]
    fields = F.struct(*[F.try_element_at(F.col("record"), F.lit(f)).alias(f) for f in PRESERVED_FIELDS])
    measured = old.select(*key, fields.alias("f"), "row_index").filter(
        F.coalesce(*[F.col(f"f.{f}") for f in PRESERVED_FIELDS]).isNotNull()
    )
    kept = measured.groupBy(*KEYWORD_KEY).agg(F.max_by("f", "row_index").alias("kept"))
    match: Column | None = None
    for k in KEYWORD_KEY:
        same = F.try_element_at(new["record"], F.lit(k)).eqNullSafe(kept[k])
        match = same if match is None else match & same
    earlier = F.map_filter(
        F.create_map(*[x for f in PRESERVED_FIELDS for x in (F.lit(f), F.col(f"kept.{f}"))]), lambda _, v: v.isNotNull()
    )
    others = F.map_filter("record", lambda k, _: ~F.array_contains(F.map_keys(earlier), k))
    merged = F.when(F.col("kept").isNull(), F.col("record")).otherwise(F.map_concat(others, earlier))
    columns = [merged.alias("record") if c == "record" else new[c] for c in new.columns]
    return new.join(kept, match, "left").select(*columns)


def load_files(warehouse: Warehouse, client_id: str, paths: list[str], keep_newer: bool = False) -> DataFrame:
    """Load report files for a client; returns the ledger rows of this load.

    The header pass picks the last file by name per report type.  Its result, a row
    per file, passes through the driver, which listed the files anyway; the chosen
    files are then parsed once each.  Earlier keyword files of the same load give
    their scores to the later ones, as if each had been loaded on its own.
    ``keep_newer`` leaves out files whose names come before the one in the ledger.
    """
    spark = warehouse.spark
    described = describe_files(read_cells(spark, paths, "headers")).filter(F.col("report_type").isNotNull())
    if keep_newer:
        stored = warehouse.uploads().filter(F.col("client_id") == client_id).groupBy("report_type").agg(F.max("source_file").alias("_stored"))
        described = described.join(F.broadcast(stored), "report_type", "left")  # a row per report type
        described = described.filter(F.col("_stored").isNull() | (F.col("source_file") >= F.col("_stored"))).drop("_stored")
    known = described.collect()
    last = {t: max((r for r in known if r["report_type"] == t), key=lambda r: (r["source_file"], r["file"]))
            for t in {r["report_type"] for r in known}}
    if not last:
        return warehouse.uploads().limit(0)
    every, chosen = spark.createDataFrame(known, described.schema), spark.createDataFrame(list(last.values()), described.schema)

    def landed(files: list[str], sides: DataFrame) -> DataFrame:
        return records(read_cells(spark, files), sides, True).withColumn("client_id", F.lit(client_id)).drop("file")

    plain = [r["file"] for t, r in last.items() if t != PRESERVED_REPORT]
    parts = [landed(plain, chosen)] if plain else []
    if PRESERVED_REPORT in last:
        own = (F.col("client_id") == client_id) & (F.col("report_type") == PRESERVED_REPORT)
        rows = warehouse.rows().filter(own)
        for r in sorted((r for r in known if r["report_type"] == PRESERVED_REPORT), key=lambda r: (r["source_file"], r["file"])):
            rows = preserve_scores(landed([r["file"]], every), rows)
        parts.append(rows)
    facts = land_rows(reduce(DataFrame.unionByName, parts))
    return warehouse.publish(client_id, warehouse.stage(facts), chosen)


def load_folder(warehouse: Warehouse, client_id: str, folder: str) -> DataFrame:
    """Load all exports of a folder.  The same call is safe to repeat."""
    paths = list_reports(folder)
    if not paths:
        return warehouse.uploads().limit(0)
    return load_files(warehouse, client_id, paths)


def unmapped_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files that are too short or whose header fits no report type."""
    paths = list_reports(folder)
    known = describe_files(read_cells(spark, paths, "headers")).filter(F.col("report_type").isNotNull())
    every = spark.createDataFrame([(p,) for p in paths], "file string")
    return every.join(known, "file", "left_anti").select(F.regexp_extract("file", r"([^/]+)$", 1).alias("source_file"))


def coverage(uploads: DataFrame) -> DataFrame:
    """Per client: each expected or loaded report, whether it is present, and ``n/12``."""
    spark = uploads.sparkSession
    loaded = uploads.groupBy("client_id", "report_type").agg(F.max("row_count").alias("row_count"))
    expected = F.array(*[F.lit(r) for r in EXPECTED_REPORTS])
    clients = loaded.groupBy("client_id").agg(F.count("*").alias("present"))
    wanted = clients.select("client_id", F.explode(expected).alias("report_type"))
    rows = wanted.join(loaded, ["client_id", "report_type"], "full_outer")
    text = F.concat(F.col("present").cast("string"), F.lit(f"/{len(EXPECTED_REPORTS)}"))
    return rows.join(clients, "client_id").select(
        "client_id", "report_type", F.col("row_count").isNotNull().alias("loaded"), "row_count",
        F.array_contains(expected, F.col("report_type")).alias("expected"), text.alias("coverage"),
    )


def client_rollup(clients: DataFrame, uploads: DataFrame) -> DataFrame:
    """Clients by name with the number of loaded reports and the last upload time."""
    sums = uploads.groupBy("client_id").agg(F.count_distinct("report_type").alias("reports_loaded"),
                                            F.max("uploaded_at").alias("last_upload"))
    rows = clients.join(sums, "client_id", "left").orderBy("name", "client_id")
    return rows.select("client_id", "name", F.coalesce("reports_loaded", F.lit(0)).alias("reports_loaded"), "last_upload")


def client_slug(name: Column | str) -> Column:
    """URL-safe client id from a display name."""
    c = F.col(name) if isinstance(name, str) else name
    text = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(text == "", "client").otherwise(text)
