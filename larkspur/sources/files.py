"""Files and exports."""

from __future__ import annotations

import contextlib
import json
import sqlite3
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.text import estimate_tokens, redact_url, stripped, without_nul
from larkspur.sources.datasources import register_sources

# The usual extensions of a source scan, folders that settings leave out, and folders that are always left out.
CODE = ["py", "ts", "tsx", "js", "sql"]
IGNORED = ["node_modules", ".venv", "__pycache__", "dist", "build", ".next"]
SKIPPED = [".git", ".openclaw", ".claude", "vendor", "coverage", ".pytest_cache", ".mypy_cache", ".ruff_cache"]
# Fixed value: the version of the export's layout.
EXPORT_VERSION = 1
# Names of a text column in a legacy store, and how many characters of a text are embedded.
TEXT_COLUMNS = ["content", "text", "chunk"]
EMBEDDED_CHARS = 2000


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def scan_files(spark: SparkSession, paths: list[str], pattern: str, least_bytes: int = 1024) -> DataFrame:
    """(path, size, modified) of files below the paths whose names match, smaller ones left out, without reading them."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(paths)
    return rows.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")).filter(F.col("size") >= least_bytes)


def source_tree(spark: SparkSession, root: str, changed: DataFrame | None = None, most_bytes: int = 100_000, types: list[str] = CODE, ignored: list[str] = IGNORED) -> DataFrame:
    """(path, content, content_hash) of source files of the given types, without the ignored folders; changed (path, below root): only those."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rows = rows.filter((F.col("length") <= most_bytes) & F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(list(types)))
    # folders above the root don't count
    below = F.regexp_replace(F.substring_index(F.col("path"), root.rstrip("/").rsplit("/", 1)[-1] + "/", -1), "/[^/]*$", "")
    rows = rows.filter(~F.arrays_overlap(F.split(below, "/"), F.array(*map(F.lit, [*ignored, *SKIPPED]))))
    if changed is not None:
        ends = changed.select(F.concat(F.lit(root.rstrip("/") + "/"), "path").alias("_lk_path"))
        rows = rows.join(ends, F.regexp_replace("path", "^file:/*", "/") == F.regexp_replace("_lk_path", "^file:/*", "/"), "left_semi")
    return rows.select("path", F.col("content").cast("string").alias("content"), F.sha2("content", 256).alias("content_hash"))


def changed_files(listing: DataFrame) -> DataFrame:
    """(path, removed) from a version control listing, a column `value` of lines 'status TAB path' or 'status TAB old TAB new'.

    Of a rename the old path is removed and the new one changed; plain lines are changed paths; empty lines are skipped.
    """
    part = F.split("value", "\t", -1)
    kind, n = F.upper(F.substring(part[0], 1, 1)), F.size(part)
    one = lambda path, gone: F.struct(path.alias("path"), gone.alias("removed"))
    moved = F.when(kind == "R", F.array(one(part[1], F.lit(True)), one(F.get(part, F.lit(2)), F.lit(False)))).otherwise(F.array(one(F.get(part, F.lit(2)), F.lit(False))))
    found = F.when(n == 1, F.array(one(part[0], F.lit(False)))).when(n == 2, F.array(one(part[1], kind == "D"))).otherwise(moved)
    return listing.filter(F.trim("value") != "").select(F.explode(found).alias("c")).select("c.*").distinct()


def unseen(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows whose (source_app, content_hash) hasn't been ingested."""
    return rows.dropDuplicates(["source_app", "content_hash"]).join(seen.select("source_app", "content_hash"), ["source_app", "content_hash"], "left_anti")


def read_sqlite(spark: SparkSession, path: str, table: str, text_columns: list[str] = TEXT_COLUMNS, least_chars: int = 20, most_chars: int | None = None, page: int = 10_000) -> DataFrame:
    """(id, text, embed_text, token_count) of a SQLite table on a path that all executors share, read by them in ranges of row ids, `page` rows each.

    The text is the table's first column with one of the names; other values than strings and short texts are left out, and texts are cut to most_chars. A table that isn't there or has
    no such column gives no rows.
    """
    register_sources(spark)
    with contextlib.closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as db:
        text = next((r[1] for r in db.execute("select * from pragma_table_info(?)", (table,)) if r[1] in text_columns), None)
    out = spark.createDataFrame([], "id long, text string")
    if text:
        out = spark.read.format("sqlite_rows").option("table", table).option("column", text).option("rowsPerPartition", page).load(path)
    bare = out.filter(F.length(stripped(F.col("text"))) >= least_chars).withColumn("text", without_nul(F.col("text")))
    tokens = estimate_tokens(F.col("text")).alias("token_count")
    kept = F.col("text") if most_chars is None else F.substring("text", 1, most_chars)
    return bare.select("id", kept.alias("text"), F.substring("text", 1, EMBEDDED_CHARS).alias("embed_text"), tokens)


def write_export(path: str, migration: str | None, source: str | None = None, compress: bool = False, part_rows: int = 500_000, **parts: DataFrame) -> dict[str, int]:
    """A folder with one header document (version, exported_at, source) and each part as JSON lines; returns counts, taken while writing.

    A part's files follow each other in the order of created_at and id, those of them that it has, so that read one after the other they are sorted; nulls come first. source is the address of the store;
    its password is left out. An export holds whole transcripts and channels: only its owner can read it. A part is there whole or, if its write fails, as it was
    before. The path is one that the driver and all executors share.
    """
    spark = next(iter(parts.values())).sparkSession
    register_sources(spark)
    told = F.struct(redact_url(F.lit(source).cast("string")).alias("database_url"), F.lit(migration).cast("string").alias("schema_migration_top"))
    header = spark.range(1).select(F.lit(EXPORT_VERSION).alias("version"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("exported_at"), told.alias("source"))
    lines = lambda df: F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")
    header.coalesce(1).select(lines(header)).write.format("ordered_export").mode("overwrite").save(f"{path}/header")
    counts = {}
    for name, df in parts.items():
        order = [c for c in ("created_at", "id") if c in df.columns]
        rows = df.select(*order, lines(df))
        if order:
            rows = rows.repartitionByRange(max(1, -(-df.count() // part_rows)), *order).sortWithinPartitions(*order)
        rows.select("value").write.format("ordered_export").option("compressed", str(compress).lower()).mode("overwrite").save(f"{path}/{name}")
        counts[name] = json.loads(Path(path.removeprefix("file://"), name, "_manifest.json").read_text())["rows"]
    return counts


def export_header(spark: SparkSession, path: str) -> dict:
    rows = spark.read.schema("version int, exported_at string, source struct<database_url: string, schema_migration_top: string>").json(f"{path}/header").collect()
    if not rows:
        raise ValueError("the export has no header")
    return rows[0].asDict(recursive=True)


def read_export(spark: SparkSession, path: str, schemas: dict[str, str], migration: str | None) -> dict[str, DataFrame]:
    """The parts of an export whose header has this library's version and whose store stood at the same migration as this one."""
    header = export_header(spark, path)
    if header["version"] != EXPORT_VERSION:
        raise ValueError(f"unsupported export version {header['version']!r}; this reads version {EXPORT_VERSION}")
    top = (header["source"] or {}).get("schema_migration_top")
    if top is None:
        raise ValueError("the export has no schema_migration_top: export again from a migrated store")
    if migration is None:
        raise ValueError("this store has no migration: migrate it first")
    if top != migration:
        raise ValueError(f"schema mismatch: the export was made at {top!r}, this store is at {migration!r}")
    return {name: spark.read.schema(schema).json(f"{path}/{name}") for name, schema in schemas.items()}
