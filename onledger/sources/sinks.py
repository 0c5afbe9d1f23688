"""Writers: projections, snapshots, manifests, and tables that are merged by key without a table format."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from onledger.operators.aggregates import earliest, latest


def write_csv(rows: DataFrame, path: str, order: Sequence[str]) -> None:
    """Ordered CSV with a header; NULL is an empty field, never zero. Sorting is a range shuffle over many files."""
    (rows.orderBy(*order).write.option("header", True).option("nullValue", "").option("emptyValue", '""')
     .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss'Z'").csv(path))


def decoded(text: Column) -> Column:
    """JSON text that holds an object or array as a nested value; any other text as it is."""
    nested = F.when(F.ltrim(text).rlike(r"\A[\{\[]"), F.try_parse_json(text))
    return F.coalesce(nested, text.cast("variant"))


def write_jsonl(rows: DataFrame, path: str, json_columns: Sequence[str]) -> None:
    """One object per line, NULL fields kept, JSON-text columns decoded."""
    fields = [decoded(F.col(c)).alias(c) if c in json_columns else F.col(c) for c in rows.columns]
    rows.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def export_snapshot(spark: SparkSession, tables: Mapping[str, DataFrame], root: str, exclude: Sequence[str] = (),
                    null_columns: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Write every table not excluded, some columns nulled, and return source against target row counts.

    The loop is over table names; every write and count is a distributed job.
    """
    report = None
    for name, rows in tables.items():
        counted = rows.agg(F.count("*").alias("source_rows"))
        if name in exclude:
            line = counted.withColumn("target_rows", F.lit(None).cast("bigint"))
        else:
            blank = {c: F.lit(None).cast(rows.schema[c].dataType) for c in (null_columns or {}).get(name, ())}
            rows.withColumns(blank).write.parquet(f"{root}/{name}") if blank else rows.write.parquet(f"{root}/{name}")
            written = spark.read.parquet(f"{root}/{name}").select(F.count("*")).scalar()
            line = counted.withColumn("target_rows", written)
        line = line.select(F.lit(name).alias("table_name"), "source_rows", "target_rows",
                           F.lit(name not in exclude).alias("included"))
        report = line if report is None else report.unionByName(line)
    return report.withColumn("agrees", ~F.col("included") | (F.col("source_rows") == F.col("target_rows")))


def manifest(spark: SparkSession, root: str, pattern: str = "*.parquet") -> DataFrame:
    """Relative path, size and SHA-256 of every exported file.

    A file is one row here, so exports have to bound theirs: write with ``maxRecordsPerFile``, as Spark reads no binary file
    above 2 GB.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root))
    return files.select(F.regexp_replace("path", r"\A.*" + root.rstrip("/").split("/")[-1] + "/", "").alias("relative_path"),
                        F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


class VersionedTable:
    """Numbered version folders below one root; a version counts once its job committed, the newest one is current.

    Rewriting the same batch gives the same rows, so a job that was lost half-way is simply run again.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path, jvm

    def versions(self) -> list[int]:
        fs, path, jvm = self._fs()
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        done = [n for n in names if n.startswith("version=") and fs.exists(
            jvm.org.apache.hadoop.fs.Path(f"{self.root}/{n}/_SUCCESS"))]
        return sorted(int(n.split("=")[1]) for n in done)

    def read(self, version: int | None = None) -> DataFrame | None:
        known = self.versions()
        if not known:
            return None
        return self.spark.read.parquet(f"{self.root}/version={version if version is not None else known[-1]}")

    def read_all(self, below: int | None = None) -> DataFrame | None:
        """All committed versions together, for tables whose versions are increments; only those before ``below`` if given.

        A batch that is run again must not see what its own first run wrote, so it names its version here.
        """
        known = [n for n in self.versions() if below is None or n < below]
        if not known:
            return None
        return self.spark.read.parquet(*[f"{self.root}/version={n}" for n in known])

    def write(self, rows: DataFrame, number: int | None = None) -> int:
        """Write a version. A caller that may run twice passes the number, so the second run replaces the first."""
        if number is None:
            known = self.versions()
            number = known[-1] + 1 if known else 1
        rows.write.mode("overwrite").parquet(f"{self.root}/version={number}")
        return number


def append_new(table: VersionedTable, batch: DataFrame, keys: Sequence[str], order: Sequence[str], number: int | None = None) -> int:
    """Add rows whose key is not stored yet; of repeated keys in the batch the first counts.

    Only the new rows are written; of what is stored only the key columns are read. A batch that may run twice passes the
    number of its version: the second run then neither sees nor keeps what the first one wrote.
    """
    fresh = earliest(batch, keys, order)
    old = table.read_all(number)
    return table.write(fresh if old is None else fresh.join(old.select(*keys), list(keys), "left_anti"), number)


def upsert_latest(current: DataFrame, batch: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """Newest version of every key wins."""
    return latest(current.unionByName(batch), keys, version)


def upsert_known(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], seq: str) -> DataFrame:
    """Per key the earliest known value of every column: known values stay, unknown ones are filled in.

    A grouped ``min_by`` that skips NULLs, so partial results combine before the shuffle.
    """
    return rows.groupBy(*keys).agg(*[
        F.min_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in columns])


def rebuild_version(table: VersionedTable, archive: VersionedTable, rows: DataFrame, key: str, archived_at: Column,
                    number: int | None = None) -> int:
    """Replace derived rows by a new version and keep the superseded ones as JSON with their version.

    The archive grows by one version per rebuild, under the number of the version it holds (read it with ``read_all``), so
    neither older records are written again nor a repeated rebuild of the same ``number`` archives anything twice.
    """
    known = [n for n in table.versions() if number is None or n < number]
    if known:
        superseded = table.read(known[-1]).select(F.lit(known[-1]).alias("version"), F.col(key).cast("string").alias("key"),
                                                  archived_at.alias("archived_at"), F.to_json(F.struct("*")).alias("record"))
        archive.write(superseded, known[-1])
    return table.write(rows, number)
