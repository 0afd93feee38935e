"""Scans and sinks of the library, its overrides, its log and its status."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .. import schema as T
from ..operators import quality


#: Columns that the table is partitioned by.
SEASON_COLUMNS = ("season_year", "season_quarter")


class LibraryError(RuntimeError):
    """A library that must not be written, with its issues."""

    def __init__(self, code: str, message: str, issues: Sequence = ()):
        super().__init__(message)
        self.code, self.issues = code, issues


def read(spark: SparkSession, path: str) -> DataFrame:
    """Items of a library document, with their place as ``ordinal``; a file that isn't there is an empty library."""
    try:
        document = spark.read.schema(T.LIBRARY).json(path, multiLine=True)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], T.ITEM).withColumn("ordinal", F.lit(0).cast("int"))
    return document.select(F.posexplode("items").alias("ordinal", "item")).select("item.*", "ordinal")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Items of a library kept as Parquet, partitioned by season; a filter on the season's columns reads only its files."""
    return spark.read.parquet(path)


def write_table(items: DataFrame, path: str) -> None:
    """Write items as Parquet by season; only the seasons that ``items`` has are replaced.  Errors keep the write from happening."""
    blocked = quality.issues(items).where("severity = 'error'")
    found = blocked.limit(100).collect()  # a report of some, not the whole table
    if found:
        raise LibraryError("CACHE_VALIDATION_FAILED", "the items have errors", found)
    keyed(items).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*SEASON_COLUMNS).parquet(path)


def keyed(items: DataFrame) -> DataFrame:
    """Items with the columns that the table is partitioned by; both are null for an item without a season."""
    return items.withColumn("season_year", F.col("primarySeason.year")).withColumn("season_quarter", F.col("primarySeason.quarter"))


def in_seasons(seasons: Iterable[tuple[int | None, str | None]]) -> Column:
    """Whether a row of the table lies in one of the seasons, null being a season of its own: a filter on partitions."""
    found = F.lit(False)
    for year, quarter in sorted(seasons, key=str):
        found = found | (F.col("season_year").eqNullSafe(F.lit(year)) & F.col("season_quarter").eqNullSafe(F.lit(quarter)))
    return found


def delete_season(spark: SparkSession, path: str, season: tuple[int | None, str | None]) -> None:
    """Delete the files of one season of the table."""
    year, quarter = ("__HIVE_DEFAULT_PARTITION__" if v is None else v for v in season)
    _, files, folder = _files(spark, f"{path}/season_year={year}/season_quarter={quarter}")
    files.delete(folder, True)


def _files(spark: SparkSession, path: str) -> tuple:
    """Hadoop's package, file system and path object of a path, whatever store it is in."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    return hadoop, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text file in whatever store the path names."""
    _, files, target = _files(spark, path)
    out = files.create(target, True)
    out.write(bytearray(text.encode()))
    out.close()


def replace_document(spark: SparkSession, path: str, text: str) -> None:
    """Replace a JSON document: written beside it first, the old one kept as ``.bak``, then put in its place by renaming.

    What is no JSON is refused before anything is touched; if the renaming
    fails, the old document is put back.
    """
    json.loads(text)
    hadoop, files, target = _files(spark, path)
    fresh, backup = hadoop.Path(f"{path}.tmp"), hadoop.Path(f"{path}.bak")
    _put(spark, f"{path}.tmp", text)
    had = files.exists(target)
    if had:
        files.delete(backup, False)
        if not files.rename(target, backup):
            raise LibraryError("CACHE_WRITE_FAILED", "the old document could not be set aside")
    if not files.rename(fresh, target):
        if had:
            files.rename(backup, target)
        raise LibraryError("CACHE_WRITE_FAILED", "the new document could not be put in place")


def document_of(items: DataFrame, updated: str, generated: str) -> str:
    """Items as a library document, checked; for libraries that fit the driver, which a document does."""
    blocked = quality.header_issues(1, updated, generated) + [tuple(r) for r in quality.issues(items).where("severity = 'error'").limit(100).collect()]
    if blocked:
        raise LibraryError("CACHE_VALIDATION_FAILED", "the items have errors", blocked)
    order = ["ordinal"] if "ordinal" in items.columns else ["id"]
    rows = items.orderBy(*order).select(F.to_json(F.struct(*T.ITEM.fieldNames()), {"ignoreNullFields": "false"}).alias("line")).collect()
    head = {"schemaVersion": 1, "updatedAt": updated, "generatedBy": generated}
    return json.dumps(head | {"items": [json.loads(r.line) for r in rows]}, ensure_ascii=False, indent=2)


#: The status of a library that was never refreshed.
EMPTY_STATUS = {"schemaVersion": 1, "status": "idle", "lastSuccessAt": None, "lastAttemptAt": None, "lastError": None, "currentJob": None, "cache": {"animeUpdatedAt": None, "itemCount": 0}}


def bootstrap(spark: SparkSession, folder: str, now: str) -> None:
    """Make what a store needs and does not have: an empty library and an empty status."""
    empty = {"schemaVersion": 1, "updatedAt": now, "generatedBy": "migration", "items": []}
    for name, content in (("library.json", empty), ("status.json", EMPTY_STATUS)):
        _, files, target = _files(spark, f"{folder}/{name}")
        if not files.exists(target):
            _put(spark, f"{folder}/{name}", json.dumps(content, ensure_ascii=False, indent=2))


def read_status(spark: SparkSession, path: str, now: str, seconds: int = 900) -> DataFrame:
    """The status, with a lock that has run out released; what that changes is written back."""
    try:
        found = spark.read.schema(T.STATUS).json(path, multiLine=True)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.read.schema(T.STATUS).json(spark.sparkContext.parallelize([json.dumps(EMPTY_STATUS)]))
    healed = expire_lock(found, now, seconds)
    line = lambda d: d.select(F.to_json(F.struct(*T.STATUS.fieldNames()), {"ignoreNullFields": "false"})).first()[0]
    before, after = line(found), line(healed)
    if before != after:
        replace_document(spark, path, json.dumps(json.loads(after), ensure_ascii=False, indent=2))
    return spark.createDataFrame([(after,)], "line string").select(F.from_json("line", T.STATUS).alias("s")).select("s.*")


def succeeded(status: DataFrame, at: str, items: int) -> DataFrame:
    """The status after a refresh that ended well."""
    return status.select(
        F.lit(1).alias("schemaVersion"), F.lit("success").alias("status"), F.lit(at).alias("lastSuccessAt"), F.coalesce("currentJob.startedAt", F.lit(at)).alias("lastAttemptAt"),
        F.lit(None).cast(T.STATUS["lastError"].dataType).alias("lastError"), F.lit(None).cast(T.STATUS["currentJob"].dataType).alias("currentJob"),
        F.struct(F.lit(at).alias("animeUpdatedAt"), F.lit(items).alias("itemCount")).alias("cache"),
    )


def failed(status: DataFrame, at: str, code: str, message: str) -> DataFrame:
    """The status after a refresh that failed: the last success and the counts stay those of the library there is."""
    error = F.struct(F.lit(code).alias("code"), F.lit(message).alias("message"), F.lit(at).alias("at"))
    job = F.lit(None).cast(T.STATUS["currentJob"].dataType)
    return status.select(
        F.lit(1).alias("schemaVersion"), F.lit("failed").alias("status"), "lastSuccessAt", F.coalesce("currentJob.startedAt", F.lit(at)).alias("lastAttemptAt"), error.alias("lastError"), job.alias("currentJob"), "cache",
    )


def write_through(spark: SparkSession, path: str, rows: Sequence[dict], source: str) -> list[tuple]:
    """Keep a source's rows as a document for the next time; none are not kept, and a failure is an issue, not an end."""
    if not rows:
        return []
    try:
        replace_document(spark, path, json.dumps(list(rows), ensure_ascii=False, indent=2))
    except Exception as error:  # the rows themselves are there all the same
        return [(source, "CACHE_WRITE_FAILED", str(error), True, None, None)]
    return []


def append_log(spark: SparkSession, entry: dict, path: str) -> None:
    """Append a line to a log of JSON lines."""
    spark.createDataFrame([(json.dumps(entry, ensure_ascii=False),)], "value string").coalesce(1).write.mode("append").text(path)


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """Manual slots by id; a file that can't be read has none."""
    try:
        return spark.read.schema(T.struct(overrides=T.T.ArrayType(T.OVERRIDE))).json(path, multiLine=True).select(F.inline("overrides")).dropDuplicates(["id"])
    except AnalysisException:
        return spark.createDataFrame([], T.OVERRIDE)


def union_sources(spark: SparkSession, sources: Sequence[tuple[str, Callable[[], DataFrame]]]) -> tuple[DataFrame, DataFrame]:
    """Items of all sources in their order, and an issue for each that fails."""
    items, issues = spark.createDataFrame([], T.ITEM).withColumn("source_ordinal", F.lit(0)), []
    for place, (name, fetch) in enumerate(sources):
        try:
            items = items.unionByName(fetch().select(*T.ITEM.fieldNames()).withColumn("source_ordinal", F.lit(place)))
        except Exception as error:  # a source that is out of order is reported, the others go on
            issues.append((name, getattr(error, "code", "NETWORK_FAILED"), str(error), True, getattr(error, "status", None), None))
    return items, spark.createDataFrame(issues, T.SOURCE_ISSUE)


def empty_rating(subject: Column) -> Column:
    """A rating that is not known yet."""
    url = F.when(subject.isNotNull(), F.concat(F.lit("https://bgm.tv/subject/"), subject.cast("string")))
    return F.struct(subject.cast("long").alias("subjectId"), url.alias("url"), F.lit(None).cast("double").alias("rating"), F.lit(None).cast("int").alias("ratingCount"), F.lit(None).cast("int").alias("rank"), F.lit(None).cast("string").alias("lastSyncedAt"))


def item_from(rows: DataFrame, **columns: Column) -> DataFrame:
    """Items of the given columns; those not given are null."""
    return rows.select(*(columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in T.ITEM.fields))


def expire_lock(status: DataFrame, now: str, seconds: int = 900) -> DataFrame:
    """A job that has run longer than its lock lasts has failed; anything else stays as it is."""
    started = F.try_to_timestamp(F.col("currentJob.startedAt"))
    stale = F.coalesce((F.col("status") == "running") & (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(started) > seconds), F.lit(False))
    error = F.struct(F.lit("STALE_UPDATE_LOCK").alias("code"), F.lit("the last job exceeded the lock's time and was released").alias("message"), F.lit(now).alias("at"))
    changed = {"status": F.when(stale, F.lit("failed")).otherwise(F.col("status")), "currentJob": F.when(~stale, F.col("currentJob")), "lastError": F.when(stale, error).otherwise(F.col("lastError"))}
    return status.select(*(changed.get(c, F.col(c)).alias(c) for c in status.columns))
