"""Refreshing seasons as candidates arrive: each micro-batch upserts the seasons that it has rows of."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from .. import schema as T
from ..operators import records as R
from ..sources import library
from ..sources.settled import settle


def watch(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of items from JSON lines that are put into a folder."""
    return spark.readStream.schema(T.ITEM).json(folder)


def upsert(items: DataFrame, path: str) -> None:
    """Replace rows of the library's table by those of a batch that have their id; a batch has the last row of each id.

    Rewritten are the seasons that the batch has rows of and those that the
    table has its ids in, rows without a season included: a row that changes
    its season leaves the old one.  Only their files are read, but for the ids
    and seasons of the table.  A batch that is written twice changes nothing
    the second time, so one that failed half-way is mended by its repetition.
    """
    spark = items.sparkSession
    fresh = R.last_by_key(items.withColumn("_o", F.struct("updatedAt", F.monotonically_increasing_id())), ["id"], "_o").drop("place").select(*T.ITEM.fieldNames())
    fresh = settle(fresh)  # one choice of the last row for all that follows
    try:
        old = library.read_table(spark, path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        library.write_table(fresh, path)
        return
    arriving = library.keyed(fresh).select(*library.SEASON_COLUMNS)
    leaving = old.select("id", *library.SEASON_COLUMNS).join(fresh.select("id"), "id", "left_semi").select(*library.SEASON_COLUMNS)
    # Seasons of a calendar, four a year: as literals they prune the table's files, missing ones too.
    seasons = {tuple(r) for r in arriving.unionByName(leaving).distinct().collect()}
    if not seasons:
        return
    touched = old.where(library.in_seasons(seasons)).select(*T.ITEM.fieldNames())
    # Files that a plan reads can't be replaced by it: the rows are written elsewhere first.
    kept = settle(touched.join(fresh.select("id"), "id", "left_anti").unionByName(fresh))
    library.write_table(kept, path)
    filled = {tuple(r) for r in library.keyed(kept).select(*library.SEASON_COLUMNS).distinct().collect()}
    for season in seasons - filled:  # a season whose last row has left: nothing was written over its files
        library.delete_season(spark, path, season)


def start(stream: DataFrame, path: str, checkpoint: str, write: Callable[[DataFrame, str], None] = upsert) -> StreamingQuery:
    """Upsert every micro-batch; the batch's number makes a repeated one harmless, as an upsert repeated changes nothing."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, _: write(batch, path)).start()
