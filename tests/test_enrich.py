"""Enrichment, detail refresh, sync, reconciliation and the stream."""

import json

import pytest
from pyspark.sql import functions as F

from loomline import schema
from loomline.operators import enrich, match, merge
from loomline.sources import library, snapshots
from loomline.streaming import refresh as stream

from .items import NOW, bound, episode, frame, item, source
from .test_match_and_sources import subject


def subjects(spark, *rows):
    return snapshots.with_facts(spark.createDataFrame(list(rows), schema.SUBJECT))


RATED = {"rating": {"score": 8.0, "total": 10, "rank": 4}, "images": {"large": None, "common": "c", "medium": None, "small": None, "grid": None}}


def test_enrichment_binds_what_matches(spark):
    items = frame(spark, [item("a", "星の物語", episodeCount=12), item("b", "べつの話"), bound("c", 9)])
    got = {r.id: r for r in enrich.enrich_missing(items, subjects(spark, subject(1, "星の物語", name_cn="星", box=[("别名", "Hoshi")], **RATED), subject(2, "むかんけい")), NOW).collect()}
    assert got["a"].bangumi.subjectId == 1 and got["a"].bangumi.rating == 8.0 and got["a"].title.aliases == ["Hoshi"] and got["a"].coverImage.large == "c" and {s.name for s in got["a"].sources} == {"YucWiki", "Bangumi"}
    assert got["b"].bangumi.subjectId is None and got["c"].bangumi.subjectId == 9


def test_details_and_matches(spark):
    items = frame(spark, [bound("a", 1, coverImage=None), bound("b", 2, coverImage={"large": "x", "medium": None, "small": None, "source": "bangumi"})])
    got = {r.id: r for r in enrich.refresh_details(items, subjects(spark, subject(1, "n", **RATED), subject(2, "m", **RATED)), NOW).collect()}
    assert got["a"].bangumi.rating == 8.0 and got["b"].bangumi.rating == 7.5
    one = items.where("id = 'a'").crossJoin(subjects(spark, subject(3, "n", name_cn="名", **RATED)).select(F.struct("*").alias("s")))
    low, high = (one.select(merge.packed(enrich.add_match(merge.own(), F.col("s"), F.lit(c), NOW)).alias("i")).first().i for c in ("medium", "high"))
    assert low.bangumi.subjectId is None and low.externalIds.bangumiSubjectId is None and low.dataStatus == "unverified"
    assert (high.bangumi.subjectId, high.bangumi.rank, high.coverImage.large, high.title.chinese, high.dataStatus) == (3, 4, "c", "标题a", "partial")
    assert match.HIGH == 85


def test_sync(spark):
    dated = bound("a", 1, episodeCount=None, schedule=[episode("2026-07-03", 1)], updateTime="22:30")
    items = frame(spark, [dated, bound("b", 2, bangumi={"subjectId": 2, "url": None, "rating": None, "ratingCount": None, "rank": None, "lastSyncedAt": None}), item("c", "星の物語", episodeCount=12)])
    got = {r.id: r for r in enrich.sync_details(items, subjects(spark, subject(1, "n", eps=3, **RATED)), subjects(spark, subject(2, "m", eps=5, **RATED), subject(3, "星の物語", **RATED)), NOW).collect()}
    a = got["a"]
    assert [e.airDate for e in a.schedule] == ["2026-07-03", "2026-07-10", "2026-07-17"] and (a.endDate, a.status, a.airedEpisodeCount, a.updateTime) == ("2026-07-17", "finished", 3, None)
    assert got["b"].bangumi.rating == 8.0 and got["b"].episodeCount == 5 and got["c"].bangumi.subjectId == 3


def test_reconciliation(spark):
    reference = item("r", "ほし", sources=[source("YourAnimes")], updateTime="21:00", startDate="2026-07-04", schedule=[episode("2026-07-04", time="21:00")], updateWeekday=6)
    items = frame(spark, [item("a", "ほし"), bound("b", 5, sources=[source("Bangumi", "bangumi")], title__original="つき"), bound("anime:yucwiki:1", 5, title__original="つき"), item("w", format="web")])
    got = {r.id: r for r in enrich.reconcile(items, frame(spark, [reference]), spark.createDataFrame([], schema.OVERRIDE), NOW).collect()}
    assert set(got) == {"a", "anime:yucwiki:1"} and (got["a"].updateTime, got["a"].startDate, got["a"].updateWeekday) == ("21:00", "2026-07-04", 6)


def test_stream(spark, tmp_path):
    folder, table = tmp_path / "in", str(tmp_path / "table")
    folder.mkdir()
    spark.sparkContext.setCheckpointDir(str(tmp_path / "reliable"))
    write = lambda n, *rows: (folder / f"{n}.json").write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows))
    write(1, item("a"), item("b"))
    stream.start(stream.watch(spark, str(folder)), table, str(tmp_path / "state")).awaitTermination()
    write(2, item("b", updateTime="20:00", updatedAt="2026-07-29T00:00:00Z"), item("c"))
    stream.start(stream.watch(spark, str(folder)), table, str(tmp_path / "state")).awaitTermination()
    assert {r.id: r.updateTime for r in spark.read.parquet(table).collect()} == {"a": "23:30", "b": "20:00", "c": "23:30"}


def upserted(spark, table, *rows):
    stream.upsert(frame(spark, list(rows)).drop("ordinal"), table)
    return {r.id: (r.season_year, r.season_quarter, r.updateTime) for r in spark.read.parquet(table).collect()}


def test_upsert_keeps_rows_without_a_season_and_moves_rows_between_seasons(spark, tmp_path):
    table = str(tmp_path / "table")
    spark.sparkContext.setCheckpointDir(str(tmp_path / "reliable"))
    undated = {"startDate": None, "primarySeason": None, "activeSeasons": [], "schedule": [], "updateWeekday": None, "updateTime": None}
    fall = {"startDate": "2026-10-02", "primarySeason": {"year": 2026, "quarter": "fall"}, "activeSeasons": [{"year": 2026, "quarter": "fall"}], "schedule": [episode("2026-10-02")]}
    assert set(upserted(spark, table, item("u1", **undated), item("u2", **undated), item("m"), item("s"))) == {"u1", "u2", "m", "s"}
    assert set(upserted(spark, table, item("u3", **undated))) == {"u1", "u2", "u3", "m", "s"}
    got = upserted(spark, table, item("m", **fall))
    assert got["m"][:2] == (2026, "fall") and spark.read.parquet(table).count() == 5 and got["s"][1] == "summer"
    # The last row of a season leaves it, one gets a season, one loses it; the same batch again changes nothing.
    batch = (item("s", **fall), item("u1"), item("m", **undated))
    first = upserted(spark, table, *batch)
    assert first == upserted(spark, table, *batch) and spark.read.parquet(table).count() == 5
    assert first["s"][1] == "fall" and first["u1"][1] == "summer" and first["m"][:2] == (None, None)
    before = first
    with pytest.raises(library.LibraryError):
        upserted(spark, table, item("u2", timezone="UTC"))
    assert {r.id: (r.season_year, r.season_quarter, r.updateTime) for r in spark.read.parquet(table).collect()} == before
    assert upserted(spark, table, item("u2"), item("u2", updateTime="20:00", updatedAt="2026-07-29T00:00:00Z"))["u2"] == (2026, "summer", "20:00")
    assert "PartitionFilters: [((" in spark.read.parquet(table).where(library.in_seasons({(None, None), (2026, "fall")}))._jdf.queryExecution().toString()
