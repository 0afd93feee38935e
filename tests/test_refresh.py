"""Merges, the fold, and refreshing a season."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from loomline import schema
from loomline.operators import merge, refresh
from loomline.sources.library import LibraryError

from .items import NOW, bound, episode, frame, item, source

AT = datetime(2026, 7, 28, 3, tzinfo=timezone.utc)
BANGUMI, REVIEW = [source("Bangumi", "bangumi", scope="metadata")], [source("YourAnimes")]


def folded(spark, *items):
    return merge.fold_items(frame(spark, items)).orderBy("ordinal").collect()


def test_two_rows_of_one_title(spark):
    a = item("a", title__aliases=["x"], schedule=[episode("2026-07-10", 2)], sources=[source("One")])
    b = item("b", title__aliases=["y", "x"], schedule=[episode("2026-07-03"), episode("2026-07-10", 2)], sources=[source("Two")], inclusionStatus="optional", dataStatus="complete")
    got = folded(spark, a, b)
    assert len(got) == 1 and got[0].id == "a" and got[0].title.aliases == ["x", "y"] and len(got[0].schedule) == 2 and len(got[0].sources) == 2 and (got[0].inclusionStatus, got[0].dataStatus) == ("optional", "complete")
    assert [e.airDate for e in got[0].schedule] == ["2026-07-03", "2026-07-10"]


def test_catalogue_takes_only_metadata_from_the_database(spark):
    a, b = item("a", officialUrl="https://a.jp"), bound("anime:9", 9, officialUrl="https://b", startDate="2026-07-01", episodeCount=12, sources=BANGUMI)
    got = folded(spark, a, b)[0]
    assert (got.id, got.startDate, got.officialUrl, got.episodeCount, got.bangumi.rating) == ("anime:9", "2026-07-03", "https://a.jp", 12, 7.5)


def test_broadcast_review_moves_the_schedule_and_final_states_lose_their_slot(spark):
    a = bound("a", 1, sources=BANGUMI, schedule=[episode("2026-07-03"), episode("2026-07-10", 2)])
    b = item("b", sources=REVIEW, startDate="2026-07-04", updateTime="01:00", updateWeekday=6)
    got = folded(spark, a, b)[0]
    assert got.startDate == "2026-07-04" and [e.airDate for e in got.schedule] == ["2026-07-04", "2026-07-11"] and {e.airTime for e in got.schedule} == {"01:00"}
    both = frame(spark, [bound("a", 1, status="finished"), b]).withColumn("i", merge.packed(merge.own()))
    over = both.groupBy().pivot("id", ["a", "b"]).agg(F.first("i")).select(merge.reviewed(F.col("a"), F.col("b")).alias("o")).first().o
    assert over.status == "finished" and over.updateTime is None and over.updateWeekday is None


def test_other_subjects_with_the_same_title_stay(spark):
    assert len(folded(spark, bound("a", 1, sources=BANGUMI), bound("b", 2, sources=BANGUMI))) == 2


def test_fold_in_order(spark):
    """A place keeps its name, takes in titles, and a later row finds it by what an earlier one brought."""
    c = item("c", "銀河", title__aliases=["Galaxy"])
    d = bound("d", 4, title__original="銀河", title__japanese=None, title__aliases=["Ginga"], sources=BANGUMI)
    r = item("r", "Ginga", title__japanese=None, title__chinese=None, sources=REVIEW)
    e = bound("e", 4, title__original="べつ", title__japanese="べつ", title__chinese="べつ", sources=BANGUMI)
    got = folded(spark, c, d, r, e)
    assert [x.id for x in got] == ["anime:4", "e"] and {s.name for s in got[0].sources} == {"YucWiki", "Bangumi", "YourAnimes"}
    assert [x.id for x in folded(spark, r, c)] == ["r", "c"]
    fall = {"startDate": "2026-10-02", "primarySeason": {"year": 2026, "quarter": "fall"}}
    assert len(folded(spark, item("a"), item("a"), item("b", **fall), item("u", startDate=None, primarySeason=None))) == 3
    plan = merge.fold_items(frame(spark, [c, d]))._jdf.queryExecution().toString()
    assert "Coalesce 1" not in plan and "MapInArrow" not in plan


def run(spark, old, new, **more):
    empty = spark.createDataFrame([], schema.OVERRIDE)
    return refresh.refresh_season(frame(spark, old), frame(spark, new), more.pop("overrides", empty), 2026, 7, AT, **more)


def rows(df):
    return {r.id: r for r in df.collect()}


def test_refresh_replaces_the_season_only(spark):
    fall = item("fall", "よその", startDate="2025-10-03", primarySeason={"year": 2025, "quarter": "fall"}, activeSeasons=[{"year": 2025, "quarter": "fall"}], schedule=[episode("2025-10-03")])
    gone = item("gone", "さようなら")
    new = [item("new", "あたらしい"), item("web", "うぇぶ", format="web"), bound("secondary", 5, title__original="ふたつめ", title__japanese="ふたつめ", sources=BANGUMI)]
    got = run(spark, [fall, gone], new)
    assert set(rows(got.library)) == {"fall", "new"} and got.summary["fetched"] == 1 and got.summary["skippedNonJapanese"] == 1 and got.summary["written"] == 2


def test_refresh_keeps_what_the_library_knows(spark):
    old = bound("anime:9001", 9001, title__original="つづき", title__japanese="つづき", createdAt="2026-01-01T00:00:00Z", schedule=[episode("2026-07-03", time="22:00")], updateTime="22:00")
    new = item("anime:yucwiki:202607:a01", "つづき", updateTime=None, updateWeekday=None, schedule=[episode("2026-07-03")])
    got = rows(run(spark, [old], [new]).library)
    assert set(got) == {"anime:9001"} and got["anime:9001"].bangumi.rating == 7.5 and got["anime:9001"].createdAt == "2026-01-01T00:00:00Z" and got["anime:9001"].updateTime == "22:00" and got["anime:9001"].schedule[0].airTime == "22:00"


def test_cold_start_and_reviews_alone(spark):
    review = item("r", "れびゅう", sources=REVIEW, dataStatus="complete")
    got = rows(run(spark, [], [review]).library)
    assert (got["r"].inclusionStatus, got["r"].dataStatus) == ("needs_review", "partial")
    assert set(rows(run(spark, [], [review, item("c", "かたろぐ")]).library)) == {"c"}
    fallback = rows(run(spark, [item("kept", "まえから")], [review]).library)
    assert set(fallback) == {"kept", "r"}


def test_overrides_and_inheritance(spark):
    manual = spark.createDataFrame([("a", "2026-07-05", "21:00", "desk", "https://desk", None)], schema.OVERRIDE)
    got = rows(run(spark, [], [item("a")], overrides=manual).library)["a"]
    assert (got.startDate, got.updateTime, got.updateWeekday, got.timezone, got.schedule[0].airDate) == ("2026-07-05", "21:00", 7, "Asia/Shanghai", "2026-07-05")
    entries = spark.createDataFrame([("A01", None, "のこる", "https://page#A01", NOW)], "id string, titleChinese string, titleJapanese string, url string, retrievedAt string")
    kept = rows(run(spark, [item("stay", "のこる"), item("go", "きえる")], [item("new", "あたらしい")], unscheduled=entries).library)
    assert set(kept) == {"stay", "new"}


def test_gates(spark):
    warned = spark.createDataFrame([("YucWiki", "NETWORK_FAILED", "x", True, None, None)], schema.SOURCE_ISSUE)
    with pytest.raises(LibraryError) as error:
        run(spark, [], [], warnings=warned)
    assert error.value.code == "SOURCE_UNAVAILABLE"
    with pytest.raises(LibraryError) as error:
        run(spark, [], [item("a", timezone="UTC")])
    assert error.value.code == "CACHE_VALIDATION_FAILED"
    past = datetime(2027, 7, 1, tzinfo=timezone.utc)
    with pytest.raises(LibraryError):
        refresh.refresh_season(frame(spark, []), frame(spark, [item("a")]), spark.createDataFrame([], schema.OVERRIDE), 2026, 7, past)
    assert set(rows(run(spark, [item("kept")], [], warnings=warned).library)) == {"kept"}
