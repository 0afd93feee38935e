"""Eligibility, listing, quality, preferences and library files on small items."""

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from loomline.functions import seasons
from loomline.operators import listing, prefs, quality, rules
from loomline.sources import catalogue_html, library, remote

from .items import NOW, bound, episode, frame, item, source

KEPT = [
    item("plain"), item("rated", title__chinese=None, bangumi__ratingCount=50), item("protected", title="はたらく 国产", officialUrl="https://x.jp/"), item("english", "Some Title"), bound("kana", 1, sources=[source("Bangumi", "bangumi")]),
    item("season10", title__chinese="标题 第10季"),
]
DROPPED = [
    item("web", format="web"), item("unrated", title__chinese=" ", bangumi__ratingCount=49), item("foreign flag", isJapaneseAnime=False), item("excluded", inclusionStatus="excluded", exclusionReason="x"), item("adult", title__aliases=["R-18"]),
    item("brand", title__english="Paw Patrol"), item("foreign", "国产动画"), item("korean", "라바 이야기", title__japanese=None), item("movie", title__chinese="剧场版"), item("recap", title__chinese="总集篇"), item("season11", title__chinese="标题 第11季"), item("season12", title__chinese="标题 第十二期"),
    bound("listed", 219760), bound("database only", 2, title={"original": "Name", "japanese": None, "chinese": "名", "english": None, "aliases": []}, sources=[source("Bangumi", "bangumi")]),
]


def test_eligibility(spark):
    got = {r.id: r.ok for r in frame(spark, KEPT + DROPPED).select("id", rules.eligible().alias("ok")).collect()}
    assert [i["id"] for i in KEPT if not got[i["id"]]] == [] and [i["id"] for i in DROPPED if got[i["id"]]] == []


def ids(df):
    return [r.id for r in df.collect()]


def test_season_page(spark):
    winter, spring = {"year": 2026, "quarter": "winter"}, {"year": 2026, "quarter": "spring"}
    old = item("old", startDate="2026-01-05", primarySeason=winter, activeSeasons=[winter, spring], updateWeekday=1)
    items = frame(spark, [item("late", primarySeason=spring, updateWeekday=7), item("none", primarySeason=spring, updateWeekday=None, updateTime=None), old, item("early", primarySeason=spring, updateWeekday=7, updateTime="01:00"), item("optional", primarySeason=spring, inclusionStatus="optional"), item("web", format="web", primarySeason=spring)])
    at = lambda y, m, d: datetime(y, m, d, tzinfo=timezone.utc)
    assert ids(listing.season_page(items, 2026, 4, at(2026, 5, 1))) == ["old", "optional", "early", "late", "none"]
    assert ids(listing.season_page(items, 2026, 4, at(2026, 8, 1), include_optional=False)) == ["early", "late", "none"]
    for year, month in ((1899, 4), (2026, 5), (True, 1)):
        with pytest.raises(listing.QueryError) as error:
            listing.season_page(items, year, month, at(2026, 5, 1))
        assert error.value.code == "INVALID_QUERY"


def test_search(spark):
    items = frame(spark, [item("a", "Galaxy Song"), item("b", "Song of Galaxy", primarySeason={"year": 2027, "quarter": "winter"}), item("c", "galaxy"), item("d", "Other", title__aliases=["ＧＡＬＡＸＹ"]), item("e", "Galaxy", format="web")])
    found = listing.search(items, " Galaxy ").collect()
    assert [r.id for r in found] == ["c", "d", "a", "b"] and found[1].matchedTitle == "ＧＡＬＡＸＹ" and found[0].displayTitle == "标题c" and found[0].secondaryTitle == "galaxy"
    assert ids(listing.search(items, "galaxy song", 1)) == ["a"] and ids(listing.search(items, "  ")) == [] and listing.search_limit(900) == 50 and listing.search_limit(None) == 20
    assert ids(listing.items_by_id(items, [" c", "b", "c", "zz", "e"])) == ["b", "c"]
    assert len(listing.wanted_ids([str(i) for i in range(900)])) == 500


def test_sorts_and_follow_list(spark):
    items = frame(spark, [item("a", "B", bangumi__rating=7.0, updateTime=None), item("b", "A", bangumi__rating=8.0, startDate=None), item("c", "C", updateWeekday=1, updateTime="00:30", status="delayed"), item("d", "D", bangumi__rating=7.0, status="finished", startDate="2026-01-01")])
    order = lambda m: ids(listing.sort_items(items, m))
    assert order("ratingAsc") == ["a", "d", "b", "c"] and order("ratingDesc") == ["b", "a", "d", "c"] and order("startDateAsc") == ["d", "a", "c", "b"] and order("updateTimeAsc") == ["b", "d", "a", "c"] and order("updateTimeDesc")[0] == "c"
    assert ids(listing.follow_list(items, 5)) == ["b", "a"] and ids(listing.follow_list(items, 7)) == ["c"]
    assert ids(listing.follow_list(items, 5, frame(spark, [item("a")]))) == ["a"]
    assert listing.status_summary(items).first().asDict() == {"complete": 0, "partial": 4, "conflicting": 0, "unverified": 0}
    assert ids(listing.filter_view(items, ["finished"], "new", 2026, 7)) == ["d"] and ids(listing.filter_view(items, ["airing"], "continuing", 2026, 10)) == ["a", "b"]


def test_issues(spark):
    bad = item("bad", startDate="2026-02-30", updateTime="24:30", timezone="UTC", updateWeekday=8, dataStatus="odd", episodeCount=1, airedEpisodeCount=2, sources=[source(" ", "what")], schedule=[episode("2026-7-1", time="9:00")], createdAt="yesterday")
    got = quality.issues(frame(spark, [item("good"), bad, item("good")]))
    codes = {(r.id, r.path, r.code) for r in got.where("severity = 'error'").collect()}
    assert codes == {
        ("bad", "startDate", "INVALID_DATE"), ("bad", "updateTime", "INVALID_TIME"), ("bad", "timezone", "INVALID_TIMEZONE"), ("bad", "updateWeekday", "INVALID_WEEKDAY"), ("bad", "dataStatus", "INVALID_DATA_STATUS"),
        ("bad", "airedEpisodeCount", "AIRED_EPISODES_OVER_TOTAL"), ("bad", "sources.0.name", "MISSING_SOURCE_NAME"), ("bad", "sources.0.type", "INVALID_SOURCE_TYPE"), ("bad", "schedule.0.airDate", "INVALID_AIR_DATE"), ("bad", "schedule.0.airTime", "INVALID_TIME"),
        ("bad", "createdAt", "INVALID_ISO_DATETIME"), ("good", "id", "DUPLICATE_ID"),
    }
    assert quality.blocking(got) and {r.issue: r.n for r in quality.histogram(got).collect()}["warning:MISSING_BANGUMI_RATING"] == 3
    assert not quality.blocking(quality.issues(frame(spark, [item("good"), bound("b", 3)])))


def test_audit(spark):
    found = quality.audit(frame(spark, [bound("a", 7), bound("b", 7), item("c", format="web", title__chinese="标题a"), item("d", coverImage=None, status="finished")]))
    buckets = {r.bucket: (r.n, r.examples) for r in found["buckets"].collect()}
    assert buckets["nonTv"] == (1, ["c"]) and buckets["missingCover"] == (1, ["d"]) and buckets["finishedWithUpdateSlot"] == (1, ["d"]) and buckets["missingBangumiSubject"][0] == 2 and buckets["excludedStatus"] == (0, [])
    assert [(r.key, r.members) for r in found["subjects_same_season"].collect()] == [(7, ["a", "b"])] and [r.members for r in found["titles"].collect()] == [["a", "c"]]
    assert [tuple(r) for r in found["sources"].collect()] == [("YucWiki", 4)]
    errors, rows = quality.audit_failures(found)
    blocked = sum(buckets[name][0] for name in quality.BLOCKING)
    assert rows == blocked + 2 and errors == sum(r.n for r in found["issues"].collect() if r.issue.startswith("error:"))
    assert quality.exit_code((errors, rows)) == 1
    tidy = quality.audit_failures(quality.audit(frame(spark, [bound("a", 7, coverImage={"large": "l", "medium": None, "small": None, "source": "bangumi"})])))
    assert tidy == (0, 0) and quality.exit_code(tidy) == 0


def test_preferences(spark):
    ids_ = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    lists = prefs.consistent(ids_("b", "a", "b", ""), ids_("a", "c"), ids_("c"))
    r = spark.range(1).select(lists.alias("l"), prefs.toggle_completed(lists, F.lit("a")).alias("t"), prefs.toggle_watching(lists, F.lit("c")).alias("w"), prefs.toggle_follow(lists, F.lit("a")).alias("f"),
                              prefs.reconciled(prefs.consistent(ids_("airing", "finished"), ids_("airing", "finished", "unknown"), ids_()), ids_("airing", "finished"), ids_("finished")).alias("k")).first()
    assert tuple(r.l) == (["a", "b"], ["a"], ["c"]) and tuple(r.t) == (["a", "b"], [], ["a", "c"]) and tuple(r.w) == tuple(r.l) and r.f.followed == ["b"]
    assert tuple(r.k) == (["airing"], ["finished", "unknown"], [])


def test_files(spark, tmp_path):
    path = tmp_path / "library.json"
    path.write_text(json.dumps({"schemaVersion": 1, "updatedAt": NOW, "generatedBy": "manual-edit", "items": [item("a"), item("b")]}, ensure_ascii=False, indent=1))
    items = library.read(spark, str(path))
    assert sorted(ids(items)) == ["a", "b"] and library.read(spark, str(tmp_path / "none.json")).count() == 0
    table = str(tmp_path / "table")
    library.write_table(items.drop("ordinal"), table)
    fall = item("c", startDate="2026-10-02", primarySeason={"year": 2026, "quarter": "fall"}, activeSeasons=[{"year": 2026, "quarter": "fall"}], schedule=[episode("2026-10-02")], updateWeekday=5)
    library.write_table(frame(spark, [fall]).drop("ordinal"), table)
    library.write_table(frame(spark, [item("d")]).drop("ordinal"), table)
    assert sorted(ids(library.read_table(spark, table))) == ["c", "d"]
    with pytest.raises(library.LibraryError):
        library.write_table(frame(spark, [item("x", updateTime="24:30")]).drop("ordinal"), table)
    assert library.read_overrides(spark, str(tmp_path / "none")).count() == 0
    library.append_log(spark, {"event": "x"}, str(tmp_path / "log"))
    library.append_log(spark, {"event": "y"}, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    status = spark.createDataFrame([(1, "running", None, None, None, ("j", 2026, 7, "summer", "2026-07-28T00:00:00Z"), (None, 3))], __import__("loomline.schema", fromlist=["STATUS"]).STATUS)
    assert library.expire_lock(status, "2026-07-28T00:15:00Z").first().status == "running"
    late = library.expire_lock(status, "2026-07-28T00:15:01Z").first()
    assert late.status == "failed" and late.currentJob is None and late.lastError.code == "STALE_UPDATE_LOCK"
    union, problems = library.union_sources(spark, [("one", lambda: items), ("two", lambda: 1 / 0)])
    assert union.count() == 2 and problems.first().source == "two"


def test_season_page_reads_its_own_files(spark, tmp_path):
    fall = item("c", startDate="2026-10-02", primarySeason={"year": 2026, "quarter": "fall"}, activeSeasons=[{"year": 2026, "quarter": "fall"}], schedule=[episode("2026-10-02")], updateWeekday=5)
    library.write_table(frame(spark, [item("a"), fall]).drop("ordinal"), str(tmp_path / "t"))
    page = listing.season_page(library.read_table(spark, str(tmp_path / "t")), 2026, 7, datetime(2027, 5, 1, tzinfo=timezone.utc))
    plan = page._jdf.queryExecution().toString()
    assert ids(page) == ["a"] and "(season_quarter" in plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    for at in (datetime(2026, 6, 16, 15, tzinfo=timezone.utc), datetime(2026, 6, 16, 16, 1), datetime(2026, 12, 17, 16), datetime(2026, 1, 31)):
        order = spark.range(1).select(seasons.season_order(seasons.current_season(F.to_timestamp(F.lit(at.strftime("%Y-%m-%dT%H:%M:%SZ"))))).alias("o")).first().o
        assert seasons.order_now(at) == order


def test_documents_and_status(spark, tmp_path):
    folder, path = str(tmp_path), str(tmp_path / "library.json")
    library.bootstrap(spark, folder, NOW)
    assert library.read(spark, path).count() == 0
    library.replace_document(spark, path, library.document_of(frame(spark, [item("a"), item("b")]), NOW, "manual-update"))
    library.bootstrap(spark, folder, NOW)
    assert sorted(ids(library.read(spark, path))) == ["a", "b"] and json.loads((tmp_path / "library.json.bak").read_text())["items"] == []
    kept = (tmp_path / "library.json").read_text()
    for broken in ("{", ""):
        with pytest.raises(ValueError):
            library.replace_document(spark, path, broken)
    with pytest.raises(library.LibraryError):
        library.document_of(frame(spark, [item("x", timezone="UTC")]), NOW, "manual-update")
    with pytest.raises(library.LibraryError):
        library.document_of(frame(spark, [item("x")]), "yesterday", "manual-update")
    assert (tmp_path / "library.json").read_text() == kept and not (tmp_path / "library.json.tmp").exists()
    status = str(tmp_path / "status.json")
    assert library.read_status(spark, status, NOW).first().status == "idle" and library.read_status(spark, str(tmp_path / "none.json"), NOW).first().cache.itemCount == 0
    running = library.EMPTY_STATUS | {"status": "running", "lastSuccessAt": "2026-07-01T00:00:00Z", "currentJob": {"jobId": "j", "year": 2026, "season": 7, "quarter": "summer", "startedAt": "2026-07-28T00:00:00Z"}, "cache": {"animeUpdatedAt": "2026-07-01T00:00:00Z", "itemCount": 7}}
    library.replace_document(spark, status, json.dumps(running))
    now = library.read_status(spark, status, "2026-07-28T00:10:00Z")
    good, bad = library.succeeded(now, "2026-07-28T00:11:00Z", 9).first(), library.failed(now, "2026-07-28T00:11:00Z", "X", "y").first()
    assert (good.status, good.lastAttemptAt, good.cache.itemCount, good.currentJob) == ("success", "2026-07-28T00:00:00Z", 9, None)
    assert (bad.status, bad.lastSuccessAt, bad.cache.itemCount, bad.lastError.code, bad.currentJob) == ("failed", "2026-07-01T00:00:00Z", 7, "X", None)
    assert library.read_status(spark, status, "2026-07-28T01:00:00Z").first().status == "failed" and json.loads((tmp_path / "status.json").read_text())["lastError"]["code"] == "STALE_UPDATE_LOCK"
    cache = tmp_path / "cache.json"
    assert library.write_through(spark, str(cache), [], "s") == [] and not cache.exists()
    assert library.write_through(spark, str(cache), [{"id": 1}], "s") == [] and json.loads(cache.read_text()) == [{"id": 1}]
    (tmp_path / "file").write_text("x")
    assert library.write_through(spark, str(tmp_path / "file" / "below.json"), [{"id": 1}], "s")[0][1] == "CACHE_WRITE_FAILED"


def test_remote_lists(spark):
    schema = "id long, name string"
    schema = spark.createDataFrame([], schema).schema
    asked = []

    def client(limit, offset):
        asked.append(offset)
        rows = [{"id": (offset + k) % 250, "name": f"n{offset + k}", "more": 1} for k in range(limit if offset < 200 else 60)]
        return 200, json.dumps({"data": rows})

    got = remote.listed(spark, client, schema).collect()
    assert asked == [0, 100, 200] and len(got) == 250 and [got[0].id, got[0].name, got[9].name, got[10].name] == [0, "n250", "n259", "n10"]
    endless = lambda limit, offset: (200, json.dumps({"data": [{"id": offset + k} for k in range(limit)]}))
    assert sum(map(len, remote.pages(endless))) == 1100
    for answer, code in (((429, ""), "RATE_LIMITED"), ((500, ""), "API_ERROR"), ((200, "<"), "SOURCE_SCHEMA_CHANGED"), ((200, "[]"), "SOURCE_SCHEMA_CHANGED")):
        with pytest.raises(remote.RemoteError) as error:
            list(remote.pages(lambda limit, offset, answer=answer: answer))
        assert error.value.code == code
    rows, failed = remote.details(spark, lambda n: (200, json.dumps({"id": n, "name": "x"})) if n != 2 else 1 / 0, [1, 2, 2, 3], schema)
    assert sorted(r.id for r in rows.collect()) == [1, 3] and [f[:2] for f in failed] == [(2, "NETWORK_FAILED")]
    found = {"aa": [{"id": 3, "name": "x"}, {"id": 1, "name": "y"}], "bb": [{"id": 1, "name": "z"}, *({"id": k, "name": "w"} for k in range(10, 30))]}
    rows, failed = remote.searched(spark, lambda title: (200, json.dumps({"data": found[title]})), [("original", "aa"), ("alias", "cc"), ("alias", "bb")], schema)
    assert [tuple(r) for r in rows.collect()] == [(3, "x"), (1, "y"), *((k, "w") for k in range(10, 20))] and [f[:2] for f in failed] == [("cc", "NETWORK_FAILED")]
    assert remote.searched(spark, lambda title: (500, ""), [], schema)[0].count() == 0
    one = spark.createDataFrame([(1,)], "id int")
    assert catalogue_html.with_next_page(one, one).count() == 2 and catalogue_html.with_next_page(one.limit(0), one).count() == 0 and catalogue_html.with_next_page(one, None).count() == 1
